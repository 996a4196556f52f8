import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from siftlode.llm import conversation as c

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def broken(rows):
    """The contract's damage, row by row, in the order of turns."""
    out = []
    text = lambda v: " " if v is None else str(v)
    for conv, turn, role, t in rows:
        k = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, t = text(role), text(t)
        if k == 1:
            t = ""
        if k == 2:
            t = re.sub("[.!?]", "", t)
        if k == 4:
            role = "user"
        out += [(turn, role, t)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(turns):
    out, seen = [], set()
    for _, role, t in turns:
        bare = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", t)
        out.append("blank" if not bare else "duplicate" if (role, t) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, t))
    return out


def tried(turns):
    """Every choice of edits, with up to two insertions of either kind at each place, the cheapest, then the least."""
    f, best = faults(turns), None
    inserts = ["", "u", "a", "ua", "au"]
    for acts in product(*(("D",) if x in ("blank", "duplicate") else ("K", "Ru", "Ra", "D") for x in f)):
        for ins in product(inserts, repeat=len(turns) + 1):
            audit, roles, out, cost = "", "", [], 0
            for i in range(len(turns) + 1):
                for x in ins[i]:
                    audit, roles, cost = audit + "I", roles + x, cost + 5
                    out.append(c.ROLES[x] + ":")
                if i == len(turns):
                    break
                a = acts[i]
                audit += a[0]
                if a == "D":
                    cost += 2
                    continue
                role = turns[i][1] if a == "K" else c.ROLES[a[1]]
                cost += (a != "K") + 5 * (f[i] == "truncated")
                roles += role[:1] or "?"
                out.append(f"{role}:{turns[i][2]}")
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, sha("\n".join(out)))
    return best


def figures(turns):
    own = [t for t, _, _ in turns if t is not None]
    f = faults(turns)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (max(own) - min(own) + 1 - len(set(own)) if own else 0, *map(f.count, ("blank", "duplicate", "truncated")), illegal)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(rng, convs, longest):
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "u"], ["Yes.", "No", "Hm?", " ", None, "So!\n", "Yes."]
    return [(i if i else None, rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.3 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{t}{i}.") for i in range(convs) for t in range(rng.randint(0, longest))]


@pytest.mark.parametrize("long", [None, 2])
def test_all_edits(spark, long):
    rows = random_rows(random.Random(5), 60, 3)
    want = {}
    for conv in {r[0] for r in rows}:
        t = broken([r for r in rows if r[0] == conv])
        if len(t) <= 4:
            want[conv] = (conv, *figures(t), *tried(t))
    got = c.op13_conversations(frame(spark, rows), long)
    assert got.columns == COLS
    found = {r.conv_id: tuple(r) for r in got.collect()}
    assert found.keys() == {r[0] for r in rows} and len(want) > 40
    assert {k: found[k] for k in want} == want


def plain(turns):
    """The same program with whole audits held."""
    f = faults(turns)
    best = {"-": (0, "", ())}
    for (_, role, t), x in zip(turns, f):
        new = {q: (v[0] + 2, v[1] + "D", v[2]) for q, v in best.items()}
        if x not in ("blank", "duplicate"):
            for q, (cost, audit, out) in best.items():
                for to in "sua":
                    if q + to in c.GAP and (to != "s" or role[:1] == "s"):
                        gap, keep = c.GAP[q + to], role[:1] == to
                        v = (cost + 5 * len(gap) + (not keep) + 5 * (x == "truncated"), audit + "I" * len(gap) + ("K" if keep else "R"))
                        v += (out + tuple(c.ROLES[g] + ":" for g in gap) + (f"{role if keep else c.ROLES[to]}:{t}",),)
                        new[to] = min(new.get(to, v), v)
        best = new
    cost, audit, out = min((v[0] + 5 * len(c.TAIL[q]), v[1] + "I" * len(c.TAIL[q]), v[2] + tuple(c.ROLES[g] + ":" for g in c.TAIL[q])) for q, v in best.items())
    return cost, audit, sha("\n".join(out))


@pytest.mark.parametrize("long", [None, 7])
def test_longer(spark, long):
    rows = random_rows(random.Random(6), 40, 60)
    want = {conv: (conv, *figures(t := broken([r for r in rows if r[0] == conv])), *plain(t)) for conv in {r[0] for r in rows}}
    assert {r.conv_id: tuple(r) for r in c.op13_conversations(frame(spark, rows), long).collect()} == want


def test_one_conversation_has_most_rows(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"text {t % 700}.") for t in range(3000)] + [(2, 0, "user", "a?"), (2, 1, "assistant", "b.")]
    want = {conv: (conv, *figures(t := broken([r for r in rows if r[0] == conv])), *plain(t)) for conv in (1, 2)}
    assert {r.conv_id: tuple(r) for r in c.op13_conversations(frame(spark, rows), 100).collect()} == want


def test_dropped_empty_and_extra_columns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    d = frame(spark, [(gone, 0, "user", "x.")]).selectExpr("*", "'k' as key", "1 as part", "2 as pos", "'f' as fate")
    assert [tuple(r) for r in c.op13_conversations(d).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]
    assert c.op13_conversations(frame(spark, [])).count() == 0


def test_query(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    by = {}
    for r in d.collect():
        by.setdefault(r.conv_id, []).append((r.conv_id, r.turn, r.role, r.text))
    want = {k: (k, *figures(t := broken(v)), *plain(t)) for k, v in by.items()}
    assert {r.conv_id: tuple(r) for r in c.op13_conversations(d).collect()} == want


def test_sql(spark):
    rows = random_rows(random.Random(12), 80, 7)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.sql(f"SELECT {', '.join(COLS)} FROM ({c.SQL})").fetchall(), key=str)
    assert sorted(map(tuple, c.op13_conversations(frame(spark, rows)).select(*COLS).collect()), key=str) == want

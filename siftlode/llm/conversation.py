"""Repair of conversation structure at least cost, with an audit of the edits.

A repaired conversation has roles ``(s?(ua)+)?`` by their initials. Each turn is kept, given another role or deleted, and
turns may be inserted. The program runs over the retained turns: a turn retained with a role follows an earlier one
with any role, what lies between is deleted at a price read from prefix sums, and the pair of roles says which turns
must be inserted. For each role of the last retained turn only the least price less the prefix sum is carried on.
Of equal prices the smaller audit wins; audits of one length of input are never prefixes of each other before the
end, so the order of two is that of their parents, or else of the letters that were added, and no audit is held.

Conversations of up to ``LONG`` turns are repaired by one task each. Longer ones are numbered across tasks and cut
into blocks; each block gives the prices from every state to every state, a walk over the blocks chooses the
states, and each block is repaired between its own two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import SEPARATORS, numbered, written

#: Turns up to which one task repairs a whole conversation; longer ones are cut into blocks of as many.
LONG = 4096
#: Conversations of up to so many turns are solved once for each sequence of turn kinds.
CACHED = 24
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing retained yet, or the initial of the role retained last.
STATES = "-sua"
ROLES = {"u": "user", "a": "assistant"}
#: Initials that must be inserted between two states; pairs not named cannot follow each other.
GAP = {"-s": "", "-u": "", "-a": "u", "su": "", "sa": "u", "ua": "", "uu": "a", "au": "", "aa": "u"}
#: Initials that must be inserted at the end.
TAIL = {"-": "", "s": "ua", "u": "a", "a": ""}

Live = dict[str, tuple[int, int]]


def advance(live: Live, kind: str) -> tuple[Live, dict[str, tuple[str, str]]]:
    """Takes one turn: live states (price less the prefix sum of deletions, rank of the audit) and, for each, where it
    came from and the letters added. kind: the turn's initial, and 'x' (to be deleted), 't' (truncated) or 'k'."""
    every = {q: [(price, rank, "D", q)] for q, (price, rank) in live.items()}
    if kind[1] != "x":
        own = (TRUNCATED if kind[1] == "t" else 0) - DELETE
        for q, (price, rank) in live.items():
            for to in "sua":
                gap = GAP.get(q + to)
                if gap is None or (to == "s" and kind[0] != "s"):
                    continue
                keep = to == kind[0]
                every.setdefault(to, []).append((price + own + INSERT * len(gap) + (0 if keep else REROLE), rank, "I" * len(gap) + ("K" if keep else "R"), q))
    best = {q: min(found) for q, found in every.items()}
    order = {k: n for n, k in enumerate(sorted({b[1:3] for b in best.values()}))}
    return {q: (b[0], order[b[1:3]]) for q, b in best.items()}, {q: (b[3], b[2]) for q, b in best.items()}


def ended(live: Live) -> tuple[int, str]:
    """The price and state of the best end."""
    price, _, _, q = min((price + INSERT * len(TAIL[q]), rank, "I" * len(TAIL[q]), q) for q, (price, rank) in live.items())
    return price, q


def solve(kinds: tuple[str, ...], first: str = "-", last: str | None = None) -> tuple[int, tuple[tuple[str, str, str], ...], str]:
    """(cost, (letters, state before, state after) of each turn, state at the end) of the best way from state ``first``
    to ``last`` (None: to the end, whose insertions count)."""
    live, back = {first: (0, 0)}, []
    for kind in kinds:
        live, came = advance(live, kind)
        back.append(came)
    price, q = ended(live) if last is None else (live[last][0], last)
    end, out = q, []
    for came in reversed(back):
        before, letters = came[q]
        out.append((letters, before, q))
        q = before
    return price + DELETE * len(kinds), tuple(reversed(out)), end


solved = lru_cache(100_000)(solve)


def kind_of(role: str, text: str, seen: bool) -> tuple[str, str]:
    """(kind for the program, the turn's first fault or '')."""
    bare = text.strip(SEPARATORS)
    fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else ""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return initial + {"": "k", "truncated": "t"}.get(fault, "x"), fault


def edited(turns: list[tuple[str, str]], edits, end: str, last: bool) -> tuple[str, list[str], list[str]]:
    """(audit, roles, texts) after edits; last: the end's insertions belong to it."""
    audit, roles, texts = [], [], []
    insert = lambda initials: (roles.extend(ROLES[i] for i in initials), texts.extend("" for _ in initials))
    for (role, text), (letters, before, after) in zip(turns, edits):
        audit.append(letters)
        if letters != "D":
            insert(GAP[before + after])
            roles.append(role if letters[-1] == "K" else ROLES[after])
            texts.append(text)
    if last:
        audit.append("I" * len(TAIL[end]))
        insert(TAIL[end])
    return "".join(audit), roles, texts


def illegal_pair(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


_FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _packed(rows: Iterator[tuple], schema: pa.Schema, chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches; the last field's lists tell the size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + sum(len(t) for t in r[-1]) if isinstance(r[-1], list) else 200
        if size > chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _ddl(ddl: str) -> str:
    return ddl.replace(" longs", " array<long>").replace(" strings", " array<string>")


_WHOLE = "key string, part long, " + ", ".join(f"{f} long" for f in _FIGURES) + ", audit string, roles strings, texts strings"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (key, turn, role, text) of short conversations to one row each."""

    def each() -> Iterator[tuple]:
        for key, rows in groupby(_rows(batches), lambda r: r[0]):
            rows = list(rows)
            turns, seen, kinds, faults = [r[2:4] for r in rows], set(), [], []
            for t in turns:
                kind, fault = kind_of(*t, t in seen)
                seen.add(t)
                kinds.append(kind)
                faults.append(fault)
            own = [r[1] for r in rows if r[1] is not None]
            gaps = max(own) - min(own) + 1 - len(set(own)) if own else 0
            cost, edits, end = (solved if len(kinds) <= CACHED else solve)(tuple(kinds))
            illegal = sum(illegal_pair(a[0], b[0]) for a, b in zip(turns, turns[1:]))
            yield key, 0, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, *edited(turns, edits, end, True)

    return _packed(each(), _arrow(_WHOLE))


_BLOCK = "key string, part long, prices longs, ranks longs, blank long, duplicate long, truncated long, illegal long, n long, first string, last string"


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (key, part, pos, role, text, seen) to a row for each part: prices and ranks from each state to each
    (16 numbers, -1: no way), fault counts and the initials at both ends."""

    def each() -> Iterator[tuple]:
        for (key, part), rows in groupby(_rows(batches), lambda r: r[:2]):
            counts, illegal, n, first, before = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, 0, 0, None, None
            live = {q: {q: (0, 0)} for q in STATES}
            for _, _, _, role, text, seen in rows:
                kind, fault = kind_of(role, text, seen)
                counts[fault] += 1
                illegal += before is not None and illegal_pair(before, role)
                first, before, n = role[:1] if first is None else first, role[:1], n + 1
                live = {q: advance(x, kind)[0] for q, x in live.items()}
            cells = [live[a].get(b) for a in STATES for b in STATES]
            prices = [-1 if c is None else c[0] + DELETE * n for c in cells]
            yield key, part, prices, [-1 if c is None else c[1] for c in cells], counts["blank"], counts["duplicate"], counts["truncated"], illegal, n, first, before

    return _packed(each(), _arrow(_BLOCK))


_CHOSEN = "key string, part long, state string, next string, ends long, blank long, duplicate long, truncated long, illegal long, cost long"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``_priced`` to the states each part runs between; the conversation's figures on its first part."""

    def each() -> Iterator[tuple]:
        for key, rows in groupby(_rows(batches), lambda r: r[0]):
            live, back, sums, before = {"-": (0, 0)}, [], [0, 0, 0, 0], None
            for _, _, prices, ranks, blank, duplicate, truncated, illegal, _, first, last in rows:
                best: dict[str, tuple] = {}
                for q, (price, rank) in live.items():
                    for i, to in enumerate(STATES, 4 * STATES.index(q)):
                        if prices[i] >= 0:
                            best[to] = min(best.get(to, (float("inf"),)), (price + prices[i], rank, ranks[i], q))
                order = {k: n for n, k in enumerate(sorted({b[1:3] for b in best.values()}))}
                live = {q: (b[0], order[b[1:3]]) for q, b in best.items()}
                back.append({q: b[3] for q, b in best.items()})
                across = before is not None and illegal_pair(before, first)
                sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal + across))]
                before = last
            cost, q = ended(live)
            path = [q]
            for came in reversed(back):
                path.append(came[path[-1]])
            path.reverse()
            for part, (a, b) in enumerate(zip(path, path[1:])):
                yield key, part, a, b, int(part == len(back) - 1), *(sums if part == 0 else [0] * 4), cost if part == 0 else 0

    return _packed(each(), _arrow(_CHOSEN))


_PART = "key string, part long, audit string, roles strings, texts strings"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (key, part, pos, role, text, seen, state, next, ends) to each part's audit and turns."""

    def each() -> Iterator[tuple]:
        for (key, part), rows in groupby(_rows(batches), lambda r: r[:2]):
            rows = list(rows)
            turns = [r[3:5] for r in rows]
            _, edits, end = solve(tuple(kind_of(*t, r[5])[0] for t, r in zip(turns, rows)), rows[0][6], rows[0][7])
            yield key, part, *edited(turns, edits, end, bool(rows[0][8]))

    return _packed(each(), _arrow(_PART))


def repair(turns: DataFrame, long: int | None = None) -> DataFrame:
    """(key, part, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts) of turns (key, turn, role, text).

    One row (part 0) for each conversation of up to ``long`` turns. Longer ones have a row for each ``long`` turns: their
    figures are on part 0, and audit, roles and texts of the parts follow one another. Turns are taken by turn
    (nulls first), then role, then text; equal rows are adjacent. key, role and text must not be null; empty and
    very long texts are turns like others. Other columns are not read. An empty table gives no rows.
    """
    long = long or LONG
    turns = turns.select("key", F.col("turn").cast("long").alias("turn"), "role", "text")
    sizes = turns.groupBy("key").count()
    many = written(sizes.where(F.col("count") > long).select("key"), "long")
    some = not many.isEmpty()
    own = turns.join(many, "key", "left_anti") if some else turns
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    whole = own.repartition("key").sortWithinPartitions(*order).mapInArrow(_whole, _ddl(_WHOLE))
    if not some:
        return whole
    placed = written(numbered(written(turns.join(many, "key", "left_semi"), "turns"), ["key"], ["turn", "role", "text"]), "turns")
    first = placed.groupBy("key", "role", "text").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(False).alias("seen"))
    marked = placed.join(first, ["key", "pos"], "left").select("key", F.expr(f"pos div {long}").alias("part"), "pos", "role", "text", F.coalesce("seen", F.lit(True)).alias("seen"))
    marked = written(marked, "turns")
    priced = marked.repartition("key", "part").sortWithinPartitions("key", "part", "pos").mapInArrow(_priced, _ddl(_BLOCK))
    chosen = written(written(priced, "prices").repartition("key").sortWithinPartitions("key", "part").mapInArrow(_chosen, _ddl(_CHOSEN)), "states")
    given = marked.join(chosen.select("key", "part", "state", "next", "ends"), ["key", "part"])
    given = given.select("key", "part", "pos", "role", "text", "seen", "state", "next", "ends")
    parts = given.repartition("key", "part").sortWithinPartitions("key", "part", "pos").mapInArrow(_repaired, _ddl(_PART))
    span = placed.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")).select("key", F.lit(0).cast("long").alias("part"), "gaps")
    figures = chosen.join(span, ["key", "part"], "left").select("key", "part", F.coalesce("gaps", F.lit(0)).alias("gaps"), *_FIGURES[1:])
    return whole.unionByName(parts.join(figures, ["key", "part"]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted parts (key, part, figures, audit, text) to one row a conversation; the texts are hashed as they pass."""

    def each() -> Iterator[tuple]:
        for key, rows in groupby(_rows(batches), lambda r: r[0]):
            sums, audit, digest, begun = [0] * len(_FIGURES), [], hashlib.sha256(), False
            for r in rows:
                sums = [a + b for a, b in zip(sums, r[2:-2])]
                audit.append(r[-2])
                if r[-1] is not None:
                    digest.update((b"\n" if begun else b"") + r[-1].encode("utf-8", "surrogatepass"))
                    begun = True
            yield key, *sums, "".join(audit), digest.hexdigest()

    return _packed(each(), _arrow(_DIGEST))


_DIGEST = "key string, " + ", ".join(f"{f} long" for f in _FIGURES) + ", audit string, repaired_sha256 string"


def digests(repaired: DataFrame, long: bool = False) -> DataFrame:
    """(key, figures, audit, repaired_sha256) of the rows of ``repair``; long: some conversations have several parts, whose
    texts pass through one task each, one part at a time, since one hash covers them in order."""
    text = F.when(F.size("roles") > 0, F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n"))
    flat = repaired.select("key", "part", *_FIGURES, "audit", text.alias("text"))
    if long:
        return flat.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_hashed, _ddl(_DIGEST))
    return flat.select("key", *_FIGURES, "audit", F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))


def key_of(column: str):
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text) of conversations (conv_id, turn, role, text) after the contract's damage; nulls count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    d = conversations.select(key_of("conv_id").alias("key"), "turn", part("role").alias("role"), part("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("key", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_conversations(conversations: DataFrame, long: int | None = None) -> DataFrame:
    """The contract's columns for every conv_id of whole ``conversations``, nulls as one conversation."""
    broken = damaged(conversations)
    parts = repair(broken, long)
    some = not broken.groupBy("key").count().where(F.col("count") > (long or LONG)).isEmpty()
    every = conversations.groupBy(key_of("conv_id").alias("key")).agg(F.first("conv_id").alias("conv_id"))
    d = every.join(digests(parts, some), "key", "left")
    zeros = {f: F.coalesce(f, F.lit(0).cast("long")).alias(f) for f in _FIGURES}
    empty = hashlib.sha256(b"").hexdigest()
    return d.select("conv_id", *zeros.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: CRC-32 of an ASCII text, bit by bit.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
#: What a turn can do in each state: (state, state after, initials inserted before it); an empty state after deletes it.
_MOVES = ", ".join([*(f"('{p[0]}', '{p[1]}', '{ins}')" for p, ins in GAP.items()), *(f"('{q}', '', '')" for q in STATES)])
_TURNS = {i: f"chr(10) || '{r}:'" for i, r in ROLES.items()}
#: The same program with whole audits and texts in its rows.
SQL = rf"""
WITH RECURSIVE hurt AS (
  SELECT k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM (SELECT *, {_CRC} % 20 AS fate FROM (SELECT coalesce('=' || conv_id::VARCHAR, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations)) WHERE fate <> 0),
seq AS MATERIALIZED (
  SELECT k, turn, role, text, i, left(role, 1) AS ini, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS bare
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt))),
moves(f, t, ins) AS (VALUES {_MOVES}),
walk(k, i, st, best) AS (
  SELECT DISTINCT k, 0::BIGINT, '-', {{'c': 0::BIGINT, 'a': '', 'o': ''}} FROM seq
  UNION ALL
  SELECT k, i, st, min(best) FROM (
    SELECT s.k, s.i, CASE WHEN t = '' THEN w.st ELSE t END AS st, CASE WHEN t = '' THEN {{'c': best.c + {DELETE}, 'a': best.a || 'D', 'o': best.o}} ELSE {{
      'c': best.c + {INSERT} * len(ins) + CASE WHEN ini = t THEN 0 ELSE {REROLE} END + CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END,
      'a': best.a || repeat('I', len(ins)) || CASE WHEN ini = t THEN 'K' ELSE 'R' END,
      'o': best.o || CASE ins WHEN 'u' THEN {_TURNS["u"]} WHEN 'a' THEN {_TURNS["a"]} ELSE '' END || CASE WHEN ini = t THEN chr(10) || role || ':' WHEN t = 'u' THEN {_TURNS["u"]} ELSE {_TURNS["a"]} END || text}} END AS best
    FROM walk w JOIN seq s ON s.k = w.k AND s.i = w.i + 1 JOIN moves ON f = w.st AND (t = '' OR (fault NOT IN ('blank', 'duplicate') AND (t <> 's' OR ini = 's'))))
  GROUP BY k, i, st),
size AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM seq GROUP BY k),
ends AS (SELECT k, min(CASE st WHEN 's' THEN {{'c': best.c + 10, 'a': best.a || 'II', 'o': best.o || {_TURNS["u"]} || {_TURNS["a"]}}} WHEN 'u' THEN {{'c': best.c + 5, 'a': best.a || 'I', 'o': best.o || {_TURNS["a"]}}} ELSE best END) AS best
  FROM walk JOIN size USING (k) WHERE i = n GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || conv_id::VARCHAR, '') AS k FROM conversations) LEFT JOIN size USING (k) LEFT JOIN ends USING (k)
"""

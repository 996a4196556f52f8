import hashlib
import zlib

import duckdb
import pytest

from siftlode.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def row_hash(d, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, (d["doc_id"], d["source"], d["lang"], d["n_chars"], text))))


def grown(h):
    """All levels of a tree over hashes."""
    out = [h]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """[(hashes before, hashes after)] of each level."""
    out = []
    for level in tree[:-1]:
        a = i // 8 * 8
        out.append((level[a:i], level[i + 1 : a + 8]))
        i //= 8
    return out


def brute(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = {}
    for d in docs:
        by.setdefault(d["lang"], []).append((d["doc_id"] is not None, d["doc_id"] or 0, row_hash(d, d["text"]), d))
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        by[g].sort(key=lambda x: x[:3])
        trees[g] = grown([x[2] for x in by[g]])
    top = grown([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, d) in enumerate(by[g]):
            steps = path(trees[g], i) + path(top, k)
            hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0
            h = row_hash(d, d["text"].translate(low)) if hit and d["text"] is not None else leaf
            for a, b in steps:
                h = sha("".join(a) + h + "".join(b))
            out.append((d["doc_id"], leaf, trees[g][-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for a, b in steps)), h, h == top[-1][0]))
    return out


def made(n):
    return [{"doc_id": i, "text": [None, "", "Ab é", "plain", "X" * 5000][i % 5], "lang": [None, "en", "en", "en", "", "É", "z"][i % 7] if i != 3 else "alone", "source": None if i % 4 == 0 else f"s{i}", "n_chars": i or None} for i in range(n)]


@pytest.mark.parametrize("docs", [made(1), made(9), made(300), made(20) + made(20) + [{"doc_id": None, "text": "A", "lang": "en", "source": None, "n_chars": None}] * 3])
def test_brute_force(spark, docs):
    df = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], SCHEMA)
    got = merkle.op12_merkle(df)
    assert got.columns == COLS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs), key=str)


def test_many_groups(spark):
    docs = [{"doc_id": i, "text": "Tt", "lang": f"g{i % 80}", "source": "s", "n_chars": 2} for i in range(100)]
    df = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], SCHEMA)
    assert sorted(map(tuple, merkle.op12_merkle(df).collect()), key=str) == sorted(brute(docs), key=str)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.op12_merkle(df).count() == 0
    docs = made(12)
    df = spark.createDataFrame([tuple(d[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for d in docs], SCHEMA)
    for c in ("h", "g", "key", "leaf", "root", "pos", "n", "c", "__m", "__p", "path"):
        df = df.selectExpr("*", f"'x' as `{c}`")
    assert sorted(map(tuple, merkle.op12_merkle(df).collect()), key=str) == sorted(brute(docs), key=str)


def test_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"SELECT {', '.join(COLS)} FROM ({merkle.SQL})").fetchall()
    got = merkle.op12_merkle(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select(*COLS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) == sorted(brute([r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]), key=str)

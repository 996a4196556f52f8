"""run() over the smallest tables against the same five stages by plain means: SQL, sets and loops."""

import base64

import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers
import tiktoken
from siftlode.llm import decontaminate, quality

D = "/root/testdata/sf0.001"


def in_sql(sql, rows, columns):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{D}/benchmark.parquet'")
    return con.sql(f"SELECT {columns} FROM ({sql})").fetchall()


def near_duplicates_dropped(rows):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (len(a & b) >= 0.8 * len(a | b) if a and b else rows[i][1] == rows[j][1]):
                x, y = label[i], label[j]
                label = [x if v == y else v for v in label]
    least = {}
    for (i, _), v in zip(rows, label):
        least[v] = min(least.get(v, i), i)
    return [(i, t) for (i, t), v in zip(rows, label) if least[v] == i]


def without_repeats(rows):
    words = [(i, t.encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        out.append((i, b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_the_whole_pipeline_by_plain_means(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall()
    kept = {i for i, k in in_sql(quality.SQL, rows, "doc_id, kept") if k}
    rows = [(i, t) for i, t in rows if i in kept]
    n = len(rows)
    rows = near_duplicates_dropped(rows)
    assert 0 < len(rows) < n
    rows = without_repeats(rows)
    leaked = {i for i, k in in_sql(decontaminate.SQL, rows, "doc_id, contaminated") if k}
    want = {i: t for i, t in rows if i not in leaked}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id: " ".join(r.text.encode().decode().split()) for r in got} == {i: " ".join(t.split()) for i, t in want.items()}
    for r in got:
        assert list(r.ids) == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.round_trip

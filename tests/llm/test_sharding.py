import random
import zlib
from collections import Counter

from siftlode.llm import sharding

SCHEMA = "doc_id long, text string, shard string, n int"


def rows():
    r = random.Random(1)
    out = [(i, "é" * r.randrange(200), "x", i) for i in range(700)]
    return [*out, (700, None, None, 1), (701, "", None, 1), (None, "n", "y", 2), (None, "m", "y", 3), (5, out[5][1], "x", 5), (702, "long " * 200_000, "z", 9)]


def test_law_and_round_trip(spark):
    src = rows()
    d = sharding.shuffled_shards(spark.createDataFrame(src, SCHEMA), shards=7, bucket_bytes=3000)
    got = d.collect()
    assert d.columns == ["doc_id", "text", "n", "slot", "shard"] or set(d.columns) == {"doc_id", "text", "n", "slot", "shard"}
    assert Counter((r.doc_id, r.text, r.n) for r in got) == Counter((a, b, c) for a, b, _, c in src)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))


def test_order_is_shuffled_and_seeded(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    place = lambda seed, d: {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shuffled_shards(d, 4, seed, bucket_bytes=20_000).collect()}
    a, b, c = place(1, docs), place(2, docs), place(1, docs.repartition(7))
    same = {k for k in a if list(k)[0] != 5}
    assert {k: a[k] for k in same} == {k: c[k] for k in same} and a != b
    order = [k[0] for k, _ in sorted(a.items(), key=lambda x: (x[1][1], x[1][0])) if k[0] is not None]
    up = sum(x < y for x, y in zip(order, order[1:]))
    assert 0.4 < up / len(order) < 0.6


def test_contract_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    for r in sharding.op7_shards(docs).collect():
        t = (r.doc_id, r.law, r.grown_shard)
        assert t[1:] == ("rows", None)
        if r.doc_id == 700:
            assert (r.size, r.text_crc32) == (1, 0)
        if r.doc_id == 702:
            assert (r.size, r.text_crc32) == (1_000_001, zlib.crc32(b"long " * 200_000))
    assert sharding.op7_shards(docs.limit(0)).collect() == []

import random

import duckdb
import pandas as pd

from siftlode.llm import decontaminate as D

BENCH = [
    (0, "A farmer has 12 apples and gives 5 km of rope to Mary before Mary sells the 12 apples at noon for profit"),
    (1, "plain words only stand here one after the other until the item ends with this last line"),
    (2, "too short"), (3, None),
]
DOCS = [
    (0, "Intro text. A farmer has 30 apples and gives 7 km of rope to Anna before Anna sells the 30 apples at noon for profit. More."),
    (1, "A farmer has 30 apples and gives 7 km of rope to Anna before Bob sells the 31 apples at noon for profit"),
    (2, "PLAIN words only, stand here one after\n the other until the item ends with this last line!"),
    (3, "Nothing of it. " * 30), (4, None), (5, ""), (6, "short"), (7, "word " * 20000), (None, BENCH[1][1]), (8, BENCH[0][1]), (8, BENCH[0][1]),
    (9, " ".join(["filler"] * 20000) + " " + BENCH[1][1] + " " + " ".join(["tail"] * 50)), (10, "too short"),
]


def run(spark, docs, bench):
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, key string, item int")
    return D.contaminated(d, spark.createDataFrame(bench, "item_id long, text string"))


def test_reparameterised_items(spark):
    out = run(spark, DOCS, BENCH).collect()
    assert len(out) == len(DOCS) and out[0].key == "k"
    got = {(r.doc_id, tuple(r.item_ids)) for r in out if r.contaminated}
    assert got == {(0, (0,)), (2, (1,)), (None, (1,)), (8, (0,)), (9, (1,))}
    assert all(r.coverage == 0 and r.item_ids == [] for r in out if not r.contaminated)


def test_empty_tables(spark):
    assert not any(r.contaminated for r in run(spark, DOCS, []).collect())
    assert run(spark, [], BENCH).collect() == []


def test_a_large_benchmark_is_shuffled(spark, monkeypatch):
    want = sorted((str(r.doc_id), r.item_ids) for r in run(spark, DOCS, BENCH).collect())
    monkeypatch.setattr(D, "MAX_BROADCAST", 1)
    assert sorted((str(r.doc_id), r.item_ids) for r in run(spark, DOCS, BENCH).collect()) == want


def test_items_without_templates(spark):
    names = "we saw Anna Bell Carl Dora Emil Fred Gina 12 34 56 78 and left"
    bench = [(0, names), (1, "who wrote the old green book"), (2, "two words"), (3, ""), (4, "one two three four")]
    docs = [
        (0, names), (1, "Before. " + names + " After."), (2, "who wrote the old green book"), (3, "so: Who wrote the old green book? nobody"), (4, "who wrote the old red book"),
        (5, "two words"), (6, ""), (7, None), (8, "we saw Anna Bell Carl and left"), (9, "who wrote the old, the old green book"), (10, "one two three four five"), (11, "four three two one"),
    ]
    got = {r.doc_id: (r.item_ids, r.coverage) for r in run(spark, docs, bench).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {0: ([0], 1.0), 1: ([0], 1.0), 2: ([1], 1.0), 3: ([1], 1.0), 10: ([4], 1.0)}
    con = duckdb.connect()
    d, b = (pd.DataFrame(x, columns=[c, "text"]) for x, c in ((docs, "doc_id"), (bench, "item_id")))
    con.register("documents", d)
    con.register("benchmark", b)
    assert {i: (x, c) for i, _, x, c in con.sql(D.SQL).fetchall()} == got

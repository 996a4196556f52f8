import random

import numpy as np
import pytest

from siftlode import session
from siftlode.operators import encoder, graph as gr, matches, patterns, rings

FUSED = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (5, 6), (6, 7), (7, 4)]  # a ring of six and one of four share 4-5
BRIDGED = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 0), (0, 6), (6, 3)]  # three paths between 0 and 3
TREE = [(0, 1), (1, 2), (1, 3)]


def graph(spark, **named):
    return spark.createDataFrame([(g, a, b) for g, es in named.items() for a, b in es], "g string, s int, d int")


def test_rings(spark):
    e = graph(spark, fused=FUSED, bridged=BRIDGED, tree=TREE, triangle=[(2, 1), (1, 0), (0, 2), (2, 2), (1, 2)], two=[(0, 1), (1, 2), (2, 0), (5, 6), (6, 7), (7, 5), (2, 5)])
    r = rings.smallest_rings(e, 8)
    got = {(x.g, x.s, x.d): x.ring for x in r.collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "fused"} == {(0, 1): 6, (1, 2): 6, (2, 3): 6, (3, 4): 6, (4, 5): 4, (0, 5): 6, (5, 6): 4, (6, 7): 4, (4, 7): 4}
    assert {k[1:]: v for k, v in got.items() if k[0] == "bridged"} == {(0, 1): 5, (1, 2): 5, (2, 3): 5, (3, 4): 5, (4, 5): 5, (0, 5): 5, (0, 6): 5, (3, 6): 5}
    assert {v for k, v in got.items() if k[0] == "tree"} == {None} and len([k for k in got if k[0] == "triangle"]) == 3
    assert got["two", 2, 5] is None and got["two", 5, 6] == 3
    assert {x.ring for x in rings.smallest_rings(e.where("g = 'fused'"), 5).collect()} == {4, None}
    assert {(x.v, x.in_ring, x.min_ring) for x in rings.vertex_rings(r.where("g = 'fused'")).collect()} == {(0, True, 6), (1, True, 6), (2, True, 6), (3, True, 6), (4, True, 4), (5, True, 4), (6, True, 4), (7, True, 4)}
    assert {(x.g, x.ring_edges, x.max_ring) for x in rings.graph_rings(r).collect()} == {("fused", 9, 6), ("bridged", 8, 5), ("tree", 0, 0), ("triangle", 3, 3), ("two", 6, 3)}
    assert rings.smallest_rings(e.limit(0)).count() == 0


def test_rings_are_shortest(spark):
    rng = random.Random(2)
    every = {f"g{k}": list({(min(a, b), max(a, b)) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(13)) if a != b}) for k in range(20)}
    want = {}
    for g, es in every.items():
        for a, b in es:
            near = {v: {y for x, y in es + [(y, x) for x, y in es] if x == v and {x, y} != {a, b}} for v in range(9)}
            front, level, seen = {a}, 0, {a}
            while front and b not in front:
                front, level = {y for x in front for y in near[x]} - seen, level + 1
                seen |= front
            want[g, a, b] = level + 1 if front and level + 1 <= 6 else None
    assert {(x.g, x.s, x.d): x.ring for x in rings.smallest_rings(graph(spark, **every), 6).collect()} == want


def test_patterns(spark):
    v = spark.createDataFrame([("a", 0, "O"), ("a", 1, "C"), ("a", 2, "O"), ("a", 3, "H"), ("b", 0, "C"), ("b", 1, "C"), ("b", 2, "C")], "g string, v int, label string")
    e = spark.createDataFrame([("a", 0, 1, 2), ("a", 1, 2, 1), ("a", 2, 3, 1), ("b", 0, 1, 1), ("b", 1, 2, 1), ("b", 2, 0, 1)], "g string, s int, d int, kind int")
    ps = [
        patterns.Pattern("carbonyl", ("C", "O"), ((0, 1, 2),)),
        patterns.Pattern("acid", ("O", "C", "O", "H"), ((0, 1, 2), (1, 2, 1), (2, 3, 1))),
        patterns.Pattern("any C-O", ("C", "O"), ((0, 1, None),)),
        patterns.Pattern("triangle", ("C", "C", "C"), ((0, 1, 1), (1, 2, 1), (2, 0, 1))),
        patterns.Pattern("chain", ("C", "C", "C"), ((0, 1, 1), (1, 2, 1))),
        patterns.Pattern("square", ("C", "C", "C", "C"), ((0, 1, None), (1, 2, None), (2, 3, None), (3, 0, None))),
    ]
    found = patterns.pattern_matches(v, e, ps)
    assert {(x.g, x.pattern, tuple(x.atoms)) for x in found.collect()} == {("a", "carbonyl", (0, 1)), ("a", "acid", (0, 1, 2, 3)), ("a", "any C-O", (0, 1)), ("a", "any C-O", (1, 2)), ("b", "triangle", (0, 1, 2)), ("b", "chain", (0, 1, 2))}
    assert found.count() == 6
    assert {(x.cid, x.atom): x.label for x in matches.best_label(patterns.hits(found, ps)).collect()} == {("a", 0): "acid", ("a", 1): "acid", ("a", 2): "acid", ("a", 3): "acid", ("b", 0): "triangle", ("b", 1): "triangle", ("b", 2): "triangle"}
    with pytest.raises(ValueError):
        patterns.Pattern("apart", ("C", "O")).steps({})


def test_common_starts_are_joined_once():
    counts = {"C": 9, "N": 5, "O": 1}
    a = patterns.Pattern("a", ("C", "O", "N"), ((0, 1, 1), (0, 2, 1))).steps(counts)
    b = patterns.Pattern("b", ("O", "C", "C"), ((0, 1, 1), (1, 2, 1))).steps(counts)
    assert a[0] == b[0] == ("O", ()) and a[1] == b[1] == ("C", ((0, 1),))


def loop_encoder(w, x, pairs, pooling):
    dense = lambda v, layer: [sum(v[i] * layer[0][i][j] for i in range(len(v))) + layer[1][j] for j in range(len(layer[1]))]
    relu = lambda v: [max(a, 0) for a in v]
    h, e = [dense(v, w.node) for v in x], {k: dense(f, w.edge) for k, f in pairs.items()}
    for edges, first, second, own in w.rounds:
        new = []
        for i, v in enumerate(h):
            total = [(1 + own) * a for a in v]
            for (s, d), f in e.items():
                if d == i:
                    total = [t + m for t, m in zip(total, relu([a + b for a, b in zip(h[s], dense(f, edges))]))]
            new.append(relu(dense(relu(dense(total, first)), second)))
        h = new
    if w.last:
        h = [dense(relu(dense(v, w.last[0])), w.last[1]) for v in h]
    return [sum(c) / (len(h) if pooling == "mean" else 1) for c in zip(*h)]


@pytest.mark.parametrize("pooling", ["mean", "sum"])
def test_encoder(spark, pooling):
    rng = np.random.default_rng(1)
    layer = lambda a, b: (rng.normal(size=(a, b)), rng.normal(size=b))
    w = encoder.Weights(layer(2, 5), layer(1, 3), [(layer(3, 5), layer(5, 5), layer(5, 5), 0.1), (layer(3, 5), layer(5, 5), layer(5, 5), -0.2)], (layer(5, 5), layer(5, 4)))
    r = random.Random(1)
    vs, es, want = [], [], {}
    for g in range(25):
        n = r.randint(1, 7)
        ids = sorted(r.sample(range(100), n))
        x = [[r.random(), r.random()] for _ in ids]
        one = {(min(a, b), max(a, b)): [r.random()] for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(n)) if a != b}
        vs += [(g, i, *f) for i, f in zip(ids, x)]
        es += [(g, ids[a], ids[b], *f) for (a, b), f in one.items()]
        want[g] = loop_encoder(w, x, one | {(b, a): f for (a, b), f in one.items()}, pooling)
    vs += [(50, 0, 1.0, float("nan")), (51, 0, 1.0, None), (52, 1, 1.0, 1.0)]
    es += [(52, 1, 9, 0.5), (50, 0, 1, 0.5)]
    want[52] = loop_encoder(w, [[1.0, 1.0]], {}, pooling)
    packed = encoder.nested(spark.createDataFrame(vs, "g int, v int, a double, b double"), spark.createDataFrame(es, "g int, s int, d int, k double"), ["a", "b"], ["k"])
    for vertices in (1, 9, 10_000):
        got = {x.g: x for x in encoder.embedded(packed, w, pooling, vertices).collect()}
        assert {g: x.status for g, x in got.items() if x.status != "ok"} == {50: "failed", 51: "failed"}
        for g, v in want.items():
            assert got[g].embedding == pytest.approx(v, abs=1e-9)
    with pytest.raises(ValueError):
        encoder.embedded(packed, w, "max")


def test_charges(spark):
    v = spark.createDataFrame([("a", 0, "X", None), ("a", 1, "Y", None), ("b", 0, "X", 1), ("b", 1, "X", None), ("b", 2, "?", 2), ("c", 0, "Y", -1)], "g string, v int, kind string, charge int")
    e = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("b", 0, 1), ("b", 1, 2), ("b", 1, 1)], "g string, s int, d int")
    kinds = spark.createDataFrame([("X", 2.0, 1.0, 0.0, 10.0), ("Y", 4.0, 1.0, 0.0, 20.0)], "kind string, a double, b double, c double, top double")
    one = {(r.g, r.v): r.charge for r in gr.equalised(v, e, kinds, rounds=1).collect()}
    assert one == pytest.approx({("a", 0): 0.1, ("a", 1): -0.1, ("b", 0): 0.95, ("b", 1): 0.05, ("b", 2): 2.0, ("c", 0): -1.0})
    for rounds in (2, 5, 9):
        total = {}
        for r in gr.equalised(v, e, kinds, rounds=rounds, cut=2).collect():
            total[r.g] = total.get(r.g, 0) + r.charge
        assert total == pytest.approx({"a": 0, "b": 3, "c": -1})


def test_edges_of_a_small_molecule(spark):
    # C=C-C=C-C-C with a ring of three at the end: conjugated are the first three
    e = spark.createDataFrame([("m", 0, 1, 2.0), ("m", 2, 1, 1.0), ("m", 2, 3, 2.0), ("m", 3, 4, 1.0), ("m", 4, 5, 1.0), ("m", 5, 6, 1.0), ("m", 6, 4, 1.0), ("m", 7, 8, 1.5)], "g string, s int, d int, order double")
    r = rings.smallest_rings(e, 6)
    got = {(x.s, x.d): (x.order, x.in_ring, x.conjugated, tuple(x.degrees)) for x in gr.edge_features(e, r).collect()}
    assert got == {(0, 1): (2.0, False, True, (1, 2)), (1, 2): (1.0, False, True, (2, 2)), (2, 3): (2.0, False, True, (2, 2)), (3, 4): (1.0, False, False, (2, 3)), (4, 5): (1.0, True, False, (3, 2)), (5, 6): (1.0, True, False, (2, 2)), (4, 6): (1.0, True, False, (3, 2)), (7, 8): (1.5, False, True, (1, 1))}
    nested = gr.edge_index(e.where("s = 0 or s = 7"), ["order"]).first().edges
    assert [(x.s, x.d, x.x) for x in nested] == [(0, 1, [2.0]), (1, 0, [2.0]), (7, 8, [1.5]), (8, 7, [1.5])]


def test_vertex_features(spark):
    # a ring of three carbons, one bound to a charged N and one double to an O; a lone atom
    v = spark.createDataFrame([("m", 0, "C", 0), ("m", 1, "C", 0), ("m", 2, "C", None), ("m", 3, "N", 1), ("m", 4, "O", 0), ("x", 0, "?", 0)], "g string, v int, label string, charge int")
    e = spark.createDataFrame([("m", 0, 1, 1.0), ("m", 1, 2, 1.0), ("m", 2, 0, 1.0), ("m", 0, 3, 1.0), ("m", 4, 1, 2.0), ("m", 1, 4, 2.0)], "g string, s int, d int, order double")
    out = gr.vertex_features(v, e, rings.smallest_rings(e, 6), {"C": 4, "N": 3, "O": 2})
    got = {(r.g, r.v): (r.degree, r.explicit_valence, r.implicit_valence, r.total_valence, r.total_degree, r.is_in_ring, r.min_ring_size) for r in out.collect()}
    assert got == {("m", 0): (3, 3, 1, 4, 4, True, 3), ("m", 1): (3, 4, 0, 4, 3, True, 3), ("m", 2): (2, 2, 2, 4, 4, True, 3), ("m", 3): (1, 1, 3, 4, 4, False, 0), ("m", 4): (1, 2, 0, 2, 1, False, 0), ("x", 0): (0, 0, 0, 0, 0, False, 0)}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_graphs_are_shuffled_once(spark):
    # edges that lie by graph are not dealt again for each join and group
    dealt = graph(spark, fused=FUSED, tree=TREE).withColumn("kind", (1 + (1 + gr.F.col("s")) % 2)).withColumn("order", gr.F.lit(1.0)).repartition(5, "g")
    v = dealt.select("g", gr.F.explode(gr.F.array("s", "d")).alias("v")).distinct().withColumns({"label": gr.F.lit("C"), "kind": gr.F.lit("C"), "charge": gr.F.lit(0), "x": gr.F.lit(1.0)})
    kinds = spark.createDataFrame([("C", 7.98, 9.18, 1.88, 19.04)], "kind string, a double, b double, c double, top double")
    r = rings.smallest_rings(dealt, 6)
    ps = [patterns.Pattern("pair", ("C", "C"), ((0, 1, 2),)), patterns.Pattern("chain", ("C", "C", "C"), ((0, 1, None), (1, 2, None)))]
    # one for each use of the tables, and one by graph behind a function in Python
    assert shuffles(r) == 1 and shuffles(rings.vertex_rings(r)) == shuffles(rings.graph_rings(r)) == 2
    assert shuffles(gr.edge_index(gr.edge_features(dealt, r), ["order"])) <= 4 and shuffles(gr.vertex_features(v, dealt, r, {"C": 4}).groupBy("g").count()) <= 5
    assert shuffles(gr.equalised(v, dealt, kinds)) <= 2 and shuffles(encoder.nested(v, dealt, ["x"], ["kind"])) <= 2
    assert shuffles(matches.best_label(patterns.hits(patterns.pattern_matches(v, dealt, ps), ps))) <= 3


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD", 10)
    d = spark.range(95)
    assert [session.spread(d, x, "id").rdd.getNumPartitions() for x in (d, d.limit(5))] == [10, int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_null_graphs_and_vertices_of_text(spark):
    e = spark.createDataFrame([(None, "a", "b"), (None, "b", "c"), (None, "a", "c"), (1, "a", "b"), (1, "c", "b"), (1, "a", "c"), (2, "x", None)], "g int, s string, d string")
    assert {(x.g, x.s, x.d, x.ring) for x in rings.smallest_rings(e, 6).collect()} == {(None, "a", "b", None), (None, "b", "c", None), (None, "a", "c", None), (1, "a", "b", 3), (1, "b", "c", 3), (1, "a", "c", 3)}

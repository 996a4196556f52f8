import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from siftlode.functions import text, vector
from siftlode.operators import clean, filters, graph, knn, order, sample, stats


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("1.5", 1.5), (" \t2\n", 2.0), ("nan", None), ("inf", None), ("abc", None), ("", None), ("1d", None), ("N/A", None), (None, None)])
def test_parse_finite(spark, raw, want):
    assert one(spark, text.parse_finite("x"), raw) == want


def test_text_functions(spark):
    assert one(spark, text.trim_all("x"), "\t a b \n") == "a b"
    assert one(spark, text.slug("x"), "--A b/C!") == "a_b_c"
    assert one(spark, text.last_parenthesis("x"), "a (b) c (d) e") == "d" and one(spark, text.last_parenthesis("x"), "none") == ""
    assert one(spark, text.ellipsis("x", 5), "abcdefg") == "ab..." and one(spark, text.ellipsis("x", 5), "abcde") == "abcde"
    assert one(spark, text.flags_array("x"), "[0,1,1]") == [0, 1, 1] and one(spark, text.flags_array("x"), "[0,2]") is None
    assert one(spark, text.set_positions("x"), [0, 1, 1], "array<int>") == [1, 2]
    assert one(spark, text.triples("x"), [1.0] * 6, "array<double>") == [[1.0] * 3] * 2 and one(spark, text.triples("x"), [1.0] * 4, "array<double>") is None
    assert one(spark, text.comma_decimal("x"), "3,5") == 3.5 and one(spark, text.comma_decimal("x"), "x") == 0.0
    assert one(spark, text.integer_key("x"), "007") == 7 and one(spark, text.integer_key("x"), "7.5") is None
    assert one(spark, text.number_in_name("x"), "model_epoch_12.pt") == 12 and one(spark, text.number_in_name("x"), "best.pt") is None
    assert one(spark, text.mentions("x", "AB"), "name (AB)") and one(spark, text.mentions("x", "AB"), "x, AB. y")
    assert not any(one(spark, text.mentions("x", "PDA"), v) for v in ("BPDA", "2,6-PDA", "PDAs", None)) and one(spark, text.mentions("x", "PDA"), "a (PDA-)")
    assert one(spark, text.has_isotope("x"), "[13C]") and not one(spark, text.has_isotope("x"), None)
    assert one(spark, text.one_hot("x", ["a", "b"]), "c") == [0, 0, 1] and one(spark, text.lookup("x", {"a": 1}, 4), "z") == 4
    assert one(spark, text.lenient_json("x", "a int"), "```json\n{'a': 3}\n```").a == 3


def test_best_row_per_key(spark):
    d = spark.createDataFrame([("k", 2.0, 1, "f"), ("k", 1.0, 3, "g"), ("k", 1.0, 2, "g"), ("k", None, 0, "f"), (None, 0.0, 4, "f")], "k string, v double, r int, f string")
    assert [r.r for r in clean.argmin_per_key(d, ["k"], "v", ["r"]).collect()] == [2]
    assert sorted(r.r for r in clean.argmin_per_key(d, ["k"], "v", ["r"], ["f"]).collect()) == [1, 2]


def test_lookups_and_exclusions(spark):
    d = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    t = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "null", 3)], "k int, v string, o int")
    assert sorted((str(r.k), r.v) for r in clean.lookup_join(d, t, "k", "v", "o").collect()) == [("1", "new"), ("2", ""), ("None", "")]
    assert sorted(str(r.k) for r in clean.exclude(d, t, ["k"]).collect()) == ["2", "None"]
    f = spark.createDataFrame([("a", "x"), ("z", "y"), (None, None)], "c string, s string")
    ref = spark.createDataFrame([("a", "y", 1.0, 1), ("a", "x", 2.0, 2), ("q", "y", 3.0, 3)], "c string, s string, v double, o int")
    assert [r.v for r in clean.fallback_join(f, ref, "c", "s", "v", "o").orderBy("c").collect()] == [None, 1.0, 1.0]
    j = spark.createDataFrame([("Chem & Bio",), ("CHEM AND BIO",), ("Other",)], "j string")
    assert sorted(str(r.i) for r in clean.variant_join(j, spark.createDataFrame([("chem and bio", 3)], "j string, i int"), "j", "i").collect()) == ["3", "3", "None"]


def test_bins_at_every_edge(spark):
    edges = [round(-3.0 + 0.1 * i, 1) for i in range(31)]
    d = spark.createDataFrame([(e,) for e in edges] + [(-3.1,), (0.1,), (None,)], "v double")
    got = {r.bin: r.n for r in stats.histogram(d, "v", edges).collect()}
    assert got == {i: 1 for i in range(29)} | {29: 2}


def test_statistics(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 5.0), ("b", 7.0), ("b", None)], "k string, v double")
    r = {x.k: x for x in stats.group_stats(d, ["k"], "v").collect()}
    assert (r["a"].median, r["a"].mean, r["b"].std, r["b"].n) == (3.0, 3.0, 0.0, 1) and stats.group_stats(d, ["k"], "v", 2).count() == 1
    m = stats.regression_metrics(spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "t double, p double"), "t", "p").first()
    assert (m.mae, m.rmse, m.r2) == (1.0, 1.0, None)
    assert {x.k: round(x.share, 3) for x in stats.share_with_total(d, "k").collect()} == {"a": 66.667, "b": 33.333, "TOTAL": 100.0}
    assert [x.v for x in stats.standardized(spark.createDataFrame([(3.0,), (3.0,)], "v double"), ["v"]).collect()] == [0.0, 0.0]
    assert {(x.a, x.b) for x in stats.pearson(spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0)], "a double, b double, c double"), ["a", "b", "c"]).collect()} == {("a", "a"), ("a", "b"), ("b", "b")}


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [9.0])], "i int, v array<double>")
    got = [(r.query_id, r.ref_id, r.rank) for r in knn.knn(v.where("i = 1"), v, "i", "v", 9, exclude_self=True).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    w = spark.createDataFrame([("1", "2"), ("x", "2")], "e0 string, e1 string")
    assert [r.embedding for r in knn.wide_vectors(w, "e", 2).collect()] == [[1.0, 2.0], None] and knn.wide_vectors(w, "e", 2, zero_fill=True).collect()[1].embedding == [0.0, 2.0]


def plain_neighbours(rows, k, exclude_self):
    out = []
    for q, v in rows:
        if not v or q is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        near = sorted((math.dist(v, w), r) for r, w in rows if r is not None and w is not None and len(w) == len(v) and all(x is not None and math.isfinite(x) for x in w) and not (exclude_self and r == q))
        out += [(q, r, i, round(d, 9)) for i, (d, r) in enumerate(near[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("exclude_self", [True, False])
@pytest.mark.parametrize("tile_bytes", [1 << 20, 900])
@pytest.mark.parametrize("name", [int, "v{:03d}".format])
def test_tiles_of_both_sides(spark, monkeypatch, exclude_self, tile_bytes, name):
    rng = random.Random(9)
    rows = [(name(i), [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(70)]  # many ties
    rows += [(name(i), [rng.gauss(1e6, 1) for _ in range(5)]) for i in range(70, 90)]
    rows += [(name(90), None), (None, [1.0, 1.0, 1.0]), (name(91), [float("nan"), 0.0, 0.0]), (name(92), [None, 0.0, 0.0]), (name(93), []), (name(94), [7.0])]
    monkeypatch.setattr(knn, "QUERY_ROWS", 16)
    monkeypatch.setattr(knn, "REF_ROWS", 8)
    v = spark.createDataFrame(rows, f"i {'long' if name is int else 'string'}, v array<double>").repartition(3)
    got = knn.knn(v, v, "i", "v", 4, exclude_self=exclude_self, tile_bytes=tile_bytes)
    assert sorted((r.query_id, r.ref_id, r.rank, round(r.distance, 9)) for r in got.collect()) == plain_neighbours(rows, 4, exclude_self)


def test_k_of_each_query(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "i int, v array<double>")
    got = knn.knn(v, v, "i", "v", F.col("i") % 3, exclude_self=True, tile_bytes=100)
    assert {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()} == {i: i % 3 for i in range(9) if i % 3}
    assert knn.knn(v.limit(0), v, "i", "v").count() == 0 and knn.knn(v, v.limit(0), "i", "v").count() == 0


def test_shuffle_grows_with_the_tables(spark, monkeypatch):
    def dealt(n):  # rows of both sides that reach the tasks
        seen, frame = [], type(spark.range(1))
        by = frame.repartitionById
        monkeypatch.setattr(frame, "repartitionById", lambda d, *a: (seen.append(d.count()), by(d, *a))[1])
        v = spark.range(n).select("id", F.array(F.col("id").cast("double"), F.rand(1)).alias("v"))
        assert knn.knn(v, v, "id", "v", 2, tile_bytes=1000).count() == 2 * n
        monkeypatch.undo()
        return seen[0]

    assert dealt(1000) == 10 * dealt(100)
    # 1 GB against as much: the root of the slots each way; few queries are not cut so finely that many references travel
    assert knn._grid(300 << 20, 300 << 20, 144) == (12, 12) and knn._grid(40 << 20, 40 << 30, 200) == (2, 100)
    # beyond the root, a tile keeps within what a task may hold
    assert knn._grid(32 << 30, 32 << 30, 144) == (1024, 1) and knn._grid(0, 0, 8)[0] == 1


def test_floats_are_compared_as_doubles(spark):
    rows = [(i, [1e4 + i / 1024, 3.0, -1e-3 * i]) for i in range(40)]
    v = spark.createDataFrame(rows, "i int, v array<float>")
    want = [tuple(r) for r in knn.knn(v, v.withColumn("v", F.col("v").cast("array<double>")), "i", "v", 3, tile_bytes=300).collect()]
    assert sorted(tuple(r) for r in knn.knn(v, v, "i", "v", 3, tile_bytes=300).collect()) == sorted(want)
    assert sorted(tuple(r) for r in knn.knn(v, v, "i", "v", 3).collect()) == sorted(want)


def test_samples_and_splits(spark):
    d = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in sample.exact(d, ["k"], 50, 1).collect()}
    assert len(a) == 50 and a == {r.k for r in sample.exact(d.repartition(7), ["k"], 50, 1).collect()} != {r.k for r in sample.exact(d, ["k"], 50, 2).collect()}
    assert 60 < sample.bernoulli(d, ["k"], 0.1, 3).count() < 140
    assert {r.split: r["count"] for r in sample.exact_split(d, ["k"], {"a": 0.7, "b": 0.2, "c": 0.1}).groupBy("split").count().collect()} == {"a": 700, "b": 200, "c": 100}
    assert {r.split for r in sample.hash_split(d, ["k"]).collect()} == {"val", *(f"train_{i}" for i in range(4))}
    s = spark.createDataFrame([(g, f"{i}") for g, n in (("x", 50), ("y", 40), ("z", 3)) for i in range(n)], "g string, i string")
    got = sample.stratified_unique(s, "g", "i", 10).collect()
    assert len({r.i for r in got}) == len(got) and [sum(r.g == g for r in got) for g in "xy"] == [10, 10]


def test_rules(spark):
    d = spark.createDataFrame([(500.0, ["C"], False), (501.0, ["C"], False), (1.0, ["C", "X"], False), (1.0, ["C"], True)], "mw double, el array<string>, frag boolean")
    r = filters.Rules({"mw": (None, 500.0)}, {"el": {"allowed": ["C", "N"], "required": []}}, ["frag"])
    assert [x.reject_reason for x in filters.apply_rules(d, r).collect()] == [None, "mw_high", "el_allowed", "has_frag"]
    with pytest.raises(ValueError, match="lower bound"):
        filters.rules_reason(filters.Rules({"mw": (2, 1)}))
    assert one(spark, filters.charged_both_ways(F.col("x")), [1, -1], "array<int>")
    bands = [("strong", None, -1.7), ("weak", -0.5, 0.0)]
    assert [one(spark, filters.band(F.col("x"), bands), v, "double") for v in (-1.7, -1.6, -0.5, 0.0, 0.1)] == [None, None, "weak", "weak", None] and one(spark, filters.band(F.col("x"), bands), -1.71, "double") == "strong"


def test_graphs(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1)], "g int, s int, d int")
    v = spark.createDataFrame([(1, i, 1.0) for i in range(4)] + [(2, 0, 1.0), (2, 1, None), (3, 0, 1.0)], "g int, v int, x double")
    assert {r.g: r.reason for r in graph.validity(v, e, ["x"]).collect()} == {1: None, 2: "bad_feature", 3: "too_few_nodes"}
    assert graph.mirrored(e).count() == 8
    left = graph.masked_subgraph(e, 0.25, 1).collect()
    assert {r.g for r in left} == {1, 2} and len(left) < 4 and (2, 0, 1) in left
    gone = graph.masked_vertices(e, 0.9, 1).groupBy("g").count().collect()
    assert [(r.g, r["count"]) for r in gone] == [(1, 2)]  # two of four stay, and graphs of two are left alone
    assert len([r for r in graph.masked_subgraph(e, 0.9, 1).collect() if r.g == 1]) >= 1
    points = spark.createDataFrame([([[1.0, 2.0, 0.0], [3.0, 6.0, 0.0]],), ([],)], "p array<array<double>>")
    assert [r.c for r in points.select(vector.centered("p").alias("c")).collect()] == [[[-1.0, -2.0, 0.0], [1.0, 2.0, 0.0]], []]


def test_cheapest_assignment(spark):
    r = random.Random(1)
    for n in range(1, 7):
        c = [[r.random() for _ in range(n)] for _ in range(n)]
        got = graph.cheapest(c)
        assert sorted(got) == list(range(n))
        assert abs(sum(c[i][j] for i, j in enumerate(got)) - min(sum(c[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n)))) < 1e-9
    d = spark.createDataFrame([("m", 0, 5, 1.0), ("m", 0, 6, 0.0), ("m", 1, 5, 0.0), ("m", 1, 6, 3.0), ("odd", 0, 5, 1.0), ("odd", 1, 5, 1.0)], "k string, a int, b int, c double")
    assert sorted((x.k, x.a, x.b) for x in graph.assigned(d, ["k"], "a", "b", "c").collect()) == [("m", 0, 6), ("m", 1, 5)]


def test_assignments_of_many_groups_at_once(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in range(60):
        n = r.choice([1, 2, 3, 4, 6])
        c = [[float(r.choice([0, 1, 2, 5, -3])) for _ in range(n)] for _ in range(n)]  # many ties
        rows += [(g, f"r{i}", j * 10, c[i][j]) for i in range(n) for j in range(n)]
        want[g] = sum(c[i][j] for i, j in enumerate(graph.cheapest(c)))
    rows += [(0, "r0", 0, 99.0), (0, "r0", 0, None), (0, None, 0, -99.0)]  # a repeated pair counts at its least cost
    rows += [(None, "x", 1, 4.0), (70, "x", 1, None), (71, "x", 1, float("nan"))]
    rows += [(72, "x", 1, 0.0), (72, "x", 2, 0.0), (72, "y", 1, 0.0), (72, "y", 3, 0.0), (73, "x", 1, 0.0), (73, "x", 2, 0.0), (73, "y", 1, 0.0)]
    r.shuffle(rows)
    pairs = spark.createDataFrame(rows, "g int, s string, t int, c double")
    got = {}
    for x in graph.assigned(pairs, ["g"], "s", "t", "c").collect():
        got.setdefault(x.g, []).append(x)
    assert got.keys() == {*want, None} and [tuple(x) for x in got[None]] == [(None, "x", 1, 4.0)]
    for g, total in want.items():
        assert len({x.s for x in got[g]}) == len({x.t for x in got[g]}) == len(got[g]) and sum(x.c for x in got[g]) == total
    # pairs that lie by their keys are not dealt again
    plan = graph.assigned(pairs.repartition(3, "g"), ["g"], "s", "t", "c")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_molecule_rules(spark):
    atom = lambda e, v=1, c=0: (e, v, c)
    ok = dict(sanitized=True, n_components=1, elements=["C", "N"], n_heavy=9, n_radicals=0, max_ring=6, weight=100.0, charges=[0], isotopes=False, atoms=[atom("C", 4), atom("N", 3)])
    cases = {
        None: {}, "null_mol": dict.fromkeys(ok), "sanitization": {"sanitized": False}, "single_component": {"n_components": 2}, "allowed_elements": {"elements": ["C", "N", "Xe"]},
        "require_any_elements": {"elements": ["C"]}, "max_heavy_atoms": {"n_heavy": 31}, "no_radicals": {"n_radicals": 1}, "max_ring_size": {"max_ring": 7}, "max_mol_weight": {"weight": None},
        "no_zwitterion": {"charges": [1, -1]}, "no_isotope": {"isotopes": True}, "heteroatom_lone_pair": {"atoms": [atom("N", 4)]},
    }
    schema = "sanitized boolean, n_components int, elements array<string>, n_heavy int, n_radicals int, max_ring int, weight double, charges array<int>, isotopes boolean, atoms array<struct<element: string, valence: int, charge: int>>"
    d = spark.createDataFrame([tuple((ok | x).values()) for x in cases.values()], schema)
    assert [r.r for r in d.select(filters.rules_reason(filters.molecule_rules()).alias("r")).collect()] == list(cases)
    nine = [r.r for r in d.select(filters.passes_nine_rules().alias("r")).collect()]
    assert nine == [k in (None, "no_isotope", "heteroatom_lone_pair") for k in cases]
    # elements that cannot hold a lone pair are not asked for one
    f = filters.molecule_rules(require_any_elements=["F"])
    assert spark.createDataFrame([tuple((ok | {"elements": ["C", "F"], "atoms": [atom("F")]}).values())], schema).select(filters.rules_reason(f).alias("r")).first().r is None
    assert d.select(filters.rules_reason(filters.molecule_rules(**{r.reason: None for r in filters.MOLECULE_RULES[1:]})).alias("r")).where("r is not null").count() == 1
    with pytest.raises(ValueError):
        filters.molecule_rules(max_size=3)


def test_strata_claim_until_they_settle(spark):
    rng = random.Random(8)
    pairs = [(f"s{min(int(rng.expovariate(0.05)), 150)}", rng.randrange(300)) for _ in range(3000)] + [(None, 1), ("s1", None)]
    d = spark.createDataFrame(pairs, "s string, x int")
    rank = {(r.s, r.x): r.u for r in d.where("s is not null and x is not null").distinct().withColumn("u", text.uniform(5, "s", "x")).collect()}
    size = {}
    for s, _ in rank:
        size[s] = size.get(s, 0) + 1
    want, taken = set(), set()
    for s in sorted(size, key=lambda s: (-size[s], s)):
        drawn = sorted((u, x) for (t, x), u in rank.items() if t == s)[:8]
        got = [x for _, x in drawn if x not in taken][:4]
        taken.update(got)
        want |= {(s, x) for x in got}
    assert {tuple(r) for r in sample.stratified_unique(d, "s", "x", 4, 5).collect()} == want
    assert sample.stratified_unique(d.limit(0), "s", "x", 4).count() == 0


def test_gaussian_fit(spark):
    rows = [("exact", x / 4, 7 * math.exp(-((x / 4 - 1) ** 2) / (2 * 0.64))) for x in range(-3, 9)]
    rows += [("noisy", x, y) for x, y in enumerate([1.0, 0.0, 4.0, 9.0, 11.0, 8.0, 5.0, 0.0, 3.0])] + [("one", 2.0, 5.0), ("none", 1.0, 0.0), ("none", 2.0, 0.0), ("exact", None, 1.0)]
    d = spark.createDataFrame([(k, float(x) if x is not None else None, y) for k, x, y in rows], "k string, center double, n double")
    got = {r.k: r for r in stats.gaussian_fit(d, ["k"]).collect()}
    assert (got["exact"].height, got["exact"]["mean"], got["exact"]["std"]) == pytest.approx((7, 1, 0.8), abs=1e-6)
    assert got["noisy"].sse < got["noisy"].sse_moments and got["one"].height is None and got["none"]["mean"] is None
    f = got["noisy"]
    sse = lambda h, m, s: sum((y - h * math.exp(-((x - m) ** 2) / (2 * s * s))) ** 2 for k, x, y in rows if k == "noisy")
    assert f.sse == pytest.approx(sse(f.height, f["mean"], f["std"]))
    assert all(sse(f.height + a, f["mean"] + b, f["std"] + c) >= f.sse for a, b, c in itertools.product((-1e-3, 0, 1e-3), repeat=3))


def test_usable_columns(spark):
    d = spark.createDataFrame([(1, 1.0, 5.0, 2.0), (2, 2.0, 5.0, 2.0), (3, float("nan"), 1.0, 2.0), (4, 3.0, None, 2.0), (5, float("inf"), 5.0, 2.0)], "i int, a double, b double, c double")
    rows, went = stats.usable(d, ["a", "b", "c"])
    assert rows.columns == ["i", "a"] and sorted(map(tuple, rows.collect())) == [(1, 1.0), (2, 2.0)]
    assert {tuple(r) for r in went.collect()} == {("rows", None, 3), ("not finite", "a", 2), ("not finite", "b", 1), ("constant", "b", 2), ("constant", "c", 2)}


@pytest.mark.parametrize("block", [1, 3, 512])
def test_contrast_loss(spark, block):
    rng = random.Random(3)
    v = lambda: [rng.gauss(0, 1) for _ in range(4)]
    rows = [(k, v(), v()) for k in "aaaaabbc"] + [("d", [float("nan")] * 4, v()), ("d", v(), v()), ("e", [float("inf"), 0.0, 0.0, 1.0], v()), ("f", None, v()), ("g", [0.0] * 4, v()), ("g", v(), v())]
    got = {r.batch: (r.n, r.loss) for r in stats.contrast_loss(spark.createDataFrame(rows, "k string, x array<double>, y array<double>"), "k", "x", "y", 0.5, block).collect()}
    for k in "abcg":
        z = [x for kk, x, _ in rows if kk == k] + [y for kk, _, y in rows if kk == k]
        cos = lambda p, q: sum(a * b for a, b in zip(p, q)) / ((math.hypot(*p) or 1) * (math.hypot(*q) or 1)) / 0.5
        n = len(z) // 2
        want = sum(math.log(sum(math.exp(cos(z[i], z[j])) for j in range(2 * n) if j != i)) - cos(z[i], z[(i + n) % (2 * n)]) for i in range(2 * n)) / (2 * n)
        assert got[k] == (n, pytest.approx(want, abs=1e-9))
    assert math.isnan(got["d"][1]) and got["e"] == (1, math.inf) and math.isnan(got["f"][1])


def test_numbered(spark):
    rows = [("a", 3), ("a", 1), ("a", None), ("b", 2), (None, 5), (None, 4), ("a", 1), ("a", 1)]
    got = order.numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    assert sorted(((r.g, r.pos, r.v, r.n) for r in got), key=str) == sorted([("a", 0, None, 5), ("a", 1, 1, 5), ("a", 2, 1, 5), ("a", 3, 1, 5), ("a", 4, 3, 5), ("b", 0, 2, 1), (None, 0, 4, 2), (None, 1, 5, 2)], key=str)
    whole = order.numbered(spark.range(500).withColumnRenamed("id", "pos").withColumn("AT", F.col("pos")).withColumn("run", F.lit(1)).repartition(7), [], ["AT"]).collect()
    assert all(r.pos == r.AT and r.n == 500 and r.run == 1 for r in whole) and len(whole) == 500
    assert order.numbered(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def test_rounding_keeps_the_sign_of_zero(spark):
    got = [one(spark, vector.signed_round("x", 6), v, "double") for v in (-1e-9, 1e-9, -0.0, 1.2345675, -1.2345675, float("nan"), None)]
    assert [str(x) for x in got] == ["-0.0", "0.0", "-0.0", "1.234568", "-1.234568", "nan", "None"]


def test_curves_are_dealt_to_tasks(spark):
    bins = spark.range(40).selectExpr("id % 8 as k", "cast(id as double) as center", "cast(1 + id % 5 as double) as n")
    fit = stats.gaussian_fit(bins, ["k"], rounds=1)
    assert fit.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

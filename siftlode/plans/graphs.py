"""Registered queries over graphs that the order lines make: rings, patterns, encoders, charges; and search in both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftlode.operators import encoder, graph, knn, matches, patterns, rings, stats
from siftlode.plans.registered import query
from siftlode.session import spread, table

#: An order as a graph: parts and suppliers, modulo 6, are its vertices, a line joins two of them.
EDGES = """
SELECT g, s, d, min(kind) AS kind FROM (
  SELECT l_orderkey AS g, least(l_partkey % 6, l_suppkey % 6) AS s, greatest(l_partkey % 6, l_suppkey % 6) AS d, 1 + l_linenumber % 2 AS kind
  FROM lineitem WHERE l_partkey % 6 <> l_suppkey % 6) GROUP BY g, s, d
"""
VERTICES = f"SELECT DISTINCT g, v, ['C', 'N', 'O'][1 + (v + g) % 3] AS label FROM (SELECT g, s AS v FROM ({EDGES}) UNION SELECT g, d FROM ({EDGES}))"


def edges(spark, sf_dir):
    a, b = F.col("l_partkey") % 6, F.col("l_suppkey") % 6
    lines = table(spark, sf_dir, "lineitem")
    d = lines.where(a != b).select(F.col("l_orderkey").alias("g"), F.least(a, b).alias("s"), F.greatest(a, b).alias("d"), (1 + F.col("l_linenumber") % 2).alias("kind"))
    # all lines of an order go to one task, so that groups and joins by graph need no further shuffle (but behind Python)
    return spread(d, lines, "g").groupBy("g", "s", "d").agg(F.min("kind").alias("kind"))


def vertices(spark, sf_dir):
    v = edges(spark, sf_dir).select("g", F.explode(F.array("s", "d")).alias("v")).distinct()
    n = (F.col("v") + F.col("g")) % 3
    return v.withColumn("label", F.when(n == 0, "C").when(n == 1, "N").otherwise("O"))


_RINGS = f"""
WITH RECURSIVE e AS MATERIALIZED ({EDGES}), b AS MATERIALIZED (SELECT g, s, d FROM e UNION ALL SELECT g, d, s FROM e),
  walk(g, s, d, v, n) AS (
    SELECT g, s, d, s, 0 FROM e
    UNION SELECT w.g, w.s, w.d, b.d, n + 1 FROM walk w JOIN b ON b.g = w.g AND b.s = w.v WHERE w.v <> w.d AND n < 5 AND NOT (w.v = w.s AND b.d = w.d)),
  ring AS (SELECT e.g, e.s, e.d, min(n) + 1 AS ring FROM e LEFT JOIN walk w ON w.g = e.g AND w.s = e.s AND w.d = e.d AND w.v = e.d GROUP BY e.g, e.s, e.d)
"""


@query("ring_of_edges", f"{_RINGS} SELECT g, s, d, ring FROM ring")
def ring_of_edges(spark, sf_dir):
    return rings.smallest_rings(edges(spark, sf_dir), 6)


@query("ring_of_vertices", f"{_RINGS} SELECT g, v, count(ring) > 0 AS in_ring, coalesce(min(ring), 0) AS min_ring FROM (SELECT g, s AS v, ring FROM ring UNION ALL SELECT g, d, ring FROM ring) GROUP BY g, v")
def ring_of_vertices(spark, sf_dir):
    return rings.vertex_rings(rings.smallest_rings(edges(spark, sf_dir), 6))


@query("ring_size_rule", f"{_RINGS} SELECT g, count(ring) AS ring_edges, coalesce(max(ring), 0) AS max_ring FROM ring GROUP BY g HAVING coalesce(max(ring), 0) <= 3")
def ring_size_rule(spark, sf_dir):
    return rings.graph_rings(rings.smallest_rings(edges(spark, sf_dir), 6)).where("max_ring <= 3")


PATTERNS = [
    patterns.Pattern("amine", ("C", "N"), ((0, 1, None),)),
    patterns.Pattern("amide", ("O", "C", "N"), ((0, 1, 2), (1, 2, None))),
    patterns.Pattern("oxime", ("O", "N", "C"), ((0, 1, 1), (1, 2, 2))),
    patterns.Pattern("ring", ("C", "N", "O"), ((0, 1, None), (1, 2, None), (0, 2, None))),
    patterns.Pattern("diamide", ("N", "C", "O", "C"), ((0, 1, None), (1, 2, None), (2, 3, None))),
    patterns.Pattern("oxygen", ("O",)),
]
_SETS = f"""
WITH v AS MATERIALIZED ({VERTICES}), e AS MATERIALIZED ({EDGES}),
  b AS MATERIALIZED (SELECT x.g, x.s, x.d, x.kind, p.label AS l, q.label AS m FROM (SELECT * FROM e UNION ALL SELECT g, d, s, kind FROM e) x
    JOIN v p ON p.g = x.g AND p.v = x.s JOIN v q ON q.g = x.g AND q.v = x.d),
  found AS (
    SELECT g, 'amine' AS pattern, 0 AS pattern_row, 2 AS size, list_sort([s, d]) AS atoms FROM b WHERE l = 'C' AND m = 'N'
    UNION SELECT x.g, 'amide', 1, 3, list_sort([x.s, x.d, y.d]) FROM b x JOIN b y ON y.g = x.g AND y.s = x.d WHERE x.l = 'O' AND x.m = 'C' AND x.kind = 2 AND y.m = 'N'
    UNION SELECT x.g, 'oxime', 2, 3, list_sort([x.s, x.d, y.d]) FROM b x JOIN b y ON y.g = x.g AND y.s = x.d WHERE x.l = 'O' AND x.m = 'N' AND x.kind = 1 AND y.m = 'C' AND y.kind = 2
    UNION SELECT x.g, 'ring', 3, 3, list_sort([x.s, x.d, y.d]) FROM b x JOIN b y ON y.g = x.g AND y.s = x.d JOIN b z ON z.g = x.g AND z.s = x.s AND z.d = y.d WHERE x.l = 'C' AND x.m = 'N' AND y.m = 'O'
    UNION SELECT x.g, 'diamide', 4, 4, list_sort([x.s, x.d, y.d, z.d]) FROM b x JOIN b y ON y.g = x.g AND y.s = x.d JOIN b z ON z.g = y.g AND z.s = y.d WHERE x.l = 'N' AND x.m = 'C' AND y.m = 'O' AND z.m = 'C' AND z.d <> x.d
    UNION SELECT g, 'oxygen', 5, 1, [v] FROM v WHERE label = 'O')
"""


@query("pattern_sets", f"{_SETS} SELECT * FROM found")
def pattern_sets(spark, sf_dir):
    return patterns.pattern_matches(vertices(spark, sf_dir), edges(spark, sf_dir), PATTERNS)


@query("pattern_groups", f"{_SETS} SELECT g, list_sort(list(DISTINCT pattern)) AS groups FROM found GROUP BY g")
def pattern_groups(spark, sf_dir):
    return patterns.groups_of(pattern_sets(spark, sf_dir))


@query("pattern_best_label", f"""{_SETS}, each AS (SELECT g AS cid, unnest(atoms) AS atom, pattern, pattern_row, size, [3, 5, 5, 6, 7, 1][pattern_row + 1] AS length FROM found)
SELECT cid, atom, arg_max(pattern, [size, length, pattern_row]) AS label FROM each GROUP BY cid, atom""")
def pattern_best_label(spark, sf_dir):
    return matches.best_label(patterns.hits(pattern_sets(spark, sf_dir), PATTERNS))


def _matrix(rows: int, cols: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A layer by a rule that SQL can state too."""
    i, j = np.arange(rows)[:, None], np.arange(cols)
    return ((i * 7 + j * 3 + seed) % 5 - 2) / 4, (j + seed) % 3 / 8


_WIDTH = 4
_ENCODER = encoder.Weights(_matrix(3, _WIDTH, 1), _matrix(1, 2, 2), [(_matrix(2, _WIDTH, s), _matrix(_WIDTH, _WIDTH, s + 1), _matrix(_WIDTH, _WIDTH, s + 2), 0.25) for s in (3, 6)], (_matrix(_WIDTH, _WIDTH, 9), _matrix(_WIDTH, _WIDTH, 10)))


def _dense(source: str, keys: str, n: int, m: int, seed: int, relu: bool = False) -> str:
    """A dense layer over a table (keys, i, x) in SQL."""
    total = f"sum(x * ((i * 7 + j * 3 + {seed}) % 5 - 2) / 4) + any_value((j + {seed}) % 3) / 8"
    return f"SELECT {keys}, j AS i, {f'greatest({total}, 0)' if relu else total} AS x FROM {source}, range({m}) t(j) GROUP BY {keys}, j"


def _round(k: int, seed: int) -> str:
    return f"""
  e{k} AS ({_dense("eb", "g, s, d", 2, _WIDTH, seed)}),
  m{k} AS (SELECT e.g, e.d AS v, e.i, sum(greatest(h.x + e.x, 0)) AS x FROM e{k} e JOIN h{k} h ON h.g = e.g AND h.v = e.s AND h.i = e.i GROUP BY e.g, e.d, e.i),
  t{k} AS (SELECT g, v, i, 1.25 * h.x + coalesce(m.x, 0) AS x FROM h{k} h LEFT JOIN m{k} m USING (g, v, i)),
  u{k} AS ({_dense(f"t{k}", "g, v", _WIDTH, _WIDTH, seed + 1, True)}),
  h{k + 1} AS MATERIALIZED ({_dense(f"u{k}", "g, v", _WIDTH, _WIDTH, seed + 2, True)}),"""


@query("encoder_embed", f"""
WITH v AS MATERIALIZED ({VERTICES}), e AS MATERIALIZED ({EDGES}),
  f AS (SELECT g, v, 0 AS i, v::DOUBLE AS x FROM v UNION ALL SELECT g, v, 1, (label = 'N')::INT FROM v UNION ALL SELECT g, v, 2, (label = 'O')::INT FROM v),
  b AS (SELECT g, s, d, 0 AS i, kind::DOUBLE AS x FROM e UNION ALL SELECT g, d, s, 0, kind FROM e),
  h0 AS MATERIALIZED ({_dense("f", "g, v", 3, _WIDTH, 1)}), eb AS MATERIALIZED ({_dense("b", "g, s, d", 1, 2, 2)}),{_round(0, 3)}{_round(1, 6)}
  p AS ({_dense("h2", "g, v", _WIDTH, _WIDTH, 9, True)}), o AS ({_dense("p", "g, v", _WIDTH, _WIDTH, 10)}),
  a AS (SELECT g, i, avg(x) AS x, count(*) AS n FROM o GROUP BY g, i)
SELECT g, any_value(n)::INT AS n, 'ok' AS status, list(round(x, 6) ORDER BY i) AS embedding FROM a GROUP BY g
""")
def encoder_embed(spark, sf_dir):
    v = vertices(spark, sf_dir).select("g", "v", F.col("v").alias("f0"), (F.col("label") == "N").cast("int").alias("f1"), (F.col("label") == "O").cast("int").alias("f2"))
    packed = encoder.nested(v, edges(spark, sf_dir), ["f0", "f1", "f2"], ["kind"])
    return encoder.embedded(packed, _ENCODER).withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 6)))


@query("knn_both_sides", """
SELECT query_id, ref_id, rank, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM (
    SELECT q.vec_id AS query_id, r.vec_id AS ref_id, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id))
WHERE rank <= 3
""")
def knn_both_sides(spark, sf_dir):
    # every vector is a query; the tiles are small enough that the queries need several
    e = table(spark, sf_dir, "embeddings")
    return knn.knn(e, e, "vec_id", "embedding", 3, exclude_self=True, tile_bytes=256 << 10).withColumn("distance", F.round("distance", 6))


#: Published parameters of electronegativity by charge, a + b q + c q^2, and its value as a positive ion.
KINDS = [("C", 7.98, 9.18, 1.88, 19.04), ("N", 11.54, 10.82, 1.36, 23.72), ("O", 14.18, 12.92, 1.39, 28.49)]


@query("equalised_charges", f"""
WITH RECURSIVE v AS MATERIALIZED ({VERTICES}), e AS MATERIALIZED ({EDGES}), b AS MATERIALIZED (SELECT g, s, d FROM e UNION ALL SELECT g, d, s FROM e),
  k(kind, a, b, c, top) AS (VALUES {", ".join(map(str, KINDS))}),
  q(n, g, v, q, a, b, c, top) AS (
    SELECT 0, g, v, CASE WHEN label = 'N' AND g % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE, k.a::DOUBLE, k.b::DOUBLE, k.c::DOUBLE, k.top::DOUBLE FROM v JOIN k ON k.kind = v.label
    UNION ALL
    SELECT n + 1, g, v, any_value(q) + sum(pow(0.5, n + 1) * (y - x) / CASE WHEN y > x THEN top ELSE other END), any_value(a), any_value(b), any_value(c), any_value(top) FROM (
      SELECT p.n, p.g, p.v, p.q, p.a, p.b, p.c, p.top, o.top AS other, p.a + p.b * p.q + p.c * p.q * p.q AS x, o.a + o.b * o.q + o.c * o.q * o.q AS y
      FROM q p JOIN b ON b.g = p.g AND b.s = p.v JOIN q o ON o.g = b.g AND o.v = b.d WHERE p.n < 6) GROUP BY n, g, v)
SELECT g, v, round(q, 6) + 0.0 AS charge FROM q WHERE n = 6
""")
def equalised_charges(spark, sf_dir):
    v = vertices(spark, sf_dir).select("g", "v", F.col("label").alias("kind"), F.when((F.col("label") == "N") & (F.col("g") % 5 == 0), 1).alias("charge"))
    kinds = spark.createDataFrame(KINDS, "kind string, a double, b double, c double, top double")
    return graph.equalised(v, edges(spark, sf_dir), kinds).withColumn("charge", F.round("charge", 6) + 0.0)


def _bonds(spark, sf_dir):
    k = (F.col("g") + F.col("s") + F.col("d")) % 4
    return edges(spark, sf_dir).withColumn("order", F.when(k == 0, 2.0).when(k == 1, 1.5).otherwise(1.0))


_BONDS = f"""{_RINGS}, o AS (SELECT g, s, d, ring, [2.0, 1.5, 1.0, 1.0][1 + (g + s + d) % 4]::DOUBLE AS "order" FROM ring),
  h AS (SELECT g, s AS v, "order" AS x FROM o UNION ALL SELECT g, d, "order" FROM o), a AS (SELECT g, v, count(*) AS deg, count(*) FILTER (x > 1) AS mult FROM h GROUP BY g, v),
  f AS (SELECT o.*, p.deg AS ds, q.deg AS dd, "order" = 1 AND p.mult > 0 AND q.mult > 0 AS bridge FROM o JOIN a p ON p.g = o.g AND p.v = o.s JOIN a q ON q.g = o.g AND q.v = o.d),
  c AS (SELECT g, s, d, "order", ring IS NOT NULL AS in_ring, [ds, dd] AS degrees, bridge OR "order" = 1.5 OR ("order" > 1 AND EXISTS (
    SELECT 1 FROM f y WHERE y.g = f.g AND y.bridge AND (y.s IN (f.s, f.d) OR y.d IN (f.s, f.d)))) AS conjugated FROM f)"""


@query("edge_features", f'{_BONDS} SELECT g, s, d, "order", in_ring, conjugated, degrees FROM c')
def edge_features(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.edge_features(_bonds(spark, sf_dir), rings.smallest_rings(e, 6))


@query("edge_arrays", f"""{_BONDS}, t AS (SELECT g, s, d, ["order", in_ring::INT, conjugated::INT]::DOUBLE[] AS x FROM c UNION ALL SELECT g, d, s, ["order", in_ring::INT, conjugated::INT]::DOUBLE[] FROM c)
SELECT g, list({{'s': s, 'd': d, 'x': x}} ORDER BY s, d) AS edges FROM t GROUP BY g""")
def edge_arrays(spark, sf_dir):
    return graph.edge_index(edge_features(spark, sf_dir), ["order", "in_ring", "conjugated"])


_USUAL = {"C": 4, "N": 3, "O": 2}


@query("node_catalog", f"""
{_BONDS}, v AS (SELECT g, v, label, (label = 'N' AND g % 5 = 0)::INT AS charge FROM ({VERTICES})),
  w AS (SELECT g, v, count(*) AS deg, ceil(sum(x))::INT AS ev, max(x = 1.5)::INT AS ar FROM h GROUP BY g, v),
  r AS (SELECT g, v, (count(ring) > 0)::INT AS inr, coalesce(min(ring), 0) AS mr FROM (SELECT g, s AS v, ring FROM ring UNION ALL SELECT g, d, ring FROM ring) GROUP BY g, v),
  i AS (SELECT *, greatest(CASE label WHEN 'C' THEN 4 WHEN 'N' THEN 3 ELSE 2 END + charge - ev, 0) AS iv FROM v JOIN w USING (g, v) JOIN r USING (g, v))
SELECT g, list(v ORDER BY v) AS ids, list([(label = 'C')::INT, (label = 'N')::INT, (label = 'O')::INT, 0, charge, deg, deg + iv, ev, iv, ev + iv, iv, ar, inr, mr, CASE label WHEN 'C' THEN 4 WHEN 'N' THEN 5 ELSE 6 END,
  CASE label WHEN 'C' THEN 2.55 WHEN 'N' THEN 3.04 ELSE 3.44 END]::DOUBLE[] ORDER BY v) AS x FROM i GROUP BY g
""")
def node_catalog(spark, sf_dir):
    # every feature that follows from elements, charges and bonds, nested by graph
    v = vertices(spark, sf_dir).withColumn("charge", ((F.col("label") == "N") & (F.col("g") % 5 == 0)).cast("int"))
    full = graph.vertex_features(v, _bonds(spark, sf_dir), rings.smallest_rings(edges(spark, sf_dir), 6), _USUAL)
    names = ["degree", "total_degree", "explicit_valence", "implicit_valence", "total_valence", "total_num_hs"]
    c = matches.Features().one_hot("element", ["C", "N", "O"], "label").number("formal_charge", "charge").flag("is_aromatic").flag("is_in_ring").number("min_ring_size")
    for n in names:
        c.number(n)
    c.of_table("valence_electrons", "label", {"C": 4.0, "N": 5.0, "O": 6.0}, 4.0).of_table("electronegativity", "label", {"C": 2.55, "N": 3.04, "O": 3.44}, 2.0)
    x = c.vector(["element", "formal_charge", *names, "is_aromatic", "is_in_ring", "min_ring_size", "valence_electrons", "electronegativity"])
    rows = full.select("g", F.struct("v", x.alias("x")).alias("r")).groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return rows.select("g", F.transform("r", lambda a: a["v"]).alias("ids"), F.transform("r", lambda a: a["x"]).alias("x"))


@query("contrast_loss", """
WITH p AS (SELECT vec_id // 16 AS batch, vec_id % 16 AS i, embedding::DOUBLE[] AS a, CASE WHEN vec_id <> 37 THEN list_reverse(embedding::DOUBLE[]) END AS b FROM embeddings),
  z AS (SELECT batch, i, 0 AS side, a AS v FROM p UNION ALL SELECT batch, i, 1, b FROM p),
  s AS (SELECT x.batch, x.i, x.side, sum(exp(list_cosine_similarity(x.v, y.v) / 0.5)) AS total, any_value(list_cosine_similarity(x.v, y.v) / 0.5) FILTER (x.i = y.i) AS own
    FROM z x JOIN z y ON y.batch = x.batch AND (y.i <> x.i OR y.side <> x.side) GROUP BY x.batch, x.i, x.side)
SELECT batch, count(*) // 2 AS n, CASE WHEN batch = 2 THEN 'nan'::DOUBLE ELSE round(avg(ln(total) - own), 6) END AS loss FROM s GROUP BY batch
""")
def contrast_loss(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch"), F.col("embedding").alias("a"), F.when(F.col("vec_id") != 37, F.reverse("embedding")).alias("b"))
    return stats.contrast_loss(e, "batch", "a", "b", 0.5, 7).withColumn("loss", F.round("loss", 6))


@query("gaussian_recovered", """
SELECT s_suppkey, 10.0 + s_nationkey AS height, s_suppkey % 7 - 3 + s_nationkey / 10 AS mean, 0.5 + s_suppkey % 5 * 0.3 AS std, true AS better FROM supplier
""")
def gaussian_recovered(spark, sf_dir):
    # each supplier's curve, cut off at both sides so that its moments are not its parameters
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    d = table(spark, sf_dir, "supplier").select("s_suppkey", (10.0 + n).alias("h"), (k % 7 - 3 + n / 10).alias("m"), (0.5 + k % 5 * 0.3).alias("s"), F.explode(F.sequence(F.lit(-16), F.lit(20))).alias("i"))
    x = F.col("m") + F.col("s") * F.col("i") / 10
    bins = d.select("s_suppkey", x.alias("center"), (F.col("h") * F.exp(-((x - F.col("m")) ** 2) / (2 * F.col("s") * F.col("s")))).alias("n"))
    fit = stats.gaussian_fit(bins, ["s_suppkey"])
    return fit.select("s_suppkey", *(F.round(c, 4).alias(c) for c in ("height", "mean", "std")), ((F.col("sse") < 1e-6) & (F.col("sse_moments") > 1)).alias("better"))


@query("gaussian_by_group", """
WITH b AS (SELECT l_returnflag, l_linestatus, floor(l_extendedprice / 5000) * 5000 + 2500 AS x, count(*) AS y FROM lineitem GROUP BY ALL),
  m AS (SELECT l_returnflag, l_linestatus, sum(x * y) / sum(y) AS mean, sqrt(sum(y * x * x) / sum(y) - (sum(x * y) / sum(y)) ** 2) AS std FROM b GROUP BY ALL),
  e AS (SELECT l_returnflag, l_linestatus, y, exp(-((x - mean) ** 2) / (2 * std * std)) AS e FROM b JOIN m USING (l_returnflag, l_linestatus)),
  h AS (SELECT l_returnflag, l_linestatus, sum(y * e) / sum(e * e) AS height FROM e GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(sqrt(sum((y - height * e) ** 2) / sum(y * y)), 6) AS error_of_moments, true AS never_worse FROM e JOIN h USING (l_returnflag, l_linestatus) GROUP BY ALL
""")
def gaussian_by_group(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", (F.floor(F.col("l_extendedprice") / 5000) * 5000 + 2500).alias("center")).agg(F.count("*").alias("n"))
    keys = ["l_returnflag", "l_linestatus"]
    total = d.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("y2"))
    fit = stats.gaussian_fit(d, keys).join(total, keys)
    return fit.select(*keys, F.round(F.sqrt(F.col("sse_moments") / F.col("y2")), 6).alias("error_of_moments"), (F.col("sse") <= F.col("sse_moments")).alias("never_worse"))


_CLEAN = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN 'nan'::DOUBLE WHEN l_orderkey % 89 = 0 THEN 'inf'::DOUBLE ELSE l_quantity::DOUBLE END AS a, CASE WHEN l_partkey % 83 <> 0 THEN l_tax END AS b, 4.0::DOUBLE AS c FROM lineitem"""


def _dirty(spark, sf_dir):
    k = F.col("l_orderkey")
    a = F.when(k % 97 == 0, float("nan")).when(k % 89 == 0, float("inf")).otherwise(F.col("l_quantity").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), F.when(F.col("l_partkey") % 83 != 0, F.col("l_tax")).alias("b"), F.lit(4.0).alias("c"))


@query("usable_rows", f"SELECT l_orderkey, l_linenumber, a, b FROM ({_CLEAN}) WHERE isfinite(a) AND b IS NOT NULL")
def usable_rows(spark, sf_dir):
    return stats.usable(_dirty(spark, sf_dir), ["a", "b", "c"])[0]


@query("unusable_report", f"""
SELECT 'rows' AS what, NULL AS name, count(*) FILTER (NOT isfinite(a) OR b IS NULL) AS n FROM ({_CLEAN}) UNION ALL SELECT 'not finite', 'a', count(*) FILTER (NOT isfinite(a)) FROM ({_CLEAN})
UNION ALL SELECT 'not finite', 'b', count(*) FILTER (b IS NULL) FROM ({_CLEAN}) UNION ALL SELECT 'constant', 'c', count(*) FILTER (isfinite(a) AND b IS NOT NULL) FROM ({_CLEAN})
""")
def unusable_report(spark, sf_dir):
    return stats.usable(_dirty(spark, sf_dir), ["a", "b", "c"])[1]

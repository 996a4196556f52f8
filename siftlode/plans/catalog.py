"""Registered queries over the star-schema and vector tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.functions import text, vector
from siftlode.operators import clean, filters, graph, sample, stats
from siftlode.operators import knn as nn
from siftlode.plans.registered import query
from siftlode.session import spread, table

#: Distances are rounded in the output only; ranks come from the full doubles.
_KNN_SQL = """
WITH p AS (
  SELECT q.vec_id AS query_id, r.vec_id AS ref_id, q.label AS qlabel,
         list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS d
  FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, ref_id, rank, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM p)
WHERE rank <= {k}
"""


@query("knn_topk", _KNN_SQL.format(k=10))
def knn_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return nn.knn(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10, exclude_self=True).withColumn("distance", F.round("distance", 6))


# ---- cleaning ----

_LINE = ["l_orderkey", "l_linenumber"]


@query("argmin_per_key", """
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def argmin_per_key(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_partkey", *_LINE, "l_extendedprice")
    return clean.argmin_per_key(d, ["l_partkey"], "l_extendedprice", _LINE)


@query("argmin_per_key_and_scope", """
SELECT l_partkey, l_returnflag, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL
""")
def argmin_scope(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", *_LINE, "l_extendedprice")
    return clean.argmin_per_key(d, ["l_partkey"], "l_extendedprice", _LINE, ["l_returnflag"]).select("l_partkey", "l_returnflag", "l_extendedprice")


@query("first_per_key", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_per_key(spark, sf_dir):
    return clean.first_per_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("lookup_left_join", """
SELECT o_orderkey, o_custkey, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey
""")
def lookup_left_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_custkey").alias("n"))
    return clean.lookup_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey", "c_name", "n")


@query("fallback_key_join", """
SELECT p_partkey, p_brand, coalesce((SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE s_suppkey = p_partkey),
  (SELECT min_by(s_name, s_suppkey) FROM supplier WHERE 'Brand#' || (s_nationkey % 60) = p_brand)) AS s_name FROM part
""")
def fallback_key_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("s_nationkey") % 60).alias("p_brand"), "s_name", F.col("s_suppkey").alias("n"))
    return clean.fallback_join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), s, "p_partkey", "p_brand", "s_name", "n")


@query("dictionary_join", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END AS weight FROM orders
""")
def dictionary_join(spark, sf_dir):
    # names come as 'Rank AND 1-URGENT', 'rank & 2-high' or with doubled blanks; the dictionary has one form of each
    t = spark.createDataFrame([(" rank & 1-urgent ", 1), ("RANK AND 2-HIGH", 2)], "name string, weight int")
    mark = F.element_at(F.array(F.lit(" AND "), F.lit(" & "), F.lit("  and ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Rank"), mark, F.lower("o_orderpriority")).alias("name"))
    return clean.variant_join(o, t, "name", "weight").select("o_orderkey", "weight")


@query("anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join(spark, sf_dir):
    return clean.exclude(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, sf_dir):
    return clean.only(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 1"), ["doc_id"])


@query("repeated_keys", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return clean.repeated_keys(table(spark, sf_dir, "documents"), ["text"])


@query("distinct_names", "SELECT DISTINCT trim(event_type) AS event_type FROM events WHERE trim(event_type) <> ''")
def distinct_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select(text.non_blank("event_type").alias("event_type")).where("event_type is not null").distinct()


@query("union_series", """
SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS price FROM orders UNION ALL SELECT 'line', l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity > 45
""")
def union_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    n = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("price"))
    return o.unionByName(n, allowMissingColumns=True)


@query("difference_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def difference_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return clean.exclude(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"]).distinct()


# ---- filters ----


@query("band_case", """
SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'strong' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'weak' END AS band FROM customer WHERE c_acctbal < -500 OR c_acctbal BETWEEN 0 AND 1000
""")
def band_case(spark, sf_dir):
    v = F.col("c_acctbal")
    b = filters.band(v, [("strong", None, -500.0), ("weak", 0.0, 1000.0)])
    return table(spark, sf_dir, "customer").select("c_custkey", b.alias("band")).where("band is not null")


@query("window_filter", "SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 3.0 ELSE 1.0 END AS weight FROM customer WHERE c_acctbal < -500 OR c_acctbal BETWEEN -100 AND 0")
def window_filter(spark, sf_dir):
    v = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").where((v < -500) | v.between(-100, 0)).select("c_custkey", F.when(v < -500, 3.0).otherwise(1.0).cast("double").alias("weight"))


_REASON = "CASE WHEN event_type IN ('error', 'logout') THEN 'type' WHEN value < 5 THEN 'value_low' WHEN value > 90 THEN 'value_high' END"


def _events_with_reason(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", "value", F.col("event_type").isin("error", "logout").alias("flag"))
    return d.withColumn("reason", clean.reject_reason([("type", F.col("flag")), ("value_low", F.col("value") < 5), ("value_high", F.col("value") > 90)]))


@query("reject_reasons", f"SELECT event_id, {_REASON} AS reason FROM events")
def reject_reasons(spark, sf_dir):
    return _events_with_reason(spark, sf_dir).select("event_id", "reason")


@query("reject_reason_counts", f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM events GROUP BY 1")
def reject_reason_counts(spark, sf_dir):
    return clean.reason_counts(_events_with_reason(spark, sf_dir), F.col("reason"))


@query("config_rules", """
SELECT p_partkey, CASE WHEN 'STEEL' = any(string_split(p_type, ' ')) THEN 'words_forbidden' WHEN p_size < 5 THEN 'p_size_low' WHEN p_size > 40 THEN 'p_size_high'
  WHEN p_retailprice > 1500 THEN 'p_retailprice_high' END AS reject_reason FROM part
""")
def config_rules(spark, sf_dir):
    rules = filters.Rules(bounds={"p_size": (5, 40), "p_retailprice": (None, 1500.0)}, sets={"words": {"forbidden": ["STEEL"], "required": []}})
    d = table(spark, sf_dir, "part").withColumn("words", F.split("p_type", " "))
    return filters.apply_rules(d, rules).select("p_partkey", "reject_reason")


@query("regex_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
def regex_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike("^(red|blue) .*t$")).select("p_partkey", "p_name")


# ---- text ----


@query("slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug("url").alias("slug"))


@query("trim_all_and_ellipsis", """
SELECT doc_id, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END AS label FROM (SELECT doc_id, regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') AS t FROM documents)
""")
def trim_ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ellipsis(text.trim_all("text"), 40).alias("label"))


@query("parse_finite", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def parse_finite(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.parse_finite(F.get_json_object("props", "$.k")).alias("k"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("explode_outer_rows", """
SELECT conv_id, turn, unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS sentence FROM (
  SELECT conv_id, turn, list_filter(string_split(text, '. '), lambda x: length(x) > 60) AS l FROM conversations)
""")
def explode_outer_rows(spark, sf_dir):
    parts = F.filter(F.split("text", r"\. "), lambda x: F.length(x) > 60)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode_outer(parts).alias("sentence"))


# ---- statistics ----

_STATS = "count(*) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_pop({v}), 6) AS std, min({v}) AS min, max({v}) AS max"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("group_stats_having", f"SELECT l_suppkey, {_STATS.format(v='l_extendedprice')} FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def group_stats_having(spark, sf_dir):
    return _rounded(stats.group_stats(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 30), "mean", "median", "std")


@query("group_stats_two_levels", f"SELECT o_orderstatus, o_orderpriority, {_STATS.format(v='o_totalprice')} FROM orders GROUP BY 1, 2")
def group_stats_two_levels(spark, sf_dir):
    return _rounded(stats.group_stats(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), "mean", "median", "std")


@query("share_with_total", """
SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1
UNION ALL SELECT 'TOTAL', count(*), 100.0 FROM events
""")
def share_with_total(spark, sf_dir):
    return _rounded(stats.share_with_total(table(spark, sf_dir, "events"), "event_type"), "share")


@query("set_label_group", """
SELECT concat_ws('+', CASE WHEN l_quantity > 25 THEN 'Q' END, CASE WHEN l_discount > 0.05 THEN 'D' END, CASE WHEN l_tax > 0.04 THEN 'T' END) AS label, count(*) AS n FROM lineitem GROUP BY 1
""")
def set_label_group(spark, sf_dir):
    flags = {"Q": F.col("l_quantity") > 25, "D": F.col("l_discount") > 0.05, "T": F.col("l_tax") > 0.04}
    return table(spark, sf_dir, "lineitem").groupBy(stats.set_label(flags, ["Q", "D", "T"]).alias("label")).agg(F.count("*").alias("n"))


_EDGES = [round(i * 0.01, 2) for i in range(11)]


@query("hist_fixed", f"""
WITH e AS (SELECT unnest({_EDGES[:-1]}::DOUBLE[]) AS low, unnest({_EDGES[1:]}::DOUBLE[]) AS high, unnest(range(10))::INT AS bin)
SELECT bin, low, high, count(l_discount) AS n, count(*) FILTER (WHERE l_tax > 0.04) AS taxed
FROM e LEFT JOIN lineitem ON l_discount >= low AND (l_discount < high OR (bin = 9 AND l_discount = high)) GROUP BY ALL
""")
def hist_fixed(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem").select("l_discount", "l_tax"), "l_discount", _EDGES, {"n": F.lit(True), "taxed": F.col("l_tax") > 0.04})


@query("gaussian_moments", """
SELECT sum(n) AS total, round(sum(n * c) / sum(n), 6) AS mean, round(sqrt(sum(n * c * c) / sum(n) - (sum(n * c) / sum(n)) ** 2), 6) AS std
FROM (SELECT p_size + 0.5 AS c, count(*) AS n FROM part GROUP BY 1)
""")
def gaussian_moments(spark, sf_dir):
    h = table(spark, sf_dir, "part").groupBy((F.col("p_size") + 0.5).cast("double").alias("center")).agg(F.count("*").alias("n"))
    return _rounded(stats.gaussian_moments(h), "mean", "std")


@query("bin_last_closed", "SELECT least(floor((l_quantity - 1) / 5.0), 9)::INT AS bin, count(*) AS n, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY 1")
def bin_last_closed(spark, sf_dir):
    b = stats.floor_bin(F.col("l_quantity"), 1.0, 5.0, 10)
    return _rounded(table(spark, sf_dir, "lineitem").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean")), "mean")


@query("size_bins", "SELECT least(p_size // 5, 5)::INT AS bin, count(*) AS n FROM part GROUP BY 1")
def size_bins(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.least(F.expr("p_size div 5"), F.lit(5)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("pearson_matrix", "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount"]) for b in ["l_quantity", "l_extendedprice", "l_discount"][i:]))
def pearson_matrix(spark, sf_dir):
    return _rounded(stats.pearson(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), "r")


@query("regression_metrics", """
SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(l_extendedprice) * count(*)), 6) AS r2
FROM (SELECT *, l_quantity * 1000 - l_extendedprice AS e FROM lineitem) GROUP BY 1
""")
def regression_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    m = stats.regression_metrics(d, "l_extendedprice", "p", ["l_returnflag"])
    return m.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6)})


@query("count_distinct_max", "SELECT source, max(n_chars) AS longest, count(DISTINCT lang) AS langs, min(doc_id) AS first FROM documents GROUP BY source")
def count_distinct_max(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first"))


@query("composite_top", """
SELECT s_suppkey, n, rank FROM (SELECT l_suppkey AS s_suppkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1) WHERE rank <= 20
""")
def composite_top(spark, sf_dir):
    top = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s_suppkey").limit(20)
    return clean.ranked(top, [], [F.desc("n"), "s_suppkey"])


@query("domain_order", """
SELECT o_orderkey, rank FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders)
""")
def domain_order(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("d", text.lookup("o_orderstatus", {"F": 0, "O": 1}, 2))
    return clean.ranked(d, ["o_custkey"], ["d", F.desc_nulls_last("o_totalprice"), "o_orderkey"]).select("o_orderkey", "rank")


# ---- nearest neighbours ----


@query("knn_per_query_k", f"""
{_KNN_SQL.split("SELECT query_id")[0]}
SELECT query_id, ref_id, rank, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM p) WHERE rank <= CASE WHEN qlabel % 2 = 0 THEN 15 ELSE 5 END
""")
def knn_per_query_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = nn.knn(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", F.when(F.col("label") % 2 == 0, 15).otherwise(5), exclude_self=True)
    return _rounded(found, "distance")


@query("knn_neighbor_dedup", f"""
WITH f AS ({_KNN_SQL.format(k=10)})
SELECT ref_id, list(query_id ORDER BY rank, query_id) AS queries, count(DISTINCT query_id) AS n_queries, min(rank) AS best_rank, min(distance) AS best_distance FROM f GROUP BY ref_id
""")
def knn_neighbor_dedup(spark, sf_dir):
    return nn.distinct_neighbors(knn_topk(spark, sf_dir))


@query("knn_nested", f"""
WITH f AS ({_KNN_SQL.format(k=10)}) SELECT query_id, list({{'rank': rank, 'ref_id': ref_id, 'distance': distance}} ORDER BY rank) AS neighbors FROM f GROUP BY query_id
""")
def knn_nested(spark, sf_dir):
    return nn.nested(knn_topk(spark, sf_dir))


# ---- vectors ----


@query("l2_normalize", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))), 6)) AS v FROM embeddings")
def l2_normalize(spark, sf_dir):
    v = vector.l2_normalize(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(v, lambda x: vector.signed_round(x, 6)).alias("v"))


@query("vector_pooling", """
SELECT label, i::INT AS i, round(avg(x), 6) AS mean, round(sum(x), 4) AS total
FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL
""")
def vector_pooling(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings")
    n = 64
    d = d.select(F.col("label").alias("g"), *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(n)))
    cols = [f"x{i}" for i in range(n)]
    m, t = (graph.pooled(d, cols, how).select(F.col("g").alias("label"), F.posexplode(F.array(*cols)).alias("i", name)) for how, name in (("mean", "mean"), ("sum", "total")))
    return m.join(t, ["label", "i"]).select("label", "i", F.round("mean", 6).alias("mean"), F.round("total", 4).alias("total"))


# ---- graphs: an order is a graph, its lines' parts and suppliers are vertices ----


def _order_graph(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    d = lines.select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("s"), (F.col("l_suppkey") + 1_000_000).alias("d"))
    return spread(d, lines, "g").dropDuplicates()


@query("graph_degree", """
WITH e AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS s, l_suppkey + 1000000 AS d FROM lineitem), m AS (SELECT g, s, d FROM e UNION SELECT g, d, s FROM e)
SELECT g, s AS v, count(*) AS degree FROM m GROUP BY ALL
""")
def graph_degree(spark, sf_dir):
    return graph.degree(graph.mirrored(_order_graph(spark, sf_dir)))


@query("graph_validity", """
WITH e AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS s, l_suppkey + 1000000 AS d FROM lineitem
    UNION SELECT DISTINCT l_orderkey, l_partkey, 9000000 FROM lineitem WHERE l_orderkey % 50 = 0),
  v AS (SELECT g, s AS v FROM e UNION SELECT g, d FROM e WHERE d < 9000000 UNION SELECT -o_orderkey, unnest([1, 2, 3, 4]) FROM orders WHERE o_orderkey % 100 = 0),
  n AS (SELECT g, count(*) AS n_nodes, bool_or(v % 97 = 0) AS bad, max(v) AS most FROM v GROUP BY g),
  m AS (SELECT g, count(*) AS n_edges, max(greatest(s, d)) AS top FROM e GROUP BY g)
SELECT g, n_nodes, coalesce(n_edges, 0) AS n_edges, CASE WHEN n_nodes < 4 THEN 'too_few_nodes' WHEN n_edges IS NULL THEN 'no_edges'
  WHEN bad THEN 'bad_feature' WHEN top > most THEN 'dangling_edge' END AS reason FROM n LEFT JOIN m USING (g)
""")
def graph_validity(spark, sf_dir):
    e = _order_graph(spark, sf_dir)
    loose = e.where("g % 50 = 0").select("g", "s", F.lit(9_000_000).cast("long").alias("d")).distinct()
    v = e.select("g", F.col("s").alias("v")).union(e.select("g", "d"))
    alone = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select((-F.col("o_orderkey")).alias("g"), F.explode(F.expr("array(1L, 2L, 3L, 4L)")).alias("v"))
    v = v.union(alone).distinct().withColumn("x", F.when(F.col("v") % 97 != 0, 1.0))
    return graph.validity(v, e.union(loose), ["x"], 4)


@query("graph_masked_subgraph", """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS s, l_suppkey + 1000000 AS d FROM lineitem),
  m AS (SELECT g, s AS a, d AS b FROM e UNION SELECT g, d, s FROM e),
  near AS (SELECT g, a, list(b ORDER BY b) AS bs FROM m GROUP BY g, a),
  n AS (SELECT g, list(a ORDER BY a) AS vs, ('0x' || substr(md5('0|' || g), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM near GROUP BY g),
  t AS (SELECT g, least(greatest(1, floor(len(vs) * 0.25)::BIGINT), len(vs) - 2) AS want, vs[floor(u * len(vs))::BIGINT + 1] AS v FROM n),
  q AS (SELECT g, want, [v] AS q, 1::BIGINT AS i FROM t WHERE want > 0
    UNION ALL SELECT q.g, want, list_concat(q.q, list_filter(bs, lambda x: NOT list_contains(q.q, x))[1:want - len(q.q)]), i + 1
    FROM q JOIN near ON near.g = q.g AND near.a = q.q[i] WHERE len(q.q) < want AND i <= len(q.q)),
  gone AS (SELECT g, unnest(arg_max(q, i)) AS v FROM q GROUP BY g),
  f AS (SELECT e.g, s, d, EXISTS (SELECT 1 FROM gone WHERE gone.g = e.g AND (gone.v = e.s OR gone.v = e.d)) AS cut FROM e),
  c AS (SELECT g, bool_and(cut) AS none, min({'s': s, 'd': d}) AS first FROM f GROUP BY g)
SELECT f.g, f.s, f.d FROM f JOIN c USING (g) WHERE NOT cut OR (none AND first = {'s': f.s, 'd': f.d})
""")
def graph_masked(spark, sf_dir):
    return graph.masked_subgraph(_order_graph(spark, sf_dir))


@query("min_cost_assignment", """
WITH q AS (SELECT l_orderkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r FROM lineitem),
  d AS (SELECT l_orderkey AS k, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate::DATE DESC) AS r FROM lineitem)
SELECT k, count(*) AS n, count(*) AS n_a, count(*) AS n_b, sum(q * day) AS cost FROM q JOIN d USING (k, r) GROUP BY k
""")
def min_cost_assignment(spark, sf_dir):
    """The cheapest totals by order: with such costs the least quantity takes the last day (rearrangement)."""
    got = graph.assigned(_waiting(spark, sf_dir), ["k"], "a", "b", "cost")
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  (an order's lines; two count_distinct treble the rows)
    return got.groupBy("k").agg(F.count("*").alias("n"), distinct("a").alias("n_a"), distinct("b").alias("n_b"), F.sum("cost").alias("cost"))


def _waiting(spark, sf_dir):
    # an order's lines (a) take the ship dates of its lines (b); each day of waiting costs a line's quantity
    # line numbers repeat within an order, so lines are numbered anew
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity", "l_shipdate")
    d = clean.ranked(d, ["k"], ["l_linenumber", "l_shipdate", "l_quantity"])
    line = F.struct("rank", "l_quantity", F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).alias("day"))
    d = d.where(F.col("k").isNotNull()).groupBy("k").agg(F.collect_list(line).alias("lines"))
    d = d.select("k", "lines", F.explode("lines").alias("x")).select("k", "x", F.explode("lines").alias("y"))
    cost = (F.col("x.l_quantity") * F.col("y.day")).cast("double")
    return d.select("k", F.col("x.rank").alias("a"), F.col("y.rank").alias("b"), cost.alias("cost"))


@query("model_scoring", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x, i: x * i)), 4) AS score FROM embeddings")
def model_scoring(spark, sf_dir):
    return graph.scored(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _linear_model, "vec_id long, score double")


def _linear_model():
    import numpy as np
    import pandas as pd

    def apply(pdf):
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        return pd.DataFrame({"vec_id": pdf["vec_id"], "score": np.round(x @ np.arange(1.0, x.shape[1] + 1), 4)})

    return apply


# ---- samples and splits: MD5 is the same in both engines ----

_U = "(('0x' || substr(md5('7|' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0)"


@query("bernoulli_sample", f"SELECT * FROM customer WHERE {_U} < 0.1")
def bernoulli_sample(spark, sf_dir):
    return sample.bernoulli(table(spark, sf_dir, "customer"), ["c_custkey"], 0.1, 7)


@query("bernoulli_per_source", """
SELECT doc_id, source FROM documents WHERE (('0x' || substr(md5('7|' || source || '|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0) < 0.3
""")
def bernoulli_per_source(spark, sf_dir):
    # each source (a file, say) draws by its own hashes
    return sample.bernoulli(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 0.3, 7)


@query("exact_sample", f"SELECT * FROM customer ORDER BY {_U}, c_custkey LIMIT 100")
def exact_sample(spark, sf_dir):
    return sample.exact(table(spark, sf_dir, "customer"), ["c_custkey"], 100, 7)


@query("fraction_sample", f"""
SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY {_U}, c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r <= floor(n * 0.15)
""")
def fraction_sample(spark, sf_dir):
    return sample.exact_fraction(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 0.15, 7)


@query("ratio_split", f"""
SELECT c_custkey, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split
FROM (SELECT c_custkey, row_number() OVER (ORDER BY {_U}, c_custkey) - 1 AS r, count(*) OVER ()::DOUBLE AS n FROM customer)
""")
def ratio_split(spark, sf_dir):
    return sample.exact_split(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], {"train": 0.7, "val": 0.2, "test": 0.1}, 7)


@query("hash_split", f"""
SELECT c_custkey, CASE WHEN u < 0.2 THEN 'val' ELSE 'train_' || least(floor((u - 0.2) / (1 - 0.2::DOUBLE) * 4)::INT, 3) END AS split
FROM (SELECT c_custkey, {_U} AS u FROM customer)
""")
def hash_split(spark, sf_dir):
    return sample.hash_split(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], seed=7)


_STRATA = """
WITH RECURSIVE p AS (SELECT DISTINCT l_returnflag AS s, l_partkey AS x FROM lineitem),
  o AS (SELECT s, row_number() OVER (ORDER BY count(*) DESC, s) AS k FROM p GROUP BY s),
  d AS (SELECT s, x, row_number() OVER (PARTITION BY s ORDER BY ('0x' || substr(md5('7|' || s || '|' || x), 1, 13))::BIGINT, x) AS r FROM p),
  l AS (SELECT k, s, list(x ORDER BY r) AS xs FROM d JOIN o USING (s) WHERE r <= 40 GROUP BY k, s),
  t AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS s, []::BIGINT[] AS got, []::BIGINT[] AS taken
    UNION ALL SELECT l.k, l.s, list_filter(l.xs, lambda x: NOT list_contains(t.taken, x))[1:20],
      list_concat(t.taken, list_filter(l.xs, lambda x: NOT list_contains(t.taken, x))[1:20]) FROM t JOIN l ON l.k = t.k + 1)
SELECT s AS l_returnflag, unnest(got) AS l_partkey FROM t WHERE k > 0
"""


#: As many strata as a table of rules never has.
_MANY = _STRATA.replace("DISTINCT l_returnflag AS s", "DISTINCT l_orderkey % 500 AS s").replace("''::VARCHAR AS s", "0::BIGINT AS s").replace("r <= 40", "r <= 6").replace("[1:20]", "[1:3]").replace("AS l_returnflag", "AS stratum")


@query("stratified_many", _MANY)
def stratified_many(spark, sf_dir):
    return sample.stratified_unique(table(spark, sf_dir, "lineitem").withColumn("stratum", F.col("l_orderkey") % 500), "stratum", "l_partkey", 3, 7)


@query("stratified_unique", _STRATA)
def stratified_unique(spark, sf_dir):
    return sample.stratified_unique(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey", 20, 7)


from siftlode.plans import features, files, graphs  # noqa: E402, F401  (they register their queries)
from siftlode.plans.registered import ORACLE, QUERIES  # noqa: E402


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE

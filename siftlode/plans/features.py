"""Registered queries over feature tables: filter presets, labels, matches, orders, made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.functions import text
from siftlode.operators import clean, filters, stats
from siftlode.operators import matches as m
from siftlode.operators.order import numbered
from siftlode.plans.registered import query
from siftlode.session import table

#: A part as a molecule: numbers made from its key and size. Every 23rd was never parsed, every 29th lacks its weight, and
#: the atoms that decide on a lone pair are in the elements.
_PART = """
SELECT p_partkey AS cid, p_size % 11 <> 0 AS sanitized, 1 + (p_size % 13 = 0)::INT AS n_components,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CASE p_partkey % 5 WHEN 0 THEN ['C', 'N'] WHEN 1 THEN ['C', 'H'] WHEN 2 THEN ['C', 'O', 'Xe'] WHEN 3 THEN ['C', 'S', 'Br'] ELSE ['C', 'F', 'Cl'] END END AS elements,
  p_size AS n_heavy, (p_partkey % 17 = 0)::INT AS n_radicals, 3 + p_partkey % 5 AS max_ring, CASE WHEN p_partkey % 29 <> 0 THEN p_retailprice / 2.5 END AS weight,
  CASE WHEN p_partkey % 7 = 0 THEN [1, -1] ELSE [0, 1] END AS charges, p_partkey % 19 = 0 AS isotopes, 2 + p_partkey % 3 AS valence, p_size % 2 AS charge FROM part
"""


def _molecules(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    sets = [F.array(*map(F.lit, x)) for x in (["C", "N"], ["C", "H"], ["C", "O", "Xe"], ["C", "S", "Br"], ["C", "F", "Cl"])]
    elements = F.when(k % 23 != 0, F.element_at(F.array(*sets), (k % 5 + 1).cast("int")))
    atoms = F.transform(elements, lambda e: F.struct(e.alias("element"), (2 + k % 3).alias("valence"), (n % 2).alias("charge")))
    return table(spark, sf_dir, "part").select(
        k.alias("cid"), (n % 11 != 0).alias("sanitized"), (1 + (n % 13 == 0).cast("int")).alias("n_components"), elements.alias("elements"),
        n.alias("n_heavy"), (k % 17 == 0).cast("int").alias("n_radicals"), (3 + k % 5).alias("max_ring"), F.when(k % 29 != 0, F.col("p_retailprice") / 2.5).alias("weight"),
        F.when(k % 7 == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1))).alias("charges"), (k % 19 == 0).alias("isotopes"), atoms.alias("atoms"),
    )


_NINE = """elements IS NOT NULL AND sanitized AND n_components = 1 AND NOT list_contains(elements, 'Xe') AND list_has_any(elements, ['O', 'N', 'S', 'P']) AND n_heavy <= 30
  AND n_radicals = 0 AND max_ring <= 6 AND weight <= 500 AND NOT list_has_any(charges, [-1])"""


@query("nine_rules", f"SELECT cid FROM ({_PART}) WHERE {_NINE}")
def nine_rules(spark, sf_dir):
    return _molecules(spark, sf_dir).where(filters.passes_nine_rules()).select("cid")


_SWITCHED = """
SELECT cid, CASE WHEN elements IS NULL THEN 'null_mol' WHEN NOT sanitized THEN 'sanitization' WHEN n_components <> 1 THEN 'single_component' WHEN list_contains(elements, 'Xe') THEN 'allowed_elements'
  WHEN NOT list_has_any(elements, {any}) THEN 'require_any_elements' WHEN NOT list_contains(elements, 'C') THEN 'require_all_elements'
  WHEN list_contains(elements, 'Br') THEN 'forbidden_elements' WHEN n_heavy > 40 THEN 'max_heavy_atoms' WHEN n_radicals <> 0 THEN 'no_radicals' WHEN weight IS NULL OR weight > 500 THEN 'max_mol_weight'
  WHEN list_has_any(charges, [-1]) THEN 'no_zwitterion' WHEN isotopes THEN 'no_isotope' WHEN {lone} THEN 'heteroatom_lone_pair' END AS reason FROM ({part})
"""


@query("thirteen_switches", _SWITCHED.format(any="['O', 'N', 'S', 'P']", part=_PART, lone="CASE WHEN list_contains(elements, 'N') THEN 5 ELSE 6 END - valence - charge < 2"))
def thirteen_switches(spark, sf_dir):
    rules = filters.molecule_rules(require_all_elements=["C"], forbidden_elements=["Br"], max_heavy_atoms=40, max_ring_size=None)
    return _molecules(spark, sf_dir).select("cid", filters.rules_reason(rules).alias("reason"))


@query("lone_pair_elements", _SWITCHED.format(any="['F', 'N']", part=_PART, lone="list_contains(elements, 'N') AND 5 - valence - charge < 2"))
def lone_pair_elements(spark, sf_dir):
    # of the elements asked for only N can hold a lone pair; molecules with F alone have none to miss
    rules = filters.molecule_rules(require_any_elements=["F", "N"], require_all_elements=["C"], forbidden_elements=["Br"], max_heavy_atoms=40, max_ring_size=None)
    return _molecules(spark, sf_dir).select("cid", filters.rules_reason(rules).alias("reason"))


@query("lone_pair_rule", """
SELECT p_partkey AS cid, coalesce(CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 6 WHEN 2 THEN 6 END - p_size % 5 - (p_partkey % 3 - 1) >= 2, false) AS lone FROM part
""")
def lone_pair_rule(spark, sf_dir):
    k = F.col("p_partkey")
    el = F.element_at(F.array(F.lit("N"), F.lit("O"), F.lit("S"), F.lit("C")), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("cid"), filters.lone_pair(el, F.col("p_size") % 5, k % 3 - 1).alias("lone"))


#: A line as a hit of a pattern on an atom: pattern, its length and row, the atoms it covers.
def _hits(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select(
        F.col("l_orderkey").alias("cid"), (F.col("l_partkey") % 3).cast("int").alias("atom"), F.concat(F.lit("fg"), F.col("l_suppkey") % 4).alias("label"),
        F.col("l_quantity").cast("int").alias("match_size"), (F.col("l_partkey") % 10).cast("int").alias("pattern_length"), F.col("l_suppkey").alias("pattern_row"),
    )


_HITS = """SELECT l_orderkey AS cid, (l_partkey % 3)::INT AS atom, 'fg' || l_suppkey % 4 AS label, l_quantity::INT AS match_size, (l_partkey % 10)::INT AS pattern_length, l_suppkey AS pattern_row FROM lineitem"""
_BEST = f"""SELECT cid, atom, label FROM (SELECT *, row_number() OVER (PARTITION BY cid, atom ORDER BY match_size DESC, pattern_length DESC, pattern_row DESC, label DESC) AS r FROM ({_HITS})) WHERE r = 1"""


@query("best_anchor_group", _BEST)
def best_anchor_group(spark, sf_dir):
    return m.best_label(_hits(spark, sf_dir))


@query("anchor_status", f"""
WITH best AS ({_BEST}),
  a AS (SELECT o_orderkey AS cid, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS found, unnest(CASE o_custkey % 5 WHEN 0 THEN []::INT[] WHEN 1 THEN [2] ELSE [0, 1] END) AS atom FROM orders),
  n AS (SELECT o_orderkey AS cid, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS found FROM orders),
  l AS (SELECT a.cid, a.atom, coalesce(label, 'other') AS label FROM a LEFT JOIN best USING (cid, atom)),
  g AS (SELECT cid, count(*) AS k, any_value(label) AS one, count(DISTINCT label) AS kinds, count(DISTINCT label) FILTER (label <> 'other') AS known, max(label) FILTER (label <> 'other') AS name FROM l GROUP BY cid),
  p AS (SELECT l.cid, l.label FROM l JOIN n ON n.cid = l.cid AND n.found = l.atom)
SELECT n.cid, CASE WHEN k IS NULL THEN 'missing' WHEN k = 1 THEN one WHEN p.label IS NOT NULL THEN p.label WHEN known = 1 THEN name WHEN known = 0 THEN 'other' ELSE 'ambiguous_N' END AS label,
  CASE WHEN k IS NULL THEN 'missing' WHEN k = 1 THEN 'trivial' WHEN p.label IS NOT NULL THEN 'geom' WHEN known <= 1 THEN 'consensus' ELSE 'ambig' END AS status
FROM n LEFT JOIN g USING (cid) LEFT JOIN p USING (cid)
""")
def anchor_status(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), F.col("o_custkey")
    anchors = o.select(F.col("o_orderkey").alias("cid"), F.lit("N").alias("element"), F.when(c % 4 == 0, 0).when(c % 4 == 1, 1).alias("mapped_atom"))
    atoms = F.when(c % 5 == 0, F.expr("cast(array() as array<int>)")).when(c % 5 == 1, F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))
    candidates = o.select(F.col("o_orderkey").alias("cid"), F.explode(atoms).alias("atom"))
    return m.anchor_status(anchors, candidates, m.best_label(_hits(spark, sf_dir))).select("cid", "label", "status")


@query("status_counts", "SELECT o_orderstatus AS element, o_orderpriority AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("element"), F.col("o_orderpriority").alias("status"))
    return m.status_counts(d, ["element", "status"])


@query("labels_without_catch_all", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('', 'error') AND NOT starts_with(event_type, 'log')")
def labels_without_catch_all(spark, sf_dir):
    return table(spark, sf_dir, "events").where(m.resolved("event_type", ("error",), "log")).select("event_id", "event_type")


@query("single_anchor", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(*) = 1")
def single_anchor(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return d.where(m.exactly("flags", ["A", "R"], 1)).select("l_orderkey", F.lit(1).cast("long").alias("n"))


@query("anchors_per_molecule", "SELECT n, count(*) AS molecules FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n")
def anchors_per_molecule(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return m.distribution(n, "n", "molecules")


@query("batch_mean_error", """
SELECT round(avg(e), 4) AS batch_mae FROM (SELECT avg(abs(l_extendedprice - l_quantity * 1000)) AS e FROM (
  SELECT l_extendedprice, l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity) - 1 AS r FROM lineitem) GROUP BY r // 128)
""")
def batch_mean_error(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    d = numbered(d, [], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"]).withColumn("p", F.col("l_quantity") * 1000)
    return stats.batch_mean_error(d, "l_extendedprice", "p", "pos", 128).select(F.round("batch_mae", 4).alias("batch_mae"))


@query("journal_lists", """
WITH j AS (SELECT upper(trim(c_mktsegment)) AS journal, c_custkey // 3 AS cid, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS name, 0 AS o, -c_custkey AS row_no FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT 'BUILDING', -1, 'Extra One', 1, 0 UNION ALL SELECT 'BUILDING', -2, 'Extra Two', 1, 1 UNION ALL SELECT 'BUILDING', min(c_custkey // 3), 'again', 1, 2 FROM customer WHERE c_mktsegment = 'BUILDING'),
  f AS (SELECT journal, cid, CASE WHEN trim(name) = '' THEN 'CID' || cid ELSE name END AS name, row_number() OVER (PARTITION BY journal, cid ORDER BY o, row_no) AS r FROM j)
SELECT journal, cid, name FROM f WHERE r = 1 AND NOT (journal = 'MACHINERY' AND lower(name) IN ('customer#000000001', 'cid2')) AND NOT (journal = 'BUILDING' AND lower(name) = 'extra two')
""")
def journal_lists(spark, sf_dir):
    # three customers share a cid, later ones stand first, and some have no name
    k = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("journal"), F.floor(k / 3).alias("cid"), F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("name"), (-k).alias("row_no"))
    least = d.where("trim(journal) = 'building'").agg(F.min("cid")).scalar()
    extra = spark.createDataFrame([("BUILDING", -1, "Extra One", 0), ("BUILDING", -2, "Extra Two", 1)], "journal string, cid long, name string, row_no long")
    again = spark.range(1).select(F.lit("BUILDING").alias("journal"), least.alias("cid"), F.lit("again").alias("name"), F.lit(2).cast("long").alias("row_no"))
    exclude = spark.createDataFrame([("MACHINERY", " Customer#000000001"), ("machinery", "CID2"), ("BUILDING", "EXTRA TWO")], "journal string, name string")
    return m.by_lists(d, ["Building ", "machinery"], extra.union(again), exclude, "row_no")


@query("epoch_order", "SELECT epoch, path FROM (SELECT (c_custkey % 50)::INT AS epoch, 'run' || c_nationkey || '/model_epoch_' || c_custkey % 50 || '.pt' AS path FROM customer) ORDER BY epoch, path LIMIT 40")
def epoch_order(spark, sf_dir):
    c = F.col("c_custkey")
    d = table(spark, sf_dir, "customer").select(F.concat(F.lit("run"), F.col("c_nationkey"), F.lit("/model_epoch_"), c % 50, F.lit(".pt")).alias("path"))
    return d.select(text.number_in_name("path").alias("epoch"), "path").orderBy("epoch", "path").limit(40)


@query("nulls_last_order", "SELECT c_custkey, energy, row_number() OVER (ORDER BY energy ASC NULLS LAST, c_custkey) - 1 AS pos FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS energy FROM customer)")
def nulls_last_order(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("energy")).withColumn("failed", F.col("energy").isNull())
    return numbered(d, [], ["failed", "energy", "c_custkey"]).select("c_custkey", "energy", "pos")


@query("row_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def row_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.lit("customer").alias("name"), F.count("*").alias("n")).union(table(spark, sf_dir, "part").agg(F.lit("part"), F.count("*")))


@query("post_threshold", "SELECT c_custkey, c_acctbal <= 250.5 AS strong FROM customer WHERE c_acctbal IS NOT NULL")
def post_threshold(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal is not null").select("c_custkey", (F.col("c_acctbal") <= 250.5).alias("strong"))


@query("name_functions", r"""
WITH d AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (' || p_brand || ')' WHEN 1 THEN '(2,6-PDA)' WHEN 2 THEN ' (PDA)' ELSE ' 2,6-PDA' END AS name, p_partkey % 4 AS q, p_name, p_brand FROM part)
SELECT k, CASE q WHEN 0 THEN p_brand WHEN 2 THEN 'PDA' ELSE name END AS label, CASE WHEN q IN (0, 2) THEN p_name ELSE name END AS lookup,
  CASE q WHEN 0 THEN p_brand WHEN 1 THEN '2,6-PDA' WHEN 2 THEN 'PDA' ELSE '' END AS short, q = 2 AS mentions_pda, CASE q WHEN 0 THEN p_brand WHEN 1 THEN name WHEN 2 THEN 'PDA' ELSE name END AS display FROM d
""")
def name_functions(spark, sf_dir):
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, F.concat(F.lit(" ("), F.col("p_brand"), F.lit(")"))).when(k % 4 == 1, "(2,6-PDA)").when(k % 4 == 2, " (PDA)").otherwise(" 2,6-PDA")
    d = table(spark, sf_dir, "part").select(k.alias("k"), F.concat("p_name", end).alias("name"))
    return d.select(
        "k", text.trailing_label("name").alias("label"), text.lookup_name("name").alias("lookup"), text.last_parenthesis("name").alias("short"),
        text.mentions("name", "PDA").alias("mentions_pda"), text.display_name("name", F.col("k") % 4 == 1).alias("display"),
    )


@query("isotopes_and_digits", r"SELECT c_custkey, c_custkey % 2 = 0 AS isotope, c_custkey % 3 = 0 AS digits FROM customer")
def isotopes_and_digits(spark, sf_dir):
    c = F.col("c_custkey")
    s = F.when(c % 2 == 0, F.concat(F.lit("C["), c, F.lit("C]"))).otherwise(F.concat(F.lit("[C"), c, F.lit("]")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.has_isotope(s).alias("isotope"), text.is_digits(F.when(c % 3 == 0, c.cast("string")).otherwise(s)).alias("digits"))


@query("array_functions", """
SELECT l_orderkey, l_linenumber, [(l_linenumber % 2)::INT, (l_linenumber % 3 = 0)::INT, 1] AS flags, list_filter([0, 1, 2], lambda i: [l_linenumber % 2, (l_linenumber % 3 = 0)::INT, 1][i + 1] = 1)::INT[] AS at,
  [[l_quantity, l_tax, 1.0]::DOUBLE[], [l_discount, 2.0, 3.0]::DOUBLE[]] AS points, CASE l_returnflag WHEN 'A' THEN [1, 0, 0] WHEN 'R' THEN [0, 1, 0] ELSE [0, 0, 1] END AS hot, CASE l_returnflag WHEN 'A' THEN 3.04 ELSE 2.0 END::DOUBLE AS electronegativity
FROM lineitem
""")
def array_functions(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    raw = F.format_string("[%d, %d, 1]", (F.col("l_linenumber") % 2).cast("int"), (F.col("l_linenumber") % 3 == 0).cast("int"))
    flat = F.array("l_quantity", "l_tax", F.lit(1.0), "l_discount", F.lit(2.0), F.lit(3.0))
    flags = text.flags_array(raw)
    return d.select(
        "l_orderkey", "l_linenumber", flags.alias("flags"), text.set_positions(flags).alias("at"), text.triples(flat).alias("points"),
        text.one_hot("l_returnflag", ["A", "R"]).alias("hot"), text.lookup("l_returnflag", {"A": 3.04}, 2.0).alias("electronegativity"),
    )


@query("node_features", """
SELECT l_orderkey AS g, l_linenumber AS v, list_concat(CASE l_returnflag WHEN 'A' THEN [1.0, 0.0, 0.0] WHEN 'N' THEN [0.0, 1.0, 0.0] ELSE [0.0, 0.0, 1.0] END, [l_quantity, CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END, CASE l_returnflag WHEN 'A' THEN 5.0 ELSE 4.0 END])::DOUBLE[] AS x FROM lineitem
""")
def node_features(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("v"), F.col("l_returnflag").alias("element"), F.col("l_quantity").alias("mass"), (F.col("l_tax") > 0.04).alias("is_aromatic")
    )
    catalog = m.Features().one_hot("element", ["A", "N"]).number("mass").flag("is_aromatic").of_table("valence_electrons", "element", {"A": 5.0}, 4.0)
    return d.select("g", "v", catalog.vector(["element", "mass", "is_aromatic", "valence_electrons"]).alias("x"))


@query("centered_points", """
SELECT l_orderkey AS g, list_transform(p, lambda a: [round(a[1] - mx, 6) + 0.0, round(a[2] - my, 6) + 0.0]) AS points FROM (
  SELECT l_orderkey, list([l_quantity, l_tax] ORDER BY l_quantity, l_tax) AS p, avg(l_quantity) AS mx, avg(l_tax) AS my FROM lineitem GROUP BY l_orderkey)
""")
def centered_points(spark, sf_dir):
    from siftlode.functions.vector import centered

    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.sort_array(F.collect_list(F.array("l_quantity", "l_tax"))).alias("p"))
    return d.select("g", F.transform(centered("p"), lambda a: F.transform(a, lambda x: F.round(x, 6) + 0.0)).alias("points"))

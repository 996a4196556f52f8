"""Registered queries over sources and sinks: a table goes to the shared folder in some format and is read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftlode.functions import text
from siftlode.operators import clean
from siftlode.plans.registered import query
from siftlode.session import scratch, table
from siftlode.sources import readers, writers
from siftlode.streaming.incremental import run_new_files


def _text(df, path: str, sep: str = "\n") -> str:
    """The only column of df as text records."""
    df.write.option("lineSep", sep).text(path)
    return path


@query("csv_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_name AS name, c_mktsegment || ', \"x\"' AS segment FROM customer")
def csv_scan(spark, sf_dir):
    p = scratch(spark, "csv")
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" C_CustKey "), F.col("c_name").alias("﻿Name"), F.concat("c_mktsegment", F.lit(', "x"')).alias("Segment"))
    d.write.option("header", True).option("escape", '"').csv(p)
    return readers.table(spark, p)


@query("csv_line_ends_in_cells", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority || chr(10) || o_orderstatus AS note FROM orders")
def csv_line_ends_in_cells(spark, sf_dir):
    p = scratch(spark, "csv")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", "o_orderpriority", "o_orderstatus").alias("note"))
    writers.quoted_csv(d, p)
    return readers.table(spark, p, line_ends_in_cells=True)


@query("tsv_positional", "SELECT p_partkey::VARCHAR AS cid, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name || '\t' || p_brand END AS smiles FROM part WHERE p_size > 10")
def tsv_positional(spark, sf_dir):
    p = scratch(spark, "tsv")
    d = table(spark, sf_dir, "part")
    # small parts come as rows of one cell, which are left out; others end in a blank cell, have more cells than the header, or a separator in quotes
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit('"'), F.col("p_name"), F.lit("\t"), F.col("p_brand"), F.lit('"')))
    more = F.when(F.col("p_size") % 2 == 0, F.lit("\tz\tmore")).otherwise(F.lit(""))
    cells = F.when(F.col("p_size") > 10, F.concat(F.col("p_partkey"), F.lit("\t"), name, more)).otherwise(F.col("p_partkey").cast("string"))
    # a header in each file
    d.select(cells.alias("x\ty\tz")).repartition(4, "p_partkey").write.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p)
    return readers.positional(spark, p, ["cid", "smiles"], "\t")


@query("shard_scan", "SELECT shard, source_file, count(*) AS n, min(k) AS least FROM (SELECT c_nationkey::BIGINT AS shard, c_nationkey || '_part.csv' AS source_file, c_custkey AS k FROM customer) GROUP BY ALL")
def shard_scan(spark, sf_dir):
    p = scratch(spark, "shards")
    d = table(spark, sf_dir, "customer")
    d.select("c_custkey", "c_nationkey").repartition("c_nationkey").write.partitionBy("c_nationkey").option("header", True).csv(f"{p}/raw")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(p).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm(f"{p}/in"))
    for st in fs.globStatus(jvm(f"{p}/raw/c_nationkey=*/part-*.csv")):  # a file for each of the nations
        fs.rename(st.getPath(), jvm(f"{p}/in/{st.getPath().getParent().getName().split('=')[1]}_part.csv"))
    got = readers.shards(spark, f"{p}/in", ",")
    return got.groupBy("shard", "source_file").agg(F.count("*").alias("n"), F.min(F.col("c_custkey").cast("long")).alias("least"))


@query("line_numbers", "SELECT row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS line_no, c_custkey FROM customer")
def line_numbers(spark, sf_dir):
    # the header is line 1, so rows count from 2
    p = scratch(spark, "lines")
    d = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    d.write.partitionBy("c_nationkey").option("header", True).csv(p)
    got = readers.lines(spark, p).where("line_no > 1")
    return got.select("line_no", F.col("value").cast("long").alias("c_custkey"))


@query("head_rows", "SELECT c_custkey, line_no FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS line_no FROM customer) WHERE line_no <= 25")
def head_rows(spark, sf_dir):
    # the first rows in the order of files and lines; the files hold ranges of the keys
    p = _text(table(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").select(F.col("c_custkey").cast("string")), scratch(spark, "head"))
    first = readers.lines(spark, p).orderBy("source_file", "line_no").limit(25)
    return first.select(F.col("value").cast("long").alias("c_custkey"), F.row_number().over(Window.orderBy("source_file", "line_no")).alias("line_no"))


@query("ragged_scan", """
SELECT p_name || CASE p_size % 3 WHEN 0 THEN ', ' || p_brand WHEN 1 THEN ', "' || p_brand || '", x' ELSE '' END AS name, p_partkey::VARCHAR AS cid, p_type AS smiles, p_size || CASE WHEN p_size % 2 = 0 THEN ', J' ELSE '' END AS journal FROM part
""")
def ragged_scan(spark, sf_dir):
    # names with bare separators, in quotes with quotes inside, and plain; journals with a separator in quotes
    d, size = table(spark, sf_dir, "part"), F.col("p_size")
    quoted = F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"", x"'))
    name = F.when(size % 3 == 0, F.concat_ws(", ", "p_name", "p_brand")).when(size % 3 == 1, quoted).otherwise(F.col("p_name"))
    journal = F.when(size % 2 == 0, F.concat(F.lit('"'), size, F.lit(', J"'))).otherwise(size.cast("string"))
    p = _text(d.select(F.concat_ws(",", name, "p_partkey", "p_type", journal)), scratch(spark, "ragged"))
    return readers.repaired(spark, p, ["name", "cid", "smiles", "journal"])


@query("tagged_scan", """
SELECT p_name || ' ' || p_brand AS title, p_type AS journal, 'About ' || p_partkey || CASE WHEN p_size % 3 = 0 THEN ' ERp57 is a protein ER' || p_size ELSE '' END AS abstract FROM part WHERE p_size % 5 <> 0
""")
def tagged_scan(spark, sf_dir):
    # lines that only begin with ER end nothing
    d = table(spark, sf_dir, "part")
    end = F.when(F.col("p_size") % 2 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))  # both kinds of line ends
    er = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("ERp57 is a protein"), end, F.lit("ER"), F.col("p_size"), end)).otherwise(F.lit(""))
    abstract = F.when(F.col("p_size") % 5 != 0, F.concat(F.lit("AB About"), end, F.lit("   "), F.col("p_partkey"), end, er)).otherwise(F.lit(""))
    rec = F.concat(F.lit("PT J"), end, F.lit("TI "), F.col("p_name"), end, F.lit("   "), F.col("p_brand"), end, F.lit("SO "), F.col("p_type"), end, abstract, F.lit("ER "), end)
    p = _text(d.select(rec), scratch(spark, "tagged"))
    return readers.tagged(spark, p, {"TI": "title", "SO": "journal", "AB": "abstract"}, "abstract")


@query("json_block_scan", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size % 7 <> 0")
def json_block_scan(spark, sf_dir):
    # files of either kind of line ends side by side
    d, p = table(spark, sf_dir, "part"), scratch(spark, "blocks")
    for i, end in enumerate(("\r\n", "\n")):
        good = F.regexp_replace(F.to_json(F.struct("p_partkey", "p_name", "p_size")), ',"p_size"', f',{end} "p_size"')
        _text(d.where(F.col("p_partkey") % 2 == i).select(F.when(F.col("p_size") % 7 == 0, F.lit("{not json")).otherwise(good)), f"{p}/{i} kind", end * 2)
    return readers.json_blocks(spark, f"{p}/*", "p_partkey long, p_name string, p_size int")


@query("json_fallback", """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 3 THEN c_name END AS name, CASE WHEN c_custkey % 4 <> 3 THEN [[c_nationkey, 0.5, -1.0], [2.0, 3.0, c_custkey]]::DOUBLE[][] END AS points FROM customer
""")
def json_fallback(spark, sf_dir):
    # a nested object as JSON, in a code fence behind prose, as a literal with single quotes, or broken; coordinates flat
    body = F.format_string('{"name": "%s", "coords": {"3d": [%d, 0.5, -1.0, 2.0, 3.0, %d]}}', "c_name", "c_nationkey", "c_custkey")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("The answer:\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 2, F.regexp_replace(body, '"', "'")).otherwise(F.lit("{name: none"))
    o = table(spark, sf_dir, "customer").select("c_custkey", text.lenient_json(raw, "name string, coords struct<`3d`: array<double>>").alias("o"))
    return o.select("c_custkey", F.col("o.name").alias("name"), text.triples(F.col("o.coords.3d")).alias("points"))


@query("json_line_scan", "SELECT count(*) AS n, sum(p_size)::BIGINT AS size FROM part WHERE p_size % 7 <> 0")
def json_line_scan(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    p = _text(d.select(F.when(F.col("p_size") % 7 == 0, F.lit('{"p_size": 1')).otherwise(F.to_json(F.struct("p_partkey", "p_size")))), scratch(spark, "lines"))
    return readers.json_lines(spark, p, "p_partkey long, p_size int").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


@query("structure_scan", "SELECT p_partkey::VARCHAR AS cid, CASE WHEN p_size % 3 = 2 THEN NULL ELSE p_name END AS smiles FROM part")
def structure_scan(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    # the name is under the first candidate, under a property that holds the word, or blank
    name = F.element_at(F.array(F.lit("SMI"), F.lit("canonical_smiles_2"), F.lit("SMI")), (F.col("p_size") % 3 + 1).cast("int"))
    value = F.when(F.col("p_size") % 3 == 2, " ").otherwise(F.col("p_name"))
    rec = F.concat(F.lit("mol\n> <CID>\n"), F.col("p_partkey"), F.lit("\n\n> <"), name, F.lit(">\n"), value, F.lit("\n\n$$$$"))
    p = scratch(spark, "sdf")
    d.select(rec).write.option("compression", "gzip").text(p)
    return readers.structure_blocks(spark, p, {"cid": ["CID"], "smiles": ["SMILES", "SMI"]}, {"smiles": "smiles"}).select("cid", "smiles")


@query("first_valid_structures", "SELECT count(*) AS n, count(DISTINCT cid) AS ids, bool_and(p_size % 3 <> 2) AS valid FROM (SELECT p_partkey AS cid, p_size FROM part WHERE p_size % 3 <> 2 ORDER BY p_partkey LIMIT 50)")
def first_valid_structures(spark, sf_dir):
    # 50 records that are valid: blank ones do not count towards the limit
    got = structure_scan(spark, sf_dir).where("smiles is not null").limit(50)
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("cid"), "p_size")
    return got.join(d, "cid").agg(F.count("*").alias("n"), F.count_distinct("cid").alias("ids"), F.bool_and(F.col("p_size") % 3 != 2).alias("valid"))


@query("query_rows_with_fallbacks", "SELECT p_partkey::VARCHAR AS cid, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS smiles, NULL::VARCHAR AS note FROM part")
def query_rows_with_fallbacks(spark, sf_dir):
    d = table(spark, sf_dir, "part")
    d = d.select(F.col("p_partkey").cast("string").alias("Ref_CID"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ").alias("SMILES"), F.col("p_type").alias("canonical"))
    return readers.with_fallbacks(d, {"cid": ["cid", "ref_cid"], "smiles": ["smiles", "canonical"], "note": ["comment"]})


@query("inline_query_rows", "SELECT c_custkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS cid FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inline_query_rows(spark, sf_dir):
    # the rows given inline are those of the smallest table, every other one without a cid; they are joined like any table
    given = [{"nation": r.n_nationkey, "name": r.n_name} | ({"cid": r.n_regionkey} if r.n_nationkey % 2 == 0 else {}) for r in table(spark, sf_dir, "nation").collect()]
    rows = readers.query_rows(spark, given, "nation long, name string, cid long")
    return table(spark, sf_dir, "customer").join(rows, F.col("c_nationkey") == F.col("nation")).select("c_custkey", "name", "cid")


@query("partitioned_write", "SELECT lower(c_mktsegment) AS group_slug, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1")
def partitioned_write(spark, sf_dir):
    p = scratch(spark, "groups")
    writers.by_group(table(spark, sf_dir, "customer"), p, "c_mktsegment")
    return spark.read.option("header", True).csv(p).groupBy("group_slug").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey").cast("long")).alias("keys"))


@query("append_resume", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM customer")
def append_resume(spark, sf_dir):
    # the first run broke off after a third of the keys; the second is given all
    p = scratch(spark, "append")
    d = table(spark, sf_dir, "customer").select("c_custkey")
    writers.append_new(d.where("c_custkey % 3 = 0").withColumn("run", F.lit("first")), p, ["c_custkey"])
    writers.append_new(d.withColumn("run", F.lit("second")), p, ["c_custkey"])
    return spark.read.parquet(p)


@query("replace_in_place", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def replace_in_place(spark, sf_dir):
    p = scratch(spark, "replace")
    table(spark, sf_dir, "customer").select("c_custkey").write.parquet(p)
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    writers.replace(clean.exclude(spark.read.parquet(p), o, ["c_custkey"]), p)
    return spark.read.parquet(p)


@query("pending_files", "SELECT c_nationkey || '.csv' AS source_file, count(*) AS n FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1")
def pending_files(spark, sf_dir):
    # outputs: whole for every third file, one row short for the next, none for the last third
    d = table(spark, sf_dir, "customer").select(F.concat("c_nationkey", F.lit(".csv")).alias("source_file"), "c_custkey", "c_nationkey")
    some = clean.ranked(d, ["c_nationkey"], ["c_custkey"])
    done = some.where("c_nationkey % 3 = 0 or (c_nationkey % 3 = 1 and rank > 1)")
    return readers.pending_files(d, done)


@query("union_of_files", "SELECT c_custkey::VARCHAR AS cid, c_name AS name FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name FROM supplier")
def union_of_files(spark, sf_dir):
    # two sets of record files are written as one
    p = scratch(spark, "union")
    for t, k in (("customer", "c"), ("supplier", "s")):
        d = table(spark, sf_dir, t)
        d.select(F.concat(F.lit("m\n> <CID>\n"), F.col(d.columns[0]), F.lit("\n\n> <NAME>\n"), F.col(f"{k}_name"), F.lit("\n\n$$$$"))).write.option("compression", "gzip" if k == "c" else "none").text(f"{p}/{t}")
    writers.concatenated(spark, [f"{p}/customer", f"{p}/supplier"], f"{p}/all", "$$$$\n")
    return readers.structure_blocks(spark, f"{p}/all", {"cid": ["CID"], "name": ["NAME"]}).select("cid", "name")


_CELLS = ", ".join(f"CASE WHEN vec_id % 9 <> 0 THEN printf('%.6f', embedding[{i + 1}]::DOUBLE) END AS emb_{i}" for i in range(64))


@query("extended_rows", f"SELECT vec_id::VARCHAR AS vec_id, label::VARCHAR AS label, CASE WHEN vec_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, {_CELLS} FROM embeddings")
def extended_rows(spark, sf_dir):
    # the columns of the input, a status and every cell of the vector as text with six decimals; blank cells where there is none
    p = scratch(spark, "extended")
    d = table(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 != 0, F.col("embedding")))
    writers.with_cells(d, "embedding", 64).write.option("header", True).csv(p)
    return readers.table(spark, p, ",")


@query("index_and_manifest", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN value < 5 THEN 'low' WHEN value > 90 THEN 'high' ELSE 'ok' END AS reason FROM events) GROUP BY 1
UNION ALL SELECT 'index', count(*) FROM events WHERE value BETWEEN 5 AND 90 UNION ALL SELECT 'failures', count(*) FROM events WHERE value < 5 OR value > 90
""")
def index_and_manifest(spark, sf_dir):
    out = scratch(spark, "indexed")
    reason = F.when(F.col("value") < 5, "low").when(F.col("value") > 90, "high")
    writers.indexed(table(spark, sf_dir, "events").select("event_id", "value", reason.alias("reason")), "reason", out, ["event_id"])
    counts = spark.read.schema("reason string, n long").json(f"{out}/manifest")
    for name in ("index", "failures"):
        counts = counts.union(spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("reason"), F.count("*").alias("n")))
    return counts


@query("index_lineage", """
WITH f AS (SELECT c_custkey, c_name, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line_no FROM customer)
SELECT c_custkey, line_no, CASE WHEN c_acctbal >= 0 THEN c_name END AS name, CASE WHEN c_acctbal < 0 THEN 'negative' END AS reason FROM f
""")
def index_lineage(spark, sf_dir):
    # rows of text files, a file a nation; the index leads from a written row to its line, and from its place to the row
    src, out = scratch(spark, "lines"), scratch(spark, "indexed")
    d = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("value")).repartition("c_nationkey")
    d.sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(src)
    got = readers.lines(spark, src).select("source_file", "line_no", F.from_json("value", "c_custkey long, c_name string, c_acctbal double").alias("o")).select("source_file", "line_no", "o.*")
    got = got.withColumn("reason", F.when(F.col("c_acctbal") < 0, "negative"))
    writers.indexed(got, "reason", out, ["c_custkey"], ["source_file", "line_no"])
    index, failures = spark.read.parquet(f"{out}/index"), spark.read.parquet(f"{out}/failures")
    found = writers.at_places(spark, f"{out}/rows", index).select(F.col("c_custkey"), "line_no", F.col("row.c_name").alias("name"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(failures.select("c_custkey", "line_no", F.lit(None).cast("string").alias("name"), "reason"))


@query("log_rebuild", """
SELECT c_custkey AS cid, CASE c_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END AS chloride_found, CASE c_nationkey % 3 WHEN 0 THEN c_name ELSE '' END AS chloride_vendor, c_mktsegment || '; x' AS notes
FROM customer
""")
def log_rebuild(spark, sf_dir):
    # results are appended as JSON lines; the table is made anew from the log, nested cells flattened
    p = scratch(spark, "log")
    d = table(spark, sf_dir, "customer")
    found = F.when(F.col("c_nationkey") % 3 != 2, F.col("c_nationkey") % 3 == 0)
    salt = F.struct(found.alias("found"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_name")).alias("vendor"))
    rows = d.select(F.col("c_custkey").alias("cid"), salt.alias("chloride"), F.array("c_mktsegment", F.lit(" "), F.lit("x")).alias("notes"))
    writers.append_json(rows.where("cid % 2 = 0"), p)
    writers.append_json(rows.where("cid % 2 = 1"), p)
    got = readers.json_lines(spark, p, "cid long, chloride struct<found: boolean, vendor: string>, notes array<string>")
    return got.select("cid", text.yes_no("chloride.found").alias("chloride_found"), F.coalesce("chloride.vendor", F.lit("")).alias("chloride_vendor"), text.list_cell("notes").alias("notes"))


@query("incremental_batches", "SELECT o_orderkey, o_totalprice * 2 AS price FROM orders")
def incremental_batches(spark, sf_dir):
    # files come in three lots; a run after each takes what is new
    src, out, chk = (scratch(spark, x) for x in ("in", "out", "chk"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    for k in range(3):
        d.where(F.col("o_orderkey") % 3 == k).write.mode("append").parquet(src)
        run_new_files(spark, src, "o_orderkey long, o_totalprice double", out, chk, lambda x: x.selectExpr("o_orderkey", "o_totalprice * 2 as price"))
    return spark.read.parquet(out)

"""Readers for loosely kept text tables: everything stays text until an expression parses it."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlode.functions.text import first_non_blank, non_blank, trim_all


def normal_name(name: str) -> str:
    """A header cell without byte-order mark and outer white space, lower case."""
    return name.replace("﻿", "").strip().lower()


def resolve(columns: list[str], *candidates: str) -> str:
    """The first candidate among the columns, whatever its case."""
    by = {normal_name(c): c for c in reversed(columns)}
    for c in candidates:
        if normal_name(c) in by:
            return by[normal_name(c)]
    raise ValueError(f"none of {', '.join(candidates)} among {', '.join(columns)}")


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def sniff(spark: SparkSession, path: str, seps: str = "\t,;") -> str:
    """The separator that splits the first line into most cells."""
    line = spark.read.text(path).first()
    return max(seps, key=lambda s: line[0].count(s)) if line else ","


def table(spark: SparkSession, path: str, sep: str | None = None, columns: list[str] | None = None, source: bool = False, line_ends_in_cells: bool = False) -> DataFrame:
    """A delimited file or folder with a header, all cells text, header cells normalised or renamed by place.

    ``source`` adds ``source_file``. Quoted cells may hold separators. Files are read in splits unless quoted
    cells may hold line ends too, which makes every file one task.
    """
    df = spark.read.csv(path, header=True, sep=sep or sniff(spark, path), multiLine=line_ends_in_cells, escape='"')
    df = df.toDF(*(columns or [normal_name(c) for c in df.columns]))
    return df.select("*", F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1).alias("source_file")) if source else df


def cells(line: str | Column, sep: str = ",") -> Column:
    """The cells of a line: a cell that begins with a quote runs to its closing quote, '""' inside it is one quote."""
    s = re.escape(sep)
    found = F.regexp_extract_all(line, F.lit(rf'(?s)(?:^|{s})(?:"(?:[^"]|"")*"[^{s}]*|[^{s}]*)'), F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r'(?s)^"((?:[^"]|"")*)"', "$1"), '""', '"')
    own = F.transform(found, lambda x, i: F.when(i == 0, x).otherwise(F.substr(x, F.lit(len(sep) + 1))))
    return F.transform(own, lambda x: F.when(x.startswith('"'), bare(x)).otherwise(x))


def positional(spark: SparkSession, path: str, columns: list[str], sep: str | None = None) -> DataFrame:
    """The first cells of each row by place, whatever the header says; blank cells are '', rows with fewer cells are left out."""
    sep = sep or sniff(spark, path)
    names = [f"c{i}" for i in range(len(spark.read.csv(path, header=True, sep=sep, escape='"').columns))]
    if len(names) < len(columns):
        raise ValueError(f"{len(names)} cells in the header, {len(columns)} wanted")
    schema = ", ".join(f"{c} string" for c in [*names, "bad"])
    df = spark.read.schema(schema).option("columnPruning", False).csv(path, header=True, sep=sep, escape='"', columnNameOfCorruptRecord="bad")
    enough = F.col("bad").isNull() | (F.size(cells("bad", sep)) >= len(columns))  # bad: another number of cells than the header
    return df.where(enough).select(*(F.coalesce(c, F.lit("")).alias(n) for c, n in zip(names, columns)))


def shards(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """A folder of numbered files: its rows with ``source_file`` and ``shard``, the number its name begins with."""
    return table(spark, path, sep, source=True).withColumn("shard", F.nullif(F.regexp_extract("source_file", r"^(\d+)", 1), F.lit("")).cast("long"))


def pieces(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """(f, no, value): the pieces of files between separators with their places from 1 in their file (its whole path).

    Pieces are ranked in the splits of the files, and the splits' counts are added up, so no task takes a whole file.
    """
    place = [F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m")]
    raw = spark.read.option("lineSep", sep).text(path) if sep != "\n" else spark.read.text(path)
    raw = raw.select("value", *place)
    before = F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = raw.groupBy("f", "b").agg(F.count("*").alias("n")).select("f", "b", F.coalesce(before, F.lit(0)).alias("o"))
    no = F.col("o") + F.row_number().over(Window.partitionBy("f", "b").orderBy("m"))
    return raw.join(offsets, ["f", "b"]).select("f", no.alias("no"), "value")


def lines(spark: SparkSession, path: str, start: int = 1) -> DataFrame:
    """(source_file, line_no, value): lines with their places in their file."""
    return pieces(spark, path).select(F.regexp_extract("f", r"([^/]*)$", 1).alias("source_file"), (F.col("no") + (start - 1)).alias("line_no"), "value")


def query_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows given inline, missing names as null."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def with_fallbacks(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """A table with wanted columns, each the first non-blank of the candidates that the table has (null: none)."""
    have = {normal_name(c): c for c in reversed(df.columns)}
    pick = lambda cs: first_non_blank(*(F.col(f"`{have[normal_name(c)]}`") for c in cs if normal_name(c) in have), F.lit(None).cast("string"))
    return df.select(*(pick(cs).alias(n) for n, cs in names.items()))


def pending_files(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(source_file, n): files of ``inputs`` that ``outputs`` (both with ``source_file``) lacks or has in part."""
    n = inputs.groupBy("source_file").agg(F.count("*").alias("n"))
    done = outputs.groupBy("source_file").agg(F.count("*").alias("done"))
    return n.join(done, "source_file", "left").where("done is null or done < n").select("source_file", "n")


def repaired(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """Lines whose first cell may hold bare separators: the last len(columns) - 1 cells are kept, the head rejoined.

    Quoted cells are read first, so separators in quotes part nothing; the CSV reader would drop what overflows. Short
    lines are left out; a line of the column names is the header.
    """
    n = len(columns)
    df = spark.read.text(path).select(cells(F.regexp_replace("value", "\ufeff|\r$", ""), sep).alias("c")).where(F.size("c") >= n)
    head = F.array_join(F.slice("c", F.lit(1), F.size("c") - (n - 1)), sep)
    out = df.select(trim_all(head).alias(columns[0]), *(trim_all(F.element_at("c", i - n)).alias(columns[i]) for i in range(1, n)))
    same = F.lit(True)
    for c in columns:
        same = same & (F.lower(F.col(c)) == c.lower())
    return out.where(~same)


def tagged(spark: SparkSession, path: str, tags: dict[str, str], needed: str | None = None, end: str = "ER") -> DataFrame:
    """Records of two-letter tags with indented continuation lines, ended by a line ``ER``; tags -> column names.

    The reader splits before every line that begins with ER, so a large file is never one row; pieces whose ER is not alone
    in its line are put back behind what they continue. Line ends may be CRLF and the last line may have blanks
    behind its tag. Of a repeated tag the last counts. Records without ``needed`` go.
    """
    raw = pieces(spark, path, f"\n{end}")
    more = raw.where((F.col("no") > 1) & ~F.col("value").rlike(r"^[ \t\r]*(\n|\z)")).select("f", "no")
    run = F.col("no") - F.row_number().over(Window.partitionBy("f").orderBy("no"))  # equal along a run of continuations
    head = more.withColumn("run", run).select("f", "no", (F.min("no").over(Window.partitionBy("f", "run")) - 1).alias("head"))
    own = raw.join(head, ["f", "no"], "left").groupBy("f", F.coalesce("head", "no").alias("head"))
    own = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "value"))), lambda x: x["value"]), f"\n{end}").alias("r"))
    recs = own.select(F.concat(F.lit("\n"), F.regexp_replace("r", "\r", "")).alias("r")).where(trim_all("r") != "")
    next_tag = r"(?=\n(?:[A-Z][A-Z0-9]|[0-9][A-Z])(?: |\n|\z)|\z)"

    def value(tag: str) -> Column:
        found = F.expr(rf"regexp_extract_all(r, r'(?s)\n{tag}(?: |(?=\n))(.*?){next_tag}', 1)")
        return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"\s*\n\s*", " ")

    out = recs.select(*(F.nullif(trim_all(value(t)), F.lit("")).alias(n) for t, n in tags.items()))
    return out.where(F.col(needed).isNotNull()) if needed else out


def json_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects separated by blank lines; blocks that are no such object are left out.

    The reader splits the blocks off, by the line ends of each file; blank lines of the other kind in a file are
    split afterwards. Of the files only their paths and kinds reach the driver, which lists them anyway.
    """
    ends = spark.read.option("lineSep", "\n").text(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.max(F.col("value").endswith("\r")).alias("crlf")).collect()
    parts = [spark.createDataFrame([], "value string")]
    for blank, crlf in (("\n\n", False), ("\r\n\r\n", True)):
        if files := [unquote(r["f"]) for r in ends if r["crlf"] == crlf]:
            parts.append(spark.read.option("lineSep", blank).text(files))
    raw = reduce(DataFrame.unionAll, parts).select(F.explode(F.split("value", r"\r?\n[ \t]*\r?\n")).alias("value")).where(trim_all("value") != "")
    return raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("o")).where("o is not null").select("o.*").na.drop("all")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; bad lines are left out."""
    raw = spark.read.text(path).where(trim_all("value") != "")
    parsed = raw.select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("o"))
    return parsed.where("o is not null and o._bad is null").select("o.*").drop("_bad")


def structure_blocks(spark: SparkSession, path: str, properties: dict[str, list[str]], containing: dict[str, str] | None = None) -> DataFrame:
    """Records ended by '$$$$' with '> <NAME>' properties (plain or gzipped): name -> candidates, first non-blank wins.

    ``containing``: name -> text; where no candidate has a value, the first property whose name holds the text does.
    """
    recs = spark.read.option("lineSep", "$$$$").text(path).withColumn("value", F.regexp_replace("value", "\r", "")).where(trim_all("value") != "")
    prop = lambda n: F.nullif(trim_all(F.regexp_extract("value", rf"(?s)>\s*<\Q{n}\E>[^\n]*\n(.*?)(?:\n\s*\n|\z)", 1)), F.lit(""))
    some = lambda t: non_blank(F.regexp_extract("value", rf"(?s)>\s*<[^>\n]*(?i:\Q{t}\E)[^>\n]*>[^\n]*\n(.*?)(?:\n\s*\n|\z)", 1))
    more = lambda k: [some(containing[k])] if containing and k in containing else []
    return recs.select(F.col("value").alias("block"), *(F.coalesce(*map(prop, names), *more(k)).alias(k) for k, names in properties.items()))


def all_blank(df: DataFrame) -> Column:
    """Whether every cell of a row is null or white space."""
    return F.forall(F.array(*(F.coalesce(trim_all(F.col(c).cast("string")), F.lit("")) for c in df.columns)), lambda x: x == "")

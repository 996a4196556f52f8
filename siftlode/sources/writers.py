"""Writers that can be run again: what is written already is skipped, what is read is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions.text import slug
from siftlode.operators.clean import exclude


def by_group(df: DataFrame, path: str, group: str, fmt: str = "csv") -> None:
    """A folder for each group, named by its slug."""
    df.withColumn("group_slug", F.coalesce(F.nullif(slug(group), F.lit("")), F.lit("none"))).write.partitionBy("group_slug").mode("overwrite").option("header", True).format(fmt).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends rows whose keys the table does not have, so a broken run goes on where it stopped."""
    spark = df.sparkSession
    if exists(spark, path):
        df = exclude(df, spark.read.parquet(path), keys)
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside the target and renames; df may read the target.

    Between the two renames there is no table for a moment. A run that broke off there is put right by the next
    call, or by ``recovered``.
    """
    spark = df.sparkSession
    recovered(spark, path)
    tmp, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").parquet(tmp)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm(old), True)
    if fs.exists(jvm(path)):
        fs.rename(jvm(path), jvm(old))
    fs.rename(jvm(tmp), jvm(path))
    fs.delete(jvm(old), True)
    spark.catalog.refreshByPath(path)


def recovered(spark: SparkSession, path: str) -> bool:
    """Puts the old table back where a replacement broke off between its renames; whether it had to."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm(path)) or not fs.exists(jvm(f"{path}.old")):
        return False
    return fs.rename(jvm(f"{path}.old"), jvm(path))


def quoted_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def concatenated(spark: SparkSession, paths: list[str], target: str, end: str) -> None:
    """The records of all files, plain or gzipped, that end in ``end``, written as one set of files; nothing is left out but blank
    pieces."""
    raw = spark.read.option("lineSep", end).text(paths)
    raw.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").write.mode("overwrite").option("lineSep", end).text(target)


def with_cells(df: DataFrame, vector: str, n: int, prefix: str = "emb_", decimals: int = 6) -> DataFrame:
    """df with ``status`` and a text column for each of the n cells of a vector instead of it.

    A vector that is null, of another length, or has a cell that is null, NaN or infinite failed: its cells are blank.
    Cells are rounded as C's printf does: from their exact value, half to even. (A float times 10^decimals is exact as a double for up to
    12 decimals; ``format_string`` alone rounds the shortest decimal text half up.)
    """
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x) == float("inf")))
    ok = F.coalesce((F.size(v) == n) & ~bad, F.lit(False))
    exact = lambda x: F.rint(x * F.lit(10.0**decimals)) / F.lit(10.0**decimals)
    cell = lambda i: F.when(ok, F.format_string(f"%.{decimals}f", exact(F.get(v, F.lit(i)).cast("double")))).alias(f"{prefix}{i}")
    return df.select(*(c for c in df.columns if c != vector), F.when(ok, "ok").otherwise("failed").alias("status"), *map(cell, range(n)))


def indexed(df: DataFrame, reason: str, path: str, keys: list[str], lineage: list[str] = ()) -> None:
    """Writes rows, an index, failures and a manifest under ``path``; df is evaluated once.

    rows/: df, those without a reason under ``part=rows``. index/: keys and lineage (where a row came from, such as
    source file and line) of each written row with its ``file`` and its ``place`` (from 0) in it. failures/: keys,
    lineage and reason of the others. manifest/: rows by reason ('ok' for none), as JSON. All but rows/ is read from rows/.
    """
    spark = df.sparkSession
    df.withColumn("part", F.when(F.col(reason).isNull(), "rows").otherwise("failures")).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    own = [*keys, *lineage]
    file = F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1)
    rows.where("part = 'rows'").select(*own, file.alias("file"), F.col("_metadata.row_index").alias("place")).write.mode("overwrite").parquet(f"{path}/index")
    rows.where("part = 'failures'").select(*own, reason).write.mode("overwrite").parquet(f"{path}/failures")
    counts = rows.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").json(f"{path}/manifest")


def at_places(spark: SparkSession, rows: str, index: DataFrame) -> DataFrame:
    """The index with ``row``, the written row at each place."""
    found = spark.read.parquet(rows).where("part = 'rows'")
    file = F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1)
    found = found.select(file.alias("file"), F.col("_metadata.row_index").alias("place"), F.struct(*(c for c in found.columns if c != "part")).alias("row"))
    return index.join(found, ["file", "place"])

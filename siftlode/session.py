"""Session construction for tests, benches and scripts; library code always takes the caller's session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go once the query that made them has ended; a written table is what lasts.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a task where ``spread`` deals them.
SPREAD = 500_000


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "siftlode") -> SparkSession:
    """A local session with the settings that results depend on (UTC) and AQE on."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One input table; the reader prunes columns and pushes filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all tasks run on this machine, as in tests, is a temporary folder made and set;
    a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="siftlode-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str = "step") -> DataFrame:
    """The same rows as a Parquet table in the shared folder.

    Lineage ends there, so a lost executor costs a reread and never the steps before it; shuffle files go once it is written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as ``counted`` has SPREAD rows, or shuffle partitions if those are more, so that what a
    task holds does not grow with the input. ``counted`` should be a table or little more: its rows are counted first."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-counted.count() // SPREAD)), *keys)

"""Incremental batches: files that a checkpoint has not seen are taken once, in one run of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> None:
    """Applies ``step`` to files under ``source`` that were not taken before and appends to ``target``.

    The checkpoint names what is done; a run that breaks off is repeated without loss or doubles.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    q = step(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

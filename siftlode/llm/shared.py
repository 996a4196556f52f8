"""Places and pieces that several operators use: the shared folder, written intermediates, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siftlode.operators.order import numbered, unused  # noqa: F401  (operators take them from here)
from siftlode.session import kept as written  # noqa: F401
from siftlode.session import scratch as shared_path  # noqa: F401

#: Words are maximal runs of other characters; ``bytes.split()`` splits at exactly these.
SEPARATORS = " \t\n\x0b\x0c\r"


def tasks(spark: SparkSession) -> int:
    """How many tasks work gets whose bytes do not tell its cost (AQE merges partitions by bytes)."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs inside, for rows that can be large."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of a stream of batches that is sorted by ``keys``; groups may span batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().copy()
        new[0] = not held or tuple(held[-1][keys].iloc[-1]) != tuple(pdf[keys].iloc[0])
        starts = new.nonzero()[0].tolist()
        if not starts:
            held.append(pdf)
            continue
        if starts[0] > 0:
            held.append(pdf.iloc[: starts[0]])
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]
        for a, b in zip(starts, starts[1:]):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def gather(rows: Iterator[tuple], columns: list[str], make: Callable[[list[tuple]], pd.DataFrame] | None = None, size: int = 5000) -> Iterator[pd.DataFrame]:
    """Tuples packed into frames of at most ``size`` rows."""
    block: list[tuple] = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pd.DataFrame(block, columns=columns)
            block = []
    if block:
        yield pd.DataFrame(block, columns=columns)

"""Places of rows in a stated order, found without a task that takes a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.session import kept


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, behind as many underscores as it takes for none to be a column of df (case aside)."""
    have, before = {c.lower() for c in df.columns}, ""
    while any((before + n).lower() in have for n in names):
        before += "_"
    return tuple(before + n for n in names)


def numbered(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """df with ``pos``, the place from 0 of each row in its group by ``order`` (nulls first), and ``n``, the group's rows.
    Null groups are groups.

    Rows are dealt to ranges of group and order and counted there; the ranges' counts are added up, so a group of any
    size is spread over tasks. Rows equal in group and order may change places. df should be a written table, since
    the ranges are found by reading it once before. Columns named pos and n are replaced.
    """
    df = df.drop("pos", "n")
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    at, run, first, size, shift = unused(df, "at", "run", "first", "size", "shift")
    rows = df.withColumn(at, F.monotonically_increasing_id())  # rows that are equal otherwise are spread too
    rows = rows.repartitionByRange(*keys, at).sortWithinPartitions(*keys, at).withColumn(at, F.monotonically_increasing_id())
    rows = kept(rows.withColumn(run, F.shiftright(at, 33)), "placed")
    runs = rows.groupBy(*groups, run).agg(F.min(at).alias(first), F.count("*").alias(size))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum(size).over(whole.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = unused(rows, *(f"group{i}" for i in range(len(groups))), "part")
    runs = runs.select(*(F.col(c).alias(m) for c, m in zip([*groups, run], mine)), (before - F.col(first)).alias(shift), F.sum(size).over(whole).alias("n"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(m)) for c, m in zip([*groups, run], mine)))
    return rows.join(runs, same).select(*df.columns, (F.col(at) + F.col(shift)).alias("pos"), "n")

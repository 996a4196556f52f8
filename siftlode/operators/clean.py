"""Relational cleaning: best row per key, lookups, exclusions, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def argmin_per_key(df: DataFrame, keys: list[str], value: str, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """The row of the least value per key (and scope, e.g. a file); ties go to the first by ``order``.

    Rows with a null value or key are left out. Rows are combined before they are shuffled.
    """
    k = keys + (scope or [])
    ok = F.lit(True)
    for c in [*k, value]:
        ok = ok & F.col(c).isNotNull()
    best = df.where(ok).groupBy(*k).agg(F.min_by(F.struct(*df.columns), F.struct(value, *order)).alias("__r"))
    return best.select("__r.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by a stated order (dropDuplicates would take any)."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def lookup_join(df: DataFrame, table: DataFrame, key: str, value: str, order: str, default="") -> DataFrame:
    """df with ``value`` of the table's last row (by ``order``) of its key, or the default."""
    last = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def exclude(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key is not in ``done``; null keys match nothing and stay."""
    return df.join(done.select(*keys), keys, "left_anti")


def only(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(wanted.select(*keys), keys, "left_semi")


def fallback_join(df: DataFrame, ref: DataFrame, first: str, second: str, value: str, order: str) -> DataFrame:
    """``value`` by the first key, else by the second; of several reference rows the first by ``order``.

    Two equi-joins: one join on either key would be a nested loop.
    """
    by = lambda k, name: ref.where(F.col(k).isNotNull()).groupBy(k).agg(F.min_by(value, order).alias(name))
    out = df.join(by(first, "__a"), first, "left").join(by(second, "__b"), second, "left")
    return out.select(*df.columns, F.coalesce("__a", "__b").alias(value))


def variant_join(df: DataFrame, table: DataFrame, name: str, value: str) -> DataFrame:
    """A dictionary join on normalised names that treats ' AND ' and ' & ' alike; the exact name wins."""
    norm = lambda c: F.upper(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))
    n = norm(F.col(name))
    keys = F.posexplode(F.array(n, F.replace(n, F.lit(" AND "), F.lit(" & ")), F.replace(n, F.lit(" & "), F.lit(" AND "))))
    t = table.select(keys.alias("__p", "__k"), F.col(value)).groupBy("__k").agg(F.min_by(value, "__p").alias(value))
    return df.withColumn("__k", norm(F.col(name))).join(t, "__k", "left").drop("__k")


def reject_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row fails, null where it passes; a null test fails nothing."""
    return F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules))


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_filter(present: Column, allowed: list | None = None, forbidden: list | None = None, required: list | None = None, any_of: list | None = None) -> Column:
    """Conditions on a row's set; None or an empty list switches one off."""
    arr = lambda v: F.array(*map(F.lit, v))
    out = F.lit(True)
    if allowed:
        out = out & (F.size(F.array_except(present, arr(allowed))) == 0)
    if forbidden:
        out = out & ~F.arrays_overlap(present, arr(forbidden))
    if required:
        out = out & (F.size(F.array_except(arr(required), present)) == 0)
    if any_of:
        out = out & F.arrays_overlap(present, arr(any_of))
    return out


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

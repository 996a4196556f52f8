"""Samples and splits from seeded hashes: the same on every run and layout, without a driver-side list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions.text import uniform
from siftlode.session import kept


def bernoulli(df: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    return df.where(uniform(seed, *keys) < fraction)


def exact(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer) without replacement; a top-n by hash, so only n rows a partition travel."""
    return df.orderBy(uniform(seed, *keys), *keys).limit(n)


def exact_fraction(df: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """floor(rows * fraction) rows without replacement, in hash order."""
    split = exact_split(df, keys, {"in": fraction, "out": 1 - fraction}, seed)
    return split.where("split = 'in'").drop("split")


def exact_split(df: DataFrame, keys: list[str], ratios: dict[str, float], seed: int = 0, buckets: int = 4096) -> DataFrame:
    """df with ``split``: parts of floor(n * ratio) rows in hash order, the last part takes the rest.

    Ranks are global, but no task sorts all rows: rows are ranked in hash ranges whose sizes are added up.
    """
    h = df.withColumn("__u", uniform(seed, *keys)).withColumn("__b", F.floor(F.col("__u") * buckets).cast("int"))
    sizes = h.groupBy("__b").agg(F.count("*").alias("__n"))  # at most ``buckets`` rows
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__b", F.coalesce(before, F.lit(0)).alias("__o"), F.sum("__n").over(Window.partitionBy()).alias("__t"))
    r = h.join(F.broadcast(offsets), "__b").withColumn("__r", F.col("__o") + F.row_number().over(Window.partitionBy("__b").orderBy("__u", *keys)) - 1)
    *cut, last = ratios
    split, edge = F.lit(last), F.lit(0)
    edges = []
    for k in cut:
        edge = edge + F.floor(F.col("__t") * ratios[k])
        edges.append((k, edge))
    for k, e in reversed(edges):
        split = F.when(F.col("__r") < e, F.lit(k)).otherwise(split)
    return r.withColumn("split", split).select(*df.columns, "split")


def hash_split(df: DataFrame, keys: list[str], validation: float = 0.2, shards: int = 4, seed: int = 0) -> DataFrame:
    """df with ``split``: 'val' below the share, else 'train_i' in equal shards."""
    u = uniform(seed, *keys)
    shard = F.least(F.floor((u - validation) / (1 - validation) * shards), F.lit(shards - 1)).cast("string")
    return df.withColumn("split", F.when(u < validation, F.lit("val")).otherwise(F.concat(F.lit("train_"), shard)))


def stratified_unique(df: DataFrame, stratum: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n items a stratum, none in two strata: strata by size, largest first, each draws from its 2n first by hash.

    All strata claim at once: each its n first items that it has not lost. Of the strata that claim an item the largest
    keeps it, the others lose it for good and claim their next; what a stratum has kept only a larger one can take
    from it. So the claims settle on what the strata would take in turn. A round is a window over at most 2n rows a
    stratum and a join on the item; no stratum, item or draw reaches the driver. Null strata and items are left out.
    """
    pairs = kept(df.where(F.col(stratum).isNotNull() & F.col(item).isNotNull()).select(F.col(stratum).alias("s"), F.col(item).alias("x")).distinct(), "pairs")
    first = Window.partitionBy("s").orderBy(uniform(seed, "s", "x"), "x")
    drawn = pairs.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 2 * n)
    sizes = pairs.groupBy("s").agg(F.count("*").alias("size"))
    drawn = kept(drawn.join(sizes, "s").select("s", "x", "r", F.struct((-F.col("size")).alias("size"), "s").alias("turn")), "drawn")
    lost = drawn.select("s", "x").limit(0)
    own = Window.partitionBy("s").orderBy("r")
    while True:
        claims = drawn.join(lost, ["s", "x"], "left_anti").withColumn("k", F.row_number().over(own)).where(F.col("k") <= n)
        claims = kept(claims.select("s", "x", "turn"), "claims")
        best = claims.groupBy("x").agg(F.min("turn").alias("best"))
        more = kept(claims.join(best, "x").where("turn <> best").select("s", "x"), "lost")
        if more.isEmpty():
            return claims.select(F.col("s").alias(stratum), F.col("x").alias(item))
        lost = kept(lost.unionByName(more), "lost")

"""Grouped statistics, histograms, correlation and regression metrics, each in one or two aggregations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_stats(df: DataFrame, keys: list, value: str, min_size: int = 1) -> DataFrame:
    """n, mean, exact median, population deviation, least and greatest value of groups of at least min_size."""
    v = F.col(value)
    out = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return out.where(F.col("n") >= min_size)


def share_with_total(df: DataFrame, key: str, total: str = "TOTAL") -> DataFrame:
    """Counts and percentages by key, and a total row."""
    every = df.agg(F.count("*").alias("n"))
    c = df.groupBy(key).agg(F.count("*").alias("n")).withColumn("share", 100.0 * F.col("n") / every.scalar())
    return c.unionByName(every.select(F.lit(total).alias(key), "n", F.lit(100.0).alias("share")))


def batch_mean_error(df: DataFrame, target: str, predicted: str, row: str, size: int) -> DataFrame:
    """The mean of the mean absolute errors of batches of ``size`` rows by row number (from 0); a short last batch counts as much."""
    b = df.groupBy(F.floor(F.col(row) / size)).agg(F.avg(F.abs(F.col(predicted) - F.col(target))).alias("e"))
    return b.agg(F.avg("e").alias("batch_mae"))


def set_label(flags: dict[str, Column], order: list[str]) -> Column:
    """The names whose flags hold, in a fixed order, joined by '+'."""
    return F.array_join(F.filter(F.array(*(F.when(flags[k], F.lit(k)) for k in order)), lambda x: x.isNotNull()), "+")


def edge_bin(value: Column, edges: list[float]) -> Column:
    """The bin of half-open intervals between edges, the last one closed; null outside.

    Edges are compared as they are: dividing by a width puts some edge values into the wrong bin.
    """
    last = len(edges) - 2
    out = F.when(value == edges[-1], F.lit(last))
    for i in range(last + 1):
        out = out.when((value >= edges[i]) & (value < edges[i + 1]), F.lit(i))
    return out


def histogram(df: DataFrame, value: str, edges: list[float], series: dict[str, Column] | None = None) -> DataFrame:
    """(bin, low, high, a count for each series): every bin, empty ones too."""
    series = series or {"n": F.lit(True)}
    counted = df.withColumn("bin", edge_bin(F.col(value), edges)).where("bin is not null").groupBy("bin").agg(*(F.count_if(c).alias(k) for k, c in series.items()))
    bins = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    return bins.join(counted, "bin", "left").fillna(0, list(series))


def floor_bin(value: Column, low: float, width: float, n: int) -> Column:
    """Bins by division, values beyond the last clamped into it."""
    return F.least(F.floor((value - low) / width), F.lit(n - 1)).cast("int")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs in one pass; rows with a null or non-finite value are left out, and constant columns."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.where(ok).agg(*(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}\x00{b}") for a, b in pairs))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}\x00{b}`").alias("r")) for a, b in pairs))
    return one.select(F.explode(cells).alias("x")).select("x.*").where("r is not null and not isnan(r)")


def regression_metrics(df: DataFrame, target: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """n, MAE, RMSE and R2 = 1 - SSE / SST over rows; R2 is null for a constant target."""
    t, e = F.col(target), F.col(predicted) - F.col(target)
    g = df.where(t.isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys)
    g = g.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"), (F.var_pop(t) * F.count("*")).alias("__sst"))
    return g.withColumn("r2", F.when(F.col("__sst") > 1e-12, 1 - F.col("__sse") / F.col("__sst"))).drop("__sse", "__sst")


def gaussian_moments(hist: DataFrame, center: str = "center", weight: str = "n") -> DataFrame:
    """Mean and deviation of a histogram by weighted moments, and the height of the curve."""
    c, w = F.col(center), F.col(weight)
    m = hist.agg(F.sum(w).alias("total"), F.try_divide(F.sum(w * c), F.sum(w)).alias("mean"), F.try_divide(F.sum(w * c * c), F.sum(w)).alias("__m2"))
    return m.withColumn("std", F.sqrt(F.greatest(F.col("__m2") - F.col("mean") ** 2, F.lit(0.0)))).drop("__m2")


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0."""
    m = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"__s_{c}") for c in columns))
    out = df.join(F.broadcast(m))  # a single row
    z = {c: F.when(F.col(f"__s_{c}") == 0, F.lit(0.0)).otherwise((F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")) for c in columns}
    return out.withColumns(z).select(*df.columns)


def gaussian_fit(bins: DataFrame, keys: list[str], center: str = "center", weight: str = "n", rounds: int = 60) -> DataFrame:
    """(keys, height, mean, std, sse, sse_moments) of curves height * exp(-(x - mean)^2 / (2 std^2)) through each group's bins.

    Least squares by damped steps (Levenberg-Marquardt) from the weighted moments; a step that does not lower the sum of
    squares is not taken, so the fit is never worse than the moments. A group's bins are one row, as many as the histogram has;
    all groups go on at once inside the JVM. Bins with a null are left out. Groups without weight or with one center alone have
    no curve: null.
    """
    # groups are few bytes and much work: dealt by number, since small partitions would be joined into one task
    deal = int(bins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pts = bins.where(F.col(center).isNotNull() & F.col(weight).isNotNull()).repartition(deal, *keys).groupBy(*keys)
    pts = pts.agg(F.sort_array(F.collect_list(F.struct(F.col(center).cast("double").alias("x"), F.col(weight).cast("double").alias("y")))).alias("p"))
    p, total = F.col("p"), lambda f: F.aggregate(F.col("p"), F.lit(0.0), lambda s, b: s + f(b))
    d = pts.withColumn("w", total(lambda b: b["y"])).withColumn("mean", F.try_divide(total(lambda b: b["x"] * b["y"]), F.col("w")))
    d = d.withColumn("std", F.sqrt(F.try_divide(total(lambda b: b["y"] * (b["x"] - F.col("mean")) ** 2), F.col("w"))))
    d = d.withColumns({c: F.when((F.col("w") > 0) & (F.col("std") > 0), F.col(c)) for c in ("mean", "std")})
    shape = lambda b, m, s: F.exp(-((b["x"] - m) ** 2) / (2 * s * s))
    error = lambda h, m, s: F.aggregate(p, F.lit(0.0), lambda t, b: t + (b["y"] - h * shape(b, m, s)) ** 2)
    top = F.try_divide(F.aggregate(p, F.lit(0.0), lambda t, b: t + b["y"] * shape(b, F.col("mean"), F.col("std"))), F.aggregate(p, F.lit(0.0), lambda t, b: t + shape(b, F.col("mean"), F.col("std")) ** 2))
    d = d.withColumn("height", top).withColumn("sse_moments", error(F.col("height"), F.col("mean"), F.col("std")))

    def normal(h: Column, m: Column, s: Column) -> Column:
        """Sums of the products of the three derivatives with each other and with the residual."""
        names = ["hh", "hm", "hs", "mm", "ms", "ss", "hr", "mr", "sr"]

        def add(t, b):
            e = shape(b, m, s)
            g = {"h": e, "m": h * e * (b["x"] - m) / (s * s), "s": h * e * (b["x"] - m) ** 2 / (s * s * s), "r": b["y"] - h * e}
            return F.struct(*((t[n] + g[n[0]] * g[n[1]]).alias(n) for n in names))

        return F.aggregate(p, F.struct(*(F.lit(0.0).alias(n) for n in names)), add)

    def step(state: Column, _: Column) -> Column:
        h, m, s, lam = (state[c] for c in ("height", "mean", "std", "lam"))

        def solved(n: Column) -> Column:
            a, e, i = (n[c] * (1 + lam) for c in ("hh", "mm", "ss"))
            b, c, f, r, q, t = n["hm"], n["hs"], n["ms"], n["hr"], n["mr"], n["sr"]
            det = a * (e * i - f * f) - b * (b * i - f * c) + c * (b * f - e * c)
            dh = r * (e * i - f * f) - b * (q * i - f * t) + c * (q * f - e * t)
            dm = a * (q * i - f * t) - r * (b * i - f * c) + c * (b * t - q * c)
            ds = a * (e * t - q * f) - b * (b * t - q * c) + r * (b * f - e * c)
            return F.struct((h + F.try_divide(dh, det)).alias("height"), (m + F.try_divide(dm, det)).alias("mean"), F.abs(s + F.try_divide(ds, det)).alias("std"))

        def judged(x: Column) -> Column:
            sse = error(x["height"], x["mean"], x["std"])
            better = F.coalesce((sse < state["sse"]) & (x["std"] > 0), F.lit(False))
            new = F.struct(x["height"].alias("height"), x["mean"].alias("mean"), x["std"].alias("std"), (lam / 4).alias("lam"), sse.alias("sse"))
            return F.when(better, new).otherwise(F.struct(h.alias("height"), m.alias("mean"), s.alias("std"), F.least(lam * 5, F.lit(1e12)).alias("lam"), state["sse"].alias("sse")))

        # arrays of one element hold what a step uses several times
        x = F.transform(F.array(normal(h, m, s)), solved)
        return F.transform(x, judged)[0]

    start = F.struct("height", "mean", "std", F.lit(1e-3).alias("lam"), F.col("sse_moments").alias("sse"))
    d = d.withColumn("fit", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return d.select(*keys, "fit.height", "fit.mean", "fit.std", "fit.sse", "sse_moments")


def usable(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns are all finite, with the columns that vary among them; what went: (what, name, n)).

    One pass counts the rows with a null, NaN or infinite value and takes each column's least and greatest value of the others;
    the schema of the result follows from it. Other columns of df stay. Of no rows no column varies.
    """
    ok = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf")) for c in columns))
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    seen = df.agg(
        F.count("*").alias("rows"), F.count_if(ok).alias("ok"), *(F.count_if(bad(c)).alias(f"bad {i}") for i, c in enumerate(columns)),
        *(F.min(F.when(ok, F.col(c))).alias(f"low {i}") for i, c in enumerate(columns)), *(F.max(F.when(ok, F.col(c))).alias(f"high {i}") for i, c in enumerate(columns)),
    ).first()
    constant = [c for i, c in enumerate(columns) if seen[f"low {i}"] == seen[f"high {i}"]]
    went = [("rows", None, seen["rows"] - seen["ok"])] + [("not finite", c, seen[f"bad {i}"]) for i, c in enumerate(columns) if seen[f"bad {i}"]] + [("constant", c, seen["ok"]) for c in constant]
    return df.where(ok).drop(*constant), df.sparkSession.createDataFrame(went, "what string, name string, n long")


def contrast_loss(pairs: DataFrame, batch: str, a: str, b: str, temperature: float = 0.1, block: int = 512) -> DataFrame:
    """(batch, n, loss): the normalised temperature-scaled cross entropy of pairs of views, batch by batch.

    Both views' vectors are scaled to length 1 (zero vectors stay); each of the 2n rows is told from all others but itself by
    its partner. Cosines are taken ``block`` rows at a time with a running log-sum-exp, so a batch of n pairs of width d
    needs 2n x (d + block) numbers; a batch is what a model trained on at once. A batch with a null or NaN cell, or vectors of
    different lengths, has the loss NaN, else one with an infinite cell an infinite loss. A single pair has loss 0.
    """
    src = pairs.select(F.col(batch).alias("batch"), F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def loss() -> pd.DataFrame:
            g = pd.concat(held)
            rows = [*g["a"], *g["b"]]
            n, value = len(g), float("nan")
            same = all(r is not None and rows[0] is not None and len(r) == len(rows[0]) > 0 for r in rows)
            z = np.array([list(r) for r in rows], float) if same else np.full((1, 1), np.nan)
            if np.isinf(z).any() and not np.isnan(z).any():
                value = float("inf")
            elif not np.isnan(z).any():
                z /= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
                total = 0.0
                for i in range(0, 2 * n, block):
                    own = np.arange(i, min(i + block, 2 * n))
                    most, rest = np.full(len(own), -np.inf), np.zeros(len(own))
                    for j in range(0, 2 * n, block):
                        s = z[own] @ z[j : j + block].T / temperature
                        s[own[:, None] == np.arange(j, j + s.shape[1])] = -np.inf
                        new = np.maximum(most, s.max(axis=1))
                        rest = rest * np.exp(most - np.where(np.isfinite(new), new, 0)) + np.exp(s - np.where(np.isfinite(new), new, 0)[:, None]).sum(axis=1)
                        most = new
                    partner = np.einsum("ij,ij->i", z[own], z[(own + n) % (2 * n)]) / temperature
                    total += float((most + np.log(rest) - partner).sum())
                value = total / (2 * n)
            return pd.DataFrame({"batch": [g["batch"].iloc[0]], "n": [n], "loss": [value]})

        for pdf in batches:
            for key, part in pdf.groupby("batch", sort=False):
                if held and held[0]["batch"].iloc[0] != key:
                    yield loss()
                    held.clear()
                held.append(part)
        if held:
            yield loss()

    kind = src.schema["batch"].dataType.simpleString()
    out = src.where("batch is not null").repartition("batch").sortWithinPartitions("batch").mapInPandas(each, f"batch {kind}, n long, loss double")
    return out.withColumn("loss", F.coalesce("loss", F.lit(float("nan"))))  # pandas hands NaN on as null

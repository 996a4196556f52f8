"""Graphs as vertex and edge tables: (g, v, features...) and (g, s, d), each edge in both directions."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.text import lookup, uniform
from siftlode.operators.order import unused


def each_group(df: DataFrame, keys: list[str], order: list[str], solve: Callable[[list[tuple]], Iterator[tuple]], out: list[str]) -> DataFrame:
    """The rows that ``solve`` makes of each group's rows; ``out`` names columns of df whose types they have.

    Groups are small (a molecule) and many: a task sorts its rows by key and goes through them group by group, many to
    each batch that it hands on.
    """
    at = [df.columns.index(c) for c in out]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields: list[pa.Field] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                fields[:] = [b.schema.field(i) for i in at]
                yield from zip(*(c.to_pylist() for c in b.columns))

        def packed(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], out)

        held: list[tuple] = []
        for _, group in groupby(rows(), lambda r: r[: len(keys)]):
            held += solve(list(group))
            if len(held) >= 10_000:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(each, df.select(*out).schema)


def mirrored(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    rest = [c for c in edges.columns if c not in ("g", "s", "d")]
    return edges.unionByName(edges.select("g", F.col("d").alias("s"), F.col("s").alias("d"), *rest)).dropDuplicates(["g", "s", "d"])


def validity(vertices: DataFrame, edges: DataFrame, features: list[str], min_nodes: int = 2) -> DataFrame:
    """(g, n_nodes, n_edges, reason): reason is null for graphs that can be used."""
    bad = F.lit(False)
    for c in features:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    v = vertices.groupBy("g").agg(F.count("*").alias("n_nodes"), F.max(bad).alias("__bad"), F.max("v").alias("__max"))
    e = edges.groupBy("g").agg(F.count("*").alias("n_edges"), F.max(F.greatest("s", "d")).alias("__top"))
    j = v.join(e, "g", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    reason = F.when(F.col("n_nodes") < min_nodes, "too_few_nodes").when(F.col("n_edges") == 0, "no_edges").when(F.col("__bad"), "bad_feature").when(F.col("__top") > F.col("__max"), "dangling_edge")
    return j.select("g", "n_nodes", "n_edges", reason.alias("reason"))


def pooled(vertices: DataFrame, features: list[str], how: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "sum": F.sum}[how]
    return vertices.groupBy("g").agg(*(f(c).alias(c) for c in features))


def degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("g", F.col("s").alias("v")).agg(F.count("*").alias("degree"))


def equalised(vertices: DataFrame, edges: DataFrame, kinds: DataFrame, rounds: int = 6, damping: float = 0.5, cut: int = 3) -> DataFrame:
    """(g, v, charge): partial charges by exchange over bonds, a fixed number of rounds, each smaller by ``damping``.

    vertices (g, v, kind, charge: the formal one, null for 0), edges (g, s, d), kinds (kind, a, b, c, top): a kind's
    electronegativity at charge q is a + b q + c q^2, and ``top`` is its value as a positive ion. In each round an edge moves
    damping^k (chi(d) - chi(s)) / top of its less electronegative end from one end to the other, so the total of a graph stays.
    Vertices of an unknown kind take part in no exchange; loops and doubled edges count as none and once. A graph's vertices and
    edges are brought together once (a molecule is a row) and all rounds run there; ``cut`` has no effect any more.
    """
    names = ["q", "a", "b", "c", "top"]
    v = vertices.join(F.broadcast(kinds), "kind", "left").withColumn("q", F.coalesce(F.col("charge").cast("double"), F.lit(0.0)))
    v = v.groupBy("g").agg(F.collect_list(F.struct("v", *(F.col(c).cast("double").alias(c) for c in names))).alias("vs"))
    e = edges.where("s <> d").groupBy("g").agg(F.collect_set(F.struct(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"))).alias("es"))
    ends = [F.transform(F.coalesce("es", F.array()), lambda x: x[c]) for c in ("s", "d")]
    run = F.arrow_udf(lambda *x: exchanged(*x, rounds, damping), "array<double>")
    done = v.join(e, "g", "left").select("g", "vs", run(*(F.transform("vs", lambda x: x[c]) for c in ("v", *names)), *ends).alias("qs"))
    rows = done.select("g", F.explode(F.zip_with("vs", "qs", lambda x, q: F.struct(x["v"].alias("v"), q.alias("charge")))).alias("x"))
    return rows.select("g", "x.v", "x.charge")


def exchanged(v: pa.Array, q: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, top: pa.Array, s: pa.Array, d: pa.Array, rounds: int, damping: float) -> pa.Array:
    """The charges of the vertices v[i] of each graph i after the rounds of ``equalised`` over its edges s[i] - d[i]."""
    of = lambda x: np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    ids = pa.concat_arrays([x.flatten() for x in (v, s, d)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    keys = np.r_[of(v), of(s), of(d)] * (len(ids) + 1) + np.nan_to_num(ids, nan=len(ids)).astype(np.int64)
    n, m = len(v.flatten()), len(s.flatten())
    q, a, b, c, top = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (q, a, b, c, top))
    if n and m:
        order = np.argsort(keys[:n], kind="stable")
        at = order[np.minimum(np.searchsorted(keys[:n], keys[n:], sorter=order), n - 1)]
        there = (keys[at] == keys[n:]) & ~np.isnan(a + b + c + top)[at]
        both = there[:m] & there[m:]
        s, d = at[:m][both], at[m:][both]
        for k in range(1, rounds + 1):
            chi = a + b * q + c * q * q
            gap = chi[d] - chi[s]
            moved = gap / np.where(gap > 0, top[s], top[d]) * damping**k
            q = q + np.bincount(s, moved, n) - np.bincount(d, moved, n)
    return pa.ListArray.from_arrays(pa.array(v.offsets.to_numpy() - v.offsets[0].as_py()), pa.array(q))


def _orders(edges: DataFrame) -> DataFrame:
    """(g, es): a graph's edges once, s < d, as an array of (s, d, order) with the highest order of each."""
    one = edges.where("s <> d").groupBy("g", F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d")).agg(F.max(F.col("order").cast("double")).alias("order"))
    return one.where("g is not null").groupBy("g").agg(F.collect_list(F.struct("s", "d", "order")).alias("es"))


def _ringed(rings: DataFrame) -> DataFrame:
    """(g, rs): a graph's edges on rings as an array of (s, d, ring)."""
    return rings.where("g is not null and ring is not null").groupBy("g").agg(F.collect_list(F.struct("s", "d", "ring")).alias("rs"))


def _at(e: Column, v: Column) -> Column:
    return (e["s"] == v) | (e["d"] == v)


def _same(e: Column, r: Column) -> Column:
    return (e["s"] == r["s"]) & (e["d"] == r["d"])


def edge_features(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """(g, s, d, order, in_ring, conjugated, degrees): edges (g, s, d, order) with what needs their surroundings.

    order is 1, 1.5, 2 or 3. An edge is conjugated if it is of order 1.5, or single between two ends that each have another edge
    above single, or above single beside a conjugated single edge. degrees: those of both ends. rings: as ``smallest_rings`` gives.
    A graph's edges are one row (a molecule): they and its rings meet by g alone.
    """
    j = _orders(edges).join(_ringed(rings), "g", "left").withColumn("rs", F.coalesce("rs", F.array()))
    multiple = lambda v: F.exists("es", lambda x: (x["order"] > 1) & _at(x, v))
    bridge = lambda e: (e["order"] == 1) & multiple(e["s"]) & multiple(e["d"])
    j = j.select("g", "es", "rs", F.filter("es", bridge).alias("bridges"))
    degree = lambda v: F.size(F.filter("es", lambda x: _at(x, v))).cast("long")
    beside = lambda e: F.exists("bridges", lambda x: _at(x, e["s"]) | _at(x, e["d"]))
    conjugated = lambda e: F.exists("bridges", lambda x: _same(x, e)) | (e["order"] == 1.5) | ((e["order"] > 1) & beside(e))
    features = lambda e: F.struct(
        e["s"].alias("s"), e["d"].alias("d"), e["order"].alias("order"), F.exists("rs", lambda r: _same(r, e)).alias("in_ring"), conjugated(e).alias("conjugated"), F.array(degree(e["s"]), degree(e["d"])).alias("degrees")
    )
    return j.select("g", F.explode(F.transform("es", features)).alias("e")).select("g", "e.*")


def vertex_features(vertices: DataFrame, edges: DataFrame, rings: DataFrame, valences: dict[str, int]) -> DataFrame:
    """vertices (g, v, label, charge, ...) with degree, explicit_valence, implicit_valence, total_valence, total_num_hs,
    total_degree, is_aromatic, is_in_ring and min_ring_size, from edges (g, s, d, order) and ``smallest_rings``.

    explicit_valence is the sum of the orders, rounded up; what the usual valence of the label, more by a positive charge, leaves open is
    implicit and filled by hydrogen. Labels without a usual valence have no open places. A vertex without edges has zeros.
    A graph's edges are one row (a molecule) that meets its vertices by g alone.
    """
    es, rs = unused(vertices, "es", "rs")
    around = _orders(edges).join(_ringed(rings), "g", "left")
    around = around.select("g", F.col("es").alias(es), F.filter(F.coalesce("rs", F.array()), lambda r: F.exists("es", lambda e: _same(e, r))).alias(rs))
    own = lambda c: F.filter(F.coalesce(c, F.array()), lambda x: _at(x, F.col("v")))
    out = vertices.join(around, "g", "left").withColumns({es: own(es), rs: own(rs)})
    total = F.aggregate(es, F.lit(0.0), lambda t, x: t + x["order"])
    out = out.withColumns({
        "degree": F.size(es).cast("long"), "explicit_valence": F.ceil(total).cast("int"), "is_aromatic": F.exists(es, lambda x: x["order"] == 1.5),
        "is_in_ring": F.size(rs) > 0, "min_ring_size": F.coalesce(F.array_min(F.transform(rs, lambda x: x["ring"])), F.lit(0)),
    }).drop(es, rs)
    usual = lookup("label", valences, None) + F.coalesce("charge", F.lit(0))
    out = out.withColumn("implicit_valence", F.greatest(F.coalesce(usual - F.col("explicit_valence"), F.lit(0)), F.lit(0)).cast("int"))
    out = out.withColumn("total_valence", F.col("explicit_valence") + F.col("implicit_valence")).withColumn("total_num_hs", F.col("implicit_valence"))
    return out.withColumn("total_degree", (F.col("degree") + F.col("implicit_valence")).cast("int"))


def edge_index(edges: DataFrame, features: list[str]) -> DataFrame:
    """(g, edges): the edges of a graph as one array of (s, d, x), each in both directions, in order; x has the features."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    both = edges.select("g", F.explode(F.array(F.struct("s", "d", x.alias("x")), F.struct(F.col("d").alias("s"), F.col("s").alias("d"), x.alias("x")))).alias("e"))
    return both.groupBy("g").agg(F.array_sort(F.collect_list("e")).alias("edges"))


def masked_vertices(edges: DataFrame, share: float = 0.25, seed: int = 0) -> DataFrame:
    """(g, v): a connected set of about ``share`` of each graph's vertices, none of graphs of two or fewer.

    The set grows breadth first, smaller neighbours first, from a vertex drawn by a seeded hash of the graph, and
    leaves two vertices at least. One graph is a group: its size is that of a molecule.
    """

    def grow(rows: list[tuple]) -> Iterator[tuple]:
        near: dict = {}
        for _, a, b, _ in rows:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        nodes = sorted(near)
        n = min(max(1, int(len(nodes) * share)), len(nodes) - 2)
        queue = [nodes[int(rows[0][3] * len(nodes))]] if n > 0 else []
        seen = set(queue)
        for x in queue:
            if len(queue) >= n:
                break
            new = sorted(near[x] - seen)[: n - len(queue)]
            queue += new
            seen.update(new)
        return ((rows[0][0], v) for v in queue)

    h = edges.select("g", "s", "d").withColumn("u", uniform(seed, "g"))
    return each_group(h, ["g"], ["s", "d"], grow, ["g", "s"]).withColumnRenamed("s", "v")


def masked_subgraph(edges: DataFrame, share: float = 0.25, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """The edges left after ``masked_vertices`` are masked; the first by ``order`` stays where none would.

    The features of the masked vertices are the caller's: ``masked_vertices`` names them.
    """
    gone = masked_vertices(edges, share, seed)
    mark = edges
    for c in ("s", "d"):
        mark = mark.join(gone.select("g", F.col("v").alias(c), F.lit(True).alias("__" + c)), ["g", c], "left")
    mark = mark.withColumn("__gone", F.coalesce("__s", "__d", F.lit(False)))
    least = mark.groupBy("g").agg(F.min("__gone").alias("__none"), F.min(F.struct(*(order or ["s", "d"]))).alias("__first"))
    first = F.struct(*(order or ["s", "d"])) == F.col("__first")
    return mark.join(least, "g").where(~F.col("__gone") | (F.col("__none") & first)).select(*edges.columns)


def assigned(pairs: DataFrame, keys: list[str], a: str, b: str, cost: str) -> DataFrame:
    """keys, a, b, cost (double): the one-to-one assignment of least total cost in each group of a square cost table.

    Groups whose sides differ in size, or miss a cost (null or NaN), give no rows. A group is a molecule's atoms of one kind;
    a task solves all groups of one size that it holds at once. Pairs that lie by their keys already are not shuffled.
    """
    schema = pairs.select(*keys, a, b).withColumn("__cost", F.lit(0.0)).schema
    src = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.struct(F.col(a).alias("a"), F.col(b).alias("b"), F.col(cost).cast("double").alias("c")).alias("__x"))
    packed = src.groupBy(*keys).agg(F.sort_array(F.collect_list("__x")).alias("__x"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(len(keys))
            group, x, y, c = _assigned(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(group)) for i in range(len(keys))), x, y, pa.array(c)], schema.names)

    return packed.mapInArrow(each, schema).withColumnRenamed("__cost", cost)


def _differ(x: pa.Array, y: pa.Array) -> np.ndarray:
    try:
        return pc.not_equal(x, y).to_numpy(zero_copy_only=False)
    except pa.ArrowNotImplementedError:
        return np.array([p != q for p, q in zip(x.to_pylist(), y.to_pylist())], bool)


def _assigned(groups: pa.ListArray) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """(group, a, b, cost) of the cheapest assignments of groups of sorted pairs (a, b, c)."""
    pairs = groups.flatten()
    x, y, c = (pairs.field(i) for i in range(3))
    c, group = c.to_numpy(zero_copy_only=False).astype(np.float64), np.repeat(np.arange(len(groups)), np.diff(groups.offsets.to_numpy()))
    new_a = np.ones(len(c), bool)
    new_a[1:] = np.diff(group) != 0
    new_a[1:] |= _differ(x[1:], x[:-1])
    new = new_a.copy()
    new[1:] |= _differ(y[1:], y[:-1])
    at = np.flatnonzero(new)  # each pair once, at its least cost
    if not len(at):
        return at, x, y, c
    c, group, new_a = np.fmin.reduceat(c, at), group[at], new_a[at]
    size = np.bincount(group, minlength=len(groups))
    n = np.bincount(group[new_a], minlength=len(groups))
    first = np.cumsum(size) - size
    place, side = np.arange(len(at)) - first[group], n[group]
    # a square: the first a has n partners, and the others have the same ones
    ok = new_a == (place % side == 0)
    ok &= (size == n * n)[group]
    pa_at = pa.array(at)
    ok &= ~_differ(y.take(pa_at), y.take(pa.array(at[first[group] + np.where(ok, place % side, 0)]))) & ~np.isnan(c)
    whole = np.bincount(group[ok], minlength=len(groups)) == size
    chosen = []
    for k in np.unique(n[whole & (n > 0)]):
        begin = first[whole & (n == k)]
        cost = c[begin[:, None] + np.arange(k * k)].reshape(-1, k, k)
        chosen.append((begin[:, None] + np.arange(k) * k + cheapest_of_each(cost)).ravel())
    chosen = np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)
    taken = pa.array(at[chosen])
    return group[chosen], x.take(taken), y.take(taken), c[chosen]


def cheapest_of_each(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment of each of many square tables of one size, as ``cheapest`` finds it,
    a step of all tables at a time."""
    g, n = cost.shape[:2]
    out = np.empty((g, n), np.int64)
    odd = ~np.isfinite(cost).all(axis=(1, 2))
    for i in np.flatnonzero(odd):
        out[i] = cheapest(cost[i].tolist())
    cost = cost[~odd]
    g = len(cost)
    # column 0 holds the row that looks for a column; rows and columns count from 1
    pot_r, pot_c, row_of = np.zeros((g, n + 1)), np.zeros((g, n + 1)), np.zeros((g, n + 1), np.int64)
    back, every = np.zeros((g, n + 1), np.int64), np.arange(g)
    for r in range(1, n + 1):
        row_of[:, 0] = r
        dist, done, at, live = np.full((g, n), np.inf), np.zeros((g, n + 1), bool), np.zeros(g, np.int64), every
        while len(live):
            j, here = at[live], np.arange(len(live))
            done[live, j] = True
            i, used = row_of[live, j], done[live]
            d, via = dist[live], back[live]
            new = cost[live, i - 1] - pot_r[live, i][:, None] - pot_c[live, 1:]
            less = ~used[:, 1:] & (new < d)
            d, via[:, 1:] = np.where(less, new, d), np.where(less, j[:, None], via[:, 1:])
            open_ = np.where(used[:, 1:], np.inf, d)
            near = open_.argmin(axis=1)
            step = open_[here, near]
            moved = used * step[:, None]
            pot = pot_r[live]
            pot[here[:, None], row_of[live]] += moved  # rows of done columns are all different; the rest adds 0
            pot_r[live] = pot
            pot_c[live] -= moved
            dist[live], back[live], at[live] = d - np.where(used[:, 1:], 0, step[:, None]), via, near + 1
            live = live[row_of[live, near + 1] > 0]
        live = every
        while len(live):
            j = at[live]
            before = back[live, j]
            row_of[live, j] = row_of[live, before]
            at[live] = before
            live = live[before > 0]
    found = np.empty((g, n), np.int64)
    found[every[:, None], row_of[:, 1:] - 1] = np.arange(n)
    out[~odd] = found
    return out


def cheapest(cost: list[list[float]]) -> list[int]:
    """The column of each row in a cheapest assignment, by successive shortest paths with potentials."""
    n = len(cost)
    row_of, pot_r, pot_c = [-1] * n, [0.0] * n, [0.0] * n
    for r in range(n):
        dist, back, done = [float("inf")] * n, [-1] * n, [False] * n
        heap = [(cost[r][j] - pot_r[r] - pot_c[j], j, -1) for j in range(n)]
        heapq.heapify(heap)
        while True:
            d, j, via = heapq.heappop(heap)
            if done[j]:
                continue
            done[j], dist[j], back[j] = True, d, via
            if row_of[j] < 0:
                break
            i = row_of[j]
            for k in range(n):
                if not done[k]:
                    heapq.heappush(heap, (d + cost[i][k] - pot_r[i] - pot_c[k], k, j))
        end = j
        for k in range(n):
            if done[k] and k != end:
                pot_c[k] += dist[k] - dist[end]
                pot_r[row_of[k]] -= dist[k] - dist[end]
        pot_r[r] += dist[end]
        while back[j] >= 0:
            row_of[j] = row_of[back[j]]
            j = back[j]
        row_of[j] = r
    out = [0] * n
    for j, i in enumerate(row_of):
        out[i] = j
    return out


def scored(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """df through a model: ``load`` runs once a task and returns a function from batches to batches."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(each, schema)

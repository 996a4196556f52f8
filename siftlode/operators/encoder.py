"""A graph encoder's forward pass: edge-conditioned sums over neighbours, dense layers, pooling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vertices of the graphs that are taken through the layers at once; a larger graph goes alone.
VERTICES = 16_384


@dataclass
class Weights:
    """Dense layers as (matrix in x out, bias): of vertices, of edges, of each round (edges, first, second, and the weight
    of a vertex itself), and the last two. A normalisation of a trained model is folded into the layer before it."""

    node: tuple[np.ndarray, np.ndarray]
    edge: tuple[np.ndarray, np.ndarray]
    rounds: list[tuple[tuple, tuple, tuple, float]] = field(default_factory=list)
    last: tuple[tuple, tuple] | None = None


def _relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def forward(w: Weights, x: np.ndarray, s: np.ndarray, d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Vertex vectors from vertex features x and directed edges s -> d with features e."""
    dense = lambda a, layer: a @ layer[0] + layer[1]
    order = np.lexsort((s, d))  # sums in one order, whatever else is in the batch
    s, d, e = s[order], d[order], e[order]
    starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, int)
    x, e = dense(x, w.node), dense(e, w.edge)
    for edges, first, second, own in w.rounds:
        total = np.zeros_like(x)
        if len(d):
            total[d[starts]] = np.add.reduceat(_relu(x[s] + dense(e, edges)), starts, axis=0)
        x = _relu(dense(_relu(dense((1 + own) * x + total, first)), second))
    if w.last:
        x = dense(_relu(dense(x, w.last[0])), w.last[1])
    return x


def nested(vertices: DataFrame, edges: DataFrame, features: list[str], edge_features: list[str]) -> DataFrame:
    """(g, n, x, s, d, e): one row a graph: vertex features in the order of v, one behind the other, and edges by the places of
    their ends, in both directions. vertices (g, v, features), edges (g, s, d, features), each edge once or both ways. An edge
    to a vertex that is not there is left out. A graph is a row: its size is that of a molecule."""
    cell = lambda cs: F.array(*(F.col(c).cast("double") for c in cs))
    v = vertices.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("v", cell(features).alias("x")))).alias("vs"))
    one = edges.select("g", F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"), cell(edge_features).alias("e")).dropDuplicates(["g", "s", "d"])
    ways = F.array(F.struct("s", "d", "e"), F.struct(F.col("d").alias("s"), F.col("s").alias("d"), "e"))
    both = one.select("g", F.explode(F.array_distinct(ways)).alias("w")).select("g", "w.*")
    es = both.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("s", "d", "e"))).alias("es"))
    j = v.join(es, "g", "left").withColumn("ids", F.transform("vs", lambda a: a["v"]))
    place = lambda end: F.transform("es", lambda a: F.array_position(F.col("ids"), a[end]) - 1)
    j = j.withColumn("es", F.filter(F.coalesce("es", F.array()), lambda a: F.array_contains(F.col("ids"), a["s"]) & F.array_contains(F.col("ids"), a["d"])))
    return j.select("g", F.size("vs").alias("n"), F.flatten(F.transform("vs", lambda a: a["x"])).alias("x"), place("s").alias("s"), place("d").alias("d"), F.flatten(F.transform("es", lambda a: a["e"])).alias("e"))


def embedded(graphs: DataFrame, weights: Weights, pooling: str = "mean", vertices: int = VERTICES) -> DataFrame:
    """(g, n, embedding, status) of graphs as ``nested`` makes them: the mean or sum of the vertex vectors.

    Whole graphs are packed until they have ``vertices`` vertices and go through the layers together; the weights are
    broadcast once. A graph with a null, NaN or infinite feature has status 'failed' and no vector, one without vertices too.
    """
    if pooling not in ("mean", "sum"):
        raise ValueError(f"unknown pooling: {pooling}")
    shared = graphs.sparkSession.sparkContext.broadcast(weights)
    width, edge_width = weights.node[0].shape[0], weights.edge[0].shape[0]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
        size = lambda c: np.diff(b.column(c).offsets.to_numpy())
        n, m = size("x") // width, size("s")
        x, e = flat("x").astype(float).reshape(-1, width), flat("e").astype(float).reshape(-1, edge_width)
        shift = np.repeat(np.cumsum(n) - n, m)
        s, d = flat("s").astype(np.int64) + shift, flat("d").astype(np.int64) + shift
        of_v, of_e = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), m)
        ok = n > 0
        ok[of_v[~np.isfinite(x).all(axis=1)]] = False
        ok[of_e[~np.isfinite(e).all(axis=1)]] = False
        x[~np.isfinite(x)], e[~np.isfinite(e)] = 0, 0
        out = forward(shared.value, x, s, d, e)
        starts = (np.cumsum(n) - n)[n > 0]
        pooled = np.zeros((len(n), out.shape[1]))
        if len(starts):
            pooled[n > 0] = np.add.reduceat(out, starts, axis=0)
        if pooling == "mean":
            pooled /= np.maximum(n, 1)[:, None]
        vectors = pa.array([v if good else None for v, good in zip(pooled, ok)], pa.list_(pa.float64()))
        status = pa.array(np.where(ok, "ok", "failed").tolist(), pa.string())
        return pa.RecordBatch.from_arrays([b.column("g"), b.column("n"), vectors, status], ["g", "n", "embedding", "status"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, a = 0, 0
            for i, n in enumerate(b.column("n").to_pylist()):
                if i > a and total + n > vertices:
                    yield run(b.slice(a, i - a))
                    a, total = i, 0
                total += n
            if a < len(b):
                yield run(b.slice(a))

    kind = graphs.schema["g"].dataType.simpleString()
    return graphs.select("g", "n", "x", "s", "d", "e").mapInArrow(each, f"g {kind}, n int, embedding array<double>, status string")

"""Rings of graphs: the shortest cycle through each edge, and what follows from it for vertices and graphs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that are taken out at a time; all pairs of such an edge and a vertex of one level are held.
HELD = 50_000


def smallest_rings(edges: DataFrame, largest: int = 8) -> DataFrame:
    """(g, s, d, ring): every edge once (s < d) with the number of edges of the shortest cycle through it.

    ring is null for edges on no cycle of at most ``largest`` edges. Loops are left out, parallel edges count once; a tree
    has no rings. A graph's edges are brought together once (a molecule is a row); ``ring_sizes`` goes through many graphs at a time.
    """
    types = {f.name: f.dataType for f in edges.schema}
    one = edges.where("s <> d").groupBy("g").agg(F.collect_set(F.struct(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"))).alias("es"))
    ends = [F.transform("es", lambda e: e[c]) for c in ("s", "d")]
    found = one.select("g", "es", F.arrow_udf(lambda s, d: ring_sizes(s, d, largest), "array<int>")(*ends).alias("rings"))
    rows = found.select("g", F.explode(F.zip_with("es", "rings", lambda e, r: F.struct(e["s"].alias("s"), e["d"].alias("d"), F.when(F.col("g").isNotNull(), r).alias("ring")))).alias("e"))
    return rows.select("g", F.col("e.s").cast(types["s"]).alias("s"), F.col("e.d").cast(types["d"]).alias("d"), F.col("e.ring").alias("ring"))


def ring_sizes(s: pa.Array, d: pa.Array, largest: int) -> pa.Array:
    """The ring sizes of the edges s[i] - d[i] of each graph i, in their order.

    Each edge is taken out in turn and its ends are sought from one another breadth first, the edges of many graphs at once. A
    level keeps only what the two before did not reach and stops at the other end. HELD edges are
    taken out at a time.
    """
    sizes = np.diff(s.offsets.to_numpy())
    ids = pa.concat_arrays([s.flatten(), d.flatten()]).dictionary_encode().indices.to_numpy().astype(np.int64)
    m = len(ids) // 2
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, v = np.unique(np.r_[of, of] * (ids.max(initial=0) + 1) + ids, return_inverse=True)
    a, b, n = v[:m], v[m:], v.max(initial=-1) + 1
    begin, to = np.r_[a, b], np.r_[b, a]
    order = np.argsort(begin, kind="stable")
    to, first = to[order], np.searchsorted(begin[order], np.arange(n + 1))
    rings = np.zeros(m, np.int32)
    for at in range(0, m, HELD):
        e = np.arange(at, min(at + HELD, m))
        seen, before = e * n + a[e], e[:0]
        for level in range(1, largest):
            x = seen % n
            count = first[x + 1] - first[x]
            y = to[np.arange(count.sum()) + np.repeat(first[x] - np.cumsum(count) + count, count)]
            e, x = np.repeat(seen // n, count), np.repeat(x, count)
            step = np.unique((e * n + y)[(x != a[e]) | (y != b[e])])
            step = step[~np.isin(step, seen, assume_unique=True) & ~np.isin(step, before, assume_unique=True)]
            closed = step[step % n == b[step // n]] // n
            rings[closed] = level + 1
            before, seen = seen, step[rings[step // n] == 0]
            if not len(seen):
                break
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(rings, mask=rings == 0))


def vertex_rings(rings: DataFrame) -> DataFrame:
    """(g, v, in_ring, min_ring) of the ends of edges; min_ring is 0 for a vertex on no ring."""
    ends = rings.select("g", F.explode(F.array("s", "d")).alias("v"), "ring")
    return ends.groupBy("g", "v").agg(F.max(F.col("ring").isNotNull()).alias("in_ring"), F.coalesce(F.min("ring"), F.lit(0)).alias("min_ring"))


def graph_rings(rings: DataFrame) -> DataFrame:
    """(g, ring_edges, max_ring): edges on rings, and the largest of the rings that are shortest for some edge (0: none).

    max_ring is the feature of a rule on the size of rings.
    """
    return rings.groupBy("g").agg(F.count("ring").alias("ring_edges"), F.coalesce(F.max("ring"), F.lit(0)).alias("max_ring"))

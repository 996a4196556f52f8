"""Exact nearest neighbours over vector tables, and the tables built from their results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of queries, with their k best, that are broadcast, and that a task holds of more queries than are broadcast.
TILE_BYTES = HELD_BYTES = 32 << 20
#: Rows of a query tile and of a reference tile whose matrix product is taken at once (16 MB of doubles).
QUERY_ROWS, REF_ROWS = 2048, 1024


class Nearest:
    """The k nearest references seen so far of a tile of queries of one length.

    A matrix product of a query tile and a reference tile gives squared distances with a known bound of error; only
    pairs that the bound cannot rule out get their distance from the differences, so equal vectors tie exactly.
    Memory: the queries, k ids and distances for each, and one product of QUERY_ROWS x REF_ROWS.
    """

    def __init__(self, ids: np.ndarray, ks: np.ndarray, vectors: np.ndarray, exclude_self: bool):
        self.ids, self.ks, self.q, self.exclude_self = ids, ks, vectors, exclude_self
        self.k = int(ks.max())
        self.d = np.full((len(ids), self.k), np.inf)
        self.ref: np.ndarray | None = None
        self.norm = np.einsum("ij,ij->i", vectors, vectors)
        self.order = np.argsort(ids, kind="stable")

    def take(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if self.ref is None:
            self.ref = np.empty((len(self.ids), self.k), ids.dtype)
        for a in range(0, len(ids), REF_ROWS):
            self._take(ids[a : a + REF_ROWS], vectors[a : a + REF_ROWS])

    def _take(self, ids: np.ndarray, r: np.ndarray) -> None:
        if ids.dtype.kind in "US" and ids.dtype.itemsize > self.ref.dtype.itemsize:
            self.ref = self.ref.astype(ids.dtype)
        norm = np.einsum("ij,ij->i", r, r)
        if self.exclude_self:  # pairs of equal ids
            own = self.ids[self.order]
            lo, hi = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
            same_q = self.order[np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)]).astype(int)] if (hi > lo).any() else np.zeros(0, int)
            same_r = np.repeat(np.arange(len(ids)), hi - lo)
        for a in range(0, len(self.ids), QUERY_ROWS):
            rows = slice(a, a + QUERY_ROWS)
            q, total = self.q[rows], self.norm[rows, None] + norm
            near = total - 2 * (q @ r.T)
            slack = total * (4e-16 * (q.shape[1] + 10))
            if self.exclude_self:
                own = (same_q >= a) & (same_q < a + QUERY_ROWS)
                near[same_q[own] - a, same_r[own]] = np.inf
            worst = self.d[rows, -1] ** 2
            if np.isinf(worst).any() and near.shape[1] >= self.k:  # not k yet: the k-th of this tile bounds them
                worst = np.minimum(worst, np.partition(near + slack, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero((near - slack <= worst[:, None] * (1 + 1e-12)) & (near < np.inf))
            if len(i):
                self._merge(a, i, ids[j], np.sqrt(np.square(q[i] - r[j]).sum(axis=1)))

    def _merge(self, a: int, i: np.ndarray, ref: np.ndarray, d: np.ndarray) -> None:
        hit = np.unique(i)
        held = np.isfinite(self.d[hit + a])
        i = np.concatenate([np.repeat(hit, held.sum(axis=1)), i])
        d, ref = np.concatenate([self.d[hit + a][held], d]), np.concatenate([self.ref[hit + a][held], ref])
        order = np.lexsort((ref, d, i))
        i, d, ref = i[order], d[order], ref[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < self.k
        self.d[hit + a] = np.inf
        self.d[i[best] + a, rank[best]], self.ref[i[best] + a, rank[best]] = d[best], ref[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, reference ids, k, distances) of what is held."""
        if self.ref is None:
            return self.ids[:0], self.ids[:0], self.ks[:0], np.zeros(0)
        keep = np.isfinite(self.d) & (np.arange(self.k) < self.ks[:, None])
        i, j = np.nonzero(keep)
        return self.ids[i], self.ref[i, j], self.ks[i], self.d[i, j]


def _dense(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, matrix) of the whole vectors of each length; those with a null, NaN or infinite cell go."""
    size = np.diff(vectors.offsets.to_numpy())
    flat, begin = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    names = np.array(ids.to_pylist())
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        m = (flat[begin[at][:, None] + np.arange(n)] if len(at) < len(size) else flat.reshape(-1, n)).astype(np.float64)
        whole = np.isfinite(m).all(axis=1)
        yield at[whole], names[at[whole]], m[whole]


def _search(batches: Iterator[pa.RecordBatch], exclude_self: bool, given: pa.Table | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (tile, part, kind, id, v, k), the queries (kind 0) of a tile and part before its references (kind 1), to the
    nearest pairs (query_id, ref_id, k, distance) of each. given: the only tile's queries, with rows of references alone."""
    tiles: dict[int, list[Nearest]] = {}

    def load(ids: pa.Array, v: pa.Array, k: pa.Array) -> None:
        for at, own, m in _dense(ids, v):
            if len(own):
                tiles.setdefault(m.shape[1], []).append(Nearest(own, k.to_numpy()[at], m, exclude_self))

    def flushed(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for one in [x for found in tiles.values() for x in found]:
            q, r, k, d = one.rows()
            for a in range(0, len(q), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(q[b].tolist(), kind), pa.array(r[b].tolist(), kind), pa.array(k[b], pa.int32()), pa.array(d[b])], ["query_id", "ref_id", "k", "distance"])
        tiles.clear()

    if given is not None:
        t = given.combine_chunks().to_batches()
        for b in t:
            load(b.column("id"), b.column("v"), b.column("k"))
    now, kind = None, None
    for batch in batches:
        kind = batch.schema.field("id").type
        if given is not None:
            parts = [(None, batch)]
        else:
            key = [batch.column(i).to_numpy() for i in range(3)]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in key], axis=0)) + 1
            edges = [0, *cuts.tolist(), len(batch)]
            parts = [(tuple(int(x[a]) for x in key), batch.slice(a, b - a)) for a, b in zip(edges, edges[1:]) if b > a]
        for at, rows in parts:
            if at is not None and at[:2] != now:
                yield from flushed(kind)
                now = at[:2]
            if at is not None and at[2] == 0:
                load(rows.column("id"), rows.column("v"), rows.column("k"))
                continue
            for _, ids, m in _dense(rows.column("id"), rows.column("v")):
                for one in tiles.get(m.shape[1], []):
                    one.take(ids, m)
    if kind is not None:
        yield from flushed(kind)


def _grid(query_bytes: int, ref_bytes: int, slots: int) -> tuple[int, int]:
    """(tiles of the queries, parts of the references) for at least ``slots`` tasks: each tile meets each part in one.

    References are sent once a tile and queries once a part, so both are cut evenly, by the root of the slots where the
    tables are alike. A tile is at most HELD_BYTES; only queries that need more tiles for that send the references oftener.
    """
    even = round((slots * query_bytes / max(1, ref_bytes)) ** 0.5)
    tiles = max(-(-query_bytes // HELD_BYTES), min(even, slots), 1)
    return tiles, -(-slots // tiles)


def knn(queries: DataFrame, refs: DataFrame, id_col: str, vec_col: str, k: int | Column = 10, exclude_self: bool = False, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(query_id, ref_id, rank, distance): the k references nearest to each query by Euclidean distance.

    Ties go to the smaller reference id. ``k`` may be a column of ``queries``. Rows with a null id or vector, a component that is
    null, NaN or infinite, no components, or another length than the query's are no candidates. Queries whose vectors and k best fit
    into ``tile_bytes`` are broadcast and each task takes the references it reads. More queries are cut into tiles and the
    references into parts by a hash (see ``_grid``); a task holds one tile of queries and streams one part past it. Shuffled
    beyond a broadcast: the references times the tiles and the queries times the parts. The numbers of both follow from the
    shuffle partitions, so this grows with the tables until tiles would be over HELD_BYTES; from there on the tiles,
    and with them the copies of the references, grow with the queries. Each task gives k rows a query at most.
    """
    spark = queries.sparkSession
    kcol = (F.lit(k) if isinstance(k, int) else k).cast("int")
    # floats travel as they are and become doubles in the tasks
    single = all(d.schema[vec_col].dataType.simpleString() == "array<float>" for d in (queries, refs))
    v = F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v")
    q = queries.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v, kcol.alias("k")).where("k > 0")
    r = refs.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v)
    kind = queries.schema[id_col].dataType.simpleString()
    out = f"query_id {kind}, ref_id {kind}, k int, distance double"
    size = q.agg(F.sum(F.size("v").cast("long") * 8 + F.col("k") * 24 + 16).alias("b")).first().b or 0
    if size <= tile_bytes:
        held = spark.sparkContext.broadcast(q.toArrow())
        found = r.mapInArrow(lambda batches: _search(batches, exclude_self, held.value), out)
    else:
        ref_size = r.agg(F.sum(F.size("v").cast("long") * 8).alias("b")).first().b or 0
        tiles, parts = _grid(size, ref_size, int(spark.conf.get("spark.sql.shuffle.partitions")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        left = q.select(deal(tiles).alias("tile"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "v", "k")
        right = r.select(every(tiles).alias("tile"), deal(parts).alias("part"), F.lit(1).alias("kind"), "id", "v", F.lit(0).alias("k"))
        cell = (F.col("tile") * parts + F.col("part")).cast("int")
        dealt = left.unionByName(right).repartitionById(tiles * parts, cell).sortWithinPartitions("tile", "part", "kind")
        found = dealt.mapInArrow(lambda batches: _search(batches, exclude_self), out)
    w = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return found.withColumn("rank", F.row_number().over(w)).where("rank <= k").select("query_id", "ref_id", "rank", "distance")


def distinct_neighbors(found: DataFrame, key: str | Column = "ref_id") -> DataFrame:
    """One row a neighbour: the queries that found it in rank order, their number, best rank and distance."""
    q = F.sort_array(F.collect_list(F.struct("rank", "query_id")))
    out = found.groupBy((F.col(key) if isinstance(key, str) else key).alias("ref_id")).agg(
        F.array_distinct(F.transform(q, lambda x: x["query_id"])).alias("queries"), F.count_distinct("query_id").alias("n_queries"), F.min("rank").alias("best_rank"), F.min("distance").alias("best_distance")
    )
    return out


def nested(found: DataFrame) -> DataFrame:
    """One row a query with its neighbours by rank."""
    return found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "ref_id", "distance"))).alias("neighbors"))


def wide_vectors(df: DataFrame, prefix: str, n: int, name: str = "embedding", zero_fill: bool = False) -> DataFrame:
    """Text columns prefix0.. as one array<float>; null where any cell is blank, unless blanks count as 0."""
    cells = [F.expr(f"try_cast(`{prefix}{i}` as float)") for i in range(n)]
    if zero_fill:
        return df.withColumn(name, F.array(*(F.coalesce(c, F.lit(0.0).cast("float")) for c in cells))).drop(*(f"{prefix}{i}" for i in range(n)))
    a = F.array(*cells)
    return df.withColumn(name, F.when(~F.exists(a, lambda x: x.isNull()), a)).drop(*(f"{prefix}{i}" for i in range(n)))

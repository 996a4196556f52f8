"""Pattern graphs found in graphs: small labelled patterns grown along the edges of vertex and edge tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = tuple[str, tuple[tuple[int, object], ...]]


@dataclass(frozen=True)
class Pattern:
    """A connected graph: the label of each vertex, and edges (a, b, kind) between places; kind None fits any edge."""

    name: str
    labels: tuple[str, ...]
    edges: tuple[tuple[int, int, object], ...] = ()

    def steps(self, counts: dict[str, int]) -> tuple[Step, ...]:
        """The order of steps: from the rarest label on, always a neighbour of what is placed, most links and rarest
        label first. Each step is a label and its links (earlier step, kind)."""
        rare = lambda i: (counts.get(self.labels[i], 0), self.labels[i], i)
        links = lambda i: [(a if b == i else b, k) for a, b, k in self.edges if i in (a, b)]
        placed = [min(range(len(self.labels)), key=rare)]
        out: list[Step] = [(self.labels[placed[0]], ())]
        while len(placed) < len(self.labels):
            ready = [i for i in range(len(self.labels)) if i not in placed and any(j in placed for j, _ in links(i))]
            if not ready:
                raise ValueError(f"{self.name}: the pattern is not connected")
            new = min(ready, key=lambda i: (-sum(j in placed for j, _ in links(i)), *rare(i)))
            out.append((self.labels[new], tuple(sorted(((placed.index(j), k) for j, k in links(new) if j in placed), key=lambda x: (x[0], str(x[1]))))))
            placed.append(new)
        return tuple(out)


def pattern_matches(vertices: DataFrame, edges: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(g, pattern, pattern_row, size, atoms): the sets of vertices on which a pattern lies, each set once a pattern.

    vertices (g, v, label), edges (g, s, d, kind) in one direction or both. The vertices of a pattern go to different
    vertices. Labels are counted once to start patterns at rare ones. A graph's vertices and edges are brought together once (a
    molecule is a row) and patterns grow there, a vertex a step; what patterns have in common from their starts on is
    grown once. Only the counts of the patterns' own labels reach the driver.
    """
    used = sorted({x for p in patterns for x in p.labels})
    own = vertices.where(F.col("label").isin(*used))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    plans = [p.steps(counts) for p in patterns]
    kinds = list({k: None for p in patterns for *_, k in p.edges if k is not None})
    code = lambda c, values: F.coalesce(*(F.when(c == x, i) for i, x in enumerate(values)), F.lit(-1))
    vs = own.groupBy("g").agg(F.collect_set(F.struct("v", code(F.col("label"), used).alias("label"))).alias("vs"))
    both = edges.where("s <> d").select("g", F.explode(F.array(F.struct("s", "d", "kind"), F.struct(F.col("d").alias("s"), F.col("s").alias("d"), "kind"))).alias("e"))
    es = both.groupBy("g").agg(F.collect_set(F.struct("e.s", "e.d", code(F.col("e.kind"), kinds).alias("kind"))).alias("es"))
    coded = [tuple((used.index(label), tuple((i, None if k is None else kinds.index(k)) for i, k in links)) for label, links in plan) for plan in plans]
    places = F.arrow_udf(lambda *x: pattern_places(*x, coded), "array<struct<row: int, at: array<int>>>")
    part = lambda c, name: F.transform(F.coalesce(c, F.array()), lambda x: x[name])
    out = vs.join(es, "g", "left").select("g", "vs", places(part("vs", "v"), part("vs", "label"), part("es", "s"), part("es", "d"), part("es", "kind")).alias("ms"))
    sets = F.transform("ms", lambda m: F.struct(m["row"].alias("row"), F.array_sort(F.transform(m["at"], lambda i: F.get(F.transform("vs", lambda x: x["v"]), i))).alias("atoms")))
    name = F.get(F.array(*(F.lit(p.name) for p in patterns)), F.col("m.row"))
    return out.select("g", F.explode(sets).alias("m")).select("g", name.alias("pattern"), F.col("m.row").alias("pattern_row"), F.size("m.atoms").alias("size"), "m.atoms")


def pattern_places(v: pa.Array, label: pa.Array, s: pa.Array, d: pa.Array, kind: pa.Array, plans: list[tuple[Step, ...]]) -> pa.Array:
    """For each graph the (row of the plan, places in v) on which the plans lie, each set of vertices once a plan.

    v[i] and label[i] are a graph's vertices, s[i], d[i] and kind[i] its edges, both ways. Partial matches of many graphs grow together, a
    step of the plans at a time, by the edges from a placed vertex.
    """
    of = lambda x: np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    ids = pa.concat_arrays([x.flatten() for x in (v, s, d)]).dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    _, key = np.unique(np.r_[of(v), of(s), of(d)] * (ids.max(initial=0) + 1) + ids, return_inverse=True)
    n, m, size = len(v.flatten()), len(s.flatten()), key.max(initial=-1) + 1
    own, labels, kinds = key[:n], label.flatten().to_numpy(), kind.flatten().to_numpy()
    order = np.argsort(own, kind="stable")

    def reached(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of at, row of the sorted keys) where they are equal."""
        low = np.searchsorted(keys, at)
        count = np.searchsorted(keys, at, "right") - low
        return np.repeat(np.arange(len(at)), count), np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)

    e, w = reached(key[n + m :], own[order])  # edges to vertices with their labels
    begin, end, kinds, to = key[n : n + m][e], key[n + m :][e], kinds[e], labels[order][w]
    sort = np.argsort(begin, kind="stable")
    begin, end, kinds, to = (x[sort] for x in (begin, end, kinds, to))
    made: dict[tuple[Step, ...], np.ndarray] = {}

    def partial(plan: tuple[Step, ...]) -> np.ndarray:
        if plan not in made:
            name, links = plan[-1]
            if len(plan) == 1:
                made[plan] = np.unique(own[labels == name])[:, None]
            else:
                before = partial(plan[:-1])
                (i, k), *others = links
                row, e = reached(before[:, i], begin)
                fit = (to[e] == name) & ((kinds[e] == k) if k is not None else True) & (before[row] != end[e][:, None]).all(axis=1)
                row, e = row[fit], e[fit]
                for i, k in others:
                    fit = np.isin(before[row, i] * size + end[e], (begin * size + end)[(kinds == k) if k is not None else slice(None)])
                    row, e = row[fit], e[fit]
                made[plan] = np.c_[before[row], end[e]]
        return made[plan]

    graph, rows, at = [], [], []
    where = np.zeros(size, np.int64)
    where[own] = np.arange(n) - np.repeat(v.offsets.to_numpy()[:-1] - v.offsets[0].as_py(), np.diff(v.offsets.to_numpy()))
    home = np.zeros(size, np.int64)
    home[own] = of(v)
    for row, plan in enumerate(plans):
        found = np.unique(np.sort(partial(plan), axis=1), axis=0)
        graph.append(home[found[:, 0]])
        rows.append(np.full(len(found), row))
        at += where[found].tolist()
    graph, rows = np.concatenate(graph), np.concatenate(rows)
    sort = np.argsort(graph, kind="stable")
    lists = pa.array(at, pa.list_(pa.int32())).take(pa.array(sort))
    one = pa.StructArray.from_arrays([pa.array(rows[sort].astype(np.int32)), lists], ["row", "at"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(graph[sort], np.arange(len(v) + 1)).astype(np.int32)), one)


def hits(matches: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(cid, atom, label, match_size, pattern_length, pattern_row) for ``best_label``: a row for each vertex of a match; a
    pattern is as long as it has vertices and edges."""
    length = F.create_map(*(F.lit(x) for row, p in enumerate(patterns) for x in (row, len(p.labels) + len(p.edges))))
    return matches.select(
        F.col("g").alias("cid"), F.explode("atoms").alias("atom"), F.col("pattern").alias("label"), F.col("size").alias("match_size"), length[F.col("pattern_row")].alias("pattern_length"), "pattern_row"
    )


def groups_of(matches: DataFrame) -> DataFrame:
    """(g, groups): the names of the patterns that a graph holds."""
    return matches.groupBy("g").agg(F.array_sort(F.collect_set("pattern")).alias("groups"))

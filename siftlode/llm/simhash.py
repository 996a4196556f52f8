"""SimHash fingerprints and the links between those that differ in few bits.

Links are found by a generalised pigeonhole: bits that vary together form partitions, a dynamic program
gives each partition its own threshold from the candidate counts it would cost, every fingerprint is filed
under its partition value and the values within the threshold, and fingerprints that meet in a bucket are
compared in full. With thresholds t_i, sum(t_i + 1) = tau + 1, no pair within tau bits is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.components import components
from siftlode.llm.shared import sorted_groups, tasks, written

#: Shingles whose bits are unpacked at a time; bounds memory on very long texts.
BLOCK = 32768
#: Fingerprints of a bucket that one task compares. Larger buckets take another way.
BUCKET = 128


def _hashes(words: list[bytes], shingle: int, seed: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    parts = zip(*(words[i:] for i in range(shingle))) if shingle > 1 else ((w,) for w in words)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(seed)), np.uint64, len(words) - shingle + 1)


def _majority(h: np.ndarray) -> int:
    """The bits, as a signed 64-bit number, that over half the hashes have; 0 for none."""
    if not len(h):
        return 0
    count = np.zeros(64, np.int64)
    raw = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), BLOCK):
        count += np.unpackbits(raw[i : i + BLOCK], axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(h)).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """One signed 64-bit lane for each seed, over the text's lower-cased (A-Z) word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return [0] * len(seeds)
    h = _hashes(words, shingle, seeds[0])
    lanes = [_majority(h)]
    for s in seeds[1:]:  # further lanes remix the first hash: a multiply and two shifts in numpy
        x = (h ^ np.uint64(s * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        lanes.append(_majority(x ^ (x >> np.uint64(32))))
    return lanes


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, f0, f1, ...): the lanes of every row. A null or wordless text has zero lanes."""
    lanes = [f"f{i}" for i in range(len(seeds))]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.array([fingerprint(t, shingle, seeds) for t in pdf["t"]], np.int64).reshape(len(pdf), len(lanes))
            yield pd.DataFrame({"id": pdf["id"]} | {c: out[:, i] for i, c in enumerate(lanes)})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInPandas(each, "id long, " + ", ".join(f"{c} long" for c in lanes))


def signed(x: int) -> int:
    """A 64-bit pattern as Spark's long."""
    return x - 2**64 if x >= 2**63 else x


@dataclass(frozen=True)
class Plan:
    """Partitions of the bits (bit numbers over all lanes) and their thresholds; -1 leaves a partition out."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def bit_statistics(fps: DataFrame, lanes: int) -> tuple[int, np.ndarray]:
    """How many distinct fingerprints there are, and in how many of them bits i and j are both set."""
    width = 64 * lanes
    cols = [f"f{i}" for i in range(lanes)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((width, width))
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                x = np.unpackbits(pdf[cols].iloc[i : i + 4096].to_numpy(np.int64).astype(">i8", order="C").view(np.uint8).reshape(-1, 8 * lanes), axis=1).astype(np.float32)
                both += x.T @ x
                n += len(x)
        if n:
            yield pd.DataFrame({"i": [-1, *range(width)], "v": [[float(n)] * width, *both.tolist()]})

    summed = fps.mapInPandas(each, "i int, v array<double>").selectExpr("i", "posexplode(v) as (j, x)").groupBy("i", "j").agg(F.sum("x").alias("x"))
    both, n = np.zeros((width, width)), 0
    table = summed.toArrow()  # (width + 1) * width numbers, whatever the corpus; as rows they would take tens of MB of the driver
    i, j, x = (table.column(c).to_numpy() for c in ("i", "j", "x"))
    both[i[i >= 0], j[i >= 0]] = x[i >= 0]
    if (i < 0).any():
        n = int(x[i < 0][0])
    return n, both


def grouped_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near-equal width; each grows by the bit that correlates most with its own."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, parts = np.ones(len(p), bool), []
    for k in range(m):
        size = round(len(p) * (k + 1) / m) - round(len(p) * k / m)
        tied = corr[:, left].sum(axis=1)
        part: list[int] = []
        while len(part) < size:
            best = int(np.argmax(np.where(left, tied, -1)))
            tied = corr[best].copy() if not part else tied + corr[best]
            part.append(best)
            left[best] = False
        parts.append(part)
    return parts


def radius(threshold: int) -> int:
    """Flips within which a row is filed: both rows of a pair are, so two rows meet at up to twice as many."""
    return (threshold + 1) // 2


def distance_law(part: list[int], n: int, both: np.ndarray, most: int) -> np.ndarray:
    """P(two random fingerprints differ in exactly d bits of the partition), d = 0..most, as a chain over its bits."""
    p = np.diag(both) / max(n, 1)

    def agree(i: int, j: int) -> tuple[float, float, float]:
        q11 = both[i, j] / max(n, 1)
        q10, q01 = p[i] - q11, p[j] - q11
        both_agree = q11**2 + q10**2 + q01**2 + (1 - q11 - q10 - q01) ** 2
        return both_agree, p[i] ** 2 + (1 - p[i]) ** 2, p[j] ** 2 + (1 - p[j]) ** 2

    state = np.zeros((2, most + 2))  # [the last bit agrees, differs][differing bits so far]
    first = p[part[0]] ** 2 + (1 - p[part[0]]) ** 2
    state[0, 0], state[1, 1] = first, 1 - first
    for i, j in zip(part, part[1:]):
        aa, ai, aj = agree(i, j)
        stay = min(1.0, aa / max(ai, 1e-12))
        back = min(1.0, max(0.0, (aj - aa) / max(1 - ai, 1e-12)))
        new = np.zeros_like(state)
        new[0] = state[0] * stay + state[1] * back
        new[1, 1:] = state[0, :-1] * (1 - stay) + state[1, :-1] * (1 - back)
        state = new
    return state.sum(axis=0)[: most + 1]


def allocate(n: int, both: np.ndarray, tau: int, partitions: tuple[int, ...], most: int = 2, probe_cost: float = 1.0) -> Plan:
    """The cheapest partitions and thresholds with sum(t + 1) = tau + 1.

    A partition's cost is the rows that file each fingerprint within the radius of the threshold, times
    ``probe_cost``, plus the pairs expected to meet.
    """
    best: Plan | None = None
    for m in partitions:
        parts = grouped_bits(n, both, m)
        price = []
        for part in parts:
            law, row = distance_law(part, n, both, most), [0.0]
            for t in range(most + 1):
                rows = sum(comb(len(part), r) for r in range(radius(t) + 1))
                row.append(probe_cost * n * rows + law[: t + 1].sum() * n * n / 2)
            price.append(row)
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for row in price:
            table = {
                u: min((c + row[k], ts + (k - 1,)) for v, (c, ts) in table.items() for k in range(most + 2) if v + k == u)
                for u in {v + k for v in table for k in range(most + 2) if v + k <= tau + 1}
            }
        if tau + 1 in table and (best is None or table[tau + 1][0] < best.cost):
            best = Plan(tuple(map(tuple, parts)), table[tau + 1][1], table[tau + 1][0])
    if best is None:
        raise ValueError(f"no allocation reaches {tau} bits")
    return best


def masks(part: tuple[int, ...], lanes: int) -> list[int]:
    """The bits of a partition in each lane."""
    out = [0] * lanes
    for b in part:
        out[b // 64] |= 1 << (63 - b % 64)
    return out


def filed(fps: DataFrame, plan: Plan, lanes: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(p, key, flip, f0, ..., kept columns): a row for each value of a partition within the radius of a row's own.

    flip is 0 for the own value and else numbers the flipped bits, fewer first.
    """
    out, cols = None, [f"f{i}" for i in range(lanes)]
    for p, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        if t < 0:
            continue
        mask = masks(part, lanes)
        keys = [F.col(c).bitwiseAND(F.lit(signed(m)).cast("long")) for c, m in zip(cols, mask)]
        flips = [masks(bits, lanes) for r in range(radius(t) + 1) for bits in combinations(part, r)]
        rows = fps
        if len(flips) > 1:
            flipped = F.array(*(F.array(*(F.lit(signed(v)).cast("long") for v in f)) for f in flips))
            rows = rows.select("*", F.posexplode(flipped).alias("flip", "x"))
            keys = [k.bitwiseXOR(F.col("x")[i]) for i, k in enumerate(keys)]
        else:
            rows = rows.withColumn("flip", F.lit(0))
        # the lanes a partition touches make one key; a clash only adds pairs that the full comparison rejects
        used = [k for k, m in zip(keys, mask) if m]
        rows = rows.withColumn("key", used[0] if len(used) == 1 else F.xxhash64(*used)).select(F.lit(p).alias("p"), "key", "flip", *cols, *keep)
        out = rows if out is None else out.unionAll(rows)
    return out


def _forest(f: np.ndarray, tau: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (row, row) that join what is within tau bits: each row is reached once, so at most len(f) - 1.

    With ``left`` (a flag for each row), only pairs of one left and one right row count.
    """
    links, rest = [], np.arange(len(f))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(f[rest] ^ f[x]).sum(axis=1) <= tau
            if left is not None:
                near &= left[rest] != left[x]
            if near.any():
                links += [(int(x), int(y)) for y in rest[near]]
                queue += rest[near].tolist()
                rest = rest[~near]
    return links


def links(fps: DataFrame, tau: int, plan: Plan, lanes: int = 1) -> DataFrame:
    """(a0.., b0..): links that connect all distinct fingerprints within tau bits, at most one a row and bucket.

    fps: distinct lanes. Buckets of one row are dropped. Those over BUCKET rows never meet in one task: for
    two bits or fewer their rows are filed anew under themselves and their 64 neighbours, which bounds every
    group by 65; for more bits they are cut into blocks, and each pair of blocks is a group of its own.
    Either way no pair is lost.
    """
    cols = [f"f{i}" for i in range(lanes)]
    rows = filed(fps, plan, lanes).drop("flip")
    sizes = rows.groupBy("p", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(sizes, ["p", "key"]), "buckets")
    small = met.where(F.col("n") <= BUCKET).select("p", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), *cols)
    large = met.where(F.col("n") > BUCKET)
    if lanes == 1 and tau <= 2:
        # two fingerprints within two bits are both within one bit of some value: at most 65 share it
        flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << b)).cast("long") for b in range(64)))
        near = large.select(*cols).distinct().withColumn("x", F.explode(flips)).withColumn("key", F.col("f0").bitwiseXOR(F.col("x")))
        large = near.select(F.lit(-1).alias("p"), "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), *cols)
    else:
        large = large.withColumn("k", F.ceil(F.col("n") / BUCKET).cast("int"))
        large = large.withColumn("own", F.pmod(F.xxhash64(*cols), F.col("k")).cast("int"))
        pairs = F.expr("transform(sequence(0, k - 1), j -> struct(least(own, j) as i, greatest(own, j) as j))")
        large = large.withColumn("g", F.explode(pairs)).select("p", "key", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "own", *cols)
    met = small.unionAll(large)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        for g in sorted_groups(batches, ["p", "key", "i", "j"]):
            f = g[cols].to_numpy(np.int64).view(np.uint64)
            across = g["own"].to_numpy() == g["i"].iloc[0] if g["i"].iloc[0] != g["j"].iloc[0] else None
            if e := _forest(f, tau, across):
                e = np.array(e)
                found.append(np.hstack([f[e[:, 0]], f[e[:, 1]]]).view(np.int64))
            if len(found) > 2000:
                yield pd.DataFrame(np.vstack(found), columns=names)
                found = []
        if found:
            yield pd.DataFrame(np.vstack(found), columns=names)

    names = [f"a{i}" for i in range(lanes)] + [f"b{i}" for i in range(lanes)]
    return met.repartition(tasks(fps.sparkSession), "p", "key", "i", "j").sortWithinPartitions("p", "key", "i", "j").mapInPandas(each, ", ".join(f"{c} long" for c in names))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2, partitions: tuple[int, ...] = (1, 2, 3, 4)
) -> DataFrame:
    """(id, f0, component_id): every row's fingerprint and the smallest id reachable over links of at most tau bits.

    Null and wordless texts have fingerprint 0 and link like any other. Rows with one id each keep a row. A
    null id keeps its row and never names a component unless all ids there are null. An empty table gives an
    empty result. Other columns are not read.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("f0").agg(F.min("id").alias("least")), "distinct")
    n, both = bit_statistics(distinct, 1)
    if n < 2:
        return rows.join(distinct, "f0").select("id", "f0", F.col("least").alias("component_id"))
    found = links(distinct.select("f0"), tau, allocate(n, both, tau, partitions))
    label = components(found, "a0", "b0").withColumnRenamed("node", "f0")
    named = distinct.join(label, "f0", "left").withColumn("label", F.coalesce("label", "f0"))
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = named.join(least, "label").select("f0", "component_id")
    return rows.join(named, "f0").select("id", "f0", "component_id")


def op1_simhash(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``."""
    g = simhash_groups(docs)
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")

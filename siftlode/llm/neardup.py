"""Near-duplicate documents: SimHash candidates by a generalised pigeonhole, verified on the shingles themselves.

Each set of five-word shingles gets a fingerprint of four SimHash lanes. Bits that vary together form partitions
and a dynamic program allots unequal thresholds (``simhash.allocate``), so that no pair within TAU bits is missed.
TAU lies two standard deviations below the distance expected of sets of the similarity; pairs further apart meet
in some partition nearly always (the README has the measured recall). What meets is compared by all bits, and
what these leave is verified by the Jaccard similarity of the two whole texts, so nothing below it is linked.

A group of copies of any size costs links in proportion to its rows. Every row first meets one centre of each of
its values, the text with the most exact copies, and is verified against the nearest. Rows that are still in
different classes then meet in the buckets: all of them in small buckets, and in large ones each row outside the
largest class with its nearest neighbour. Only where that fails is such a row compared with the whole bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import acos, pi, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.components import components
from siftlode.llm.shared import batches_of, tasks, unused, written
from siftlode.llm.simhash import Plan, _hashes, _majority, allocate, bit_statistics, filed, masks

#: Words of a shingle and the Jaccard similarity of near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Seeds of the lanes after the first, which is the shingle hash itself.
SEEDS = (7, 11, 13, 17)
LANES = len(SEEDS)
#: Partitions that the allocation may choose; how many compared pairs cost as much as a filed row; rows filed at a time.
PARTITIONS, ROW_COST, FILED = tuple(range(10, 21)), 300.0, 64
#: Rows of a bucket all pairs of which are compared (a few times the rows that ROW_COST makes usual); members that are verified
#: against a text in one task.
BUCKET, MEMBERS = 1024, 256
#: Labels that an unsettled row names, so that its bucket can be closed once they are its own; with more it stays open.
NAMED = 16
#: 64-bit words of parity bits of a set, which rule pairs of large buckets out.
BITS = 8
_EPS = 1e-9
COLS, ODD = [f"f{i}" for i in range(LANES)], [f"b{i}" for i in range(BITS)]


def bits_apart(similarity: float, deviations: float) -> int:
    """Differing bits of two fingerprints of that similarity: the mean and so many standard deviations more.

    Sets of Jaccard similarity s have a cosine of 2s / (1 + s) at least, and a bit differs with angle / pi.
    """
    p, n = acos(2 * similarity / (1 + similarity)) / pi, 64 * LANES
    return int(n * p + deviations * sqrt(n * p * (1 - p)))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of lower-cased (A-Z) words; fewer words are one shingle."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.unique(_hashes(w, SHINGLE, SEEDS[0]))


def lanes_of(h: np.ndarray) -> list[int]:
    """The SimHash lanes of a set of shingles; those after the first remix its hashes."""
    out = [_majority(h)]
    for s in SEEDS[1:]:
        x = (h ^ np.uint64(s * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(32))))
    return out


def parity(h: np.ndarray) -> np.ndarray:
    """Bit h mod 64 BITS is how many of the hashes fall on it, mod 2: two sets differ in as many elements at least."""
    odd = np.bincount((h % np.uint64(64 * BITS)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _fingerprinted(src: DataFrame) -> DataFrame:
    """(id, tx, f, n, f0, ...): f names the set of shingles (or, of a wordless text, the text), n is its size."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t) for t in pdf["t"]]
            out = {"id": pdf["id"], "tx": pdf["tx"], "f": [xxhash.xxh64_intdigest(h.tobytes()) - 2**63 if len(h) else x for h, x in zip(sets, pdf["tx"])], "n": [len(h) for h in sets]}
            lanes = np.array([lanes_of(h) for h in sets], np.int64).reshape(len(pdf), LANES)
            bits = np.array([parity(h) for h in sets], np.int64).reshape(len(pdf), BITS)
            yield pd.DataFrame(out | {f"f{i}": lanes[:, i] for i in range(LANES)} | {f"b{i}": bits[:, i] for i in range(BITS)})

    return src.mapInPandas(each, "id long, tx long, f long, n int, " + ", ".join(f"{c} long" for c in (*COLS, *ODD)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, tx, component_id): every row's class, named by its smallest id; tx is a hash of the text.

    Classes are connected by pairs of the similarity. Equal texts, and then equal sets of shingles, are one
    before anything is compared. Wordless and null texts are one class only with their own equals: they have no
    words to compare. Null ids count as larger than any. An empty table gives an empty result. Other columns
    are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tx"), text.alias("t"))
    rows = written(_fingerprinted(src), "shingles")
    worded = rows.where("n > 0").groupBy("f").agg(F.count("*").alias("copies"), F.min("tx").alias("tx"), *(F.first(c).alias(c) for c in ("n", *COLS, *ODD)))
    classes = written(worded, "classes")
    n, both = bit_statistics(classes.select(*COLS), LANES)
    label = classes.select("f", F.col("f").alias("label")).limit(0)
    if n > 1:
        plan = allocate(n, both, bits_apart(similarity, -2), PARTITIONS, most=4, probe_cost=ROW_COST)
        most = bits_apart(similarity, 3)
        check = lambda pairs: _similar(pairs, classes, src, similarity)
        links = check(_stars(classes, plan, most))
        label = components(links, "a", "b").withColumnRenamed("node", "f")
        met, open_ = _met(classes, label, plan, most, similarity)
        links = links.unionAll(check(met))
        label = components(links, "a", "b").withColumnRenamed("node", "f")
        buckets = _still_open(open_, label)
        if not buckets.isEmpty():
            links = links.unionAll(check(_met(classes, label, plan, most, similarity, buckets)[0]))
            label = components(links, "a", "b").withColumnRenamed("node", "f")
    distinct = rows.groupBy("f").agg(F.min("id").alias("least")).join(label, "f", "left").withColumn("label", F.coalesce("label", "f"))
    least = written(distinct.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = distinct.select("f", "label").join(least, "label").select("f", "component_id")
    return rows.select("id", "tx", "f").join(named, "f").select("id", "tx", "component_id")


def _apart(a: list, b: list):
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))


def _stars(classes: DataFrame, plan: Plan, most: int) -> DataFrame:
    """(a, b): each class b with the nearest of the centres of its own partition values, if within ``most`` bits."""
    own = filed(classes, Plan(plan.parts, (0,) * len(plan.parts), 0.0), LANES, ("f", "copies")).drop("flip")
    centre = own.groupBy("p", "key").agg(F.max(F.struct("copies", "f", *COLS)).alias("c"), F.count("*").alias("m")).where("m > 1").drop("m")
    near = own.join(centre, ["p", "key"]).where(F.col("f") != F.col("c.f"))
    near = near.withColumn("d", _apart([F.col(c) for c in COLS], [F.col("c." + c) for c in COLS])).where(F.col("d") <= most)
    return near.groupBy(F.col("f").alias("b")).agg(F.min(F.struct("d", "c.f")).alias("m")).select(F.col("m.f").alias("a"), "b")


def _met(classes: DataFrame, label: DataFrame, plan: Plan, most: int, similarity: float, buckets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((a, b), unsettled rows (p, key, x, others)): classes of different labels that meet in a bucket within ``most`` bits.

    Of buckets over BUCKET rows, each row outside the largest label comes with its nearest only; where it had
    more to choose from it is unsettled, and others are their labels (none if over NAMED). ``buckets``: open ones, of which all pairs are given, less those whose
    sizes and parity bits rule the similarity out; only their rows are shuffled again.
    """
    spark, rest = classes.sparkSession, buckets is not None
    keep = ("n", *ODD) if rest else ()
    held = written(classes.select("f", *COLS, *keep).join(label, "f", "left").withColumn("label", F.coalesce("label", "f")), "labelled")
    earlier = [np.array(masks(part, LANES), np.uint64) for part in plan.parts]
    reach = plan.thresholds

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _whole(batches):
            p, key, flip, f, lab = (g[c].to_numpy() for c in ("p", "key", "flip", "f", "label"))
            bits = g[COLS].to_numpy(np.int64).view(np.uint64)
            n, odd = (g["n"].to_numpy(), g[ODD].to_numpy(np.int64).view(np.uint64)) if rest else (None, None)

            def ruled_out(x: int, y: np.ndarray) -> np.ndarray:
                return np.bitwise_count(odd[y] ^ odd[x]).sum(axis=1) > (n[y] + n[x]) * ((1 - similarity) / (1 + similarity)) + _EPS

            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0)) + 1
            start, end = np.r_[0, new], np.r_[new, len(g)]
            found = [_large(lab, bits, s, e, most, ruled_out if rest else None) for s, e in zip(start, end) if e - s > BUCKET and (lab[s:e] != lab[s]).any()]
            if not rest:
                found.append(_small(start, end, lab, bits, most))
            if not found:
                continue
            i, j, others, alone = (np.concatenate(x) for x in zip(*found))
            at = i
            swap = f[i] > f[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            once = (flip[i] < flip[j]) | ((flip[i] == 0) & (flip[j] == 0))  # a pair meets under more values
            for q, m in enumerate(earlier):  # and in more partitions; its first one counts
                once &= (p[i] <= q) | (np.bitwise_count((bits[i] ^ bits[j]) & m).sum(axis=1) > reach[q])
            once |= alone
            if once.any():
                yield pd.DataFrame({"a": f[i[once]], "b": f[j[once]], "p": p[at[once]], "key": key[at[once]], "x": f[at[once]], "others": others[once]})

    out, got = None, None
    for parts in _dealt(plan):
        some = Plan(plan.parts, tuple(t if q in parts else -1 for q, t in enumerate(plan.thresholds)), 0.0)
        met = filed(held, some, LANES, ("f", "label", *keep))
        if rest:
            met = met.join(buckets, ["p", "key"], "left_semi")
        met = met.repartition(tasks(spark), "p", "key").sortWithinPartitions("p", "key")
        got = written(met.mapInPandas(each, "a long, b long, p int, key long, x long, others array<long>"), "met")
        out = got if out is None else out.unionAll(got)
    return out.select("a", "b").distinct(), out.where("others is not null").select("p", "key", "x", "others")


def _still_open(unsettled: DataFrame, label: DataFrame) -> DataFrame:
    """The buckets (p, key) of rows x that have another label than one of those they could have met."""
    name = lambda c: label.select(F.col("f").alias(c), F.col("label").alias(c + "_label"))
    met = unsettled.select("p", "key", "x", F.explode_outer("others").alias("other")).join(name("x"), "x", "left").join(name("other"), "other", "left")
    apart = F.coalesce("x_label", "x") != F.coalesce("other_label", "other")
    return written(met.where(F.col("other").isNull() | apart).select("p", "key").distinct(), "open")


def _dealt(plan: Plan) -> list[set[int]]:
    """The partitions in groups that file about FILED rows of a fingerprint each."""
    groups: list[set[int]] = [set()]
    size = 0
    for q, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        if t >= 0:
            rows = 1 if t == 0 else 1 + len(part) ** ((t + 1) // 2)
            if groups[-1] and size + rows > FILED:
                groups, size = [*groups, set()], 0
            groups[-1].add(q)
            size += rows
    return groups


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of many whole buckets out of a stream sorted by (p, key)."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = (pdf["p"].to_numpy() == pdf["p"].iloc[-1]) & (pdf["key"].to_numpy() == pdf["key"].iloc[-1])
        cut = len(pdf) - int(last.sum())
        if cut or (held and (held[-1]["p"].iloc[-1] != pdf["p"].iloc[0] or held[-1]["key"].iloc[-1] != pdf["key"].iloc[0])):
            whole = pd.concat([*held, pdf.iloc[:cut]])
            if len(whole):
                yield whole
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held)


def _small(start: np.ndarray, end: np.ndarray, label: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(i, j, others, alone): rows of one bucket of BUCKET rows or fewer, with different labels, within ``most`` bits."""
    size = end - start
    stop = np.repeat(np.where(size <= BUCKET, end, 0), size)
    i, d, found = np.arange(len(label)), 1, []
    while len(i := i[i + d < stop[i]]):
        x = i[label[i] != label[i + d]]
        x = x[np.bitwise_count(bits[x, :2] ^ bits[x + d, :2]).sum(axis=1) <= most]  # half of the lanes rules most out
        x = x[np.bitwise_count(bits[x] ^ bits[x + d]).sum(axis=1) <= most]
        found.append(np.stack([x, x + d]))
        d += 1
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return i, j, np.full(len(i), None, object), np.zeros(len(i), bool)


def _large(label: np.ndarray, bits: np.ndarray, s: int, e: int, most: int, ruled_out: Callable | None) -> tuple[np.ndarray, ...]:
    """(i, j, settled, alone) of a large bucket: rows outside the largest label, each with the nearest of another
    label (which stands alone: another bucket need not have it), or with all that are not ruled out."""
    lab, b = label[s:e], bits[s:e]
    names, number, count = np.unique(lab, return_inverse=True, return_counts=True)
    outside = number != np.argmax(count)
    i, j, others = [], [], []
    for x in np.flatnonzero(outside):
        d = np.bitwise_count(b ^ b[x]).sum(axis=1).astype(np.int64)
        at = np.flatnonzero((lab != lab[x]) & (d <= most))
        if not len(at):
            continue
        if not ruled_out:
            near = np.unique(lab[at]) if len(at) > 1 else None
            others.append(near if near is None else near.tolist() if len(near) <= NAMED else [])
        if ruled_out:
            at = at[~outside[at] | (at > x)]
            at = at[~ruled_out(s + x, s + at)]
        else:
            at = at[[np.argmin(d[at])]]
        i.append(np.full(len(at), s + x))
        j.append(s + at)
    none = [np.zeros(0, np.int64)]
    i, j = np.concatenate(i or none), np.concatenate(j or none)
    said = np.full(len(i), None, object)
    for x, near in enumerate(others):
        said[x] = near
    return i, j, said, np.full(len(i), not ruled_out)


def _similar(pairs: DataFrame, classes: DataFrame, src: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity, by all shingles of both.

    Each text travels once a pair, to a task that holds the other text: the one with more pairs, and that is
    sent to one task for every MEMBERS of them.
    """
    spark = pairs.sparkSession
    pairs = written(pairs, "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("f")).groupBy("f").agg(F.count("*").alias("m"))
    used = written(used.join(classes.select("f", "tx"), "f"), "used")
    texts = written(src.select("tx", "t").join(used.select("f", "tx"), "tx").groupBy("f").agg(F.first("t").alias("t")), "texts")
    m = used.select("f", "m")
    pairs = pairs.join(m.toDF("a", "am"), "a").join(m.toDF("b", "bm"), "b")
    turned = F.col("bm") > F.col("am")
    pairs = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("am", "bm").alias("m"))
    pairs = pairs.withColumn("k", F.ceil(F.col("m") / MEMBERS).cast("int"))
    members = pairs.join(texts.toDF("b", "t"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("s"), F.lit(1).alias("member"), "b", "t")
    heads = pairs.groupBy("a").agg(F.max("k").alias("k")).select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    heads = heads.join(texts.toDF("a", "t"), "a").select("a", "s", F.lit(0).alias("member"), F.col("a").alias("b"), "t")
    dealt = members.unionAll(heads).repartition(tasks(spark), "a", "s").sortWithinPartitions("a", "s", "member")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = np.zeros(0, np.uint64)
        for pdf in batches:
            out = []
            for a, b, member, t in zip(*(pdf[c].tolist() for c in ("a", "b", "member", "t"))):
                if not member:
                    head = shingles(t)
                elif jaccard(head, shingles(t)) >= similarity - _EPS:
                    out.append((a, b))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    with batches_of(spark, 2000):
        return written(dealt.mapInPandas(each, "a long, b long"), "links")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the smallest id, with its own columns; null ids all stay."""
    id_, gx, tx = unused(docs, "id", "gx", "tx")
    g = near_duplicates(docs).where("id <=> component_id").select(F.col("id").alias(id_), F.col("tx").alias(gx)).distinct()
    kept = docs.withColumn(tx, F.coalesce(F.xxhash64(F.col("text").cast("string")), F.lit(0)))
    return kept.join(g, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(tx) == F.col(gx)), "left_semi").select(*docs.columns)

"""Removal of long word runs that an earlier document has, by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of the GRAM-word runs inside it, so
equal windows have equal minimisers wherever they occur. Consecutive windows of a document that share one
travel as a single packed string to the minimiser's bucket; there the strings are sorted and their windows
counted by their words, not by hashes.

1. One pass over the texts gives each document's minimisers. Those of a single document can hold no
   repeat; the others are found by a combined minimum and maximum of doc_id.
2. A second pass, over the documents that have such minimisers, packs their super-k-mers. Equal strings
   become one row with the least doc_id before they are shuffled.
3. Buckets with few strings are sorted and counted whole. In larger ones (a passage in thousands of
   different settings) the words right and left of the minimiser are sorted over all tasks; a string's
   longest common prefix with its neighbours bounds what it can share, the rest is cut off, and what is
   left of a common passage is one string again. Buckets that are still large are split into windows.
4. The windows go back to the documents as word intervals, and a third pass cuts the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import sorted_groups, unused, words_of, written

WINDOW = 50
GRAM = 8
#: Distinct strings of a bucket that are sorted in one group, before and after strings are cut.
BUCKET, CUT_BUCKET = 32, 2048
#: Bytes of text hashed at a time.
BLOCK = 1 << 20
#: Stands for a null doc_id: larger than any, so it never counts as the earlier document.
NO_ID = 2**63 - 1

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(int(_BASE), -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a text whose words are joined by single spaces."""
    raw = np.frombuffer(joined, np.uint8)
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # blocks end at words; a longer word is a block of its own
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        lo, hi = starts[first], ends[last - 1]
        up, down = _power_tables(int(hi - lo) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo])])
        a, b = starts[first:last] - lo, ends[first:last] - lo
        out[first:last] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        first = last
    return _mixed(out), starts, ends


def _grams(h: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM words."""
    g = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        g = g * np.uint64(0x2545F4914F6CDD1D) + h[i : i + len(g)]
    return _mixed(g)


def _minimisers(h: np.ndarray) -> np.ndarray:
    """The minimiser of each window of a document's word hashes; fewer words than a window give none."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64)
    g = _grams(h)
    span, have = WINDOW - GRAM + 1, 1
    while have < span:  # minima over runs of doubling length
        step = min(have, span - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def super_kmers(words: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(minimiser, first window, windows, byte start, byte end) of each run, bytes in the joined words."""
    if len(words) < WINDOW:
        return
    h, starts, ends = _word_hashes(b" ".join(words))
    g = _minimisers(h)
    cut = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
    first, n = cut[:-1], np.diff(cut)
    yield from zip(g[first].view(np.int64).tolist(), first.tolist(), n.tolist(), starts[first].tolist(), ends[first + n + WINDOW - 2].tolist())


def _windows(packed: bytes) -> list[bytes]:
    """The windows of a packed string, in order."""
    at = [-1, *(i for i, c in enumerate(packed) if c == 32), len(packed)]
    return [packed[at[i] + 1 : at[i + WINDOW]] for i in range(len(at) - WINDOW)]


def _runs(least: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, length, value) of runs of equal values."""
    a = 0
    for i in range(1, len(least) + 1):
        if i == len(least) or least[i] != least[a]:
            yield a, i - a, least[a]
            a = i


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (m, sid, s, least) -> (m, sid, first, n, least): the least doc_id of each window of a string."""
    out: list[tuple] = []
    for g in sorted_groups(batches, ["m"]):
        strings = [(sid, bytes(s), d) for sid, s, d in zip(g["sid"], g["s"], g["least"])]
        m = int(g["m"].iloc[0])
        if len(strings) == 1:
            sid, s, d = strings[0]
            out.append((m, sid, 0, s.count(b" ") + 2 - WINDOW, d))
        else:
            parts = [(sid, _windows(s), d) for sid, s, d in strings]
            least: dict[bytes, int] = {}
            for _, ws, d in parts:
                for w in ws:
                    if least.get(w, NO_ID) >= d:
                        least[w] = d
            for sid, ws, _ in parts:
                out += [(m, sid, *r) for r in _runs([least[w] for w in ws])]
        if len(out) > 20000:
            yield pd.DataFrame(out, columns=["m", "sid", "first", "n", "least"])
            out = []
    if out:
        yield pd.DataFrame(out, columns=["m", "sid", "first", "n", "least"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(m, sid, windows) -> (m, sid, first, n, least): windows in a row with one least doc_id as a run."""
    for pdf in batches:
        out = []
        for m, sid, x in zip(pdf["m"], pdf["sid"], pdf["x"]):
            at, n, least = x[0]["first"], 0, x[0]["least"]
            for r in x:
                if r["first"] != at + n or r["least"] != least:
                    out.append((m, sid, at, n, least))
                    at, n, least = r["first"], 0, r["least"]
                n += 1
            out.append((m, sid, at, n, least))
        yield pd.DataFrame(out, columns=["m", "sid", "first", "n", "least"])


def _by_size(strings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The strings of buckets of at most ``most`` strings, and the others."""
    large = strings.groupBy("m").count().where(F.col("count") > most).select("m")
    cols = ["m", "sid", "s", "least", "most"]
    return strings.join(large, "m", "left_anti").select(cols), strings.join(large, "m", "left_semi").select(cols)


def _bucketed(strings: DataFrame) -> DataFrame:
    return strings.repartition("m").sortWithinPartitions("m", "s").mapInPandas(_counted, "m long, sid long, first int, n int, least long")


def _anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each place of the minimiser in a string: the words right and left of it, outward."""
    names = ["m", "sid", "p", "many", "right", "left"]
    reach = WINDOW - GRAM
    for pdf in batches:
        for i in range(0, len(pdf), 2000):
            out = []
            for m, sid, s in zip(pdf["m"].iloc[i : i + 2000], pdf["sid"].iloc[i : i + 2000], pdf["s"].iloc[i : i + 2000]):
                w = bytes(s).split(b" ")
                at = np.flatnonzero(_grams(_word_hashes(bytes(s))[0]).view(np.int64) == m).tolist()
                for p in at:
                    right, left = w[p + GRAM : p + WINDOW], w[max(0, p - reach) : p][::-1]
                    out.append((m, sid, p, len(at) > 1, b"".join(x + b" " for x in right), b"".join(x + b" " for x in left)))
            yield pd.DataFrame(out, columns=names)


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted distinct (m, key, n) -> (m, kh, reach): words that a key has in common with a neighbour.

    Keys that several strings have, and the first and last of a batch, count as common in full.
    """
    for pdf in batches:
        m, key = pdf["m"].tolist(), [bytes(k) for k in pdf["key"]]
        common = [0] * (len(key) + 1)
        for i in range(1, len(key)):
            if m[i] == m[i - 1]:
                a, b = key[i - 1], key[i]
                n = min(len(a), len(b))
                if a[:n] != b[:n]:
                    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
                    n = int((x != y).argmax())
                common[i] = a.count(b" ", 0, n)
        reach = [k.count(b" ") if n > 1 or i in (0, len(key) - 1) else max(common[i], common[i + 1]) for i, (k, n) in enumerate(zip(key, pdf["n"].tolist()))]
        yield pd.DataFrame({"m": m, "kh": pdf["kh"].to_numpy(), "reach": reach})


def _trimmed(strings: DataFrame) -> DataFrame:
    """(m, sid, shift, tid, t, least, most): the strings cut to the windows that another string may share.

    A window reaches a words left of the minimiser and WINDOW - GRAM - a right of it. Both must lie within
    the string's longest common contexts on their side, so no window that two strings share is cut off.
    Strings that several documents have stay whole. So do those with the minimiser in several places, which stand at each place for the others.
    """
    rows = written(strings.mapInPandas(_anchored, "m long, sid long, p int, many boolean, right binary, left binary"), "anchored")
    for side in ("right", "left"):
        keys = rows.groupBy("m", F.col(side).alias("key")).agg(F.count("*").alias("n")).withColumn("kh", F.xxhash64("key"))
        known = keys.repartitionByRange("m", "key").sortWithinPartitions("m", "key").mapInPandas(_prefixes, "m long, kh long, reach int")
        # two keys of one hash would only add reach
        # written, so that both sides of the join are plain exchanges, which Spark splits where a context is very common
        known = written(known.groupBy("m", "kh").agg(F.max("reach").alias(f"{side}_reach")).withColumnRenamed("kh", f"{side}_kh"), "contexts")
        rows = rows.withColumn(f"{side}_kh", F.xxhash64(side)).join(known, ["m", f"{side}_kh"])
    reach = rows.groupBy("m", "sid").agg(F.min("p").alias("p"), F.max("many").alias("many"), F.max("right_reach").alias("r"), F.max("left_reach").alias("l"))
    span = WINDOW - GRAM

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for m, sid, s, d, most, p, many, r, left in pdf[["m", "sid", "s", "least", "most", "p", "many", "r", "l"]].itertuples(index=False):
                w = bytes(s).split(b" ")
                lo, hi = (0, len(w) - WINDOW) if many or d < most else (max(0, p - left), min(len(w) - WINDOW, p - span + r))
                if lo <= hi:
                    out.append((m, sid, lo, b" ".join(w[lo : hi + WINDOW]), d, most))
            yield pd.DataFrame(out, columns=["m", "sid", "shift", "t", "least", "most"])

    return strings.join(reach, ["m", "sid"]).mapInPandas(cut, "m long, sid long, shift int, t binary, least long, most long").withColumn("tid", F.xxhash64("t"))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(m, sid, s, least, most) -> a row for each window: 128 bits of its words and its place."""
    for pdf in batches:
        for i in range(0, len(pdf), 200):
            out = []
            for m, sid, s, d, most in pdf[["m", "sid", "s", "least", "most"]].iloc[i : i + 200].itertuples(index=False):
                for j, w in enumerate(_windows(bytes(s))):
                    x = xxhash.xxh3_128_intdigest(w)
                    out.append((m, sid, j, (x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63, d, most))
            yield pd.DataFrame(out, columns=["m", "sid", "first", "w0", "w1", "d", "most"])


def _merged(first: list[int], n: list[int]) -> Iterator[tuple[int, int]]:
    """The union of word intervals [first, first + n + WINDOW - 1)."""
    lo = hi = -1
    for a, k in sorted(zip(first, n)):
        b = a + k + WINDOW - 1
        if a > hi:
            if hi > lo:
                yield lo, hi
            lo, hi = a, b
        else:
            hi = max(hi, b)
    if hi > lo:
        yield lo, hi


def removals(docs: DataFrame) -> DataFrame:
    """(id, tx, first, n): lists of window runs to remove for the rows of docs (id, tx, t) that have any."""
    key = ["id", "tx"]

    def minis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, x, m) for i, x, t in zip(pdf["id"], pdf["tx"], pdf["t"]) for m in {k[0] for k in super_kmers(words_of(t))}]
            yield pd.DataFrame(rows, columns=["id", "tx", "m"])

    held = written(docs.mapInPandas(minis, "id long, tx long, m long"), "minimisers")
    common = held.groupBy("m").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("m")
    wanted = held.join(common, "m").groupBy(*key).agg(F.collect_set("m").alias("ms"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for i, x, t, ms in zip(pdf["id"], pdf["tx"], pdf["t"], pdf["ms"]):
                w, take = words_of(t), set(ms.tolist() if hasattr(ms, "tolist") else ms)
                joined = b" ".join(w)
                for m, a, n, lo, hi in super_kmers(w):
                    if m in take:
                        rows.append((i, x, m, a, n, joined[lo:hi]))
                        size += hi - lo
                if size > 4 * BLOCK:
                    yield pd.DataFrame(rows, columns=["id", "tx", "m", "at", "n", "s"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["id", "tx", "m", "at", "n", "s"])

    packed = docs.join(wanted, key).select(*key, "t", "ms").mapInPandas(pack, "id long, tx long, m long, at int, n int, s binary")
    packed = written(packed.withColumn("sid", F.xxhash64("s")), "superkmers")
    strings = written(packed.groupBy("m", "sid", "s").agg(F.min("id").alias("least"), F.max("id").alias("most")), "strings")
    small, large = _by_size(strings, BUCKET)
    found = _bucketed(small)
    cut = written(_trimmed(large), "trimmed")
    again = cut.groupBy("m", "tid", "t").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    again = written(again.select("m", F.col("tid").alias("sid"), F.col("t").alias("s"), "least", "most"), "strings")
    small, large = _by_size(again, CUT_BUCKET)
    places = written(large.mapInPandas(_split, "m long, sid long, first int, w0 long, w1 long, d long, most long"), "windows")
    least = places.groupBy("w0", "w1").agg(F.min("d").alias("least"), F.max("most").alias("most")).where("least < most").drop("most")
    single = places.join(least, ["w0", "w1"]).groupBy("m", "sid").agg(F.sort_array(F.collect_list(F.struct("first", "least"))).alias("x"))
    inner = _bucketed(small).unionAll(single.mapInPandas(_joined, "m long, sid long, first int, n int, least long"))
    inner = cut.select("m", "sid", "shift", "tid").join(inner.withColumnRenamed("sid", "tid"), ["m", "tid"])
    found = found.unionAll(inner.select("m", "sid", (F.col("first") + F.col("shift")).alias("first"), "n", "least"))
    back = packed.select(*key, "m", "sid", "at").join(found, ["m", "sid"]).where("least < id")
    return back.groupBy(*key).agg(F.collect_set(F.struct((F.col("at") + F.col("first")).alias("first"), "n")).alias("cuts"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with ``text_col`` less its repeated words, and n_words, n_removed before it.

    A word goes if it lies in a window of 50 words that also starts in a row with a smaller id; windows are
    judged on the input. Kept words are joined by one space; a text that loses nothing stays as it is, and a
    text that loses everything becomes empty. A null text has no words and stays null. A null id is larger
    than any other and equal to its like. Rows with one id do not remove each other's words. The counts are
    named ``n_words`` and ``n_removed``; columns of these names in ``docs`` are replaced.
    """
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    text = F.col(text_col).cast("string")
    keyed = docs.select(id_.alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tx"), text.alias("t"))
    cuts = removals(keyed)
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed")]
    i, x, own, a, n, made = unused(docs, "id", "tx", "own", "a", "n", "made")
    src = docs.select(*rest, id_.alias(i), F.coalesce(F.xxhash64(text), F.lit(0)).alias(x), text.alias(own))
    cuts = cuts.select(F.col("id").alias(i), F.col("tx").alias(x), F.transform("cuts", lambda r: r["first"]).alias(a), F.transform("cuts", lambda r: r["n"]).alias(n))
    both = src.join(cuts, [i, x], "left")

    @F.pandas_udf("t string, n_words long, n_removed long")
    def cut(t: pd.Series, first: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for x, a, k in zip(t, first, n):
            w = words_of(x)
            if a is None:
                out.append((x, len(w), 0))
                continue
            keep, at = [], 0
            for lo, hi in _merged(list(a), list(k)):
                keep += w[at:lo]
                at = hi
            keep += w[at:]
            out.append((b" ".join(keep).decode("utf-8", "surrogatepass"), len(w), len(w) - len(keep)))
        return pd.DataFrame(out, columns=["t", "n_words", "n_removed"])

    both = both.withColumn(made, cut(own, a, n))
    return both.select(*(F.col(made)["t"].alias(c) if c == text_col else F.col(c) for c in rest), F.col(made)["n_words"].alias("n_words"), F.col(made)["n_removed"].alias("n_removed"))


def op2_substring(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``."""
    d = dedup_substrings(docs.select("doc_id", "text"))
    t = F.coalesce("text", F.lit(""))
    seps = r"[\x20\x09-\x0D]+"
    plain = F.trim(F.regexp_replace(t, seps, " "))
    return d.select("doc_id", "n_words", "n_removed", F.sha2(plain.cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, its text less the repeated words."""
    put = {c: unused(docs, f"own_{c}")[0] if c.lower() in ("n_words", "n_removed") else c for c in docs.columns}
    d = dedup_substrings(docs.withColumnsRenamed({c: p for c, p in put.items() if c != p}))
    return d.select(*(F.col(p).alias(c) for c, p in put.items()))

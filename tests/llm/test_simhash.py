import random

import numpy as np
import xxhash

from siftlode.llm import simhash

SCHEMA = "doc_id long, text string, f0 long, id string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(fps)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if bin(fps[a] ^ fps[b]).count("1") <= 2 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp


def texts():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(vocab, k=r.choice([2, 5, 60, 200]))) for _ in range(60)]
    out = list(base)
    for t in base[:30]:
        w = t.split()
        w[r.randrange(len(w))] = "EDIT"
        out += [" ".join(w), t, t.upper(), t.replace(" ", "\n\t ")]
    return [*out, None, "", " \n", "x", "X", "x y", "é b c d", "word " * 5000]


def test_against_brute_force(spark):
    rows = [(i, t, 7, "clash") for i, t in enumerate(texts())]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    comp = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_same_links_by_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    test_against_brute_force(spark)


def test_blocks_find_links_of_more_bits(spark, monkeypatch):
    r = np.random.default_rng(3)
    base = r.integers(-(2**62), 2**62, 40)
    f = np.unique(np.concatenate([base, *(base ^ (1 << int(b)) for b in r.integers(0, 60, 4))]))
    fps = spark.createDataFrame([(int(x),) for x in f], "f0 long")
    n, both = simhash.bit_statistics(fps, 1)
    assert n == len(f)
    plan = simhash.allocate(n, both, 5, (3,))
    assert sum(t + 1 for t in plan.thresholds) == 6
    want = brute_pairs(f, 5)
    for bucket in (128, 2):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        e = [(x.a0, x.b0) for x in simhash.links(fps, 5, plan).collect()]
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 5 for a, b in e)
        assert groups(f, e) == groups(f, want)


def brute_pairs(f, tau):
    return [(int(a), int(b)) for a in f for b in f if a < b and int(np.bitwise_count(np.uint64(int(a) & (2**64 - 1)) ^ np.uint64(int(b) & (2**64 - 1)))) <= tau]


def groups(f, edges):
    root = {int(x): int(x) for x in f}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_empty_and_null_ids(spark):
    assert simhash.op1_simhash(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d", 0, ""), (5, "a b c d", 0, ""), (5, "a b c d", 0, "")]
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.op1_simhash(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("5", 5), ("5", 5), ("None", 5)]


def test_thresholds_follow_the_costs():
    r = np.random.default_rng(0)
    bits = r.random((4000, 64)) < 0.5
    bits[:, :20] = bits[:, :1] ^ (r.random((4000, 20)) < 0.05)  # these twenty move together
    both = bits.T.astype(float) @ bits
    plan = simhash.allocate(4000, both, 2, (4,))
    skewed = [p for p, part in enumerate(plan.parts) if np.mean([b < 20 for b in part]) > 0.9]
    assert skewed and all(plan.thresholds[p] == -1 for p in skewed)


def test_bit_statistics_reach_the_driver_in_columns(spark, monkeypatch):
    fps = spark.createDataFrame([(3, -1), (1, 0), (5, 2)], "f0 long, f1 long")
    monkeypatch.setattr(type(fps), "collect", lambda *a: (_ for _ in ()).throw(AssertionError("rows")))
    n, both = simhash.bit_statistics(fps, 2)
    bits = np.array([[v >> (63 - i) & 1 for v in r for i in range(64)] for r in ((3, -1), (1, 0), (5, 2))])
    assert n == 3 and np.array_equal(both, bits.T @ bits)
    n, both = simhash.bit_statistics(fps.limit(0), 2)
    assert n == 0 and not both.any()

import random

import corpus_pipeline
import numpy as np
from siftlode.llm import neardup
from siftlode.llm.shared import shared_path


def prose(r, n, tag):
    return " ".join(r.choice(["the", "of", "and", "is", "to"]) if r.random() < 0.35 else f"{tag}{r.randrange(900)}" for _ in range(n))


def docs():
    r = random.Random(3)
    clean = [prose(r, 150, f"a{i}x") for i in range(12)]
    near = []
    for i in range(5):
        w = clean[0].split()
        w[20 * i + 5] = "edit"
        near.append(" ".join(w))
    item = prose(r, 30, "item")
    passage = prose(r, 60, "pass")
    leaked = [prose(r, 80, "l") + " " + item.replace("item", "item") + " " + prose(r, 40, "m")]
    shared = [prose(r, 70, f"s{i}x") + " " + passage + " " + prose(r, 70, f"t{i}x") for i in range(3)]
    junk = ["short text", None, "", "### *** %%% " * 40, "a b c " * 100]
    texts = [*clean, clean[1], clean[1], *near, *leaked, *shared, *junk]
    return [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], item, passage


def test_stages_and_their_decisions(spark):
    rows, item, passage = docs()
    d = shared_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(out) == {*range(12), 20, 21, 22}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out.values())
    assert all(out[i].text == rows[i][1] for i in [*range(12), 20])
    assert all(passage not in out[i].text and len(out[i].text.split()) == 140 for i in (21, 22))


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(11)
    base = [prose(r, 300, f"b{i}x") for i in range(6)]
    texts = list(base)
    for t in base[:4]:
        for k in (1, 3, 5):
            w = t.split()
            for j in range(k):
                w[j * 50 + r.randrange(40)] = f"new{j}"
            texts.append(" ".join(w))
    texts += [base[0], None, None, "", "x", "x"]
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    comp = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            same = a == b or (bool(a) and bool(b) and len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) >= 0.8)
            if same:
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    assert {g.id: g.component_id for g in got} == dict(enumerate(comp))
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def partners(spark, texts):
    """Pairs of rows in one class, for texts that come in twos."""
    got = {g.id: g.component_id for g in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return [got[i] == got[i + 1] for i in range(0, len(texts), 2)]


def test_no_near_copy_is_lost(spark):
    r = random.Random(5)
    texts = []
    for i in range(150):
        t = prose(r, 200, f"e{i}x").split()
        cut = r.randrange(10, 38)
        edited = [t + prose(r, cut, f"e{i}x").split(), t[:-cut], t[:60] + [f"n{j}" for j in range(cut // 3)] + t[60 + cut // 3 :]][i % 3]
        texts += [" ".join(t), " ".join(edited)]
    near = [jaccard(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2])]
    assert sum(near) > 120 and all(p for p, n in zip(partners(spark, texts), near) if n)


def test_fingerprints_are_as_far_apart_as_the_similarity_says():
    r = np.random.default_rng(4)
    far = []
    for _ in range(200):
        both, a, b = np.split(r.integers(0, 2**63, 450, np.uint64), [400, 425])
        x, y = (np.array(neardup.lanes_of(np.sort(np.concatenate([both, s]))), np.int64).view(np.uint64) for s in (a, b))
        far.append(int(np.bitwise_count(x ^ y).sum()))
    s = 400 / 450
    assert abs(np.mean(far) - neardup.bits_apart(s, 0)) < 2
    assert max(far) <= neardup.bits_apart(s, 4) and min(far) >= neardup.bits_apart(s, -4)


def test_every_pair_within_the_thresholds_meets_once(spark):
    r = np.random.default_rng(7)
    base = r.integers(-(2**63), 2**63, (60, 4), np.int64)
    rows = [b for b in base]
    for b in base:
        for k in (1, 9, 20, 27):
            x = b.copy()
            for bit in r.choice(256, k, replace=False).tolist():
                x[bit // 64] ^= np.array(1 << (bit % 64), np.uint64).view(np.int64)
            rows.append(x)
    classes = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(rows)], "f long, f0 long, f1 long, f2 long, f3 long")
    n, both = neardup.bit_statistics(classes.select("f0", "f1", "f2", "f3"), 4)
    plan = neardup.allocate(n, both, 27, (12, 16), most=4, probe_cost=100.0)
    assert sum(t + 1 for t in plan.thresholds) == 28 and len(set(plan.thresholds)) > 1
    none = classes.selectExpr("f", "f as label").limit(0)
    got = [(p.a, p.b) for p in neardup._met(classes, none, plan, 56, 0.8)[0].collect()]
    bits = np.array(rows).view(np.uint64)
    near = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if np.bitwise_count(bits[i] ^ bits[j]).sum() <= 27}
    assert len(got) == len(set(got)) and near <= set(got) and len(near) >= 240


def test_pairs_apart_in_a_group_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 3)
    monkeypatch.setattr(neardup, "MEMBERS", 2)
    monkeypatch.setattr(neardup, "FILED", 20)
    r = random.Random(9)
    t = prose(r, 400, "h").split()
    texts = [" ".join(t[4 * i : 4 * i + 200]) for i in range(40)]  # neighbours up to 5 steps are near, the ends are not
    got = {g.component_id for g in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0}


def test_pairs_below_the_similarity_stay_apart(spark):
    r = random.Random(6)
    texts = []
    for i in range(60):
        t = prose(r, 200, f"f{i}x").split()
        texts += [" ".join(t), " ".join(t + prose(r, 52 + i % 20, f"f{i}x").split())]
    assert all(0.7 < jaccard(a, b) < 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert not any(partners(spark, texts))

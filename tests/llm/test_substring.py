import hashlib
import random

from siftlode.llm import substring


def brute(rows):
    """Per row: words, removed words, digest; straight from the definition."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            least[g] = min(least.get(g, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 49):
            if least[tuple(w[k : k + 50])] < (float("inf") if i is None else i):
                gone.update(range(k, k + 50))
        keep = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(keep)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    vocab = [f"wö{i}" for i in range(400)]
    new = lambda n: r.choices(vocab, k=n)
    passage, base = new(60), new(300)
    texts = [new(r.choice([10, 49, 50, 51, 120, 400])) for _ in range(25)]
    texts += [[*new(r.randrange(30)), *passage, *new(r.randrange(30))] for _ in range(50)]
    for _ in range(20):
        w = list(base)
        w[r.randrange(300)] = "edit"
        texts.append(w[r.randrange(40) :])
    texts += [list(base)] * 5 + [["same"] * 300, ["same"] * 120, ["a", "b"] * 80, new(50) * 3, passage[:50], passage[:49]]
    out = [" ".join(t) if k % 3 else "\n\t".join(t) + " " for k, t in enumerate(texts)]
    out += [None, "", " \x0b ", "z" * 3_000_000 + " " + " ".join(passage)]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, m string, n_words int")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.op2_substring(docs).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    assert any(x[2] for x in want)
    assert run(spark, rows) == want
    for first, second in ((1, 1), (1, 99), (6, 3)):  # windows by themselves; cut strings; both
        monkeypatch.setattr(substring, "BUCKET", first)
        monkeypatch.setattr(substring, "CUT_BUCKET", second)
        assert run(spark, rows) == want


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(70))
    assert run(spark, [(4, t), (4, t), (None, t), (None, t)]) == brute([(4, t), (4, t), (None, t), (None, t)])
    assert run(spark, []) == []


def test_stage_keeps_columns(spark):
    t = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, t, 5), (2, "own " + t, 6), (3, "a\nb", 7), (4, None, 8)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in substring.stage(spark, docs, "").collect()}
    assert got[1].text == t and got[2].text == "own" and got[2].n_words == 6 and got[3].text == "a\nb" and got[4].text is None

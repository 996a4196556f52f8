import re
from collections import Counter

from siftlode.llm import quality

TEXTS = [
    None, "", " \n\t", "a", "a b c", "a b c a b c a b c", "x\x0by\x0cz\rw", "é# *ü\n\nsame line\nsame line\n same line\n \n",
    "the and of " * 40 + "\n" + " ".join(f"w{i}" for i in range(60)), " ".join(f"the wor{i} of" for i in range(50)),
    " ".join(f"w{i}### and" for i in range(50)), "long " * 30000, " ".join(f"{i}" for i in range(80)),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rows = [(i, t, 99, "n") for i, t in enumerate(TEXTS)] + [(None, "a b", 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, rule string")
    got = {r.doc_id: r for r in quality.op3_quality(docs).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        n, chars, sym, dup, rep = want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)
    assert got[9].kept and got[10].rule == "symbols" and not got[10].kept and got[12].rule is not None


def test_stage_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, TEXTS[9], 5, "x"), (2, "short", 6, "y")], "doc_id long, text string, n_words int, rule string")
    got = quality.stage(spark, docs, "").collect()
    assert [(r.doc_id, r.n_words, r.rule) for r in got] == [(1, 5, "x")]
    assert quality.stage(spark, docs.limit(0), "").collect() == []


def test_no_python_in_the_plan(spark, capsys):
    quality.op3_quality(spark.createDataFrame([(1, "a")], "doc_id long, text string")).explain()
    assert "Python" not in capsys.readouterr().out

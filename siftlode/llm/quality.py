"""Quality rules: a table of thresholds compiled into one projection, with no user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.llm.shared import unused

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Everyday words of the four languages of the corpus (a parameter of the rules, lower case).
STOP_WORDS = tuple(
    sorted(
        set(
            "a an and are as at be by for from in is it of on that the this to was with or "
            "au avec dans de des du elle en est et la le les ne par pas pour que qui sur un une "
            "auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
            "con del el es las lo los no para por se su una y".split()
        )
    )
)
_SPACES = "\t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A document fails where ``ratio`` lies below ``low`` or above ``high``."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None


#: Ratios are of the counts that ``counts`` makes. One row a rule.
RULES = (
    Rule("word_length", "word_chars / n_words", 3.0, 10.0),
    Rule("symbols", "n_symbols / n_words", high=0.1),
    Rule("stop_words", "n_stop_words / n_words", low=0.06),
    Rule("letters", "n_letter_words / n_words", low=0.7),
    Rule("duplicate_lines", "n_dup_lines / n_lines", high=0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The columns of ``docs`` and, under ``prefix``, the counts that rules use.

    A null text counts as empty: all counts are zero. Every step is a built-in expression on the row
    itself: nothing is shuffled, and one document's arrays are all a task holds. A word is covered by a
    repeat if it lies in a 3-word window that occurs twice in the text: windows are hashed, sorted with
    their positions and compared with their neighbours, so the cost is that of a sort. Repeated rows are
    counted each, an empty table stays empty, columns that have a count's name are replaced, all others stay.
    """
    p = prefix
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spaced = F.translate(t, _SPACES, " " * len(_SPACES))
    c = dict(zip(("t", "w", "lines", "s"), unused(docs, "t", "w", "lines", "s"))).__getitem__
    df = docs.withColumn(c("t"), t).withColumn(c("w"), F.filter(F.split(spaced, " "), lambda w: w != ""))
    lines = F.filter(F.split(F.col(c("t")), "\n"), lambda x: F.btrim(x, F.lit(" " + _SPACES)) != "")
    w = F.col(c("w"))
    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
    )
    df = df.withColumns({c("lines"): lines, c("s"): F.sort_array(windows)})
    s = F.col(c("s"))
    again = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    made = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(F.col(c("t")), " " + _SPACES, "")),
        "n_symbols": F.length(F.col(c("t"))) - F.length(F.translate(F.col(c("t")), SYMBOLS, "")),
        "n_lines": F.size(c("lines")),
        "n_dup_lines": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
        "n_repeat_words": F.size(covered),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))),
        "n_letter_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
    }
    return df.withColumns({p + k: v.cast("long") for k, v in made.items()}).drop(*(c(n) for n in ("t", "w", "lines", "s")))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def first_failure(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """The name of the first rule that a row fails, null where it passes all; 0 / 0 passes."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        a, b = (F.col(prefix + x.strip()) for x in r.ratio.split("/"))
        ratio = F.when(b > 0, a / b)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | F.coalesce(ratio < r.low, F.lit(False))
        if r.high is not None:
            bad = bad | F.coalesce(ratio > r.high, F.lit(False))
        out = F.when(bad, F.lit(r.name)).otherwise(out)
    return out


def op3_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns for whole ``documents``, and the rule that decided."""
    d = counts(docs.select("doc_id", "text")).withColumn("base_failed", base_failed()).withColumn("rule", first_failure())
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass the base test and every rule, with their own columns."""
    own = "_quality_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = "_" + own
    d = counts(docs, prefix=own)
    keep = ~base_failed(own) & first_failure(prefix=own).isNull()
    # the verdict passes through a generator of one row: a filter on it would be pushed below the arrays it
    # comes from and evaluate them again for every use
    d = d.withColumn(own + "keep", F.explode_outer(F.array(keep)))
    return d.where(F.col(own + "keep")).select(*docs.columns)


def _ratio_sql(r: Rule) -> str:
    a, b = (x.strip() for x in r.ratio.split("/"))
    tests = [f"{a} / {b} < {r.low}"] * (r.low is not None) + [f"{a} / {b} > {r.high}"] * (r.high is not None)
    return f"WHEN {b} > 0 AND ({' OR '.join(tests)}) THEN '{r.name}'"


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        CASE {" ".join(map(_ratio_sql, RULES))} END AS rule FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule IS NULL AS kept, rule FROM r
"""

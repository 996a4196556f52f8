"""Tables of pattern matches and anchors, label filters, and a catalog of vertex features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.text import finite_or_zero, lookup, non_blank, one_hot, trim_all


def best_label(hits: DataFrame) -> DataFrame:
    """(cid, atom, label) of hits (cid, atom, label, match_size, pattern_length, pattern_row): an atom's largest
    match, then the longest pattern, then the last row, then the last label."""
    best = F.max_by("label", F.struct("match_size", "pattern_length", "pattern_row", "label"))
    return hits.groupBy("cid", "atom").agg(best.alias("label"))


def anchor_status(anchors: DataFrame, candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, element, label, status) of anchors (cid, element, mapped_atom), one a molecule.

    candidates (cid, atom): the atoms that may be the anchor; labels (cid, atom, label): an atom without one is
    'other'. missing: no candidate; trivial: just one; geom: the mapped atom is one of them; consensus: all known
    labels agree; ambig: they do not.
    """
    named = candidates.join(labels, ["cid", "atom"], "left").withColumn("label", F.coalesce("label", F.lit("other")))
    known = F.when(F.col("label") != "other", F.col("label"))
    each = named.groupBy("cid").agg(F.count("*").alias("k"), F.min("label").alias("one"), F.count_distinct(known).alias("known"), F.max(known).alias("name"))
    mapped = anchors.join(named.select("cid", F.col("atom").alias("mapped_atom"), F.col("label").alias("mapped")), ["cid", "mapped_atom"], "left_outer")
    a = mapped.join(each, "cid", "left")
    status = F.when(F.col("k").isNull(), "missing").when(F.col("k") == 1, "trivial").when(F.col("mapped").isNotNull(), "geom").when(F.col("known") <= 1, "consensus").otherwise("ambig")
    label = F.when(F.col("k").isNull(), "missing").when(F.col("k") == 1, F.col("one")).when(F.col("mapped").isNotNull(), F.col("mapped"))
    label = label.when(F.col("known") == 1, F.col("name")).when(F.col("known") == 0, "other").otherwise(F.concat(F.lit("ambiguous_"), F.col("element")))
    return a.select("cid", "element", label.alias("label"), status.alias("status"))


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def resolved(label: str, catch_all: tuple[str, ...] = ("other",), unresolved: str = "ambiguous_") -> Column:
    """Whether a label names something: not blank, no catch-all, not one of those left open."""
    c = F.col(label)
    return F.coalesce((trim_all(c) != "") & ~c.isin(*catch_all) & ~c.startswith(unresolved), F.lit(False))


def exactly(values: str, kinds: list, n: int) -> Column:
    """Whether an array has n elements of some kinds, whatever else it has."""
    return F.size(F.filter(F.col(values), lambda x: x.isin(*kinds))) == n


def distribution(df: DataFrame, value: str, name: str = "n") -> DataFrame:
    """How many rows have each value."""
    return df.groupBy(value).agg(F.count("*").alias(name))


def by_lists(df: DataFrame, journals: list[str], extra: DataFrame, exclude: DataFrame, order: str) -> DataFrame:
    """(journal, cid, name): rows of the journals, the first by ``order`` of each journal and cid, with extra rows that are
    not there yet, less excluded names. Journals compare trimmed and in upper case, names trimmed and in lower case; a blank
    name is 'CID' and the cid."""
    journal, name = F.upper(trim_all("journal")), F.lower(trim_all("name"))
    own = df.withColumn("journal", journal).where(F.col("journal").isin(*(j.strip().upper() for j in journals)) & F.col("cid").isNotNull())
    both = own.select("journal", "cid", "name", F.lit(0).alias("o"), order).unionAll(extra.select(journal.alias("journal"), "cid", "name", F.lit(1).alias("o"), order))
    both = both.withColumn("name", F.coalesce(non_blank("name"), F.concat(F.lit("CID"), F.col("cid"))))
    one = both.groupBy("journal", "cid").agg(F.min_by("name", F.struct("o", order, "name")).alias("name")).withColumn("__n", name)
    return one.join(exclude.select(journal.alias("journal"), name.alias("__n")), ["journal", "__n"], "left_anti").select("journal", "cid", "name")


class Features:
    """A catalog of named features of a vertex or edge table, each an array of doubles, to be chosen by name."""

    def __init__(self):
        self.parts: dict[str, Column] = {}

    def number(self, name: str, column: str | None = None) -> Features:
        """The column's value; what is null or not finite counts as 0."""
        self.parts[name] = F.array(finite_or_zero(F.col(column or name).cast("double")))
        return self

    def flag(self, name: str, column: str | None = None) -> Features:
        self.parts[name] = F.array(F.coalesce(F.col(column or name).cast("double"), F.lit(0.0)))
        return self

    def one_hot(self, name: str, values: list, column: str | None = None) -> Features:
        """A place for each value and a last one for all others."""
        self.parts[name] = F.transform(one_hot(column or name, values), lambda x: x.cast("double"))
        return self

    def of_table(self, name: str, column: str, values: dict, default: float) -> Features:
        """A value of a small fixed table."""
        self.parts[name] = F.array(lookup(column, values, default).cast("double"))
        return self

    def vector(self, names: list[str]) -> Column:
        """The chosen features one behind the other."""
        missing = [n for n in names if n not in self.parts]
        if missing:
            raise ValueError(f"unknown features: {', '.join(missing)}")
        return F.flatten(F.array(*(self.parts[n] for n in names)))

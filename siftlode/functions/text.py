"""Text and number expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(x: str | Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def non_blank(x: str | Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(trim_all(x), F.lit(""))


def first_non_blank(*xs: str | Column) -> Column:
    return F.coalesce(*(non_blank(x) for x in xs))


def parse_finite(x: str | Column) -> Column:
    """A double, null for what is no number, NaN or infinite. Type suffixes ('1d', '1f') are no numbers."""
    t = trim_all(_c(x).cast("string"))
    v = F.when(~t.rlike("[dDfF]$"), t.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def comma_decimal(x: str | Column) -> Column:
    """A number with a decimal comma or point, 0 where there is none."""
    return F.coalesce(parse_finite(F.regexp_replace(_c(x), ",", ".")), F.lit(0.0))


def finite_or_zero(x: str | Column) -> Column:
    v = _c(x)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def integer_key(x: str | Column) -> Column:
    """A whole-number key ('007' and '7' are one), null for anything else."""
    t = trim_all(_c(x).cast("string"))
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def slug(x: str | Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def last_parenthesis(x: str | Column) -> Column:
    """What stands in the last pair of parentheses, '' without one."""
    return trim_all(F.regexp_extract(_c(x), r"\(([^()]*)\)[^(]*$", 1))


def trailing_label(x: str | Column) -> Column:
    """The text in parentheses at the end, behind a blank, if it is not empty; else the trimmed name."""
    t = trim_all(x)
    return F.coalesce(non_blank(F.regexp_extract(t, r"(?s)^.+\s+\(([^)]*)\)$", 1)), t)


def lookup_name(x: str | Column, longest: int = 20) -> Column:
    """The trimmed name without a short parenthesis at its end that is behind a blank and holds no comma."""
    t = trim_all(x)
    inner = F.regexp_extract(t, r"(?s)^.+\s+\(([^)]*)\)$", 1)
    short = t.rlike(r"(?s)^.+\s+\([^)]*\)$") & (F.length(inner) <= longest) & ~inner.contains(",")
    return F.when(short, trim_all(F.regexp_replace(t, r"\s+\([^)]*\)$", ""))).otherwise(t)


def display_name(x: str | Column, shared: str | Column, blank: str = "Unknown") -> Column:
    """The abbreviation in the last parentheses unless it is shared with another name; else the whole name."""
    short = last_parenthesis(x)
    return F.when((short != "") & ~_c(shared), short).otherwise(F.coalesce(non_blank(x), F.lit(blank)))


def yes_no(x: str | Column) -> Column:
    """A flag as 'yes' or 'no', '' where it is unknown."""
    return F.coalesce(F.when(_c(x), F.lit("yes")).when(~_c(x), F.lit("no")), F.lit(""))


def list_cell(x: str | Column, sep: str = "; ") -> Column:
    """An array of texts as one cell, blank elements left out; '' for null."""
    return F.coalesce(F.array_join(F.filter(_c(x), lambda v: non_blank(v).isNotNull()), sep), F.lit(""))


def ellipsis(x: str | Column, n: int) -> Column:
    """At most n characters, the last three of them dots where the text was longer."""
    return F.when(F.length(_c(x)) > n, F.concat(F.substring(_c(x), 1, n - 3), F.lit("..."))).otherwise(_c(x))


def number_in_name(x: str | Column, word: str = "epoch") -> Column:
    """The number that follows a word in a file name, null without one."""
    return F.nullif(F.regexp_extract(_c(x), rf"(?i){word}[_-]?(\d+)", 1), F.lit("")).cast("int")


def has_isotope(x: str | Column) -> Column:
    return F.coalesce(_c(x).rlike(r"\[\d+[A-Za-z]"), F.lit(False))


def is_digits(x: str | Column) -> Column:
    return F.coalesce(_c(x).rlike(r"^[0-9]+$"), F.lit(False))


def mentions(x: str | Column, short: str) -> Column:
    """Whether a name is an abbreviation, holds it in parentheses, or holds it as a word of its own.

    A word begins after white space, a comma or a parenthesis: '2,6-PDA' and 'BPDA' do not mention 'PDA'.
    """
    short = short.strip()
    if not short:
        return F.lit(False)
    t, q = trim_all(_c(x)), "\\Q" + short + "\\E"
    return F.coalesce((t == short) | t.contains(f"({short})") | t.contains(f"({short}-") | t.rlike(rf"(^|[\s(,]){q}([\s),.\-]|$)"), F.lit(False))


def flags_array(x: str | Column) -> Column:
    """'[0,0,1]' as array<int>; null unless every element is 0 or 1."""
    a = F.from_json(_c(x), "array<int>")
    return F.when((F.size(a) > 0) & F.forall(a, lambda v: v.isNotNull() & v.isin(0, 1)), a)


def set_positions(flags: str | Column) -> Column:
    """The places (from 0) of ones."""
    return F.filter(F.transform(_c(flags), lambda v, i: F.when(v == 1, i)), lambda v: v.isNotNull())


def triples(flat: str | Column) -> Column:
    """3n numbers as n rows of three; null if they do not divide."""
    a = _c(flat)
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / 3).cast("int") - 1), lambda i: F.slice(a, i * 3 + 1, 3))
    return F.when((F.size(a) > 0) & (F.size(a) % 3 == 0), rows)


def lenient_json(x: str | Column, schema: str) -> Column:
    """JSON, out of a code fence or surrounding prose, and with single quotes where it is none otherwise."""
    t = F.regexp_extract(F.regexp_replace(_c(x), r"```[a-zA-Z]*", ""), r"(?s)\{.*\}|\[.*\]", 0)
    return F.coalesce(F.from_json(F.nullif(t, F.lit("")), schema, {"mode": "PERMISSIVE"}), F.from_json(F.regexp_replace(F.nullif(t, F.lit("")), "'", '"'), schema))


def one_hot(x: str | Column, values: list) -> Column:
    """An array of 0/1 with a last place for other values and nulls."""
    v = _c(x)
    known = F.coalesce(v.isin(*values), F.lit(False))
    return F.array(*(F.coalesce((v == a).cast("int"), F.lit(0)) for a in values), (~known).cast("int"))


def lookup(x: str | Column, table: dict, default) -> Column:
    """A value of a small fixed table, or the default (None: null)."""
    m = F.create_map(*(F.lit(a) for kv in table.items() for a in kv))
    return F.coalesce(F.try_element_at(m, _c(x)), F.lit(default)) if default is not None else F.try_element_at(m, _c(x))


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and the keys as text: the same on every run, layout and engine."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(_c(k).cast("string") for k in keys))), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / float(1 << 52)

"""Rule filters built from a configuration over a table of precomputed features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlode.functions.text import lookup
from siftlode.operators.clean import reject_reason, set_filter


@dataclass(frozen=True)
class Rule:
    """A reason for rejection: what a test of a column against a value finds. A value of None, False or [] switches it off."""

    reason: str
    column: str
    test: str
    value: object = True


#: What each test rejects.
TESTS: dict[str, Callable[[Column, object], Column]] = {
    "missing": lambda c, _: c.isNull(),
    "holds": lambda c, _: c,
    "fails": lambda c, _: ~c,
    "not_equal": lambda c, v: c != v,
    "below": lambda c, v: c < v,
    "above": lambda c, v: c > v,
    "allowed": lambda c, v: ~set_filter(c, allowed=v),
    "any_of": lambda c, v: ~set_filter(c, any_of=v),
    "required": lambda c, v: ~set_filter(c, required=v),
    "forbidden": lambda c, v: ~set_filter(c, forbidden=v),
    "both_signs": lambda c, _: charged_both_ways(c),
    "no_lone_pair": lambda c, v: lone_pair_missing(c, v),
}


@dataclass
class Rules:
    """Flags that must not hold, conditions on sets, bounds of numbers (inclusive, either may be None), then further rules.

    An empty list or None switches a condition off. ``check`` names what is wrong with a configuration. A null
    feature passes the tests of ``flags``, ``sets`` and ``bounds``, and fails those of ``more``.
    """

    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    sets: dict[str, dict[str, list]] = field(default_factory=dict)
    forbidden_flags: list[str] = field(default_factory=list)
    more: list[Rule] = field(default_factory=list)

    def check(self) -> list[str]:
        wrong = [f"{k}: the lower bound exceeds the upper" for k, (a, b) in self.bounds.items() if a is not None and b is not None and a > b]
        known = {"allowed", "forbidden", "required", "any_of"}
        wrong += [f"{k}: unknown condition {c}" for k, v in self.sets.items() for c in v if c not in known]
        return wrong + [f"{r.reason}: unknown test {r.test}" for r in self.more if r.test not in TESTS]

    def rules(self) -> list[Rule]:
        """All rules that are on, in order (cheap ones first)."""
        out = [Rule(f"has_{f}", f, "holds") for f in self.forbidden_flags]
        out += [Rule(f"{c}_{k}", c, k, vals) for c, v in self.sets.items() for k, vals in v.items()]
        for c, (lo, hi) in self.bounds.items():
            out += [Rule(f"{c}_low", c, "below", lo), Rule(f"{c}_high", c, "above", hi)]
        return [r for r in [*out, *self.more] if r.value is not None and r.value is not False and r.value != []]


def rules_reason(rules: Rules) -> Column:
    """The first rule that rejects a row, null for a row that passes all."""
    if wrong := rules.check():
        raise ValueError("; ".join(wrong))
    found = lambda r: TESTS[r.test](F.col(r.column), r.value)
    tests = [(r.reason, F.coalesce(found(r), F.lit(True)) if r in rules.more else found(r)) for r in rules.rules()]
    return reject_reason(tests) if tests else F.lit(None).cast("string")


def apply_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """df with ``reject_reason``, null for what passes."""
    return df.withColumn("reject_reason", rules_reason(rules))


def charged_both_ways(charges: Column) -> Column:
    """Whether an array holds a positive and a negative charge."""
    return F.exists(charges, lambda x: x > 0) & F.exists(charges, lambda x: x < 0)


def band(value: Column, bands: list[tuple[str, float | None, float | None]]) -> Column:
    """The first band that holds; null outside all. Bands are low <= value <= high, but value < high if low is None."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(bands):
        ok = F.lit(True)
        ok = ok & (value >= lo) if lo is not None else ok
        ok = ok & ((value <= hi) if lo is not None else (value < hi)) if hi is not None else ok
        out = F.when(ok, F.lit(name)).otherwise(out)
    return out


def lone_pair(element: Column, valence: Column, charge: Column, electrons: dict[str, int] | None = None) -> Column:
    """Whether an atom has two or more electrons left after its bonds; other elements than those named have none."""
    return F.coalesce(lookup(element, electrons or OUTER_ELECTRONS, None) - valence - charge >= 2, F.lit(False))


def lone_pair_missing(atoms: Column, elements: list[str]) -> Column:
    """Whether an array of atoms (element, valence, charge) has atoms of the elements that can hold a lone pair, but none with one."""
    able = F.filter(atoms, lambda a: a["element"].isin(*(e for e in elements if e in OUTER_ELECTRONS)))
    return (F.size(able) > 0) & ~F.exists(able, lambda a: lone_pair(a["element"], a["valence"], a["charge"]))


#: Outer electrons of the elements that can anchor.
OUTER_ELECTRONS = {"N": 5, "O": 6, "S": 6, "P": 5}
#: Elements that a molecule may hold, and those of which it must hold one.
ALLOWED_ELEMENTS = ["H", "C", "N", "O", "S", "P", "F", "Cl", "Br", "I"]
HETERO_ELEMENTS = ["N", "O", "S", "P"]
#: The reasons in the order in which molecules are tried, the feature and test of each, and its default.
MOLECULE_RULES = [
    Rule("null_mol", "elements", "missing"),
    Rule("sanitization", "sanitized", "fails"),
    Rule("single_component", "n_components", "not_equal", 1),
    Rule("allowed_elements", "elements", "allowed", ALLOWED_ELEMENTS),
    Rule("require_any_elements", "elements", "any_of", HETERO_ELEMENTS),
    Rule("require_all_elements", "elements", "required", []),
    Rule("forbidden_elements", "elements", "forbidden", []),
    Rule("max_heavy_atoms", "n_heavy", "above", 30),
    Rule("no_radicals", "n_radicals", "not_equal", 0),
    Rule("max_ring_size", "max_ring", "above", 6),
    Rule("max_mol_weight", "weight", "above", 500.0),
    Rule("no_zwitterion", "charges", "both_signs"),
    Rule("no_isotope", "isotopes", "holds"),
    Rule("heteroatom_lone_pair", "atoms", "no_lone_pair", HETERO_ELEMENTS),
]


def molecule_rules(**values) -> Rules:
    """The rules on molecules with other values by reason; None, False or [] switches one off, but null_mol stays.

    A molecule without elements was never parsed and is null_mol; any other null feature fails its rule. The lone pair
    is asked of the elements of which one must be there; where none must be, it is off.
    """
    known = [r.reason for r in MOLECULE_RULES]
    if wrong := [k for k in values if k not in known or k == "null_mol"]:
        raise ValueError(f"unknown rules: {', '.join(wrong)}")
    wanted = values.get("require_any_elements", HETERO_ELEMENTS) or []
    if values.get("heteroatom_lone_pair", True):
        values["heteroatom_lone_pair"] = list(wanted)
    return Rules(more=[Rule(r.reason, r.column, r.test, values.get(r.reason, r.value)) for r in MOLECULE_RULES])


def passes_nine_rules() -> Column:
    """The fixed preset: the defaults without isotopes and lone pairs."""
    return rules_reason(molecule_rules(no_isotope=None, heteroatom_lone_pair=None)).isNull()

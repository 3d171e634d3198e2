"""Tax rates and category paths: parsing, legality, expectation, coherence, canonical spelling, gaps."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.config import RuleSet
from shelfwise.functions.text import normalize_label, strip_all


def parse_rate(raw: Column) -> Column:
    """'5,5' and '20%' as double; null where that is no number."""
    text = F.regexp_replace(F.translate(strip_all(F.coalesce(raw, F.lit(""))), ",", "."), "[%\\s]+$", "")
    return F.when(text.rlike("^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def rate_anomaly(rate: Column, rules: RuleSet) -> Column:
    return F.when(rate.isNull(), "vat_missing").when(~rate.isin(*rules.legal_rates), "vat_illegal_rate")


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def canonical_level(value: Column, level: int, rules: RuleSet) -> Column:
    """The reference spelling of a level's value, found by its canonical form; others stay."""
    from shelfwise.functions.plain import canonical

    spelled = {canonical(p[level]): p[level] for p in rules.paths}
    return F.coalesce(_literal_map(spelled)[normalize_label(value)], value)


def path_shape(levels: Sequence[Column], rules: RuleSet) -> Column:
    """'complete', 'taxonomy_gap', 'taxonomy_incomplete' or 'taxonomy_unknown_path'."""
    full = [F.coalesce(c, F.lit("")) != "" for c in levels]
    complete = full[0] & full[1] & full[2] & full[3]
    gap = F.lit(False)
    for k in range(3):
        later = F.lit(False)
        for c in full[k + 1 :]:
            later = later | c
        gap = gap | (~full[k] & later)
    known = F.concat_ws("\u0001", *levels).isin(*["\u0001".join(p) for p in rules.paths])
    return F.when(complete & known, "complete").when(complete, "taxonomy_unknown_path").when(gap, "taxonomy_gap").otherwise("taxonomy_incomplete")


def fill_gaps(levels: Sequence[Column], rules: RuleSet) -> list[Column]:
    """Empty levels 1 to 3 filled from a known leaf; what is there stays."""
    leaf = levels[3]
    out = []
    for k in range(3):
        reference = _literal_map({p: path[k] for p, path in rules.by_leaf.items()})[leaf]
        out.append(F.when(F.coalesce(levels[k], F.lit("")) == "", F.coalesce(reference, F.lit(""))).otherwise(levels[k]))
    return [*out, leaf]


def _first_hit(tokens: Column, candidates: dict, value) -> Column:
    """The value of the first candidate, in order, that shares a token."""
    options = [F.when(F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in words])), F.lit(value(name))) for name, words in candidates.items()]
    return F.coalesce(*options)


def expected_leaf(tokens: Column, rules: RuleSet) -> Column:
    return _first_hit(tokens, rules.keywords, lambda name: name)


def name_mismatch(tokens: Column, leaf: Column, rules: RuleSet) -> Column:
    expected = expected_leaf(tokens, rules)
    return F.coalesce(expected.isNotNull() & (leaf != "") & (expected != leaf), F.lit(False))


def _category(leaf: Column, rules: RuleSet) -> tuple[Column, Column]:
    expected = _literal_map({k: c.expected for k, c in rules.categories.items()})[leaf]
    accepted = F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(r) for r in c.accepted])) for k, c in rules.categories.items()))[leaf]
    return expected, accepted


def expected_rate(tokens: Column, leaf: Column, rate: Column, rules: RuleSet) -> Column:
    """From the keyword family; else from the category, unless the label contradicts it; a tolerated rate is its own expectation."""
    family = _first_hit(tokens, {k: f.tokens for k, f in rules.families.items()}, lambda name: rules.families[name].expected)
    expected, accepted = _category(leaf, rules)
    by_category = F.when(F.coalesce(F.array_contains(accepted, rate), F.lit(False)), rate).otherwise(expected)
    return F.coalesce(family, F.when(~name_mismatch(tokens, leaf, rules), by_category))


def coherent(rate: Column, expected: Column, leaf: Column, rules: RuleSet) -> Column:
    """No expectation, or met, or a rate that the category accepts."""
    _, accepted = _category(leaf, rules)
    return expected.isNull() | rate.eqNullSafe(expected) | F.coalesce(F.array_contains(accepted, rate), F.lit(False))

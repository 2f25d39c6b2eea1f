"""Metric names as column expressions: cleaned phrase, family and kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import first_of, let, squeezed


def normalize_attribute(attribute: Column) -> Column:
    text = F.lower(F.coalesce(attribute, F.lit("")))
    for pattern in (r"\([^)]*\)", r"[*#]", "(?iU)" + lx.PERIOD_WORDS, r"(?U)[^\w\s%\-]"):
        text = F.regexp_replace(text, pattern, " ")
    return F.array_join(F.filter(F.split(squeezed(text), " "), lambda w: ~w.isin("", *lx.SCOPE_WORDS)), " ")


def family(attribute: Column) -> Column:
    """The name under which metrics are compared. Only whole total-revenue phrases are `revenue`."""
    return let(normalize_attribute(attribute), lambda norm: _family(attribute, norm))


def _family(attribute: Column, norm: Column) -> Column:
    growth, nominal = F.lower(attribute).rlike("grow"), attribute.rlike(r"(?iU)\bnominal\b")

    def named(head: str) -> Column:
        if head not in ("gdp", "gva"):
            return F.lit(head)
        return F.when(growth & nominal, f"nominal {head} growth").when(growth, f"{head} growth").otherwise(head)

    heads = first_of((norm.rlike(rf"(?U)\b(?:{pattern})\b"), named(head)) for pattern, head in lx.FAMILY_HEADS)
    rest = F.array_join(F.filter(F.split(norm, " "), lambda w: ~w.isin(*lx.FILLER_WORDS)), " ")
    revenue = F.when(norm.isin(*lx.TOTAL_REVENUE), "revenue").otherwise(norm)
    return F.when(norm.rlike(r"(?U)\brevenues?\b|\bturnover\b"), revenue).otherwise(F.coalesce(heads, F.nullif(rest, F.lit("")), norm))


def family_kind(name: Column) -> Column:
    kinds = (("monetary", lx.MONETARY_FAMILIES), ("count", lx.COUNT_FAMILIES), ("percent", lx.PERCENT_FAMILIES))
    return F.coalesce(first_of((name.isin(*names), kind) for kind, names in kinds), F.lit("unknown"))


def is_junk(phrase: Column) -> Column:
    """Nothing but connecting words."""
    return F.size(F.filter(F.split(squeezed(phrase), " "), lambda w: ~w.isin("", *lx.NO_METRIC))) == 0


def fact_family(plain: Column, attribute: Column, is_percent: Column, evidence: Column) -> Column:
    """The family of a fact, of its attribute's: a percentage of GDP or GVA is a growth rate in a context of growth, else a share."""
    suffix = F.when(evidence.rlike("(?iU)" + lx.GROWTH), " growth").otherwise(" share")
    nominal = attribute.rlike(r"(?iU)\bnominal\b") | F.left(evidence, F.lit(120)).rlike(r"(?iU)\bnominal\b")
    return F.when(is_percent & plain.isin("gdp", "gva"), F.concat(F.when(nominal, "nominal ").otherwise(""), plain, suffix)).otherwise(plain)

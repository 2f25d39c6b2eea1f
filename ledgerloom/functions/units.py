"""Numbers, scales, currencies and their equivalence, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import first_of, let, strip

VALUE_TYPE = "struct<value:double,normalized_value:double,normalized_unit:string,currency:string,scale_word:string,is_percent:boolean,raw_number:string>"
_SCALES = lambda: F.create_map(*[F.lit(x) for x in chain.from_iterable(lx.SCALES.items())])


def currency(c: Column) -> Column:
    low = F.lower(c)
    return first_of((low.contains(mark), code) for mark, code in lx.CURRENCY_MARKS)


def is_percent(c: Column) -> Column:
    return F.lower(c).rlike("(?U)" + lx.PERCENT)


def number(token: Column) -> Column:
    """A token of the number pattern as a double; in parentheses it is negative."""
    bare = F.regexp_replace(F.regexp_replace(token, r"^[()]+|[()]+$", ""), ",", "")
    sign = F.when(token.startswith("(") & token.endswith(")"), -1.0).otherwise(1.0)
    return let(bare, lambda x: F.when(x.rlike(r"^-?\d+(\.\d+)?$"), x).try_cast("double")) * sign


def parse_value(raw: Column) -> Column:
    """A struct of VALUE_TYPE, or null where there is no number. Percents ignore their scale word."""

    def parts(text: Column) -> Column:
        token = F.nullif(F.regexp_extract(text, lx.NUMBER, 0), F.lit(""))
        return F.struct(token.alias("token"), F.substring(F.lower(text), F.regexp_instr(text, F.lit(lx.NUMBER)) + F.length(token), F.length(text)).alias("tail"), is_percent(text).alias("percent"), currency(text).alias("money"))

    def read(p: Column) -> Column:
        word = F.regexp_extract(p["tail"], "[a-z]+", 0)
        return F.struct(p["token"].alias("token"), p["percent"].alias("percent"), p["money"].alias("money"), number(p["token"]).alias("plain"), let(word, lambda w: F.when(w.isin(*lx.SCALES), w)).alias("scale"))

    def value(r: Column) -> Column:
        times = F.when(r["percent"], F.lit(1.0)).otherwise(F.coalesce(F.try_element_at(_SCALES(), r["scale"]), F.lit(1.0)))
        unit = F.when(r["percent"], "percent").otherwise(F.coalesce(r["money"], F.lit("count")))
        out = F.struct(
            (r["plain"] * times).alias("value"), (r["plain"] * times).alias("normalized_value"), unit.alias("normalized_unit"),
            F.when(~r["percent"], r["money"]).alias("currency"), r["scale"].alias("scale_word"), r["percent"].alias("is_percent"), r["token"].alias("raw_number"),
        )
        return F.when(r["plain"].isNotNull(), out)

    return let(let(let(strip(raw), parts), read), value)


def half_width(value: Column) -> Column:
    """Half of the last written digit's worth, in the base unit (of a percent with a scale word, too)."""
    digits = F.regexp_replace(F.regexp_replace(value["raw_number"], r"^[()]+|[()]+$", ""), ",", "")
    decimals = F.when(digits.contains("."), F.length(F.substring_index(digits, ".", -1))).otherwise(0)
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * F.coalesce(F.try_element_at(_SCALES(), value["scale_word"]), F.lit(1.0))


def difference(a: Column, b: Column) -> Column:
    return F.abs(a["normalized_value"] - b["normalized_value"])


def relative_difference(a: Column, b: Column) -> Column:
    return difference(a, b) / F.greatest(F.abs(a["normalized_value"]), F.abs(b["normalized_value"]), F.lit(1e-9))


def equivalent(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Same unit, and as near as the coarser writing or the tolerance allows."""
    near = (difference(a, b) <= F.greatest(half_width(a), half_width(b))) | (relative_difference(a, b) <= tolerance)
    return (a["normalized_unit"] == b["normalized_unit"]) & near


def _short(x: Column) -> Column:
    """Four significant digits without trailing zeros; from 10000 on and below 0.0001 with an exponent."""
    bare = lambda digits: F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    full = F.format_string("%.3e", x)
    science = F.concat(bare(F.regexp_extract(full, r"^([^e]*)", 1)), F.regexp_extract(full, r"(e.*)$", 1))
    return F.when(x == 0, "0").when((F.abs(x) >= 9999.5) | (F.abs(x) < 1e-4), science).otherwise(bare(F.format_string("%.4g", x)))


def equivalence_note(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Why two values count as equal or not."""
    diff, rel, width = difference(a, b), relative_difference(a, b), F.greatest(half_width(a), half_width(b))
    return (
        F.when(a["normalized_unit"] != b["normalized_unit"], F.format_string(lx.NOTE_UNITS, a["normalized_unit"], b["normalized_unit"]))
        .when(diff <= width, F.format_string(lx.NOTE_ROUNDING, _short(diff), _short(width)))
        .when(rel <= tolerance, F.format_string(lx.NOTE_RELATIVE, rel * 100, F.lit(tolerance * 100)))
        .when(diff.isNotNull(), F.format_string(lx.NOTE_DIFFER, rel * 100, _short(diff)))
    )


def page_scale(text: Column) -> Column:
    """The scale that a page states for its amounts."""
    pattern = "(?iU)" + lx.PAGE_SCALE
    word = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")))
    return F.nullif(F.regexp_replace(F.lower(word), "s+$", ""), F.lit(""))


def label_scale(label: Column) -> Column:
    low = F.lower(label)
    return first_of((low.rlike(rf"(?U)\bin\b.*\b{w}s?\b") | low.rlike(rf"\({w}s?\)"), w) for w in lx.LABEL_SCALES)


def label_currency(label: Column) -> Column:
    """The letters `rs` anywhere count as rupees; a dollar sign or code wins."""
    low = F.lower(label)
    return F.when(label.contains("$") | low.contains("usd"), "USD").when(label.contains("₹") | low.contains("rs") | low.contains("inr"), "INR")


def fact_type(value: Column) -> Column:
    return F.when(value.isNull(), "unknown").when(value["is_percent"], "percentage").when(value["currency"].isNotNull(), "monetary").otherwise("count")

"""Fiscal and calendar periods as column expressions. A fiscal year ends on 31 March."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import let, squeezed

PERIOD_TYPE = "struct<kind:string,raw:string,label:string,fy_end_year:int,quarter:int,start_date:date,end_date:date>"
_FLAGS = "(?iU)"


def period(kind: str, raw: Column, label: Column, year: Column, quarter: Column | None = None, end: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("kind"), raw.alias("raw"), label.alias("label"), year.cast("int").alias("fy_end_year"),
        (none if quarter is None else quarter).cast("int").alias("quarter"), none.cast("date").alias("start_date"),
        (none if end is None else end).cast("date").alias("end_date"),
    )


UNKNOWN = lambda: period("unknown", F.lit(""), F.lit(""), F.lit(None))


def fiscal_year_period(year: Column) -> Column:
    label = F.concat(F.lit("FY"), year.cast("string"))
    return period("fiscal_year", label, label, year)


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match, null if the group or the match is missing."""
    return F.nullif(F.regexp_extract(text, _FLAGS + pattern, i), F.lit(""))


def full_year(digits: Column) -> Column:
    """Two digits are years of this century."""
    return let(digits.try_cast("int"), lambda year: F.when(year < 100, year + 2000).otherwise(year))


def span_end(first: Column, last: Column) -> Column:
    """The year in which a span like 2024-25 or 1999-00 ends."""

    def end(x: Column) -> Column:
        same = F.floor(x["start"] / 100) * 100 + x["two"]
        return F.when(x["two"] >= 100, x["two"]).when(same < x["start"], same + 100).otherwise(same).cast("int")

    return let(F.struct(full_year(first).alias("start"), last.try_cast("int").alias("two")), end)


def date_in(text: Column) -> Column:
    """The first written date; null if there is none or the day does not exist."""
    short = F.array(*[F.lit(m[:3]) for m in lx.MONTHS])

    def day(match: Column) -> Column:
        month = F.array_position(short, F.lower(F.left(F.regexp_extract(match, "([A-Za-z]+)", 1), F.lit(3))))
        return F.format_string("%s-%02d-%s", F.right(match, F.lit(4)), month, F.lpad(F.regexp_extract(match, r"(\d{1,2})\b", 1), 2, "0")).try_cast("date")

    return let(_group(text, lx.DATE, 0), day)


def fiscal_year_of(day: Column) -> Column:
    return F.year(day) + (F.month(day) >= 4).cast("int")


def parse_period(text: Column) -> Column:
    """The strongest period in a text, a struct of PERIOD_TYPE; kind `unknown` if there is none."""

    def found(t: Column) -> Column:
        quarter = F.struct(*[_group(t, lx.QUARTER, i).alias(n) for i, n in enumerate(("all", "q", "year", "last"))])
        span = F.struct(*[_group(t, lx.YEAR_SPAN, i).alias(n) for i, n in enumerate(("all", "first", "last"))])
        single = F.struct(*[_group(t, lx.FISCAL_YEAR, i).alias(n) for i, n in enumerate(("all", "year"))])
        return F.struct(
            t.alias("t"), F.left(t, F.lit(80)).alias("head"), quarter.alias("quarter"), span.alias("span"), single.alias("single"),
            F.when(~F.lower(t).contains("year ended"), date_in(_group(t, lx.MONTHS_ENDED, 2))).alias("range_day"),
            date_in(_group(t, lx.YEAR_ENDED, 1)).alias("year_day"), _group(t, lx.AS_OF, 0).alias("as_of"), date_in(_group(t, lx.AS_OF, 1)).alias("at_day"),
            date_in(t).alias("day"), _group(t, lx.CALENDAR_YEAR, 0).alias("calendar"),
        )

    def ended(f: Column) -> Column:
        """The years of the candidates."""
        q = f["quarter"]
        return F.struct(
            f.alias("f"), F.when(q["last"].isNotNull(), span_end(q["year"], q["last"])).otherwise(full_year(q["year"])).alias("quarter_end"),
            span_end(f["span"]["first"], f["span"]["last"]).alias("span_end"), full_year(f["single"]["year"]).alias("single_year"),
        )

    def strongest(e: Column) -> Column:
        f = e["f"]
        written = lambda d: F.date_format(d, "yyyy-MM-dd")
        fiscal = lambda raw, year, end=None: period("fiscal_year", raw, F.concat(F.lit("FY"), year.cast("string")), year, end=end)
        on_day = lambda raw, d: period("as_of", raw, F.concat(F.lit("as of "), written(d)), fiscal_year_of(d), end=d)
        q, day = f["quarter"], f["day"]
        return (
            F.when(q["q"].isNotNull(), period("quarter", F.trim(q["all"]), F.format_string("Q%s FY%d", q["q"], e["quarter_end"]), e["quarter_end"], q["q"]))
            .when(f["range_day"].isNotNull(), period("range", f["head"], F.concat(F.lit("period ended "), written(f["range_day"])), fiscal_year_of(f["range_day"]), end=f["range_day"]))
            .when(f["year_day"].isNotNull(), fiscal(f["head"], fiscal_year_of(f["year_day"]), f["year_day"]))
            .when(f["at_day"].isNotNull(), on_day(F.left(F.trim(f["as_of"]), F.lit(80)), f["at_day"]))
            .when(f["span"]["last"].isNotNull(), fiscal(F.trim(f["span"]["all"]), e["span_end"]))
            .when(f["single"]["year"].isNotNull(), fiscal(F.trim(f["single"]["all"]), e["single_year"]))
            .when((F.month(day) == 3) & (F.dayofmonth(day) == 31), fiscal(f["head"], fiscal_year_of(day), day))
            .when(day.isNotNull(), on_day(f["head"], day))
            .when(f["calendar"].isNotNull(), period("calendar_year", f["calendar"], F.concat(F.lit("CY"), f["calendar"]), F.lit(None), end=F.concat(f["calendar"], F.lit("-12-31")).try_cast("date")))
            .otherwise(UNKNOWN())
        )

    return let(let(let(squeezed(F.coalesce(text, F.lit(""))), found), ended), strongest)


def column_period(c: Column) -> Column:
    """The period of a table's column, of a struct (kind, raw, year, quarter, day); null for none."""
    year, day = c["year"].cast("string"), F.date_format(c["day"], "yyyy-MM-dd")
    label = (
        F.when(c["kind"] == "quarter", F.concat(F.lit("Q"), c["quarter"].cast("string"), F.lit(" FY"), year)).when(c["kind"] == "fiscal_year", F.concat(F.lit("FY"), year))
        .when(c["kind"] == "calendar_year", F.concat(F.lit("CY"), F.year(c["day"]).cast("string"))).when(c["kind"] == "range", F.concat(F.lit("period ended "), day)).otherwise(F.concat(F.lit("as of "), day))
    )
    out = F.struct(c["kind"].alias("kind"), c["raw"].alias("raw"), label.alias("label"), c["year"].alias("fy_end_year"), c["quarter"].alias("quarter"), F.lit(None).cast("date").alias("start_date"), c["day"].alias("end_date"))
    return F.when(c.isNotNull(), out)


def period_key(p: Column) -> Column:
    """Equal for periods that may be compared."""
    return let(p, _key)


def _key(p: Column) -> Column:
    year = p["fy_end_year"].cast("string")
    return (
        F.when((p["kind"] == "quarter") & p["quarter"].isNotNull() & year.isNotNull(), F.concat(F.lit("Q"), p["quarter"].cast("string"), F.lit("-FY"), year))
        .when((p["kind"] == "fiscal_year") & year.isNotNull(), F.concat(F.lit("FY"), year))
        .when((p["kind"] == "calendar_year") & p["end_date"].isNotNull(), F.concat(F.lit("CY"), F.year(p["end_date"]).cast("string")))
        .when(p["kind"].isin("as_of", "range") & p["end_date"].isNotNull(), F.concat(p["kind"], F.lit(":"), F.date_format(p["end_date"], "yyyy-MM-dd")))
        .otherwise(F.coalesce(F.nullif(p["label"], F.lit("")), F.nullif(p["raw"], F.lit("")), F.lit("unknown")))
    )


def document_years(text: Column) -> Column:
    """All fiscal years that a text names, in order (case counts)."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + lx.DOCUMENT_FISCAL_YEAR), F.lit(1)), full_year)

"""Text columns: white space, cues, footnotes, sentences and small predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: nested expressions keep their size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def first_of(pairs) -> Column:
    """The value of the first condition that holds, else null."""
    return F.coalesce(*[F.when(condition, F.lit(value) if not isinstance(value, Column) else value) for condition, value in pairs])


def status(c: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return first_of((padded.contains(cue), name) for name, cues in lx.STATUS_CUES for cue in cues)


def scope(c: Column) -> Column:
    return first_of((F.lower(c).contains(cue), name) for name, cues in lx.SCOPE_CUES for cue in cues)


def footnote_markers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\((\d)\)"), F.lit(1))


def sentences(c: Column) -> Column:
    """Sentences in order. A blank line ends a paragraph, a single line break is a wrap."""
    # without look-around on ends of matches, paragraphs are split first
    paragraphs = F.split(F.regexp_replace(F.regexp_replace(c, r"\n[ \t]*\n", "\u0000"), r"(?U)\s*\n\s*", " "), "\u0000")
    parts = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "(?U)" + lx.SENTENCE_BREAK)))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def is_numeric_cell(c: Column) -> Column:
    cell = strip(c)
    return cell.rlike(lx.NUMERIC_CELL) & ~cell.rlike(lx.FOOTNOTE_CELL)


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def is_scanned(c: Column) -> Column:
    """Pages with hardly any text."""
    return F.length(strip(F.coalesce(c, F.lit("")))) < 20


def printed_page(c: Column) -> Column:
    """The number printed on the last, else on the first line of a page."""
    edge = lines(F.coalesce(c, F.lit("")))
    pick = lambda line: F.coalesce(
        F.nullif(F.regexp_extract(line, r"^(\d{1,4})$", 1), F.lit("")),
        F.nullif(F.regexp_extract(line, r"(?i)^(?:page\s+)?(\d{1,4})(?:\s+of\s+\d{1,4})?$", 1), F.lit("")),
    )
    return F.coalesce(pick(F.try_element_at(edge, F.lit(-1))), pick(F.try_element_at(edge, F.lit(1))))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")

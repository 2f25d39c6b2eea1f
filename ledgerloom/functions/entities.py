"""Entity names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import let, squeezed, strip

_SUFFIXES = "|".join(lx.LEGAL_SUFFIXES)


def normalize_entity(name: Column) -> Column:
    """A lower-case key without punctuation, `the` and trailing legal suffixes."""
    words = F.split(squeezed(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)[^\w\s]", " ")), " ")
    joined = F.array_join(F.filter(words, lambda w: ~w.isin("", "the")), " ")
    return F.trim(F.regexp_replace(joined, rf"(?:(?:^| )(?:{_SUFFIXES}))+$", ""))


def display_entity(name: Column) -> Column:
    """The name as written, without trailing legal suffixes; a name of nothing else stays."""
    flat = squeezed(name)
    short = F.regexp_replace(flat, rf"(?i)(?:(?:^| )\.*(?:{_SUFFIXES})\.*)+$", "")
    return F.when(short == "", strip(name)).otherwise(short)


def is_generic(name: Column) -> Column:
    return F.lower(strip(name)).isin(*lx.GENERIC_NAMES)


def resolve_entity(raw: Column, primary: Column) -> Column:
    """The display name of a fact's entity: generic and missing names mean the document's primary entity."""
    given = F.nullif(raw, F.lit(""))
    base = F.when(given.isNull() | is_generic(given), F.coalesce(F.nullif(primary, F.lit("")), given, F.lit("Unknown"))).otherwise(given)
    return let(base, display_entity)


def sentence_entity(sentence: Column) -> Column:
    """A subject that opens a sentence: a possessive, or capitalised words before a reporting verb."""
    return F.coalesce(*[F.nullif(F.regexp_extract(sentence, "(?U)" + p, 1), F.lit("")) for p in (lx.POSSESSIVE, lx.SUBJECT)])


def hint_tokens(file_name: Column) -> Column:
    """Words of a file name that may name its subject."""
    words = F.split(F.lower(F.coalesce(file_name, F.lit(""))), "[^A-Za-z]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*lx.NO_HINT))

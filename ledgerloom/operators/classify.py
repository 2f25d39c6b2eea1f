"""How two facts relate: one ordered list of rules as a column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..config import EngineConfig
from ..functions import units as U
from ..functions.similarity import similarity
from ..sources.shared import written
from .candidates import entity_key

#: What the rules read of a fact, beside its parsed raw value.
READS = ["fact_id", "canonical_entity", "canonical_attribute", "fact_type", "raw_value", "raw_unit", "normalized_unit", "period", "period_key", "status", "scope", "definition", "document_name", "page", "confidence"]
MONEY = ["INR", "USD", "EUR", "GBP"]
BASES = ["actual", "estimate", "forecast", "revised", "budget"]


def prepared(facts: DataFrame) -> DataFrame:
    """What the rules read, with the raw value parsed once a fact."""
    return facts.select(*READS, "seq", U.parse_value(F.col("raw_value")).alias("parsed"))


def _meaning(c: str) -> Column:
    return F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))


def paired(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """(a, b, likeness): both facts of each pair as structs, and how alike their definitions are (null unless both have one). New facts may share an id; seq tells which one is meant."""
    pairs = written(pairs.select("a_id", "a_seq", "b_id"), "pairs")  # ids only; read for the definitions and for the facts
    defined_a = new.select(F.col("fact_id").alias("a_id"), F.col("seq").alias("a_seq"), _meaning("definition").alias("m_a")).where("m_a IS NOT NULL")
    defined_b = old.select(F.col("fact_id").alias("b_id"), _meaning("definition").alias("m_b")).where("m_b IS NOT NULL")
    meanings = pairs.join(defined_a, ["a_id", "a_seq"]).join(defined_b, "b_id").select("m_a", "m_b").distinct()  # each pair of definitions is scored once
    scored = meanings.withColumn("likeness", similarity(F.col("m_a"), F.col("m_b")))
    a = prepared(new).select(F.col("fact_id").alias("a_id"), F.col("seq").alias("a_seq"), F.struct(*READS, "parsed").alias("a"), _meaning("definition").alias("m_a"))
    b = prepared(old).select(F.col("fact_id").alias("b_id"), F.struct(*READS, "parsed").alias("b"), _meaning("definition").alias("m_b"))
    return pairs.join(a, ["a_id", "a_seq"]).join(b, "b_id").join(scored, ["m_a", "m_b"], "left").select("a", "b", "likeness")


def _compatible(a: Column, b: Column) -> Column:
    unit = lambda x: F.when(x["normalized_unit"].isin(*MONEY), "money").otherwise(x["normalized_unit"])
    some = lambda x: F.coalesce(x["normalized_unit"], F.lit("")) != ""
    return F.when(some(a) & some(b), unit(a) == unit(b)).otherwise(a["fact_type"] == b["fact_type"])


def _shown(f: Column) -> Column:
    return F.concat(f["raw_value"], F.lit(" ("), f["document_name"], F.lit(", p."), f["page"].cast("string"), F.lit(")"))


def _differences(pairs: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds what the rules ask about: the value relation and the differences of context."""
    a, b = F.col("a"), F.col("b")
    text = lambda x: F.coalesce(x, F.lit(""))
    stated = lambda x: x["scope"].isin("standalone", "consolidated")
    scopes = F.when((text(a["scope"]) != "") & (text(b["scope"]) != ""), a["scope"] != b["scope"]).otherwise(F.coalesce(stated(a), F.lit(False)) != F.coalesce(stated(b), F.lit(False)))
    bases = a["status"].isin(*BASES) & b["status"].isin(*BASES) & (a["status"] != b["status"])
    known = (a["period"]["kind"] != "unknown") & (b["period"]["kind"] != "unknown")
    label = lambda x: F.coalesce(F.nullif(x["period"]["label"], F.lit("")), x["period_key"])
    out = pairs.withColumns({
        "compatible": _compatible(a, b), "readable": a["parsed"].isNotNull() & b["parsed"].isNotNull(),
        "equal": U.equivalent(a["parsed"], b["parsed"], config.rel_tolerance), "note": U.equivalence_note(a["parsed"], b["parsed"], config.rel_tolerance),
        "known": known, "same": known & (a["period_key"] == b["period_key"]), "base": F.least(a["confidence"], b["confidence"]),
        "by_scope": scopes, "by_basis": bases, "label_a": label(a), "label_b": label(b),
    })
    out = out.withColumn("by_meaning", F.coalesce(F.col("likeness") < config.definition_threshold, F.lit(False)))
    versus = lambda what, x, y: F.format_string(lx.DIFFERENT_VALUES.replace("{what}", what), x, y)
    units = (text(a["raw_unit"]) != "") & (text(b["raw_unit"]) != "") & (a["raw_unit"] != b["raw_unit"])
    plain = lambda x: F.coalesce(F.nullif(x["scope"], F.lit("")), F.lit("unspecified"))
    return out.withColumns({
        "d_unit": F.when(units, versus("units", a["raw_unit"], b["raw_unit"])), "d_scope": F.when(F.col("by_scope"), versus("scope", plain(a), plain(b))),
        "d_meaning": F.when(F.col("by_meaning"), lx.DIFFERENT_DEFINITIONS), "d_basis": F.when(F.col("by_basis"), versus("reporting basis", a["status"], b["status"])),
    })


def classified(pairs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Relationships of pairs (a, b, likeness). Facts of different entities have none."""
    rows = _differences(pairs.where(entity_key(F.col("a.canonical_entity")) == entity_key(F.col("b.canonical_entity"))), config)
    a, b, c = F.col("a"), F.col("b"), F.col
    both, note = F.array_compact(F.array("d_unit", "d_scope", "d_meaning", "d_basis")), c("note")
    subject = F.concat(a["canonical_entity"], F.lit(" — "), a["canonical_attribute"])
    timed = F.concat(subject, F.lit(" for "), c("label_a"), F.lit(": "))
    facts = F.concat(_shown(a), F.lit(" and "), _shown(b))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    structural = F.array_join(F.array_compact(F.array("d_scope", "d_meaning")), ", ")
    also = F.when(F.size(both) > 0, F.concat(F.lit("; also "), F.array_join(both, ", "))).otherwise("")
    units = F.coalesce(F.concat(F.lit(", written in "), c("d_unit")), F.lit(""))
    vintage = F.when(c("by_basis"), say(" One is of the basis ", a["status"], ", the other ", b["status"], ": a later vintage may explain it.")).otherwise("")
    firm = F.round(F.least(F.lit(0.9), F.lit(0.6) + F.lit(0.3) * c("base")), 3)
    apart = F.round(F.lit(0.7) * (F.lit(0.7) + c("base")), 3)

    # in this order: the first condition that holds decides
    rules = [
        ("R1", ~c("compatible"), "related_not_comparable", F.lit(0.4),
         say(subject, ": units ", F.coalesce(a["normalized_unit"], F.lit("None")), " and ", F.coalesce(b["normalized_unit"], F.lit("None")), " measure different things.")),
        ("R2", ~c("readable"), "uncertain", F.lit(0.3), F.lit("A value that cannot be read leaves nothing to compare.")),
        ("R3a", ~c("known") & c("equal"), "corroborates", F.round(F.lit(0.55) * (F.lit(0.6) + c("base")), 3),
         say(subject, ": ", facts, " match (", note, "); a missing period makes this weak support.")),
        ("R3b", ~c("known"), "uncertain", F.lit(0.35), say(subject, ": no match (", note, "); without both periods that is no contradiction yet.")),
        ("R4", ~c("same"), "contextually_different", apart, say(subject, ": the period of ", _shown(a), " is ", c("label_a"), ", that of ", _shown(b), " is ", c("label_b"), also, ".")),
        ("R5", c("equal"), "corroborates", F.round(F.least(F.lit(0.99), F.lit(0.75) + F.lit(0.2) * c("base")), 3), say(timed, facts, " are one figure (", note, ")", units, ".")),
        ("R6", c("by_scope") | c("by_meaning"), "contextually_different", apart, say(timed, facts, " do not match (", note, "); they have ", structural, ".")),
        ("R7", c("base") < 0.65, "uncertain", F.round(F.lit(0.3) + F.lit(0.2) * c("base"), 3), say(timed, facts, " do not match (", note, "), but one of them was read with little confidence.")),
        ("R8", F.lit(True), "contradicts", F.when(c("by_basis"), F.round(firm * 0.85, 3)).otherwise(firm), say(timed, facts, " cannot both hold (", note, ").", vintage)),
    ]
    pick = lambda i: F.coalesce(*[F.when(F.coalesce(r[1], F.lit(False)), F.lit(r[i]) if isinstance(r[i], str) else r[i]) for r in rules])
    factors = (
        F.when(c("rule") == "R1", F.create_map(F.lit("type_a"), F.coalesce(a["normalized_unit"], F.lit("")), F.lit("type_b"), F.coalesce(b["normalized_unit"], F.lit(""))))
        .when(c("rule") == "R2", F.create_map().cast("map<string,string>"))
        .otherwise(F.create_map(F.lit("same_period"), F.when(c("same"), "True").otherwise("False"), F.lit("value_relation"), note, F.lit("period_a"), c("label_a"), F.lit("period_b"), c("label_b")))
    )
    ends = [F.least(a["fact_id"], b["fact_id"]), F.greatest(a["fact_id"], b["fact_id"])]
    return rows.withColumn("rule", pick(0)).select(
        F.left(F.sha1(F.concat_ws("|", *ends).cast("binary")), F.lit(16)).alias("relationship_id"), a["fact_id"].alias("fact_a_id"), b["fact_id"].alias("fact_b_id"),
        pick(2).alias("relation"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), pick(3))), 3).alias("confidence"), pick(4).alias("explanation"),
        factors.alias("reasoning_factors"), F.when(c("rule").isin("R1", "R2"), F.array().cast("array<string>")).otherwise(both).alias("context_differences"), F.lit("deterministic").alias("method"), "rule",
    )

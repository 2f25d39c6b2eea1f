"""Pairs of facts of different documents that may speak of one thing.

Two joins with equality keys, never one with OR: facts of one entity and family, and facts of one
entity and type whose phrases are nearly the same. Similarity is scored once for each distinct
pair of phrases. The later document's fact comes first in a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.similarity import similarity
from ..functions.text import strip


def entity_key(c: Column) -> Column:
    return F.lower(strip(c))


def stored(facts: DataFrame) -> DataFrame:
    """What a store keeps: of facts with one id, the last."""
    rank = F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("ingest_seq"), F.desc("seq")))
    return facts.withColumn("rank", rank).where("rank = 1").drop("rank")


def _side(facts: DataFrame, prefix: str) -> DataFrame:
    return facts.select(
        entity_key(F.col("canonical_entity")).alias("entity_key"), F.col("canonical_attribute").alias(f"{prefix}_family"), F.col("fact_type").alias(f"{prefix}_type"),
        F.coalesce("norm_attr", "canonical_attribute").alias(f"{prefix}_phrase"), F.col("fact_id").alias(f"{prefix}_id"), F.col("ingest_seq").alias(f"{prefix}_doc"), F.col("seq").alias(f"{prefix}_seq"),
        F.col("period_key").alias(f"{prefix}_period"))


_PAIR = ["a_id", "b_id", "a_doc", "b_doc", "a_seq", "b_seq"]
UNKNOWN = "unknown"


def exact_pairs(new: DataFrame, old: DataFrame, all_periods: bool = True) -> DataFrame:
    """By entity and family; shares of something are compared with nothing.

    Without all_periods, pairs are made of one period or with an unknown one, by joins that have the
    period in their key: the pairs of a dominant entity and family then grow with its facts of one
    period instead of with the square of all.
    """
    sides = [_side(rows.where(~F.col("canonical_attribute").endswith("share")), x).withColumnRenamed(f"{x}_family", "family") for rows, x in ((new, "a"), (old, "b"))]
    a, b = sides
    keys = ["entity_key", "family"]
    if all_periods:
        found = a.join(b, keys)
    else:
        dated = lambda side, x: side.where(F.col(f"{x}_period") != UNKNOWN)
        undated = lambda side, x: side.where(F.col(f"{x}_period") == UNKNOWN)
        same = dated(a, "a").withColumnRenamed("a_period", "period").join(dated(b, "b").withColumnRenamed("b_period", "period"), [*keys, "period"])
        found = same.select(*_PAIR).unionByName(undated(a, "a").join(b, keys).select(*_PAIR)).unionByName(dated(a, "a").join(undated(b, "b"), keys).select(*_PAIR))
    return found.where("a_doc > b_doc").select(*_PAIR, F.lit("exact").alias("via"))


def period_contrasts(facts: DataFrame) -> DataFrame:
    """entity, family, period_a, period_b, pairs: how many pairs of facts of two documents speak of one thing at two known periods. Classes are counted, no pair is made; exact_pairs() of the facts of one class gives its pairs."""
    rows = facts.where((F.col("period_key") != UNKNOWN) & ~F.col("canonical_attribute").endswith("share"))
    thing = [F.col("canonical_entity").alias("entity"), F.col("canonical_attribute").alias("family")]
    by_document = rows.groupBy(*thing, "period_key", "document_id").agg(F.count("*").alias("n"))
    by_class = by_document.groupBy("entity", "family", "period_key").agg(F.sum("n").alias("n"))

    def crossed(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
        a, b = (counts.withColumnsRenamed({"period_key": f"period_{x}", "n": f"n_{x}"}) for x in "ab")
        return a.join(b, keys).where("period_a < period_b").groupBy("entity", "family", "period_a", "period_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias(name))

    keys = ["entity", "family"]
    inside = crossed(by_document, [*keys, "document_id"], "inside")
    out = crossed(by_class, keys, "all").join(inside, [*keys, "period_a", "period_b"], "left")
    return out.withColumn("pairs", F.col("all") - F.coalesce("inside", F.lit(0))).where("pairs > 0").select(*keys, "period_a", "period_b", "pairs")


def lexical_pairs(new: DataFrame, old: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """By entity and type, other families, phrases alike."""
    a = _side(new.where(~F.col("canonical_attribute").endswith("share")), "a").withColumnRenamed("a_type", "fact_type")
    b = _side(old, "b").withColumnRenamed("b_type", "fact_type")
    keys = ["entity_key", "fact_type"]
    phrases = a.select(*keys, "a_phrase", "a_family").distinct().join(b.select(*keys, "b_phrase", "b_family").distinct(), keys).where("a_family != b_family")
    alike = phrases.select("a_phrase", "b_phrase").distinct().withColumn("score", similarity(F.col("a_phrase"), F.col("b_phrase"))).where(F.col("score") >= config.lexical_threshold)
    found = phrases.join(alike.select("a_phrase", "b_phrase"), ["a_phrase", "b_phrase"])
    pairs = a.join(found, [*keys, "a_phrase", "a_family"]).join(b, [*keys, "b_phrase", "b_family"]).where("a_doc > b_doc")
    if not config.all_periods:
        pairs = pairs.where((F.col("a_period") == F.col("b_period")) | (F.col("a_period") == UNKNOWN) | (F.col("b_period") == UNKNOWN))
    return pairs.select(*_PAIR, F.lit("lexical").alias("via"))


def candidate_pairs(new: DataFrame, old: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Every unordered pair of fact ids once: the exact one before the lexical one, then the first fact."""
    both = exact_pairs(new, old, config.all_periods).unionByName(lexical_pairs(new, old, config)).where("a_id != b_id")
    ids = [F.least("a_id", "b_id"), F.greatest("a_id", "b_id")]
    rank = F.row_number().over(Window.partitionBy(*ids).orderBy("a_doc", "via", "a_seq", "b_doc", "b_seq"))
    return both.withColumn("rank", rank).where("rank = 1").select("a_id", "b_id", "a_seq", "via")

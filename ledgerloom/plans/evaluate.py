"""Evaluation: grounding, confusion of expected and found relations, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATIONS = ["corroborates", "contradicts", "contextually_different", "uncertain", "related_not_comparable", "none"]


def grounding(facts: DataFrame) -> DataFrame:
    """One row: facts, grounded (a text and a page from 1 on), rate."""
    ok = (F.trim(F.coalesce("evidence", F.lit(""))) != "") & (F.col("page") >= 1)
    return facts.agg(F.count("*").alias("facts"), F.count_if(ok).alias("grounded")).withColumn("rate", F.col("grounded") / F.greatest("facts", F.lit(1)))


def confusion(cases: DataFrame) -> DataFrame:
    """(expected, and a count for each relation) of cases (expected, predicted); no prediction counts as `none`."""
    predicted = F.coalesce("predicted", F.lit("none"))
    return cases.groupBy("expected").agg(*[F.count_if(predicted == r).alias(r) for r in RELATIONS])


def accuracy(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.count_if(F.col("expected").eqNullSafe(F.col("predicted"))).alias("correct")).withColumn("accuracy", F.try_divide("correct", "cases"))


def labelled(cases: DataFrame, facts: DataFrame, rels: DataFrame) -> DataFrame:
    """cases (name, entity, family, doc_a, value_a, doc_b, value_b, expected) with the relation found between the first facts that fit."""
    out = cases
    for x in ("a", "b"):
        near = facts.select(F.col("canonical_entity").alias("entity"), F.col("canonical_attribute").alias("family"), "document_name", "raw_value", "fact_id", "ingest_seq", "seq")
        fits = cases.join(near, ["entity", "family"]).where(F.col("document_name").contains(F.col(f"doc_{x}")) & F.regexp_replace("raw_value", " ", "").contains(F.regexp_replace(f"value_{x}", " ", "")))
        best = fits.groupBy("name").agg(F.min_by("fact_id", F.struct("ingest_seq", "seq")).alias(f"id_{x}"))
        out = out.join(best, "name", "left")
    ends = rels.select(F.least("fact_a_id", "fact_b_id").alias("lo"), F.greatest("fact_a_id", "fact_b_id").alias("hi"), F.col("relation").alias("predicted"))
    return out.withColumns({"lo": F.least("id_a", "id_b"), "hi": F.greatest("id_a", "id_b")}).join(ends, ["lo", "hi"], "left").select(*cases.columns, "predicted")

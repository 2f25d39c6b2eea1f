"""Accounting identities inside a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..config import EngineConfig


def identity_checks(facts: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """One row for each identity whose figures stand together: the best fact of each family, on pages one apart at most."""
    money = facts.where("normalized_value IS NOT NULL AND fact_type = 'monetary'")
    names = sorted({n for result, parts in lx.IDENTITIES for n in (result, *parts)})
    rows = money.where(F.col("canonical_attribute").isin(*names)).withColumn("scope_key", F.coalesce("scope", F.lit("")))
    keys = ["document_id", "canonical_entity", "period_key", "scope_key", "normalized_unit"]
    rank = F.row_number().over(Window.partitionBy(*keys, "canonical_attribute").orderBy(F.desc("confidence"), "seq"))
    best = rows.withColumn("rank", rank).where("rank = 1")
    fact = F.struct("normalized_value", "raw_value", "page", "document_name", F.col("period.label").alias("label"), F.col("canonical_attribute").alias("family"))
    wide = best.groupBy(*keys).agg(*[F.first(F.when(F.col("canonical_attribute") == n, fact), ignorenulls=True).alias(n) for n in names])
    out = None
    for result, parts in lx.IDENTITIES:
        r, cs = F.col(f"`{result}`"), [F.col(f"`{p}`") for p in parts]
        pages = [r["page"], *(c["page"] for c in cs)]
        total = sum((c["normalized_value"] for c in cs), F.lit(0.0))
        some = wide.where(r.isNotNull())
        for c in cs:
            some = some.where(c.isNotNull())
        some = some.where(F.greatest(*pages) - F.least(*pages) <= 1)
        delta = F.abs(r["normalized_value"] - total)
        one = some.select(
            "document_id", r["document_name"].alias("document_name"), F.col("canonical_entity").alias("entity"), F.coalesce(F.nullif(r["label"], F.lit("")), F.col("period_key")).alias("period"),
            F.nullif("scope_key", F.lit("")).alias("scope"), F.lit(f"{result} = {' + '.join(parts)}").alias("identity"), F.lit(result).alias("result_family"),
            r["normalized_value"].alias("result_value"), total.alias("computed_value"), delta.alias("delta"),
            (delta / F.greatest(F.abs(r["normalized_value"]), F.lit(1e-9)) <= max(config.rel_tolerance, 0.01)).alias("ok"), F.col("normalized_unit").alias("unit"),
            F.array(*[F.struct(c["family"].alias("family"), c["raw_value"].alias("raw_value"), c["page"].alias("page")) for c in cs]).alias("components"), r["page"].alias("result_page"),
        )
        out = one if out is None else out.unionByName(one)
    return out

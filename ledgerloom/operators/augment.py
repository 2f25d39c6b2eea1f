"""Facts from answers of an outside model, given as JSON beside the pages.

No model is called here: answers come as a table (document_id, page, answer). An answer that is no
JSON of the expected shape yields nothing, and a fact whose evidence is not in the page is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import entities as E
from ..functions import periods as P
from ..functions import text as X
from ..functions import units as U
from ..sources.shared import written

SHAPE = "struct<facts:array<struct<entity:string,attribute:string,value:string,period:string,scope:string,status:string,evidence:string>>>"
STATUSES = ["actual", "estimate", "forecast", "revised", "budget"]
SHORTEST_PAGE, CONFIDENCE = 40, 0.65


def augmented(pages: DataFrame, answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the columns of facts.extracted(); seq puts them behind those of the page's own text."""
    json = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)  # from the first brace to the last
    asked = pages.where(F.length(X.strip(F.coalesce("text", F.lit("")))) >= SHORTEST_PAGE).join(answers, ["document_id", "page"]).join(entities, "document_id", "left")
    rows = asked.withColumn("said", F.from_json(json, SHAPE)).select(
        "document_id", "document_name", "ingest_seq", "page", "text", "primary_entity", X.printed_page(F.col("text")).alias("printed_page"), F.posexplode("said.facts").alias("ordinal", "f"))
    f = F.col("f")
    rows = rows.where(f["attribute"].isNotNull() & f["value"].isNotNull() & f["evidence"].isNotNull() & F.col("text").contains(f["evidence"]))
    rows = rows.withColumns({"parsed": U.parse_value(f["value"]), "norm_attr": A.normalize_attribute(f["attribute"]), "family": A.family(f["attribute"]), "period": P.parse_period(F.coalesce(f["period"], F.lit("")))})
    rows = written(rows, "answers").where("parsed IS NOT NULL AND norm_attr != ''")
    key = F.concat_ws("|", F.lit("llm"), "document_id", F.col("page").cast("string"), f["attribute"], f["value"])
    entity = F.nullif(f["entity"], F.lit(""))
    return rows.select(
        F.left(F.sha1(key.cast("binary")), F.lit(16)).alias("fact_id"), F.coalesce(entity, F.col("primary_entity")).alias("entity"), E.resolve_entity(entity, F.col("primary_entity")).alias("canonical_entity"),
        F.left(f["attribute"], F.lit(160)).alias("attribute"), F.col("family").alias("canonical_attribute"), "norm_attr", U.fact_type(F.col("parsed")).alias("fact_type"), F.left(f["value"], F.lit(80)).alias("raw_value"),
        F.col("parsed.value").alias("value"), F.lit(None).cast("string").alias("raw_unit"), "parsed.normalized_value", "parsed.normalized_unit", "parsed.currency", "period", P.period_key(F.col("period")).alias("period_key"),
        F.lit(None).cast("date").alias("as_of_date"), F.when(f["status"].isin(*STATUSES), f["status"]).otherwise("unknown").alias("status"), f["scope"].alias("scope"), F.lit(None).cast("string").alias("definition"),
        F.create_map(F.lit("norm_attr"), F.col("norm_attr")).alias("qualifiers"), "document_id", "document_name", "ingest_seq", "page", "printed_page", F.left(f["evidence"], F.lit(600)).alias("evidence"),
        F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), F.lit(CONFIDENCE).alias("confidence"), F.lit("llm_assisted").alias("method"),
        F.struct("page", (F.col("ordinal") + 1_000_000).cast("int").alias("ordinal")).alias("seq"),
    )

"""What the store answers: scans, search, top lists, joins, deletes and merges, each one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATION_ORDER = ["contradicts", "corroborates", "contextually_different", "uncertain", "related_not_comparable"]


def merged(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """old and new by key; new rows replace old ones, of new rows with one key the last stays."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) for o in order]))
    last = new.withColumn("rank", rank).where("rank = 1").drop("rank")
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def upserted_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents by id: a known one keeps what it was first stored with and takes over its state and counters."""
    changing = ["status", "error", "primary_entity", "fact_count", "relationship_count", "processing_ms", "llm_calls"]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, "document_id", "full")
    is_new, is_known = F.col("n.status").isNotNull(), F.col("o.status").isNotNull()
    pick = lambda c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in changing else F.when(is_known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select("document_id", *[pick(c).alias(c) for c in old.columns if c != "document_id"])


def documents_list(documents: DataFrame) -> DataFrame:
    """The newest first."""
    return documents.orderBy(F.desc("ingest_seq"), "document_id")


def one(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The row of one id: none if it is unknown."""
    return rows.where(F.col(key) == value)


def these(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of many ids (the column `key` of a table); an id that comes twice is looked up once."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def by_content(documents: DataFrame, content: bytes) -> DataFrame:
    """The documents (document_id, ...) that these bytes are."""
    import hashlib

    return one(documents, "document_id", hashlib.sha256(content).hexdigest()[:16])


def facts_of_document(facts: DataFrame, document_id: str) -> DataFrame:
    return one(facts, "document_id", document_id).orderBy("page", "seq")


def amounts_shown(value: Column) -> Column:
    """Large numbers in short: B, Cr and L from 1e9, 1e7 and 1e5 on."""
    short = [(1e9, "B"), (1e7, "Cr"), (1e5, "L")]
    out = F.coalesce(*[F.when(F.abs(value) >= least, F.concat(F.format_string("%.2f", value / least), F.lit(f" {name}"))) for least, name in short])
    return F.coalesce(out, F.format_number(value, 2))


def facts_list(facts: DataFrame, entity: str | None = None, attribute: str | None = None, fact_type: str | None = None, limit: int = 200) -> DataFrame:
    """Filtered by parts of names, the surest first."""
    has = lambda c, part: F.lower(c).contains(part.lower())
    if entity:
        facts = facts.where(has("canonical_entity", entity))
    if attribute:
        facts = facts.where(has("canonical_attribute", attribute) | has("attribute", attribute))
    if fact_type:
        facts = facts.where(F.col("fact_type") == fact_type)
    return facts.orderBy(F.desc("confidence"), "ingest_seq", "seq").limit(min(limit, 2000))


def search(facts: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """`%` and `_` of the text are wildcards."""
    like = lambda c: F.lower(c).like(f"%{text.lower()}%")
    return facts.where(like("attribute") | like("canonical_entity") | like("canonical_attribute")).orderBy(F.desc("confidence"), "ingest_seq", "seq").limit(min(limit, 1000))


def facts_view(facts: DataFrame, text: str = "", entity: str = "", fact_type: str = "", limit: int = 400) -> DataFrame:
    """What is looked for, or the list where nothing is; of these, those that fit the entity and the type; the surest first."""
    rows = search(facts, text, 300) if text else facts_list(facts, entity or None, None, fact_type or None, limit)
    if text and entity:
        rows = rows.where(F.lower("canonical_entity").contains(entity.lower()))
    if text and fact_type:
        rows = rows.where(F.col("fact_type") == fact_type)
    return rows.orderBy(F.desc("confidence"), "ingest_seq", "seq").limit(limit)


def placed(rows: DataFrame, name: str = "place") -> DataFrame:
    """Numbers the rows of a short ordered list from 1."""
    at = F.row_number().over(Window.orderBy("_at"))
    return rows.withColumn("_at", F.monotonically_increasing_id()).withColumn(name, at).drop("_at")


def health(documents: DataFrame, facts: DataFrame, rels: DataFrame) -> DataFrame:
    """One row: ok, and the counts of all three."""
    return stats(documents, facts, rels).select(F.lit("ok").alias("status"), "documents", "facts", "relationships")


def relationships_list(rels: DataFrame, relation: str | None = None, min_confidence: float = 0.0, limit: int = 500) -> DataFrame:
    rows = rels.where(F.col("confidence") >= min_confidence)
    if relation:
        rows = rows.where(F.col("relation") == relation)
    return rows.orderBy(F.desc("confidence"), "relationship_id").limit(min(limit, 5000))


def relationships_of(rels: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact_id and the relationship) for each of the facts, by an equality join on either end."""
    ends = rels.withColumn("fact_id", F.explode(F.array_distinct(F.array("fact_a_id", "fact_b_id"))))
    return ends.join(facts.select("fact_id").distinct(), "fact_id")


def enriched(rels: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Relationships with both facts; a missing fact is null."""
    side = lambda x: facts.select(F.col("fact_id").alias(f"fact_{x}_id"), F.struct(*columns).alias(f"fact_{x}"))
    return rels.join(side("a"), "fact_a_id", "left").join(side("b"), "fact_b_id", "left")


def reconciliation(rels: DataFrame, relations: list[str], low: float, high: float) -> DataFrame:
    """The view of differences: chosen relations within a confidence range, contradictions first."""
    place = F.array_position(F.array(*map(F.lit, RELATION_ORDER)), F.col("relation"))
    return rels.where(F.col("relation").isin(*relations) & F.col("confidence").between(low - 1e-9, high + 1e-9)).orderBy(place, F.desc("confidence"), "relationship_id")


def checks_list(checks: DataFrame) -> DataFrame:
    """Failures first."""
    return checks.orderBy("ok", "entity", "document_id", "period")


def entities(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.col("canonical_entity").alias("entity")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "entity")


def stats(documents: DataFrame, facts: DataFrame, rels: DataFrame) -> DataFrame:
    """One row: counts of all three and of relationships by type."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    kinds = rels.groupBy("relation").agg(F.count("*").alias("n"))
    by_type = kinds.agg(F.sum("n").alias("relationships"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n")))).alias("by_type"))
    rows = n(documents, "documents").unionByName(n(facts, "facts"), True).unionByName(by_type, True)  # a row each
    counts = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("documents", "facts", "relationships")]
    return rows.agg(*counts, F.first("by_type", ignorenulls=True).alias("by_type"))


def without_document(documents: DataFrame, facts: DataFrame, rels: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, facts and relationships that stay when the documents of a condition are deleted."""
    dropped = facts.join(documents.where(gone).select("document_id"), "document_id", "left_semi").select("fact_id").distinct()
    kept = documents.where(~gone)
    rels = rels.join(dropped.withColumnRenamed("fact_id", "fact_a_id"), "fact_a_id", "left_anti").join(dropped.withColumnRenamed("fact_id", "fact_b_id"), "fact_b_id", "left_anti")
    return kept, facts.join(dropped, "fact_id", "left_anti"), rels


def per_document(documents: DataFrame, facts: DataFrame, rels: DataFrame) -> DataFrame:
    """Counters of each document: its facts, those of them that a model gave, and the relationships that it brought."""
    n_facts = facts.groupBy("document_id").agg(F.count("*").alias("fact_count"), F.count_if(F.col("method") == "llm_assisted").alias("model_facts"))
    brought = rels.join(facts.select(F.col("fact_id").alias("fact_a_id"), "document_id"), "fact_a_id").groupBy("document_id").agg(F.count("*").alias("relationship_count"))
    out = documents.join(n_facts, "document_id", "left").join(brought, "document_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fact_count", "model_facts", "relationship_count")})

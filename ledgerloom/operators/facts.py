"""Facts of documents: primary entity and period, gates, normalization and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..config import EngineConfig
from ..functions import attributes as A
from ..functions import entities as E
from ..functions import periods as P
from ..functions import text as X
from ..functions import units as U
from ..sources.shared import written
from . import scan

#: (document_id, document_name, ingest_seq, page, text, blocks)
BLOCKS_TYPE = "array<struct<block_no:int,text:string,char_start:int,char_end:int>>"


def sampled_pages(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(document_id, document_name, page, text): what lies within the first config.entity_sample characters of each document, page by page. Only lengths are summed up, no document is put together."""
    length = F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).alias("length")
    before = F.sum("length").over(Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    room = pages.groupBy("document_id", "page").agg(length).withColumn("room", F.lit(config.entity_sample) - F.coalesce(before, F.lit(0))).where("room > 0").select("document_id", "page", "room")
    return pages.select("document_id", "document_name", "page", "text").join(room, ["document_id", "page"]).withColumn("text", F.left("text", F.col("room").cast("int"))).drop("room")


def _counted(texts: DataFrame, found, keep) -> DataFrame:
    """(document_id, name, n, first) of the names that an array expression finds."""
    each = texts.select("document_id", "page", F.posexplode(found).alias("at", "name")).where(keep(F.col("name")))
    return each.groupBy("document_id", "name").agg(F.count("*").alias("n"), F.min(F.struct("page", "at")).alias("first"))


def _best(rows: DataFrame, *order, name: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    return rows.withColumn("rank", rank).where("rank = 1").select("document_id", F.col("name").alias(name))


def primary_entities(texts: DataFrame) -> DataFrame:
    """(document_id, primary_entity): a word of the file name that the text bears out, else the company named most, else the most frequent name.

    texts: document_id, document_name, page, text. Pages are read one by one and whole, so a name that two pages share counts for neither.
    """
    documents = texts.groupBy("document_id").agg(F.first("document_name").alias("document_name"))
    stops = sorted({*lx.NO_SUBJECT, *lx.NO_ENTITY})
    ok = lambda c: ~c.isin(*stops) & ~F.lower(c).isin(*lx.LEGAL_SUFFIXES)
    names = _counted(texts, F.regexp_extract_all("text", F.lit("(?U)" + lx.PROPER_NOUN), F.lit(1)), ok)
    last = lambda c: F.try_element_at(F.filter(F.split(X.squeezed(c), " "), lambda w: ~w.isin(*stops) & (F.lower(w) != "of")), F.lit(-1))
    heads = _counted(texts, F.transform(F.regexp_extract_all("text", F.lit("(?U)" + lx.LEGAL_NAME), F.lit(1)), last), lambda c: c.isNotNull())

    hints = documents.select("document_id", F.posexplode(E.hint_tokens(F.col("document_name"))).alias("at", "hint"))
    by_head = heads.select("document_id", F.lower("name").alias("hint"), F.lit(True).alias("is_head")).distinct()
    by_name = names.where("n >= 5").select("document_id", F.lower("name").alias("hint"), F.col("name").alias("as_written"))
    hinted = hints.join(by_head, ["document_id", "hint"], "left").join(by_name, ["document_id", "hint"], "left").where("is_head OR as_written IS NOT NULL")
    hinted = _best(hinted.withColumn("name", F.when(F.col("is_head"), E.display_entity(F.initcap("hint"))).otherwise(F.col("as_written"))), "at", name="by_hint")

    both = heads.join(names.select("document_id", "name", F.col("n").alias("freq")), ["document_id", "name"]).where("freq >= 15")
    company = _best(both.withColumn("name", E.display_entity(F.col("name"))), F.desc("freq"), "first", name="by_company")
    common = _best(names, F.desc("n"), "first", name="by_count")
    head = _best(heads.withColumn("name", E.display_entity(F.col("name"))), F.desc("n"), "first", name="by_head")
    out = documents
    for part in (hinted, company, common, head):
        out = out.join(part, "document_id", "left")
    return out.select("document_id", F.coalesce("by_hint", "by_company", "by_count", "by_head", F.nullif("document_name", F.lit("")), F.lit("Unknown")).alias("primary_entity"))


def primary_periods(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(document_id, primary_period): the fiscal year that the first pages (all, if config.primary_pages is None) name most; of equals, the first."""
    first = pages if config.primary_pages is None else pages.where(F.col("page") <= config.primary_pages)
    named = first.select("document_id", "page", F.posexplode(P.document_years(F.coalesce("text", F.lit("")))).alias("at", "year"))
    years = named.where("year IS NOT NULL").groupBy("document_id", F.col("year").alias("name")).agg(F.count("*").alias("n"), F.min(F.struct("page", "at")).alias("first"))
    return _best(years, F.desc("n"), "first", name="year").select("document_id", P.fiscal_year_period(F.col("year")).alias("primary_period"))


def extracted(pages: DataFrame, config: EngineConfig = EngineConfig(), entities: DataFrame | None = None) -> DataFrame:
    """Facts of all pages before deduplication; seq orders those of a document. Pages with hardly any text are left out."""
    readable = pages.where(~X.is_scanned(F.col("text")))
    scanned = readable.select("document_id", "document_name", "ingest_seq", "page", "text", "blocks", X.printed_page(F.col("text")).alias("printed_page"), U.page_scale(F.col("text")).alias("page_scale"))
    found = scan.candidates(scanned)
    entities = primary_entities(sampled_pages(pages, config)) if entities is None else entities
    found = found.join(entities, "document_id", "left").join(primary_periods(pages, config), "document_id", "left")

    c, table = F.col, F.col("strategy") == scan.TABLE
    # what the pieces say, in written tables: filters on parsed structs would otherwise pull whole parsers into themselves
    found = found.withColumns({
        "stated": F.coalesce(P.column_period(c("column")), P.parse_period(c("period_text"))), "plain_family": A.family(c("attribute")), "norm_attr": A.normalize_attribute(c("attribute")),
        "label_scale": F.when(table, U.label_scale(c("raw_label"))), "label_currency": F.when(table, U.label_currency(c("raw_label"))),
        "raw_entity": F.when(c("strategy") == scan.NARRATIVE, E.sentence_entity(c("evidence"))),
    })
    found = written(found, "candidates")

    # tables: what a bare cell means comes from its label and page
    kind = A.family_kind(c("plain_family"))
    found = found.withColumn("scale", F.coalesce("label_scale", F.when(kind == "monetary", c("page_scale"))))
    found = found.where(~table | ((kind != "monetary") | c("scale").isNotNull()) & ((kind != "unknown") | c("label_currency").isNotNull() | c("label_scale").isNotNull()))
    signs = F.create_map(*[F.lit(x) for pair in lx.CURRENCY_SIGNS.items() for x in pair])
    sign = F.coalesce(F.try_element_at(signs, c("label_currency")), F.when((kind == "monetary") & c("scale").isNotNull(), "₹"), F.lit(""))
    shown = F.when(table, F.trim(F.concat(sign, c("raw_value"), F.coalesce(F.concat(F.lit(" "), c("scale")), F.lit(""))))).otherwise(c("raw_value"))

    # periods: stated, else the document's
    known = c("stated.kind") != "unknown"
    found = found.withColumn("inferred", ~table & ~known & c("primary_period").isNotNull())
    found = found.where(F.when(table | c("needs_period"), known | c("inferred")).otherwise(F.lit(True)))
    found = found.withColumn("period", F.when(c("inferred"), c("primary_period")).otherwise(c("stated")))

    found = found.where(~A.is_junk(c("norm_attr")) & ~A.is_junk(c("plain_family"))).withColumn("raw_value", shown)
    found = written(found.withColumns({"parsed": U.parse_value(c("raw_value")), "period_key": P.period_key(c("period"))}), "values").where("parsed IS NOT NULL")
    found = found.withColumn("family", A.fact_family(c("plain_family"), c("attribute"), c("parsed.is_percent"), c("evidence")))
    percent = c("parsed.is_percent")
    rate = c("family").endswith("growth") | c("family").contains("inflation")
    found = found.where(~(percent & (A.family_kind(c("family")) == "monetary")) & ~(percent & rate & (F.abs("parsed.normalized_value") > 35)))

    narrated = c("strategy") == scan.NARRATIVE
    confidence = (
        F.when(table, F.lit(0.7) * c("column_confidence"))
        .when(narrated, F.when(c("inferred"), 0.6).otherwise(0.78)).otherwise(F.when(c("inferred"), 0.55).otherwise(0.72))
    )
    raw_entity = c("raw_entity")
    extra = F.when(table, F.map_concat(F.create_map(F.lit("source"), F.lit("table")), F.create_map(F.lit("column_confidence"), F.format_string("%.2f", c("column_confidence"))))).when(c("inferred"), F.create_map(F.lit("period_inferred"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))
    key = F.concat_ws("|", c("document_id"), c("page").cast("string"), F.coalesce("char_start", F.lit(0)).cast("string"), c("family"), c("parsed.raw_number"))
    return found.select(
        F.left(F.sha1(key.cast("binary")), F.lit(16)).alias("fact_id"),
        F.coalesce(raw_entity, c("primary_entity")).alias("entity"), E.resolve_entity(raw_entity, c("primary_entity")).alias("canonical_entity"),
        F.left(F.trim("attribute"), F.lit(160)).alias("attribute"), c("family").alias("canonical_attribute"), "norm_attr",
        U.fact_type(c("parsed")).alias("fact_type"), F.left(F.trim("raw_value"), F.lit(80)).alias("raw_value"), c("parsed.value").alias("value"),
        F.coalesce("parsed.scale_word", F.when(percent, "%")).alias("raw_unit"), "parsed.normalized_value", "parsed.normalized_unit", "parsed.currency",
        "period", "period_key", F.when(c("period.kind").isin("as_of", "range"), c("period.end_date")).alias("as_of_date"),
        F.coalesce(F.when(~table, X.status(c("evidence"))), F.lit("unknown")).alias("status"), F.when(table, c("scope")).otherwise(X.scope(c("scope_text"))).alias("scope"),
        "definition", F.map_concat(extra, F.create_map(F.lit("norm_attr"), c("norm_attr"))).alias("qualifiers"),
        "document_id", "document_name", "ingest_seq", "page", "printed_page", F.left(F.trim("evidence"), F.lit(600)).alias("evidence"), "char_start", "char_end",
        F.round(confidence, 3).alias("confidence"), F.element_at(F.array(*map(F.lit, ("deterministic_narrative", "deterministic_kpi", "deterministic_table"))), c("strategy") + 1).alias("method"),
        F.struct("page", "ordinal").alias("seq"),
    )


def deduplicated(facts: DataFrame) -> DataFrame:
    """Per document and (entity, family, period, value, scope) the fact of highest confidence, the first of equals."""
    key = ["document_id", F.lower("canonical_entity"), "canonical_attribute", "period_key", F.round("normalized_value", 2), F.coalesce("scope", F.lit(""))]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("confidence"), "seq"))
    return facts.withColumn("rank", rank).where("rank = 1").drop("rank")


def extract_facts(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return deduplicated(extracted(pages, config))

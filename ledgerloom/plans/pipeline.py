"""From pages to facts and relationships, in one batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators.candidates import candidate_pairs, stored
from ..operators.classify import classified, paired
from ..operators.facts import extract_facts
from ..sources.documents import binary_files, checked_uploads, hashed, new_documents, numbered
from ..sources.pdf import Loader, document_states, loaded, optional_loader
from ..sources.shared import scratch, written


@dataclass
class Knowledge:
    documents: DataFrame
    facts: DataFrame
    relationships: DataFrame


def first_copies(documents: DataFrame) -> DataFrame:
    """Of documents with one content, the one that came first."""
    best = documents.groupBy("document_id").agg(F.min("ingest_seq").alias("ingest_seq"))
    return documents.join(best, ["document_id", "ingest_seq"], "left_semi")


def relate(new: DataFrame, old: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Relationships of new facts with stored ones of earlier documents (or of their own batch)."""
    return classified(paired(candidate_pairs(new, old, config), new, old), config)


def build(pages: DataFrame, config: EngineConfig = EngineConfig()) -> Knowledge:
    """Documents, stored facts and relationships of pages (document_id, document_name, ingest_seq, page, text, blocks)."""
    documents = pages.groupBy("document_id", "document_name", "ingest_seq").agg(F.count("*").alias("page_count"))
    with scratch() as keep:
        keep.append(facts := written(extract_facts(pages, config), "facts"))  # read by both sides of both joins
    return Knowledge(documents, stored(facts), relate(facts, stored(facts), config))


def ingested(spark: SparkSession, path: str, loader: Loader = optional_loader, known: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, Knowledge]:
    """Files of a folder, in the order of their paths, to knowledge. Beside it, one row a file: path, name, document_id, status (processed, failed, duplicate or rejected), error, page_count, scanned_pages.

    A file whose content came before (in an earlier path, or in `known` by sha256) is a duplicate; what
    cannot be opened has failed and brings no page.
    """
    files = numbered(hashed(checked_uploads(binary_files(spark, path), config), "content"), "path")
    accepted = files.where("accepted")
    first = new_documents(accepted, known, "ingest_seq")
    pages = written(loaded(first, loader), "pages")
    states = document_states(pages).select("document_id", "status", "error", "page_count", "scanned_pages")
    seen = first.select("ingest_seq", F.lit(True).alias("first"))
    rows = files.select("path", "name", "document_id", "ingest_seq", "accepted", "reject_reason").join(seen, "ingest_seq", "left").join(states, "document_id", "left")
    is_first = F.coalesce("first", F.lit(False))
    status = F.when(~F.col("accepted"), "rejected").when(is_first, F.col("status")).otherwise("duplicate")
    report = rows.select("path", "name", "document_id", "ingest_seq", status.alias("status"), F.when(~F.col("accepted"), F.col("reject_reason")).when(is_first, F.col("error")).alias("error"),
                         *[F.when(is_first, F.col(c)).alias(c) for c in ("page_count", "scanned_pages")])
    return report, build(pages.where("error IS NULL").drop("error"), config)

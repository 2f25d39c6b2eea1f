"""Documents from bytes and tables: checks, hashes, first copies, pages and blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import EngineConfig
from ..functions.text import is_scanned, printed_page, safe_name
from .pdf import block_spans
from .shared import written


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, length) of files, in the order of their paths when numbered."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")


def checked_uploads(files: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds safe_name, accepted and reject_reason: only PDF names, of limited size, that begin like a PDF."""
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    reason = (
        F.when(~F.lower("name").endswith(".pdf"), "not a pdf name")
        .when(F.octet_length("content") > config.max_upload_mb * 1024 * 1024, "too large").when(~magic, "not a pdf")
    )
    return files.withColumns({"safe_name": safe_name(F.col("name")), "reject_reason": reason, "accepted": reason.isNull()})


def hashed(rows: DataFrame, content: str) -> DataFrame:
    """Adds sha256 and document_id, its first 16 digits."""
    digest = F.sha2(F.col(content).cast("binary"), 256)
    return rows.withColumn("sha256", digest).withColumn("document_id", F.left(digest, F.lit(16)))


def new_documents(rows: DataFrame, known: DataFrame | None, order: str) -> DataFrame:
    """Rows whose content is neither known nor in an earlier row; hashes are aggregated before the shuffle, so copies are no hot group."""
    first = rows.groupBy("sha256").agg(F.min(order).alias(order))
    if known is not None:
        first = first.join(known.select("sha256"), "sha256", "left_anti")
    return rows.join(first, ["sha256", order], "left_semi")


def page_flags(pages: DataFrame) -> DataFrame:
    """Adds is_scanned and printed_page."""
    return pages.withColumns({"is_scanned": is_scanned(F.col("text")), "printed_page": printed_page(F.col("text"))})


def html_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_no, text): texts between block tags of pages (page_id, html), white space squeezed."""
    flat = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", ""), r"(?i)</?(p|div|li|ul|h1|nav|article|footer|title|head|body|html)( [^>]*)?>", "\u0001")
    parts = F.filter(F.transform(F.split(F.regexp_replace(flat, "<[^>]*>", " "), "\u0001"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return pages.select("page_id", F.posexplode(parts).alias("block_no", "text"))


def block_offsets(pages: DataFrame) -> DataFrame:
    """(document_id, page, block_no, char_start, char_end) of the blocks of pages (document_id, page, text, blocks: block_no and text): found behind the block before, else anywhere, else at 0. A page is one row and stays where it is."""
    keep = ["document_id", "page"]
    schema = T.StructType([*(pages.schema[n] for n in keep), T.StructField("spans", T._parse_datatype_string("array<struct<block_no:int,char_start:int,char_end:int>>"))])
    kind = to_arrow_type(schema["spans"].dataType)

    def spans(text, blocks):
        blocks = sorted(blocks or [], key=lambda b: b["block_no"])
        return [b | {"block_no": n["block_no"]} for b, n in zip(block_spans(text or "", [b["text"] for b in blocks]), blocks, strict=True)]

    def run(batches):
        for b in batches:
            found = [spans(t, x) for t, x in zip(b.column("text").to_pylist(), b.column("blocks").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array([[{k: s[k] for k in ("block_no", "char_start", "char_end")} for s in page] for page in found], kind)], names=schema.names)

    return pages.select(*keep, "text", "blocks").mapInArrow(run, schema).select(*keep, F.explode("spans").alias("s")).select(*keep, "s.*")


def located(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """fact_id, at (1-based place in the page, 0 if nowhere) and snippet: the raw value, else the evidence's first 60 characters, else all of it."""
    rows = facts.select("fact_id", "document_id", "page", "raw_value", "evidence").join(pages.select("document_id", "page", F.col("text").alias("page_text")), ["document_id", "page"])
    tries = [F.col("raw_value"), F.left("evidence", F.lit(60)), F.col("evidence")]
    hits = F.filter(F.array(*[F.struct(F.instr("page_text", t).alias("at"), t.alias("snippet")) for t in tries]), lambda h: h["at"] > 0)
    best = F.try_element_at(hits, F.lit(1))
    return rows.select("fact_id", F.coalesce(best["at"], F.lit(0)).alias("at"), best["snippet"].alias("snippet"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """ingest_seq, a number that grows with an order column (with gaps), by a distributed sort; written, so that it stays what it is."""
    return written(rows.orderBy(order).withColumn("ingest_seq", F.monotonically_increasing_id()), "numbered")

"""PDF bytes to pages, behind a loader that may be replaced.

A loader gets the bytes of a file and returns its pages as (text, blocks); it raises ValueError for
what it cannot open. The default loader needs an optional library and says so if it is missing.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.facts import BLOCKS_TYPE

Loader = Callable[[bytes], list[tuple[str, list[str]]]]


def optional_loader(content: bytes) -> list[tuple[str, list[str]]]:
    try:
        import pymupdf
    except ImportError as missing:
        raise ValueError("no PDF library is installed") from missing
    try:
        doc = pymupdf.open(stream=content, filetype="pdf")
    except Exception as broken:
        raise ValueError(f"malformed document: {broken}") from broken
    if doc.needs_pass:
        raise ValueError("password-protected document")
    return [(p.get_text("text"), [b[4].strip() for b in p.get_text("blocks") if b[4].strip()]) for p in doc]


def block_spans(text: str, blocks: list[str]) -> list[dict]:
    """Blocks with their places in the text: behind the block before, else anywhere, else at 0."""
    out, at = [], 0
    for i, b in enumerate(blocks):
        start = max(next((s for s in (text.find(b, at), text.find(b)) if s >= 0), 0), 0)
        at = start + len(b)
        out.append({"block_no": i, "text": b, "char_start": start, "char_end": at})
    return out


def loaded(files: DataFrame, loader: Loader = optional_loader) -> DataFrame:
    """One row a page of files (document_id, name, ingest_seq, content): document_name, page from 1, text, blocks; a file that fails has one row with its error and no page."""
    schema = T.StructType([*(files.schema[n] for n in ("document_id", "ingest_seq")), T.StructField("document_name", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()),
                           T.StructField("blocks", T._parse_datatype_string(BLOCKS_TYPE)), T.StructField("error", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        for b in batches:
            rows = []
            for key, seq, name, content in zip(*(b.column(n).to_pylist() for n in ("document_id", "ingest_seq", "name", "content")), strict=True):
                try:
                    rows += [(key, seq, name, i, text, block_spans(text, blocks), None) for i, (text, blocks) in enumerate(loader(bytes(content or b"")), 1)]
                except ValueError as failed:
                    rows.append((key, seq, name, None, None, None, str(failed)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return files.select("document_id", "ingest_seq", "name", "content").mapInArrow(run, schema)


def document_states(pages: DataFrame) -> DataFrame:
    """document_id, status (processed or failed), error, page_count, scanned_pages of loaded() rows."""
    from ..functions.text import is_scanned

    scanned = F.count_if(F.col("page").isNotNull() & is_scanned(F.col("text")))
    out = pages.groupBy("document_id", "document_name").agg(F.first("error", ignorenulls=True).alias("error"), F.count("page").alias("page_count"), scanned.alias("scanned_pages"))
    return out.withColumn("status", F.when(F.col("error").isNull(), "processed").otherwise("failed"))

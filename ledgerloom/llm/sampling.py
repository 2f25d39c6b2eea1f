"""A bounded, repeatable sample of labelled texts for a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytecnn import windows
from .common import mapped


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def thinned(rows: DataFrame, label: str, each: int) -> tuple[DataFrame, dict]:
    """About `each` rows of every label at most (a hash of doc_id decides), and the counts of all labels."""
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(each / n)) for k, n in counts.items() if n > each], F.lit(1.0)) if counts else F.lit(1.0)
    return rows.where(draw < rate), counts


def windowed(rows: DataFrame, label: str, length: int, stride: int, most: int) -> tuple[list[np.ndarray], list]:
    """To the driver: of each doc_id of the rows (doc_id, text, label) `most` evenly spaced windows at most, in a repeatable order. Of rows of one doc_id that with the smallest hash of its text counts, so an id on any share of the rows is one document of the sample."""

    def cut(texts):
        return [[np.ascontiguousarray(windows((t or "").encode("utf-8", "surrogatepass"), length, stride, most)).tobytes() for t in texts]]

    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", F.col(label).alias("label"))).alias("first")
    rows = rows.groupBy("doc_id").agg(first).select("doc_id", "first.text", "first.label")
    rows = mapped(rows, ["doc_id", "label"], ["text"], {"cut": "binary"}, cut)
    found = sorted((str(r["doc_id"]), bytes(r["cut"]), r["label"]) for r in rows.collect())
    return [np.frombuffer(x[1], np.uint8).reshape(-1, length) for x in found], [x[2] for x in found]

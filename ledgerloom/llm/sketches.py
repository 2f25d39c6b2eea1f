"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the sorted K smallest of a document's hashed shingles, six bytes each, in base64
behind the number of shingles it stands for. Sketches of parts merge into that of the whole; two
of them tell resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, mix, shingle_sets, table, written

K = 128
WIDTH = 5
#: Bits of a kept hash: a float holds them exactly and base64 wastes none.
BITS = 48
_SALT = np.uint64(0xA0761D6478BD642F)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct scrambled hashes, ascending; of fewer, all."""
    h = np.unique(mix(hashes ^ _SALT) >> np.uint64(64 - BITS))
    return h[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two sets, from theirs."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A | B|; two empty sets are alike, one empty set is like nothing. Exact while the union has k shingles at most."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, k)
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A|; 1 for an empty A."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merged(a, b, k), k) / max(1.0, distinct(a, k)))


def text_of(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return f"{len(sketch)}:{base64.b64encode(raw).decode()}"


def sketch_of(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text.partition(":")[2]), np.uint8).reshape(-1, 6).astype(np.uint64)
    return (raw << np.arange(40, -8, -8, dtype=np.uint64)).sum(1, dtype=np.uint64)


def fingerprints(texts, width: int = WIDTH) -> list[np.ndarray]:
    return [bottom(h) for h in shingle_sets(texts, width)]


# ---------------------------------------------------------------- each document and the next

#: Stretches of doc_id for each shuffle partition, and altogether: their edges and first keys come to the driver. Keys that edges are taken from, for each stretch.
STRETCHES_EACH, STRETCHES_MOST, KEYS_EACH = 8, 8192, 40
#: More rows than this alike in doc_id and text are looked at twice in each task and multiplied afterwards; RUN of them are one task's.
ALIKE, RUN = 4096, 4096


def _key(doc_id, h) -> tuple:
    """The order of documents: by doc_id, those without one last, then by a hash of the text."""
    return (doc_id is None, doc_id or 0, h)


def stretched(docs: DataFrame, alike: DataFrame) -> DataFrame:
    """(stretch, guest, doc_id, text, h): rows of docs (doc_id, text, h) in stretches of their order, each with a guest copy of the row that follows its last one; the first follows the last. Of the documents in alike (doc_id, h; few) a task gives two rows. Texts are not shuffled here."""
    spark = docs.sparkSession
    keys = docs.select("doc_id", "h")
    n = keys.count()
    many = min(STRETCHES_MOST, STRETCHES_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    some = sorted(_key(*r) for r in keys.sample(min(1.0, KEYS_EACH * many / max(1, n)), 7).collect())  # for even stretches only
    edges = sorted(set(some[len(some) // many :: max(1, len(some) // many)]))
    often = {(r["doc_id"], r["h"]) for r in alike.collect()}

    def own(ids, hs) -> list[int]:
        return [bisect_right(edges, _key(i, h)) for i, h in zip(ids, hs, strict=True)]

    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("first")
    firsts = mapped(keys, ["doc_id", "h"], ["doc_id", "h"], {"stretch": "int"}, lambda i, h: [own(i, h)]).groupBy("stretch").agg(least).collect()  # one row a stretch
    firsts = sorted((r["stretch"], tuple(r["first"])) for r in firsts)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def task():
        given: dict = {}  # what this task has already given: guests, and rows of documents that come often

        def once(x, times: int = 1) -> bool:
            given[x] = given.get(x, 0) + 1
            return given[x] <= times

        def places(ids, hs):
            out = []
            for i, h, k in zip(ids, hs, own(ids, hs), strict=True):
                found = [(k, False)] if (i, h) not in often or once((i, h), 2) else []
                if (x := before.get(_key(i, h))) is not None and once(("guest", x)):
                    found.append((x, True))
                out.append(found)
            return [out]

        return places

    out = mapped(docs, ["doc_id", "text", "h"], ["doc_id", "h"], {"places": "array<struct<stretch:int,guest:boolean>>"}, task, per_task=True)
    return out.select(F.explode("places").alias("p"), "doc_id", "text", "h").select("p.*", "doc_id", "text", "h")


#: Texts are unpacked up to about this many bytes at a time, however long those of a batch are.
PART_BYTES = 1 << 22


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of PART_BYTES of text, or of a single row that is longer."""
    before = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(before, (before[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the beginning of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprinted(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, that of its edited text, and their likeness to each other and to the next document.

    A null text is empty; an empty text has the fingerprint `0:` and is like empty texts only. Rows
    of one doc_id follow each other by a hash of their texts, rows without one come last in the same
    way. A single row is followed by itself; no rows give no rows. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    counts = docs.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where(F.col("n") > ALIKE)
    alike = written(counts.orderBy(F.desc("n")).limit(ALIKE), "alike")  # the rest of such documents has fewer rows than a 4096th of all and goes the plain way
    rows = stretched(docs, alike).repartition("stretch").sortWithinPartitions("stretch", "guest", F.col("doc_id").isNull(), "doc_id", "h")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "edited_contains", "h", "by_itself"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, edited_contains double, h long, by_itself boolean"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]

    def run(batches):
        held = []
        for b in (part for batch in batches for part in parts(batch)):
            got = held + list(zip(*(b.column(n).to_pylist() for n in ("stretch", "guest", "doc_id", "text", "h")), strict=True))
            held = got[-1:]
            own = [bottom(h, k) for h in shingle_sets([r[3] for r in got], width)]
            at = [i for i in range(len(got) - 1) if not got[i][1] and got[i][0] == got[i + 1][0]]
            new = [edited(got[i][3], got[i + 1][3]) for i in at]
            theirs = [bottom(h, k) for h in shingle_sets(new, width)]
            out = [
                (got[i][2], len(got[i][3]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own[i]), text_of(e),
                 resemblance(own[i], e, k), resemblance(own[i], own[i + 1], k), distinct(own[i], k), containment(own[i], e, k), got[i][4], got[i][2::2] == got[i + 1][2::2])
                for i, t, e in zip(at, new, theirs, strict=True)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    found = rows.mapInArrow(run, schema)
    if alike.count() == 0:
        return found.drop("h", "by_itself")
    # documents that come often: all their rows are followed by their like but for one, if another document follows
    found = written(found, "found")
    often = F.broadcast(alike.select(F.col("doc_id").alias("d"), F.col("h").alias("x"), "n"))  # ALIKE rows at most
    is_often = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x"))
    plain = found.join(often, is_often, "left_anti").drop("h", "by_itself")
    one = found.join(often, is_often).groupBy("d", "x", "n").agg(F.min(F.when(~F.col("by_itself"), F.struct(*names[:-2]))).alias("last"), F.min(F.when(F.col("by_itself"), F.struct(*names[:-2]))).alias("row"))
    runs = one.withColumn("times", F.col("n") - F.col("last").isNotNull().cast("int")).withColumn("run", F.explode(F.expr(f"sequence(1L, times, {RUN}L)"))).repartition("d", "run")
    many = runs.withColumn("i", F.explode(F.expr(f"sequence(run, least(run + {RUN}L - 1, times))"))).select("row.*")
    return plain.unionByName(many).unionByName(one.where("last IS NOT NULL").select("last.*"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table."""
    return fingerprinted(table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the fingerprints: lengths and the checksums of the edited texts."""
    return op10_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED_TEXTS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS following FROM t)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(left(t, length(t) - half) || left(following, half)) AS edited_sha256 FROM o
"""

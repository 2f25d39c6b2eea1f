"""What the operators of this folder share: the shared folder, written tables and hashed shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.shared import forget, scratch, shared_dir, table, written

__all__ = ["WORD", "forget", "mapped", "mix", "row_salt", "scratch", "shared_dir", "shingle_sets", "shingles", "spread_join", "table", "word_hashes", "written"]

#: White space that separates words, by contract of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def mapped(df: DataFrame, keep: list[str], inputs: list[str], made: dict[str, str], make, per_task: bool = False) -> DataFrame:
    """The columns of `keep` as they are and, beside them, those of `made` (name: type), which make() gets from the input columns, lists of Python values, a batch at a time. per_task: make() gives that function, anew for each task."""
    schema = T.StructType([*(df.schema[n] for n in keep), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in made.items())])
    types = [to_arrow_type(schema[n].dataType) for n in made]

    def run(batches):
        one = make() if per_task else make
        for b in batches:
            new = one(*(b.column(n).to_pylist() for n in inputs))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *(pa.array(x, k) for x, k in zip(new, types, strict=True))], names=[*keep, *made])

    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)


#: A key with more than one of HOT rows, and more than HOT rows, is dealt over SALTS tasks; there are HOT such keys at most.
HOT, SALTS = 256, 64


def row_salt() -> Column:
    """Deals the rows of a written table, those too that are alike in all columns; the same again if a task is repeated."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")


def spread_join(left: DataFrame, right: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """left (a scan) left-joined with right (one row a key, a written table). A right side below spark.sql.autoBroadcastJoinThreshold is broadcast; else a key may hold any share of left's rows: sizes (key, n) tells which are hot, and rows of those are dealt over SALTS tasks. Without any the plan is a plain join."""
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if not total or most <= max(HOT, total // HOT):
        return left.join(right, key, "left")
    hot = F.broadcast(sizes.where((F.col("n") * HOT > total) & (F.col("n") > HOT)).select(F.col(key), F.lit(True).alias("__hot")))  # HOT rows at most
    is_hot = F.coalesce(F.col("__hot"), F.lit(False))
    a = left.withColumn("__row", row_salt()).join(hot, key, "left").withColumn("__salt", F.when(is_hot, F.col("__row")).otherwise(0)).drop("__hot", "__row")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(hot, key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return a.join(b, [key, "__salt"], "left").drop("__salt")


# ---------------------------------------------------------------- hashed words and shingles

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the UTF-8 bytes, A-Z lower-cased, and the byte offset where it starts."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(raw) + 1)
    summed = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    return mix((summed[end] - summed[start]) * down[start] + (end - start).astype(np.uint64)), start


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    out = words[: len(words) - width + 1].copy()
    for i in range(1, width):
        out = mix(out * _BASE + words[i : len(words) - width + 1 + i])
    return mix(out + np.uint64(width))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of `width` words; of fewer words, the whole sequence is the only one."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(_joined(words, min(width, len(words))))


#: Texts are joined up to about this many bytes before they are hashed together.
BATCH_BYTES = 1 << 20


def shingle_sets(texts, width: int):
    """shingles() of each text (None: empty); hashes many short texts in one go."""
    pending, size = [], 0

    def flush():
        words, at = word_hashes(b"\n".join(pending))
        ends = np.cumsum([len(x) + 1 for x in pending])
        cut = np.searchsorted(at, ends)
        return [shingles(x, width) for x in np.split(words, cut[:-1])]

    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        pending.append(data)
        size += len(data)
        if size >= BATCH_BYTES:
            yield from flush()
            pending, size = [], 0
    if pending:
        yield from flush()

"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into equal cells, more of them for more rows. A row's cell comes from a hash of its
doc_id and text, so that rows without doc_id, or with one and the same, are no hot place; the next
virtual node clockwise is its home. Each shard has room for its share of the rows only: first
every shard takes its own cells in ring order until it is full, then what is left goes on
clockwise to the next virtual node whose shard has room. That walk needs the row count of each
cell only, so the driver sees 2 ** MOST_BITS numbers at most. In a cell rows are
ranked by hash; the walk hands out ranges of ranks, and each range starts at a known slot.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Cells: one for so many entries, within bounds.
CELL_ROWS, LEAST_BITS, MOST_BITS = 1 << 16, 14, 20
#: Virtual nodes of each shard.
VIRTUAL = 128
SEED = 77
#: Rows of one doc_id, size and text that one task writes out at most.
RUN = 4096


def ring(shards: int, bits: int = LEAST_BITS) -> list[tuple[int, int, int]]:
    """(cell, tie, shard) of all virtual nodes, clockwise. More bits cut the same ring finer."""
    out = []
    for shard in range(shards):
        for v in range(VIRTUAL):
            x = int.from_bytes(hashlib.blake2b(f"{SEED}/{shard}/{v}".encode(), digest_size=8).digest(), "big")
            out.append((x >> 64 - bits, x, shard))
    return sorted(out)


def walk(counts: dict[int, int], shards: int, bits: int = LEAST_BITS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, last rank + 1, shard, first slot): who takes which rows of each cell. Loads differ by one at most."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, nodes, out, left = [0] * shards, ring(shards, bits), [], []
    cells = [n[0] for n in nodes]

    def give(cell: int, start: int, n: int, shard: int) -> int:
        k = min(n, room[shard] - filled[shard])
        if k:
            out.append((cell, start, start + k, shard, filled[shard]))
            filled[shard] += k
        return k

    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(nodes)
        k = give(cell, 0, counts[cell], nodes[home][2])
        if k < counts[cell]:
            left.append((cell, k, home))
    for cell, start, home in left:
        step = home
        while start < counts[cell]:
            step += 1
            start += give(cell, start, counts[cell] - start, nodes[step % len(nodes)][2])
    return out


def placed(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs (doc_id, text; other columns are not read).

    size: UTF-8 bytes of the text plus 1; a null text has none and the checksum 0. The law is
    `rows`: counts of shards differ by one at most; grown_shard is null. Rows alike in doc_id,
    size and checksum are one entry with a count until they are written out, so a doc_id on a
    third of all rows is no hot group. A null doc_id is a key like others. No rows: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    entries = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    entries = written(entries.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "size", "text_crc32")), "entries")
    bits = min(MOST_BITS, max(LEAST_BITS, (entries.count() // CELL_ROWS).bit_length()))
    entries = entries.withColumn("cell", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    counts = {r["cell"]: r["n"] for r in entries.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # 2 ** MOST_BITS rows at most
    parts: dict[int, list] = {}
    for cell, *part in walk(counts, shards, bits):
        parts.setdefault(cell, []).append(tuple(part))
    plan = docs.sparkSession.createDataFrame(list(parts.items()), "cell int, parts array<struct<lo:long,hi:long,shard:int,slot:long>>")  # a range or two a cell
    rank = F.sum("n").over(Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0))
    ranked = entries.withColumn("hi", rank).withColumn("lo", F.col("hi") - F.col("n")).join(F.broadcast(plan), "cell").drop("cell", "h")
    few = ranked.where(F.col("n") <= RUN)
    many = ranked.where(F.col("n") > RUN).withColumn("lo", F.explode(F.expr(f"sequence(lo, hi - 1, {RUN}L)"))).withColumn("hi", F.expr(f"least(hi, lo + {RUN}L)")).repartition(F.col("doc_id"), F.col("lo"))
    each = few.unionByName(many).withColumn("rank", F.explode(F.expr("sequence(lo, hi - 1)")))
    part = F.element_at(F.filter("parts", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"])), 1)
    return each.withColumn("part", part).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("rank") - F.col("part.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table on 16 shards."""
    return placed(table(spark, sf_dir, "documents"), 16)


def shard_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the shards: how many rows each has, at how many places, and which one is its last."""
    found = op7_consistent_sharding(spark, sf_dir)
    return found.groupBy("law", "shard").agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last_slot"))


SHARD_LAWS_SQL = """
WITH n AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(i AS INT) AS shard, n // 16 + CAST(i < n % 16 AS INT) AS rows FROM n, unnest(range(0, 16)) AS u(i))
SELECT 'rows' AS law, shard, CAST(rows AS BIGINT) AS rows, CAST(rows AS BIGINT) AS slots, CAST(rows - 1 AS BIGINT) AS last_slot FROM s WHERE rows > 0
"""

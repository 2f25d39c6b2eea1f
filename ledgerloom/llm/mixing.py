"""Mixing sources to target weights by subset sums over exact lengths.

Documents are counted by source and exact length in words. A source's target is so many whole
passes over it and a remaining budget. All but the last words of the budget (DP_WORDS of them, or
LONGEST times the longest document if that is more) are spread over the lengths in proportion, with
seeded rounding; what is then open is filled by a bounded-knapsack dynamic program over the counts
that are left, so a few long documents are fitted, too. Which documents of a length are taken is decided by a
seeded hash of the whole row: documents come in the order of that hash, up to a cut. The cut of each
source and length is found by counting, in slices, then in slices of the slice at the cut, then row
by row there, so rows themselves are never ranked or sorted. Rows alike in all columns share their
hash; where the cut falls among them they are made anew, as many with the extra copy as it takes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, spread_join, table, written

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 1234
#: Slices of the hash, and slices of each of them.
SLICES = 512
#: Rows alike that one task makes at most.
RUN = 4096
#: Budget that the dynamic program fills: so many words, or so many times the longest document, up to a bound of its memory (8 bytes a word).
DP_WORDS, LONGEST, DP_MOST = 1 << 16, 4, 1 << 23


def targets(sizes: dict, weights: tuple = WEIGHTS, most: float = MOST) -> dict:
    """Sources by code point, null last, get the repeating weights and share all words; a source stops at `most` times its size and the excess is shared again."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    out, active, rest = {}, list(names), float(sum(sizes.values()))
    while active:
        whole = sum(weight[k] for k in active)
        over = [k for k in active if rest * weight[k] / whole > most * sizes[k]]
        if not over:
            return out | {k: rest * weight[k] / whole for k in active}
        out |= {k: float(most * sizes[k]) for k in over}
        rest -= sum(out[k] for k in over)
        active = [k for k in active if k not in over]
    return out


def subset(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take so that their sum comes as near below `budget` (0 to DP_MOST) as can be."""
    first = np.full(budget + 1, -1, np.int32)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    items = []
    for i, (s, n) in enumerate(zip(sizes, counts, strict=True)):
        k = 1
        n = min(int(n), budget // int(s))
        while n > 0 and not reached[budget]:
            k = min(k, n)
            w = int(s) * k
            new = np.zeros_like(reached)
            new[w:] = reached[: budget + 1 - w]
            new &= ~reached
            first[new] = len(items)
            reached |= new
            items.append((i, k, w))
            n -= k
            k *= 2
        if reached[budget]:
            break
    out, at = np.zeros(len(sizes), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        i, k, w = items[first[at]]
        out[i] += k
        at -= w
    return out


def picks(source, sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length (over 0) take part in a budget below their sum."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(repr((seed, source)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big"))
    order = rng.permutation(len(sizes))
    total = int((sizes * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    window = min(DP_MOST, max(DP_WORDS, LONGEST * int(sizes.max())))
    take = np.minimum(counts, np.floor(counts * (max(0, budget - window) / total) + rng.random(len(sizes))).astype(np.int64))
    left = budget - int((take * sizes).sum())
    least = min(budget, window) // 2
    for i in order:  # the rounding took too much
        if left >= least:
            break
        k = min(int(take[i]), -((left - least) // int(sizes[i])))
        take[i] -= k
        left += k * int(sizes[i])
    for i in order:  # or far too little
        if left <= window:
            break
        k = min(int(counts[i] - take[i]), (left - window) // int(sizes[i]) + 1, left // int(sizes[i]))
        take[i] += k
        left -= k * int(sizes[i])
    if left > window:  # each document left over is longer than the budget
        return take
    free = counts - take
    fits = order[(free[order] > 0) & (sizes[order] <= left)]
    fits = fits[np.argsort(-(sizes[fits] // (DP_WORDS // LONGEST)), kind="stable")]  # long documents first, as few sums of others come near theirs
    take[fits] += subset(sizes[fits], free[fits], left)
    return take


def _planned(goal: dict, size_of: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        source = pdf["source"].iloc[0]
        source = None if pd.isna(source) else source
        passes = int(min(MOST, goal[source] // size_of[source])) if size_of[source] else 0
        budget = 0 if passes >= MOST else int(round(goal[source])) - passes * size_of[source]
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        full = sizes > 0
        extra = np.zeros(len(pdf), np.int64)
        extra[full] = picks(source, sizes[full], counts[full], budget)
        return pd.DataFrame({"source": pdf["source"], "size": sizes, "passes": passes, "extra": extra})

    return run


def mixed(docs: DataFrame, keep: list[str], seed: int = SEED, prefix: str = "") -> DataFrame:
    """The columns of `keep` and, behind the prefix, size, source_size, target, times (copies that the mix takes) of each row of docs (doc_id, text, source).

    size counts words; a null text has none. A null source is one more source, the last. Sizes of
    0 are taken with the whole passes. Rows of one doc_id with other texts or other values in `keep`
    are rows of their own, whose places are fixed; only rows alike in all of these may swap places.
    No rows: no rows.
    """
    # one row a source comes to the driver, one row a source and length to a task of that source
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    h = F.xxhash64(F.lit(seed), *[F.col(n) for n in dict.fromkeys(["doc_id", "text", "source", *keep])])
    rows = docs.select(*[F.col(n).alias(f"k_{n}") for n in keep], F.col("source").alias("source"), size.alias("size"), h.alias("h"))
    kind = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "size")
    rows = rows.withColumns({"kind": kind, "one": F.pmod("h", F.lit(SLICES)).cast("int"), "two": F.pmod(F.shiftright("h", 12), F.lit(SLICES)).cast("int")})
    counts = written(rows.groupBy("kind", "one", "two", "h").agg(F.count("*").alias("n")), "counts")
    lengths = written(counts.groupBy("kind").agg(F.sum("n").alias("n")).select(F.when(~F.col("kind.none"), F.col("kind.source")).alias("source"), F.col("kind.size").alias("size"), "n"), "lengths")
    size_of = {r["source"]: r["s"] for r in lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()}
    goal = targets(size_of)
    plan = lengths.groupBy("source").applyInPandas(_planned(goal, size_of), "source string, size long, passes int, extra long")
    plan = plan.select(kind.alias("kind"), "passes", F.col("extra").alias("left"))

    # for each kind the first slice, slice of it and hash that are not taken whole, and how much is taken there
    level, found = [], plan
    for name in ("one", "two", "h"):
        here = counts.join(found.select("kind", *[F.col(x).alias(f"at_{x}") for x in level]), "kind") if level else counts
        for x in level:
            here = here.where(F.col(x) == F.col(f"at_{x}"))
        here = here.groupBy("kind", name).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("kind").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))  # SLICES rows, or those of one small slice
        here = here.withColumn("upto", upto).join(found.select("kind", "left"), "kind").where(F.col("upto") > F.col("left"))
        first = here.groupBy("kind").agg(F.min_by(F.struct(name, (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "n"), name).alias("c"))
        first = first.select("kind", F.col(f"c.{name}").alias(name), F.col("c.left").alias("rest"), F.col("c.n").alias("alike"))
        # where nothing is left over, all is taken: no cut
        found = written(found.drop("alike").join(first, "kind", "left").withColumn("left", F.coalesce("rest", F.lit(0))).drop("rest"), "cuts")
        level.append(name)
    cuts = found.select("kind", "passes", *[F.col(x).alias(f"at_{x}") for x in level], F.col("left").alias("some"), "alike")
    sources = docs.sparkSession.createDataFrame([(k is None, k or "", size_of[k], float(goal[k])) for k in size_of], "none boolean, source string, source_size long, target double")
    cuts = written(cuts.join(sources, (F.col("kind.none") == F.col("none")) & (F.col("kind.source") == F.col("source"))).drop("none", "source"), "cuts")

    placed = spread_join(rows, cuts, "kind", counts.groupBy("kind").agg(F.sum("n").alias("n")))
    before = F.lit(False)
    for x in reversed(level):
        before = (F.col(x) < F.col(f"at_{x}")) | ((F.col(x) == F.col(f"at_{x}")) & before)
    taken = F.when(F.col("at_one").isNull(), True).otherwise(before)
    split = F.coalesce((F.col("some") > 0) & (F.col("one") == F.col("at_one")) & (F.col("two") == F.col("at_two")) & (F.col("h") == F.col("at_h")), F.lit(False))
    names = [f"k_{n}" for n in keep]
    placed = placed.select(*names, "size", "source_size", "target", "passes", "h", "kind", "some", "alike", taken.alias("taken"), split.alias("split"))
    whole = placed.where(~F.col("split")).select(*names, "size", "source_size", "target", (F.col("passes") + F.col("taken").cast("int")).alias("times"))
    # rows alike where the cut is: one of them stands for all
    one = F.first(F.struct(*names, "size", "source_size", "target", "passes", "some", "alike")).alias("row")
    runs = placed.where("split").groupBy("kind", "h").agg(one).select("row.*").withColumn("run", F.explode(F.expr(f"sequence(0L, alike - 1, {RUN}L)"))).repartition(F.col("run"), *names[:1])
    each = runs.withColumn("i", F.explode(F.expr(f"sequence(run, least(run + {RUN}L, alike) - 1)")))
    made = each.select(*names, "size", "source_size", "target", (F.col("passes") + (F.col("i") < F.col("some")).cast("int")).alias("times"))
    return whole.unionByName(made).select(*[F.col(f"k_{n}").alias(n) for n in keep], *[F.col(n).alias(f"{prefix}{n}") for n in ("size", "source_size", "target", "times")])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents table, mixed by weights 1, 2, 3, repeating."""
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the mix: sizes and targets, and that the words taken of a document are whole passes over it."""
    found = op9_source_mix(spark, sf_dir)
    return found.select("doc_id", "size", "source_size", "target", ((F.col("taken") <= MOST * F.col("size")) & (F.col("taken") % F.greatest(F.col("size"), F.lit(1)) == 0)).alias("whole"))


#: Sources by how soon they are full: one is if its share of what the fuller ones leave is above its bound.
MIX_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, sum(size) OVER () AS whole, coalesce(sum(3 * size) OVER (ORDER BY size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM s),
f AS (SELECT *, (whole - before) * w > 3 * size * w_rest AS capped FROM o),
t AS (
  SELECT source, CAST(size AS BIGINT) AS source_size, CASE WHEN capped THEN CAST(3 * size AS DOUBLE)
    ELSE CAST((whole - sum(CASE WHEN capped THEN 3 * size ELSE 0 END) OVER ()) * w AS DOUBLE) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target FROM f)
SELECT doc_id, d.size, source_size, target, true AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

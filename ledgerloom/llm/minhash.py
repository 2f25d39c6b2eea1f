"""Near-duplicate groups by HyperMinHash sketches.

Each distinct shingle set gets one sketch of REGISTERS buckets from a single hash a shingle. A
register keeps the number of leading zeros of the smallest hash of its bucket and the MANTISSA
bits that follow them. Empty registers borrow from others for banding only. Bands of compressed
registers propose pairs, the collision-corrected estimate of the Jaccard index turns away those
that are far off, and the full sets decide the rest. Sets of few shingles are also proposed by what is left
of them without any DELETED shingles or fewer, which finds all links between such sets.

A node is a shingle set, whatever documents it comes from; doc_ids are put to sets at the end.
Within a band's bucket every node is first held against the bucket's smallest node only. Buckets
that are then of one component need nothing more. In the others the largest component and the
rest are dealt out in blocks of BLOCK nodes; a task holds one block against another, and gives
back one link at most for each pair of components that it joins. So no link between different
components is lost, no group is expanded into all its pairs, and no task gets more than two blocks.
A node of an open bucket of n nodes outside the largest component is copied n / BLOCK times.
Two sets in the bucket of a core are linked if both leave out few enough shingles, so the one that
leaves out least is linked with all that are linked with any: such buckets are never open.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, mapped, mix, shingle_sets, spread_join, table, written
from .graph import components

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard deviations that an estimate may be off before a pair is turned away unverified.
MARGIN = 6.0
#: Of one register at an index of 0.85 or 0.8: sqrt(J (1 - J)) at most.
SPREAD = 0.4
#: Nodes of a side of one comparison task.
BLOCK = 256

_probe = mix(np.arange(REGISTERS * 64, dtype=np.uint64).reshape(64, REGISTERS) + np.uint64(7919)) % np.uint64(REGISTERS)
#: For registers that no probe fills: the filled register of the smallest value stands in.
_stand_in = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64).reshape(REGISTERS, REGISTERS) + np.uint64(1299709))
#: Shingles that a set may lack of a linked one, for it to count as small.
DELETED = 2
_band_salt = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(104729))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes: leading zeros above the MANTISSA bits, 0 where empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    scrambled = mix(hashes)
    bucket = (scrambled >> np.uint64(48)) * np.uint64(REGISTERS) >> np.uint64(16)
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, bucket.astype(np.int64), scrambled & np.uint64((1 << 48) - 1))
    full = low != np.iinfo(np.uint64).max
    v = np.maximum(low[full], np.uint64(1))
    top = np.frexp(v.astype(np.float64))[1] - 1  # exact: v has 48 bits at most
    rest = v ^ (np.uint64(1) << top.astype(np.uint64))
    mantissa = np.where(top >= MANTISSA, rest >> np.maximum(top - MANTISSA, 0).astype(np.uint64), rest << np.maximum(MANTISSA - top, 0).astype(np.uint64))
    out[full] = ((48 - top).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; empty registers borrow by a fixed probe order, so sets of any size agree as often as their index says."""
    filled = registers.astype(np.uint64)
    empty = np.flatnonzero(registers == 0)
    if len(empty) == REGISTERS:
        return np.empty(0, np.uint64)
    for row in _probe:
        if not len(empty):
            break
        got = registers[row[empty].astype(np.int64)].astype(np.uint64)
        filled[empty] = got
        empty = empty[got == 0]
    if len(empty):  # very few registers are set: each empty one has its own order of them
        some = np.flatnonzero(registers)
        filled[empty] = registers[some[_stand_in[np.ix_(empty, some)].argmin(1)]]
    key = _band_salt.copy()
    for column in filled.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def lacking(n: int, percent: int) -> int:
    """How many shingles a set of n may have that a linked one has not."""
    return n * (100 - percent) // 100


def cores(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a small set and of what is left without as many shingles as a link leaves out at most, and how many each leaves out. Linked small sets have the key of their intersection in common; larger sets have none."""
    most = lacking(len(hashes), percent)
    if not len(hashes) or most > DELETED:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    folded = mix(hashes)
    sums = [folded.sum(dtype=np.uint64, keepdims=True)]
    if most >= 1:
        sums.append(sums[0] - folded)
    if most >= 2:
        i, j = np.triu_indices(len(hashes), 1)
        sums.append(sums[0] - folded[i] - folded[j])
    return mix(np.concatenate(sums) + np.uint64(15485863)), np.repeat(np.arange(len(sums)), [len(x) for x in sums])


def keys(hashes: np.ndarray, registers: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(key, left_out) of all buckets of a set: its cores, and its bands (left_out: -1) unless all that it may link with have cores, too."""
    core, left_out = cores(hashes, percent)
    band = np.empty(0, np.uint64) if len(hashes) and lacking(len(hashes) * 100 // percent, percent) <= DELETED else bands(registers)
    return list(zip(np.concatenate([band, core]).view(np.int64).tolist(), [-1] * len(band) + left_out.tolist(), strict=True))


def _set_key(hashes: np.ndarray) -> str:
    folded = mix(hashes)
    return f"{int(folded.sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(folded)):016x}"


def _sketched(width: int, percent: int):
    def run(texts):
        out = []
        for hashes in shingle_sets(texts, width):
            registers = sketch(hashes)
            some = len(hashes) > 0
            out.append((len(hashes), _set_key(hashes) if some else None, registers.tobytes() if some else None, keys(hashes, registers, percent)))
        return list(zip(*out, strict=True)) or [[]] * 4

    return run


def _sets(width: int, wanted: np.ndarray, given: set):
    """(set_key, hashes) of the rows whose bit is set; of others, and of rows that `given` has, nulls."""
    bits = np.uint64(len(wanted) * 64 - 1)

    def run(rows, texts):
        h = mix(np.array(rows, np.int64).view(np.uint64)) & bits
        hit = ((wanted[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)
        for i in np.flatnonzero(hit):
            hit[i] = rows[i] not in given
            given.add(rows[i])
        found = list(shingle_sets([t for t, x in zip(texts, hit, strict=True) if x], width))
        at = iter(found)
        return list(zip(*[(_set_key(s), s.view(np.int64)) if x and len(s := next(at)) else (None, None) for x in hit], strict=True)) or [[]] * 2

    return run


#: Bits of the filter that says which texts to read again: so many a node, up to a fixed size.
FILTER_BITS_EACH, FILTER_BITS_MOST = 16, 1 << 26


def _full_sets(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of nodes (node, set_key, row: the row that stands for the set). Texts (row, text) are picked by a broadcast filter of bounded size, so they are never shuffled; what it lets pass wrongly goes in the join. Of rows alike a task gives one."""
    nodes = written(nodes, "nodes")
    n = nodes.count()
    size = min(FILTER_BITS_MOST, max(1 << 16, 1 << int(n * FILTER_BITS_EACH).bit_length()))
    at = mapped(nodes.select("row"), [], ["row"], {"bit": "long"}, lambda x: [(mix(np.array(x, np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)])
    words = at.groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    wanted = np.zeros(size // 64, np.int64)
    got = words.toPandas()  # FILTER_BITS_MOST / 64 rows at most
    wanted[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast(wanted.view(np.uint64))

    def task():
        given: set = set()  # of one task
        return lambda rows, t: _sets(width, shared.value, given)(rows, t)

    found = mapped(texts, [], ["row", "text"], {"set_key": "string", "hashes": "array<long>"}, task, per_task=True).where("set_key IS NOT NULL")
    return nodes.select("node", "set_key").join(found.groupBy("set_key").agg(F.first("hashes").alias("hashes")).hint("merge"), "set_key").select("node", "hashes")


def _compared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, REGISTERS)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, REGISTERS)
    some = (x != 0) | (y != 0)
    return pd.DataFrame({"matches": ((x == y) & some).sum(1).astype(np.int32), "valid": some.sum(1).astype(np.int32)})


def _estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Adds est, the collision-corrected index, and slack, how far off it may be."""
    a = sketches.select(F.col("node").alias("a"), F.col("registers").alias("ra"), F.col("n_shingles").alias("na"))
    b = sketches.select(F.col("node").alias("b"), F.col("registers").alias("rb"), F.col("n_shingles").alias("nb"))
    # expected share of registers whose minima differ and yet agree in zeros and mantissa
    share = F.col("na") * F.col("nb") * 4.0 / ((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb")))
    chance = F.lit(0.1699) * share * (2.0**-MANTISSA) * 2
    out = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").withColumn("c", F.pandas_udf(_compared, "struct<matches int, valid int>")("ra", "rb")).withColumn("chance", chance)
    est = F.greatest(F.lit(0.0), (F.col("c.matches") / F.col("c.valid") - F.col("chance")) / (1 - F.col("chance")))
    return out.select(*pairs.columns, "na", "nb", (est + MARGIN * SPREAD / F.sqrt(F.col("c.valid"))).alias("at_most"))


def _block_links(percent: int):
    """Between the nodes of two sides (or of one with itself) of different components: links that join two of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", ignore_index=True)
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["hashes"]]
        sizes = np.array([len(x) for x in sets])
        registers = np.array([sketch(x) for x in sets])
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(inverse, kind="stable")
        posted, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
        mine = np.split(inverse, np.cumsum(sizes)[:-1])
        comp, side = pdf["comp"].to_numpy().copy(), pdf["side"].to_numpy()
        both_sides = len(set(side)) > 1
        out = []
        for i in range(len(sets)):
            open_ = comp != comp[i]
            open_ &= (np.minimum(sizes, sizes[i]) * 100 >= np.maximum(sizes, sizes[i]) * percent)
            open_ &= (side != side[i]) if both_sides else (np.arange(len(sets)) > i)
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            some = (registers[at] != 0) | (registers[i] != 0)
            chance = 0.1699 * 8 * 2.0**-MANTISSA * sizes[at] * sizes[i] / (sizes[at] + sizes[i]) ** 2.0
            est = (((registers[at] == registers[i]) & some).sum(1) / some.sum(1) - chance) / (1 - chance)
            at = at[est + MARGIN * SPREAD / np.sqrt(some.sum(1)) >= percent / 100]
            if not len(at):
                continue
            both = np.bincount(np.concatenate([posted[starts[v] : starts[v + 1]] for v in mine[i]]), minlength=len(sets))[at]
            for j in at[both * 100 >= percent * (sizes[at] + sizes[i] - both)]:
                if comp[j] != comp[i]:
                    out.append((pdf["node"][i], pdf["node"][j]))
                    comp[comp == comp[j]] = comp[i]
        return pd.DataFrame({"a": [x[0] for x in out], "b": [x[1] for x in out]}, dtype="int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (a hash of the text) and component (a number) for each row of docs (doc_id, text; other columns are not read).

    Two rows are linked if 100 * |A & B| >= percent * |A | B| over their sets of `width`-word
    shingles; component_id is the smallest doc_id that links reach. Every row is judged by its own
    text: rows of one doc_id are linked by their texts only. Rows without doc_id link like others;
    component_id is null where links reach no doc_id. A null or empty text has no shingle, no link and
    no component, its component_id is its doc_id. Repeated rows stay. No rows give no rows. kept:
    doc_id equals component_id, nulls included.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    made = {"n_shingles": "long", "set_key": "string", "registers": "binary", "keys": "array<struct<key:bigint,left_out:int>>"}
    sketched = written(mapped(docs, ["doc_id", "text_key"], ["text"], made, _sketched(width, percent)), "sketched")
    row = F.xxhash64("doc_id", "text_key")
    first = F.min(F.struct(row.alias("row"), "n_shingles", "registers", "keys")).alias("first")
    heads = sketched.where("set_key IS NOT NULL").groupBy("set_key").agg(first, F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    heads = written(heads.select(F.monotonically_increasing_id().alias("node"), "set_key", "doc_id", "n", "first.*"), "heads")  # written, so numbers stay

    # every node of a bucket against the one that leaves out least, or the smallest
    placed = heads.select("node", "n_shingles", F.explode(F.array_distinct("keys")).alias("k")).select("node", "n_shingles", "k.*")
    leaders = placed.groupBy("key").agg(F.min(F.struct("left_out", "node")).alias("l"), F.count("*").alias("n")).where("n > 1").select("key", F.col("l.node").alias("leader"), F.col("l.left_out").alias("least"))
    members = written(placed.hint("merge").join(leaders, "key"), "members")  # of buckets of two or more
    core = F.col("n_shingles") - F.col("left_out")
    linked = (F.col("left_out") < 0) | (core * 100 >= percent * (core + F.col("least") + F.col("left_out")))
    stars = members.where("node != leader").where(linked).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    close = written(_estimated(stars, heads).where(F.col("at_most") >= percent / 100.0).select("a", "b", "na", "nb"), "close")
    in_bands = members.where("left_out < 0").select("node").distinct()
    needed = in_bands.union(close.select("a")).union(close.select("b")).distinct()
    full = written(_full_sets(heads.select("node", "set_key", "row").join(needed.hint("merge"), "node", "left_semi"), docs.select(row.alias("row"), "text"), width), "full")
    a, b = (full.select(F.col("node").alias(n), F.col("hashes").alias(f"h{n}")) for n in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    links = close.join(b.hint("merge"), "b").join(a.hint("merge"), "a").where(both * F.lit(100) >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
    labels = written(components(links), "labels")

    # what the smallest leaves open: other nodes of different components in one band's bucket
    rest = members.where("left_out < 0 AND node != leader").select(F.col("key").alias("band"), "node").join(labels.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = rest.groupBy("band", "comp").agg(F.count("*").alias("n"))
    opened = counts.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).where("comps > 1")
    opened = opened.select("band", F.col("top.comp").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("m"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("r"))
    spot = F.xxhash64(F.lit("block"), "node")
    dealt = rest.join(opened.hint("merge"), "band").withColumn("is_main", F.col("comp") == F.col("main"))
    dealt = dealt.withColumn("own", F.pmod(spot, F.when(F.col("is_main"), F.col("m")).otherwise(F.col("r"))).cast("int"))
    against_main = "transform(sequence(0, m - 1), i -> struct(0 as kind, i as i, own as j, 1 as side))"
    against_rest = "transform(sequence(0, r - 1), i -> struct(1 as kind, least(i, own) as i, greatest(i, own) as j, if(own < i, 0, if(own > i, 1, 0)) as side))"
    tasks = F.when(F.col("is_main"), F.expr("transform(sequence(0, r - 1), j -> struct(0 as kind, own as i, j as j, 0 as side))")).otherwise(F.expr(f"concat({against_main}, {against_rest})"))
    dealt = dealt.select("band", "node", "comp", F.explode(tasks).alias("task")).select("band", "node", "comp", "task.*")
    more = dealt.join(full.hint("merge"), "node").groupBy("band", "kind", "i", "j").applyInPandas(_block_links(percent), "a long, b long")
    known = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels2 = written(components(known.union(more)), "labels")
    forget(members, close, full, labels)

    # documents of sets of components; a set and a component may hold any share of the rows
    of_set = written(heads.select("node", "set_key", "doc_id", "n").join(labels2, "node", "left").select("set_key", "n", "doc_id", F.coalesce("component", "node").alias("component")), "of_set")
    least = of_set.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = spread_join(of_set.select("set_key", "component"), least, "component", of_set.groupBy("component").agg(F.count("*").alias("n"))).select("set_key", "component", "component_id")
    rows = sketched.select("doc_id", "text_key", "n_shingles", "set_key")
    found = spread_join(rows.where("set_key IS NOT NULL"), named, "set_key", of_set.select("set_key", "n")).drop("set_key")
    empty = rows.where("set_key IS NULL").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return found.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "component")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles and 85 percent, by contract, over the whole documents table."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key", "component")


#: Exact single-linkage groups by an inverted index of shingles; components by repeated minima.
OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN least_of m ON s.doc_id = m.a
"""

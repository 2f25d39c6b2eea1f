"""Benchmark passages in documents, by DataFrame functions only.

1. A filter of bounded size over the benchmark's hashed five-word shingles tells, inside the
   scan, which texts share any; only those keep their shingle arrays, one for each distinct text.
2. A window of an item's size that is 0.8 alike shares 4/9 of both sizes' sum with the item. All
   windows with so many shingles of items of that size, wherever they start, are taken; which
   item they may be like is not asked yet.
3. Distinct windows and items get 64-bit SimHash fingerprints. A multi-index finds all items of
   the window's size within RADIUS: of BLOCKS blocks of 16 bits one differs in RADIUS / BLOCKS bits
   at most, so items are entered under all values up to ITEM_FLIPS bits off, and windows look up
   all values up to the rest. Of several ways to find a pair one counts.
4. The exact weighted similarity (shingles with their multiplicities) verifies what was found.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, spread_join, table, written

WIDTH = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 two fingerprints differ by 9.7 bits on average, with a deviation of 2.9.
RADIUS = 19
BLOCKS, BITS = 4, 16
#: Bits that one block of a pair within RADIUS differs in at most, and how many of them the item's entries cover.
FLIPS, ITEM_FLIPS = RADIUS // BLOCKS, 3
#: Bits of the filter: so many a shingle of the benchmark, up to a fixed size.
FILTER_BITS_EACH, FILTER_BITS_MOST, PROBES = 64, 1 << 26, 4
#: Places of texts are dealt by so many salts, as one shingle may be in any share of them.
SALTS = 16


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(words: str, width: int) -> Column:
    """Hashed shingles of `width` words in order of their places, of an array of word hashes."""
    one = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(width)])
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), one)).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in more than half of the hashes, counted with repeats."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.call_function("getbit", h, b).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _masks(flips: int) -> list[int]:
    """All values of a block with so many bits set at most."""
    return [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BITS), n)]


def _block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _entries(fingerprint: Column, flips: int) -> Column:
    """An array of (block, value, flipped) under which a fingerprint is entered or looked up."""
    masks = F.array(*[F.lit(m) for m in _masks(flips)])

    def of(i: int) -> Column:
        return F.transform(masks, lambda m: F.struct(F.lit(i).alias("block"), _block(fingerprint, i).bitwiseXOR(m).alias("value"), m.alias("flipped")))

    return F.flatten(F.array(*[of(i) for i in range(BLOCKS)]))


def within(windows: DataFrame, items: DataFrame) -> DataFrame:
    """windows (length, print, ...) and items (length, item_print, ...) of one length whose fingerprints differ in RADIUS bits at most, each pair once."""
    look = windows.withColumn("e", F.explode(_entries(F.col("print"), FLIPS - ITEM_FLIPS)))
    index = items.withColumn("x", F.explode(_entries(F.col("item_print"), ITEM_FLIPS)))
    names = [c for c in items.columns if c != "length"]
    index = index.select(F.col("length").alias("of"), F.col("x.block").alias("block"), F.col("x.value").alias("value"), *names)
    found = look.join(index.hint("merge"), (F.col("length") == F.col("of")) & (F.col("e.block") == F.col("block")) & (F.col("e.value") == F.col("value")))
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    found = found.where(F.bit_count(differ) <= RADIUS)
    # a pair counts in its first block that is near enough, there without a flip of the window's or, if the item's do not reach, with that of the lowest bits
    first = F.coalesce(*[F.when(F.bit_count(_block(differ, i)) <= FLIPS, F.lit(i)) for i in range(BLOCKS)])
    d = F.coalesce(*[F.when(F.col("block") == i, _block(differ, i)) for i in range(BLOCKS)])
    lowest = d.bitwiseAND(-d)
    flipped = F.when(F.bit_count(d) <= ITEM_FLIPS, F.lit(0)).otherwise(lowest)
    return found.where((F.col("block") == first) & (F.col("e.flipped") == flipped)).drop("e", "of", "block", "value")


def _filter(hashes: DataFrame):
    """What makes a condition of a test for hashes (one bigint column) by a literal bit array of bounded size: PROBES places of a hash must be set. Beyond FILTER_BITS_MOST / 16 hashes it lets more and more others pass, which the join after it takes out. The condition holds the array once, as the driver keeps and sends each copy."""
    bits = min(FILTER_BITS_MOST, max(1 << 16, 1 << (hashes.count() * FILTER_BITS_EACH).bit_length()))

    def spots(h: Column) -> list[Column]:
        low, high = h.bitwiseAND(F.lit((1 << 31) - 1)), F.shiftrightunsigned(h, 33)
        return [x.bitwiseAND(F.lit(bits - 1)).cast("int") for x in (h, high, *(low + high * i for i in range(1, PROBES - 1)))]

    words = hashes.select(F.explode(F.array(*spots(F.col("hash")))).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("v")).collect()  # bits / 64 rows at most
    values = [0] * (bits // 64)
    for r in words:
        values[r["w"]] = r["v"]
    table_ = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    bit = lambda t, b: F.call_function("getbit", F.get(t, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1

    def passes(t: Column, h: Column) -> Column:
        out = F.lit(True)
        for b in spots(h):
            out = out & bit(t, b)
        return out

    # as a lambda's variable the array is one literal, however often it is probed
    return lambda condition: F.get(F.transform(F.array(table_), lambda t: condition(lambda h: passes(t, h))), F.lit(0))


def _starts(places: str, length: str, width: str, n_words: str) -> Column:
    """Where windows begin that hold enough of the sorted places: for each place as a window's first one, the starts behind the place before that still reach the last one needed."""
    whole = F.col(n_words) - F.col(width) + 1
    mine = F.least(F.col(length) - F.col(width) + 1, whole)
    need = F.floor((4 * (mine + F.col(length) - F.col(width) + 1) + 8) / 9).cast("int")  # 0.8 / 1.8 of both sizes

    def of(i: Column) -> Column:
        p = F.col(places)
        low = F.greatest(F.when(i > 0, F.get(p, i - 1) + 1).otherwise(0), F.get(p, i + need - 1) - mine + 1)
        high = F.least(F.get(p, i), whole - mine)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(places) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - need), of))).otherwise(F.array().cast("array<int>"))


def _similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard index of two arrays: what is in both, as often as in the one that has it less, over what is in either."""
    times = lambda arr, d: F.size(F.filter(arr, lambda x: x == d))
    both = F.array_intersect(a, b)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    # where one side repeats nothing, each shared value counts once
    shared = F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, d: s + F.least(times(a, d), times(b, d))))
    return F.get(F.transform(F.array(shared), lambda n: n / (F.size(a) + F.size(b) - n)), F.lit(0))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, similarity, start_word for each document and item with a window of the item's size that is alike enough; the best window, then the first.

    Words are runs of letters and digits, lower-cased; shingles have five words. An item of fewer
    words is one shingle of that length. Null and empty texts hold nothing and are no items. A
    document shorter than an item is one window. text_key is a hash of the text: rows of equal
    doc_id and text are one document here, a null doc_id or item_id is kept as null. Without
    documents or items there is no row. Other columns are not read. Texts that come often are looked
    at once, and so are passages that are in many texts.
    """
    word_hashes = lambda df, text: df.withColumn("w", F.transform(_words(text), lambda x: F.xxhash64(x)))
    items = word_hashes(benchmark.select("item_id", "text"), "text").withColumn("length", F.size("w")).where("length > 0").drop("text")
    items = written(items.withColumn("width", F.least(F.lit(WIDTH), F.col("length"))), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # 1 to WIDTH
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, text_key long, item_id long, similarity double, start_word long"
    if not widths:
        return docs.sparkSession.createDataFrame([], kind)
    by_width = lambda df: F.coalesce(*[F.when(df["width"] == k, _hashes("w", k)) for k in widths])
    items = written(items.withColumn("hashes", by_width(items)).drop("w").withColumn("item", F.monotonically_increasing_id()), "items")
    known = written(items.select("width", "length", F.explode("hashes").alias("hash")).distinct(), "known")
    prints = items.select("item", "length", simhash(F.col("hashes")).alias("item_print"))

    hit = _filter(known.select("hash").distinct())
    hashed = word_hashes(rows, "text").select("doc_id", F.xxhash64("text").alias("text_key"), F.size("w").alias("n_words"), F.explode(F.array(*[F.struct(F.lit(k).alias("width"), _hashes("w", k).alias("hashes")) for k in widths])).alias("s"))
    some = written(hashed.select("doc_id", "text_key", "n_words", "s.width", "s.hashes").where(hit(lambda passes: F.exists("hashes", passes))), "some")
    near = written(some.drop("doc_id").dropDuplicates(["text_key", "width"]), "near")  # one row a text

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    lengths = known.groupBy("hash", "width").agg(F.collect_set("length").alias("lengths"))  # sizes of items, not items
    places = near.select("text_key", "n_words", "width", F.posexplode("hashes").alias("p", "hash")).where(hit(lambda passes: passes(F.col("hash")))).withColumn("salt", F.col("p") % SALTS)
    places = places.join(lengths.select("*", salt), ["hash", "width", "salt"]).select("text_key", "n_words", "width", "p", F.explode("lengths").alias("length"))
    starts = places.groupBy("text_key", "width", "length", "n_words").agg(F.array_sort(F.collect_list("p")).alias("places"))  # as many as the text has shingles
    starts = starts.select("text_key", "width", "length", _starts("places", "length", "width", "n_words").alias("at")).where(F.size("at") > 0)
    at = F.explode("at").alias("start")
    windows = near.select("text_key", "width", "hashes").join(starts, ["text_key", "width"]).select("text_key", "width", "length", "hashes", at)
    part = F.slice("hashes", F.col("start") + 1, F.col("length") - F.col("width") + 1)
    windows = windows.select("text_key", "length", "start", part.alias("part")).withColumns({"one": F.xxhash64("part"), "two": F.xxhash64(F.lit("window"), "part")})
    windows = written(windows.withColumn("window", F.struct("length", "one", "two")).drop("one", "two"), "windows")

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = written(windows.groupBy("window").agg(F.first("part").alias("part")).repartition(tasks, "window").withColumns({"length": F.col("window.length"), "print": simhash(F.col("part"))}), "distinct")
    pairs = within(distinct.select("window", "length", "print"), prints).select("window", "item")
    pairs = pairs.join(distinct.select("window", "part").hint("merge"), "window").join(items.select("item", "item_id", "hashes").hint("merge"), "item")
    scored = written(pairs.select("window", "item_id", _similarity(F.col("part"), F.col("hashes")).alias("similarity")), "scored")
    alike = written(scored.where(F.col("similarity") >= SIMILARITY).groupBy("window").agg(F.collect_set(F.struct("item_id", "similarity")).alias("items")), "alike")  # as many as items are alike one window

    # back to the texts that hold such a window, and to the documents with such a text; both may be any share of all
    seen = written(windows.select("text_key", "start", "window").join(alike.select("window"), "window", "left_semi"), "seen")
    held = spread_join(seen, alike, "window", seen.groupBy("window").agg(F.count("*").alias("n")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    held = held.select("text_key", "start", F.explode("items").alias("i")).select("text_key", "start", "i.*").groupBy("text_key", "item_id").agg(best)
    of_text = written(held.groupBy("text_key").agg(F.collect_list(F.struct("item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start_word"))).alias("items")), "of_text")
    holders = written(some.select("doc_id", "text_key").distinct().join(of_text.select("text_key").hint("merge"), "text_key", "left_semi"), "holders")
    out = spread_join(holders, of_text, "text_key", holders.groupBy("text_key").agg(F.count("*").alias("n")))
    forget(items, known, some, near, windows, distinct, scored, alike, seen)
    return out.select("doc_id", "text_key", F.explode("items").alias("i")).select("doc_id", "text_key", "i.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the whole documents table: doc_id, item_id, similarity, start_word."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word")


#: The same by strings instead of hashes, over all windows that share a shingle with the item, and without fingerprints.
OP5_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
items AS (SELECT id AS item_id, len(w) AS length, w FROM words WHERE kind = 'i' AND len(w) >= 5),
i_sh AS (SELECT item_id, length, q, array_to_string(w[q + 1 : q + 5], ' ') AS g FROM items, unnest(range(0, len(w) - 4)) AS u(q)),
d_sh AS (
  SELECT id AS doc_id, len(w) AS n, p, array_to_string(w[p + 1 : p + 5], ' ') AS g
  FROM words, unnest(range(0, greatest(len(w) - 4, 0))) AS u(p) WHERE kind = 'd'),
hits AS (SELECT * FROM d_sh SEMI JOIN i_sh USING (g)),
starts AS (
  SELECT DISTINCT h.doc_id, h.n, i.item_id, i.length, s.start
  FROM hits h JOIN i_sh i ON h.g = i.g, unnest(range(greatest(0, least(h.p - i.length + 5, h.n - i.length)), greatest(0, least(h.p, h.n - i.length)) + 1)) AS s(start)),
window_counts AS (
  SELECT s.doc_id, s.item_id, s.start, h.g, count(*) AS c
  FROM starts s JOIN hits h ON s.doc_id = h.doc_id AND h.p >= s.start AND h.p <= s.start + s.length - 5 GROUP BY ALL),
item_counts AS (SELECT item_id, g, count(*) AS c FROM i_sh GROUP BY ALL),
shared AS (
  SELECT w.doc_id, w.item_id, w.start, sum(least(w.c, i.c)) AS shared
  FROM window_counts w JOIN item_counts i ON w.item_id = i.item_id AND w.g = i.g GROUP BY ALL),
scored AS (
  SELECT x.doc_id, x.item_id, x.start, x.shared / (least(s.length, s.n) - 4 + s.length - 4 - x.shared) AS similarity
  FROM shared x JOIN starts s USING (doc_id, item_id, start))
SELECT doc_id, item_id, similarity, CAST(start AS BIGINT) AS start_word FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

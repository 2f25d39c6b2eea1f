"""Leaks against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontam


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute(rows, items):
    """Best similarity over all windows of the item's size."""
    out = {}
    for d, text in rows:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            k = min(5, len(v))
            goal = Counter(grams(v, k))
            for s in range(max(1, len(w) - len(v) + 1)):
                have = Counter(grams(w[s : s + len(v)], k))
                both = sum((have & goal).values())
                total = sum((have | goal).values())
                if both and both / total >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), both / total)
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 9, 20, 40])))) for i in range(30)]
    rows = []
    for d in range(400):
        w = [word() for _ in range(rng.choice([0, 4, 60, 200]))]
        if d % 2:
            p = items[rng.randrange(30)][1].split()
            if d % 4 == 1 and len(p) > 15:  # an edit at an end, or words more or less in the middle
                p = [p[1:], p[: len(p) - 1] + ["zzz"], p[:9] + ["zzz"] + p[9:], p[:12] + p[14:], p[:-2] + ["a", "b"] + p[-2:]][d // 4 % 5]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if d % 3 == 0 else x for x in p]
        rows.append((d, " ".join(w)))
    rows.append((500, "the the the the the the the the " * 20))
    items.append((50, "the " * 12))
    return rows, items


def test_against_all_windows(spark, docs, planted):
    rows, items = planted
    got = decontam.leaks(docs(rows), spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, length int, hash int"))
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got.collect()} == {k: round(v, 9) for k, v in brute(rows, items).items()}


def test_index_finds_all_within_the_radius(spark):
    """Each pair of one length within the radius once, and few others looked at."""
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(40)]
    near = [(p ^ sum(1 << b for b in rng.sample(range(64), n)), i) for i, p in enumerate(prints) for n in (0, 1, 5, 12, 17, 19, 19, 19, 20, 24)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    items = spark.createDataFrame([(7, signed(p), i) for i, p in enumerate(prints)] + [(8, signed(prints[0]), 99)], "length int, item_print long, item int")
    windows = spark.createDataFrame([(7, signed(p), k) for k, (p, _) in enumerate(near)], "length int, print long, w int")
    got = sorted((r["w"], r["item"]) for r in decontam.within(windows, items).collect())
    assert got == sorted((k, i) for k, (p, _) in enumerate(near) for i, q in enumerate(prints) if (p ^ q).bit_count() <= decontam.RADIUS)
    # entries that meet, of items that have nothing to do with a window
    value = lambda p, i: p >> 16 * i & 0xFFFF
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(2000)]
    met = sum(any((value(p, i) ^ value(q, i)).bit_count() <= decontam.FLIPS for i in range(4)) for p, q in pairs)
    assert met / len(pairs) < 0.2


def test_a_passage_in_a_third_of_the_texts(spark, docs):
    """One item in very many texts, also often in one text, is compared once."""
    rng = random.Random(12)
    item = " ".join(f"w{rng.randrange(9000)}" for _ in range(30))
    rows = [(i, f"x{i} y{i} " + item + f" z{i}") for i in range(1500)] + [(9000, (item + " ") * 40)] + [(i, item) for i in range(2000, 2500)]
    got = decontam.leaks(docs(rows), spark.createDataFrame([(1, item), (2, item), (3, "q " + item)], "item_id long, text string")).collect()
    assert len(got) == 3 * len(rows) and {r["start_word"] for r in got if r["doc_id"] < 1500 and r["item_id"] == 1} == {2}


def test_no_python_in_the_plan(spark, docs, planted):
    rows, items = planted
    plan = decontam.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, docs, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one"), (5, "word " * 10), (None, "one two three four"), (4, "one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(odd), items).collect()}
    assert {(4, 4), (5, 4), (8, 5), (None, None)} <= got and not any(d in (1, 2, 3) for d, _ in got)
    assert decontam.leaks(docs([]), items).count() == 0 and decontam.leaks(docs(odd), items.limit(0)).count() == 0


def test_agrees_with_sql(spark, small, duck, same_rows):
    same_rows(decontam.op5_decontamination(spark, small), duck, decontam.OP5_SQL)


def test_plans_hold_the_filter_once(spark):
    hashes = spark.range(2000).select(F.xxhash64("id").alias("hash"))
    hit = decontam._filter(hashes)
    rows = spark.range(1990, 2300).select("id", F.xxhash64("id").alias("hash"), F.array(F.xxhash64("id")).alias("hashes"))
    some, one = rows.where(hit(lambda passes: F.exists("hashes", passes))), rows.where(hit(lambda passes: passes(F.col("hash"))))
    assert set(range(1990, 2000)) <= {r["id"] for r in some.collect()} and sorted(some.collect()) == sorted(one.collect()) and some.count() < 30
    for df in (some, one):  # 2048 words or more of up to 20 digits
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 2 * 22 * (1 << (2000 * decontam.FILTER_BITS_EACH).bit_length()) / 64

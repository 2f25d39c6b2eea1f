"""Near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest

from ledgerloom.llm import graph, minhash
from ledgerloom.llm.common import shingle_sets, shingles, word_hashes
from ledgerloom.llm.graph import components


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    groups: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return {(doc_id, len(s), least[find(i)] if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True))}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([2, 5, 8, 30, 120]))]
        rows += [edited(rng, base, rng.choice([0, 0, 1, 2, 6])) for _ in range(rng.choice([1, 1, 2, 4]))]
    base = [word() for _ in range(150)]
    rows += [edited(rng, base, rng.randrange(9)) for _ in range(350)]  # one large group whose copies differ from each other
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_all_links(docs, corpus, width, percent):
    got = minhash.near_duplicates(docs(corpus), width, percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(corpus, width, percent) and len(got) == len(corpus)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_any_size_find_the_same(docs, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    got = minhash.near_duplicates(docs(corpus), 3, 85).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(corpus, 3, 85)


def test_links_of_few_shingles(docs):
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(8)] for _ in range(400)]
    rows = [(2 * i + k, " ".join(w + ["more"] * k)) for i, w in enumerate(texts) for k in (0, 1)]  # 4 and 5 shingles, 0.8
    got = minhash.near_duplicates(docs(rows), 5, 80).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got) and len(got) == 800


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_small_sets_share_a_core(percent):
    rng = np.random.default_rng(3)
    for n in range(1, 20):
        for m in range(n, 20):
            both = next((i for i in range(n, 0, -1) if 100 * i >= percent * (n + m - i)), 0)
            while both and 100 * both >= percent * (n + m - both):
                x = rng.integers(0, 2**63, n + m - both).astype(np.uint64)
                (a, x_a), (b, x_b) = minhash.cores(x[:n], percent), minhash.cores(x[n - both :], percent)
                assert not len(a) or not len(b) or set(a) & set(b)
                # what they share is the core that leaves out just what the other has not
                shared = [(i, j) for i, k in zip(x_a, a, strict=True) for j, q in zip(x_b, b, strict=True) if k == q]
                assert not len(a) or not len(b) or (n - both, m - both) in shared
                both -= 1


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_doc_ids_that_come_twice_or_not_at_all(docs, corpus, width, percent):
    """Rows are judged by their texts, whatever their ids."""
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(150)]), t) for _, t in corpus] + [(7, None), (None, ""), (7, corpus[0][1]), (7, corpus[0][1])]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(rows), width, percent).collect()]
    assert set(got) == brute(rows, width, percent) and len(got) == len(rows)


def test_one_id_with_two_texts(docs):
    words = [f"w{i}" for i in range(120)]
    a, c = " ".join(words), " ".join(words[:60] + ["new"] + words[61:])
    b = " ".join(f"v{i}" for i in range(90))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs([(1, a), (1, b), (2, b + " " + c), (3, b)]), 3, 85).collect()}
    assert got == {(1, 118, 1), (1, 88, 1), (2, 208, 2), (3, 88, 1)}


def test_many_rows_of_two_ids_take_seconds(docs):
    import time

    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(k, edited(rng, base, 1)) for k in (1, 2) for _ in range(1000)]
    began = time.time()
    got = minhash.near_duplicates(docs(rows), 3, 85).collect()
    assert len(got) == 2000 and time.time() - began < 60
    assert all(r["component_id"] == 1 for r in got)


def test_short_texts_of_one_pattern(docs):
    """Thousands of short texts that share all but one shingle are no bucket to be held against each other."""
    rows = [(i, f"your order was shipped this morning at number {i}") for i in range(3000)] + [(5000, "your order was shipped this morning at number 77")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows), 3, 85).collect()}
    assert got[5000] == 77 and all(got[i] == i for i in range(3000))


def test_odd_rows(docs, odd):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(odd), 3, 85).collect()))
    assert len(got) == len(odd)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(i, 0, i, True) for i in (1, 2, 3)]
    assert [g for g in got if g[0] == 4] == [(4, 1, 4, True)] * 3 and (0, 2, None, True) in got and (8, 1, 8, True) in got
    assert minhash.near_duplicates(docs([]), 3, 85).count() == 0


def test_estimate_is_near():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.85, 0.95):
        both, only = rng.integers(0, 2**63, int(4000 * share)).astype(np.uint64), rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64)
        a, b = minhash.sketch(np.concatenate([both, only[::2]])), minhash.sketch(np.concatenate([both, only[1::2]]))
        some = (a != 0) | (b != 0)
        assert abs(((a == b) & some).sum() / some.sum() - share) < 0.15


def test_hashes():
    words, at = word_hashes(b"  Ab c\tAB\n")
    assert len(words) == 3 and words[0] == words[2] and list(at) == [2, 5, 7]
    assert len(shingles(words, 3)) == 1 and len(shingles(words[:0], 3)) == 0
    alone = [list(next(shingle_sets([t], 2))) for t in ("a b c", None, "", "x")]
    assert [list(x) for x in shingle_sets(["a b c", None, "", "x"], 2)] == alone


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (10, 9), (9, 10), (7, 7), (None, 3)], "a long, b long")
    assert dict(components(links).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9, 10: 9}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in components(chain).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_few_links_cost_few_jobs(spark, monkeypatch):
    rng = random.Random(5)
    links = spark.createDataFrame([*((i, i + 1) for i in range(200)), *((1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(300))], "a long, b long")
    spark.sparkContext.setJobGroup("few-links", "few-links")
    found = sorted(components(links).collect())
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 8
    monkeypatch.setattr(graph, "ONE_TASK", 0)  # the distributed steps
    assert found == sorted(components(links).collect()) and len(found) > 400

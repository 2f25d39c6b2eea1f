"""Sharding, mixing, fingerprints, token counts and URL verdicts against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, sharding, sketches, tokens, urls

# ---------------------------------------------------------------- sharding


def check_shards(rows, texts, shards):
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards(docs, real, odd, shards):
    texts = [(d, t) for d, t, *_ in [*real, *[(*o, None, None) for o in odd]]]
    check_shards(sharding.placed(docs(texts), shards).collect(), texts, shards)


def test_hot_key(docs):
    texts = [(1, "same")] * 9000 + [(i, "x") for i in range(2, 200)]
    check_shards(sharding.placed(docs(texts), 16).collect(), texts, 16)
    assert sharding.placed(docs([]), 16).count() == 0


def test_rows_without_doc_id_are_no_hot_place(spark):
    """Different texts under one id are dealt over the ring."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = sharding.placed(rows, 16).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [1250] * 16


@pytest.mark.parametrize(("shards", "bits"), [(1, 14), (5, 14), (16, 17)])
def test_walk_against_one_row_after_another(shards, bits):
    """Each row takes its home if it has room, in ring order; what is left goes on clockwise."""
    rng = random.Random(shards)
    counts = {c: rng.choice([1, 1, 2, 50]) for c in rng.sample(range(1 << bits), 300)}
    nodes = sharding.ring(shards, bits)
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    clockwise = lambda cell: [n[2] for n in nodes if n[0] >= cell] + [n[2] for n in nodes if n[0] < cell]
    expected, late, filled = {}, [], [0] * shards
    for cell in sorted(counts):
        home = clockwise(cell)[0]
        for rank in range(counts[cell]):
            if room[home]:
                room[home] -= 1
                expected[cell, rank] = (home, filled[home])
                filled[home] += 1
            else:
                late.append((cell, rank))
    for cell, rank in late:
        shard = next(s for s in clockwise(cell) if room[s])
        room[shard] -= 1
        expected[cell, rank] = (shard, filled[shard])
        filled[shard] += 1
    got = {(c, r): (shard, slot + r - lo) for c, lo, hi, shard, slot in sharding.walk(counts, shards, bits) for r in range(lo, hi)}
    assert got == expected


def test_walk_moves_little():
    """Rows keep to their home while it has room."""
    rng = random.Random(1)
    counts = {c: rng.randrange(5) for c in range(0, 1 << sharding.LEAST_BITS, 7)}
    parts, nodes = sharding.walk(counts, 16), sharding.ring(16)
    taken = {}
    for cell, lo, hi, shard, _ in parts:
        taken.setdefault(cell, []).append((lo, hi, shard))
    assert all(sum(h - l for l, h, _ in taken.get(c, [])) == n for c, n in counts.items())
    home = sum(h - l for c, ps in taken.items() for l, h, s in ps if s == next((n[2] for n in nodes if n[0] >= c), nodes[0][2]))
    assert home > 0.85 * sum(counts.values())


def test_no_python_in_sharding_plan(docs, real):
    plan = sharding.placed(docs(real))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- mixing


def test_targets():
    got = mixing.targets({"b": 100, "a": 1000, None: 10, "c": 0})
    assert got["c"] == 0
    assert sum(got.values()) == pytest.approx(1110) and all(v <= 3 * s + 1e-9 for v, s in zip((got["a"], got["b"], got[None]), (1000, 100, 10), strict=True))
    assert mixing.targets({"a": 600, "b": 600, "c": 600}) == {"a": 300, "b": 600, "c": 900}
    assert mixing.targets({}) == {}


def test_subset_sum_is_exact_where_it_can_be():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = np.unique(rng.integers(1, 60, 8))
        counts = rng.integers(1, 4, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum()))
        reach = {0}
        for s, n in zip(sizes, counts, strict=True):
            reach = {r + s * k for r in reach for k in range(n + 1)}
        got = mixing.subset(sizes, counts, budget)
        assert (got <= counts).all() and (got * sizes).sum() == max(r for r in reach if r <= budget)
    big = mixing.picks("s", np.arange(1, 2000), np.full(1999, 50), 30_000_017)
    assert (big * np.arange(1, 2000)).sum() == 30_000_017 and (big <= 50).all()


@pytest.mark.parametrize("lengths, n", [((40_000, 90_000), 30), ((70_000, 200_000), 30), ((5_000, 20_000), 200)])
def test_few_long_documents_meet_their_budget(lengths, n):
    missed = []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        sizes, counts = np.unique(rng.integers(*lengths, n), return_counts=True)
        budget = int(0.4 * (sizes * counts).sum())
        took = mixing.picks(f"s{seed}", sizes, counts, budget)
        assert (took >= 0).all() and (took <= counts).all()
        missed.append(1 - (took * sizes).sum() / budget)
    assert min(missed) >= 0 and max(missed) < 0.002 and sum(missed) / len(missed) < 0.0003


def test_one_long_document_among_short_ones():
    sizes = np.concatenate([np.arange(20, 1500), [1_000_000]])
    counts = np.where(sizes < 1500, 20, 1)
    for share in (0.1, 0.4, 0.9):
        budget = int(share * (sizes * counts).sum())
        took = mixing.picks("s", sizes, counts, budget)
        assert (took >= 0).all() and (took <= counts).all() and (took * sizes).sum() == budget


def test_mix(docs, real, odd):
    rows = [*real, *[(d, t, None, s) for (d, t), s in zip(odd, [None, "zz", ""] * 9, strict=False)]]
    got = mixing.mixed(docs(rows), ["doc_id", "text", "source"]).collect()
    assert len(got) == len(rows)
    size: dict = {}
    took: dict = {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["times"] <= 3
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["size"] * r["times"]
    goal = mixing.targets(size)
    assert all(r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[r["source"]]) for r in got)
    assert all(abs(took[k] - goal[k]) <= max(1.0, 0.02 * goal[k]) for k in size if size[k] < 60_000)
    again = mixing.mixed(docs(rows).repartition(5), ["doc_id", "text", "source"]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mixed(docs([]), ["doc_id"]).count() == 0


@pytest.mark.parametrize("repeats", [1, 300])
def test_chosen_rows_are_the_first_by_their_hash(spark, docs, repeats, monkeypatch):
    """Against a plain sort: of each source and length the rows with the smallest (slice, slice of it, hash) get the extra copy; as many as the plan says, also among rows alike."""
    monkeypatch.setattr(mixing, "RUN", 64)
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, rng.randrange(400)]), "w " * rng.choice([3, 3, 3, 4, 9, 17]) + rng.choice("ab"), None, rng.choice(["x", "y", None])) for _ in range(700)] + [(77, "w w w a", None, "x")] * repeats
    df = docs(rows).select("doc_id", "text", "source")
    got = mixing.mixed(df, ["doc_id", "text"]).withColumn("source", F.lit(0)).collect()
    h = F.xxhash64(F.lit(mixing.SEED), "doc_id", "text", "source")
    local = [(r["source"], len(r["text"].split()), r["h"] % 512, (r["h"] >> 12) % 512, r["h"], r["doc_id"], r["text"]) for r in df.withColumn("h", h).collect()]
    sizes: dict = {}
    for r in local:
        sizes[r[0]] = sizes.get(r[0], 0) + r[1]
    goal, expected = mixing.targets(sizes), []
    for source in sizes:
        mine = [r for r in local if r[0] == source]
        lengths = sorted({r[1] for r in mine})
        passes = min(3, int(goal[source] // sizes[source]))
        n = np.array([sum(r[1] == x for r in mine) for x in lengths])
        extra = mixing.picks(source, np.array(lengths), n, 0 if passes >= 3 else round(goal[source]) - passes * sizes[source])
        for x, k in zip(lengths, extra, strict=True):
            for i, r in enumerate(sorted((r for r in mine if r[1] == x), key=lambda r: r[2:5])):
                expected.append((r[5], r[6], x, sizes[source], int(passes + (i < k))))
    assert sorted(map(repr, expected)) == sorted(repr((r["doc_id"], r["text"], r["size"], r["source_size"], r["times"])) for r in got)


# ---------------------------------------------------------------- fingerprints


def grams(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def likeness(a, b):
    return float(a == b) if not a or not b else len(a & b) / len(a | b)


def check_prints(got, rows):
    place = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, place(r[1])))
    expected = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + following[:half]
        a, b, c = grams(t), grams(e), grams(following)
        expected.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), likeness(a, b), likeness(a, c), len(a | b), len(a | c)))
    found = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    expected.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4]))
    found.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4]))
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    # exact up to K shingles in the union, beyond that within five deviations
    off = [(abs(x[i] - y[i]), y[i + 2]) for x, y in zip(found, expected, strict=True) for i in (3, 4)]
    assert all(o < 1e-12 for o, n in off if n <= sketches.K) and all(o < 5 * 0.5 / sketches.K**0.5 for o, _ in off)


def test_fingerprints(docs, real):
    rows = [r[:2] for r in real]
    got = sketches.fingerprinted(docs(rows)).collect()
    check_prints(got, rows)
    texts: dict = {}
    by_id = dict(rows)
    for r in got:
        texts.setdefault(by_id[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in texts.values())


def test_fingerprints_of_odd_rows(docs, odd):
    check_prints(sketches.fingerprinted(docs(odd)).collect(), odd)
    check_prints(sketches.fingerprinted(docs([(5, "a b c")])).collect(), [(5, "a b c")])
    assert sketches.fingerprinted(docs([])).count() == 0


@pytest.mark.parametrize("others", [0, 40])
def test_documents_that_come_often(docs, others, monkeypatch):
    monkeypatch.setattr(sketches, "ALIKE", 100)
    monkeypatch.setattr(sketches, "RUN", 64)
    rows = [(5, "a b c d e f g")] * 700 + [(None, "x y z")] * (200 if others else 0) + [(None, f"n {i}") for i in range(others)] + [(5, f"t {i} a b c d e") for i in range(others)] + [(i, f"o {i}") for i in range(others)]
    check_prints(sketches.fingerprinted(docs(rows)).collect(), rows)


def test_sketches():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**63, 20_000).astype(np.uint64), rng.integers(0, 2**63, 20_000).astype(np.uint64)
    b[:10_000] = a[:10_000]
    x, y = sketches.bottom(a), sketches.bottom(b)
    assert np.array_equal(sketches.merged(x, y), sketches.bottom(np.concatenate([a, b]))) and np.array_equal(sketches.sketch_of(sketches.text_of(x)), x)
    assert abs(sketches.resemblance(x, y) - 1 / 3) < 0.15 and abs(sketches.containment(x, y) - 0.5) < 0.2 and abs(sketches.distinct(x) / 20_000 - 1) < 0.3
    few = sketches.bottom(a[:50])
    assert sketches.distinct(few) == 50 and sketches.resemblance(few, sketches.bottom(a[:100])) == 0.5 and sketches.resemblance(few[:0], few) == 0


# ---------------------------------------------------------------- token counts


def test_token_counts(docs, real, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    long = [" " * 1_000_000 + "a", "b" + "\n \t" * 300_000, "c" + " " * 5000 + "d" + "\u3000" * 5000 + "!" + " " * 4095 + "7" + "\n" * 4096, " " * 4096, "x" * 1_000_000, "7" * 1_000_000, "!" * 1_000_000, "\x1c" * 5000 + "e"]
    rows = [r[:2] for r in real] + list(odd) + [(100 + i, t) for i, t in enumerate(long)]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # the same vocabulary by another library
    lengths = [len(other.encode(t, add_special_tokens=False).ids) if t else 0 for _, t in rows]
    counted = tokens.counted(docs(rows), keep=["doc_id", "text"])
    assert sorted(r["n_tokens"] for r in counted.collect()) == sorted(lengths)
    suffix = tokens.histogram(counted)
    for r in suffix.collect():
        n = r["n_tokens"]
        assert r["docs"] == lengths.count(n) and r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["kept_at_limit"] == sum(min(x, n) for x in lengths) and r["share_upto"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    for limit in (0, 1, 7, 512, 10**6):
        assert tokens.limit_total(suffix, limit).first()["kept"] == sum(min(x, limit) for x in lengths)
    assert tokens.quantile(suffix, 0.5).first()["n_tokens"] == sorted(lengths)[-(-len(lengths) // 2) - 1]


def test_token_counts_of_odd_rows(docs, odd):
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.counted(docs([*odd, (20, "<|endoftext|>")])).collect()}
    assert got[1] == got[2] == 0 and got[20] > 1 and got[8] > 50_000
    none = tokens.histogram(tokens.counted(docs([])))
    assert none.count() == 0 and tokens.limit_total(none, 5).first()["kept"] == 0 and tokens.quantile(none, 0.5).first()["n_tokens"] is None


# ---------------------------------------------------------------- URLs


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.com/x?y#z", "https://WWW.Example.com/en/1", "https://shop.example.com/en/", "https://example.com/EN/", "http://x.net/es/1", "http://net/fr/", "http://x.net", "ftp://spam-farm.org/de/", "https://adult-x.example.net/en/1#a/b",
        "https://cheappills.example.org/", "https://news.example.org/cheap", "no scheme", "", None, "://", "http://?q", "http://h#f", "http://casino-win.org//?", "https://gardenrecipes.org/a", "http://a.com?x=://b.net/es/", "http://xcom/", "https://ads-track.example.org/1"]


def test_verdicts(spark):
    html = "<p>garden recipes and news about farms, cheap pills</p><script>gardenrecipes</script><p class='cheappills'>gardenrecipes.org</p>"
    df = spark.createDataFrame([(i, u, html, 1, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string, n int, host string")
    got = urls.judged(df).collect()
    assert len(got) == 2 * len(URLS)
    by_id = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        rule, verdict = rule_of(host, path)
        r = by_id[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"]), u
    verdicts = {u: by_id[i]["verdict"] for i, u in enumerate(URLS) if by_id[i]["rule"] is None}
    assert {u for u, v in verdicts.items() if v == "block"} == {"ftp://spam-farm.org/de/", "https://adult-x.example.net/en/1#a/b", "https://cheappills.example.org/", "http://casino-win.org//?", "https://ads-track.example.org/1"}
    assert urls.judged(df.limit(0)).count() == 0
    assert urls.judged(df.withColumn("html", F.lit(None).cast("string"))).count() == 2 * len(URLS)


def plain_cost(words, counts, total, known):
    import math

    out = 0.0
    for w in words:
        p = (1 - urls.EXAMPLE_SHARE) * counts.get(w, 0) / total + urls.EXAMPLE_SHARE * (w in known) / len(known)
        out += math.log(p) if p and (len(w) > 1 or w in known) else math.log(urls.UNKNOWN) - math.log(10) * len(w)
    return out


def splits(x):
    return [[x]] + [[x[:i], *rest] for i in range(1, len(x)) for rest in splits(x[i:])]


def test_segmentation_is_the_best():
    counts = {"cheap": 50, "pills": 40, "ch": 500, "ea": 900, "pill": 30, "heap": 10}
    total, known = 10_000, frozenset({"cheap", "farm"})
    for label in ("cheappills", "heaps", "zqcheap", "spills", "cheapfarm"):
        assert plain_cost(urls.segment(label, counts, total, known), counts, total, known) == pytest.approx(max(plain_cost(w, counts, total, known) for w in splits(label)))
    assert urls.segment("", counts, total) == [] and urls.segment("cheappills", counts, total) == ["cheap", "pills"]


def test_names_are_split_although_their_pages_say_them(spark):
    """Planted concatenations, which also stand in their own pages; verdicts against plain counting."""
    from collections import Counter

    talk = "the best casino and a bonus for the garden with recipes on news of today"
    hosts = {"bestcasinobonus": "block", "gardenrecipes": "allow", "newstoday": "allow", "freepornvideos": "block", "bestgarden": "allow"}
    rows = [(i, f"https://{h}.example.org/{i}", f"<p>{talk}</p><p>{(h + ' ') * 30}</p>") for i, h in enumerate(hosts)] + [(100 + i, f"https://site{i}.example.org/", f"<h1>{talk}</h1>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judged(df).collect()}
    counts: Counter = Counter()
    for _, url, html in rows:
        own = re.findall("[a-z]+", url[8:].split("/")[0])
        counts.update(w for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", html)) if w not in own)
    total, known, model = sum(counts.values()), frozenset(urls.words_of(urls.EXAMPLES)), urls.Bayes()
    for i, (h, verdict) in enumerate(hosts.items()):
        words = max(splits(h), key=lambda w: plain_cost(w, counts, total, known))
        assert len(words) > 1 and got[i]["host_words"] == " ".join([*words, "example", "org"])
        assert got[i]["score"] == pytest.approx(model.log_odds(words)) and got[i]["verdict"] == verdict == ("block" if model.log_odds(words) > 0 else "allow")


def test_bayes_against_counts():
    model = urls.Bayes([("block", "spam spam ham"), ("allow", "ham eggs")])
    import math

    words, a = 3, urls.ALPHA
    odd = math.log((2 + a) / (3 + a * words)) - math.log((0 + a) / (2 + a * words))
    both = math.log((1 + a) / (3 + a * words)) - math.log((1 + a) / (2 + a * words))
    assert model.log_odds(["spam", "unknown", "www"]) == pytest.approx(math.log(0.25 / 0.75) + odd)
    assert model.log_odds(["ham", "spam", "spam"]) == pytest.approx(math.log(0.25 / 0.75) + 2 * odd + both)
    # what was never seen with one verdict is not impossible
    assert all(math.isfinite(x) for x in urls.Bayes().odds.values())


def test_spread_join_salts_hot_keys_only(spark):
    from ledgerloom.llm import common

    right = common.written(spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "right")
    for hot in (0, 600):
        left = common.written(spark.range(400).select((F.col("id") % 51).alias("k"), "id").union(spark.range(hot).select(F.lit(7).alias("k"), F.col("id") + 1000)), "left")
        joined = common.spread_join(left, right, "k", left.groupBy("k").agg(F.count("*").alias("n")))
        assert joined.columns == ["k", "id", "v"] and ("explode" in joined._jdf.queryExecution().optimizedPlan().toString()) == (hot > 0)
        assert sorted((r["id"], r["k"], r["v"]) for r in joined.collect()) == sorted((r["id"], r["k"], r["k"] * 2 if r["k"] < 50 else None) for r in left.collect())


def test_texts_are_unpacked_in_parts(monkeypatch):
    """However long the texts of a batch are, so many bytes at a time; no row is lost or out of order."""
    import pyarrow as pa

    monkeypatch.setattr(sketches, "PART_BYTES", 10)
    texts = ["", "abc", None, "é" * 3, "x" * 50, "y", "z" * 10, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped", *texts])], names=["text"]).slice(1)
    found = [p.column("text").to_pylist() for p in sketches.parts(batch)]
    assert sum(found, []) == texts and len(found) > 2
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in found)

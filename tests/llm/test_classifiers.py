"""Quality and language on held-out rows, and their odd cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bytecnn, langid, quality
from ledgerloom.llm.sampling import fold, thinned


def test_windows_cover_everything():
    data = bytes(range(1, 201))
    cut = bytecnn.windows(data, 64, 48)
    assert {b for w in cut for b in w} - {0} == set(data) and bytecnn.windows(b"", 64, 48).shape == (1, 64)
    assert len(bytecnn.windows(data * 50, 64, 48, most=5)) == 5


TEXTS = [b"", b"a", bytes(range(1, 256)) * 3, b"word " * 9000, b"x" * 127, b"y" * 128, b"z" * 129] + [bytes([65 + i % 26]) * (i * 7) for i in range(60)]


def test_groups_hold_each_window_once(monkeypatch):
    for together in (1, 3, 50, 4096):
        monkeypatch.setattr(bytecnn, "TOGETHER", together)
        got: dict = {}
        for numbers, x, starts in bytecnn.grouped(TEXTS, 128, 96):
            for i, part in zip(numbers, np.split(x, starts[1:]), strict=True):
                got.setdefault(i, []).append(part)
        assert sorted(got) == list(range(len(TEXTS)))
        assert all(np.array_equal(np.concatenate(got[i]), bytecnn.windows(t, 128, 96)) for i, t in enumerate(TEXTS))


def by_place(net, data, length, stride):
    """Pooled filters of each window by a plain loop over its places."""
    out = []
    for w in bytecnn.windows(data, length, stride):
        row = []
        for t in net.tables:
            for f in range(t.shape[2]):
                row.append(max(sum(float(t[j, w[at + j], f]) for j in range(len(t))) for at in range(length - len(t) + 1)))
        out.append([max(0.0, r + float(b)) for r, b in zip(row, net.bias, strict=True)])
    return np.array(out)


def test_scores_are_those_of_a_plain_loop():
    texts = ["", "short", "Some words, und noch mehr davon. " * 14, None]
    rng = np.random.default_rng(5)
    net = bytecnn.ByteCnn({3: 2, 6: 2}, 2, 8, seed=3, sees_padding=True)
    net.dense = rng.normal(0, 1, net.dense.shape).astype(np.float32)
    got = quality.Quality(net, 0.3).scores(texts * 2)
    for i, t in enumerate(texts):
        pooled = by_place(net, (t or "").encode(), quality.CHUNK, quality.STRIDE)
        z = np.concatenate([pooled.mean(0), pooled.max(0)]) @ net.dense + net.dense_bias
        assert got[i] == got[i + len(texts)] == pytest.approx(1 / (1 + np.exp(-(z[1] - z[0] + 0.3))), rel=1e-4)
    net = bytecnn.ByteCnn({2: 2, 4: 2}, 3, 4, seed=4)
    net.dense = rng.normal(0, 1, net.dense.shape).astype(np.float32)
    shares = langid.Languages(net, ["a", "b"]).shares([t or "" for t in texts] * 2)
    for i, t in enumerate(texts[1:3], 1):
        pooled, cut = by_place(net, t.encode(), langid.LENGTH, langid.LENGTH), bytecnn.windows(t.encode(), langid.LENGTH, langid.LENGTH)
        z = np.exp(pooled @ net.dense + net.dense_bias)
        expected = ((z / z.sum(1, keepdims=True)) * (cut != 0).sum(1)[:, None]).sum(0) / (cut != 0).sum()
        assert shares[i] == pytest.approx(expected, rel=1e-4) and np.array_equal(shares[i], shares[i + len(texts)])


def test_gradients():
    net = bytecnn.ByteCnn({3: 4}, 2, 4, seed=1)
    x = np.random.default_rng(0).integers(1, 256, (5, 20)).astype(np.uint8)
    pooled, at = net.pooled(x, places=True)
    g = net.table_grads(x, at, (pooled > 0).astype(np.float32))[0]
    j, b, f = np.unravel_index(np.abs(g).argmax(), g.shape)
    net.tables[0][j, b, f] += 1e-3
    assert (net.pooled(x).sum() - pooled.sum()) / 1e-3 == pytest.approx(g[j, b, f], rel=0.05)


def test_quality_held_out(spark, docs):
    sf = "/root/testdata/sf0.01"
    got = quality.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == got["predicted"].astype(bool)).all()


def test_quality_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([(i % 3, i % 2, "x") for i in range(20)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    rows = docs(odd)
    model = quality.fit(rows, labels)
    assert quality.scored(rows, model).count() == len(odd)
    for n in (labels.limit(0), labels.where("quality = 1")):
        got = quality.scored(rows, quality.fit(rows, n)).collect()
        assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored(rows.limit(0), model).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op4_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert not got["foreign"].any()


def test_language_odd_rows(docs, odd, real):
    rows = docs([*odd, *real])
    model = langid.fit(docs(real))
    got = langid.identified(rows, model).collect()
    assert len(got) == len(odd) + len(real)
    by_id = {r["doc_id"]: r for r in langid.identified(docs(odd), model).collect()}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 9)) and by_id[4]["lang_pred"] != "und"
    assert langid.identified(docs(odd), langid.fit(docs([]))).where("lang_pred != 'und'").count() == 0
    assert {r["lang_pred"] for r in langid.identified(docs([(1, "a b")]), langid.fit(docs([(1, "a", "en")]))).collect()} == {"en"}


def test_training_is_repeatable(docs, real):
    one, two = (langid.fit(docs(real)) for _ in range(2))
    assert all(np.array_equal(a, b) for a, b in zip(one.net.params(), two.net.params(), strict=True))


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    some, counts = thinned(rows, "y", 500)
    assert sum(counts.values()) == 20_000 and all(380 < r["count"] < 620 for r in some.groupBy("y").count().collect())
    assert spark.range(10).select(F.col("id").alias("doc_id")).where(fold(5).isNull()).count() == 0


def test_sample_of_an_id_on_many_rows(docs):
    """Whatever share of the rows has one doc_id, the driver gets the windows of one of them."""
    from ledgerloom.llm import sampling

    rows = [(7, f"some text {i}", "en") for i in range(3000)] + [(7, "same", "en")] * 500 + [(i, "other text", "de") for i in range(100, 120)]
    some, counts = sampling.thinned(docs(rows).select("doc_id", "text", "lang"), "lang", 5000)
    assert counts == {"en": 3500, "de": 20} and some.count() == 3520
    found, labels = sampling.windowed(some, "lang", 64, 64, 4)
    assert len(found) == 21 and sorted(labels) == ["de"] * 20 + ["en"]
    again, _ = sampling.windowed(some.repartition(5), "lang", 64, 64, 4)
    assert all((x == y).all() for x, y in zip(found, again, strict=True))

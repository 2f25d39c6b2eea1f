"""The stages on planted documents, and the registry."""

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import minhash, mixing, registry


def test_names():
    import __spark_entry__ as entry

    ops = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(set(registry.queries()) - set(ops)) == ["edited_texts", "mix_targets", "shard_laws", "url_rules"]  # views of operators
    assert sorted(ops) == ["op10_fingerprints", "op1_minhash_dedup", "op2_quality_classifier", "op3_html_extraction", "op4_language_id", "op5_decontamination", "op6_url_filter", "op7_consistent_sharding", "op8_token_counts", "op9_source_mix"]
    assert set(registry.oracle_sql()) < set(registry.queries()) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "sharding"]


def test_stages(spark, small, docs, real):
    item = spark.read.parquet(f"{small}/benchmark.parquet").first()["text"]
    long = real[0][1]
    planted = [(9001, None), (9002, "1234 !!!"), (9003, long + " one more"), (9003, long + " one more"), (9004, f"Some words before {item} and some more after it"), (9005, "A clean and short text of its own"),
               (9006, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4), (9007, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 5), (9008, "我能吞下玻璃而不伤身体。" * 12),
               (9003, "Another text that has the id of a copy but says something else"), (None, long + " and more"), (None, "A text without any id that nobody else has"), (None, "A text without any id that nobody else has")]
    rows = docs([*real, *[(d, t, None, "own") for d, t in planted]])
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    out = stages["language_id"](spark, rows, small)
    assert ids(rows) - ids(out) == {9001, 9002, 9006, 9007, 9008} and out.columns == rows.columns
    deduped = stages["near_dedup"](spark, out, small)
    assert real[0][0] in ids(deduped) and {9004, 9005} <= ids(deduped) and deduped.columns == rows.columns
    assert [r["text"][:7] for r in deduped.where("doc_id = 9003").collect()] == ["Another"] and [r["text"][:7] for r in deduped.where("doc_id IS NULL").collect()] == ["A text "]
    # no two rows that are left are near copies
    again = minhash.near_duplicates(deduped).where("component IS NOT NULL")
    assert again.count() == again.select("component").distinct().count()
    clean = stages["decontamination"](spark, deduped, small)
    assert 9004 not in ids(clean) and 9005 in ids(clean) and clean.columns == rows.columns
    mix = stages["source_mix"](spark, clean, small)
    size: dict = {}
    for r in clean.select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).collect():
        size[r["source"]] = size.get(r["source"], 0) + r["n"]
    goal = mixing.targets(size)
    got = {r["source"]: r["n"] for r in mix.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert all(abs(got.get(k, 0) - v) <= max(2, 0.03 * v) for k, v in goal.items() if size[k] > 2000) and mix.columns == rows.columns
    last = stages["sharding"](spark, mix, small).collect()
    assert len(last) == mix.count()
    counts = [sum(r["shard"] == s for r in last) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_columns_of_any_name_stay(spark, small, docs, real):
    """Columns that are called like those of the stages."""
    names = ["__key", "__k", "__t", "__text_key", "__copy", "__times", "__lang_pred", "__foreign", "__hot", "__salt", "__row", "component", "kind", "h", "k_text", "one"]
    rows = docs(real[:120]).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, small)
        assert set(names) < set(rows.columns) and all(r[n] == i for r in rows.limit(3).collect() for i, n in enumerate(names))
    assert corpus_pipeline.STAGES[-1][1](spark, rows, small).count() == rows.count()


def test_stages_of_no_documents(spark, small, docs):
    rows = docs([])
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, small)
    assert rows.count() == 0


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 100 and corpus_pipeline.ORACLE_SQL is None

"""Micro-batches against one batch."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import facts
from ledgerloom.plans import pipeline
from ledgerloom.streaming.incremental import KnowledgeStore

PAGE = f"document_id string, document_name string, ingest_seq long, page int, text string, blocks {facts.BLOCKS_TYPE}"


@pytest.fixture(scope="module")
def pages(spark):
    intro = "Acme Acme Acme Acme Acme Acme.\n\n"
    said = ["Consolidated revenue from operations stood at ₹ 81,415.38 million in FY2024.", "Revenue from operations stood at ₹8,142 Cr in FY2024.", "Revenue from operations stood at ₹ 9,000 Cr in FY2024.", "Standalone revenue from operations stood at ₹ 7,000 Cr in FY2023."]
    return spark.createDataFrame([(f"d{i}", f"acme-{i}.txt", i, 1, intro + s, []) for i, s in enumerate(said)], PAGE)


def plain(rels):
    return sorted((r["relationship_id"], r["relation"], r["confidence"]) for r in rels.collect())


@pytest.mark.parametrize("cuts", [(0, 1, 2, 3, 4), (0, 3, 4)])
def test_any_cut_gives_the_same(spark, pages, tmp_path, cuts):
    store = KnowledgeStore(f"file://{tmp_path}/store")
    for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        store.add(pages.where(F.col("ingest_seq").between(low, high - 1)), i)
    batch = pipeline.build(pages)
    assert plain(store.relationships(spark)) == plain(batch.relationships) and len(plain(batch.relationships)) == 6
    assert store.facts(spark).count() == batch.facts.count()


def test_batches_may_run_again_and_copies_add_nothing(spark, pages, tmp_path):
    store = KnowledgeStore(f"file://{tmp_path}/store")
    store.add(pages.where("ingest_seq < 2"), 0)
    store.add(pages.where("ingest_seq >= 2"), 1)
    once = plain(store.relationships(spark))
    store.add(pages.where("ingest_seq >= 2"), 1)  # the same batch, after a failure
    store.add(pages, 2)  # known documents
    assert plain(store.relationships(spark)) == once
    assert store.table(spark, "documents").count() == 4

"""A training corpus in five stages: each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, langid, minhash, mixing, sharding
from ledgerloom.llm.common import scratch, shared_dir, table, written
from ledgerloom.llm.sampling import fold


#: Begins the names of columns that stages add for themselves.
OWN = "__pipeline_"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the learned languages, null texts and texts without a letter among them; the model comes from the labelled rows of the training folds of documents."""
    model = langid.fit(table(spark, sf_dir, "documents").where(fold(4) != 2))
    found = langid.identified(docs, model, keep=docs.columns, prefix=OWN)
    return found.where(~F.col(f"{OWN}foreign")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group (five-word shingles, 0.8): that with the smallest doc_id, of rows of one doc_id that with the smallest hash of its text. Of rows alike in doc_id and text one stays; texts without shingles are no group."""
    found = minhash.near_duplicates(docs).select("component", "doc_id", "text_key")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_key")
    kept = first.union(found.where("component IS NULL").select("doc_id", "text_key")).distinct().select(F.xxhash64("doc_id", "text_key").alias(f"{OWN}row"), F.col("doc_id").alias(f"{OWN}doc"), F.col("text_key").alias(f"{OWN}text"))
    named = docs.withColumns({f"{OWN}key": F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), f"{OWN}text_key": F.xxhash64("text")})
    same = (F.col(f"{OWN}key") == F.col(f"{OWN}row")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{OWN}doc")) & (F.col(f"{OWN}text_key") == F.col(f"{OWN}text"))
    alone = named.join(kept.hint("merge"), same, "left_semi")
    return alone.dropDuplicates([f"{OWN}key"]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("text_key").alias(f"{OWN}leak")).distinct()
    return docs.join(found, F.xxhash64("text") == F.col(f"{OWN}leak"), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    chosen = mixing.mixed(docs, docs.columns, prefix=OWN).where(f"{OWN}times > 0")
    return chosen.select(*docs.columns, F.explode(F.expr(f"sequence(1, {OWN}times)")).alias(f"{OWN}copy")).drop(f"{OWN}copy")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.placed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharded),
]

#: Learned models and seeded choices are no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as kept:
            kept.append(docs := written(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents that come in over time: each micro-batch is held against what is stored.

State is three Parquet tables (documents, facts, relationships), partitioned by batch_id. A batch
that runs again overwrites its own partition, so the sink is idempotent. Facts are also partitioned
by a hash of their entity: a batch reads only the parts of its own entities, as facts of different
entities never meet. Fact ids hold their document's, and a document comes in one batch only, so
facts of one id are settled within their batch and the store is never sorted out as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..operators.candidates import entity_key, stored
from ..operators.facts import extract_facts
from ..plans.pipeline import relate
from ..plans.store import merged
from ..sources.shared import scratch, written

#: Parts of the fact table by entity.
PARTS = 64
#: ingest_seq of a batch: its own numbers behind those of the batches before. given_seq keeps what came.
BATCH_SPAN = 10**12


def part_of(entity: str) -> Column:
    return F.pmod(F.xxhash64(entity_key(F.col(entity))), F.lit(PARTS)).cast("int")


class KnowledgeStore:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _read(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame | None:
        base = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not base.getFileSystem(spark._jsc.hadoopConfiguration()).exists(base):
            return None
        rows = spark.read.parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        return self._read(spark, name)

    def _put(self, rows: DataFrame, name: str, batch_id: int, *parts: str) -> None:
        rows = rows.withColumn("batch_id", F.lit(batch_id))
        if parts:
            rows = rows.repartition(*parts)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *parts).parquet(f"{self.path}/{name}")

    def add(self, pages: DataFrame, batch_id: int, config: EngineConfig = EngineConfig()) -> None:
        """Takes a batch of pages (document_id, document_name, ingest_seq, page, text, blocks); documents known by content are left out.

        What comes in a later batch is newer, whatever number it brings: ingest_seq counts on from
        batch_id * BATCH_SPAN, given_seq of the documents is the number that came.
        """
        spark = pages.sparkSession
        pages = pages.withColumn("given_seq", F.col("ingest_seq")).withColumn("ingest_seq", F.col("ingest_seq") + F.lit(batch_id * BATCH_SPAN))
        known, facts = self._read(spark, "documents", batch_id), self._read(spark, "facts", batch_id)
        if known is not None:
            pages = pages.join(known.select("document_id"), "document_id", "left_anti")
        first = pages.groupBy("document_id").agg(F.min("ingest_seq").alias("ingest_seq"))
        with scratch():
            pages = written(pages.join(first, ["document_id", "ingest_seq"], "left_semi"), "pages")
            new = written(extract_facts(pages.drop("given_seq"), config).withColumn("part", part_of("canonical_entity")), "new")
            old = stored(new)
            if facts is not None:
                touched = [r["part"] for r in new.select("part").distinct().collect()]  # PARTS at most
                old = old.unionByName(facts.where(F.col("part").isin(touched)).drop("batch_id"))
            self._put(relate(new, old, config), "relationships", batch_id)
            self._put(pages.groupBy("document_id", "document_name", "ingest_seq", "given_seq").agg(F.count("*").alias("page_count")), "documents", batch_id)
            self._put(stored(new), "facts", batch_id, "part")

    def facts(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "facts").drop("batch_id", "part")

    def relationships(self, spark: SparkSession) -> DataFrame:
        """Of relationships with one id, the one of the last batch."""
        rows = self._read(spark, "relationships")
        return merged(rows.limit(0), rows, "relationship_id", "batch_id").drop("batch_id")


def ingest_stream(spark: SparkSession, source: str, schema: T.StructType, store: KnowledgeStore, checkpoint: str, files_per_batch: int = 1, config: EngineConfig = EngineConfig()):
    """Runs through all files of pages under `source` and stops; call it again for what came since."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: store.add(df, i, config)).start()

"""What driver and executors share: a folder for tables, and this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers find this package where it lies, wherever the session was started."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset on a single machine, a folder of our own that goes when Python ends. A cluster has to name a folder that all its machines see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written inside the innermost scratch().
_open: ContextVar[list | None] = ContextVar("written", default=None)


@contextmanager
def scratch(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Tables that are written() inside go at the end, but for those put into the list that it gives."""
    token, keep = _open.set(made := []), list(kept)
    try:
        yield keep
    finally:
        _open.reset(token)
        forget(*[t for t in made if all(t is not k for k in keep)])
        if (outer := _open.get()) is not None:
            outer += keep


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor costs nothing but a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    if (made := _open.get()) is not None:
        made.append(out)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written() tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._ledgerloom_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. One that lies in fewer pieces than there are cores is dealt out, as work on its rows costs more than moving them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)

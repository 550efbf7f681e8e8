"""Helpers shared by the operators: lineage cuts, and joins against id sets of a checked size."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id sets up to this many rows (16 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_IDS = 1_000_000

_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR or not os.path.isdir(_OWN_DIR[0].removeprefix("file://")):
        _OWN_DIR.clear()
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="mnemoframe-"))
    return _OWN_DIR[0]


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mnemoframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Hand whole texts to Python in batches of at most ``rows`` rows, so that memory does not follow the default of 10,000; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/mnemoframe/" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does so once the driver has collected their plans as garbage, which a driver with room to spare puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Mark ``ids`` for broadcast if it has at most ``limit`` rows; else leave the join to a shuffle."""
    n = ids.limit(limit + 1).count()
    return F.broadcast(ids) if n <= limit else ids


def row_key(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "_row", more: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with a struct that tells rows apart by key, text and the columns ``more``; rows equal in these share it."""
    return docs.withColumn(out, F.struct(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t"), *[F.col(c) for c in more]))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as keep it from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, rejected: DataFrame, key: str = "_row") -> DataFrame:
    """``docs`` without the rows whose key is in ``rejected``, null-safely."""
    out = unused(docs, "_gone")
    gone = small(rejected.select(F.col(key).alias(out)).distinct())
    return docs.join(gone, F.col(key).eqNullSafe(F.col(out)), "left_anti")

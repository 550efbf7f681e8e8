"""Run logs as streams: an extension for logs that are still growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.schemas import LOG_LINE
from mnemoframe.sources.files import SEED_DIR


def read_lines(spark: SparkSession, glob: str, max_files: int = 1000) -> DataFrame:
    """Parsed log lines of every file that appears under ``glob``."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(glob)
    rows = lines.filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("p"), F.from_json("value", LOG_LINE).alias("r"))
    return rows.select(F.regexp_extract("p", SEED_DIR, 1).alias("exp"), F.regexp_extract("p", SEED_DIR, 2).cast("int").alias("seed"), "r.record_type", "r.data")


def record_counts(lines: DataFrame) -> DataFrame:
    """Running number of records of each kind in each run."""
    return lines.groupBy("exp", "seed", "record_type").agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window, with a watermark for late ones."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

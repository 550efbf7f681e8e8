"""Scores over seeds: mean, sample standard deviation, count, and the results table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.schemas import METRICS

#: Fewer seeds than this are not to be reported.
MIN_SEEDS = 3


def metrics_long(scores: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(exp, seed, metric, value): one row for each metric of each run, nulls included."""
    have = [m for m in metrics if m in scores.columns]
    return scores.select("exp", "seed", *[F.col(m).cast("double").alias(m) for m in have]).unpivot(["exp", "seed"], have, "metric", "value")


def aggregate_seeds(long: DataFrame) -> DataFrame:
    """Per experiment and metric: mean, std (0.0 for a single value), n_seeds; metrics without a value do not appear."""
    out = long.groupBy("exp", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n_seeds"))
    out = out.filter("n_seeds > 0").withColumn("std", F.when(F.col("n_seeds") == 1, F.lit(0.0)).otherwise(F.col("std")))
    return out.withColumn("reportable", F.col("n_seeds") >= MIN_SEEDS)


def results_table(aggregated: DataFrame) -> DataFrame:
    return aggregated.select(
        F.col("metric").alias("Metric"), F.col("mean").alias("Mean"), F.col("std").alias("Std"), X.mean_and_std(F.col("mean"), F.col("std")).alias("Reported"),
        F.col("n_seeds").alias("N_Seeds"), F.col("exp").alias("Experiment"),
    )


def metric_comparison(table: DataFrame, group: str = "Experiment") -> DataFrame:
    """The numbers behind a bar chart: mean of means and of deviations per group."""
    return table.groupBy(group).agg(F.avg("Mean").alias("Mean"), F.avg("Std").alias("Std"))


def token_totals(probes: DataFrame) -> DataFrame:
    return probes.groupBy("exp", "seed").agg(F.sum("metadata.tokens").alias("tokens"))

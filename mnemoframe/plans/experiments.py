"""The three entry points: run experiments, score their logs, aggregate over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.config import RunConfig
from mnemoframe.operators import aggregate, runner, score
from mnemoframe.plans.lineage import cut
from mnemoframe.sources import files

#: Fixed facts, scored where no bank is given.
SMOKE_FACTS = [
    {"id": "smoke_1", "domain": "health", "entity": "user", "relation": "allergic_to", "value": "peanuts", "surface": {"en": "I am allergic to peanuts.", "hi": "मुझे मूंगफली से एलर्जी है।"}, "probe_questions": {"en": "What food am I allergic to?", "hi": "मुझे किस चीज़ से एलर्जी है?"}},
    {"id": "smoke_2", "domain": "travel", "entity": "user", "relation": "lives_in", "value": "pune", "surface": {"en": "I live in Pune.", "hi": "मैं पुणे में रहता हूँ।"}, "probe_questions": {"en": "Where do I live?", "hi": "मैं कहाँ रहता हूँ?"}},
    {"id": "smoke_3", "domain": "work", "entity": "user", "relation": "works_at", "value": "infosys", "surface": {"en": "I work at Infosys.", "hi": "मैं इंफोसिस में काम करता हूँ।"}, "probe_questions": {"en": "Where do I work?", "hi": "मैं कहाँ काम करता हूँ?"}},
    {"id": "smoke_4", "domain": "preferences", "entity": "user", "relation": "favorite_food", "value": "biryani", "surface": {"en": "My favorite food is biryani.", "hi": "मेरा पसंदीदा खाना बिरयानी है।"}, "probe_questions": {"en": "What is my favorite food?", "hi": "मेरा पसंदीदा खाना क्या है?"}},
    {"id": "smoke_5", "domain": "family", "entity": "user", "relation": "owns_pet", "value": "dog", "surface": {"en": "I have a pet dog.", "hi": "मेरे पास एक पालतू कुत्ता है।"}, "probe_questions": {"en": "What pet do I have?", "hi": "मेरे पास कौन सा पालतू जानवर है?"}},
]


def facts_or_smoke(spark: SparkSession, path: str | None, n_facts: int | None = None) -> DataFrame:
    """A bank's facts; the smoke facts where there is no bank."""
    try:
        return files.read_facts(spark, path or "", n_facts)
    except FileNotFoundError:
        return files.facts_frame(spark, SMOKE_FACTS)


def run_experiment(spark: SparkSession, config: RunConfig, root: str, facts: DataFrame | None = None, respond: runner.Respond | None = None, offline: bool = False) -> list[str]:
    """Run all seeds on the native store, in one plan, and write their snapshots and logs; returns the folders.

    All seeds are looked for first: nothing runs if one of them is there already.  ``offline`` lets the native
    store stand in for an external one, whose name the log keeps; without it such a configuration is an error.
    """
    if config.framework != "mock" and not offline:
        raise ValueError(f"{config.framework} is an external store; only the native one (mock) runs here, or stands in for it offline")
    files.ensure_absent(spark, root, config.experiment, config.seeds)
    if facts is None:
        facts = files.read_facts(spark, config.benchmark.fact_bank, config.benchmark.n_facts)
    kwargs = {"respond": respond} if respond else {}
    run = runner.run_seeds(facts, config.experiment, config.seeds, config.languages.store, config.languages.probe, config.benchmark.filler_sessions, config.framework, **kwargs)
    rows = files.run_rows(*[x.withColumn("exp", F.lit(config.experiment)) for x in (run.plant, run.final, run.log)])
    return files.write_runs(rows, root, [(config.experiment, x) for x in config.seeds])


def score_logs(spark: SparkSession, root: str, facts: DataFrame, write: bool = True) -> DataFrame:
    """Scores of all runs under ``root``, in one job rather than a loop over folders."""
    log = cut(files.read_log(spark, root))
    scores = score.score_runs(facts, files.read_snapshots(spark, root), files.probes(log), files.runs(log))
    if write:
        files.write_scores(scores, root)
        scores = files.read_scores(spark, root)
    return scores


def aggregate_scores(scores: DataFrame, root: str | None = None) -> DataFrame:
    """The results table of all experiments; written as CSV if a root is given."""
    table = aggregate.results_table(aggregate.aggregate_seeds(aggregate.metrics_long(scores)))
    if root:
        files.write_results(table, root)
    return table


def views(spark: SparkSession, **frames: DataFrame) -> None:
    """Make frames available to spark.sql under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)

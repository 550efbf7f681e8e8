"""A run over the native store: the phases of a script as staged DataFrames, and the run log they leave.

Answers come from ``respond``, a function from a prompt column to an answer
column; the default is the offline mock.  A live model goes in as a pandas UDF.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.operators import script, store
from mnemoframe.plans.lineage import cut

Respond = Callable[[Column], Column]


@dataclass
class Run:
    """What runs leave, by seed: two snapshots and the log (line, value)."""

    plant: DataFrame
    final: DataFrame
    log: DataFrame


def question(facts: DataFrame, probe_lang: str) -> Column:
    """The question that a probe asks when it is not given one."""
    asked = F.col("probe_questions")
    has = F.coalesce(F.map_contains_key(asked, F.lit(probe_lang)), F.lit(False))
    return F.when(has, F.try_element_at(asked, F.lit(probe_lang))).otherwise(X.fallback_probe(F.col("relation"), probe_lang, transliterated=False))


def probe(memory: DataFrame, queries: DataFrame, store_lang: str, probe_lang: str, k: int = 5, respond: Respond = X.mock_response) -> DataFrame:
    """Probe records by (user_id, pos).  ``queries``: (pos, fact_id, user_id, query).  Hits are never judged here."""
    found = store.retrieve(memory, queries.select(F.struct("user_id", "pos").alias("query_id"), "user_id", "query"), k)
    record = F.struct("rank", "raw_id", "text", "lang_detected", F.map_entries("metadata").alias("meta"))
    plain = lambda x: F.struct(x["raw_id"].alias("raw_id"), x["text"].alias("text"), x["lang_detected"].alias("lang_detected"), F.map_from_entries(x["meta"]).alias("metadata"))
    found = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(record)), plain).alias("retrieved"))  # k records at most
    rows = queries.join(found.select("query_id.user_id", "query_id.pos", "retrieved"), ["user_id", "pos"], "left")
    none = F.array().cast(found.schema["retrieved"].dataType)
    rows = rows.withColumn("retrieved", F.coalesce("retrieved", none))
    lines = F.array_join(F.transform("retrieved", lambda m: F.concat(F.lit("- "), m["text"])), "\n")
    context = F.when(F.size("retrieved") > 0, lines).otherwise("None")
    prompt = F.concat(F.lit("User Memories:\n"), context, F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nAnswer:"))
    rows = rows.withColumn("prompt", prompt).withColumn("response", respond(F.col("prompt")))
    tokens = (F.size(X.words(F.col("prompt"))) + F.size(X.words(F.col("response")))).cast("long")
    return rows.select(
        "user_id", "pos", "fact_id", F.lit(store_lang).alias("store_lang"), F.lit(probe_lang).alias("probe_lang"), "retrieved", "response",
        F.lit(False).alias("hit_strict"), F.lit(False).alias("hit_lenient"), F.struct(tokens.alias("tokens"), F.lit(0.0).alias("latency")).alias("metadata"),
    )


def traces(turns: DataFrame, memory: DataFrame) -> DataFrame:
    """Trace records of ingested turns; ``memory`` holds what the store made of them, in the same order."""
    own = Window.partitionBy("user_id").orderBy("seq")
    t = turns.withColumn("n", F.row_number().over(own))
    m = memory.withColumn("n", F.row_number().over(own)).select("user_id", "n", "raw_id")
    out = t.join(m, ["user_id", "n"])
    fields = ("session_id", "kind", "fact_id", "lang", "text")
    wrote = F.struct(*[F.col(f) for f in fields], F.lit(True).alias("write_success"), F.col("raw_id").alias("memory_id"))
    changed = F.struct(*[F.col(f) for f in fields], F.lit(True).alias("update_success"), F.col("raw_id").alias("updated_memory_id"))
    line = lambda s: F.to_json(F.struct(F.lit("turn_trace").alias("record_type"), s.alias("data")), {"ignoreNullFields": "false"})
    return out.select("user_id", F.col("seq").alias("pos"), F.when(F.col("kind") == "correction", line(changed)).otherwise(line(wrote)).alias("value"))


def run_seed(facts: DataFrame, experiment: str, seed: int, store_lang: str, probe_lang: str, filler_sessions: int = 1, **options) -> Run:
    """One run: see :func:`run_seeds`."""
    run = run_seeds(facts, experiment, [seed], store_lang, probe_lang, filler_sessions, **options)
    return Run(run.plant.drop("seed"), run.final.drop("seed"), run.log.drop("seed"))


def run_seeds(
    facts: DataFrame, experiment: str, seeds: list[int], store_lang: str, probe_lang: str, filler_sessions: int = 1, framework: str = "mock",
    k: int = 5, respond: Respond = X.mock_response, now: float | None = None, draws: str = "twister",
) -> Run:
    """Plant, consolidate, snapshot, filler, probe, correct, ask again, snapshot: the runs of all seeds go through each step together, a user each."""
    spark = facts.sparkSession
    user = F.concat(F.lit(f"user_{experiment}_"), F.col("seed").cast("string"))
    facts = cut(facts)
    turns = cut(script.split_phases(script.build_scripts(facts, store_lang, probe_lang, seeds, filler_sessions, draws=draws)).withColumn("user_id", user))
    phase = lambda *names: turns.filter(F.col("phase").isin(*names))
    w = Window.partitionBy("id").orderBy(F.col("seq").desc())
    by_id = facts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "relation", "probe_questions")
    owner = F.col("user_id")

    written = cut(store.write(store.empty(spark), phase("plant"), owner))
    plant = cut(store.consolidate(written))
    filled = cut(store.write(plant, phase("filler"), owner))
    before = cut(store.consolidate(filled))
    asked = phase("probe").withColumnRenamed("seq", "pos").join(by_id, F.col("fact_id") == F.col("id"))
    first = cut(probe(before, asked.select("pos", "fact_id", "user_id", question(facts, probe_lang).alias("query")), store_lang, probe_lang, k, respond))
    fixed = cut(store.update(before, phase("correction"), owner))
    after = cut(store.consolidate(fixed))
    again = phase("reprobe").withColumnRenamed("seq", "pos").join(by_id, F.col("fact_id") == F.col("id"))
    second = cut(probe(after, again.select("pos", "fact_id", "user_id", F.col("text").alias("query")), store_lang, probe_lang, k, respond))

    n = facts.count()
    users = spark.createDataFrame([(f"user_{experiment}_{x}", x) for x in seeds], "user_id string, seed int")  # one row a seed
    head = spark.createDataFrame(
        [("metadata", time.time() if now is None else now, experiment, framework, x, store_lang, probe_lang, n) for x in seeds],
        "record_type string, timestamp double, experiment string, framework string, seed int, store_lang string, probe_lang string, n_facts int",
    )
    new = lambda df, old: df.join(old.select("user_id", "seq"), ["user_id", "seq"], "left_anti")

    def record(df: DataFrame, kind: str) -> DataFrame:
        data = F.struct(*[F.col(c) for c in df.columns if c not in ("user_id", "pos")])
        return df.select("user_id", "pos", F.to_json(F.struct(F.lit(kind).alias("record_type"), data.alias("data")), {"ignoreNullFields": "false"}).alias("value"))

    parts = [
        head.select(user.alias("user_id"), F.lit(0).cast("long").alias("pos"), F.to_json(F.struct("*")).alias("value")),
        traces(phase("plant"), written), traces(phase("filler"), new(filled, plant)), traces(phase("correction"), new(fixed, before)),
        record(first, "probe_result"), record(second, "reprobe_result"),
    ]
    log = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        log = p if log is None else log.unionByName(p)
    line = (F.row_number().over(Window.partitionBy("user_id").orderBy("part", "pos")) - 1).cast("long")
    log = log.select("user_id", line.alias("line"), "value")
    seeded = lambda df: df.join(F.broadcast(users), "user_id").drop("user_id")
    return Run(seeded(plant), seeded(after), seeded(log))

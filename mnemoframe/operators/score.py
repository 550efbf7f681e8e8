"""Scores of runs: write, retrieve, consolidate, update.

Everything is computed for all runs (exp, seed) at once.  One DataFrame of
matches, (exp, seed, snapshot, memory) x fact, feeds write fidelity, eligibility,
duplication and false merges.  A fact missing from the store is a write failure:
recall looks at written facts only, through a semi join in front.

A fact's identity is its position ``seq``; ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.operators.match import Index, contains_join
from mnemoframe.plans.lineage import cut, small

RUN = ["exp", "seed"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0.0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_keys(facts: DataFrame, use_aliases: bool = False) -> DataFrame:
    """Facts with ``keys``: of the value and of every surface sentence (and, as an option, of the value aliases)."""
    parts = [F.array("value"), F.coalesce(F.map_values("surface"), F.array().cast("array<string>"))]
    if use_aliases:
        parts.append(F.coalesce(F.flatten(F.map_values("value_aliases")), F.array().cast("array<string>")))
    return facts.withColumn("keys", X.match_keys(*parts))


def normalized(memories: DataFrame) -> DataFrame:
    """``memories`` with their normalised texts as ``normal``; a store that has them already is left as it is."""
    if "normal" in memories.columns:
        return memories
    return memories.withColumn("normal", X.normalize(F.coalesce("text", F.lit(""))))


def texts_of(memories: DataFrame) -> DataFrame:
    """(text_id, normal) of a store, as :func:`matches` and :func:`match.build_index` take it."""
    return normalized(memories).select(F.struct("exp", "seed", "snapshot", F.col("seq").alias("mem_seq")).alias("text_id"), "normal")


def matches(facts: DataFrame, memories: DataFrame | Index, plan: str = "auto", use_aliases: bool = False) -> DataFrame:
    """(exp, seed, snapshot, mem_seq, fact_seq): which memory holds which fact; a store that is scored often may come as an index of :func:`texts_of`."""
    keys = with_keys(facts, use_aliases).select(F.col("seq").alias("key_id"), F.explode("keys").alias("key"))
    texts = memories if isinstance(memories, Index) else texts_of(memories)
    return contains_join(keys, texts, plan).select("text_id.*", F.col("key_id").alias("fact_seq"))


def scored_store(matched: DataFrame, memories: DataFrame) -> DataFrame:
    """(exp, seed, snapshot): the final snapshot of each run, or the one after planting where the final one is empty."""
    has = memories.groupBy(*RUN).agg(F.max((F.col("snapshot") == "final").cast("int")).alias("f"))
    return has.select(*RUN, F.when(F.col("f") == 1, "final").otherwise("plant").alias("snapshot"))


def write_fidelity(facts: DataFrame, matched: DataFrame, runs: DataFrame, only: str | None = None) -> DataFrame:
    """Per run: the share of facts that the store holds after planting.  ``only``: a condition on facts, e.g. ``distractor_of IS NULL``."""
    pool = facts.filter(only) if only else facts
    n = pool.agg(F.count(F.lit(1)).alias("n"))
    found = matched.filter("snapshot = 'plant'").select(*RUN, "fact_seq").distinct().join(pool.select(F.col("seq").alias("fact_seq")), "fact_seq", "left_semi")
    got = runs.join(found.groupBy(*RUN).agg(F.count(F.lit(1)).alias("hits")), RUN, "left")
    return got.join(F.broadcast(n)).select(*RUN, ratio(F.coalesce("hits", F.lit(0)), F.col("n")).alias("write_fidelity"))


def written_facts(facts: DataFrame, matched: DataFrame) -> DataFrame:
    """(exp, seed, id, seq) of the written facts; a fact is eligible if any fact of its id was written."""
    ids = facts.select("id", "seq")
    found = matched.filter("snapshot = 'plant'").select(*RUN, F.col("fact_seq").alias("seq")).distinct().join(ids, "seq").select(*RUN, "id").distinct()
    return found.join(ids, "id").select(*RUN, "id", "seq")


def last_probes(probes: DataFrame, phase: str) -> DataFrame:
    """The last probe of each fact in each run."""
    w = Window.partitionBy(*RUN, "fact_id").orderBy(F.col("line").desc())
    return probes.filter(F.col("phase") == phase).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def recall(facts: DataFrame, probes: DataFrame, eligible: DataFrame, runs: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per run: recall at each k, strict and lenient, in one pass over the rank of the first hit.

    The denominator is the eligible facts; one without a probe is a miss.
    """
    keyed = with_keys(facts).select("seq", "keys")
    first = F.array_position(F.transform("retrieved", lambda m: X.contains_any(X.normalize(F.coalesce(m["text"], F.lit(""))), F.col("keys"))), True)
    asked = eligible.join(small(keyed), "seq").join(last_probes(probes, "probe"), [eligible["exp"].eqNullSafe(probes["exp"]), eligible["seed"].eqNullSafe(probes["seed"]), eligible["id"] == probes["fact_id"]], "left")
    asked = asked.select(eligible["exp"], eligible["seed"], first.alias("rank"), "hit_strict", "hit_lenient")
    out = []
    for mode in ("strict", "lenient"):
        flag = F.coalesce(F.col(f"hit_{mode}"), F.lit(False))
        out += [F.sum((F.coalesce(F.col("rank").between(1, k), F.lit(False)) | flag).cast("int")).alias(f"recall_at_{k}_{mode}") for k in ks]
    per = asked.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"), *out)
    names = [f"recall_at_{k}_{mode}" for mode in ("strict", "lenient") for k in ks]
    return runs.join(per, RUN, "left").select(*RUN, *[ratio(F.col(x), F.col("n")).alias(x) for x in names])


def duplication_rate(facts: DataFrame, matched: DataFrame, store: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: records beyond the first of each fact, by the number of facts."""
    n = facts.agg(F.count(F.lit(1)).alias("n"))
    per = matched.join(store, [*RUN, "snapshot"], "left_semi").groupBy(*RUN, "fact_seq").count()
    per = per.groupBy(*RUN).agg(F.sum(F.greatest(F.col("count") - 1, F.lit(0))).alias("excess"))
    return runs.join(per, RUN, "left").join(F.broadcast(n)).select(*RUN, ratio(F.coalesce("excess", F.lit(0)), F.col("n")).alias("duplication_rate"))


def distractor_pairs(facts: DataFrame, last_wins: bool = False) -> DataFrame:
    """(base, distractor) facts as structs: every base row with the distractor's base id, or only the last such row."""
    base = facts
    if last_wins:
        w = Window.partitionBy("id").orderBy(F.col("seq").desc())
        base = facts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    whole = F.struct(*[F.col(c) for c in facts.columns])
    left = base.select(F.col("id").alias("base_id"), whole.alias("base"))
    right = facts.filter("distractor_of IS NOT NULL").select(F.col("distractor_of").alias("base_id"), whole.alias("distractor"))
    return right.join(left, "base_id").select("base", "distractor")


def false_merge_rate(facts: DataFrame, matched: DataFrame, memories: DataFrame, store: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: the share of near-miss pairs that one record collapses.

    Different values: one record matches both facts.  Equal values: one record matches the base fact and names both entities.
    """
    pairs = distractor_pairs(facts).select(
        F.col("base.seq").alias("fact_seq"), F.col("distractor.seq").alias("other_seq"),
        (F.col("base.value") != F.col("distractor.value")).alias("by_value"),
        X.match_key(X.entity_stem(F.col("base.entity"))).alias("e1"), X.match_key(X.entity_stem(F.col("distractor.entity"))).alias("e2"),
    )
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    own = matched.join(store, [*RUN, "snapshot"], "left_semi")
    at = own.join(small(pairs), "fact_seq")
    record = [*RUN, "snapshot", "mem_seq"]
    value = at.filter("by_value").join(own.select(*record, F.col("fact_seq").alias("other_seq")), [*record, "other_seq"], "left_semi")
    texts = normalized(memories).select(*RUN, "snapshot", F.col("seq").alias("mem_seq"), "normal")
    entity = at.filter("NOT by_value AND e1 <> '' AND e2 <> ''").join(texts, record)
    entity = entity.filter(F.contains("normal", F.col("e1")) & F.contains("normal", F.col("e2")))
    merged = value.select(*RUN, "fact_seq", "other_seq").unionByName(entity.select(*RUN, "fact_seq", "other_seq")).distinct()
    per = merged.groupBy(*RUN).agg(F.count(F.lit(1)).alias("merged"))
    return runs.join(per, RUN, "left").join(F.broadcast(n)).select(*RUN, ratio(F.coalesce("merged", F.lit(0)), F.col("n")).alias("false_merge_rate"))


def is_stale(value: Column, updated: Column, response: Column, hit_strict: Column) -> Column:
    """The old value is still there, or neither the new value nor a judged hit is."""
    old = X.strict_match(response, value)
    new = F.when(F.coalesce(updated, F.lit("")) != "", X.strict_match(response, updated)).otherwise(False)
    return old | (~new & ~F.coalesce(hit_strict, F.lit(False)))


def staleness_rate(facts: DataFrame, probes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: stale facts by facts with an update; null, with a reason, where updates exist but nothing was asked again."""
    updates = facts.filter("update IS NOT NULL").select("id", "value", F.col("update.updated_value").alias("updated"))
    n = updates.agg(F.count(F.lit(1)).alias("n"))
    again = last_probes(probes, "reprobe")
    asked = again.join(small(updates), again["fact_id"] == updates["id"])
    asked = asked.withColumn("is_stale", is_stale(F.col("value"), F.col("updated"), F.coalesce("response", F.lit("")), F.col("hit_strict")).cast("int"))
    stale = asked.groupBy(*RUN).agg(F.sum("is_stale").alias("stale"))
    rows = probes.filter("phase = 'reprobe'").groupBy(*RUN).agg(F.count(F.lit(1)).alias("asked"))
    out = runs.join(stale, RUN, "left").join(rows, RUN, "left").join(F.broadcast(n))
    unknown = (F.col("n") > 0) & F.col("asked").isNull()
    rate = F.when(~unknown, ratio(F.coalesce("stale", F.lit(0)), F.col("n")))
    reason = F.when(unknown, F.create_map(F.lit("staleness_rate"), F.lit("no re-probe was recorded")))
    return out.select(*RUN, rate.alias("staleness_rate"), reason.alias("invalid_metrics"))


def score_runs(facts: DataFrame, memories: DataFrame, probes: DataFrame, runs: DataFrame, plan: str = "auto") -> DataFrame:
    """All ten metrics of every run in ``runs`` (exp, seed)."""
    facts, runs = cut(facts), cut(runs.select(*RUN).distinct())
    memories = cut(normalized(memories))  # once for all metrics
    matched = cut(matches(facts, memories, plan))
    store = scored_store(matched, memories)
    out = write_fidelity(facts, matched, runs)
    for part in (
        recall(facts, probes, written_facts(facts, matched), runs),
        duplication_rate(facts, matched, store, runs),
        false_merge_rate(facts, matched, memories, store, runs),
        staleness_rate(facts, probes, runs),
    ):
        out = out.join(part, RUN, "left")
    return out


def language_transfer_gap(recalls: DataFrame, recall: str = "recall", same: str = "same_lang") -> DataFrame:
    """Mean recall in the same language less that across languages; 0.0 if either has none."""
    mean = lambda c: F.avg(F.when(c, F.col(recall)))
    return recalls.agg(F.coalesce(mean(F.col(same)) - mean(~F.col(same)), F.lit(0.0)).alias("ltg"))


def encoding_asymmetry(recalls: DataFrame, lang: str = "lang", recall: str = "recall", first: str = "hi", second: str = "en") -> DataFrame:
    """Recall of facts stored in ``first`` less that of facts stored in ``second``."""
    of = lambda x: F.max(F.when(F.col(lang) == x, F.col(recall)))
    return recalls.agg((of(first) - of(second)).alias("encoding_asymmetry"))

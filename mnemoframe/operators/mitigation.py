"""Mitigations: pivot-language normalisation and cross-lingual duplicate resolution, over answers that a model gave beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.plans.lineage import cut


def normalize_turns(turns: DataFrame, translations: DataFrame, pivot: str = "en") -> DataFrame:
    """Turns in the pivot language: those of another language take their translation (seq, translated), or stay if it is blank."""
    out = turns.join(translations.select("seq", "translated"), "seq", "left")
    text = F.when(F.col("lang") == pivot, F.col("text")).otherwise(F.coalesce(F.nullif(F.trim("translated"), F.lit("")), F.col("text")))
    return out.withColumn("text", text).withColumn("lang", F.lit(pivot)).select(turns.columns)


def resolve_by_answer(turns: DataFrame, memories: DataFrame, answers: DataFrame) -> DataFrame:
    """(seq, is_duplicate, matched_id): an answer with a YES makes the turn a duplicate of the first memory."""
    first = memories.agg(F.min_by("raw_id", "seq").alias("first"))
    yes = F.coalesce(F.upper("answer").contains("YES"), F.lit(False)) & F.col("first").isNotNull()
    return turns.join(answers, "seq", "left").join(F.broadcast(first)).select("seq", yes.alias("is_duplicate"), F.when(yes, F.col("first")).alias("matched_id"))


def resolve_by_overlap(turns: DataFrame, memories: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The same without a model: the best memory by Jaccard similarity of normalised tokens, if that reaches the threshold.

    Prefix filter: in the order of rarity, two sets that reach the threshold share one of the first n - ceil(threshold * n) + 1
    tokens of each, so frequent words hardly ever make a pair.
    """
    words = lambda c: F.array_distinct(F.array_remove(F.split(X.normalize(c), " "), ""))
    t, m = cut(turns.select("seq", words(F.col("text")).alias("ws"))), cut(memories.select("raw_id", F.col("seq").alias("mseq"), words(F.col("text")).alias("ms")))
    often = cut(t.select(F.explode("ws").alias("w")).unionByName(m.select(F.explode("ms").alias("w"))).groupBy("w").count())

    def prefix(rows: DataFrame, key: list[str], ws: str) -> DataFrame:
        each = rows.select(*key, F.explode(ws).alias("w"), F.size(ws).alias("n")).join(often, "w")
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("count", "w"))
        return each.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select(*key, "w")

    pairs = prefix(t, ["seq"], "ws").join(prefix(m, ["raw_id", "mseq"], "ms"), "w").select("seq", "raw_id", "mseq").distinct()
    both = pairs.join(t, "seq").join(m, ["raw_id", "mseq"]).withColumn("c", F.size(F.array_intersect("ws", "ms")))
    both = both.withColumn("s", F.col("c") / (F.size("ws") + F.size("ms") - F.col("c"))).filter(F.col("s") >= threshold)
    best = both.groupBy("seq").agg(F.max_by("raw_id", F.struct("s", -F.col("mseq"))).alias("raw_id"))
    return turns.select("seq").join(best, "seq", "left").select("seq", F.col("raw_id").isNotNull().alias("is_duplicate"), F.col("raw_id").alias("matched_id"))

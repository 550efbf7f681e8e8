"""Session scripts: plant, filler, probe, correction, re-probe, each a projection of the facts.

A script is as long as a fact bank, so the rows of one seed are numbered in one window;
scripts of many seeds are made in one plan, with the seed as a column.

Distractors are shuffled and neutral turns chosen by the Mersenne Twister of the seed, in
the order in which :mod:`random` draws (``draws="twister"``), or by hashes of (seed, id), which SQL can say too (``"hash"``).
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X

#: Fixed texts: neutral turns by language.
FILLERS = [
    {
        "en": "How is the weather looking today?",
        "hi": "आज मौसम कैसा लग रहा है?",
        "hi-en": "Aaj weather kaisa lag raha hai?",
    },
    {
        "en": "Can you recommend a good book to read on machine learning?",
        "hi": "क्या आप मशीन लर्निंग पर पढ़ने के लिए कोई अच्छी किताब सुझा सकते हैं?",
        "hi-en": "Kya aap machine learning par koi achhi book recommend kar sakte ho?",
    },
    {
        "en": "What is the capital city of Australia?",
        "hi": "ऑस्ट्रेलिया की राजधानी कौन सा शहर है?",
        "hi-en": "Australia ki capital city kaun si hai?",
    },
    {
        "en": "Let's review the schedule for our upcoming project sprint.",
        "hi": "आइए हमारे आगामी प्रोजेक्ट स्प्रिंट की समय सारणी की समीक्षा करें।",
        "hi-en": "Aao hamare upcoming project sprint ka schedule review karein.",
    },
]


def _draw(*parts: Column) -> Column:
    """A repeatable number below 2**32 from the MD5 of the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[x.cast("string") for x in parts])), 1, 8), 16, 10).cast("long")


def _in(texts: Column, lang: str) -> Column:
    return F.try_element_at(texts, F.lit(lang))


def spoken(texts: Column, lang: str) -> Column:
    """A text in a language, or in English where that is missing or empty, or an empty text."""
    return X.first_filled(_in(texts, lang), _in(texts, "en"))


def correction_subset(facts: DataFrame, ratio: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """The first base facts with an update: a share of them, one at least, for each value of ``by``."""
    have = facts.filter("distractor_of IS NULL AND update IS NOT NULL")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    return have.withColumns({"_rank": rank, "_n": n}).filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))).drop("_rank", "_n")


def twister_draws(spark: SparkSession, seeds: list[int], distractors: DataFrame, sessions: int) -> DataFrame:
    """(seed, step, other, choice): for every filler session the place of its distractor among all (null if they have run out), and the neutral turn.

    A generator shuffles all places, then chooses session by session; one row a seed enters.
    """

    @F.pandas_udf("struct<other: array<int>, choice: array<int>>")
    def draw(seed: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for x, size in zip(seed, n):
            rng, places = random.Random(int(x)), list(range(int(size)))
            rng.shuffle(places)
            rows.append((places[:sessions], [rng.choice(range(len(FILLERS))) for _ in range(sessions)]))
        return pd.DataFrame(rows, columns=["other", "choice"])

    n = distractors.agg(F.count(F.lit(1)).alias("n"))
    drawn = spark.createDataFrame([(x,) for x in seeds], "seed int").join(F.broadcast(n)).select("seed", draw("seed", "n").alias("d"))  # n: one row
    return drawn.select("seed", F.posexplode("d.choice").alias("step", "choice"), "d.other").select("seed", "step", F.get("other", F.col("step")).alias("other"), "choice")


def hash_draws(spark: SparkSession, seeds: list[int], distractors: DataFrame, sessions: int) -> DataFrame:
    """The same columns by hashes: distractors in order of the hash of (seed, id), neutral turns by that of (seed, step)."""
    steps = _each(spark.range(sessions).select(F.col("id").cast("int").alias("step")), seeds)
    choice = F.pmod(_draw(F.col("seed"), F.lit("filler"), F.col("step")), F.lit(len(FILLERS))).cast("int")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(_draw(F.col("seed"), F.col("id")), "seq")) - 1
    ranked = _each(distractors, seeds).select("seed", rank.alias("step"), F.col("place").alias("other")).filter(F.col("step") < sessions)
    return steps.join(ranked, ["seed", "step"], "left").select("seed", "step", "other", choice.alias("choice"))


def _each(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """``rows`` once for each seed."""
    return rows.withColumn("seed", F.explode(F.array(*[F.lit(int(x)) for x in seeds])))


def _turns(rows: DataFrame, phase: int, session: Column | int, lang: str, text: Column, kind: str, fact_id: Column | None = None, order: Column | None = None) -> DataFrame:
    session = session if isinstance(session, Column) else F.lit(session)
    return rows.select(
        "seed", F.lit(phase).alias("phase"), (order if order is not None else F.col("seq")).cast("long").alias("pos"), session.cast("int").alias("session_id"), F.lit("user").alias("role"),
        F.lit(lang).alias("lang"), text.alias("text"), F.lit(kind).alias("kind"), (fact_id if fact_id is not None else F.col("id")).alias("fact_id"),
    )


def build_script(
    facts: DataFrame, store_lang: str, probe_lang: str, filler_sessions: int = 1, update_ratio: float = 0.2, seed: int = 42, draws: str = "twister",
) -> DataFrame:
    """The turns of a run, in order of ``seq``."""
    return build_scripts(facts, store_lang, probe_lang, [seed], filler_sessions, update_ratio, draws).drop("seed")


def build_scripts(
    facts: DataFrame, store_lang: str, probe_lang: str, seeds: list[int], filler_sessions: int = 1, update_ratio: float = 0.2, draws: str = "twister",
) -> DataFrame:
    """The turns of the runs of all seeds, each in order of ``seq``; the plan does not grow with them."""
    spark = facts.sparkSession
    each = _each(facts, seeds)
    base = each.filter("distractor_of IS NULL")
    parts = [_turns(base, 1, 1, store_lang, spoken(F.col("surface"), store_lang), "plant")]
    if filler_sessions > 0:
        others = facts.filter("distractor_of IS NOT NULL").withColumn("place", (F.row_number().over(Window.orderBy("seq")) - 1).cast("int"))
        drawn = {"twister": twister_draws, "hash": hash_draws}[draws](spark, seeds, others, filler_sessions)
        texts = F.array(*[F.lit(x.get(store_lang) or x["en"]) for x in FILLERS])
        parts.append(_turns(drawn, 2, F.col("step") + 2, store_lang, F.get(texts, F.col("choice")), "filler", F.lit(None).cast("string"), F.col("step") * 2))
        given = drawn.join(others, drawn["other"] == others["place"])
        parts.append(_turns(given, 2, F.col("step") + 2, store_lang, spoken(F.col("surface"), store_lang), "filler", None, F.col("step") * 2 + 1))
    asked = F.col("probe_questions")
    question = F.when(F.coalesce(F.map_contains_key(asked, F.lit(probe_lang)), F.lit(False)), _in(asked, probe_lang)).otherwise(X.fallback_probe(F.col("relation"), probe_lang))
    parts.append(_turns(base, 3, 2 + filler_sessions, probe_lang, question, "probe"))
    chosen = correction_subset(each, update_ratio, ("seed",))
    plainly = F.concat(F.lit("Correction: the "), F.col("relation"), F.lit(" is actually "), F.coalesce("update.updated_value", F.lit("None")), F.lit("."))
    told = F.coalesce(F.nullif(spoken(F.col("update.surface"), store_lang), F.lit("")), plainly)
    parts.append(_turns(chosen, 4, 3 + filler_sessions, store_lang, told, "correction"))
    again = F.coalesce(
        F.nullif(_in(F.col("update.probe_questions"), probe_lang), F.lit("")), F.nullif(_in(asked, probe_lang), F.lit("")), X.fallback_probe(F.col("relation"), probe_lang, again=True)
    )
    parts.append(_turns(chosen, 5, 4 + filler_sessions, probe_lang, again, "probe"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    seq = (F.row_number().over(Window.partitionBy("seed").orderBy("phase", "pos")) - 1).cast("long")
    return out.select("seed", seq.alias("seq"), "session_id", "role", "lang", "text", "kind", "fact_id")


def split_phases(turns: DataFrame) -> DataFrame:
    """Turns with ``phase``: kind, except that a probe after the (seed's) correction session is a reprobe, and one within it is none."""
    by = ["seed"] if "seed" in turns.columns else []
    first = turns.filter("kind = 'correction'").groupBy(*by).agg(F.min("session_id").alias("_c"))
    probe = F.when(F.col("_c").isNull() | (F.col("session_id") < F.col("_c")), "probe").when(F.col("session_id") > F.col("_c"), "reprobe")
    both = turns.join(F.broadcast(first), by, "left") if by else turns.join(F.broadcast(first))  # one row a seed
    return both.withColumn("phase", F.when(F.col("kind") == "probe", probe).otherwise(F.col("kind"))).drop("_c")

"""The containment join: which texts hold which keys.

Catalyst plans a join on ``contains`` as a nested loop over all pairs.  Three
exact plans are offered instead of one:

* ``nested``: the loop, keys broadcast.  Best for a few pairs.
* ``automaton``: all keys in one Aho-Corasick automaton, built once per task
  from a broadcast whose rows and bytes are checked; one pass over each text, whatever the
  number of keys.  The plan for large stores: no shuffle at all.
* ``tokens``: for key sets too large to broadcast.  A key of three words or more
  holds its inner words whole, so its rarest inner word is joined with the
  texts' words, and the candidates verified; keys of one or two words, which may
  lie inside longer words, go through automata of key chunks.

A store that is matched often is indexed once (:func:`build_index`): its normalised
texts, and an inverted index of their tokens in buckets, which later joins on tokens
read without shuffling it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.plans.lineage import cut, small

#: Pairs up to which the nested loop is the fastest plan.
NESTED_PAIRS = 200_000
#: Keys that may be broadcast, and their bytes: an automaton takes some thirty times as much in a task.
MAX_KEYS = 2_000_000
MAX_KEY_BYTES = 16 << 20


#: Buckets of an inverted index, where none are asked for: one for each so many texts.
BUCKET_TEXTS, MOST_BUCKETS = 10_000, 4_096


@dataclass
class Index:
    """``texts``: (text_id, normal), written; ``words``: (word, text_id), a table in buckets by word; ``often``: (word, n) in the same buckets."""

    texts: DataFrame
    words: DataFrame
    often: DataFrame
    tables: tuple[str, str]

    def drop(self) -> None:
        for t in self.tables:
            self.texts.sparkSession.sql(f"DROP TABLE IF EXISTS {t}")


def build_index(texts: DataFrame, buckets: int | None = None) -> Index:
    """The inverted index of ``texts`` (text_id, normal), each normalised and split once, in the session's catalogue."""
    spark = texts.sparkSession
    texts = cut(texts.select("text_id", "normal"))
    n = buckets or max(1, min(MOST_BUCKETS, texts.count() // BUCKET_TEXTS + 1))
    names = tuple(f"mnemoframe_{kind}_{uuid.uuid4().hex}" for kind in ("words", "often"))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.repartition(n, "word").write.bucketBy(n, "word").sortBy("word").saveAsTable(name)
        return spark.table(name)

    words = keep(texts.select(F.explode(F.array_distinct(F.split("normal", " "))).alias("word"), "text_id"), names[0])
    return Index(texts, words, keep(words.groupBy("word").agg(F.count(F.lit(1)).alias("count")), names[1]), names)


def contains_join(keys: DataFrame, texts: DataFrame | Index, plan: str = "auto") -> DataFrame:
    """Distinct (key_id, text_id): ``keys`` is (key_id, key), ``texts`` is (text_id, normal) or an index of these, both normalised.

    An empty key matches nothing; several keys of one id give one row.  Ids may be structs.
    """
    keys = keys.filter("key <> ''").select("key_id", "key").distinct()
    index = texts if isinstance(texts, Index) else None
    texts = index.texts if index else texts
    if plan == "auto":
        n, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
        if n * texts.limit(NESTED_PAIRS // max(n, 1) + 1).count() <= NESTED_PAIRS:
            plan = "nested"
        else:
            plan = "automaton" if n <= MAX_KEYS and size <= MAX_KEY_BYTES else "tokens"
    if plan == "tokens":
        return _tokens(keys, texts, index)
    return {"nested": _nested, "automaton": _automaton}[plan](keys, texts)


def _nested(keys: DataFrame, texts: DataFrame) -> DataFrame:
    sets = keys.groupBy("key_id").agg(F.collect_list("key").alias("keys"))
    # a file of one row group is one task: rows are spread before the texts are normalised and compared
    pairs = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism).join(small(sets), F.exists("keys", lambda k: F.contains(F.col("normal"), k)))
    return pairs.select("key_id", "text_id")


def _automaton(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """One pass of an automaton over every text; the numbers it finds are turned back into ids by a broadcast join."""
    counted = [(x.key, x.n) for x in keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]  # MAX_KEYS at most
    distinct = [k for k, _ in counted]
    shared = keys.sparkSession.sparkContext.broadcast(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, k in enumerate(shared.value):
            machine.add_word(k, i)
        if len(machine):
            machine.make_automaton()
        for b in batches:
            rows, found = [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                if text and len(machine):
                    own = {i for _, i in machine.iter(text)}
                    rows += [row] * len(own)
                    found += own
            names = pa.array([shared.value[i] for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), names], names=["text_id", "key"])

    kind = texts.schema["text_id"].dataType.simpleString()
    hits = texts.select("text_id", "normal").mapInArrow(run, f"text_id {kind}, key string")
    return hits.join(F.broadcast(keys) if sum(n for _, n in counted) <= MAX_KEYS else keys, "key").select("key_id", "text_id").distinct()


def _tokens(keys: DataFrame, texts: DataFrame, index: Index | None = None) -> DataFrame:
    texts = texts if index else cut(texts)  # normalised once
    parts = keys.withColumn("words", F.split("key", " ")).withColumn("row", F.xxhash64("key"))
    long, short = parts.filter(F.size("words") >= 3), parts.filter(F.size("words") < 3)
    words = index.words if index else texts.select("text_id", F.explode(F.array_distinct(F.split("normal", " "))).alias("word"))
    inner = long.select("key_id", "key", F.explode(F.expr("slice(words, 2, size(words) - 2)")).alias("word")).distinct()
    often = index.often if index else words.join(inner.select("word").distinct(), "word", "left_semi").groupBy("word").count()
    # words that no text holds rule a key out, so the inner join may drop them only if all are held: the rarest of all decides
    rarest = inner.join(often, "word", "left").groupBy("key_id", "key").agg(F.min_by("word", F.struct(F.coalesce("count", F.lit(0)), "word")).alias("word"))
    candidates = cut(words.join(small(rarest), "word").select("key_id", "key", "text_id"))
    out = texts.join(small(candidates), "text_id").filter(F.contains("normal", F.col("key"))).select("key_id", "text_id")
    count, size = short.agg(F.count_distinct("key"), F.sum(F.octet_length("key"))).first()
    n = max(-(-count // MAX_KEYS), -(-(size or 0) // MAX_KEY_BYTES))  # without short keys no text is read for them
    for i in range(n):
        out = out.unionByName(_automaton(short.filter(F.pmod("row", F.lit(n)) == i).select("key_id", "key"), texts))
    return out.distinct()

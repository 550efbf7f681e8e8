"""The native store fed by a stream: keyed state instead of a table that every write reads again.

A user's state is the number of its next record, how often it was reset, and the texts it has seen, each with
its first record's number.  Every record comes out once, in append mode, marked whether its text was new:
all rows are what :func:`mnemoframe.operators.store.write` makes of the turns, the marked ones what ``consolidate``
leaves, however the stream is cut into batches.  A reset comes out as a row with seq -1.  State lives in RocksDB, which spills to disk, and in the
checkpoint, from which a query that was stopped or lost its executors goes on.

Within a batch a user's turns are put in order of ``seq``; a batch must not hold turns that precede an earlier batch's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECORD = "user_id string, epoch long, seq long, raw_id string, text string, lang_detected string, metadata map<string,string>, is_first boolean"
TURNS = ("user_id", "op", "seq", "session_id", "kind", "fact_id", "lang", "text")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstWins(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "next long, epoch long")
        self.seen = handle.getMapState("seen", "text string", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values("seq", kind="stable")
        n, epoch = self.counts.get() if self.counts.exists() else (0, 0)
        out = []
        for t in turns.itertuples():
            if t.op == "reset":
                self.seen.clear()
                n, epoch = 0, epoch + 1
                out.append((key[0], epoch, -1, None, None, None, {}, False))
                continue
            text = (t.text,)
            first = not self.seen.containsKey(text)
            if first:
                self.seen.updateValue(text, (n,))
            told = lambda x: None if x is None or x != x else str(x)
            session = told(t.session_id)
            meta = {"session_id": session and session.removesuffix(".0"), "kind": told(t.kind), "fact_id": told(t.fact_id)}
            out.append((key[0], epoch, n, f"mem_{n}", t.text, t.lang, meta, first))
            n += 1
        self.counts.update((n, epoch))
        yield pd.DataFrame(out, columns=["user_id", "epoch", "seq", "raw_id", "text", "lang_detected", "metadata", "is_first"])

    def close(self) -> None:
        pass


def records(turns: DataFrame) -> DataFrame:
    """Records of a stream of turns (user_id, op, seq, session_id, kind, fact_id, lang, text); ``op`` is write or reset, a correction is written like any other turn.

    The session must keep state in RocksDB: see :func:`rocks`.
    """
    rows = turns.select(*[F.col(c).cast("string") if c not in ("seq", "session_id") else F.col(c) for c in TURNS])
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    return rows.groupBy("user_id").transformWithStateInPandas(FirstWins(), RECORD, "append", "none")


def rocks(spark: SparkSession) -> None:
    """Keep the state of queries that start from now on in RocksDB."""
    spark.conf.set(_PROVIDER, _ROCKS)


def write_all(turns: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that the stream ``turns`` has now, taken in to the table at ``path``; a second call goes on where the first one ended."""
    spark = turns.sparkSession
    rocks(spark)
    query = records(turns).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(RECORD).parquet(path)


def current(table: DataFrame) -> DataFrame:
    """The records that stand: those since each user's last reset."""
    last = table.groupBy("user_id").agg(F.max("epoch").alias("epoch"))
    return table.join(last, ["user_id", "epoch"]).filter("seq >= 0")

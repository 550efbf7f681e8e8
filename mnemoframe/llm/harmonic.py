"""Harmonic packing: reciprocal-capacity classes with a fixed number of pieces in each sequence.

Class k holds pieces of one size, floor(capacity / k), and k of them fill a sequence but for less than k tokens.
As documents may be cut anywhere, each is cut along its length into the largest sizes that still fit in what is
left of it: whole sequences first, then a few pieces of falling size (about 2.5 a document; the tail shrinks with its square).

Tasks number the pieces of a class on their own while they encode, and a class's sequence and place in it follow by
division once the counts of the tasks before are known: one row a task and size, whatever the pieces.  No piece
is compared with another, none is shuffled, and a size that holds any share of all pieces is no heavier than others.
What is left of each class fills no sequence: at most k - 1 pieces, which are best-fitted across classes on their counts.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they come; an
empty table gives an empty result; a text of any length is cut holding no more than its tokens; a null key stays; other columns are unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import bounded_batches, cut, drop_cut, small
from mnemoframe.llm.packing import CAPACITY, Encoder, best_fit, encoder, lots, slots


def class_sizes(capacity: int = CAPACITY) -> np.ndarray:
    """The sizes floor(capacity / k), rising."""
    return np.unique(capacity // np.arange(1, capacity + 1))


def cuts(length: int, sizes: np.ndarray) -> list[int]:
    """Sizes of the pieces of a document, in its order."""
    out = [int(sizes[-1])] * (length // int(sizes[-1]))
    left = length % int(sizes[-1])
    while left:
        out.append(int(sizes[np.searchsorted(sizes, left, side="right") - 1]))
        left -= out[-1]
    return out


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, and the task with the piece's number among the task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, task = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId()
        own = np.zeros(capacity + 1, np.int64)
        for part in lots(batches):
            yield cut_up(part, enc, end, own, task)
        pa.default_memory_pool().release_unused()

    sizes = class_sizes(capacity)

    def cut_up(part: pa.Table, enc: Encoder, end: bytes, own: np.ndarray, task: int) -> pa.RecordBatch:
        column = pc.fill_null(part.column(1), "").cast(pa.large_string()).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        rows: list[tuple[int, int, int, int, int, int]] = []
        for i, ids in enumerate(enc.encode(column.to_pylist(), column)):
            ids += end
            start, total = 0, len(ids) // 4
            for n in cuts(total, sizes):
                rows.append((i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, int(own[n])))
                own[n] += 1
                start += n
        take, *rest = np.array(rows, dtype=np.int64).reshape(-1, 6).T
        keys = part.column(0).take(pa.array(take)).combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        return pa.RecordBatch.from_arrays(
            [keys, *[pa.array(x) for x in rest], pa.array(np.full(len(take), task, np.int32))],
            names=["k", "start", "length", "ids_crc32", "doc_tokens", "own", "task"],
        )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, start long, length long, ids_crc32 long, doc_tokens long, own long, task int")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut_up = cut(pieces(docs, tokenizer, key, text, capacity, end_id), "harmonic")
    counts = cut(cut_up.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a size, at most 2 * sqrt(capacity)
    # full sequences of each class stand together; what is left is planned on its counts
    table, sequence, left = [], 0, np.zeros(capacity + 1, np.int64)
    for size in sorted(total, reverse=True):
        each = capacity // size
        full, left[size] = divmod(total[size], each)
        table.append((size, each, sequence, full * each))
        sequence += full
    plan = slots([(n, lens) for n, lens, _ in best_fit(left, [], capacity)])
    rest = list(zip(*(plan[x].tolist() for x in ("length", "first", "sequence", "offset"))))
    ends = [b[1] if b[0] == a[0] else int(left[a[0]]) for a, b in zip(rest, [*rest[1:], (0, 0, 0, 0)])]
    classes = spark.createDataFrame(table, "length long, each long, class_first long, in_full long")
    runs = spark.createDataFrame([(a, b, e, sequence + s, o) for (a, b, s, o), e in zip(rest, ends)], "run_length long, run_first long, run_end long, run_sequence long, run_offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "starts")
    rows = cut_up.join(small(starts), ["task", "length"]).join(F.broadcast(classes), "length").withColumn("rank", F.col("before") + F.col("own"))  # classes: a row a size
    whole = F.col("rank") < F.col("in_full")
    late = F.col("rank") - F.col("in_full")
    inside = ~whole & (F.col("run_length") == F.col("length")) & (F.col("run_first") <= late) & (late < F.col("run_end"))
    rows = rows.join(F.broadcast(runs), inside, "left")  # runs: at most a few for each size
    place = F.floor(F.col("rank") / F.col("each"))
    out = rows.select(
        F.col("k").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        F.when(whole, F.col("class_first") + place).otherwise(F.col("run_sequence")).cast("long").alias("sequence_id"),
        F.when(whole, F.col("length") * (F.col("rank") % F.col("each"))).otherwise(F.col("run_offset")).cast("long").alias("offset"),
    )
    drop_cut(counts)
    return out

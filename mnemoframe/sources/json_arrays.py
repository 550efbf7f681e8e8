"""JSON arrays read in splits: any byte of a file may start one.

Whether a byte stands in a string, and how deep in brackets, depends on all that comes
before it.  So every split is read three times at most, each time on its own:

1. for each state that a split can begin in (inside a string or not, behind an open escape or not)
   it tells the state it ends in and by how much the depth changes;
2. these small tables, one row a split, are chained along each file, which gives every split its
   true state, and a count of the records that begin in it their places in the array;
3. every split emits the records that begin in it, reading on beyond its end for the last one.

A file of one split needs the third pass only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a split, and of what is looked at together (a hundred times as much is in use meanwhile).
SPLIT, CHUNK = 16 << 20, 1 << 17

#: (inside a string, behind an open escape)
State = tuple[int, int]


def scan(data: bytes, state: State) -> tuple[np.ndarray, np.ndarray, State]:
    """Places and depth changes of the brackets outside strings, and the state behind ``data``."""
    b = np.frombuffer(data, np.uint8)
    inside, open_escape = state
    at = np.arange(len(b))
    slash = b == 0x5C
    last = np.maximum.accumulate(np.where(slash, -1, at)) if len(b) else at  # the last other character up to here
    before = np.concatenate(([-1], last[:-1])) if len(b) else at
    run = at - 1 - before + np.where(before < 0, open_escape, 0)  # backslashes right in front
    quotes = (b == 0x22) & (run % 2 == 0)
    parity = np.cumsum(quotes) + inside
    change = np.zeros(len(b), np.int64)
    change[(b == 0x7B) | (b == 0x5B)] = 1
    change[(b == 0x7D) | (b == 0x5D)] = -1
    change[parity % 2 == 1] = 0
    places = np.flatnonzero(change)
    end = len(b) - 1
    pending = ((end - last[-1]) + (open_escape if last[-1] < 0 else 0)) % 2 if len(b) else open_escape
    return places, change[places], (int(parity[-1] % 2) if len(b) else inside, int(pending))


def _open(path: str):
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _chunks(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    with _open(path) as f:
        f.seek(start)
        while start < end and (data := f.read(min(CHUNK, end - start))):
            yield start, data
            start += len(data)


def _outcomes(splits: DataFrame) -> DataFrame:
    """Splits with, for each of the four states they may begin in, the state they end in and the change of depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                ends = []
                for state in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    depth, now = 0, state
                    for _, data in _chunks(r.path, r.start, r.end):
                        _, change, now = scan(data, now)
                        depth += int(change.sum())
                    ends += [*now, depth]
                out.append(ends)
            yield rows.assign(ends=out)

    return splits.mapInPandas(run, splits.schema.simpleString()[7:-1].replace(":", " ") + ", ends array<long>")


def _begun(splits: DataFrame) -> DataFrame:
    """Splits with the state and depth they truly begin in, by chaining a file's splits; one small row for each split is grouped."""
    fields = "store int, no long, path string, start long, end long, inside int, pending int, depth long"

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        state, depth, out = (0, 0), 0, []
        rows = rows.sort_values("start")
        for r in rows.itertuples():
            out.append((*state, depth))
            i = 3 * (2 * state[0] + state[1])
            state, depth = (int(r.ends[i]), int(r.ends[i + 1])), depth + int(r.ends[i + 2])
        rows[["inside", "pending", "depth"]] = out
        return rows.drop(columns="ends")

    return _outcomes(splits).groupBy("path").applyInPandas(chain, fields)


def _records(path: str, start: int, end: int, state: State, depth: int) -> Iterator[bytes]:
    """The records that begin in [start, end)."""
    parts: list[bytes] = []
    is_open = False
    for at, data in _chunks(path, start, 1 << 62):
        if at >= end and not is_open:
            return
        places, change, state = scan(data, state)
        after = depth + np.cumsum(change)
        starts = places[(change > 0) & (after == 2) & (places + at < end)]
        ends = places[(change < 0) & (after == 1)] + 1
        depth = int(after[-1]) if len(after) else depth
        if is_open:
            if not len(ends):
                parts.append(data)
                continue
            yield b"".join([*parts, data[: ends[0]]])
            is_open, parts = False, []
        ends = ends[ends > starts[0]] if len(starts) else ends[:0]
        for a, b in zip(starts.tolist(), ends.tolist()):
            yield data[a:b]
        if len(starts) > len(ends):
            is_open, parts = True, [data[starts[-1] :]]


def _counts(begun: DataFrame) -> DataFrame:
    """(store, no, before): how many records begin in a store's earlier splits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = []
            for r in rows.itertuples():
                state, depth, count = (r.inside, r.pending), r.depth, 0
                for _, data in _chunks(r.path, r.start, r.end):
                    _, change, state = scan(data, state)
                    after = depth + np.cumsum(change)
                    count += int(((change > 0) & (after == 2)).sum())
                    depth = int(after[-1]) if len(after) else depth
                n.append(count)
            yield rows[["store", "no"]].assign(n=n)

    before = Window.partitionBy("store").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return begun.mapInPandas(run, "store int, no long, n long").select("store", "no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def read(spark: SparkSession, files: list[tuple[int, str, int]], split: int = SPLIT) -> DataFrame:
    """(store, seq, value): the objects of JSON arrays and their places in them.

    ``files``: (store, path, bytes); the files of one store are read as one array, in the order of their paths.  Elements that are no objects are passed over.
    """
    rows, no = [], 0
    for store, path, size in sorted(files):
        for start in range(0, max(size, 1), split):
            rows.append((store, no, path, start, min(start + split, size)))
            no += 1
    splits = spark.createDataFrame(rows, "store int, no long, path string, start long, end long").repartition(max(1, min(len(rows), 10_000)), "no")
    if len(rows) == len({r[2] for r in rows}):  # no file is cut: each begins outside strings and brackets
        begun = splits.withColumns({"inside": F.lit(0), "pending": F.lit(0), "depth": F.lit(0).cast("long")})
    else:
        from mnemoframe.plans.lineage import cut

        begun = cut(_begun(splits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names=["store", "no", "own", "value"])

        for b in batches:
            for r in b.to_pylist():
                found, size = [], 0
                for own, x in enumerate(_records(r["path"], r["start"], r["end"], (r["inside"], r["pending"]), r["depth"])):
                    found.append((r["store"], r["no"], own, x.decode("utf-8", "replace")))
                    size += len(x)
                    if size > 4 << 20:
                        yield batch(found)
                        found, size = [], 0
                if found:
                    yield batch(found)

    out = begun.mapInArrow(run, "store int, no long, own long, value string")
    if len(rows) == len({r[0] for r in rows}):
        return out.select("store", F.col("own").alias("seq"), "value")
    from mnemoframe.plans.lineage import small

    return out.join(small(_counts(begun)), ["store", "no"]).select("store", (F.col("before") + F.col("own")).alias("seq"), "value")

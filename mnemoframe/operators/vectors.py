"""Vector retrieval through an inverted file with exact pruning, and the mock embedder.

The base is cut into cells around centres; a cell knows the smallest and the largest
angle of its members to its centre.  On the unit sphere angles obey the triangle
inequality: no member of a cell is nearer to a query than the query's own angle
to the centre allows.  A query is first compared with some members of its nearest cells; the k-th best of
these is a bound, and only cells that can still beat it are visited.  The result is exact, whatever
the centres, which are fitted on a bounded sample and only decide how much is pruned.

Queries and base meet by area: some cells that fill a lot together, or one large cell.  Large cells are dealt to lots, and so are the queries that visit
an area, so that no task holds more than one lot of each; a query goes to an area once, with the list of cells that it visits there.  What meets in a cell is
multiplied as matrices, and the best k of each query leave.  The driver sees one row a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.plans.lineage import cut

#: Most cells, and base rows that a cell has on average if there are fewer; rows on which the centres are fitted.
CELLS, CELL_ROWS, SAMPLE_ROWS = 4096, 256, 50_000
#: Base rows, and queries, of one lot.
LOT, QUERY_LOT = 4096, 8192
#: Pairs of row and cell that a task looks at together, and rows that it passes on together.
PAIRS, EMIT_ROWS = 1 << 20, 4096
#: Digits of a cosine that count: what differs behind them is a tie.
DIGITS = 12
#: Angles and cosines within this of a bound are not pruned.
_SLACK = 1e-9
#: The cell of vectors without direction, whose cosine with any is 0.
_NOWHERE = -1


@dataclass
class Index:
    """``table``: (base_id, cell, angle, vector of unit length); ``centres``: a row a cell; ``cells``: members, smallest and largest angle by cell."""

    table: DataFrame
    centres: np.ndarray
    cells: dict[int, tuple[int, float, float]]

    @property
    def rows(self) -> int:
        return sum(n for n, _, _ in self.cells.values())

    def areas(self) -> dict[int, int]:
        """The area of each cell: neighbours by number share one up to ``LOT`` rows; vectors without direction have their own."""
        out, area, filled = {}, -1, LOT
        for c in sorted(self.cells):
            n = self.cells[c][0]
            if filled + n > LOT or c == _NOWHERE:
                area, filled = area + 1, 0
            filled += LOT if c == _NOWHERE else n
            out[c] = area
        return out


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _whole(df: DataFrame, column: str = "vector") -> DataFrame:
    """Rows whose vector is there and holds numbers only."""
    v = F.col(column).cast("array<double>")
    return df.withColumn(column, v).filter(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def _steps(rows: int, cells: int) -> Iterator[slice]:
    step = max(1, PAIRS // max(1, cells))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def build_index(base: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Index | None:
    """The inverted file of ``base`` (base_id, vector), written once; None if no row has a vector.

    Centres come from k-means by cosine over at most ``sample_rows`` rows (those with the smallest hashes of their ids); all rows are indexed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    base = _whole(base.select("base_id", "vector"))
    n = base.count()
    if not n:
        return None
    pointing = base.filter(F.exists("vector", lambda x: x != 0))
    sample = pointing.orderBy(F.xxhash64("base_id"), "base_id").limit(sample_rows).select(array_to_vector("vector").alias("features"))
    k = max(1, min(CELLS, n // CELL_ROWS)) if cells is None else cells
    if k > 1 and pointing.limit(2).count() == 2:
        fitted = KMeans(k=k, maxIter=4, initMode="random", seed=1, distanceMeasure="cosine").fit(sample)
        centres = _unit(np.array(fitted.clusterCenters(), dtype=np.float64))
    else:
        centres = _unit(np.array([x.features.toArray() for x in sample.limit(1).collect()] or np.zeros((1, len(base.first().vector)))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _unit(_matrix(b.column(1), centres.shape[1]))
            cell, angle = np.zeros(len(m), np.int64), np.zeros(len(m))
            for at in _steps(len(m), len(centres)):
                dots = m[at] @ centres.T
                cell[at] = dots.argmax(axis=1)
                angle[at] = _angles(dots.max(axis=1))
            cell = np.where((m != 0).any(axis=1), cell, _NOWHERE)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array(angle), _lists(m)], names=["base_id", "cell", "angle", "vector"])

    kind = base.schema["base_id"].dataType.simpleString()
    table = cut(base.mapInArrow(assign, f"base_id {kind}, cell int, angle double, vector array<double>"))
    sizes = table.groupBy("cell").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle")).collect()  # one row a cell
    return Index(table, centres, {c: (n, low, high) for c, n, low, high in sizes})


def _lots(n: int) -> int:
    return -(-n // LOT)


def _blocks(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, base_id, score): of each (query_id, vector, floor, area, lot, cells) wanted, the k best members of each of those cells in that lot with a score of ``floor`` or more."""
    spark, d = wanted.sparkSession, index.centres.shape[1]
    wanted = cut(wanted)
    visits = wanted.groupBy("area", "lot").agg(F.ceil(F.count(F.lit(1)) / QUERY_LOT).cast("int").alias("query_lots"))
    areas = index.areas()
    sizes = spark.createDataFrame([(c, areas[c], _lots(n)) for c, (n, _, _) in index.cells.items()], "cell int, area int, lots int")  # one row a cell
    members = index.table.join(F.broadcast(sizes), "cell").withColumn("lot", F.pmod(F.xxhash64("base_id"), F.col("lots")).cast("int"))
    members = members.join(visits, ["area", "lot"]).select("area", "lot", F.explode(F.sequence(F.lit(0), F.col("query_lots") - 1)).alias("part"), "cell", "base_id", F.col("vector").alias("v"))
    asking = wanted.join(visits, ["area", "lot"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("query_lots")).cast("int")).select("area", "lot", "part", "query_id", "vector", "floor", "cells")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        q, m = _matrix(left.column("vector"), d), _matrix(right.column("v"), d)
        own, ids, floor = left.column("query_id").to_numpy(), right.column("base_id").to_numpy(), left.column("floor").to_numpy()
        cell = right.column("cell").to_numpy()
        order = np.lexsort((ids, cell))
        ids, m, cell = ids[order], m[order], cell[order]
        visited = left.column("cells").combine_chunks()
        visitor = np.repeat(np.arange(len(q)), visited.value_lengths().to_numpy(zero_copy_only=False))
        asked = visited.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(asked, kind="stable")
        visitor, asked = visitor[order], asked[order]
        found: list[list[np.ndarray]] = [[own[:0]], [ids[:0]], [np.zeros(0)]]
        for c in np.unique(cell):
            here, who = slice(*np.searchsorted(cell, (c, c + 1))), visitor[slice(*np.searchsorted(asked, (c, c + 1)))]
            for at in range(0, len(who), 512):
                some = who[at : at + 512]
                s = np.round(q[some] @ m[here].T, DIGITS)
                s[own[some, None] == ids[None, here]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # stable: ties by base id
                rows = np.repeat(np.arange(len(s)), top.shape[1])
                score = s[rows, top.ravel()]
                good = np.isfinite(score) & (score >= floor[some[rows]] - _SLACK)
                for x, y in zip(found, (own[some[rows[good]]], ids[here][top.ravel()[good]], score[good])):
                    x.append(y)
        return pa.table({name: np.concatenate(x) for name, x in zip(("query_id", "base_id", "score"), found)})

    kinds = (wanted.schema["query_id"].dataType.simpleString(), index.table.schema["base_id"].dataType.simpleString())
    both = asking.groupBy("area", "lot", "part").cogroup(members.groupBy("area", "lot", "part"))
    return both.applyInArrow(best, f"query_id {kinds[0]}, base_id {kinds[1]}, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "base_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def visits(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vector, floor, area, lot, cells): the lots of all cells that can hold one of the k best of each query, an area's cells in one row.

    ``floor`` is the k-th best cosine among the first lots of the cells nearest to the query that hold enough members together; -2 if there are too few.
    """
    d, centres, nowhere = index.centres.shape[1], index.centres, _NOWHERE in index.cells
    names = np.array(sorted(c for c in index.cells if c != _NOWHERE), dtype=np.int64)
    count, low, high = (np.array([index.cells[int(c)][i] for c in names]) for i in range(3))
    count = count.astype(np.int64)
    first = np.minimum(count, np.maximum(1, count // np.maximum(1, -(-count // LOT)) // 2))  # what the first lot holds at least, or nearly
    areas = index.areas()
    every = np.array(sorted(areas), dtype=np.int64)
    area_of = np.array([areas[int(c)] for c in every], dtype=np.int64)
    lots_of = np.zeros(len(every) and area_of.max() + 1, np.int64)
    np.maximum.at(lots_of, area_of, [_lots(index.cells[int(c)][0]) for c in every])
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, vector array<double>, floor double, area int, lot int, cells array<int>"

    def emit(ids: pa.Array, q: np.ndarray, floor: np.ndarray, rows: np.ndarray, cells: np.ndarray, all_lots: bool) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        area = area_of[np.searchsorted(every, cells)]
        order = np.lexsort((cells, area, rows))
        rows, cells, area = rows[order], cells[order], area[order]
        starts = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (area[1:] != area[:-1]))))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(cells.astype(np.int32)))
        rows, area = rows[starts], area[starts]
        lots = lots_of[area] if all_lots else np.ones(len(area), np.int64)
        each = np.repeat(np.arange(len(area)), lots)
        within = np.arange(lots.sum()) - np.repeat(np.cumsum(lots) - lots, lots)
        for at in range(0, len(each), EMIT_ROWS):
            x, lot = each[at : at + EMIT_ROWS], within[at : at + EMIT_ROWS]
            columns = [ids.take(pa.array(rows[x])), _lists(q[rows[x]]), pa.array(floor[rows[x]]), pa.array(area[x].astype(np.int32)), pa.array(lot.astype(np.int32)), lists.take(pa.array(x))]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vector", "floor", "area", "lot", "cells"])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every_q = _unit(_matrix(b.column(1), d))
            for step in _steps(len(every_q), len(names)):
                q = every_q[step]
                order = np.argsort(-(q @ centres[names].T), axis=1, kind="stable")
                before = np.cumsum(first[order], axis=1) - first[order]
                rows, at = np.nonzero(before < k + 1)
                yield from emit(b.column(0).slice(step.start, len(q)), q, np.full(len(q), -2.0), rows, names[order[rows, at]], False)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every_q, floors = _unit(_matrix(b.column(1), d)), b.column(2).to_numpy(zero_copy_only=False)
            for step in _steps(len(every_q), len(names)):
                q, floor = every_q[step], floors[step]
                theta = _angles(q @ centres[names].T)
                gap = np.maximum(0, np.maximum(theta - high, low - theta))
                could = np.where((q != 0).any(axis=1)[:, None], np.cos(np.minimum(gap, np.pi)), 0.0)
                rows, at = np.nonzero(could >= floor[:, None] - _SLACK)
                cells = names[at]
                if nowhere:
                    zero = np.flatnonzero(floor <= _SLACK)
                    rows, cells = np.concatenate([rows, zero]), np.concatenate([cells, np.full(len(zero), _NOWHERE)])
                yield from emit(b.column(0).slice(step.start, len(q)), q, floor, rows, cells, True)

    queries = _whole(queries.select("query_id", "vector"))
    if len(names):
        some = _ranked(_blocks(index, queries.mapInArrow(home, schema), k), k)
        floors = some.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-2.0).alias("floor"))
        queries = queries.join(floors, "query_id", "left").select("query_id", "vector", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
    else:
        queries = queries.withColumn("floor", F.lit(-2.0))
    return queries.mapInArrow(near, schema)


def search(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, base_id, score, rank) over an index that stands; see :func:`top_k`."""
    return _ranked(_blocks(index, visits(index, queries, k), k), k)


def pruned_share(index: Index, queries: DataFrame, k: int = 5) -> float:
    """The share of pairs of query and base row that a search never compares."""
    seen = visits(index, queries, k).filter("lot = 0").select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cell
    compared = sum(r.n * index.cells[r.cell][0] for r in seen)
    return 1 - compared / max(1, _whole(queries.select("query_id", "vector")).count() * index.rows)


def top_k(queries: DataFrame, base: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, base_id, score, rank): the k base vectors of highest cosine for each query, ties by base id, a vector never its own hit.

    ``queries`` is (query_id, vector) with one row an id, ``base`` (base_id, vector).  A vector of zeros has cosine 0 with any;
    rows whose vector is null or holds anything but numbers are left out on both sides.
    """
    index = build_index(base)
    if index is None:
        kinds = (queries.schema["query_id"].dataType.simpleString(), base.schema["base_id"].dataType.simpleString())
        return base.sparkSession.createDataFrame([], f"query_id {kinds[0]}, base_id {kinds[1]}, score double, rank int")
    return search(index, queries, k)


def mock_embeddings(texts: DataFrame, text: str = "text", out: str = "embedding", size: int = 384) -> DataFrame:
    """Unit Gaussian vectors that depend on the text alone."""

    def run(seeds: pd.Series) -> pd.Series:
        rows = []
        for s in seeds:
            v = np.random.default_rng(int(s) & (2**64 - 1)).standard_normal(size)
            rows.append((v / np.linalg.norm(v)).astype(np.float32))
        return pd.Series(rows)

    return texts.withColumn(out, F.pandas_udf(run, "array<float>")(F.xxhash64(text)))

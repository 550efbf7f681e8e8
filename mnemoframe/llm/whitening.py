"""Whitening of embeddings by a one-sided Jacobi SVD over a blockwise TSQR.

1. Every task sums its vectors' scaled entries as whole numbers; the sums of all
   rows give the exact centre.
2. Every task folds its centred rows, batch by batch, into a triangle R (Householder
   QR of the old R over the new rows); triangles are stacked and reduced in groups,
   level by level, so that no task and not the driver holds more than ``FAN`` of them.
   The covariance is R'R / n, but is never formed: that would halve the digits.
3. Plane rotations orthogonalise the columns of the last R (one number for each pair
   of dimensions, whatever the rows).  Their norms are the singular values, accurate
   even where small; the product of the rotations holds the components.
4. Rows are projected; a last pass reduces the centred co-moments of what comes out,
   as blocks with their means, and compares them with the identity.

Rows are read again in every pass rather than kept: the work on a row is less than that of storing it.

Defined results: rows with a null vector, a null or non-finite entry are dropped; so
are entries beyond ``LIMIT`` after scaling (no deviation in a long could hold them) and vectors whose
length is not the most common one (of equally common ones the longest).  A deviation
beyond a long is null.  Directions without variance cannot be whitened and are no
components: vectors that are all alike, one vector, or an empty table give no rows.
Repeated rows count and come out as often as they come; a null key stays; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import bounded_batches, cut, drop_cut

#: x = floor(SCALE * entry) + SHIFT: fixed values of the contract.
SCALE, SHIFT = 64, 1_000_000
#: Largest x or -x of a vector that is kept.
LIMIT = 1 << 31
#: Triangles or co-moments that one task reduces to one.
FAN = 32
#: Largest size of a rotation's angle that counts as none, in units of the rounding error of a column's dot product.
_SETTLED = 4


def _scaled(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the vectors without null, non-finite or too large entries, for each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
    ends = np.cumsum(sizes)
    out = []
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        c = entries[(ends[rows] - d)[:, None] + np.arange(d)]
        with np.errstate(invalid="ignore", over="ignore"):
            x = np.floor(SCALE * c) + SHIFT
            good = (np.abs(x) <= LIMIT).all(axis=1)
        if good.any():
            out.append((rows[good], x[good].astype(np.int64)))
    return out


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """(n, sums of x) of the vectors of the most common length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for rows, x in _scaled(b.column(0)):
                own = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                own[0] += len(rows)
                own[1] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))],
            names=["d", "n", "sums"],
        )

    parts = cut(vectors.mapInArrow(run, "d int, n long, sums array<long>"), "sums")
    most = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, np.zeros(0, np.int64)
    each = parts.filter(F.col("d") == most.d).select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
    sums = np.zeros(most.d, np.int64)
    for pos, s in each.collect():  # one row for each dimension
        sums[pos] = s
    drop_cut(parts)
    return most.n, sums


def _centred(column: pa.Array, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, n * x - S as whole numbers, x - S / n) of the vectors that are fitted."""
    for rows, x in _scaled(column):
        if x.shape[1] == len(sums):
            whole = n * x - sums
            return rows, whole, whole / n
    none = np.zeros((0, len(sums)), np.int64)
    return np.zeros(0, np.int64), none, none.astype(np.float64)


def _reduced(parts: DataFrame, fold: Callable[[list[bytes]], bytes], name: str) -> bytes | None:
    """One value of the blocks (block int, value binary) of all tasks, by ``fold`` over at most ``FAN`` at a time."""
    parts = cut(parts, name)
    while (last := parts.agg(F.max("block")).first()[0]) is not None and last > 0:

        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("block")
            return pa.table({"block": pa.array([group.column("block")[0].as_py() // FAN], pa.int32()), "value": pa.array([fold(group.column("value").to_pylist())], pa.binary())})

        level = cut(parts.groupBy(F.floor(F.col("block") / FAN)).applyInArrow(run, "block int, value binary"), name)
        drop_cut(parts)
        parts = level
    value = parts.first()
    drop_cut(parts)
    return None if value is None else fold([value.value])


def _block(value: bytes) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([value], pa.binary())], names=["block", "value"])


def triangle(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    d = len(sums)

    def fold(values: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, d) for v in values]), mode="r").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            y = _centred(b.column(0), n, sums)[2]
            if len(y):
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
        if len(r):
            yield _block(r.tobytes())

    value = _reduced(vectors.mapInArrow(run, "block int, value binary"), fold, "triangles")
    return np.frombuffer(value).reshape(-1, d)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), falling, by rotations of pairs of columns until all are orthogonal.

    The pairs of a round share no column, so that their rotations are made at once; d - 1 rounds meet all pairs.
    """
    d = r.shape[1]
    a, v = np.array(r, dtype=np.float64), np.eye(d)
    players = list(range(d + d % 2))  # the odd one out pauses
    close = _SETTLED * np.sqrt(max(a.shape[0], 1)) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):
            half = len(players) // 2
            pairs = np.array([p for p in zip(players[:half], players[: half - 1 : -1]) if max(p) < d], dtype=np.int64).reshape(-1, 2)
            players.insert(1, players.pop())
            i, j = pairs.min(axis=1), pairs.max(axis=1)
            p, q = a[:, i], a[:, j]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            on = np.abs(pq) > close * np.sqrt(pp * qq)
            if not on.any():
                continue
            turned = True
            i, j, zeta = i[on], j[on], (qq[on] - pp[on]) / (2 * pq[on])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
        if not turned:
            break
    else:
        raise RuntimeError(f"the columns are not orthogonal after {sweeps} sweeps")
    sigma = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)  # the largest entry is positive
    return sigma[order], v


def _comoment(values: list[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, mean, co-moments about it) of blocks together."""
    n = sum(v[0] for v in values)
    mean = sum(v[0] / n * v[1] for v in values)
    return n, mean, sum(v[2] + v[0] * np.outer(v[1] - mean, v[1] - mean) for v in values)


def _identity_error(vectors: DataFrame, n: int, sums: np.ndarray, turn: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance less the identity."""
    k = turn.shape[1]

    def load(value: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        m = np.frombuffer(value)
        return float(m[0]), m[1 : k + 1], m[k + 1 :].reshape(k, k)

    def dump(value: tuple[float, np.ndarray, np.ndarray]) -> bytes:
        return np.concatenate([[value[0]], value[1], value[2].ravel()]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            w = _centred(b.column(0), n, sums)[2] @ turn
            if len(w):
                off = w - w.mean(axis=0)
                new = (float(len(w)), w.mean(axis=0), off.T @ off)
                own = _comoment([own, new]) if own else new
        if own:
            yield _block(dump(own))

    value = _reduced(vectors.mapInArrow(run, "block int, value binary"), lambda vs: dump(_comoment([load(v) for v in vs])), "comoments")
    return float(np.abs(load(value)[2] / n - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32) -> DataFrame:
    """Per vector and component (up to ``most``): key, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    bounded_batches(spark, 4_000)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    table = rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("k"))
    vectors = table.select("v").filter(F.col("v").isNotNull())
    n, sums = _sums(vectors)
    sigma, v = jacobi(triangle(vectors, n, sums)) if n else (np.zeros(0), np.zeros((0, 0)))
    rank = int((sigma > 16 * len(sums) * np.finfo(float).eps * sigma.max(initial=0)).sum())
    k = min(most, rank)
    if not k:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    turn = v[:, :k] / (sigma[:k] / np.sqrt(n))
    explained = sigma[:k] ** 2 / (sigma**2).sum()
    error = _identity_error(vectors, n, sums, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, whole, y = _centred(b.column(0), n, sums)
            times = len(own) * k
            far = np.abs(whole).max(initial=0)
            if int(far) ** 2 * len(sums) < 1 << 63:
                deviation = pa.array(np.repeat((whole * whole).sum(axis=1), k), pa.int64())
            else:
                exact = [sum(x * x for x in row) for row in whole.tolist()]
                deviation = pa.array([x if x < 1 << 63 else None for x in exact for _ in range(k)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(times, n, np.int64)),
                    deviation, pa.array((y @ turn).ravel()), pa.array(np.tile(explained, len(own))), pa.array(np.full(times, error)),
                ], names=["k", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return table.mapInArrow(run, schema).withColumnRenamed("k", key)

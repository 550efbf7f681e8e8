"""SimHash fingerprints and exact near-duplicate components through pivot distance tables.

Every text becomes a 64-bit fingerprint of its word shingles.  Two fingerprints
link at ``radius`` differing bits or fewer; components of that graph are the
groups of near copies.

Candidates.  With ``radius`` differing bits spread over ``blocks`` bit blocks, at
least ``blocks - radius`` blocks agree, so two linked fingerprints share the key
of one combination of so many blocks.  This is the equi-join that a cluster
needs: a pivot table alone cannot be turned into one without comparing all
pairs.  Within a bucket the pivot tables work: the distances of every
fingerprint to a fixed set of reference fingerprints were computed beforehand;
by the triangle inequality a pair whose distances to any pivot differ by more
than ``radius`` is discarded, and only survivors are verified on all 64 bits.

A bucket is searched breadth first and leaves one edge for each fingerprint it
reaches, so output is linear in a bucket's size, whatever its density: a large
group of near copies costs one sweep, not all its pairs.  Equal fingerprints (with
a least similarity: equal sets of shingles) are one node from the start.  Components of the remaining edges are found by
alternating large-star and small-star steps on distributed tables.

With a least similarity the sweep's edges alone do not suffice: one that fails
may have stood for a link that holds.  Members of swept buckets are compared
again, all pairs whose components still differ.  ``whole`` finds every pair of
that similarity, whatever its bit distance, through the shingles themselves: in
one order of all shingles, two such texts share one of the first
``n - ceil(least * n) + 1`` of each (prefix filter, exact in any order; shingles
that are frequent in a sample come last to keep buckets small).  Candidates are
held against parity sketches of the sets first, two bits a shingle, which never
rule out a similar pair, so that few pairs need their texts side by side.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, which links like any other; fewer words than a shingle form
one shingle; repeated rows repeat their result; an empty table gives an empty
result; a null id is an id of its own, the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import bounded_batches, cut, drop_cut, small, unused, without

PIVOTS = 16
#: Stands for a null key among nodes.
_NULL_ID = -(1 << 63)
#: Mean number of fingerprints that chance alone may put into a bucket: within one, pairs are compared in arrays.
CHANCE = 64.0


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of a text's UTF-8 bytes: a bit is set if it is set in more than half of the shingles' XXH64 (seed 42)."""
    return _majority(_shingle_hashes(text, width))


def _majority(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist()))


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle; none where there is no word."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.zeros(0, dtype="<u8")
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype="<u8")
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=n) - 1
    digest = xxhash.xxh64_intdigest
    m = n - width + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), (ends[width - 1 :] - 1).tolist())), dtype="<u8", count=m)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch(h: np.ndarray) -> bytes:
    """The parity of a set's members in each of 2**i cells, at least twice as many as members.

    Where two sets differ in d cells they differ in d members or more, which bounds their overlap from above without
    the sets: nothing similar is ever ruled out.  A larger sketch folds onto a smaller one.
    """
    cells = 1 << max(6, int(2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_alike(a: bytes, b: bytes, na: int, nb: int, least: float) -> bool:
    """Whether sets of ``na`` and ``nb`` members with these sketches can have a Jaccard similarity of ``least``."""
    need = least / (1 + least) * (na + nb) - 1e-9
    if min(na, nb) < need:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (na + nb - int(np.bitwise_count(x ^ y).sum())) / 2 >= need


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, sets: bool = False) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of every row; with ``sets`` also n, sketch and a 128-bit digest of its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, n, sketches, digests = [], [], [], []
            for x in b.column(1):
                h = _shingle_hashes(_bytes(x), width)
                fps.append(_signed(_majority(h)))
                if sets:
                    h = _as_set(h)
                    n.append(len(h))
                    sketches.append(sketch(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
            more = [pa.array(n, pa.int64()), pa.array(sketches, pa.binary()), pa.array(digests, pa.binary())] if sets else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *more], names=["k", "fp", "n", "sketch", "digest"][: 2 + len(more)])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, fp long" + ", n long, sketch binary, digest binary" * sets).withColumnRenamed("k", key)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed digests, spread over the space."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode()) for i in range(n)], dtype=np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :])


def plan_blocks(n: int, radius: int) -> tuple[int, int]:
    """(number of blocks, blocks in a key): the cheapest exact scheme whose keys have room for ``n`` fingerprints."""
    for blocks in range(radius + 1, radius + 9):
        take = blocks - radius
        if n / 2.0 ** (64 * take / blocks) <= CHANCE:
            return blocks, take
    return radius + 8, 8


def _masks(blocks: int, take: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, take)]


#: Steps of a sweep before what is left of a bucket is split once more (each costs a pass over the rest); a sweep that reaches
#: fewer than ``_WORTH`` fingerprints a step ends after ``_TRIES`` steps.
_STEPS, _TRIES, _WORTH = 256, 8, 4


def _bucket_edges(ids: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect whatever is connected in one bucket: breadth first, over rows sorted by the first pivot's distance.

    A dense bucket is reached in few steps.  What they leave is sparse; it is split by further bits (:func:`_split_edges`).
    """
    order = np.argsort(table[:, 0], kind="stable")
    ids, fps, table = ids[order], fps[order], table[order].astype(np.int16)
    left, todo, steps = np.arange(len(ids)), [], 0
    out: list[tuple[int, int]] = []
    while len(left) and len(left) + len(todo) > 1:
        idle = steps >= _TRIES and len(ids) - len(left) < _WORTH * steps
        if (steps >= _STEPS or idle) and len(left) > _PAIRWISE:
            # rows that were searched from have no links to the rest: only the rest and the rows still to search from do
            rest = np.sort(np.concatenate([left, np.array(todo, dtype=left.dtype)]))
            u, v = _split_edges(ids[rest], fps[rest], table[rest], radius)
            out.extend(zip(u.tolist(), v.tolist()))
            break
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i, steps = todo.pop(), steps + 1
        # the first coordinate is sorted: only a slice of the bucket can be near
        first = table[left, 0]
        a, b = np.searchsorted(first, table[i, 0] - radius), np.searchsorted(first, table[i, 0] + radius, side="right")
        near = left[a:b]
        near = near[np.abs(table[near] - table[i]).max(axis=1, initial=0) <= radius]
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        if len(near):
            out.extend(zip(ids[near].tolist(), [int(ids[i])] * len(near)))
            todo.extend(near.tolist())
            left = left[~np.isin(left, near, assume_unique=True)]
    return out


def _split_edges(ids: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a bucket by its own bits: those in which its members differ are dealt into ``radius + 1`` masks, one of which every link agrees in."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [i for i in range(64) if differ >> i & 1]
    if len(bits) <= radius:  # all of them link
        return ids[1:], np.repeat(ids[:1], len(ids) - 1)
    u, v = [], []
    for j in range(radius + 1):
        part = fps & np.uint64(sum(1 << i for i in bits[j :: radius + 1]))
        order = np.argsort(part, kind="stable")
        for x, y in _run_edges(part[order], ids[order], fps[order], table[order], radius):
            u.append(x)
            v.append(y)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _run_edges(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges within runs of equal keys: small runs pair by pair, all at once, larger ones by a sweep each."""
    start, size = _runs(keys)
    end = start + size
    rows = np.flatnonzero((size > 1) & (size <= _PAIRWISE))
    shift = 1
    while len(rows := rows[rows + shift < end[rows]]):
        a, b = rows, rows + shift
        for c in range(0, table.shape[1], 4):  # the table's columns, a few at a time: most pairs go at once
            ok = (np.abs(table[a, c : c + 4].astype(np.int16) - table[b, c : c + 4]) <= radius).all(axis=1)
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        yield ids[a[ok]], ids[b[ok]]
        shift += 1
    for first in np.unique(start[size > _PAIRWISE]).tolist():
        at = slice(first, first + int(size[first]))
        edges = np.array(_bucket_edges(ids[at], fps[at], table[at], radius), dtype=np.int64).reshape(-1, 2)
        yield edges[:, 0], edges[:, 1]


#: Rows of sorted keys searched at once.
_ROWS = 50_000
#: Buckets up to this size are compared pair by pair, all buckets of a batch at once.
_PAIRWISE = 96


def _search(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, refs: np.ndarray, radius: int, mark: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, id) within runs of equal keys; with ``mark`` also (id, id) of each member of a run that was swept."""
    _, size = _runs(keys)
    some = size > 1
    keys, ids, fps, swept = keys[some], ids[some], fps[some], size[some] > _PAIRWISE
    found = list(_run_edges(keys, ids, fps, pivot_table(fps, refs), radius)) if len(keys) else []
    if mark:
        found.append((ids[swept], ids[swept]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *[u for u, _ in found]]), np.concatenate([none, *[v for _, v in found]])


#: Fingerprints that a bucket may hold before it is split over tasks, and how often.
CROWDED, LEVELS = 50_000, 2


def _deal(bits: Callable[[int], int], radius: int) -> list[int]:
    """``radius + 1`` masks: bit i belongs to mask ``bits(i) % (radius + 1)``."""
    return [sum(1 << i for i in range(64) if bits(i) % (radius + 1) == j) for j in range(radius + 1)]


def _keyed(nodes: DataFrame, radius: int, *columns: str) -> DataFrame:
    """(key, id, fp, ...) in runs of equal keys: one row for each combination of agreeing blocks.

    Keys of more than ``CROWDED`` rows are split: by pigeonhole a link agrees in one of any ``radius + 1`` masks too,
    so its rows go under the key and each mask's bits instead, ``LEVELS`` times with other masks.
    """
    blocks, take = plan_blocks(nodes.count(), radius)

    def parts(masks: list[int]) -> Column:
        return F.posexplode(F.array(*[F.lit(_signed(m)).bitwiseAND(F.col("fp")) for m in masks])).alias("combo", "part")

    keyed = nodes.select("id", "fp", *columns, parts(_masks(blocks, take)))
    keyed = keyed.select(F.xxhash64("combo", "part").alias("key"), "id", "fp", *columns)
    for bits in (lambda i: i, lambda i: i // (radius + 1))[:LEVELS]:
        crowded = cut(keyed.groupBy("key").count().filter(F.col("count") > CROWDED).select("key"), "crowded")  # few: each stands for so many rows
        if crowded.isEmpty():
            drop_cut(crowded)
            break
        crowded = small(crowded)
        split = keyed.join(crowded, "key", "left_semi").select("key", "id", "fp", *columns, parts(_deal(bits, radius)))
        split = split.select(F.xxhash64("key", "combo", "part").alias("key"), "id", "fp", *columns)
        keyed = keyed.join(crowded, "key", "left_anti").select("key", "id", "fp", *columns).unionByName(split)
    return keyed.repartition("key").sortWithinPartitions("key")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the batches, in pieces that end where the first column, the sorted key, changes."""
    held, n = [], 0
    for b in batches:
        held.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n < _ROWS:
            continue
        now = [np.concatenate(x) for x in zip(*held)]
        last = int(np.searchsorted(now[0], now[0][-1]))  # keys are sorted; the last bucket may go on
        held, n = [[x[last:] for x in now]], n - last
        if last:
            yield [x[:last] for x in now]
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every row's run of equal keys."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    return np.repeat(starts, sizes), np.repeat(sizes, sizes)


def links(nodes: DataFrame, radius: int = 4, mark: bool = False) -> DataFrame:
    """Edges (u, v) over distinct fingerprints (id, fp) that connect exactly what distances up to ``radius`` connect.

    With ``mark``, members of buckets that were swept, not compared pair by pair, come as edges to themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = pivots()
        for keys, ids, fps in _whole_runs(batches):
            yield _edge_batch(*_search(keys, ids, fps.astype(np.int64).view(np.uint64), refs, radius, mark))

    return _keyed(nodes, radius).mapInArrow(run, "u long, v long").distinct()


def _edge_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v), pa.int64()), pa.array(np.minimum(u, v), pa.int64())], names=["u", "v"])


def _pairs(keys: np.ndarray, ids: np.ndarray, ok: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Edges between all rows of a run of equal keys for which ``ok`` (of row numbers) holds, in bounded batches."""
    start, size = _runs(keys)
    end, rows = start + size, np.flatnonzero(size > 1)
    u, v, n, shift = [], [], 0, 1
    while len(rows := rows[rows + shift < end[rows]]):
        good = ok(rows, rows + shift)
        u.append(ids[rows[good]])
        v.append(ids[rows[good] + shift])
        n, shift = n + len(u[-1]), shift + 1
        if n > most:
            yield _edge_batch(np.concatenate(u), np.concatenate(v))
            u, v, n = [], [], 0
    if n:
        yield _edge_batch(np.concatenate(u), np.concatenate(v))


def apart(nodes: DataFrame, radius: int) -> DataFrame:
    """All pairs (u, v) of fingerprints (id, fp, label) within ``radius`` whose labels differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, fps, label in _whole_runs(batches):
            bits = fps.astype(np.int64).view(np.uint64)
            yield from _pairs(keys, ids, lambda a, b: (label[a] != label[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= radius))  # noqa: B023

    return _keyed(nodes, radius, "label").mapInArrow(run, "u long, v long").distinct()


#: Documents whose shingles tell the frequent ones, in how many of them a frequent one stands, and how many are kept.
_SAMPLE, _FREQUENT, _HOT = 5_000, 4, 100_000
#: Buckets of shingles beyond this size are compared with their first member before all their pairs.
_CROWD = 32


def _shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of :func:`similarity`'s shingles: a text without words has one, the empty one."""
    return _as_set(_shingle_hashes(text, width))


def _as_set(h: np.ndarray) -> np.ndarray:
    h = np.unique(h)
    return h if len(h) else np.array([xxhash.xxh64_intdigest(b"", 42)], dtype="<u8")


def frequent(docs: DataFrame, key: str, text: str, width: int) -> np.ndarray:
    """Shingle hashes that recur in a sample, sorted: a hint for the order of shingles, which stays exact with any list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(_bytes(x), width).view(np.int64))], names=["a"])

    share = max(1, -(-docs.count() // _SAMPLE))
    rows = docs.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(F.col(text).cast("string").cast("binary").alias("t"))
    counted = rows.mapInArrow(run, "a long").groupBy("a").count().filter(F.col("count") >= _FREQUENT)
    return np.sort(counted.orderBy(F.desc("count")).limit(_HOT).toPandas()["a"].to_numpy(dtype=np.int64).view(np.uint64))


def prefixes(docs: DataFrame, least: float, key: str, text: str, width: int) -> DataFrame:
    """(a, id, n, at): the first shingles of every text in the common order that another text shares, the size of its set, and their places."""
    hot = frequent(docs, key, text, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, n = [], np.zeros(b.num_rows, np.int32)
            for i, x in enumerate(b.column(1)):
                h = _shingle_set(_bytes(x), width)
                late = np.isin(h, hot, assume_unique=True)
                n[i] = len(h)
                found.append(np.concatenate((h[~late], h[late]))[: len(h) - ceil(least * len(h) - 1e-9) + 1])
            sizes = [len(x) for x in found]
            at = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes] or [np.zeros(0, np.int32)])
            a = np.concatenate(found or [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
            ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids), pa.array(np.repeat(n, sizes)), pa.array(at)], names=["a", "id", "n", "at"])
        pa.default_memory_pool().release_unused()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_runs(batches):
            some = _runs(cols[0])[1] > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in cols], names=["a", "id", "n", "at"])

    kind = "a long, id long, n int, at int"
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, kind).repartition("a").sortWithinPartitions("a").mapInArrow(shared, kind)


def alike(shared: DataFrame, labels: DataFrame, least: float, first: bool) -> DataFrame:
    """Pairs (u, v) that may have a similarity of ``least`` and whose labels (id, component) differ, from shared prefixes.

    ``first``: only of each crowded bucket's members with its first one, which unites most of a large group at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, ids, n, at, label in _whole_runs(batches):

            def ok(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                # at the first shingle that both share, no more than what follows can be common
                need = least / (1 + least) * (n[x].astype(np.int64) + n[y]) - 1e-9  # noqa: B023
                return (label[x] != label[y]) & (np.minimum(n[x] - at[x], n[y] - at[y]) >= need)  # noqa: B023

            if first:
                start, size = _runs(a)
                rows = np.flatnonzero((size > _CROWD) & (start < np.arange(len(a))))
                rows = rows[ok(start[rows], rows)]
                yield _edge_batch(ids[start[rows]], ids[rows])
            else:
                yield from _pairs(a, ids, ok)

    rows = shared.join(small(labels.filter("id <> component")), "id", "left")
    rows = rows.select("a", "id", "n", "at", F.coalesce("component", "id").alias("label"))
    return rows.repartition("a").sortWithinPartitions("a", "id").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v): the smallest id that is reachable.

    Alternating large-star and small-star (Kiveris et al. 2014): each round is grouped and joined on
    distributed tables, partial minima come first, and nothing but a checksum reaches the driver.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, now = now, cut(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        drop_cut(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def similarity(a: bytes, b: bytes, width: int = 5) -> float:
    """Jaccard similarity of two texts' sets of word shingles."""

    def shingles(text: bytes) -> set[bytes]:
        w = text.lower().split()
        return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def plausible(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The edges (u, v) that the sketches of ``sets`` (id, n, sketch) cannot rule out; a sketch has two bits for each shingle, so no text travels here."""
    of = lambda side: sets.select(F.col("id").alias(side), F.struct("n", "sketch").alias(f"s{side}"))
    both = edges.join(of("v"), "v").join(of("u"), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [may_be_alike(a, b, na, nb, least) for a, b, na, nb in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), x.column(4).to_pylist(), x.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(x.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "su.sketch", "sv.sketch", F.col("su.n").alias("nu"), F.col("sv.n").alias("nv")).toDF("u", "v", "a", "b", "nu", "nv").mapInArrow(run, "u long, v long")


def verified(edges: DataFrame, docs: DataFrame, least: float, key: str, text: str, width: int, sets: DataFrame | None = None) -> DataFrame:
    """The edges whose texts have a similarity of ``least`` or more, as a written table; only texts that an edge names are read again."""
    edges = cut(plausible(edges, sets, least) if sets is not None else edges, "candidates")
    ids = small(edges.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(text).cast("string").cast("binary").alias("t")).join(ids, "id", "left_semi")
    texts = cut(texts.groupBy("id").agg(F.min("t").alias("t")), "candidate-texts")
    both = edges.join(texts.withColumnsRenamed({"id": "v", "t": "b"}), "v").join(texts.withColumnsRenamed({"id": "u", "t": "a"}), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [similarity(*map(_bytes, pair), width) >= least for pair in zip(x.column(2), x.column(3))]
            yield pa.RecordBatch.from_arrays(x.columns[:2], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    out = cut(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "verified")
    drop_cut(edges)
    drop_cut(texts)
    return out


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, least: float | None = None, whole: bool = False) -> DataFrame:
    """``key``, fp (signed long) and component_id (the smallest reachable key) of every row.

    With ``least``, a link must also have shingle sets of that Jaccard similarity; a wider radius then costs no false links.
    With ``whole``, such sets link at any distance.
    Rows of one fingerprint (with ``least``: of one set of shingles) are one node, named by the smallest key.  With ``least``, rows
    that share a key are one document, and the smallest of their texts stands for it.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text)
    fps = cut(fingerprints(docs, key, text, width, least is not None), "fps")
    if least is not None and not fps.groupBy(key).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b").isEmpty():
        docs = cut(docs.groupBy(key).agg(F.min(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias(text)), "one-text-a-key")
        fps = cut(fingerprints(docs, key, text, width, True), "fps")
    named = fps.withColumn("id", F.coalesce(F.col(key), F.lit(_NULL_ID)))
    if least is None:
        nodes = cut(named.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
        groups = cut(components(links(nodes, radius)), "components")
        of = nodes.join(groups, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
        out = fps.join(of, "fp")
    else:
        nodes = cut(named.groupBy("digest").agg(F.min("id").alias("id"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
        groups = similar_groups(nodes, docs, key, text, width, radius, least, whole)
        of = nodes.join(groups, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
        out = fps.join(of, "digest")
    out = cut(out.select(key, "fp", F.when(F.col("component") != _NULL_ID, F.col("component")).alias("component_id")), "groups")
    for x in (fps, nodes, groups):
        drop_cut(x)
    return out


def similar_groups(nodes: DataFrame, docs: DataFrame, key: str, text: str, width: int, radius: int, least: float, whole: bool) -> DataFrame:
    """(id, component) over the distinct sets ``nodes`` (id, fp, n, sketch), linked where their similarity is ``least`` or more."""
    check = lambda edges: verified(edges, docs, least, key, text, width, nodes)
    found = cut(links(nodes, radius, mark=not whole), "links")
    good = check(found.filter("u <> v"))
    groups = cut(components(good), "components")
    if whole:
        id_ = F.coalesce(F.col(key), F.lit(_NULL_ID))
        distinct = docs.join(small(nodes.select(F.col("id").alias("_id"))), id_ == F.col("_id"), "left_semi")
        shared = cut(prefixes(distinct, least, key, text, width), "shared-shingles")
        rounds = [lambda g: alike(shared, g, least, True), lambda g: alike(shared, g, least, False)]
    else:
        swept = nodes.join(found.filter("u = v").select(F.col("u").alias("id")), "id", "left_semi")
        rounds = [lambda g: apart(swept.join(g, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("label")), radius)]
    for pairs in rounds:
        more = check(pairs(groups))
        if not more.isEmpty():
            # links between groups that stand already: a few edges instead of all
            label = lambda side: groups.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))  # noqa: B023, E731
            joined = more.join(label("u"), "u", "left").join(label("v"), "v", "left")
            joined = joined.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
            known = groups.filter("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v"))
            before, groups = groups, cut(components(joined.unionByName(known)), "components")
            drop_cut(before)
        drop_cut(more)
    for x in (found, good):
        drop_cut(x)
    if whole:
        drop_cut(shared)
    return groups


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, least: float | None = None, whole: bool = False) -> DataFrame:
    """One row of each group of near copies, the one with the smallest key; rows that share a key count as one document and leave one row."""
    groups = near_groups(docs, key, text, width, radius, least, whole)
    kept = without(docs, groups.filter(~F.col("component_id").eqNullSafe(F.col(key))), key)
    again = groups.groupBy(key).count().filter("count > 1")
    if again.isEmpty():
        return kept
    out = unused(docs, "_again")
    again = small(again.select(F.col(key).alias(out)))
    same = F.col(key).eqNullSafe(F.col(out))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([key]))

"""Line deduplication by pairwise alignment.

Passages that documents share are found through rare hashes, aligned pair by
pair with a patience diff, and deleted from the later document (the one with the
larger key).

With ``line_words``, real lines of so many words or more that stand in several documents stay
in the first one only.  A line that ``RARE_DOCS`` documents or fewer hold pairs each holder with the first one,
and the pair is aligned on its lines as well.  A line of more documents is boilerplate: it says nothing about
which texts overlap, so it pairs none; its hash marks it in every later document, and it goes from there.

For passages, lines are logical ones.  A passage may stand inside another document's line, so
a text is read as overlapping lines of ``WIDTH`` words; the hash of a line is
kept if it is the smallest of ``MIN_WORDS - WIDTH + 1`` neighbours (winnowing).
This keeps about one hash in ten words, yet any passage of ``MIN_WORDS`` words
that two documents share leaves at least one hash in common, wherever it stands.
Lines so long hardly recur by chance, so the hashes are rare.

A hash that two documents hold pairs them.  The first of more holders may have a
shorter piece of a passage only, so there the runs of ``MIN_WORDS`` words that
the hash stands for are joined, and each pairs its holders with its first one,
which has it whole: a group of any size makes few pairs for each member, and hot
hashes are pre-aggregated.  A pair is aligned on the lines that both texts hold (the n-th
occurrence of a line with the n-th), the longest increasing chain of them first,
then what is left over in other order, and each match is extended word by word.
Common blocks of ``MIN_WORDS`` words or more go; then what stays between them is
searched for any run of ``MIN_WORDS`` words that the earlier text holds anywhere,
so further copies of a passage go as well.  Shorter ones stay.

Defined results: a null, empty or short text stays as it is; a text that is all
copied becomes empty, its row stays; a null key is never compared; rows of one
key are not compared with each other, and equal ones are edited alike; all
columns of the input come back, and names starting with ``_ld_`` are reserved.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.llm.common import bounded_batches, cut, drop_cut, release, small
from mnemoframe.llm.rolling import prefix_sums, window

MIN_WORDS = 50
WIDTH = 30
#: Documents that may hold a real line before it counts as boilerplate.
RARE_DOCS = 10

#: Bytes hashed at a time, or one word if that is longer.
STRETCH = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, which are those of ``bytes.split``."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = [0] if len(space) and not space[0] else [], [len(space)] if len(space) and not space[-1] else []
    edges = np.concatenate((np.array(first, np.int64), edges, np.array(last, np.int64)))
    return edges[::2], edges[1::2]


class Words:
    """The words of a text by their places, cut out only where they are asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self.starts, self.ends = word_spans(text)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, at: int | slice) -> bytes | list[bytes]:
        if isinstance(at, slice):
            some = range(len(self))[at]
            return self.text[self.starts[some[0]] : self.ends[some[-1]]].split() if some else []
        return self.text[self.starts[at] : self.ends[at]]


def text_sums(text: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """What :func:`run_hashes` takes, computed once for all widths: sums over the hashes of the words, which are taken from the bytes a stretch at a time."""
    starts, ends = spans or word_spans(text)
    raw, hashes, i = np.frombuffer(text, np.uint8), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + STRETCH, "right")))
        values = raw[at : int(ends[j - 1])].astype(np.uint64)
        values += np.uint64(1)
        hashes[i:j] = window(prefix_sums(values), starts[i:j] - at, ends[i:j] - at)
        i = j
    return prefix_sums(hashes)


def run_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    at = np.arange(max(0, len(sums) - width))
    return window(sums, at, at + width) if len(at) else np.zeros(0, np.uint64)


def line_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    return run_hashes(text_sums(b" ".join(words)), width)


def winnow(h: np.ndarray, span: int) -> np.ndarray:
    """The distinct minima of all runs of ``span`` hashes."""
    return np.unique(minima(h, span))


def minima(h: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every run of ``span`` hashes."""
    if len(h) < span:
        return np.zeros(0, np.uint64)
    m, w = h, 1
    while 2 * w <= span:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    if w < span:
        m = np.minimum(m[: len(m) - (span - w)], m[span - w :])
    return m


def _occurrences(h: np.ndarray) -> np.ndarray:
    """For each hash, how many equal ones stand before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - first
    return out


def _chain(values: list[int]) -> list[int]:
    """Indices of a longest increasing chain."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tails, v)
        if p == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[p], at[p] = v, i
        back[i] = at[p - 1] if p else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_blocks(
    earlier: list[bytes] | Words, later: list[bytes] | Words, width: int = WIDTH, least: int = MIN_WORDS, sums: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[tuple[int, int]]:
    """Word ranges of ``later`` that ``earlier`` holds too, of ``least`` words or more, in order; ``sums`` are those of both, which :func:`run_hashes` takes."""
    if earlier == later:
        return [(0, len(later))] if len(later) >= least else []
    sums = sums or tuple(text_sums(b" ".join(words)) for words in (earlier, later))
    found = _aligned(earlier, later, width, least, sums)
    return sorted(found + _left_over(earlier, later, found, least, sums))


def _left_over(earlier: list[bytes] | Words, later: list[bytes] | Words, found: list[tuple[int, int]], least: int, sums: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Word ranges between the blocks ``found`` that consist of runs of ``least`` words which ``earlier`` holds anywhere."""
    edges = [0, *(x for block in sorted(found) for x in block), len(later)]
    gaps = [(s, e) for s, e in zip(edges[::2], edges[1::2]) if e - s >= least]
    if not gaps or len(earlier) < least:
        return []
    a, b = (run_hashes(x, least) for x in sums)
    order = np.argsort(a, kind="stable")
    sorted_a = a[order]
    out: list[tuple[int, int]] = []
    for s, e in gaps:
        h = b[s : e - least + 1]
        hit = np.minimum(np.searchsorted(sorted_a, h), len(a) - 1)
        for j in np.flatnonzero(sorted_a[hit] == h).tolist():
            i, j = int(order[hit[j]]), s + j
            if later[j : j + least] == earlier[i : i + least]:
                if out and j <= out[-1][1] and out[-1][0] >= s:
                    out[-1] = (out[-1][0], j + least)
                else:
                    out.append((j, j + least))
    return out


def real_lines(text: bytes, least: int) -> list[tuple[bytes, int, int]]:
    """(line, start, end) of the lines of ``least`` words or more, without the white space around them."""
    out, at = [], 0
    for raw in text.split(b"\n"):
        line = raw.strip()
        if line and len(line.split(None, least - 1)) == least:
            start = at + raw.index(line)
            out.append((line, start, start + len(line)))
        at += len(raw) + 1
    return out


#: Hashes of real lines are odd, others even.
_EVEN = np.uint64((1 << 64) - 2)


def line_digest(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, 9) | 1


def common_lines(earlier: bytes, later: bytes, least: int) -> list[tuple[int, int]]:
    """Byte ranges of the real lines of ``later`` that ``earlier`` holds too, by an alignment of the two texts' lines."""
    a, b = real_lines(earlier, least), real_lines(later, least)
    if not a or not b:
        return []
    own, other = ([line for line, _, _ in x] for x in (a, b))
    sums = tuple(prefix_sums(np.fromiter(map(line_digest, x), np.uint64, len(x))) for x in (own, other))
    return [b[i][1:] for x, y in common_blocks(own, other, 1, 1, sums) for i in range(x, y)]


def _aligned(earlier: list[bytes] | Words, later: list[bytes] | Words, width: int, least: int, sums: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """Common blocks by one patience alignment."""
    a, b = (run_hashes(x, width) for x in sums)
    if not len(a) or not len(b):
        return []
    # the n-th occurrence of a line meets the n-th
    mixed = [h ^ (_occurrences(h).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for h in (a, b)]
    order = np.argsort(mixed[0], kind="stable")
    at = np.searchsorted(mixed[0][order], mixed[1])
    hit = order[np.minimum(at, len(order) - 1)]
    j = np.flatnonzero(mixed[0][hit] == mixed[1])
    i = hit[j]
    if not len(j):
        return []
    # lines that follow each other in both texts are one match
    breaks = np.flatnonzero((np.diff(j) != 1) | (np.diff(i) != 1)) + 1
    heads, ends = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(j)]))
    left = [(int(j[x]), int(i[x]), int(y - x) + width - 1) for x, y in zip(heads, ends)]
    found: list[tuple[int, int]] = []
    free = np.ones(len(later), bool)
    while left:
        chain = set(_chain([m[1] for m in left]))
        gained = False
        for n in sorted(chain):
            js, is_, size = left[n]
            if not free[js : js + size].all():
                busy = np.flatnonzero(free[js : js + size])
                if not len(busy):
                    continue
                js, is_, size = js + int(busy[0]), is_ + int(busy[0]), int(busy[-1] - busy[0]) + 1
            if later[js : js + size] != earlier[is_ : is_ + size]:
                continue
            while js and is_ and free[js - 1] and later[js - 1] == earlier[is_ - 1]:
                js, is_, size = js - 1, is_ - 1, size + 1
            while js + size < len(later) and is_ + size < len(earlier) and free[js + size] and later[js + size] == earlier[is_ + size]:
                size += 1
            if size >= least:
                found.append((js, js + size))
                free[js : js + size] = False
                gained = True
        left = [m for n, m in enumerate(left) if n not in chain and free[m[0] : m[0] + m[2]].any()]
        if not gained and not left:
            break
    return sorted(found)


def delete(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the byte ranges; lines left without words go, what is left of a line is joined by single spaces."""
    out, at, n = [], 0, 0
    spans = _merged(spans)
    for line in text.split(b"\n"):
        end = at + len(line)
        while n < len(spans) and spans[n][1] <= at:
            n += 1
        parts, pos, k = [], at, n
        while k < len(spans) and spans[k][0] < end:
            parts.append(text[pos : max(pos, spans[k][0])])
            pos = min(end, spans[k][1])
            k += 1
        if k == n:
            out.append(line)
        else:
            parts.append(text[pos:end])
            if rest := b" ".join(x for p in parts if (x := p.strip(b" \t\r\x0b\x0c"))):
                out.append(rest)
        at = end + 1
    return b"\n".join(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def anchors(docs: DataFrame, key: str, text: str, width: int, least: int, line_words: int | None = None) -> DataFrame:
    """(a, k): the rare line hashes of every row (even), and the hashes of its real lines (odd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, real = [], []
            for x in b.column(1):
                t = _bytes(x)
                found.append(winnow(run_hashes(text_sums(t), width), least - width + 1) & _EVEN)
                if line_words:
                    real.append(np.array(list({line_digest(line) for line, _, _ in real_lines(t, line_words)}), np.uint64))
            names = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.concatenate([np.repeat(names, [len(x) for x in xs]) for xs in (found, real) if xs] or [names[:0]])
            hashes = np.concatenate([*found, *real] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys)], names=["a", "k"])
        pa.default_memory_pool().release_unused()

    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "a long, k long")


def whole_runs(docs: DataFrame, marked: DataFrame, key: str, text: str, width: int, least: int) -> DataFrame:
    """(a, k): the hashes of all runs of ``least`` words whose rare line hash is one of ``marked`` (k, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for x, marks in zip(b.column(1), b.column(2)):
                sums = text_sums(_bytes(x))
                low = minima(run_hashes(sums, width), least - width + 1) & _EVEN
                some = np.isin(low, marks.values.to_numpy().view(np.uint64))
                found.append(np.unique(run_hashes(sums, least)[some]))
            keys = np.repeat(b.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(keys)], names=["a", "k"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").cast("binary").alias("t"))
    rows = rows.join(small(marked.select("k")), "k", "left_semi")
    return rows.join(marked, "k").select("k", "t", "marks").mapInArrow(run, "a long, k long")


def _first(found: DataFrame) -> DataFrame:
    """(a, first, n): the first holder of every hash that several keys hold, and the number of rows that hold it."""
    return found.groupBy("a").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n")).filter("last > first").select("a", "first", "n")


def _with_first(shared: DataFrame) -> DataFrame:
    """(later, earlier, line): holders with the first one, and whether they share a real line, a run of words, or both (a row each)."""
    both = shared.filter("k > first")
    return both.select(F.col("k").alias("later"), F.col("first").alias("earlier"), F.col("a").bitwiseAND(1).cast("boolean").alias("line")).distinct()


def pairs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = MIN_WORDS, line_words: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents to align (later, earlier, runs, lines: what they are known to share), and boilerplate (id, lines): the hashes of the lines that go from a document anyway.

    Every run of ``least`` words of a later document is paired with a document that holds it whole, if an earlier one does.
    """
    line = F.col("a").bitwiseAND(1) == 1
    found = cut(anchors(docs, key, text, width, least, line_words), "anchors")
    first = cut(_first(found), "shared")
    shared = cut(found.join(small(first), "a"), "holders")
    drop_cut(found)
    drop_cut(first)
    marked = cut(shared.filter((F.col("n") > 2) & ~line).groupBy("k").agg(F.collect_set("a").alias("marks")), "marked")
    two = cut(_with_first(shared.filter(F.when(line, F.col("n") <= RARE_DOCS).otherwise(F.col("n") == 2))), "pairs-of-two")
    common = shared.filter(line & (F.col("n") > RARE_DOCS) & (F.col("k") > F.col("first")))
    boilerplate = cut(common.groupBy(F.col("k").alias("id")).agg(F.collect_set("a").alias("lines")), "boilerplate")  # a text's own lines at most
    drop_cut(shared)
    release(docs.sparkSession)
    runs = cut(whole_runs(docs, marked, key, text, width, least), "runs")
    drop_cut(marked)
    first = cut(_first(runs), "shared-runs")
    both = two.unionByName(_with_first(runs.join(small(first), "a")).withColumn("line", F.lit(False)))
    out = cut(both.groupBy("later", "earlier").agg(F.bool_or(~F.col("line")).alias("runs"), F.bool_or("line").alias("lines")), "pairs")
    for x in (two, runs, first):
        drop_cut(x)
    del x, two, runs, first, both, marked, common, shared, found
    release(docs.sparkSession)
    return out, boilerplate


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = MIN_WORDS, n_chars: str | None = None, line_words: int | None = None,
) -> DataFrame:
    """``docs`` with the copied passages (and lines) deleted, and _ld_blocks and _ld_words: what was deleted (0 where nothing was).

    ``n_chars`` names a column that holds the text's length and is kept true.
    """
    found, boilerplate = pairs(docs, key, text, width, least, line_words)
    ids = small(found.select(F.explode(F.array("later", "earlier")).alias("_ld_id")).unionByName(boilerplate.select(F.col("id").alias("_ld_id"))).distinct())
    marked = docs.withColumn("_ld_id", F.col(key).cast("long")).withColumn("_ld_th", F.xxhash64(text))
    rows = cut(marked.join(ids, "_ld_id", "left_semi"), "involved")
    named = rows.select(F.col("_ld_id").alias("id"), F.col("_ld_th").alias("th"))
    texts = rows.select("_ld_id", "_ld_th", F.col(text).cast("string").cast("binary").alias("t"))
    first = small(found.select(F.col("earlier").alias("_ld_id")).distinct())
    earlier = cut(texts.join(first, "_ld_id", "left_semi").groupBy("_ld_id").agg(F.min("t").alias("e")).withColumnRenamed("_ld_id", "earlier"), "earlier")  # so that a hot one can be split in the join
    if not named.groupBy("id", "th").count().filter("count > 1").isEmpty():  # repeated rows are aligned once; without any, texts need no shuffle for it
        texts = texts.distinct()
    both = found.join(earlier, "earlier").join(texts.withColumnRenamed("_ld_id", "later"), "later").select("later", "_ld_th", "t", "e", "runs", "lines")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            later, th, spans = [], [], []
            last, words, sums = b"", Words(b""), text_sums(b"")  # pairs of one later text mostly follow each other
            rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist())
            for k, h, t, e, by_runs, by_lines in rows:
                t, e, own = _bytes(t), _bytes(e), []
                if by_runs:
                    if t != last:
                        last, words = t, Words(t)
                        sums = text_sums(t, (words.starts, words.ends))
                    if t == e:
                        blocks = [(0, len(words))] * (len(words) >= least)
                    else:
                        other = Words(e)
                        blocks = common_blocks(other, words, width, least, (text_sums(e, (other.starts, other.ends)), sums))
                    own = [(int(words.starts[x]), int(words.ends[y - 1])) for x, y in blocks]
                if by_lines:  # lines inside a passage that goes are gone with it
                    own = _merged(own + common_lines(e, t, line_words))
                if own:
                    later.append(k)
                    th.append(h)
                    spans.append([{"s": x, "e": y} for x, y in own])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(later, pa.int64()), pa.array(th, pa.int64()), pa.array(spans, kind)], names=["id", "th", "spans"])

    spans = both.mapInArrow(align, "id long, th long, spans array<struct<s:long,e:long>>")
    spans = spans.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a text's own hashes
    nothing = F.array().cast("array<struct<s:long,e:long>>")
    marks = named.distinct().join(boilerplate, "id").select("id", "th", nothing.alias("spans"), "lines")
    both = spans.withColumn("lines", F.array().cast("array<long>")).unionByName(marks)
    spans = cut(both.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("lines")).alias("lines")), "spans")  # two rows a text at most
    drop_cut(earlier)
    del both
    release(docs.sparkSession)
    kind = T.StructType([T.StructField(text, T.StringType()), T.StructField("_ld_blocks", T.LongType()), T.StructField("_ld_words", T.LongType())])

    @F.arrow_udf(kind)
    def edit(texts: pa.Array, spans: pa.Array, lines: pa.Array) -> pa.Array:
        out, blocks, words = [], [], []
        for t, own, hashes in zip(texts, spans.to_pylist(), lines):
            t, marks = _bytes(t), set(hashes.values.to_numpy().view(np.uint64).tolist())
            known = [(s, e) for line, s, e in real_lines(t, line_words) if line_digest(line) in marks] if marks else []
            gone = _merged([(x["s"], x["e"]) for x in own] + known)
            out.append(delete(t, gone).decode())
            blocks.append(len(gone))
            words.append(sum(len(t[s:e].split()) for s, e in gone))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(blocks, pa.int64()), pa.array(words, pa.int64())], names=[text, "_ld_blocks", "_ld_words"])

    marks = spans.select(F.col("id").alias("_ld_id"), F.col("th").alias("_ld_th"), F.col("spans").alias("_ld_spans"), F.col("lines").alias("_ld_lines"))
    edited = rows.join(marks, ["_ld_id", "_ld_th"]).withColumn("_ld_edit", edit(F.col(text).cast("string").cast("binary"), "_ld_spans", "_ld_lines"))
    changed = edited.select(*docs.drop(text).columns, "_ld_edit.*")
    if n_chars:
        kind = docs.schema[n_chars].dataType
        changed = changed.withColumn(n_chars, F.length(text).cast(kind))
    keys = small(spans.select(F.col("id").alias("_ld_id"), F.col("th").alias("_ld_th")))
    same = marked.join(keys, ["_ld_id", "_ld_th"], "left_anti").withColumns({"_ld_blocks": F.lit(0).cast("long"), "_ld_words": F.lit(0).cast("long")})
    columns = [*docs.columns, "_ld_blocks", "_ld_words"]
    return same.select(columns).unionByName(changed.select(columns))

"""Packing documents into token sequences by a linear grouping scheme.

Tokenised documents are cut into pieces only where they exceed a sequence.  What
is left is bin packing, and as lengths are whole numbers up to the sequence
length, all that the plan needs from the corpus is the number of pieces of each
length: at most 2048 counts, whatever the corpus.  On these counts

1. large lengths are ranked and put into groups of equal cardinality, each
   rounded up to its largest member, which leaves few sizes;
2. configurations of these sizes are optimised by column generation (a linear
   programme with knapsack pricing), and their rounded-down multiples opened;
3. actual lengths take the places of the rounded ones, so slack appears;
4. what is left, small pieces above all, goes best-fit, longest first, into the
   slack, and into new sequences where there is none;
5. sequences that stay short are taken apart and best-fitted anew, if that saves any.

The plan is a list of runs (so many sequences with such lengths).  Pieces of one
length are numbered in parallel over salted lots, and each number finds its
sequence and place in the plan by binary search.

Defined results: a null or empty text is the end token alone; repeated rows are
packed as often as they come; an empty table gives an empty result; a text of
any length is cut without holding more than its tokens; other columns are unread.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import bounded_batches, cut
from mnemoframe.llm.rolling import prefix_sums, window

CAPACITY = 2048
GROUPS = 64
#: Lengths up to this are small: they wait for the slack.
SMALL = 100
#: Words of a generation whose ids a worker remembers; it keeps two (about 50 bytes a word).
CACHE = 400_000
#: Words of more bytes are not remembered.
LONG = 48
#: Bytes of texts encoded together: the more, the fewer words are looked up twice, and the more a worker needs.
CHUNK = 2 << 20
#: White space beyond ASCII, control characters, and what may start a special token: such texts are encoded whole.
_ODD = re.compile("<\\||[\x1c-\x1f\x85\xa0 ᠎ -‏ -  　﻿]")

#: Words that the tokenizer takes as one, whatever the case, and marks that are tokens of their own behind them.
_LATIN, _MARKS = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$", ",.;:!?"


class Words:
    """Ids of words by the words' hashes: arrays only, an open table of 64-bit hashes and one run of ids."""

    def __init__(self, kind: type, room: int = 1 << 14):
        self.n = 0
        self.table = np.zeros(room, np.uint64)  # hash by slot, 0 where free
        self.which = np.zeros(room, np.int32)
        self.starts = np.zeros(room // 2 + 1, np.int64)
        self.ids = np.zeros(4 * room, kind)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's word, or -1."""
        out = np.full(len(h), -1, np.int32)
        rows, slot, last = np.arange(len(h)), self._slots(h), len(self.table) - 1
        while len(rows):
            there = self.table[slot]
            hit = there == h[rows]
            out[rows[hit]] = self.which[slot[hit]]
            on = ~hit & (there != 0)
            rows, slot = rows[on], (slot[on] + 1) & last
        return out

    def add(self, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new hashes with so many ids each."""
        first, n = self.n, self.n + len(h)
        while len(self.starts) <= n:
            self.starts = np.concatenate((self.starts, np.zeros(len(self.starts), np.int64)))
        end = int(self.starts[first]) + len(ids)
        while len(self.ids) < end:
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), self.ids.dtype)))
        self.ids[end - len(ids) : end] = ids
        self.starts[first + 1 : n + 1] = self.starts[first] + np.cumsum(sizes)
        self.n = n
        if 2 * n > len(self.table):
            used = np.flatnonzero(self.table)
            old, which = self.table[used], self.which[used]
            room = 1 << (2 * n).bit_length()
            self.table, self.which = np.zeros(room, np.uint64), np.zeros(room, np.int32)
            self._put(old, which)
        self._put(h, np.arange(first, n, dtype=np.int32))

    def _put(self, h: np.ndarray, which: np.ndarray) -> None:
        slot, last = self._slots(h), len(self.table) - 1
        while len(h):
            free = self.table[slot] == 0
            self.table[slot[free]] = h[free]  # of several that want one slot, the last gets it
            got = free & (self.table[slot] == h)
            self.which[slot[got]] = which[got]
            h, which, slot = h[~got], which[~got], (slot[~got] + 1) & last

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words by number."""
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        return sizes, self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]


def word_hashes(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, size in bytes) of each word; two rolling hashes in one number, never 0."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    a, b = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[a:b] if b > a else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1] - a, offsets[1:] - a
    h = np.zeros(len(words), np.uint64)
    for at in range(0, len(words), 50_000):  # short runs keep the powers few
        lo, hi = int(starts[at]), int(ends[min(at + 50_000, len(words)) - 1])
        part = slice(at, at + 50_000)
        h[part] = window(prefix_sums(data[lo:hi].astype(np.uint64) + np.uint64(1)), starts[part] - lo, ends[part] - lo)
    sizes = ends - starts
    return np.maximum(h ^ (sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.uint64(1)), sizes


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to encoding each text whole.

    The tokenizer drops white space and never joins across it, so words are encoded apart, and common ones once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Latin letters in lower case are normal already and one word to the splitting pattern: they go straight to the merges
        self.latin = Tokenizer.from_file(path)
        self.latin.normalizer = None
        self.latin.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes that a token stands for, one a character
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token.removesuffix("</w>"))
        self.marks = {ord(x): int(ids[0]) for x in _MARKS if len(ids := self._whole(x)) == 1}
        self.known, self.older = Words(self.kind), Words(self.kind)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._whole(w).astype(self.kind) for w in words]
        return np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, self.kind), *found])

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words of lower-case Latin letters, many in one call: where a word ends follows from the bytes that its tokens stand for."""
        sizes, out = [], []
        for at in range(0, len(words), 2_000):
            part = words[at : at + 2_000]
            ids = np.array(self.latin.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            ends, want = np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in part])
            cuts = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and np.array_equal(ends[cuts], want):
                n, found = np.diff(np.concatenate(([0], cuts + 1))), ids
            else:
                n, found = self._one_by_one(part)
            sizes.append(n)
            out.append(found)
        return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, self.kind), *out])

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of any words: a NUL between them is a word of its own, whose id marks the ends."""
        mark = self.tokenizer.encode("\0", add_special_tokens=False).ids
        sizes, out = [], []
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" \0 ".join(part) + " \0"], add_special_tokens=False)[0].ids, dtype=self.kind)
            is_end = ids == mark[0]
            ends = np.flatnonzero(is_end)
            if len(mark) != 1 or len(ends) != len(part) or any("\0" in w for w in part):
                n, found = self._one_by_one(part)
            else:
                n, found = np.diff(np.concatenate(([-1], ends))) - 1, ids[~is_end]
            sizes.append(n)
            out.append(found)
        return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, self.kind), *out])

    def _learn(self, words: pa.LargeStringArray, h: np.ndarray) -> None:
        """Remember words that are not known.  Case is dropped, and a mark after a letter is a token of its own: most words follow from others."""
        base = pc.utf8_rtrim(words, characters=_MARKS)
        marked = pc.binary_length(words).to_numpy() - pc.binary_length(base).to_numpy()
        plain = (marked <= 1) & pc.match_substring_regex(base, _LATIN).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(plain)
        names = pc.utf8_lower(base.take(pa.array(rows))).dictionary_encode()
        own, _ = word_hashes(names.dictionary)
        new = np.flatnonzero(self.known.find(own) < 0)
        self.known.add(own[new], *self._letters(names.dictionary.take(pa.array(new)).to_pylist()))
        rows_of = names.indices.to_numpy()
        left = self.known.find(h[rows]) < 0  # others than the bases themselves
        rows, at, mark = rows[left], self.known.find(own)[rows_of[left]], marked[rows[left]]
        sizes, ids = self.known.gather(at)
        out = np.zeros(len(ids) + int(mark.sum()), self.kind)
        out[np.arange(len(ids)) + np.repeat(np.cumsum(mark) - mark, sizes)] = ids
        texts = words.take(pa.array(rows[mark == 1])).to_pylist()
        out[np.cumsum(sizes + mark)[mark == 1] - 1] = [self.marks[ord(w[-1])] for w in texts]
        self.known.add(h[rows], sizes + mark, out)
        rows = np.flatnonzero(~plain)
        self.known.add(h[rows], *self._others(words.take(pa.array(rows)).to_pylist()))

    def _known(self, words: pa.LargeStringArray) -> np.ndarray:
        """Numbers of distinct words among the known ones; unknown ones are learned."""
        if self.known.n > CACHE:  # words not seen since the last such moment go
            self.older, self.known = self.known, Words(self.kind)
        h, sizes = word_hashes(words)
        new = np.flatnonzero(self.known.find(h) < 0)
        if len(new) and self.older.n:
            old = self.older.find(h[new])
            have = old >= 0
            self.known.add(h[new[have]], *self.older.gather(old[have]))
            new = new[~have]
        if len(new):
            self._learn(words.take(pa.array(new)), h[new])
        return self.known.find(h)

    def encode(self, texts: list[str], column: pa.Array | None = None) -> list[bytes]:
        """Ids of texts (``column``: the same texts, if they come from Arrow).

        Words are split and numbered by Arrow's kernels; only a batch's distinct ones are looked up, and their ids gathered in arrays.
        Texts with what those kernels would split otherwise, or with a word of over ``LONG`` bytes, are encoded whole.
        """
        odd = [bool(_ODD.search(t)) for t in texts]
        if column is None or any(odd):
            column = pa.array(["" if o else t for t, o in zip(texts, odd)], pa.large_string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
        words = lists.values.dictionary_encode()
        names, at, ends = words.dictionary, words.indices.to_numpy(), lists.offsets.to_numpy()
        large = np.flatnonzero(pc.binary_length(names).to_numpy() > LONG)
        if len(large):
            where = np.searchsorted(ends, np.flatnonzero(np.isin(at, large)), side="right") - 1
            for i in set(where.tolist()):
                odd[i] = True
            return self.encode_some(texts, odd)
        sizes, out = self.known_ids(names, at)
        cuts = np.concatenate(([0], np.cumsum(sizes)))[ends]
        return [self._whole(t).tobytes() if o else out[a:b].tobytes() for t, o, a, b in zip(texts, odd, cuts.tolist(), cuts[1:].tolist())]

    def encode_some(self, texts: list[str], odd: list[bool]) -> list[bytes]:
        """Texts with the marked ones encoded whole."""
        rest = iter(self.encode([t for t, o in zip(texts, odd) if not o]) if not all(odd) else [])
        return [self._whole(t).tobytes() if o else next(rest) for t, o in zip(texts, odd)]

    def known_ids(self, names: pa.LargeStringArray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, 32-bit ids) of words given by their numbers among ``names``."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        which = self._known(names)  # may turn the memory over
        sizes, ids = self.known.gather(which[at])
        return sizes, ids.astype("<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of ``batches`` (key, text) in order, in tables of at most ``CHUNK`` bytes of text (and 16 a row), whatever the size of a batch; a longer text stands alone."""
    held, size = [], 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().astype(np.int64) + 16
        ends, at = np.cumsum(sizes), 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, before + CHUNK - size, side="right"))
            if to <= at and held:  # no room for the next text
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(b.slice(at, to - at))
            size, at = size + int(ends[to - 1]) - before, to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, wide = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for part in lots(batches):
            yield cut_up(part, enc, end, wide)
        pa.default_memory_pool().release_unused()

    def cut_up(part: pa.Table, enc: Encoder, end: bytes, wide: int) -> pa.RecordBatch:
        take, piece, start, length, crc = [], [], [], [], []
        column = pc.fill_null(part.column(1), "").cast(pa.large_string()).combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        for i, ids in enumerate(enc.encode(column.to_pylist(), column)):
            ids += end
            for n, a in enumerate(range(0, len(ids), wide)):
                own = ids[a : a + wide]
                take.append(i)
                piece.append(n)
                start.append(a // 4)
                length.append(len(own) // 4)
                crc.append(zlib.crc32(own))
        keys = part.column(0).take(pa.array(take, pa.int64())).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            names=["k", "piece", "start", "length", "ids_crc32"],
        )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("k", key)


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        v = np.where(sizes <= c, best[np.maximum(c - sizes, 0)] + values, -1.0)
        g = int(v.argmax())
        if v[g] > best[c - 1]:
            best[c], pick[c] = v[g], g
        else:
            best[c] = best[c - 1]
    out = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[float, np.ndarray]]:
    """(multiple, configuration) of a linear cutting-stock solution by column generation."""
    n = len(sizes)
    if not n:
        return []
    columns = [np.where(np.arange(n) == g, capacity // sizes[g], 0).astype(float) for g in range(n)]
    inverse = np.diag([1.0 / c[g] for g, c in enumerate(columns)])
    x = inverse @ demand
    for _ in range(rounds):
        value, column = _knapsack(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-3:
            break
        d = inverse @ column
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        if not np.isfinite(step):
            break
        x = x - step * d
        x[r] = step
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
        columns[r] = column
    return [(float(a), c) for a, c in zip(x, columns) if a > 0]


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (number of sequences, lengths in each) that hold exactly ``counts[length]`` pieces of each length."""
    left = np.array(counts, dtype=np.int64)
    runs: list[tuple[int, tuple[int, ...], int]] = []
    if left[capacity]:
        runs.append((int(left[capacity]), (capacity,), 0))
        left[capacity] = 0
    large = int(left[small + 1 :].sum())
    if large:
        # 1. groups of equal cardinality, longest first; each keeps its actual lengths as (length, count)
        each = -(-large // groups)
        queues: list[list[list[int]]] = [[]]
        room = each
        for length in range(capacity - 1, small, -1):
            n = int(left[length])
            while n:
                take = min(n, room)
                queues[-1].append([length, take])
                n, room = n - take, room - take
                if not room:
                    queues.append([])
                    room = each
        queues = [q for q in queues if q]
        merged: list[list[list[int]]] = []
        for q in queues:  # groups rounded up to the same size are one size
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1] += q
            else:
                merged.append(q)
        sizes = np.array([q[0][0] for q in merged], dtype=np.int64)
        demand = np.array([sum(n for _, n in q) for q in merged], dtype=float)
        # 2. and 3. whole multiples of each configuration, filled with actual lengths
        for multiple, config in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(sizes)) for _ in range(int(config[g]))]
            m = int(multiple + 1e-9)
            for g in set(slots):
                m = min(m, sum(n for _, n in merged[g]) // slots.count(g))
            if m <= 0:
                continue
            parts = []
            for g in slots:
                got, need = [], m
                while need:
                    head = merged[g][0]
                    t = min(need, head[1])
                    got.append((head[0], t))
                    left[head[0]] -= t
                    head[1] -= t
                    need -= t
                    if not head[1]:
                        merged[g].pop(0)
                parts.append(got)
            ends = sorted({e for got in parts for e in np.cumsum([t for _, t in got]).tolist()})
            at, where = 0, [0] * len(parts)
            inner = [0] * len(parts)
            for e in ends:
                lens = tuple(got[where[j]][0] for j, got in enumerate(parts))
                runs.append((e - at, lens, capacity - sum(lens)))
                for j, got in enumerate(parts):
                    inner[j] += e - at
                    if inner[j] == got[where[j]][1]:
                        where[j], inner[j] = where[j] + 1, 0
                at = e
    # 4. the rest best-fit, longest first
    runs = best_fit(left, runs, capacity)
    # 5. sequences that stay short are taken apart and best-fitted anew, if that saves any
    best = runs
    for slack in (1, 4, 16, 64):
        again = np.zeros(capacity + 1, dtype=np.int64)
        for n, lens, s in runs:
            if s >= slack:
                np.add.at(again, list(lens), n)
        trial = [x for x in runs if x[2] < slack] + best_fit(again, [], capacity)
        if sum(x[0] for x in trial) < sum(x[0] for x in best):
            best = trial
    return [(n, lens) for n, lens, _ in best]


def best_fit(counts: np.ndarray, runs: list[tuple[int, tuple[int, ...], int]], capacity: int) -> list[tuple[int, tuple[int, ...], int]]:
    """``runs`` (number, lengths, slack) with ``counts[length]`` more pieces, longest first, each where the least room is left."""
    by: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for n, lens, slack in runs:
        by[slack].append((n, lens))
    for length in range(capacity, 0, -1):
        n, s = int(counts[length]), length
        while n:
            while s <= capacity and not by[s]:
                s += 1
            if s > capacity:
                per = capacity // length
                full, rest = divmod(n, per)
                if full:
                    by[capacity - per * length].append((full, (length,) * per))
                if rest:
                    by[capacity - rest * length].append((1, (length,) * rest))
                break
            have, lens = by[s].pop()
            t = min(have, n)
            if t < have:
                by[s].append((have - t, lens))
            by[s - length].append((t, (*lens, length)))
            n -= t
            if s - length >= length:
                s = length
    return [(n, lens, s) for s, found in enumerate(by) for n, lens in found]


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For each length, ranges of its numbers: (length, first number, first sequence, offset), sorted."""
    nexts: dict[int, int] = {}
    out, sequence = [], 0
    for n, lens in runs:
        offset = 0
        for length in lens:
            first = nexts.get(length, 0)
            out.append((length, first, sequence, offset))
            nexts[length] = first + n
            offset += length
        sequence += n
    a = np.array(sorted(out), dtype=np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "first": a[:, 1], "sequence": a[:, 2], "offset": a[:, 3]}


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = cut(pieces(docs, tokenizer, key, text, capacity, end_id), "pieces")
    n = cut_up.count()
    lots = max(16, min(n // 200_000, 65_536))  # of one length, which may hold any share of all pieces
    rows = cut_up.withColumn("lot", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(lots)))
    sizes = cut(rows.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n")), "sizes")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, total in sizes.groupBy("length").agg(F.sum("n")).collect():  # one row a length: at most ``capacity``
        counts[length] = total
    table = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "lot").orderBy(key, "piece", "start", "ids_crc32")
    rows = rows.withColumn("own", F.row_number().over(own)).join(starts, ["length", "lot"])
    rows = rows.select(key, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a length's ranges stand together: the range is found among (length, first number) pairs
        span = int(table["first"].max()) + 1 if len(table["first"]) else 1
        keys = table["length"] * span + table["first"]
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            sequence = table["sequence"][at] + rank - table["first"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], names=["k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)

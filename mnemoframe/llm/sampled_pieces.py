"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's segmentations into pieces of a vocabulary are the paths of a lattice;
each has a probability in proportion to the product of its pieces' weights.
Gumbel top-k draws k distinct ones: give every path its log probability plus
Gumbel noise and take the k largest.  This is done without listing paths, by A*
from the root (all paths): the largest perturbed value of a set of paths is a
Gumbel variable at the log of the set's mass, so a set is split into the branch
that holds the largest value and the rest, whose largest value is a Gumbel
variable cut off at the parent's (Kool, van Hoof and Welling 2019).

No piece crosses from a word to the blank before the next, so the lattice is a
chain of word lattices.  A branch point is a word: the paths that agree with a
sample before it and differ in it are one set.  Inside a word, the branch is
drawn backwards through the word's own lattice (forward sums, then sampling).
All words and documents of a batch are drawn together in arrays; each draw is a
hash of (row key, seed, sample, word, step), so it depends on the row alone.

Weights: a BPE vocabulary has ranks instead of probabilities; the weight of rank
r is (r + 2.7) ** -alpha.  Characters without a piece fall back to their bytes.

Defined results: a null or empty text has the one segmentation of a lone blank,
as the tokenizer adds one in front; texts with fewer than k segmentations give
fewer rows, however improbable the others are: the mass beside a path is summed
from what branches off it, never as one less the path's own; of equal perturbed
values the earlier sample's, then the earlier word's wins; repeated rows repeat
their samples; an empty table gives an empty result; other columns pass unread.  A text's words are held at once, so memory follows the longest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import count
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import bounded_batches
from mnemoframe.llm.rolling import prefix_sums, window

BLANK = "▁"
MAX_PIECE = 16
#: Words drawn together.
BATCH_WORDS = 100_000
#: Lattice states that a worker keeps (200 bytes each).
KEEP = 1_400_000
_UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Blanks that meet, and characters that stand for blanks and separators.
_IRREGULAR = re.compile(f"  |{BLANK}|\0|^ |\n ")
_U64 = np.uint64


class Vocabulary:
    """Pieces by hash, with ids and weights."""

    def __init__(self, path: str, alpha: float = 0.5):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {i: sp.id_to_piece(i) for i in normal if len(sp.id_to_piece(i)) <= MAX_PIECE}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.unknown = sp.unk_id()
        self.blob: np.ndarray | None = None
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in self.pieces.values()):
            raise ValueError("a piece crosses a word's end")
        weight = lambda r: (r + 2.7) ** -alpha
        self.byte_weight = float(weight(n))
        ids = np.array(list(self.pieces), np.int32)
        keys = np.array([window(s := prefix_sums(_codes(p)), np.zeros(1, int), np.array([len(s) - 1]))[0] for p in self.pieces.values()], _U64)
        self.keys, self.ids = keys, ids
        self.weights = np.array([weight(max(0.0, -sp.get_score(int(i)))) for i in ids], np.float32)
        # two slots for each hash prefix; a third piece of one prefix would go to the list that is searched
        slot = (keys >> _U64(44)).astype(np.int64)
        self.slots = np.full((2, 1 << 20), -1, np.int32)
        self.more: list[int] = []
        for j, s in enumerate(slot.tolist()):
            if self.slots[0, s] < 0:
                self.slots[0, s] = j
            elif self.slots[1, s] < 0:
                self.slots[1, s] = j
            else:
                self.more.append(j)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash's piece, or -1."""
        slot = (h >> _U64(44)).astype(np.int64)
        j = self.slots[0][slot]
        j[(j >= 0) & (self.keys[j] != h)] = -1
        some = np.flatnonzero(j < 0)
        k = self.slots[1][slot[some]]
        ok = (k >= 0) & (self.keys[k] == h[some])
        j[some[ok]] = k[ok]
        for m in self.more:
            j[h == self.keys[m]] = m
        return j

    def raw(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ``ids`` stand for, gathered from one run of all pieces' bytes."""
        if self.blob is None:
            n = max(*self.pieces, *self.byte_of) + 1
            texts = [self.pieces[i].replace(BLANK, " ").encode() if i in self.pieces else bytes([self.byte_of[i]]) if i in self.byte_of else b"" for i in range(n)]
            self.blob = np.frombuffer(b"".join(texts), np.uint8)
            self.sizes = np.fromiter(map(len, texts), np.int64, n)
            self.starts = np.cumsum(self.sizes) - self.sizes
        each = self.sizes[ids]
        ends = np.cumsum(each)
        return self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - each), each)]

    def text(self, ids: np.ndarray) -> str:
        """The text that ``ids`` stand for, without the blank that the tokenizer puts in front."""
        out = self.raw(ids).tobytes().decode(errors="replace")
        return out[1:] if out.startswith(" ") else out

    def decode(self, ids: list[int]) -> str:
        return self.text(np.array(ids, np.int64))


_vocabularies: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str, alpha: float = 0.5) -> Vocabulary:
    if (path, alpha) not in _vocabularies:
        _vocabularies[path, alpha] = Vocabulary(path, alpha)
    return _vocabularies[path, alpha]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def units(text: str) -> list[str]:
    """The words of a text, each with the blanks before it."""
    return _UNIT.findall(BLANK + text.replace(" ", BLANK))


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in order, words of each text).

    Texts with single blanks are split by Arrow's kernels; others, whose runs of blanks are words' beginnings, by the pattern.
    """
    plain = [not _IRREGULAR.search(t) for t in texts]
    column = pa.array(texts if all(plain) else [t if p else "" for t, p in zip(texts, plain)], pa.large_string())
    column = pc.binary_join_element_wise(pa.scalar(BLANK, pa.large_string()), column, pa.scalar("", pa.large_string()))
    column = pc.replace_substring(pc.replace_substring(column, "\n", "\0\n\0"), " ", "\0" + BLANK)
    lists = pc.split_pattern(column, "\0")
    offsets, values = lists.offsets.to_numpy(), lists.values
    if not all(plain):
        parts, sizes = [], np.diff(offsets)
        for i, (t, p) in enumerate(zip(texts, plain)):
            parts.append(values.slice(int(offsets[i]), int(sizes[i])) if p else pa.array(units(t), pa.large_string()))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        values = pa.concat_arrays(parts)
    words = values.dictionary_encode()
    names, at = words.dictionary.to_pylist(), words.indices.to_numpy()
    if "" in names:  # between separators
        none = names.index("")
        there = at != none
        offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
        at = at[there]
        at = at - (at > none)
        names.pop(none)
    return names, at, np.diff(offsets)


class Store:
    """The lattices of the words that a worker knows.

    States are positions in words.  A state's row of ``prob`` holds, for 1 to 16 characters back, the probability
    of that last step given the state; ``upto`` its running sums, ``low`` the sum of all but the largest, ``piece`` the
    pieces, ``codes`` the character before the state.  The first words, up to ``KEEP`` states, stay; those of a batch beyond that go with it.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.names: dict[str, int] = {}
        self.states = 0
        self.prob = np.zeros((0, MAX_PIECE), np.float32)
        self.upto = np.zeros((0, MAX_PIECE), np.float32)
        self.piece = np.zeros((0, MAX_PIECE), np.int32)
        self.codes = np.zeros(0, np.uint32)
        self.low = np.zeros(0, np.float32)
        self.first = self.last = np.zeros(0, np.int64)

    def load(self, words: list[str]) -> list[str]:
        """Make the lattices of ``words``, all different, available; returns those to be dropped after the batch."""
        fresh = [w for w in words if w not in self.names]
        if not fresh:
            return []
        n, u = self.states, len(self.names)
        x = _codes("".join(fresh))
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        end = n + len(x) + len(fresh)
        for name in ("prob", "upto", "piece", "codes", "low"):
            have = getattr(self, name)
            if len(have) < end:
                grown = np.empty((max(end, min(2 * len(have), KEEP)), *have.shape[1:]), have.dtype)
                grown[:n] = have[:n]
                setattr(self, name, grown)
        first = np.cumsum(sizes) - sizes + np.arange(len(fresh))
        self._fill(slice(n, end), x, sizes, first)
        self.first = np.concatenate((self.first[:u], first + n))
        self.last = np.concatenate((self.last[:u], first + sizes + n))
        self.names.update(zip(fresh, count(u)))
        if end <= KEEP:
            self.states = end
            return []
        return fresh

    def drop(self, words: list[str]) -> None:
        for w in words:
            del self.names[w]

    def _fill(self, at_states: slice, x: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> None:
        """Enter the edges of new words, characters ``x``, and turn their weights into probabilities."""
        vocab, prob, piece, codes = self.vocab, self.prob[at_states], self.piece[at_states], self.codes[at_states]
        prob.fill(0)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        stop = np.repeat(np.cumsum(sizes), sizes)
        codes[np.arange(len(x)) + unit + 1] = x
        sums, at = prefix_sums(x), np.arange(len(x))
        for size in range(1, MAX_PIECE + 1):
            at = at[at + size <= stop[at]]
            if not len(at):
                break
            j = vocab.find(window(sums, at, at + size))
            hit = np.flatnonzero(j >= 0)
            from_ = at[hit]
            end = from_ + unit[from_] + size
            prob[end, size - 1] = vocab.weights[j[hit]]
            piece[end, size - 1] = vocab.ids[j[hit]]
            if size == 1 and len(hit) < len(at):
                # bytes instead: one step of as many ids as the character has bytes (-2 stands for more than one)
                from_ = at[j < 0]
                c, end = x[from_], from_ + unit[from_] + 1
                n = 1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)
                prob[end, 0] = vocab.byte_weight**n
                piece[end, 0] = np.where(n == 1, np.array(vocab.bytes, np.int32)[np.minimum(c, 127)], -2)
        # forward sums, brought back to the order of one in long words
        alpha = np.zeros(len(prob))
        alpha[first] = 1
        order = np.argsort(-sizes, kind="stable")
        head, longest = first[order], sizes[order]
        back = np.arange(1, MAX_PIECE + 1)
        for t in range(1, int(sizes.max(initial=0)) + 1):
            at = head[: np.searchsorted(-longest, -t, side="right")] + t
            k = min(t, MAX_PIECE)
            step = prob[at, :k] * alpha[at[:, None] - back[:k]]
            total = step.sum(axis=1)
            alpha[at] = total
            step /= total[:, None]
            prob[at, :k] = step
            if t % 32 == 0:
                alpha[at[:, None] - np.arange(MAX_PIECE)] /= total[:, None]
        rows = np.arange(len(prob))
        best = prob.argmax(axis=1)
        top = prob[rows, best]
        prob[rows, best] = 0
        self.low[at_states] = prob.sum(axis=1)
        prob[rows, best] = top
        upto = self.upto[at_states]
        upto[:, 0] = prob[:, 0]
        for j in range(1, MAX_PIECE):
            np.add(upto[:, j - 1], prob[:, j], out=upto[:, j])


_stores: dict[int, Store] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _uniform(key: np.ndarray, word: np.ndarray, sample: int, step: int) -> np.ndarray:
    """Numbers in (0, 1), one for each row key, word, sample and step."""
    salt = _U64((sample * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & (2**64 - 1))
    x = _mix(key ^ (word.astype(_U64) * _U64(0xD1342543DE82EF95) + salt))
    return ((x >> _U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform_one(key: int, word: int, sample: int, step: int) -> float:
    """The same for a single draw."""
    m = 2**64 - 1
    salt = (sample * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & m
    x = key ^ ((word * 0xD1342543DE82EF95 + salt) & m)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    x ^= x >> 31
    return ((x >> 11) + 0.5) / (1 << 53)


class _Paths:
    """A sample of every document: for each word, its steps in reading order."""

    def __init__(self, n: int):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
        self.n = n
        self.logp = np.zeros(n)
        #: Mass of the other paths of each word.
        self.other = np.zeros(n)

    def add(self, word: np.ndarray, state: np.ndarray, size: np.ndarray, step: int) -> None:
        self.parts.append((word, state, size, step))

    def close(self) -> _Paths:
        word = np.concatenate([p[0] for p in self.parts])
        self.steps = np.bincount(word, minlength=self.n)
        self.ends = np.cumsum(self.steps)
        at = np.concatenate([self.ends[p[0]] - 1 - p[3] for p in self.parts])
        self.state = np.empty(len(at), np.int64)
        self.size = np.empty(len(at), np.int64)
        self.state[at] = np.concatenate([p[1] for p in self.parts])
        self.size[at] = np.concatenate([p[2] for p in self.parts])
        self.parts = []
        return self

    def of(self, word: int) -> tuple[int, ...]:
        """Sizes of a word's steps, last first."""
        return tuple(self.size[self.ends[word] - self.steps[word] : self.ends[word]][::-1].tolist())


def _draw(lat: Store, kind: np.ndarray, key: np.ndarray, index: np.ndarray, words: np.ndarray, sample: int, into: _Paths) -> None:
    """Draw a path for each of ``words``."""
    state, first = lat.last[kind[words]], lat.first[kind[words]]
    step = 0
    while len(words):
        u = _uniform(key[words], index[words], sample, step).astype(np.float32)
        rows = lat.upto[state]
        size = (rows >= (u * rows[:, -1])[:, None]).argmax(axis=1)
        p = lat.prob[state, size]
        if len(off := np.flatnonzero(p <= 0)):  # sums that rounding has put out of order
            size[off] = lat.prob[state[off]].argmax(axis=1)
            p = lat.prob[state, size]
        beside = np.where(p >= 0.5, lat.low[state], 1 - p).astype(np.float64)
        so_far = into.logp[words]
        into.other[words] += np.exp(so_far) * beside
        into.logp[words] = so_far + np.log(p)
        into.add(words, state, size + 1, step)
        state = state - size - 1
        on = state > first
        words, state, first, step = words[on], state[on], first[on], step + 1


class _Others:
    """The paths of one word but those in ``never``, and their mass at every beginning that these share: sums only, no differences.

    Paths are sizes of steps, last first.  The beginnings are the nodes of a tree, level by level; a word may be as long as a text.
    """

    def __init__(self, lat: Store, unit: int, never: list[tuple[int, ...]]):
        self.lat, self.state, self.first = lat, int(lat.last[unit]), int(lat.first[unit])
        #: For each node its state, and the node behind each step that a path takes from it.
        self.nodes: list[tuple[int, dict[int, int]]] = []
        live = [(self.state, never)] if never else []
        depth, behind = 0, len(live)
        while live:
            following = []
            for state, paths in live:
                after: dict[int, int] = {}
                if state > self.first:
                    for size in sorted({x[depth] for x in paths}):
                        after[size] = behind
                        behind += 1
                        following.append((state - size, [x for x in paths if x[depth] == size]))
                self.nodes.append((state, after))
            live, depth = following, depth + 1
        self.masses = [0.0] * len(self.nodes)
        for i in range(len(self.nodes) - 1, -1, -1):
            state, after = self.nodes[i]
            if after:
                p = lat.prob[state].astype(np.float64)
                total = 0.0
                for size, node in after.items():
                    total += p[size - 1] * self.masses[node]
                    p[size - 1] = 0
                self.masses[i] = total + float(p.sum())

    def mass(self) -> float:
        return self.masses[0]

    def draw(self, draws: Iterator[float]) -> list[tuple[int, int]] | None:
        """(state, size) steps of one of these paths, last first; None if there is none."""
        state, node, out = self.state, 0, []
        while state > self.first:
            w = self.lat.prob[state].astype(np.float64)
            after = self.nodes[node][1] if node is not None else {}
            for size, x in after.items():
                w[size - 1] *= self.masses[x]
            c = np.cumsum(w)
            if not c[-1] > 0:
                return None
            size = int(np.searchsorted(c, next(draws) * c[-1], side="right")) + 1
            out.append((state, size))
            state, node = state - size, after.get(size)
        return out


def sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary, k: int = 2) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text up to k distinct segmentations: (perturbed value, log probability, log inclusion probability, ids), best first.

    The inclusion probability is that of a segmentation being among the k, given the (k+1)-th perturbed value.
    """
    names, at, sizes = numbered(texts)
    lat = _stores.setdefault(id(vocab), Store(vocab))
    passing = lat.load(names)
    kind = np.fromiter(map(lat.names.__getitem__, names), np.int64, len(names))[at]
    try:
        return _sample(lat, sizes, kind, keys, vocab, k)
    finally:
        lat.drop(passing)


def _sample(lat: Store, sizes: np.ndarray, kind: np.ndarray, keys: np.ndarray, vocab: Vocabulary, k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    docs = len(sizes)
    doc = np.repeat(np.arange(docs), sizes)
    starts = np.cumsum(sizes) - sizes
    index, key = np.arange(len(kind)) - starts[doc], keys[doc]
    n, everything = len(kind), np.arange(len(kind))
    safe_log = lambda x: np.log(np.maximum(x, 1e-300))
    root = -np.log(-np.log(_uniform(keys, np.zeros(len(keys)), 0, 1 << 20)))
    now = _Paths(n)
    _draw(lat, kind, key, index, everything, 0, now)
    paths, values = [now.close()], [root]
    fronts: list[np.ndarray] = []
    never: list[dict[int, list]] = [{}]
    branch = [np.full(docs, -1)]
    alive = [np.ones(docs, bool)]
    bound = np.full(docs, -np.inf)
    for s in range(k):
        # the sets of paths that leave the newest sample at each word at or after its own branch point
        p = paths[s]
        before = np.cumsum(p.logp) - p.logp
        before -= before[starts][doc]
        rest = p.other
        for d, out in never[s].items():
            w = starts[d] + branch[s][d]
            rest[w] = _Others(lat, int(kind[w]), list({*out, p.of(w)})).mass()
        open_ = (rest > 0) & (index >= branch[s][doc]) & alive[s][doc]
        g, mass = values[s][doc], before + safe_log(rest)
        with np.errstate(over="ignore", invalid="ignore"):
            v = mass - safe_log(np.exp(np.minimum(mass - g, 700)) - safe_log(_uniform(key, index, s, 1 << 21)))
        fronts.append(np.where(open_, np.minimum(v, g), -np.inf))
        best = np.stack([np.maximum.reduceat(f, starts) for f in fronts])
        source = best.argmax(axis=0)
        top = best[source, np.arange(docs)]
        if s == k - 1:
            bound = top
            break
        new = _Paths(n)
        at, ok, excluded = np.full(docs, -1), np.isfinite(top), {}
        turns: dict[int, list[tuple[int, int, int]]] = {}
        for d in np.flatnonzero(ok).tolist():
            a, b = starts[d], starts[d] + sizes[d]
            src = int(source[d])
            w = a + int(fronts[src][a:b].argmax())
            out = [paths[src].of(w)]
            if w - a == branch[src][d]:
                out += never[src].get(d, [])
            draws = (_uniform_one(int(keys[d]), int(w - a), s + 1, (1 << 22) + i) for i in count())
            got = _Others(lat, int(kind[w]), out).draw(draws)
            fronts[src][w] = -np.inf
            if got is None:
                ok[d] = False
                continue
            at[d], excluded[d] = w - a, out
            for i, step in enumerate(got):
                turns.setdefault(i, []).append((w, *step))
            new.logp[w] = sum(log(float(lat.prob[state, size - 1])) for state, size in got)
        for i, steps in turns.items():
            new.add(*np.array(steps, dtype=np.int64).T, i)
        # words before the branch point are the source's, those after it are drawn afresh
        for src in range(s + 1):
            old = (source == src) & ok
            take = np.flatnonzero(old[doc] & (index < at[doc]))
            if len(take):
                q = paths[src]
                new.logp[take] = q.logp[take]
                new.other[take] = q.other[take]
                reach = np.repeat(take, q.steps[take])
                pos = np.arange(len(reach)) - np.repeat(np.cumsum(q.steps[take]) - q.steps[take], q.steps[take])
                where = q.ends[reach] - 1 - pos
                for i in range(int(pos.max(initial=-1)) + 1):
                    m = pos == i
                    new.add(reach[m], q.state[where[m]], q.size[where[m]], i)
        later = np.flatnonzero(ok[doc] & (index > at[doc]))
        _draw(lat, kind, key, index, later, s + 1, new)
        paths.append(new.close() if new.parts else new)
        if not len(getattr(new, "steps", ())):
            new.steps = new.ends = np.zeros(n, np.int64)
            new.state = new.size = np.zeros(0, np.int64)
        values.append(np.where(ok, top, -np.inf))
        never.append(excluded)
        branch.append(at)
        alive.append(ok)
    out: list[list[tuple[float, float, float, np.ndarray]]] = [[] for _ in range(docs)]
    for s, p in enumerate(paths):
        ids = lat.piece[p.state, p.size - 1]
        wide = np.flatnonzero(ids == -2)
        totals = np.add.reduceat(p.logp, starts)
        ends = np.concatenate(([0], p.ends))
        for d in np.flatnonzero(alive[s]).tolist():
            a, b = int(ends[starts[d]]), int(ends[starts[d] + sizes[d]])
            own = ids[a:b]
            if len(wide) and np.searchsorted(wide, a) < np.searchsorted(wide, b):
                own = np.concatenate([[i] if i != -2 else [vocab.bytes[x] for x in chr(c).encode("utf-8", "surrogatepass")] for i, c in zip(own.tolist(), lat.codes[p.state[a:b]].tolist())])
            out[d].append((float(values[s][d]), float(totals[d]), _log_inclusion(float(totals[d]), float(bound[d])), own))
    return out


def _log_inclusion(logp: float, bound: float) -> float:
    """Log of the probability that a path's perturbed value exceeds ``bound``; of a long text's path it is far below what a double holds."""
    if bound == -np.inf:
        return 0.0
    x = logp - bound
    return x if x < -30 else float(np.log(-np.expm1(-exp(min(x, 700.0)))))


def sampled(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = 2, alpha: float = 0.5, seed: int = 0, with_ids: bool = True, with_check: bool = False) -> DataFrame:
    """Per row and sample: key, sample (1 is best), n_pieces, ids_crc32, log_prob, gumbel, log_inclusion and, if asked for, ids (little-endian unsigned 32-bit, as bytes) and round_trip (whether the ids decode to the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            keys = _mix(b.column(1).to_numpy().astype(np.int64).view(_U64) + _U64(seed))
            words, at = 0, 0
            for i, t in enumerate(texts):
                words += t.count(" ") + 1
                if words >= BATCH_WORDS or i == len(texts) - 1:
                    yield batch(b.column(0).slice(at, i + 1 - at), texts[at : i + 1], sample(texts[at : i + 1], keys[at : i + 1], vocab, k), vocab)
                    words, at = 0, i + 1

    def batch(ids: pa.Array, texts: list[str], found: list, vocab: Vocabulary) -> pa.RecordBatch:
        rows = [(d, n + 1, len(x[3]), zlib.crc32(raw := x[3].astype("<u4").tobytes()), x[1], x[0], x[2], raw) for d, own in enumerate(found) for n, x in enumerate(own)]
        cols = list(zip(*rows)) or [[]] * 8
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        arrays = [ids.take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:7], kinds[1:]))]
        names = ["k", "sample", "n_pieces", "ids_crc32", "log_prob", "gumbel", "log_inclusion"]
        if with_ids:
            arrays.append(pa.array(cols[7], pa.binary()))
            names.append("ids")
        if with_check:
            arrays.append(pa.array([vocab.text(x[3]) == t for t, own in zip(texts, found) for x in own], pa.bool_()))
            names.append("round_trip")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, sample int, n_pieces long, ids_crc32 long, log_prob double, gumbel double, log_inclusion double" + ", ids binary" * with_ids + ", round_trip boolean" * with_check
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("h"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def decoded(rows: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the column ``out``: the text that the ids (little-endian unsigned 32-bit, as bytes) stand for; null for null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(model)
        for b in batches:
            yield pd.Series([vocab.text(np.frombuffer(x, "<u4")) if x is not None else None for x in b], dtype=object)

    return rows.withColumn(out, F.pandas_udf(run, "string")(F.col(ids)))

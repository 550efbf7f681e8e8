import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from mnemoframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_whole_texts(spark, small):
    tok, enc = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts += ["", "Don't I'LL, stop. a\x1cb\u00a0c x<|endoftext|>y \0 a\0b", "İSTANBUL ΣΑΣ Σ ǅ ß ÉÀ é.", "12,5 a1b2 ..,; ab,. 'tis", "﻿x\u200by\u2028z 日本語 𝒳"]
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at:], enc.encode(texts[at : at + 50])):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_words_are_forgotten_and_learned_again(monkeypatch):
    """Random words of many scripts, long ones, and a memory of a few words: always the ids of the whole text."""
    monkeypatch.setattr(packing, "CACHE", 50)
    tok, enc, rng = Tokenizer.from_file(PATH), packing.Encoder(PATH), np.random.default_rng(3)
    letters = "aAbßéÉÑçñz.,;:!?'-0٣अ日𝒳\u0301\u0130"
    words = ["".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(400)] + ["x" * 49, "é" * 24, "é" * 25 + ",", "y" * 5000]
    for _ in range(40):
        texts = [" ".join(rng.choice(words, 12)) for _ in range(5)] + [""]
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
    assert enc.encode([]) == [] and enc.encode(["", " "]) == [b"", b""]


def test_plan_holds_all_and_wastes_little():
    rng = np.random.default_rng(1)
    for counts in (rng.poisson(40, 2049), rng.integers(0, 2, 2049), np.eye(2049, dtype=int)[700] * 1000, np.bincount(rng.integers(500, 1400, 3000), minlength=2049)):
        counts = counts.copy()
        counts[0] = 0
        runs = packing.plan(counts)
        held = np.zeros(2049, dtype=int)
        for n, lens in runs:
            assert n > 0 and sum(lens) <= 2048
            np.add.at(held, list(lens), n)
        assert (held == counts).all()
        fit = packing.best_fit(counts, [], 2048)
        assert sum(n for n, _ in runs) <= 1.02 * sum(x[0] for x in fit) + 1
    assert packing.plan(np.zeros(2049, dtype=int)) == []


def check(rows, texts):
    tok = Tokenizer.from_file(PATH)
    whole, places = {}, {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, own in whole.items():
        ids = np.array([*tok.encode(texts[k] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        copies = len(own) // -(-len(ids) // 2048)
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == sorted(
            (n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048)) for _ in range(copies)
        )
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(whole) == set(texts)
    return len(places)


def test_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "a"), (4, "a"), (None, "b c")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int")
    got = packing.pack(docs, PATH).collect()
    assert check(got, dict(rows)) == 3
    assert len(got) == 5 + 3
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_memory_does_not_follow_the_batch(spark, monkeypatch):
    """One batch of 30 MB of long texts: a worker holds parts of it, and the pieces are those of the whole."""
    rng = np.random.default_rng(5)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefgh"), (3_000, 6))])
    texts = [" ".join(rng.choice(words, 4_300)) for _ in range(1_000)]
    texts[3:7] = [None, "", " ", "word " * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000)), pa.array(texts)], names=["k", "t"])
    frame, work = spark.createDataFrame([], "doc_id long, text string"), []
    with monkeypatch.context() as m:
        m.setattr(type(frame), "mapInArrow", lambda df, run, schema: work.append(run) or df)
        packing.pieces(frame, PATH)
    packing.encoder(PATH).encode(texts[:3])
    tracemalloc.start()
    rows = [row for out in work[0](iter([batch.slice(0, 0), batch])) for row in zip(*[out.column(i).to_pylist() for i in (0, 3)])]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 100 << 20, peak >> 20
    lengths = np.bincount(*np.array(rows).T)
    assert [k for k, _ in rows] == sorted(k for k, _ in rows) and lengths[[3, 4, 5]].tolist() == [1, 1, 1]
    tok = Tokenizer.from_file(PATH)
    for k in (0, 2, 6, 7, 500, 999):
        assert lengths[k] == len(tok.encode(texts[k], add_special_tokens=False).ids) + 1


def test_known_words_need_few_bytes(monkeypatch):
    """The table doubles as words come, so that a word needs no more than 85 bytes right after it has grown."""
    rng, words = np.random.default_rng(7), packing.Words(np.uint16)
    for _ in range(54):
        h = rng.integers(1, 1 << 63, 10_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        words.add(h, np.full(10_000, 3), np.arange(30_000).astype(np.uint16))
        sizes, ids = words.gather(words.find(h))
        assert (sizes == 3).all() and (ids == np.arange(30_000)).all()
    held = sum(x.nbytes for x in (words.table, words.which, words.starts, words.ids))
    assert held < 85 * words.n, held / words.n


def test_lots_keep_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 100)
    texts = [None, "", "a" * 90, "b" * 300, "é" * 20, *[""] * 50, "c" * 84, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"])
    for cuts in ([0, len(texts)], [0, 0, 1, 4, 4, 30, len(texts)]):
        parts = list(packing.lots(iter([batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])])))
        assert [(r["k"], r["t"]) for part in parts for r in part.to_pylist()] == list(enumerate(texts))
        assert all(part.num_rows == 1 or sum(16 + len((t or "").encode()) for t in part.column(1).to_pylist()) <= 100 for part in parts)
    assert list(packing.lots(iter([]))) == []

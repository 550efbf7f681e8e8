import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoframe.llm import harmonic

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_sizes_and_cuts():
    sizes = harmonic.class_sizes(2048)
    assert sizes[0] == 1 and sizes[-1] == 2048 and set(sizes.tolist()) == {2048 // k for k in range(1, 2049)}
    for n in [1, 2, 67, 1365, 2047, 2048, 2049, 10_000]:
        own = harmonic.cuts(n, sizes)
        assert sum(own) == n and set(own) <= set(sizes.tolist()) and own == sorted(own, reverse=True)
    assert np.mean([len(harmonic.cuts(n, sizes)) for n in range(1, 2049)]) < 4


def check(rows, texts, capacity=2048):
    """Every id of every document once and in place, sequences without gaps; the padding."""
    tok = Tokenizer.from_file(PATH)
    docs, places = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(texts)
    for k, own in docs.items():
        ids = np.array([*tok.encode(texts[k] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        copies, at = sum(r.length for r in own) // len(ids), {}
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            at.setdefault(r.start, []).append(r.length)
        end = 0
        for start in sorted(at):
            assert start == end and len(at[start]) == copies and len(set(at[start])) == 1
            end += at[start][0]
        assert end == len(ids)
    padding = 0
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
        padding += capacity - end if end & (end - 1) else 0
    return padding, len(places)


@pytest.mark.parametrize("tasks", [1, 5])
def test_whole_table(spark, small, tasks):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(tasks)
    rows = harmonic.pack(docs, PATH).collect()
    padding, sequences = check(rows, {r.doc_id: r.text for r in docs.collect()})
    total = sum(r.length for r in rows)
    assert sequences == -(-total // 2048) and padding < 0.01 * total and len(rows) < 4 * docs.count()


def test_rows_that_are_hard_to_handle(spark):
    texts = {1: None, 2: "", 3: "one two three", 4: "word " * 9_000, 5: "x" * 100_000, None: "no key", 6: "same text here"}
    data = [*texts.items(), (6, texts[6]), (6, texts[6]), (3, texts[3])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("length", "task", "k", "own", "start", "rank")})
    check(harmonic.pack(docs, PATH).collect(), texts)
    check(harmonic.pack(docs, PATH, capacity=100).collect(), texts, 100)
    assert harmonic.pack(docs.limit(0), PATH).count() == 0


def test_classes_are_filled_with_a_fixed_count(spark):
    """Texts of one length: each sequence of the class holds as many pieces as the class has."""
    docs = spark.range(1_000).select(F.col("id").alias("doc_id"), F.lit("one " * 408).alias("text")).repartition(3)
    rows = harmonic.pack(docs, PATH).collect()
    count = {}
    for r in rows:
        assert r.length == 409
        count.setdefault(r.sequence_id, []).append(r.offset)
    assert len(count) == 200 and all(sorted(x) == [0, 409, 818, 1227, 1636] for x in count.values())

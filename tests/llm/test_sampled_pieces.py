import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from mnemoframe.llm import sampled_pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocab():
    return S.vocabulary(MODEL)


def every_segmentation(vocab, text):
    ids, weight = {p: i for i, p in vocab.pieces.items()}, dict(zip(vocab.ids.tolist(), np.log(vocab.weights).tolist()))
    out = {}

    def go(at, path, w):
        if at == len(text):
            out[tuple(path)] = w
        for n in range(1, S.MAX_PIECE + 1):
            if at + n <= len(text) and text[at : at + n] in ids:
                i = ids[text[at : at + n]]
                go(at + n, [*path, i], w + weight[i])

    go(0, [], 0.0)
    z = math.log(sum(map(math.exp, out.values())))
    return {k: math.exp(v - z) for k, v in out.items()}


def test_samples_follow_the_distribution_without_replacement(vocab):
    p = every_segmentation(vocab, S.BLANK + "to" + S.BLANK + "be")
    n = 20_000
    found = S.sample(["to be"] * n, S._mix(np.arange(n).astype(np.uint64)), vocab, 3)
    paths = [[tuple(x[3].tolist()) for x in own] for own in found]
    assert all(len(set(x)) == 3 for x in paths)
    assert all(a[0] >= b[0] for own in found for a, b in zip(own, own[1:]))
    assert all(abs(x[1] - math.log(p[tuple(x[3].tolist())])) < 1e-5 for own in found[:300] for x in own)
    first, pairs = Counter(x[0] for x in paths), Counter(tuple(x[:2]) for x in paths)
    assert max(abs(first[s] / n - q) for s, q in p.items()) < 0.01
    assert max(abs(pairs[a, b] / n - p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b) < 0.01
    # inclusion probabilities make an unbiased sum: the probabilities of all segmentations add up to one
    assert abs(np.mean([sum(math.exp(x[1] - x[2]) for x in own) for own in found]) - 1) < 0.01


def test_improbable_segmentations_are_none_the_less_there(vocab):
    """A letter of which one segmentation has nearly all the mass still gives its two; three are not to be had."""
    n = 50
    for text in ("a", "s", "t"):
        p = every_segmentation(vocab, S.BLANK + text)
        assert len(p) == 2 and min(p.values()) < 1e-5
        for own in S.sample([text] * n, S._mix(np.arange(n).astype(np.uint64)), vocab, 3):
            assert {tuple(x[3].tolist()) for x in own} == set(p)
            assert all(abs(x[1] - math.log(p[tuple(x[3].tolist())])) < 1e-4 for x in own)
            assert all(vocab.decode(x[3].tolist()) == text for x in own)


def test_round_trip_and_edges(spark, vocab, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows = [(i, t, "c") for i, t in enumerate([*texts, None, "", "\n", "  two  blanks ", "\U0001f600 ퟿\r\n", "a" * 5000, "b c " * 20000])]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, ids string")
    got = S.decoded(S.sampled(docs, MODEL, with_check=True), MODEL).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.text == (rows[r.doc_id][1] or "")
        assert 4 * r.n_pieces == len(r.ids) and r.log_inclusion <= 0 and r.round_trip
    assert len(by[0]) == 4 and len({tuple(r.ids) for r in by[0]}) == 2  # a repeated row repeats its samples
    assert all(len({tuple(r.ids) for r in v}) == 2 for k, v in by.items() if k < len(texts))
    assert len(by[len(texts)]) == 1  # a null text has one segmentation
    assert S.sampled(docs.limit(0), MODEL).count() == 0


def test_the_query_decodes(spark, small):
    """The texts come back from the ids that the registered query returns."""
    from mnemoframe.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = S.decoded(queries.op6_gumbel_topk_pieces(spark, small), MODEL).collect()
    assert {r.doc_id for r in got} == set(texts) and all(r.text == texts[r.doc_id] for r in got)

"""The pipeline against a plain version of every stage on a small table."""

import re

import public_tokenizers

import corpus_pipeline
from mnemoframe.llm import line_dedup, quality
from mnemoframe.llm.simhash import similarity
from tests.llm.test_packing import check
from tests.llm.test_simhash import united


def plain(texts):
    """Of documents that pass the quality rules (all languages are sure): runs of 50 words that an earlier document holds, pairs of 0.8 or more."""
    seen, out = set(), {}
    for i in sorted(texts):
        words = texts[i].encode().split()
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        where = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", texts[i].encode())]
        out[i] = line_dedup.delete(texts[i].encode(), [(where[k][0], where[k + 49][1]) for k, r in enumerate(runs) if r in seen]).decode()
        seen.update(runs)
    ids = sorted(out)
    near = [(i, j) for i in ids for j in ids if j < i and similarity(out[i].encode(), out[j].encode()) >= 0.8]
    groups = united(ids, near)
    return {i: out[i] for i in ids if groups[i] == i}


def test_run(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    good = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}  # tests/llm/test_quality.py holds these
    check(corpus_pipeline.run(spark, small).collect(), plain({r.doc_id: r.text for r in docs.collect() if r.doc_id in good}))


def test_stages_keep_columns_and_take_any_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "word " * 60 + "other " * 60, "en", "s", 9), (3, " ".join(f"w{i}" for i in range(70)), None, None, 1)]
    odd = docs.limit(0).unionByName(spark.createDataFrame(rows, docs.schema))
    for frame in (docs.limit(0), odd):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, small)
            assert out.columns == docs.columns, name
            assert out.count() <= frame.count()
    assert [x for x, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    assert public_tokenizers.path("word_bpe_49k.json")

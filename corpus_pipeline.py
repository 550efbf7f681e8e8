"""The corpus pipeline: quality rules, language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and
returns the columns of ``documents`` (the last one: the packed pieces).  Repeated rows
are judged alike; a null text is an empty one, which the quality rules reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoframe.llm import language_id, line_dedup, packing, quality, simhash
from mnemoframe.llm.common import cut, row_key, small, unused, without
from mnemoframe.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host is not rejected."""
    row = unused(docs, "_row")
    rows = row_key(docs, out=row)
    rejected = quality.judge(rows, key=row).filter(~F.col("kept"))
    return without(rows, rejected, row).select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; the column lang becomes the language found."""
    row, changed, language = (unused(docs, c) for c in ("_row", "_changed", "_language"))
    rows = row_key(docs, out=row, more=("lang", "source"))
    found = cut(language_id.identify(rows, key=row), "languages")
    kept = without(rows, found.filter(~F.col("kept")), row)
    other = found.filter(F.col("kept") & ~F.col(f"{row}.lang").eqNullSafe(F.col("language")))
    other = small(other.select(F.col(row).alias(changed), F.col("language").alias(language)).distinct())
    kept = kept.join(other, F.col(row).eqNullSafe(F.col(changed)), "left")
    return kept.withColumn("lang", F.coalesce(language, "lang")).select(docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; n_chars follows the text."""
    return line_dedup.dedup_lines(docs, n_chars="n_chars").select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 or more, found by fingerprints at 8 bits or fewer and by the rarest shingles."""
    return simhash.dedup(docs, width=5, radius=8, least=0.8, whole=True).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", identify_language),
    ("line_dedup", dedup_passages),
    ("simhash_near_dedup", dedup_documents),
    ("best_fit_packing", pack),
]

#: Tokens and alignments are beyond SQL; tests/llm/test_pipeline.py holds a plain version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs

"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are multiplied: the likelihood of the text (byte trigrams,
naive Bayes), the language that markup declares, through a confusion table
estimated on all documents, and the prior of the host, smoothed towards its
address suffix, which is smoothed towards the whole corpus.  All counts behind
the confusion table and the priors are grouped sums of the text posteriors over
all documents; only the trigram model is fitted on a sample: at most
``sample_rows`` rows (those with the smallest hashes of their keys) out of one
labelled row in ``SAMPLE_SHARE``, so that at any size nearly all rows are judged
by a model that has not seen them.

Defined results: a null text, or one under three bytes, has no likelihood, and
declared language and host decide; a null declaration is a value of its own; a
null host shares the empty host; without labelled rows every language is
``und`` and nothing is kept; repeated rows each count and get equal results;
ties go to the first language by name; other columns pass unread, those named in
``carry`` as the struct ``carried``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.llm.common import bounded_batches, cut, small

SAMPLE_ROWS = 4_000
SAMPLE_SHARE = 5
BUCKETS = 1 << 14
#: Trigrams overlap and repeat: their log likelihood counts for this share.
TEMPER = 0.25
#: Documents that a suffix's (corpus's) prior is worth in a host's (suffix's).
PRIOR_DOCS = 20.0
#: A language is sure enough if it is more probable than all others together, whatever their number.
MIN_CONFIDENCE = 0.5


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram, A-Z lower-cased and white space as one space."""
    b = np.frombuffer(b" ".join(text.lower().split()), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def _bytes(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def declared_language(html: Column) -> Column:
    """The primary language that a page's root element declares (``lang`` of ``html``), in lower case; null if there is none."""
    found = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z]+)""", 1)
    return F.lower(F.nullif(found, F.lit("")))


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the buckets in each (buckets x languages), from at most about ``sample_rows`` labelled rows."""
    labelled = docs.filter(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(key)).filter(F.pmod(F.xxhash64("_h"), F.lit(SAMPLE_SHARE)) == 0)
    edge = labelled.select("_h").orderBy("_h").limit(sample_rows).agg(F.max("_h")).first()[0]
    if edge is None:
        return [], np.zeros((BUCKETS, 0))
    rows = labelled.filter(F.col("_h") <= edge).limit(sample_rows).select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1)):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(_bytes(t)), minlength=BUCKETS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(s[at])], names=["lang", "bucket", "n"])

    counted = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # languages x buckets at most
    langs = sorted(set(table["lang"]))
    n = np.zeros((BUCKETS, len(langs)))
    n[table["bucket"].to_numpy(dtype=np.int64), [langs.index(x) for x in table["lang"]]] = table["n"]
    n += 0.5
    return langs, np.log(n / n.sum(axis=0))


def likelihoods(docs: DataFrame, model: np.ndarray, columns: list[str], text: str) -> DataFrame:
    """``columns`` of every row and ll, the text's log likelihood in each language."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*columns).schema.add("ll", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.empty((b.num_rows, model.shape[1]))
            for i, t in enumerate(b.column(0)):
                at = trigrams(_bytes(t))
                out[i] = 0
                for a in range(0, len(at), 1 << 16):
                    out[i] += model[at[a : a + (1 << 16)]].sum(axis=0)
            ll = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * model.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], ll], names=[*columns, "ll"])

    return docs.select(F.col(text).cast("string").cast("binary").alias("_t"), *columns).mapInArrow(run, schema)


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    e = [F.exp(s - top) for s in scores]
    total = reduce(lambda a, b: a + b, e)
    return [x / total for x in e]


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", declared: str = "lang", host: str = "source", label: str = "lang",
    model: tuple[list[str], np.ndarray] | None = None, min_confidence: float = MIN_CONFIDENCE, carry: list[str] | None = None,
) -> DataFrame:
    """Per row: key, language, confidence (its posterior), text_language (by the text alone), kept (confidence of ``min_confidence`` or more) and, if asked for, carried."""
    carried = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    extra = ["carried"] if carry else []
    langs, table = model or fit(docs, key, text, label)
    if not langs:
        return docs.select(F.col(key), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_language"), F.lit(False).alias("kept"), *carried)
    h = F.coalesce(F.col(host).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(declared).cast("string"), F.lit("\0")).alias("d"), h.alias("h"), *carried)
    rows = rows.withColumn("s", F.when(F.col("h").contains("."), F.substring_index("h", ".", -1)).otherwise(""))
    seen = cut(likelihoods(rows, table, ["k", "d", "h", "s", *extra], "t"), "likelihoods")
    ids = range(len(langs))
    ll = [F.col("ll")[i] * TEMPER for i in ids]
    soft = seen.select("*", *[p.alias(f"p{i}") for i, p in enumerate(_softmax(ll))])
    # one pass: sums of the text posteriors by (declared, host, suffix), from which the rest follows
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in ids]
    cells = cut(soft.groupBy("d", "h", "s").agg(*sums), "evidence")
    total = cells.agg(*sums).first()
    n_all = sum(x or 0 for x in total)
    world = [((x or 0) + 1) / (n_all + len(langs)) for x in total]
    kinds = cells.select("d").distinct().count()
    confusion = cells.groupBy("d").agg(*sums).select("d", *[F.log((F.col(f"p{i}") + 0.5) / ((total[i] or 0) + 0.5 * (kinds + 1))).alias(f"d{i}") for i in ids])
    own = reduce(lambda a, b: a + b, [F.col(f"p{i}") for i in ids])
    suffix = cells.groupBy("s").agg(*sums).select("s", *[((F.col(f"p{i}") + PRIOR_DOCS * world[i]) / (own + PRIOR_DOCS)).alias(f"s{i}") for i in ids])
    hosts = cells.groupBy("h", "s").agg(*sums).join(small(suffix), "s")
    hosts = cut(hosts.select("h", *[F.log((F.col(f"p{i}") + PRIOR_DOCS * F.col(f"s{i}")) / (own + PRIOR_DOCS)).alias(f"h{i}") for i in ids]), "hosts")
    full = soft.join(small(cut(confusion, "confusion")), "d").join(small(hosts), "h")
    posterior = _softmax([ll[i] + F.col(f"d{i}") + F.col(f"h{i}") for i in ids])
    best = lambda cols: F.array_max(F.array(*[F.struct(c.alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(cols)]))
    names = F.array(*[F.lit(x) for x in langs])
    full = full.select("k", *extra, best(posterior).alias("b"), best([F.col(f"p{i}") for i in ids]).alias("t"))
    return full.select(
        F.col("k").alias(key), names[-F.col("b.i")].alias("language"), F.col("b.p").alias("confidence"),
        names[-F.col("t.i")].alias("text_language"), (F.col("b.p") >= min_confidence).alias("kept"), *extra,
    )

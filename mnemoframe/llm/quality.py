"""Quality rules with host verdicts, in DataFrame functions only.

Every text is measured and held against per-document rules.  Rule failures are
then summed by host; each host's failure rate is shrunk towards the rate of all
hosts with an empirical beta prior (fitted by moments), so that a host with few
documents is not judged by chance, and the verdict is joined back:

* ``rejected``, if the shrunk rate is nearer to certain failure than to the mean
  of the prior: all documents go;
* ``watched``, if it is above that mean: documents go that fail any rule;
* ``trusted`` otherwise: documents go that fail the base rules.

So a weak sign (odd words, symbols, repeated lines) counts where the host makes
it likely to mean something.

Defined results: a null text counts as empty (no words, so it fails); a null
host is a host of its own; repeated rows each count and are each returned; a
host whose rate equals the mean is trusted; an empty table gives an empty
result; columns of the input other than key, text and host are not read, so
clashing names do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import cut, small

#: What separates words, and what counts as a symbol.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: How far from the prior's mean towards certain failure a host's shrunk rate may lie.
HOST_LIMIT = 0.5
#: Rates nearer to the mean than this equal it.
EQUAL = 1e-9


def repeat_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: the number of words of the array ``words`` that lie in a three-word window found twice or more.

    Windows are sorted by (hash, position) inside the row, so that equal ones meet as neighbours; no shuffle, and n log n for any text.
    """
    w = F.col(words)
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    docs = docs.withColumn("_sorted", F.array_sort(windows))
    s = F.col("_sorted")
    same = lambda x, y: x["h"].eqNullSafe(y["h"])
    docs = docs.withColumn("_at", F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]))
    docs = docs.withColumn("_at", F.array_sort("_at"))
    at = F.col("_at")
    steps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(3)), F.lit(3)))
    return docs.withColumn(out, F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)).drop("_sorted", "_at")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(key).alias("k"), F.col(host).alias("h"), t.alias("t"), F.array_remove(F.split(t, SPACES), "").alias("w"), lines.alias("l"))
    rows = rows.select(
        "k", "h", "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    rows = repeat_words(rows, "w", "n_repeat_words")
    return rows.select(F.col("k").alias(key), F.col("h").alias(host), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Per-document rules whose failures count against the host."""
    n = F.col("n_words")
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") * 10 > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "dup_lines": F.col("n_dup_lines") * 2 > F.col("n_lines"),
    }


def any_failed() -> Column:
    return reduce(Column.__or__, rules().values())


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """Per host: n, failed documents, the shrunk rate and the prior's mean.

    The beta prior has the mean of all documents; its weight (in documents) follows from the spread of
    the hosts' rates beyond what counting alone gives, from 1 (hosts differ at will) to 10,000 (they are alike).
    """
    by = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(any_failed().cast("long")).alias("failed"))
    by = cut(by, "hosts")
    n, f = F.col("n"), F.col("failed")
    mean = by.agg(F.sum("n").alias("docs"), F.sum("failed").alias("fails"), F.count(F.lit(1)).alias("hosts"))
    mean = mean.select("docs", "hosts", F.try_divide("fails", "docs").alias("mu"))
    spread = by.join(F.broadcast(mean)).agg(F.sum(n * F.pow(f / n - F.col("mu"), F.lit(2))).alias("ss"), F.sum(n * n).alias("nn"))
    prior = mean.join(F.broadcast(spread))
    within = F.col("mu") * (1 - F.col("mu"))
    between = F.try_divide(F.col("ss") - (F.col("hosts") - 1) * within, F.col("docs") - F.try_divide("nn", "docs"))
    weight = F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), F.coalesce(F.when(between > 0, within / between - 1), F.lit(10_000.0))))
    prior = prior.select("mu", weight.alias("nu"))
    return by.join(F.broadcast(prior)).select("host", "n", "failed", ((f + F.col("mu") * F.col("nu")) / (n + F.col("nu"))).alias("host_rate"), "mu")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per row: key, host, the measures, base_failed, host_rate, host_verdict and kept."""
    measured = cut(measure(docs, key, text, host), "measured")
    over = F.col("host_rate") - F.col("mu")
    verdict = F.when(over > host_limit * (1 - F.col("mu")), "rejected").when(over > EQUAL, "watched").otherwise("trusted")
    verdicts = small(cut(host_rates(measured, host).select(F.col("host").alias("_host"), "host_rate", verdict.alias("host_verdict")), "verdicts"))
    out = measured.join(verdicts, F.col(host).eqNullSafe(F.col("_host"))).drop("_host").withColumn("base_failed", base_failed())
    fails = F.when(F.col("host_verdict") == "watched", any_failed()).otherwise(F.col("base_failed"))
    return out.withColumn("kept", ~fails & (F.col("host_verdict") != "rejected"))

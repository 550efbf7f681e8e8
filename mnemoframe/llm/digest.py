"""Canonical exact digests, in DataFrame functions only.

A text is normalised (NFKC), case-folded, its white space folded, and hashed to
128 bits with two differently salted XXH64.  Groups of equal digests are then
compared byte by byte, so that no collision ever joins two texts.

Unicode normalisation and full case folding come from ICU, which Spark ships
for its collations, through the SQL function ``reflect``; ASCII texts need neither.

Defined results: a null text counts as empty; equal texts have equal digests; an
empty table gives an empty result; null keys sort first.  Every row of the input
is one row of the result.  Rows that share a key are one document to their
neighbours: its next document is the one with the next larger key, and of
several texts of one key the one with the smallest XXH64 stands for it, so
repeated rows get repeated results.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import cut, drop_cut, small

#: Keys in a range whose order one task finds, and the bound on the number of ranges.
RANGE_ROWS = 200_000
MAX_RANGES = 20_000

_ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
_ICU_CHARACTER = "com.ibm.icu.lang.UCharacter"
_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def canonical(text: Column) -> Column:
    """NFKC, full case folding, white space runs as one space, trimmed."""
    folded = F.reflect(F.lit(_ICU_CHARACTER), F.lit("foldCase"), F.reflect(F.lit(_ICU_NORMALIZER), F.lit("compose"), text, F.lit(True)), F.lit(True))
    whole = F.reflect(F.lit(_ICU_NORMALIZER), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(F.when(text.rlike(r"[^\x00-\x7f]"), whole).otherwise(F.lower(text)), _SPACE, " "))


def wide_hash(text: Column) -> Column:
    """128 bits as 32 hex digits."""
    half = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(half(F.xxhash64(text)), half(F.xxhash64(F.lit("salt"), text)))


def digest(text: Column) -> Column:
    return wide_hash(canonical(F.coalesce(text.cast("string"), F.lit(""))))


def next_keys(keys: DataFrame, key: str) -> DataFrame:
    """(key, next): every distinct key, null first, with the next larger one; the last one's is the first.

    Keys are dealt by ranges that follow their own quantiles, so that no distribution fills one range; of each range only
    the first key (``MAX_RANGES`` at most) is gathered in one place.
    """
    k = F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key"))
    distinct = cut(keys.select(k.alias("k")).distinct(), "keys")
    n = max(1, min(distinct.count() // RANGE_ROWS, MAX_RANGES))
    dealt = cut(distinct.repartitionByRange(n, "k").withColumn("b", F.spark_partition_id()), "ranges")
    order = Window.orderBy("b")
    heads = dealt.groupBy("b").agg(F.min("k").alias("head"))
    first = dealt.agg(F.min("k").alias("first"))
    after = heads.join(F.broadcast(first)).select("b", F.coalesce(F.lead("head").over(order), F.col("first")).alias("after"))  # MAX_RANGES rows
    out = dealt.join(F.broadcast(after), "b").withColumn("next", F.coalesce(F.lead("k").over(Window.partitionBy("b").orderBy("k")), F.col("after")))
    out = cut(out.select(F.col("k.key").alias(key), F.col("next.key").alias("next")), "next")
    for x in (distinct, dealt):
        drop_cut(x)
    return out


def next_heads(docs: DataFrame, info: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, head, next_fp): for every distinct key the beginning of the next document, a quarter of the own text long, and its fingerprint, as a written table.

    ``info``: (key, th, n, fp) of every row, th being the text's XXH64.  Of the next text only what is needed travels.
    """
    links = next_keys(info, key)
    one = info.groupBy(F.col(key).alias("_o")).agg(F.max(F.floor(F.col("n") / 4)).cast("int").alias("q"), F.min(F.struct("th", "fp")).alias("r"))
    wanted = links.join(one.select("_o", "q"), F.col(key).eqNullSafe(F.col("_o"))).select(F.col(key).alias("_k"), "next", "q")
    wanted = cut(wanted.join(one.select("_o", "r"), F.col("next").eqNullSafe(F.col("_o"))).select("_k", "next", "q", F.col("r.th").alias("_th"), F.col("r.fp").alias("next_fp")), "wanted")
    found = docs.join(small(wanted), F.col(key).eqNullSafe(F.col("next")) & (F.xxhash64(text) == F.col("_th")))
    heads = cut(found.groupBy("_k", "next_fp").agg(F.min(F.substring(F.col(text), F.lit(1), F.col("q"))).alias("head")), "heads")
    for x in (links, wanted):
        drop_cut(x)
    return heads


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last quarter (code points, rounded down) replaced by the first as many of ``other``."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - q), F.substring(other, F.lit(1), q))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (1 if the digests are equal, else 0).

    Texts are canonicalised where they lie; they are shuffled once, to meet the beginnings of their neighbours, many rows to one.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    info = cut(rows.select(key, F.xxhash64("t").alias("th"), F.length("t").cast("long").alias("n"), digest(F.col("t")).alias("fp")), "info")
    heads = next_heads(rows, info, key, "t")
    met = rows.join(heads, F.col(key).eqNullSafe(F.col("_k"))).withColumn("e", edited(F.col("t"), F.col("head")))
    changed = F.when(F.col("e") != F.col("t"), digest(F.col("e")))
    met = cut(met.select(key, F.xxhash64("t").alias("th"), F.sha2("e", 256).alias("edited_sha256"), changed.alias("changed"), "next_fp"), "edited")
    own = info.groupBy(F.col(key).alias("_k"), F.col("th").alias("_t")).agg(F.first("n").alias("n"), F.first("fp").alias("fp"))
    out = met.join(small(cut(own, "own")), F.col(key).eqNullSafe(F.col("_k")) & (F.col("th") == F.col("_t")))
    out = out.withColumn("efp", F.coalesce("changed", "fp"))
    alike = lambda other: (F.col("fp") == F.col(other)).cast("double")
    return out.select(
        key, F.col("n").alias("n_chars"), "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        alike("efp").alias("near_edited"), alike("next_fp").alias("near_next"),
    )


def with_groups(digests: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """``digests`` with group_id, the smallest key of a document with the same canonical bytes.

    Only texts in buckets with company are read again.  Equal bytes are summed up before they meet, and rows take their group by
    the digest alone; only where a bucket holds different bytes (a collision) do they take it by the bytes themselves.
    """
    own = F.col(fingerprint)
    shared = cut(digests.groupBy(own.alias("fp")).count().filter("count > 1").select("fp"), "shared")
    in_company = digests.join(small(shared), own == F.col("fp"), "left_semi").select(F.col(key).alias("_in")).distinct()
    rows = docs.join(small(in_company), F.col(key).eqNullSafe(F.col("_in")), "left_semi")
    rows = rows.select(F.col(key).alias("k"), canonical(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("c"))
    rows = rows.withColumn("fp", wide_hash(F.col("c"))).join(small(shared), "fp", "left_semi")
    first = F.min(F.struct(F.col("k").isNotNull().alias("some"), F.col("k").alias("key")))
    classes = cut(rows.groupBy("fp", "c").agg(first.alias("g")), "classes")
    by = classes.groupBy("fp").agg(F.min("g").alias("g"), F.count(F.lit(1)).alias("n"))
    out = digests.join(small(cut(by, "buckets")), own == F.col("fp"), "left").drop("fp")
    apart = small(by.filter("n > 1").select("fp"))
    if not by.filter("n > 1").isEmpty():
        exact = rows.join(apart, "fp", "left_semi").join(classes, ["fp", "c"]).groupBy(F.col("k").alias("_k"), F.col("fp").alias("_f")).agg(F.min("g").alias("_g"))
        out = out.join(exact, (own == F.col("_f")) & F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("g", F.coalesce("_g", "g")).drop("_k", "_f", "_g")
    return out.withColumn("group_id", F.when(F.col("g").isNull(), F.col(key)).otherwise(F.col("g.key"))).drop("g", "n")

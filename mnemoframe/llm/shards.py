"""Sharding by extendible hashing, in DataFrame functions only.

A row's address is the leading bits of a hash of its key.  The directory starts
with no bits; a bucket over the byte limit splits on its next bit, all others
stay, until every shard fits.  The splits are not made one by one: bytes are
summed once per cell of a fine prefix, rolled up to every shorter prefix, and
each cell takes the shortest prefix that fits.  Cells that are over the limit
themselves go on with more bits; rows of one address that are over it together
are found beforehand, as no bit parts them, and dealt to numbered parts.

Defined results: a null text has no bytes; a null key hashes as an empty string;
a row larger than the limit is a shard of its own (``oversized``); rows whose
keys hash alike over all bits (repeated rows, above all) are dealt to numbered
parts that fit; every row of the input is one row of the result, also where keys
repeat; an empty table gives an empty result; other columns are unread, but for
``write``, which reserves the names ``_key`` and ``_shard``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.llm.common import cut, drop_cut, small

#: Bits of the address: 15 hex digits of an MD5.
BITS = 60
LIMIT = 64 << 20
#: Bits a step goes beyond what even filling would need.
_SPARE = 4
#: Rows of one address in a lot, and its bytes in limits: a lot's running sum is one task's.
_LOT_ROWS, _LOT_LIMITS = 1_000_000, 16


def address(key: str) -> Column:
    """The first 60 bits of the MD5 of the key's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: Column) -> Column:
    """The leading ``depth`` bits of the column h."""
    return F.call_function("shiftright", F.col("h"), F.lit(BITS) - depth)


def _placed(docs: DataFrame, limit: int, key: str, text: str, carry: list[str]) -> DataFrame:
    """One row for each of ``docs``: v (a struct of ``carry``), bytes, shard, depth, as a written table."""
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long")
    rows = cut(docs.select(F.struct(*[F.col(c) for c in carry]).alias("v"), address(key).alias("h"), size.alias("bytes")), "addresses")
    scratch = [rows]
    columns = ["v", "bytes", "depth", "shard"]
    large = rows.filter(F.col("bytes") > limit)
    done = [large.withColumns({"depth": F.lit(BITS), "shard": F.concat(F.lit("*"), F.hex("h"))}).select(columns)]
    todo, depth = rows.filter(F.col("bytes") <= limit), 0
    total = todo.agg(F.sum("bytes")).first()[0] or 0
    while True:
        deep = min(BITS, depth + max(_SPARE, min(20, math.ceil(math.log2(max(1.0, total / limit))) + _SPARE)))
        cells = todo.groupBy(_prefix(F.lit(deep)).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        ups = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth"))
        ups = ups.withColumn("prefix", F.call_function("shiftright", "cell", F.lit(deep) - F.col("depth")))
        fits = ups.groupBy("depth", "prefix").agg(F.sum("bytes").alias("b")).filter(F.col("b") <= limit).drop("b")
        leaves = cut(ups.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth")), "directory")
        here = todo.withColumn("cell", _prefix(F.lit(deep))).join(small(leaves), "cell", "left")
        bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix(F.col("depth"))), F.col("depth"), F.lit("0")))
        done.append(here.filter("depth IS NOT NULL").withColumn("shard", bits).select(columns))
        scratch.append(leaves)
        rest = cells.join(leaves, "cell", "left_anti")
        total = rest.agg(F.sum("bytes")).first()[0] or 0
        if not total:
            break
        todo = cut(todo.withColumn("cell", _prefix(F.lit(deep))).join(small(rest.select("cell")), "cell", "left_semi").drop("cell"), "deeper")
        scratch.append(todo)
        # no further bit parts the rows of one address: where they do not fit, they leave the directory
        by = todo.groupBy("h").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).filter(F.col("b") > limit)
        hot = cut(by.select("h", F.ceil(F.greatest(F.col("n") / _LOT_ROWS, F.col("b") / (_LOT_LIMITS * limit))).cast("long").alias("lots")), "hot")
        scratch.append(hot)
        if not hot.isEmpty():
            lots = cut(todo.join(small(hot), "h").withColumn("lot", F.pmod(F.xxhash64("h", "bytes", F.monotonically_increasing_id()), F.col("lots"))), "lots")
            scratch.append(lots)
            done.append(_parts(lots, limit).select(columns))
            todo = todo.join(small(hot.select("h")), "h", "left_anti")
            total = todo.agg(F.sum("bytes")).first()[0] or 0
            if not total:
                break
        depth = deep
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = cut(out, "assigned")
    for x in scratch:
        drop_cut(x)
    return out


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal address, dealt to lots, in parts within the limit: each lot is cut by its running bytes."""
    w = Window.partitionBy("h", "lot").orderBy("bytes").rowsBetween(Window.unboundedPreceding, -1)
    top = Window.partitionBy("h", "lot")
    step = F.greatest(F.lit(limit) - F.max("bytes").over(top), F.lit(1))
    rows = rows.withColumn("part", F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / step))
    name = F.concat(F.lpad(F.bin("h"), BITS, "0"), F.lit("-"), F.col("lot").cast("string"), F.lit("-"), F.col("part").cast("string"))
    return rows.withColumns({"depth": F.lit(BITS), "shard": name})


def assign(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, bytes, shard (the prefix's bits; ``-lot-part`` for parts; ``*`` and the address for oversized rows), depth, shard_bytes, shard_rows and oversized."""
    out = _placed(docs, limit, key, text, [key]).withColumn("_key", F.col(f"v.{key}"))
    sums = out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return out.join(small(sums), "shard").select(F.col("_key").alias(key), "bytes", "shard", "depth", "shard_bytes", "shard_rows", (F.col("bytes") > limit).alias("oversized"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` as Parquet, a folder for each shard; every row goes to the shard that it was given itself, so repeated keys stay as many."""
    rows = _placed(docs, limit, key, text, docs.columns)
    rows.select("v.*", F.col("shard").alias("_shard")).repartition("_shard").write.partitionBy("_shard").parquet(path)
    drop_cut(rows)

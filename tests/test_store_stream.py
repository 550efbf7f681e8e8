import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import store
from mnemoframe.streaming import store_stream

SCHEMA = "user_id string, op string, seq long, session_id int, kind string, fact_id string, lang string, text string"


def turns(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice("uuv"), "write", i, 1 + i // 10, rng.choice(["plant", "filler", "correction"]), rng.choice(["f1", None]), "en", rng.choice("abcdefgh") * 2) for i in range(n)]
    return rows + [("w", "write", n, None, "plant", None, "hi", None), ("w", "write", n + 1, 2, "plant", None, "hi", "")]


def plain(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("text", F.coalesce("text", F.lit("")))
    return store.write(store.empty(spark), df.withColumnRenamed("user_id", "who"), F.col("who"))


def view(df):
    return sorted((r.user_id, r.seq, r.raw_id, r.text, r.lang_detected, tuple(sorted(r.metadata.items()))) for r in df.collect())


@pytest.mark.parametrize("files", [1, 7])
def test_any_batch_cut_gives_the_batch_result(spark, tmp_path, files):
    """Batches of one file each, the query ended and started again from its checkpoint between the halves."""
    rows = turns(90)
    step = -(-len(rows) // files)
    parts = [rows[i : i + step] for i in range(0, len(rows), step)]
    source = f"file://{tmp_path}/in"

    def feed(some):
        for p in some:
            spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    run = lambda: store_stream.write_all(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    half = max(1, len(parts) // 2)
    feed(parts[:half])
    assert run().count() == sum(map(len, parts[:half]))
    feed(parts[half:])
    got, want = run(), plain(spark, rows)
    assert view(got) == view(want) and view(store_stream.current(got)) == view(want)
    assert view(got.filter("is_first")) == view(store.consolidate(want))
    assert run().count() == len(rows)  # nothing new: nothing twice


def test_reset_starts_anew(spark, tmp_path):
    w = lambda i, t, user="u": (user, "write", i, 1, "plant", "f", "en", t)
    rows = [w(0, "a"), w(1, "a"), w(2, "x", "v"), ("u", "reset", 3, None, None, None, None, None), w(4, "b"), w(5, "a"), w(6, "a"), w(7, "z", "gone"), ("gone", "reset", 8, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    got = store_stream.write_all(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    now = sorted((r.user_id, r.seq, r.text, r.is_first) for r in store_stream.current(got).collect())
    assert now == [("u", 0, "b", True), ("u", 1, "a", True), ("u", 2, "a", False), ("v", 0, "x", True)]
    assert got.filter("seq >= 0").count() == 7

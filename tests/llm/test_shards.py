import hashlib

from pyspark.sql import functions as F

from mnemoframe.llm import shards


def plain(rows, limit):
    """Extendible hashing, bucket by bucket."""
    at = {i: (int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), b) for i, b in rows}
    out, todo = {}, [("", [i for i, b in rows if b <= limit])]
    while todo:
        bits, ids = todo.pop()
        if sum(at[i][1] for i in ids) <= limit:
            out |= {i: bits for i in ids}
            continue
        d = len(bits) + 1
        for bit in "01":
            part = [i for i in ids if f"{at[i][0]:060b}"[d - 1] == bit]
            if part:
                todo.append((bits + bit, part))
    return out


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, len(r.text.encode())) for r in docs.collect()]
    for limit in (20_000, 60_000, 10**9):
        got = shards.assign(docs, limit).collect()
        assert {r.doc_id: r.shard for r in got if not r.oversized} == plain(rows, limit)
        assert all(r.shard_bytes <= limit for r in got if not r.oversized)
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)


def test_hot_key_and_edges(spark, tmp_path):
    rows = [(1, "x" * 1000)] * 300 + [(i, "y" * 500) for i in range(2, 300)] + [(1000, None), (None, "z"), (1001, "w" * 9000), (1002, "")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shard string")
    got = shards.assign(docs, 8000).collect()
    assert len(got) == len(rows)
    assert all(r.shard_bytes <= 8000 for r in got if not r.oversized)
    assert [r.doc_id for r in got if r.oversized] == [1001]
    assert sum(r.bytes for r in got) == 300 * 1000 + 298 * 500 + 1 + 9000
    assert shards.assign(docs.limit(0)).count() == 0
    shards.write(docs.filter("doc_id > 1 AND doc_id < 40"), str(tmp_path / "out"), 4000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 38


def test_write_keeps_repeated_rows(spark, tmp_path):
    """A key whose rows are over the limit goes to several parts: each row to one of them."""
    rows = [(1, "x" * 100, i) for i in range(61)] + [(None, "y" * 90, 0)] * 3 + [(i, "z" * 50, 0) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bytes int")
    shards.write(docs, str(tmp_path / "out"), 1000)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, out.select("doc_id", "text", "bytes").collect())) == sorted(map(str, docs.collect()))
    assert max(r.b for r in out.groupBy("_shard").agg(F.sum(F.length("text")).alias("b")).collect()) <= 1000
    assert out.filter("doc_id = 1").select("_shard").distinct().count() > 6

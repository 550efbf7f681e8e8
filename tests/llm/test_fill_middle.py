import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemoframe.llm import fill_middle


def plain(key, text):
    """(n, form, prefix, middle, suffix, output) by a list of tokens."""
    text = text or ""
    w = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", pre, mid, suf, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(w), "psm", pre, mid, suf, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("chunk", [1, 2, 5, 2048])
def test_equals_a_list_of_tokens(spark, monkeypatch, chunk):
    """Random texts of letters, marks and code points of one to four bytes, with chunks so small that cuts fall on and beside their borders."""
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    rng = random.Random(chunk)
    alphabet = ["a", "B", "zz", " ", "\n", "é", "日", "\U0001f600", "0", "<", "P", ">", "\0", "ab cd", "́", "İ"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(None, "a b"), (1000, None), (1001, ""), (1002, "<P>x"), (1003, "x <S"), (1004, "><M><"), (1005, "a" * 5000), (1006, "é" * 3000), (7, rows[7][1]), (-5, "minus one two")]
    if chunk > 4:
        rows.append((1007, "word, \U0001f600 " * 40_000))
    got = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "form": F.lit("x"), "bytes": F.lit(1)}))
    got = got.withColumn("restored", fill_middle.restore(F.col("form"), F.col("output"))).collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in got))) == sorted(str((k, *plain(k, t))) for k, t in rows)
    assert sorted((r.doc_id or 0, r.restored) for r in got) == sorted((k or 0, t or "") for k, t in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_only_owning_chunks_are_scanned_again(spark):
    df = spark.createDataFrame([([3, 0, 2, 4], 0, 3), ([3, 0, 2, 4], 4, 9), ([], 0, 0), ([1], 1, 1)], "s array<bigint>, a long, b long")
    got = df.select(fill_middle.owners(F.col("s"), {"a": F.col("a"), "b": F.col("b")}).alias("o")).select("o.*").collect()
    assert [(r.a_chunk, r.a_before, r.b_chunk, r.b_before) for r in got] == [(0, 0, 2, 3), (2, 3, None, None), (None,) * 4, (None,) * 4]


def test_no_python_and_no_shuffle(spark, small):
    from mnemoframe.llm import queries

    plan = queries.op11_overlapping_chunks_fim(spark, small)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_other_rates(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    count = lambda **o: {r.form: r.n for r in fill_middle.transform(df, **o).groupBy("form").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert count(rate=0) == {"plain": 200} and count(rate=100, spm=100) == {"spm": 200} and count(rate=100, spm=0) == {"psm": 200}

import re
from collections import Counter

from mnemoframe.llm import quality


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c, cover = Counter(zip(w, w[1:], w[2:])), set()
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if c[g] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def check(df, rows):
    got = quality.judge(df).collect()
    texts = {}
    for k, t, *_ in rows:
        texts.setdefault(k, t)
    assert len(got) == len(rows)
    for r in got:
        n = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.base_failed and r.kept)
    return got


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "a b c a b c a\n\na b\na b | #", "a"), (4, "x " * 40000, "b"), (4, "x " * 40000, "b"), (5, " ".join(f"w{i}é" for i in range(60)), None)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)
    assert {r.doc_id: r.kept for r in got}[5] is True
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    clash = spark.createDataFrame([(1, "t", "s", 7, True)], "doc_id long, text string, source string, n_words int, kept boolean")
    assert quality.judge(clash).first().n_words == 1


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "junk", "bad") for i in range(400)] + [(400, good, "bad"), (401, "junk", "new"), (402, good, "new")] + [(500 + i, good, f"h{i % 20}") for i in range(400)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[400].host_rate > 0.9 and not got[400].kept and not got[400].base_failed
    assert got[402].kept  # two documents say little about a host: its rate stays near the prior
    assert got[500].kept


def test_a_weak_sign_counts_on_a_watched_host(spark):
    """Odd texts that pass the base rules stay on hosts at the mean or below, and go on hosts above it."""
    good, odd = " ".join(f"word{i}" for i in range(80)), " ".join(f"w{i} # $" for i in range(60))
    rows = [(i, odd if i % 3 == 0 else good, "worse") for i in range(300)] + [(1000 + i, odd if i == 0 else good, "better") for i in range(300)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].host_verdict == "watched" and not got[0].kept and not got[0].base_failed and got[1].kept
    assert got[1000].host_verdict == "trusted" and got[1000].kept

import hashlib
import unicodedata

import xxhash
from pyspark.sql import functions as F

from mnemoframe.llm import digest


def canon(t):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return " ".join(n(n(t).casefold()).split())


def plain(rows):
    """(key, text) rows by the definition: (key, n_chars, sha of the edited text, likeness of the edited and of the next text, canonical text, canonical edited text)."""
    one = {}
    for k, t in rows:
        t = t or ""
        h = lambda x: (xxhash.xxh64_intdigest(x.encode(), 42) + 2**63) % 2**64  # noqa: E731  as a signed number
        one[k] = min(one.get(k, t), t, key=h)
    order = sorted(one, key=lambda k: (k is not None, k))
    out = []
    for k, t in rows:
        t = t or ""
        n, q = one[order[(order.index(k) + 1) % len(order)]], len(t) // 4
        e = t[: len(t) - q] + n[:q]
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), float(canon(t) == canon(e)), float(canon(t) == canon(n)), canon(t), canon(e)))
    return out


def check(got, rows):
    want = plain(rows)
    strip = lambda r: sorted(r, key=str)
    assert strip((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == strip(w[:5] for w in want)
    by, ids = {}, {}
    for w in want:
        by.setdefault((w[0], w[2]), set()).update([("f", w[5]), ("e", w[6])])
    for r in got:
        for kind, value in (("f", r.fingerprint), ("e", r.edited_fingerprint)):
            texts = {t for k, t in by[r.doc_id, r.edited_sha256] if k == kind}
            if len(texts) == 1:
                ids.setdefault(value, set()).update(texts)
    assert all(len(t) == 1 for t in ids.values())
    assert len(ids) == len({t for v in ids.values() for t in v})


def test_fingerprints(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(digest.fingerprints(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_null_and_outlying_keys(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_ROWS", 3)
    rows = [(1, "one two three four"), (1, "one two three four"), (1, "One  two three four"), (None, "x" * 9), (None, "x" * 9), (2, None), (3, ""), (10**15, "y " * 50_000), (-5, "ab"), (4, "ABC d"), (5, "abc D")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fp string")
    got = queries_op5(docs)
    assert len(got) == len(rows)
    check(got, rows)
    assert {r.doc_id: r.group_id for r in got} == {1: 1, None: None, 2: 2, 3: 2, 10**15: 10**15, -5: -5, 4: 4, 5: 4}
    names = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(20)], "doc_id string, text string")
    s = sorted(f"k{i}" for i in range(20))
    assert {r.doc_id: r.next for r in digest.next_keys(names, "doc_id").collect()} == dict(zip(s, s[1:] + s[:1]))


def queries_op5(docs):
    return digest.with_groups(digest.fingerprints(docs), docs).collect()


def test_colliding_digests_stay_apart(spark, monkeypatch):
    """With a hash that says nothing, the bytes decide."""
    monkeypatch.setattr(digest, "wide_hash", lambda c: F.when(c.isNotNull(), F.lit("0")))
    rows = [(1, "a"), (2, "b"), (3, "A"), (3, "A"), (4, "b ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = queries_op5(docs)
    assert sorted((r.doc_id, r.group_id) for r in got) == [(1, 1), (2, 2), (3, 1), (3, 1), (4, 2)]


def test_canonical_forms_and_edges(spark):
    rows = [(1, "Straße  ﬁn"), (2, "STRASSE\nfin"), (3, None), (4, ""), (5, "e\u0301"), (6, "É"), (7, "x" * 200_000), (7, "x" * 200_000), (None, "a b")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, fingerprint string")
    got = digest.fingerprints(docs)
    f = {r.doc_id: r.fingerprint for r in got.collect()}
    assert got.count() == 9 and len(f) == 8
    assert f[1] == f[2] and f[3] == f[4] and f[5] == f[6] and len(set(f.values())) == 5
    assert digest.fingerprints(docs.limit(0)).count() == 0
    one = digest.fingerprints(docs.filter("doc_id = 1")).first()
    assert one.near_next == 1.0

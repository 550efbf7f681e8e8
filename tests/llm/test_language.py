import numpy as np
from pyspark.sql import functions as F

from mnemoframe.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = language_id.fit(docs.filter(part == 0))
    rest = docs.filter(part == 1).withColumn("shown", F.lit(None).cast("string"))
    got = language_id.identify(rest, declared="shown", model=model).join(rest.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.text_language == got.lang).mean() > 0.98
    assert (got.language == got.lang).mean() > 0.98
    assert got.kept.mean() > 0.99


def test_evidence_is_fused(spark):
    """A text that says nothing follows its declaration and its host; the sample alone bounds the fit."""
    langs = ["aa", "bb"]
    table = np.log(np.full((language_id.BUCKETS, 2), 0.5 / language_id.BUCKETS))
    at = {x: language_id.trigrams(x.encode() * 3)[0] for x in ("xxx", "yyy")}
    table[at["xxx"], 0] += 5
    table[at["yyy"], 1] += 5
    rows = [(i, "xxxxxx", "aa", "h.one") for i in range(50)] + [(100 + i, "yyyyyy", "bb", "h.two") for i in range(50)]
    rows += [(200, "q", "aa", "new.one"), (201, "q", None, "h.two"), (202, None, "bb", None), (203, "", "aa", "h.two"), (200, "q", "aa", "new.one")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, source string, language string")
    got = language_id.identify(docs, model=(langs, table)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[0].language == "aa" and by[100].language == "bb"
    assert by[200].language == "aa" and by[201].language == "bb" and by[202].language == "bb"
    total = language_id.identify(docs.limit(0))
    assert total.count() == 0
    assert language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("language <> 'und' OR kept").count() == 0


def test_posterior_equals_a_plain_one(spark):
    """The same model, summed up document by document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300)
    rows = docs.select("doc_id", F.substring("text", 1, 12).alias("text"), "lang", F.concat("source", F.when(F.col("doc_id") % 3 == 0, ".one").otherwise(".two")).alias("source"))
    rows = rows.withColumn("declared", F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    langs, table = model = language_id.fit(docs)
    data, n = rows.collect(), len(langs)
    ll = np.array([[language_id.TEMPER * table[language_id.trigrams(r.text.encode()), j].sum() for j in range(n)] for r in data])
    soft = np.exp(ll - ll.max(axis=1, keepdims=True))
    soft /= soft.sum(axis=1, keepdims=True)
    total = soft.sum(axis=0)
    world = (total + 1) / (total.sum() + n)

    def sums(key):
        out = {}
        for r, p in zip(data, soft):
            out[key(r)] = out.get(key(r), 0) + p
        return out

    declared, hosts, suffixes = sums(lambda r: r.declared), sums(lambda r: r.source), sums(lambda r: r.source.rpartition(".")[2])
    smooth = lambda own, prior: (own + language_id.PRIOR_DOCS * prior) / (own.sum() + language_id.PRIOR_DOCS)
    want = {}
    for r, x in zip(data, ll):
        prior = smooth(hosts[r.source], smooth(suffixes[r.source.rpartition(".")[2]], world))
        s = x + np.log((declared[r.declared] + 0.5) / (total + 0.5 * (len(declared) + 1))) + np.log(prior)
        e = np.exp(s - s.max())
        want[r.doc_id] = (langs[int(s.argmax())], float((e / e.sum()).max()))
    got = language_id.identify(rows, declared="declared", model=model, carry=["source"]).collect()
    for r in got:
        assert r.language == want[r.doc_id][0] and abs(r.confidence - want[r.doc_id][1]) < 1e-9
        assert r.kept == (r.confidence >= language_id.MIN_CONFIDENCE)
    assert len(got) == len(data) and any(r.language != r.text_language for r in got)


def test_declarations_and_hosts(spark):
    rows = [("<!DOCTYPE html><HTML class=a LANG='De-AT'>", "HTTPS://A.b.Com:80/x"), ('<html data-lang="en">', "no address"), (None, None), ('<html lang=fr><p lang="es">', "http://h.org?q#f")]
    df = spark.createDataFrame(rows, "h string, u string")
    got = [tuple(r) for r in df.select(language_id.declared_language(F.col("h")), language_id.host_of(F.col("u"))).collect()]
    assert got == [("de", "a.b.com:80"), (None, ""), (None, ""), ("fr", "h.org")]

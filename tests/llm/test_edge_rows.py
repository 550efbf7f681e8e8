"""Every query of the dealt operators, and every pipeline stage, on a folder of rows that are hard to handle."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from mnemoframe.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
#: Columns whose names the operators use inside.
CLASHING = ["_gone", "_row", "fp", "k", "t", "a", "id", "text_language", "kept", "host", "shard", "piece", "start", "component_id", "_changed", "earlier", "later"]


def _documents():
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    one, two = prose(120), prose(90)
    row = lambda i, t, lang="en", source="src1": (i, t, lang, source, None if t is None else len(t))
    return [
        *[row(1, one, "en", "src9")] * 3, row(2, one, "en", "src9"), row(3, one + " more", "en", "src9"), row(4, None), row(5, ""), row(6, " \n\t "), row(7, two, None, None), *[row(None, two)] * 2,
        row(8, prose(40_000), "en", "src9"), row(9, "x" * 300_000), row(10, "é\U0001f600 " * 60, "fr"), row(11, "a"), row(12, "a"), *[row(13, None)] * 2, row(14, "same " * 200, "en", "src2"),
    ]


def _pages():
    body = "<html lang=en><body><article><p>" + "words of an article, " * 30 + "</p></article></body></html>"
    return [*[(1, "http://a.example.com/x", body)] * 2, (2, None, body), (3, "no scheme", None), (4, "", ""), (None, "http://b.example.net/en/", "<p>" * 5_000 + "deep"), (5, "http://c.org", "x" * 200_000)]


def _vectors():
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], i) for i in range(10, 40)]
    nan, inf = float("nan"), float("inf")
    return rows + [rows[0]] * 2 + [(None, [0.5, 0.5, 0.5], None), (1, None, 1), (2, [], 1), (3, [1.0, None, 2.0], 1), (4, [nan, 0.0, 0.0], 1), (5, [0.0, -inf, 0.0], 1), (6, [1.0, 2.0], 1), (7, [3e38, 0.0, 0.0], 1)]


@pytest.fixture(scope="module", params=["edge", "empty"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    docs, pages = (_documents(), _pages()) if request.param == "edge" else ([], [])
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(pages, PAGES).coalesce(2).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(_vectors() if docs else [], "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    return path, docs, pages


def _ids(rows, name):
    return Counter(r[name] for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, folder):
    path, docs, pages = folder
    rows = queries.QUERIES[name](spark, path).collect()
    op = int(name[2:].split("_")[0])
    if op == 12:
        assert Counter((r.vec_id, r.component) for r in rows) == Counter({(i, c): 3 if i == 10 else 1 for i in [None, *range(10, 40)] for c in (1, 2, 3)} if docs else {})
        return
    wanted = Counter(p[0] for p in pages) if op in (1, 4) else Counter(d[0] for d in docs)
    if op == 7:
        assert _ids([r for r in rows if r.is_page], "page_id") == Counter(p[0] for p in pages)
        rows = [r for r in rows if not r.is_page]
    key = "page_id" if op in (1, 4) else "doc_id"
    found = _ids([r for r in rows if op not in (10, 13) or r.start == 0] if op != 6 else rows, key)
    if op == 6:  # one or two segmentations of each row
        assert set(found) == set(wanted) and all(n <= found[i] <= 2 * n for i, n in wanted.items())
    else:
        assert found == wanted
    # rows alike in the columns read come out alike, but for their places in sequences
    if op not in (6, 10, 13):
        names = [c for c in rows[0].asDict()] if rows else []
        ones = [tuple(r[c] for c in names) for r in rows if r[key] == 1]
        assert len(set(ones)) <= 1


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_with_clashing_names(stage, spark, folder):
    from pyspark.sql import functions as F

    path, docs, _ = folder
    table = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(7) for c in CLASHING})
    out = dict(corpus_pipeline.STAGES)[stage](spark, table, path)
    rows = out.collect()
    if stage == "best_fit_packing":
        assert _ids([r for r in rows if r.piece == 0], "doc_id") == Counter(d[0] for d in docs)
        return
    assert out.columns == table.columns
    assert all(r[c] == 7 for r in rows for c in CLASHING)
    had = Counter(d[0] for d in docs)
    kept = _ids(rows, "doc_id")
    if stage == "line_dedup":
        assert kept == had
    elif stage == "simhash_near_dedup":  # one row of each group
        assert all(n <= had[i] for i, n in kept.items()) and {4, 5, 6, 13} & set(kept) or not docs
        assert kept[1] + kept[2] + kept[3] == (1 if docs else 0)
        assert kept[7] + kept[None] <= (3 if docs else 0)
    else:  # equal rows are judged alike
        assert all(n == had[i] for i, n in kept.items())


def test_pipeline(spark, folder):
    path, docs, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.doc_id] += r.length
    assert set(sizes) <= {d[0] for d in docs}
    if docs:  # the copies of 1 are emptied by line dedup, and their rows are near copies of nothing
        assert sizes[1] > 100 and sizes[8] > 40_000 and sizes[2] + sizes[3] < 10

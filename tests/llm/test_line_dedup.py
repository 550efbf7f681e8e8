import random

from mnemoframe.llm import line_dedup as L


def windows(text, n=50):
    w = text.split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def repeated(texts):
    """Documents that hold a window of an earlier one."""
    own, out = {}, set()
    for i in sorted(texts):
        for x in windows(texts[i]):
            if own.setdefault(x, i) != i:
                out.add(i)
    return out


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_passages_go_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = L.dedup_lines(docs, n_chars="n_chars").collect()
    after = {r.doc_id: r.text for r in rows}
    dirty = repeated(before)
    assert dirty and not repeated(after)
    assert all(after[i] == before[i] for i in before if i not in dirty)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows if r._ld_blocks} == dirty


def test_inner_passages_order_and_periods():
    rng = random.Random(4)
    p, q = words(rng, 60), words(rng, 70)
    a, b = words(rng, 20) + p + words(rng, 33) + q + words(rng, 9), words(rng, 5) + q + words(rng, 41) + p
    enc = lambda ws: [w.encode() for w in ws]
    assert L.common_blocks(enc(a), enc(b)) == [(5, 75), (116, 176)]  # in other order, both go
    assert L.common_blocks(enc(a), enc(words(rng, 300))) == []
    assert L.common_blocks(enc(p[:49]), enc(p[:49] + words(rng, 5))) == []
    assert L.common_blocks(enc(["is", "so"] * 150), enc(["is", "so"] * 170 + p)) == [(0, 300)]
    assert L.common_blocks(enc(p), enc(p)) == [(0, 60)]


def test_deletion_keeps_lines():
    assert L.delete(b"one two\nthree four five\nsix", [(8, 23)]) == b"one two\nsix"
    assert L.delete(b"one two three", [(4, 7)]) == b"one three"
    assert L.delete(b"a\n\nb", []) == b"a\n\nb"
    assert L.delete(b"a b", [(0, 3)]) == b""


def test_edges(spark):
    rng = random.Random(5)
    p = " ".join(words(rng, 80))
    long = " ".join(words(rng, 30000))
    rows = [(1, p), (2, "x " + p + " y"), (2, "x " + p + " y"), (3, None), (4, ""), (None, p), (5, long), (6, long + " end"), (7, p.replace(" ", "\n"))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, a long")
    got = {r.a: r for r in L.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    assert [got[i].text for i in range(9)] == [p, "x y", "x y", None, "", p, long, "end", ""]
    assert got[7]._ld_words == 30000
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(6)
    for _ in range(50):
        p = words(rng, 50)
        h = [set(L.winnow(L.line_hashes([w.encode() for w in words(rng, rng.randrange(90)) + p + words(rng, rng.randrange(90))]), L.MIN_WORDS - L.WIDTH + 1).tolist()) for _ in range(2)]
        assert h[0] & h[1]


def test_every_copy_meets_a_whole_holder(spark):
    """A first holder of 49 words of each passage hides it from no later copy."""
    rng = random.Random(9)
    rows, want = [], {}
    for g in range(12):
        p = words(rng, 51)
        for part in (p[:49], p, p, p):
            i = len(rows)
            head, tail = words(rng, 20), words(rng, 20)
            rows.append((i, " ".join(head + part + tail)))
            want[i] = " ".join(head + tail) if i % 4 > 1 else rows[-1][1]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == want


def test_further_copies_of_a_passage_go():
    rng = random.Random(10)
    enc = lambda ws: [w.encode() for w in ws]
    p, q, x, y = words(rng, 55), words(rng, 50), words(rng, 20), words(rng, 9)
    assert L.common_blocks(enc(p + y), enc(p + x + p + y[::-1] + p)) == [(0, 55), (75, 130), (139, 194)]
    assert L.common_blocks(enc(q[:40] + x + q[10:] + y + q), enc(y[::-1] + q)) == [(9, 59)]  # pieces of the passage come first
    assert L.common_blocks(enc(["is", "so"] * 150), enc(["is", "so"] * 350 + x)) == [(0, 300), (300, 700)]


def surplus(texts, least=5):
    """Lines of ``least`` words that a document shares with an earlier one, by document."""
    first, out = {}, {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            if len(line.split()) >= least and first.setdefault(line.strip(), i) != i:
                out.setdefault(i, []).append(line.strip())
    return out


def test_real_lines_go_from_later_documents(spark):
    """Rare lines through pairs and boilerplate through its hashes, both against a plain pass over all lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r.text for r in L.dedup_lines(docs, line_words=5).collect()}
    assert len(surplus(before)) > 50 and not surplus(after) and not repeated(after)
    dirty = repeated(before) | set(surplus(before))
    assert all(after[i] == before[i] for i in before if i not in dirty)
    kept = lambda texts: {x.strip() for t in texts.values() for x in t.split("\n") if len(x.split()) >= 5}
    passages = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    assert kept(after) >= kept(passages) & kept(before)  # no line is lost altogether


def test_a_licence_line_stays_once(spark, monkeypatch):
    rng = random.Random(8)
    licence, rare, short = " ".join(words(rng, 20)), " ".join(words(rng, 7)), "four words are short"
    text = lambda i: "\n".join([" ".join(words(rng, 30)), short, *([f"  {licence}\t"] if i < 20 else []), *([rare] if i in (3, 9) else []), " ".join(words(rng, 12))])
    rows = {i: text(i) for i in range(25)}
    for bound in (1, 10, 100):  # all boilerplate, as given, all by pairs
        monkeypatch.setattr(L, "RARE_DOCS", bound)
        got = {r.doc_id: r for r in L.dedup_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), line_words=5).collect()}
        assert [i for i, r in got.items() if licence in r.text] == [0] and [i for i, r in got.items() if rare in r.text] == [3]
        assert all(short in r.text for r in got.values())
        assert got[9]._ld_words == 27 and got[5]._ld_words == 20 and got[24]._ld_words == 0
        assert all(got[i].text == rows[i] for i in (0, *range(20, 25)))


def test_word_hashes_do_not_depend_on_place_or_stretch(monkeypatch):
    text = b"\x0b one\ttwo  " + b"x" * 70 + b"\nthree \xc3\xa9t\xc3\xa9\x00 four\r"
    monkeypatch.setattr(L, "STRETCH", 16)  # a long word is a stretch of its own
    starts, ends = L.word_spans(text)
    assert [text[s:e] for s, e in zip(starts, ends)] == text.split()
    small = L.run_hashes(L.text_sums(text), 2).tolist()
    monkeypatch.undo()
    assert small == L.run_hashes(L.text_sums(b" ".join(text.split())), 2).tolist() and len(set(small)) == 5
    assert [len(x) for x in L.word_spans(b"")] == [0, 0] and len(L.run_hashes(L.text_sums(b" \n"), 1)) == 0

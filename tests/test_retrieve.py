import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import store

STORE = "user_id string, seq long, raw_id string, text string"


def data(spark, n=1500):
    """Records and queries of few common and many rare words, two users of different size, ties and repeated texts."""
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "a", "in"]) if rng.random() < 0.6 else f"w{int(rng.paretovariate(0.6)) % 400}"
    rows = [(rng.choice("uuuv"), i, f"m{i}", " ".join(word() for _ in range(rng.randrange(1, 14)))) for i in range(n)]
    asked = [(i, rng.choice("uv"), " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(99, "nobody", "the"), (100, "u", "The of AND a in"), (101, "u", None)]
    return spark.createDataFrame(rows, STORE), spark.createDataFrame(asked, "query_id long, user_id string, query string"), rows, asked


def test_plans_agree_with_brute_force(spark):
    s, q, rows, asked = data(spark)
    want = {}
    for i, user, query in asked:
        words = set((query or "").lower().split())
        own = sorted((-len(words & set(t.split())), seq) for u, seq, _, t in rows if u == user)[:5]
        want[i] = [(seq, -x) for x, seq in own]
    for plan in ("join", "bounded"):
        got = {i: [] for i, _, _ in asked}
        for r in store.retrieve(s, q, 5, plan).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.seq, r.score))
        assert got == want


def test_common_words_are_not_joined(spark):
    """The join reads far fewer postings, and a query of common words alone keeps what it needs."""
    s, q, _, _ = data(spark, 4000)
    words = lambda c: F.explode(store._words(F.col(c))).alias("word")
    postings = s.select("user_id", "seq", words("text"))
    every = q.select("query_id", "user_id", words("query")).join(postings, ["user_id", "word"]).count()
    needed = store.essential_tokens(s, postings, q, 5)
    assert needed.join(postings, ["user_id", "word"]).count() < 0.5 * every
    assert needed.filter("query_id = 100").count() >= 1


@pytest.mark.parametrize("limit,plan", [(10, "bounded"), (10_000, "join")])
def test_plan_follows_the_size(spark, monkeypatch, limit, plan):
    monkeypatch.setattr(store, "PLAIN_RECORDS", limit)
    used = []
    for name in ("_by_every_token", "_by_bounds"):
        f = getattr(store, name)
        monkeypatch.setattr(store, name, lambda *a, f=f, name=name: used.append(name) or f(*a))
    s, q, _, _ = data(spark, 50)
    assert store.retrieve(s, q, 2).count() > 0
    assert used == [{"bounded": "_by_bounds", "join": "_by_every_token"}[plan]]


@pytest.mark.parametrize("lot", [40, 16_384])
def test_lots_of_records_and_queries(spark, monkeypatch, lot):
    """Users cut into lots and users that share one, ids that are structs: what the join on every token gives."""
    monkeypatch.setattr(store, "RECORD_LOT", lot)
    monkeypatch.setattr(store, "QUERY_LOT", max(3, lot // 4))
    s, q, _, _ = data(spark, 400)
    q = q.withColumn("query_id", F.struct("query_id", F.lit("x").alias("y")))
    rows = lambda plan: sorted((r.query_id.query_id, r["rank"], r.seq, r.score) for r in store.retrieve(s, q, 3, plan).collect())
    assert rows("bounded") == rows("join")


@pytest.mark.parametrize("cells", [1, 200])
def test_counting_in_small_steps(monkeypatch, cells):
    import pyarrow as pa

    rng = random.Random(4)
    some = lambda n: rng.sample([f"w{i}" for i in range(30)], n)
    left = pa.table({"query_id": list(range(20)), "user_id": [rng.choice("uv") for _ in range(20)], "needed": [some(rng.randrange(6)) for _ in range(20)], "rest": [[] for _ in range(20)], "left_out": [0] * 20, "floor": [rng.randrange(3) for _ in range(20)]}, pa.schema([("query_id", pa.int64()), ("user_id", pa.string()), ("needed", pa.list_(pa.string())), ("rest", pa.list_(pa.string())), ("left_out", pa.int64()), ("floor", pa.int64())]))
    right = pa.table({"user_id": [rng.choice("uvw") for _ in range(80)], "seq": rng.sample(range(200), 80), "words": [some(rng.randrange(9)) for _ in range(80)]})
    monkeypatch.setattr(store, "CELLS", cells)
    monkeypatch.setattr(store, "SHARED", cells)
    got = {}
    for r in store._best(left, right, 4).to_pylist():
        got.setdefault(r["query_id"], []).append((-r["score"], r["seq"]))
    for q in left.to_pylist():
        own = sorted((-x, r["seq"]) for r in right.to_pylist() if r["user_id"] == q["user_id"] and (x := len({*q["needed"]} & {*r["words"]})) >= max(1, q["floor"]))
        assert got.get(q["query_id"], []) == own[:4]


def test_every_first_turn_is_a_query(spark, small):
    """The registered query and its SQL ask for all conversations, not for some."""
    from mnemoframe.queries import ORACLES, QUERIES, _t

    from tests.oracle import connect

    want = sorted(r.conv_id for r in _t(spark, small, "conversations").filter("turn = 0").collect())
    assert len(want) > 10
    assert sorted(r.conv_id for r in QUERIES["topk_lexical_bounded"](spark, small).select("conv_id").distinct().collect()) == want
    assert sorted(x for (x,) in connect(small).execute(f"SELECT DISTINCT conv_id FROM ({ORACLES['topk_lexical_bounded']})").fetchall()) == want


def test_records_without_text(spark):
    s = spark.createDataFrame([("u", 0, None), ("u", 1, "a b"), ("u", 2, " "), ("u", 3, "b c"), ("v", 4, None)], "user_id string, seq long, text string")
    q = spark.createDataFrame([(1, "u", "b c"), (2, "v", "b"), (3, "u", " ")], "query_id long, user_id string, query string")
    rows = lambda plan: sorted((r.query_id, r["rank"], r.seq, r.score) for r in store.retrieve(s, q, 2, plan).collect())
    assert rows("bounded") == rows("join") == [(1, 1, 3, 2), (1, 2, 1, 1), (2, 1, 4, 0), (3, 1, 0, 0), (3, 2, 1, 0)]


@pytest.mark.parametrize("dense,matrix", [(0, 1 << 26), (0.05, 1 << 26), (0, 600), (2, 0)])
@pytest.mark.parametrize("cells", [50, 1 << 20])
def test_common_and_rare_tokens(monkeypatch, dense, matrix, cells):
    """All tokens in the matrices, some, none: the same scores; many ties, several users, users of one side only."""
    import pyarrow as pa

    rng = random.Random(5)
    some = lambda n: rng.sample([f"w{i}" for i in range(12)] + [f"r{i}" for i in range(60)], n)
    left = pa.table({"query_id": list(range(40)), "user_id": [rng.choice("uvx") for _ in range(40)], "needed": [some(rng.randrange(9)) for _ in range(40)], "floor": [rng.randrange(4) for _ in range(40)]}, pa.schema([("query_id", pa.int64()), ("user_id", pa.string()), ("needed", pa.list_(pa.string())), ("floor", pa.int64())]))
    right = pa.table({"user_id": [rng.choice("uuvw") for _ in range(300)], "seq": rng.sample(range(999), 300), "words": [some(rng.randrange(30)) for _ in range(300)]})
    monkeypatch.setattr(store, "DENSE", dense)
    monkeypatch.setattr(store, "MATRIX", matrix)
    monkeypatch.setattr(store, "CELLS", cells)
    got = {}
    for r in store._best(left, right, 3).to_pylist():
        got.setdefault(r["query_id"], []).append((-r["score"], r["seq"]))
    for q in left.to_pylist():
        own = sorted((-x, r["seq"]) for r in right.to_pylist() if r["user_id"] == q["user_id"] and (x := len({*q["needed"]} & {*r["words"]})) >= max(1, q["floor"]))
        assert got.get(q["query_id"], []) == own[:3]

"""Hand-computed cases of the metrics."""

import pytest
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.operators import aggregate, match, score
from mnemoframe.schemas import FACT, PROBE, SNAPSHOT
from mnemoframe.sources import files

BANK = [("f_1", "user", "allergic_to", "peanuts", None), ("f_2", "user", "lives_in", "pune", None), ("f_3", "user", "works_at", "infosys", None), ("f_4", "user", "speaks", "marathi", None), ("f_5", "user", "pet", "golden_retriever", None)]
STORE = ["User has peanut allergy", "Lives in Pune city", "Works at Infosys", "Infosys is the employer", "Has a Golden-Retriever"]


def facts(spark, rows, updates=None):
    items = [{"id": i, "domain": "d", "entity": e, "relation": r, "value": v, "distractor_of": of, **({"update": {"updated_value": updates[i]}} if i in (updates or {}) else {})} for i, e, r, v, of in rows]
    return files.facts_frame(spark, items)


def store(spark, texts, snapshot="plant", seed=1):
    return spark.createDataFrame([("e", seed, snapshot, i, f"m{i}", t, "en", {}) for i, t in enumerate(texts)], SNAPSHOT)


def probe(spark, rows, phase="probe"):
    """rows: (fact_id, retrieved texts, response, hit_strict)"""
    return spark.createDataFrame([("e", 1, phase, i, f, "en", "en", [("", t, "", {}) for t in r], a, h, False, (1, 0.0)) for i, (f, r, a, h) in enumerate(rows)], PROBE)


def runs(spark):
    return spark.createDataFrame([("e", 1)], "exp string, seed int")


@pytest.mark.parametrize("plan", ["nested", "automaton", "tokens"])
def test_write_fidelity_and_duplication(spark, plan):
    f, m = facts(spark, BANK), store(spark, STORE)
    found = score.matches(f, m, plan)
    assert score.write_fidelity(f, found, runs(spark)).first().write_fidelity == pytest.approx(0.8)
    assert sorted(r.id for r in score.written_facts(f, found).collect()) == ["f_1", "f_2", "f_3", "f_5"]
    assert score.duplication_rate(f, found, score.scored_store(found, m), runs(spark)).first().duplication_rate == pytest.approx(0.2)


def test_recall_over_eligible_facts(spark):
    f, m = facts(spark, BANK), store(spark, STORE)
    p = probe(spark, [("f_1", ["x", "peanut"], "", False), ("f_2", ["nothing"], "", False), ("f_2", ["in pune"], "", False), ("f_3", [], "", True), ("f_5", ["a", "b", "c", "d", "e", "golden retriever"], "", False)])
    found = score.matches(f, m)
    r = score.recall(f, p, score.written_facts(f, found), runs(spark)).first()
    # the last probe of f_2 counts; f_3 was judged a hit; f_5's record comes sixth
    assert (r.recall_at_1_strict, r.recall_at_3_strict, r.recall_at_5_strict) == (0.5, 0.75, 0.75)
    assert (r.recall_at_1_lenient, r.recall_at_5_lenient) == (0.25, 0.5)
    everything = f.selectExpr("'e' AS exp", "1 AS seed", "id", "seq")
    assert score.recall(f, p, everything, runs(spark)).first().recall_at_3_strict == pytest.approx(0.6)


def false_merges(spark, rows, texts):
    f, m = facts(spark, rows), store(spark, texts)
    found = score.matches(f, m)
    return score.false_merge_rate(f, found, m, score.scored_store(found, m), runs(spark)).first().false_merge_rate


def test_false_merges(spark):
    shift = [("f_1", "user", "allergic_to", "peanuts", None), ("f_1_dist", "user_sister", "allergic_to", "peanuts", "f_1")]
    assert false_merges(spark, shift, ["user has peanut allergy", "sister has peanut allergy"]) == 0.0
    assert false_merges(spark, shift, ["the user and the sister: peanuts"]) == 1.0
    other = [("f_1", "user", "likes", "apple", None), ("f_1_dist", "user", "likes", "orange", "f_1")]
    assert false_merges(spark, other, ["apple and orange"]) == 1.0
    assert false_merges(spark, other, ["apple", "orange"]) == 0.0
    assert false_merges(spark, [BANK[0]], STORE) == 0.0


def test_staleness(spark):
    f = facts(spark, [("f_2", "user", "lives_in", "Pune", None)], {"f_2": "Mumbai"})
    for answer, want in (("You live in Pune and Mumbai.", 1.0), ("You live in Mumbai.", 0.0), ("No idea.", 1.0)):
        assert score.staleness_rate(f, probe(spark, [("f_2", [], answer, False)], "reprobe"), runs(spark)).first().staleness_rate == want
    assert score.staleness_rate(f, probe(spark, [("f_9", [], "", False)], "reprobe"), runs(spark)).first().staleness_rate == 0.0
    silent = score.staleness_rate(f, probe(spark, []), runs(spark)).first()
    assert silent.staleness_rate is None and "staleness_rate" in silent.invalid_metrics
    none = score.staleness_rate(facts(spark, BANK), probe(spark, []), runs(spark)).first()
    assert none.staleness_rate == 0.0 and none.invalid_metrics is None


def test_empty_inputs_and_snapshots(spark):
    empty = spark.createDataFrame([], FACT)
    s = score.score_runs(empty, store(spark, STORE), probe(spark, []), runs(spark)).first()
    assert s.write_fidelity == s.duplication_rate == s.false_merge_rate == s.recall_at_5_strict == s.staleness_rate == 0.0
    f = facts(spark, BANK)
    both = store(spark, STORE).unionByName(store(spark, ["pune"], "final", 2)).unionByName(store(spark, STORE, "plant", 2))
    picked = {r.seed: r.snapshot for r in score.scored_store(score.matches(f, both), both).collect()}
    assert picked == {1: "plant", 2: "final"}  # no final rows: the snapshot after planting


def test_language_gaps(spark):
    rows = spark.createDataFrame([(0.90, True), (0.86, True), (0.65, False), (0.71, False)], "recall double, same_lang boolean")
    assert score.language_transfer_gap(rows).first().ltg == pytest.approx(0.20)
    assert score.language_transfer_gap(rows.filter("same_lang")).first().ltg == 0.0
    by = spark.createDataFrame([("hi", 0.60), ("en", 0.75)], "lang string, recall double")
    assert score.encoding_asymmetry(by).first().encoding_asymmetry == pytest.approx(-0.15)


def test_seed_aggregates(spark):
    scores = spark.createDataFrame([("e", 1, 0.4, 0.2), ("e", 2, 0.5, 0.3), ("e", 3, 0.6, None), ("one", 1, 0.7, None)], "exp string, seed int, write_fidelity double, staleness_rate double")
    a = {(r.exp, r.metric): r for r in aggregate.aggregate_seeds(aggregate.metrics_long(scores)).collect()}
    assert a["e", "write_fidelity"].mean == pytest.approx(0.5) and a["e", "write_fidelity"].n_seeds == 3 and a["e", "write_fidelity"].reportable
    assert a["e", "staleness_rate"].mean == pytest.approx(0.25) and a["e", "staleness_rate"].n_seeds == 2
    assert a["one", "write_fidelity"].std == 0.0 and ("one", "staleness_rate") not in a
    table = {r.Metric: r.Reported for r in aggregate.results_table(aggregate.aggregate_seeds(aggregate.metrics_long(scores))).filter("Experiment = 'e'").collect()}
    assert table["write_fidelity"] == "0.500 ± 0.100"


def test_plans_agree(spark):
    """Random keys and texts under all three plans; several keys of one id count once."""
    import random

    rng = random.Random(7)
    word = lambda: rng.choice(["ab", "abc", "bc", "c", "cab", "zz"])
    keys = spark.createDataFrame([(i // 2, " ".join(word() for _ in range(rng.randrange(0, 5)))) for i in range(60)], "key_id long, key string")
    texts = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randrange(0, 12)))) for i in range(80)], "text_id long, normal string")
    want = sorted({(k.key_id, t.text_id) for k in keys.collect() if k.key for t in texts.collect() if k.key in t.normal})
    for plan in ("nested", "automaton", "tokens", "auto"):
        assert sorted(map(tuple, match.contains_join(keys, texts, plan).collect())) == want


def test_an_index_is_read_without_a_shuffle(spark, small):
    from mnemoframe.operators import match

    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = docs.select(F.col("doc_id").alias("text_id"), X.normalize(F.col("text")).alias("normal"))
    b = spark.read.parquet(f"{small}/benchmark.parquet")
    keys = b.select(F.col("item_id").alias("key_id"), X.normalize(F.col("text")).alias("key")).unionByName(spark.createDataFrame([(1000, "a"), (1001, "of the"), (1002, "no such words there")], "key_id long, key string"))
    index = match.build_index(texts, 3)
    try:
        pairs = lambda t: sorted(map(tuple, match.contains_join(keys, t, "tokens").collect()))
        assert pairs(index) == pairs(texts) and len(pairs(index)) > 10
        by_word = index.words.groupBy("word").count().join(index.often.hint("merge"), "word")
        assert "Exchange" not in by_word._jdf.queryExecution().executedPlan().toString()
    finally:
        index.drop()
    assert not spark.catalog.tableExists(index.tables[0])


def test_texts_are_not_read_for_short_keys_where_there_are_none(spark, monkeypatch):
    from mnemoframe.operators import match

    texts = spark.createDataFrame([(1, "one two three four"), (2, "two three"), (3, "zero one two three")], "text_id long, normal string")
    keys = spark.createDataFrame([(1, "one two three"), (2, "no one here")], "key_id long, key string")
    used = []
    plain = match._automaton
    monkeypatch.setattr(match, "_automaton", lambda *a: used.append(a) or plain(*a))
    assert sorted(map(tuple, match.contains_join(keys, texts, "tokens").collect())) == [(1, 1), (1, 3)] and not used
    keys = keys.unionByName(spark.createDataFrame([(3, "wo")], "key_id long, key string"))
    assert sorted(map(tuple, match.contains_join(keys, texts, "tokens").collect())) == [(1, 1), (1, 3), (3, 1), (3, 2), (3, 3)] and len(used) == 1

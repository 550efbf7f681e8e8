"""Store, runner, files, streaming and command line, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from mnemoframe import cli
from mnemoframe.config import RunConfig, allowed_url
from mnemoframe.operators import mitigation, script, store, vectors
from mnemoframe.plans import experiments
from mnemoframe.sources import files
from mnemoframe.streaming import run_log


def turns(spark, texts):
    return spark.createDataFrame([(i, 1, "user", "en", t, "plant", f"f{i}") for i, t in enumerate(texts)], "seq long, session_id int, role string, lang string, text string, kind string, fact_id string")


def test_store_contract(spark):
    s = store.write(store.empty(spark), turns(spark, [f"text {i}" for i in range(10)] + ["text 0", "text 3"]), "u")
    assert s.count() == 12
    s = store.write(s, turns(spark, ["other"]), "v")
    kept = store.consolidate(s)
    assert kept.count() == 11 and sorted(r.seq for r in kept.filter("user_id = 'u'").collect()) == list(range(10))
    assert store.reset(s, "u").count() == 1
    more = store.update(s, turns(spark, ["text 1"]), "u").filter("user_id = 'u'")
    assert more.count() == 13 and more.agg(F.max("seq")).first()[0] == 12
    assert store.latest(more).filter("text = 'text 1'").first().seq == 12


def test_retrieve_ranks_by_overlap_then_order(spark):
    s = store.write(store.empty(spark), turns(spark, ["a b", "x", "b a c", "y", "A", "z", "w"]), "u")
    q = spark.createDataFrame([(1, "u", "a c"), (2, "u", ""), (3, "nobody", "a")], "query_id long, user_id string, query string")
    got = {}
    for r in store.retrieve(s, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.text, r.score))
    assert got[1] == [("b a c", 2), ("a b", 1), ("A", 1), ("x", 0), ("y", 0)]
    assert [t for t, _ in got[2]] == ["a b", "x", "b a c", "y", "A"] and 3 not in got


def test_vectors(spark):
    rows = [(i, [float(i % 3 == j) + 0.01 * i * j for j in range(3)]) for i in range(12)]
    base = spark.createDataFrame(rows, "base_id long, vector array<double>")
    q = base.filter("base_id < 3").withColumnRenamed("base_id", "query_id")
    got = vectors.top_k(q, base, 2).collect()
    assert len(got) == 6 and all(r.base_id % 3 == r.query_id % 3 and r.base_id != r.query_id for r in got)
    assert vectors.top_k(q.limit(0), base).count() == 0
    e = vectors.mock_embeddings(spark.createDataFrame([("a",), ("a",), ("b",)], "text string")).collect()
    assert e[0].embedding == e[1].embedding != e[2].embedding and abs(sum(x * x for x in e[0].embedding) - 1) < 1e-4


def test_native_store_stands_in_offline(spark, tmp_path):
    facts = files.facts_frame(spark, experiments.SMOKE_FACTS[:2])
    config = RunConfig("away", framework="letta", languages={"store": "en", "probe": "en"}, benchmark={"filler_sessions": 0}, seeds=[1])
    with pytest.raises(ValueError, match="external store"):
        experiments.run_experiment(spark, config, f"file://{tmp_path}/runs", facts)
    assert not (tmp_path / "runs").exists()
    experiments.run_experiment(spark, config, f"file://{tmp_path}/runs", facts, offline=True)
    lines = [json.loads(x) for x in (tmp_path / "runs/exp=away/seed=1/run_log.jsonl").read_text().splitlines()]
    assert lines[0]["framework"] == "letta"
    assert [x["record_type"] for x in lines].count("probe_result") == 2


def test_all_seeds_in_one_plan(spark):
    """The runs of several seeds together are the runs of each, and the plan is as deep for five as for one."""
    from mnemoframe.operators import runner

    facts = files.facts_frame(spark, experiments.SMOKE_FACTS + [experiments.SMOKE_FACTS[i] | {"id": f"d{i}", "distractor_of": f"smoke_{i + 1}", "surface": {"en": f"distractor {i}"}} for i in range(4)])
    together = runner.run_seeds(facts, "e", [11, 22, 33], "en", "en", 3, now=1.0)
    for seed in (11, 33):
        alone = runner.run_seed(facts, "e", seed, "en", "en", 3, now=1.0)
        for name in ("plant", "final", "log"):
            rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
            assert rows(getattr(together, name).filter(F.col("seed") == seed).drop("seed")) == rows(getattr(alone, name))
    depth = lambda seeds: len(script.build_scripts(facts, "en", "en", seeds, 2)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert depth([1, 2, 3, 4, 5]) == depth([1])


def test_fillers_are_those_of_the_standard_generator(spark):
    import random

    facts = files.facts_frame(spark, [*experiments.SMOKE_FACTS, *[experiments.SMOKE_FACTS[0] | {"id": f"d{i}", "distractor_of": "smoke_1", "surface": {"en": f"distractor {i}"}} for i in range(7)]])
    for sessions in (2, 9):
        got = {}
        for r in script.build_scripts(facts, "en", "en", [11, 22, 33], sessions).filter("kind = 'filler'").orderBy("seed", "seq").collect():
            got.setdefault(r.seed, []).append((r.session_id, r.text))
        for seed in (11, 22, 33):
            rng, pool, want = random.Random(seed), list(range(7)), []
            rng.shuffle(pool)
            for step in range(sessions):
                want.append((step + 2, rng.choice(script.FILLERS)["en"]))
                if pool:
                    want.append((step + 2, f"distractor {pool.pop(0)}"))
            assert got[seed] == want


def test_run_score_aggregate(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    facts = files.facts_frame(spark, experiments.SMOKE_FACTS)
    config = RunConfig("demo", languages={"store": "en", "probe": "en"}, benchmark={"filler_sessions": 1}, seeds=[1, 2])
    experiments.run_experiment(spark, config, root, facts)
    lines = [json.loads(x) for x in (tmp_path / "runs/exp=demo/seed=1/run_log.jsonl").read_text().splitlines()]
    kinds = [x["record_type"] for x in lines]
    assert kinds == ["metadata"] + ["turn_trace"] * 6 + ["probe_result"] * 5
    assert lines[0]["n_facts"] == 5 and lines[1]["data"]["write_success"] is True
    assert all(not x["data"]["hit_strict"] and len(x["data"]["retrieved"]) == 5 for x in lines if x["record_type"] == "probe_result")
    before = (tmp_path / "runs/exp=demo/seed=1/run_log.jsonl").read_bytes()
    with pytest.raises(FileExistsError):
        experiments.run_experiment(spark, config, root, facts)
    scores = experiments.score_logs(spark, root, facts)
    assert scores.count() == 2 and {r.write_fidelity for r in scores.collect()} == {1.0} and {r.recall_at_5_strict for r in scores.collect()} <= {0.8, 1.0}
    scores = experiments.score_logs(spark, root, facts)  # scores may be written again, logs stay
    assert scores.count() == 2
    assert (tmp_path / "runs/exp=demo/seed=1/run_log.jsonl").read_bytes() == before
    table = experiments.aggregate_scores(scores, root)
    assert table.filter("Metric = 'write_fidelity' AND Reported = '1.000 ± 0.000' AND N_Seeds = 2").count() == 1
    lines = run_log.record_counts(run_log.read_lines(spark, f"{root}"))
    q = lines.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.seed, r.record_type): r.n for r in spark.sql("SELECT * FROM counts").collect()}[1, "probe_result"] == 5


def test_log_reader_is_lenient(spark, tmp_path):
    d = tmp_path / "e1" / "seed_3"
    d.mkdir(parents=True)
    data = {"fact_id": "f", "store_lang": "en", "probe_lang": "en"}
    (d / "run_log.jsonl").write_text("\n".join(["", json.dumps({"record_type": "reprobe_result", "data": data | {"response": "r", "hit_strict": True}}), "  ", json.dumps({"record_type": "probe_result", "data": data})]))
    log = files.read_log(spark, f"file://{tmp_path}")
    p = {r.phase: r for r in files.probes(log).collect()}
    assert p["probe"].retrieved == [] and p["probe"].response == "" and p["reprobe"].hit_strict and p["reprobe"].seed == 3
    assert files.read_snapshots(spark, f"file://{tmp_path}").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_log(spark, f"file://{tmp_path}/nothing")


def test_decoding(spark, tmp_path):
    (tmp_path / "b.yaml").write_text("facts:\n- {id: f_1, domain: d, entity: e, relation: r, value: v, update: {}, update_data: {updated_value: w}}\n- {id: f_2, domain: d, entity: e, relation: r, value: 5}\n")
    a, b = files.read_facts(spark, str(tmp_path / "b.yaml")).orderBy("seq").collect()
    assert a.update.updated_value == "w" and a.surface == {} and b.update is None and b.value == "5"
    assert files.read_facts(spark, str(tmp_path / "b.yaml"), 1).count() == 1
    (tmp_path / "c.yaml").write_text("x: 1\n")
    with pytest.raises(ValueError):
        files.read_facts(spark, str(tmp_path / "c.yaml"))
    assert len(files.bank_errors([str(tmp_path / "c.yaml"), str(tmp_path / "none.yaml")])) == 2
    assert experiments.facts_or_smoke(spark, str(tmp_path / "none.yaml")).count() == 5


def test_config(tmp_path):
    c = RunConfig("x", languages={"store": "hi", "probe": "en"})
    c.to_yaml(str(tmp_path / "c.yaml"))
    assert RunConfig.from_yaml(str(tmp_path / "c.yaml")) == c
    for bad in ({"framework": "other"}, {"seeds": []}, {"languages": {"store": "xx"}}, {"benchmark": {"n_facts": 0}}, {"model": {"temperature": 3}}):
        with pytest.raises(ValueError):
            RunConfig("x", **bad)
    assert allowed_url("http://localhost:11434") and not allowed_url("https://api.OpenAI.com/v1")


def test_mitigations(spark):
    t = turns(spark, ["namaste", "hello"]).withColumn("lang", F.when(F.col("seq") == 0, "hi").otherwise("en"))
    answers = spark.createDataFrame([(0, " hello there "), (1, "ignored")], "seq long, translated string")
    assert [r.text for r in mitigation.normalize_turns(t, answers).orderBy("seq").collect()] == ["hello there", "hello"]
    m = spark.createDataFrame([(0, "m0", "hello there"), (1, "m1", "hello")], "seq long, raw_id string, text string")
    said = spark.createDataFrame([(0, "NO"), (1, "yes, 2")], "seq long, answer string")
    assert [(r.is_duplicate, r.matched_id) for r in mitigation.resolve_by_answer(t, m, said).orderBy("seq").collect()] == [(False, None), (True, "m0")]
    assert [(r.is_duplicate, r.matched_id) for r in mitigation.resolve_by_overlap(t, m).orderBy("seq").collect()] == [(False, None), (True, "m1")]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["smoke", "--out", f"file://{tmp_path}/s", "--store-lang", "en"]) == 0
    assert cli.main(["aggregate", "--runs", f"file://{tmp_path}/s"]) == 0
    (tmp_path / "b.yaml").write_text("facts:\n- {id: f_001, domain: work, entity: e, relation: r, value: v}\n")
    assert cli.main(["validate", str(tmp_path / "b.yaml")]) == 1
    assert "surface missing language(s)" in capsys.readouterr().out

"""Runs as files: the splittable reader of JSON arrays, and the sink with its two-phase commit."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mnemoframe.sources import files, json_arrays, run_sink


def nasty(rng, n):
    text = lambda: "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", "a", "é", "\U0001f600", "\n", " ", '\\"', "\t"]) for _ in range(rng.randrange(40)))
    return [{"raw_id": f"m{i}", "text": text(), "lang_detected": "en", "metadata": {"a": text(), text(): "b"}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii", [True, False])
def test_any_split_reads_alike(spark, tmp_path, monkeypatch, indent, ascii):
    monkeypatch.setattr(json_arrays, "CHUNK", 37)
    records = nasty(random.Random(5), 60)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=ascii), encoding="utf-8")
    size = path.stat().st_size
    # without Spark: every cut of the file, by chained states
    data = path.read_bytes()
    for width in (1, 2, 3, 7, 64, 1000, size):
        state, depth, found = (0, 0), 0, []
        for start in range(0, size, width):
            end = min(start + width, size)
            found += json_arrays._records(f"file://{path}", start, end, state, depth) if width > 3 else []
            _, change, state = json_arrays.scan(data[start:end], state)
            depth += int(change.sum())
        assert (state, depth) == ((0, 0), 0)
        assert width <= 3 or [json.loads(x) for x in found] == records
    got = json_arrays.read(spark, [(0, f"file://{path}", size)], 1000).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(60)) and [json.loads(r.value) for r in got] == records


def test_snapshots_in_small_splits_and_parts(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for exp, seed, n in (("x", 1, 40), ("x", 2, 0), ("y", 1, 25)):
        folder = tmp_path / f"exp={exp}" / f"seed={seed}"
        (folder / "store_final.json").mkdir(parents=True)
        records = nasty(rng, n)
        (folder / "store_after_plant.json").write_text(json.dumps(records, indent=2), encoding="utf-8")
        for i in range(0, n, 10):  # in parts
            (folder / "store_final.json" / f"part-{i // 10:06d}.json").write_text(json.dumps(records[i : i + 10]), encoding="utf-8")
        for snapshot in ("plant", "final"):
            want |= {(exp, seed, snapshot, i): (r["raw_id"], r["text"], r["metadata"]) for i, r in enumerate(records)}
    for split in (500, 1 << 20):
        rows = files.read_snapshots(spark, f"file://{tmp_path}", split).collect()
        assert {(r.exp, r.seed, r.snapshot, r.seq): (r.raw_id, r.text, r.metadata) for r in rows} == want and len(rows) == len(want)


def lines(spark, exp, seed, n):
    store = spark.range(n).select(F.lit(exp).alias("exp"), F.lit(seed).alias("seed"), F.col("id").alias("seq"), F.concat(F.lit("m"), "id").alias("raw_id"), F.concat(F.lit('t"\\{'), "id").alias("text"), F.lit("en").alias("lang_detected"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    log = spark.range(n).select(F.lit(exp).alias("exp"), F.lit(seed).alias("seed"), F.col("id").alias("line"), F.concat(F.lit('{"record_type": "probe_result", "data": {"fact_id": "f'), "id", F.lit('"}}')).alias("value"))
    return files.run_rows(store, store.filter("seq % 2 = 0"), log)


def test_runs_are_written_whole(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    rows = lines(spark, "x", 1, 50).unionByName(lines(spark, "x", 2, 7)).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that files come in several parts
    try:
        files.write_runs(rows, root, [("x", 1), ("x", 2), ("x", 3)])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stores = files.read_snapshots(spark, root)
    assert {(r.seed, r.snapshot): (r.n, r.last) for r in stores.groupBy("seed", "snapshot").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).collect()} == {
        (1, "plant"): (50, 49), (1, "final"): (25, 24), (2, "plant"): (7, 6), (2, "final"): (4, 3),
    }
    assert stores.filter("snapshot = 'plant' AND raw_id <> concat('m', seq)").count() == 0
    log = files.probes(files.read_log(spark, root)).filter("seed = 1").orderBy("line").collect()
    assert [(r.line, r.fact_id) for r in log] == [(i, f"f{i}") for i in range(50)]
    assert (tmp_path / "runs/exp=x/seed=3/store_final.json").read_text() == "[]"
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["exp=x"]
    with pytest.raises(Exception, match="never overwritten"):
        files.write_runs(rows, root, [("x", 1)])
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["exp=x"] and files.read_snapshots(spark, root).count() == 86


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    """A task that fails after it wrote: no run, no staging."""
    root = f"file://{tmp_path}/runs"
    fail = F.when(F.col("pos") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("value"))
    with pytest.raises(Exception, match="lost"):
        files.write_runs(lines(spark, "x", 1, 50).withColumn("value", fail), root, [("x", 1)])
    assert not (tmp_path / "runs").exists() or list((tmp_path / "runs").iterdir()) == []
    files.write_runs(lines(spark, "x", 1, 50), root, [("x", 1)])
    assert files.read_snapshots(spark, root).count() == 75


def test_attempts_that_are_not_named_do_not_count(tmp_path):
    """An attempt killed between its write and the commit, and its repetition: each line once."""
    from pyspark.sql import Row

    rows = [Row(exp="x", seed=1, file="run_log.jsonl", pos=i, value=f'{{"n": {i}}}') for i in range(5)]
    writer = run_sink.RunWriter({"path": f"file://{tmp_path}", "runs": '[["x", 1]]'})
    writer.write(iter(rows))  # killed: nobody hears of it
    second, first = writer.write(iter(rows[3:])), writer.write(iter(rows[:3]))
    assert not (tmp_path / "exp=x").exists()
    writer.commit([second, None, first])
    folder = tmp_path / "exp=x" / "seed=1"
    assert "".join(p.read_text() for p in sorted((folder / "run_log.jsonl").iterdir())) == "".join(r.value + "\n" for r in rows)
    assert [p.name for p in tmp_path.iterdir()] == ["exp=x"]


def test_memory_of_a_split_is_bounded(tmp_path):
    import tracemalloc

    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"raw_id": f"m{i}", "text": "word " * 100} for i in range(8_000)]))
    tracemalloc.start()
    try:
        n = sum(1 for _ in json_arrays._records(f"file://{path}", 0, path.stat().st_size, (0, 0), 0))
        assert n == 8_000 and tracemalloc.get_traced_memory()[1] < 24 << 20
    finally:
        tracemalloc.stop()

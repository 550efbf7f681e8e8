import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from mnemoframe.operators import calls, store
from mnemoframe.plans import adapters


class Counting:
    """Leaves a file for each time it is built and for each call; fails as the request says."""

    def __init__(self, folder):
        self.folder, self.open, self.most = folder, 0, 0
        open(f"{folder}/built-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def call(self, request, request_id):
        seen = len([x for x in os.listdir(self.folder) if x.startswith(f"call-{request_id}")])
        open(f"{self.folder}/call-{request_id}-{uuid.uuid4().hex}", "w").close()
        if "never" in request or "later" in request and seen < 2:
            raise ConnectionError("no answer")
        if request.startswith("{"):
            asked = json.loads(request)
            return json.dumps([] if asked["query"] == "nothing" else [{"raw_id": "s1", "text": f"service {asked['query']}"}])
        return f"answer to {request}"


def test_one_client_a_worker_and_retries(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{'never' if i % 10 == 3 else 'later' if i % 10 == 4 else 'ok'} {i}") for i in range(40)] + [(99, None)], "id long, ask string").repartition(6)
    called = calls.call_rows(rows, "id", "ask", Counting, {"folder": str(tmp_path)}, attempts=3)
    by = {r.id: r for r in called.collect()}
    assert len(by) == 41 and called.filter("error IS NOT NULL").count() == 4
    for i in range(40):
        if i % 10 == 3:
            assert by[i].answer is None and by[i].error == "ConnectionError: no answer" and by[i].attempts == 3
        else:
            assert by[i].answer == f"answer to {by[i].request}" and by[i].attempts == (3 if i % 10 == 4 else 1)
    assert by[99].answer is None and by[99].error is None and by[99].attempts == 0
    files = os.listdir(tmp_path)
    built = [x.split("-")[1] for x in files if x.startswith("built")]
    assert len(built) == len(set(built))  # of each worker process one
    assert len([x for x in files if x.startswith("call")]) == 32 + 4 * 3 + 4 * 3  # reading the result again asked nothing


def test_failed_rows_alone_fall_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ok"), (2, "never"), (3, "ok")], "id long, ask string")
    letters = f"file://{tmp_path}/dead"
    os.makedirs(tmp_path / "c")
    called = calls.call_rows(rows, "id", "ask", Counting, {"folder": str(tmp_path / "c")}, attempts=2)
    asked = []

    def native(failed):
        asked.extend(r.id for r in failed.collect())
        return failed.select("id", F.lit("native").alias("answer"))

    got = {(r.id, r.answer, r.source) for r in calls.with_fallback(called, native, "id", letters).collect()}
    assert got == {(1, "answer to ok", "service"), (3, "answer to ok", "service"), (2, "native", "fallback")} and asked == [2]
    dead = spark.read.parquet(letters)
    assert [(r.id, r.request, r.attempts) for r in dead.collect()] == [(2, "never", 2)]


def test_retrieval_by_a_service(spark, tmp_path):
    memory = spark.createDataFrame([("u", 0, "mem_0", "never a b"), ("u", 1, "mem_1", "nothing")], "user_id string, seq long, raw_id string, text string")
    queries = spark.createDataFrame([(1, "u", "good"), (2, "u", "never a"), (3, "u", "nothing")], "query_id long, user_id string, query string")
    with pytest.raises(ValueError, match="registered: mock"):
        adapters.get("elsewhere")
    adapters.register("Elsewhere", Counting)
    assert adapters.registered() == ["elsewhere", "mock"]
    options = {"arguments": {"folder": str(tmp_path)}, "attempts": 1}
    got = {(r.query_id, r.rank, r.raw_id, r.source) for r in adapters.retrieve(memory, queries, "elsewhere", 1, dead_letters=f"file://{tmp_path}/dead", **options).collect()}
    assert got == {(1, 1, "s1", "elsewhere"), (2, 1, "mem_0", "mock"), (3, 1, "mem_1", "mock")}
    assert adapters.latest_dead_letters(spark.read.parquet(f"file://{tmp_path}/dead")).first().query_id == 2
    assert {r.source for r in adapters.retrieve(memory, queries, k=1).collect()} == {"mock"}
    with pytest.raises(RuntimeError, match="no answer"):
        adapters.retrieve(memory, queries, "elsewhere", 1, offline_fallback=False, **options)
    del adapters._services["elsewhere"]
    assert store.retrieve(memory, queries, 1).count() == 3

"""Calls of external services from tasks: one client a worker, bounded concurrency, retries, dead letters.

A client is any object with ``call(request, request_id)``; it is built by a factory from its
arguments, once in each Python worker of an executor, and shared by all batches and columns that name the same arguments.
The request id is a digest of the row's key and request, the same in every retry and in every repetition
of a lost task, so that a service can tell repetitions apart from new requests.

A row whose call fails ``attempts`` times does not fail the job: its answer is null, and its error is kept.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.plans.lineage import cut

_clients: dict[tuple[str, str], Any] = {}
_lock = threading.Lock()


def client(factory: Callable[..., Any], **arguments: Any) -> Any:
    """The worker's client for these arguments, built when it is first asked for."""
    name = (f"{factory.__module__}.{factory.__qualname__}", json.dumps(arguments, sort_keys=True, default=str))
    with _lock:
        if name not in _clients:
            _clients[name] = factory(**arguments)
        return _clients[name]


def request_id(key: Any, request: str) -> str:
    return hashlib.sha256(f"{key!r}\0{request}".encode()).hexdigest()


def call_rows(
    rows: DataFrame, key: str, request: str, factory: Callable[..., Any], arguments: dict[str, Any] | None = None, attempts: int = 3,
    concurrency: int = 4, pause: float = 0.0,
) -> DataFrame:
    """(key, request, answer, error, attempts): one row for each row of ``rows``, written once, so that nothing is asked again when the result is read again.

    At most ``concurrency`` calls of a task are open at a time; ``pause`` seconds, doubled each time, lie between attempts.  A null request gets no call and no answer.
    """
    arguments = arguments or {}

    def ask(key_: Any, text: str | None) -> tuple[str | None, str | None, int]:
        if text is None:
            return None, None, 0
        error = None
        for n in range(1, attempts + 1):
            try:
                return client(factory, **arguments).call(text, request_id(key_, text)), None, n
            except Exception as e:  # whatever a service raises belongs to the row
                error = f"{type(e).__name__}: {e}"
                if pause and n < attempts:
                    time.sleep(pause * 2 ** (n - 1))
        return None, error, attempts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                found = list(pool.map(ask, b.column(0).to_pylist(), b.column(1).to_pylist()))
                answer, error, n = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(answer, pa.string()), pa.array(error, pa.string()), pa.array(n, pa.int32())],
                    names=["k", "request", "answer", "error", "attempts"],
                )

    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(F.col(key).alias("k"), F.col(request).cast("string").alias("request"))
    return cut(asked.mapInArrow(run, f"k {kind}, request string, answer string, error string, attempts int").withColumnRenamed("k", key))


def with_fallback(called: DataFrame, fallback: Callable[[DataFrame], DataFrame], key: str, dead_letters: str | None = None) -> DataFrame:
    """(key, answer, source): answers of :func:`call_rows`, and for the rows whose call failed what ``fallback`` makes of exactly these.

    ``fallback`` takes (key, request) and returns (key, answer).  Failed rows are appended to the table ``dead_letters`` with their errors.
    """
    failed = called.filter(F.col("error").isNotNull())
    if dead_letters:
        failed.withColumn("failed_at", F.current_timestamp()).write.mode("append").parquet(dead_letters)
    good = called.filter(F.col("error").isNull()).select(key, "answer", F.lit("service").alias("source"))
    return good.unionByName(fallback(failed.select(key, "request")).select(key, "answer", F.lit("fallback").alias("source")))

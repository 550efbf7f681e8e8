"""Memory services by name, and retrieval that falls back to the native store call by call.

A service is a client factory for :mod:`mnemoframe.operators.calls`; its ``call`` takes a JSON object
{user_id, query, k} and returns a JSON array of {raw_id, text}.  The native store needs none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.operators import calls, store

NATIVE = "mock"
_services: dict[str, Callable[..., Any] | None] = {NATIVE: None}


def register(name: str, factory: Callable[..., Any]) -> None:
    """Make a service known; a name that is known already gets the new factory."""
    _services[name.lower()] = factory


def registered() -> list[str]:
    return sorted(_services)


def get(name: str) -> Callable[..., Any] | None:
    """A service's factory, None for the native store."""
    if name.lower() not in _services:
        raise ValueError(f"unknown memory service {name!r}; registered: {', '.join(registered())}")
    return _services[name.lower()]


def retrieve(
    memory: DataFrame, queries: DataFrame, service: str = NATIVE, k: int = 5, arguments: dict[str, Any] | None = None, offline_fallback: bool = True,
    dead_letters: str | None = None, **options: Any,
) -> DataFrame:
    """(query_id, rank, raw_id, text, source) of ``queries`` (query_id, user_id, query), by a service; ``memory`` answers in its stead where a call fails.

    A call that fails or finds nothing falls back; without ``offline_fallback`` a failed call is an error.  Options go to :func:`calls.call_rows`.
    """
    factory = get(service)

    def native(some: DataFrame) -> DataFrame:
        return store.retrieve(memory, some, k).select("query_id", "rank", "raw_id", "text")

    if factory is None:
        return native(queries).withColumn("source", F.lit(NATIVE))
    request = F.to_json(F.struct("user_id", "query", F.lit(k).alias("k")))
    called = calls.call_rows(queries.select("query_id", request.alias("request")), "query_id", "request", factory, arguments, **options)
    failed = called.filter(F.col("error").isNotNull())
    if not offline_fallback and (first := failed.first()) is not None:
        raise RuntimeError(f"{service} failed: {first.error}")
    if dead_letters:
        failed.withColumn("failed_at", F.current_timestamp()).write.mode("append").parquet(dead_letters)
    found = called.filter(F.col("error").isNull()).select("query_id", F.posexplode(F.from_json("answer", "array<struct<raw_id: string, text: string>>")).alias("pos", "m"))
    found = found.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "m.raw_id", "m.text", F.lit(service).alias("source")).filter(F.col("rank") <= k)
    empty = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(native(empty).withColumn("source", F.lit(NATIVE)))


def latest_dead_letters(table: DataFrame, key: str = "query_id") -> DataFrame:
    """The last failure of each key in a table of dead letters: what is to be asked again."""
    w = Window.partitionBy(key).orderBy(F.col("failed_at").desc())
    return table.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

"""Record schemas.  List positions carry meaning in the data model, so every list has an explicit ``seq``."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXTS = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


UPDATE = _struct(updated_value=T.StringType(), surface=_TEXTS, probe_questions=_TEXTS)

FACT = _struct(
    seq=T.LongType(), id=T.StringType(), domain=T.StringType(), entity=T.StringType(), relation=T.StringType(), value=T.StringType(),
    value_aliases=T.MapType(T.StringType(), T.ArrayType(T.StringType())), distractor_of=T.StringType(), surface=_TEXTS, probe_questions=_TEXTS, update=UPDATE,
)

TURN = _struct(seq=T.LongType(), session_id=T.IntegerType(), role=T.StringType(), lang=T.StringType(), text=T.StringType(), kind=T.StringType(), fact_id=T.StringType())

_MEMORY = dict(raw_id=T.StringType(), text=T.StringType(), lang_detected=T.StringType(), metadata=_TEXTS)
MEMORY = _struct(**_MEMORY)
#: A store's rows: the records of all users, in write order.
STORE = _struct(user_id=T.StringType(), seq=T.LongType(), **_MEMORY)
#: Snapshots of all runs.
SNAPSHOT = _struct(exp=T.StringType(), seed=T.IntegerType(), snapshot=T.StringType(), seq=T.LongType(), **_MEMORY)

PROBE_DATA = _struct(
    fact_id=T.StringType(), store_lang=T.StringType(), probe_lang=T.StringType(), retrieved=T.ArrayType(MEMORY), response=T.StringType(),
    hit_strict=T.BooleanType(), hit_lenient=T.BooleanType(), metadata=_struct(tokens=T.LongType(), latency=T.DoubleType()),
)
TRACE_DATA = _struct(
    session_id=T.IntegerType(), kind=T.StringType(), fact_id=T.StringType(), lang=T.StringType(), text=T.StringType(),
    write_success=T.BooleanType(), memory_id=T.StringType(), update_success=T.BooleanType(), updated_memory_id=T.StringType(),
)
#: One line of a run log: the metadata record is flat, the others nest under data.
LOG_LINE = _struct(
    record_type=T.StringType(), timestamp=T.DoubleType(), experiment=T.StringType(), framework=T.StringType(), seed=T.IntegerType(),
    store_lang=T.StringType(), probe_lang=T.StringType(), n_facts=T.IntegerType(),
    data=T.StructType([*PROBE_DATA.fields, *(f for f in TRACE_DATA.fields if f.name not in PROBE_DATA.names)]),
)
#: Probes of all runs; phase is probe or reprobe, line the position in the log.
PROBE = T.StructType([T.StructField("exp", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("phase", T.StringType()), T.StructField("line", T.LongType()), *PROBE_DATA.fields])

METRICS = (
    "write_fidelity", "recall_at_1_strict", "recall_at_3_strict", "recall_at_5_strict", "recall_at_1_lenient", "recall_at_3_lenient",
    "recall_at_5_lenient", "duplication_rate", "false_merge_rate", "staleness_rate",
)

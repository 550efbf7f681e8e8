"""Readers and writers.

Runs lie in ``<root>/exp=<name>/seed=<n>/`` (partition discovery gives exp and
seed) with store_after_plant.json, store_final.json and run_log.jsonl; folders
named ``<name>/seed_<n>/`` are read too.  Run logs are written once and never
again; scores may be rewritten.
"""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.plans import lineage
from mnemoframe.schemas import FACT, LOG_LINE, MEMORY, METRICS, PROBE, SNAPSHOT
from mnemoframe.sources import json_arrays, run_sink

#: A run's file, or a part of it.
SEED_DIR = r"(?:^|/)(?:exp=)?([^/]+)/seed[_=](\d+)/[^/]+(?:/part-[^/]+)?$"


def _yaml(path: str) -> Any:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def _plain(x: Any) -> Any:
    """YAML values as text where a schema wants text."""
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)


def _texts(x: Any) -> dict[str, str]:
    return {str(k): _plain(v) for k, v in (x or {}).items()}


def fact_row(item: dict, seq: int) -> dict:
    """A fact of a bank as a row: of ``update`` and ``update_data`` the first that is not empty counts, missing maps are empty."""
    for name in ("id", "domain", "entity", "relation", "value"):
        if name not in item:
            raise KeyError(name)
    update = item.get("update") or item.get("update_data") or None
    if update is not None:
        update = {"updated_value": _plain(update.get("updated_value")), "surface": _texts(update.get("surface")), "probe_questions": _texts(update.get("probe_questions"))}
    out = {k: _plain(item[k]) for k in ("id", "domain", "entity", "relation", "value")}
    aliases = {str(k): [_plain(x) for x in v] for k, v in (item.get("value_aliases") or {}).items()}
    return out | {"seq": seq, "value_aliases": aliases, "distractor_of": _plain(item.get("distractor_of")), "surface": _texts(item.get("surface")), "probe_questions": _texts(item.get("probe_questions")), "update": update}


def facts_frame(spark: SparkSession, facts: list[dict]) -> DataFrame:
    return spark.createDataFrame([fact_row(x, i) for i, x in enumerate(facts)], FACT)


def _bank_items(path: str) -> list[dict]:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no fact bank at {path}")
    payload = _yaml(path)
    if not isinstance(payload, dict) or "facts" not in payload:
        raise ValueError(f"{path}: the key 'facts' is missing")
    return payload["facts"]


def read_facts(spark: SparkSession, path: str, n_facts: int | None = None) -> DataFrame:
    """A fact bank (YAML, hand-written and small, so read on the driver), in file order; ``n_facts`` keeps the first ones."""
    return facts_frame(spark, _bank_items(path)[:n_facts])


def read_raw_banks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, file_no, seq, raw): items of banks as JSON, for validation."""
    rows = [(p, n, i, json.dumps(x, ensure_ascii=False)) for n, p in enumerate(paths) for i, x in enumerate((_yaml(p) or {}).get("facts", []))]
    return spark.createDataFrame(rows, "file string, file_no int, seq long, raw string")


def read_hand_written(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Facts of several banks with the name of their ``file``; ``seq`` counts within a bank."""
    rows = facts_frame(spark, []).withColumn("file", F.lit(""))
    for p in paths:
        rows = rows.unionByName(read_facts(spark, p).withColumn("file", F.lit(os.path.basename(p))))
    return rows


def bank_errors(paths: list[str]) -> list[tuple[str, str]]:
    """(file, message) of banks that cannot be read at all."""
    out = []
    for p in paths:
        if not os.path.exists(p):
            out.append((p, f"Fact bank not found: {p}"))
        elif not isinstance(payload := _yaml(p), dict) or "facts" not in payload:
            out.append((p, "YAML missing top-level 'facts' key"))
    return out


def read_templates(spark: SparkSession, paths: list[str], entities: str) -> dict[str, DataFrame]:
    """plan, relations, lexicon and entities of domain templates."""
    plan, relations, lexicon = [], [], []
    for path in paths:
        t = _yaml(path)
        d = t["domain"]
        for i, p in enumerate(t["facts"]):
            plan.append((d, i, *[_plain(p.get(k)) for k in ("id", "relation", "entity", "value", "update", "distractor_of")], p.get("batch", 1)))
        for r, spec in t["relations"].items():
            relations.append((len(relations), d, r, *[_texts(spec[k]) for k in ("gender", "statement", "probe", "correction", "reprobe")]))
            lexicon += [(len(lexicon) + i, d, r, _plain(v), _texts(forms)) for i, (v, forms) in enumerate(spec["values"].items())]
    people = [(i, k, *[_plain(e[x]) for x in ("poss_en", "poss_hi_stem", "poss_hien_stem")]) for i, (k, e) in enumerate(_yaml(entities)["entities"].items())]
    m = "map<string,string>"
    return {
        "plan": spark.createDataFrame(plan, "domain string, seq long, id string, relation string, entity string, value string, update string, distractor_of string, batch int"),
        "relations": spark.createDataFrame(relations, f"ord int, domain string, relation string, gender {m}, statement {m}, probe {m}, correction {m}, reprobe {m}"),
        "lexicon": spark.createDataFrame(lexicon, f"ord int, domain string, relation string, value string, forms {m}"),
        "entities": spark.createDataFrame(people, "ord int, entity string, poss_en string, poss_hi_stem string, poss_hien_stem string"),
    }


def write_bank(facts: DataFrame, path: str) -> int:
    """A rendered bank as YAML; an existing file is never overwritten."""
    import yaml

    rows = [x.asDict(recursive=True) for x in facts.orderBy("seq").collect()]
    for x in rows:
        x.pop("seq")
    with open(path, "x", encoding="utf-8") as f:
        yaml.safe_dump({"facts": rows}, f, allow_unicode=True, sort_keys=False)
    return len(rows)


def _place(rows: DataFrame, path_column: str) -> DataFrame:
    p = F.col(path_column)
    return rows.withColumn("exp", F.regexp_extract(p, SEED_DIR, 1)).withColumn("seed", F.regexp_extract(p, SEED_DIR, 2).cast("int"))


def _existing(spark: SparkSession, root: str, name: str) -> list[tuple[str, int]]:
    """(path, bytes) of every run's file of this name; of a folder of parts each part."""
    jvm = spark.sparkContext._jvm
    found = []
    for below in ("", "/part-*"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/seed[_=]*/{name}{below}")
        found += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [(x.getPath().toString(), x.getLen()) for x in found if x.isFile()]


def read_snapshots(spark: SparkSession, root: str, split: int = json_arrays.SPLIT) -> DataFrame:
    """Snapshots of all runs under ``root``, large ones in splits; a missing file is an empty store."""
    stores, listed = {}, []
    for snapshot, name in (("plant", "store_after_plant.json"), ("final", "store_final.json")):
        for path, size in _existing(spark, root, name):
            exp, seed = re.search(SEED_DIR, path).groups()
            listed.append((stores.setdefault((exp, int(seed), snapshot), len(stores)), path, size))
    if not listed:
        return spark.createDataFrame([], SNAPSHOT)
    names = spark.createDataFrame([(i, *x) for x, i in stores.items()], "store int, exp string, seed int, snapshot string")  # one row a file
    rows = json_arrays.read(spark, listed, split).join(lineage.small(names), "store").withColumn("m", F.from_json("value", MEMORY))
    coerced = [F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("raw_id", "text", "lang_detected")]
    return rows.select("exp", "seed", "snapshot", "seq", *coerced, F.coalesce("m.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Log lines (exp, seed, line, value) parsed; blank lines are skipped."""
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", LOG_LINE))
    return rows.select("exp", "seed", "line", "r.record_type", "r.data", F.struct(*[f"r.{c}" for c in LOG_LINE.names if c not in ("record_type", "data")]).alias("header"))


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All run logs under ``root`` as parsed lines, with their positions; at least one log must be there."""
    paths = _existing(spark, root, "run_log.jsonl")
    if not paths:
        raise FileNotFoundError(f"no run log under {root}")
    # a long log lies in parts and is read in pieces: a line's place is that of its part, then of its piece in the part, then its own
    texts = spark.read.option("lineSep", "\n").text([p for p, _ in paths])
    texts = texts.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.monotonically_increasing_id().alias("at"))
    line = F.row_number().over(Window.partitionBy("exp", "seed").orderBy("path", "piece", "at")) - 1
    return parse_log(_place(texts, "path").withColumn("line", line.cast("long")).select("exp", "seed", "line", "value"))


def probes(log: DataFrame) -> DataFrame:
    """Probe and re-probe records of a parsed log; missing lists are empty, missing flags false."""
    rows = log.filter(F.col("record_type").isin("probe_result", "reprobe_result"))
    fields = {f.name: F.col(f"data.{f.name}") for f in PROBE.fields[4:]}
    fields["retrieved"] = F.coalesce(fields["retrieved"], F.array().cast(PROBE["retrieved"].dataType))
    fields["response"] = F.coalesce(fields["response"], F.lit(""))
    for flag in ("hit_strict", "hit_lenient"):
        fields[flag] = F.coalesce(fields[flag], F.lit(False))
    phase = F.when(F.col("record_type") == "probe_result", "probe").otherwise("reprobe")
    return rows.select("exp", "seed", phase.alias("phase"), "line", *[c.alias(n) for n, c in fields.items()])


def runs(log: DataFrame) -> DataFrame:
    return log.select("exp", "seed").distinct()


def ensure_absent(spark: SparkSession, root: str, exp: str, seeds: list[int]) -> None:
    """Raise before anything is written if any of the runs is there."""
    jvm = spark.sparkContext._jvm
    for seed in seeds:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/exp={exp}/seed={seed}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileExistsError(f"run exp={exp} seed={seed} is there already; runs are never overwritten")


def run_rows(plant: DataFrame, final: DataFrame, log: DataFrame) -> DataFrame:
    """The lines (exp, seed, file, pos, value) of runs' files.  ``plant`` and ``final`` are snapshots, ``log`` lines (line, value), each with exp and seed."""
    record = F.to_json(F.struct("raw_id", "text", "lang_detected", "metadata"))
    rows = log.select("exp", "seed", F.lit("run_log.jsonl").alias("file"), F.col("line").alias("pos"), "value")
    for file, store in (("store_after_plant.json", plant), ("store_final.json", final)):
        rows = rows.unionByName(store.select("exp", "seed", F.lit(file).alias("file"), F.col("seq").alias("pos"), record.alias("value")))
    return rows


def write_runs(rows: DataFrame, root: str, runs: list[tuple[str, int]]) -> list[str]:
    """Files of runs from their lines (exp, seed, file, pos, value), each run whole or not at all; returns the folders."""
    spark = rows.sparkSession
    spark.dataSource.register(run_sink.RunSink)
    order = ("exp", "seed", "file", "pos")
    rows = rows.select(F.col("exp").cast("string"), F.col("seed").cast("int"), "file", F.col("pos").cast("long"), "value").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("mnemoframe_runs").option("runs", json.dumps(runs)).mode("append").save(root)
    return [f"{root.rstrip('/')}/{run_sink.run_folder(*x)}" for x in runs]


def write_run(spark: SparkSession, root: str, exp: str, seed: int, plant: DataFrame, final: DataFrame, log: DataFrame) -> str:
    """The two snapshots and the log (line, value) of one run."""
    ensure_absent(spark, root, exp, [seed])
    tagged = [x.withColumns({"exp": F.lit(exp), "seed": F.lit(seed)}) for x in (plant, final, log)]
    return write_runs(run_rows(*tagged), root, [(exp, seed)])[0]


def write_scores(scores: DataFrame, root: str) -> None:
    """Scores of all runs, partitioned by run; rewriting them is allowed and touches no log."""
    scores.write.mode("overwrite").partitionBy("exp", "seed").json(f"{root.rstrip('/')}/scores")


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS] + [T.StructField("invalid_metrics", T.MapType(T.StringType(), T.StringType())), T.StructField("exp", T.StringType()), T.StructField("seed", T.IntegerType())])
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/scores")


def write_results(table: DataFrame, root: str) -> None:
    """The results table as CSV, a folder for each experiment."""
    table.withColumn("exp", F.col("Experiment")).write.mode("overwrite").partitionBy("exp").csv(f"{root.rstrip('/')}/aggregated", header=True)


def write_xlsx(path: str, sheets: dict[str, DataFrame], check: str | tuple[str, ...] = (), notes: dict[str, list[str]] | None = None) -> None:
    """Review sheets as a workbook: frozen header, filter, and the empty columns ``check`` for the reviewer, an OK/Fix choice in the first of them.

    ``notes`` are sheets of plain lines, which come first.  Sheets are short and go through the driver.
    """
    check = (check,) if isinstance(check, str) else check
    from xml.sax.saxutils import escape
    from zipfile import ZIP_DEFLATED, ZipFile

    def name(n: int) -> str:
        return ("" if n < 26 else name(n // 26 - 1)) + chr(65 + n % 26)

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    with ZipFile(path, "x", ZIP_DEFLATED) as z:
        parts = []
        for i, (title, df) in enumerate([*(notes or {}).items(), *sheets.items()], 1):
            note = isinstance(df, list)
            header = [] if note else [*df.columns, *check]
            rows = [[x] for x in df] if note else [header, *[["" if v is None else str(v) for v in r] for r in df.collect()]]
            cells = "".join(
                f'<row r="{r}">' + "".join(f'<c r="{name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v))}</t></is></c>' for c, v in enumerate(row)) + "</row>"
                for r, row in enumerate(rows, 1)
            )
            last = f"{name(len(header) - 1)}{len(rows)}"
            choice = ""
            if check and not note and len(rows) > 1:
                col = name(len(header) - len(check))
                choice = f'<dataValidations count="1"><dataValidation type="list" allowBlank="1" sqref="{col}2:{col}{len(rows)}"><formula1>"OK,Fix"</formula1></dataValidation></dataValidations>'
            pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
            pane, filtered = ("", "") if note else (pane, f'<autoFilter ref="A1:{last}"/>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet {ns}>{pane}<sheetData>{cells}</sheetData>{filtered}{choice}</worksheet>')
            parts.append((i, escape(title[:31], {'"': "&quot;"})))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{t}" sheetId="{i}" r:id="rId{i}"/>' for i, t in parts) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i, _ in parts) + "</Relationships>")
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i, _ in parts)
        z.writestr(
            "[Content_Types].xml",
            f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
        )

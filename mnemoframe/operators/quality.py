"""Validation of fact banks: issues as DataFrames, one rule each.

A bank is read as raw items, (file, seq, raw) with ``raw`` the item as JSON, since
several rules tell an absent key (fails) from an explicit null (reads as "None"
and passes).  Issues are (file, seq, rule, fact_id, severity, message); their
order is (file, seq, rule).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.plans.lineage import cut

# Fixed values.
DOMAINS = ["dining", "family", "finance", "health", "hobbies", "tech", "travel", "work"]
BASE_ID = r"^f_[0-9]{3}\n?$"
DISTRACTOR_ID = r"^f_[0-9]{3}_dist[0-9]*\n?$"
LANGS = ["en", "hi", "hi-en"]
UPDATE_LANGS = ["en", "hi"]
REQUIRED = ["domain", "entity", "relation", "value"]
DISTRACTOR_RATIO = 0.30

_MAP = "map<string,string>"


def _text(name: str, absent: str) -> Column:
    """A field as text: ``absent`` if the key is missing, None if it is null."""
    value = F.coalesce(F.get_json_object("raw", f"$.{name}"), F.lit("None"))
    return F.when(F.array_contains("names", name), value).otherwise(F.lit(absent))


def items(raw: DataFrame) -> DataFrame:
    """Raw items with the fields that the rules use."""
    out = raw.withColumn("names", F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))
    get = lambda path: F.get_json_object("raw", f"$.{path}")
    return out.select(
        "file", "seq", "names", "raw",
        _text("id", "<missing-id>").alias("fid"), _text("id", "").alias("id"),
        *[_text(f, "").alias(f) for f in REQUIRED],
        *[get(f).alias(f"{f}_or_null") for f in REQUIRED],
        get("distractor_of").alias("distractor_of"),
        get("update").alias("update"),
        get("update.updated_value").alias("updated_value"),
        F.array_contains(F.coalesce(F.json_object_keys(get("update")), F.array().cast("array<string>")), "updated_value").alias("has_updated_value"),
    )


def _issue(rows: DataFrame, rule: int, severity: str, message: Column, fact_id: Column | None = None) -> DataFrame:
    return rows.select("file", F.col("seq").cast("long"), F.lit(rule).alias("rule"), (fact_id if fact_id is not None else F.col("fid")).alias("fact_id"), F.lit(severity).alias("severity"), message.alias("message"))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("file", "fid").orderBy("seq")
    return _issue(rows.withColumn("n", F.row_number().over(w)).filter("n > 1"), 1, "error", F.lit("duplicate id"))


def id_patterns(rows: DataFrame) -> DataFrame:
    other = F.col("distractor_of").isNotNull()
    bad = rows.filter(F.when(other, ~F.col("fid").rlike(DISTRACTOR_ID)).otherwise(~F.col("fid").rlike(BASE_ID)))
    return _issue(bad, 2, "warning", F.when(other, "distractor id does not match f_<3digit>_dist[N] pattern").otherwise("base fact id does not match f_<3digit> pattern"))


def required_fields(rows: DataFrame) -> DataFrame:
    each = rows.select("*", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("content")) for f in REQUIRED])).alias("f"))
    return _issue(each.filter(F.trim("f.content") == ""), 3, "error", F.concat(F.lit("missing/empty required field '"), F.col("f.field"), F.lit("'")))


def domain_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("domain_or_null <> ''").groupBy("file", F.col("domain_or_null").alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def unapproved_domains(rows: DataFrame) -> DataFrame:
    bad = rows.filter((F.col("domain_or_null") != "") & ~F.col("domain_or_null").isin(DOMAINS))
    return _issue(bad, 4, "warning", F.concat(F.lit("domain '"), F.col("domain_or_null"), F.lit(f"' is not one of the {len(DOMAINS)} approved domains: {DOMAINS}")))


def language_maps(rows: DataFrame, path: str, name: str, required: list[str], rule: int) -> DataFrame:
    """A map from language to text: not a map; languages missing (one issue); texts blank (one each, null reads as None)."""
    parent, _, leaf = path.rpartition(".")
    keys = F.json_object_keys(F.get_json_object("raw", f"$.{parent}")) if parent else F.col("names")
    there = F.array_contains(F.coalesce(keys, F.array().cast("array<string>")), leaf)
    value = F.when(there, F.coalesce(F.get_json_object("raw", f"$.{path}"), F.lit("null"))).otherwise("{}")
    rows = rows.withColumn("v", value)
    is_map = F.ltrim("v").startswith("{")
    rows = rows.withColumn("m", F.when(is_map, F.from_json("v", _MAP)))
    lacks = F.array_except(F.array(*map(F.lit, required)), F.map_keys("m"))
    quoted = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(lacks), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    blank = rows.filter("m IS NOT NULL").select("*", F.explode("m").alias("lang", "t")).filter(F.col("lang").isin(required) & (F.trim(F.coalesce("t", F.lit("None"))) == ""))
    return (
        _issue(rows.filter("m IS NULL"), rule, "error", F.lit(f"{name} is not a mapping"))
        .unionByName(_issue(rows.filter(F.col("m").isNotNull() & (F.size(lacks) > 0)), rule, "error", F.concat(F.lit(f"{name} missing language(s): "), quoted)))
        .unionByName(_issue(blank, rule, "error", F.concat(F.lit(f"{name}["), F.col("lang"), F.lit("] is empty"))))
    )


def distractor_bases(rows: DataFrame) -> DataFrame:
    """Each distractor with its base (the last item of that id), null if there is none."""
    w = Window.partitionBy("file", "id").orderBy(F.col("seq").desc())
    base = rows.withColumn("n", F.row_number().over(w)).filter("n = 1")
    base = base.select("file", F.col("id").alias("base_id"), F.lit(True).alias("found"), *[F.col(f"{f}_or_null").alias(f"base_{f}") for f in REQUIRED[1:]])
    return rows.filter("distractor_of IS NOT NULL").withColumn("base_id", F.col("distractor_of")).join(base, ["file", "base_id"], "left")


def dangling_distractors(rows: DataFrame) -> DataFrame:
    return _issue(distractor_bases(rows).filter("found IS NULL"), 7, "error", F.concat(F.lit("distractor_of references unknown fact id '"), F.col("base_id"), F.lit("'")))


def near_misses(rows: DataFrame) -> DataFrame:
    """Distractors that differ from their base in neither the entity alone nor the value alone."""
    same = {f: F.col(f"{f}_or_null").eqNullSafe(F.col(f"base_{f}")) for f in REQUIRED[1:]}
    shift = same["relation"] & (same["value"] != same["entity"])
    return _issue(distractor_bases(rows).filter("found").filter(~shift), 8, "warning", F.lit("distractor is neither an entity shift nor a value shift of its base fact"))


def updates(rows: DataFrame) -> DataFrame:
    have = rows.filter("update IS NOT NULL")
    value = F.when(F.col("has_updated_value"), F.coalesce("updated_value", F.lit("None"))).otherwise("")
    return (
        _issue(have.filter(F.trim(value) == ""), 9, "error", F.lit("update.updated_value is missing/empty"))
        .unionByName(language_maps(have, "update.surface", "update.surface", LANGS, 10))
        .unionByName(language_maps(have, "update.probe_questions", "update.probe_questions", UPDATE_LANGS, 11))
    )


def summary(rows: DataFrame) -> DataFrame:
    """Per file: totals and the map of domain counts."""
    totals = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_facts"), F.count_if(F.col("distractor_of").isNotNull()).alias("total_distractors"), F.count_if(F.col("update").isNotNull()).alias("total_updates")
    )
    counts = domain_counts(rows).groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "n")))).alias("domain_counts"))
    return totals.join(counts, "file", "left")


def low_ratio(rows: DataFrame) -> DataFrame:
    """A bank with too few distractors by base fact."""
    t = summary(rows).withColumn("base", F.col("total_facts") - F.col("total_distractors"))
    t = t.filter("base > 0").withColumn("r", F.col("total_distractors") / F.col("base")).filter(F.col("r") < DISTRACTOR_RATIO)
    percent = F.concat(F.bround(F.col("r") * 100, 0).cast("int").cast("string"), F.lit("%"))
    return _issue(t.withColumn("seq", F.lit(1 << 62)), 12, "warning", F.concat(F.lit("distractor ratio "), percent, F.lit(f" of base facts is below the target of {DISTRACTOR_RATIO:.0%}")), F.lit("<bank>"))


def validate(raw: DataFrame) -> DataFrame:
    """All issues of every bank in ``raw``."""
    rows = cut(items(raw))
    parts = [
        duplicate_ids(rows), id_patterns(rows), required_fields(rows), unapproved_domains(rows),
        language_maps(rows, "surface", "surface", LANGS, 5), language_maps(rows, "probe_questions", "probe_questions", LANGS, 6),
        dangling_distractors(rows), near_misses(rows), updates(rows), low_ratio(rows),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(raw: DataFrame) -> DataFrame:
    """Per file: totals, errors, warnings and is_valid (no errors)."""
    issues = validate(raw).groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return summary(items(raw)).join(issues, "file", "left").select("file", "total_facts", "total_distractors", "total_updates", "domain_counts", zero("errors"), zero("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"))


def collisions(raw: DataFrame) -> DataFrame:
    """Facts that clash across banks read in (file_no, seq) order; each is held against the first one with its id, triple, slot or entity and value.

    ``raw`` has file_no besides; a bank's own rows may clash too, but for ids.
    """
    rows = items(raw.drop("file_no")).join(raw.select("file", "file_no").distinct(), "file")
    rows = rows.withColumn("at", F.struct("file_no", "seq"))
    rows = rows.select("file", "seq", "at", "id", *[F.coalesce(f"{f}_or_null", F.lit("None")).alias(f) for f in REQUIRED[1:]])
    rows = rows.withColumn("place", F.concat("id", F.lit(" ("), F.element_at(F.split("file", "/"), -1), F.lit(")"))).withColumn("fid", F.col("id"))

    def first(keys: list[str], value: str) -> Column:
        """``value`` of the first row with these keys, if that is an earlier one."""
        w = Window.partitionBy(*keys).orderBy("at")
        return F.when(F.row_number().over(w) > 1, F.first(value).over(w))

    slot = F.struct("value", "place")
    ev = F.struct("relation", "place")
    rows = rows.withColumns({"slot_": slot, "ev_": ev})
    rows = rows.withColumns(
        {"id1": first(["id"], "file"), "triple1": first(["entity", "relation", "value"], "place"), "slot1": first(["entity", "relation"], "slot_"), "ev1": first(["entity", "value"], "ev_")}
    )
    q = lambda *c: F.concat(F.lit("("), F.array_join(F.array(*[F.concat(F.lit("'"), F.col(x), F.lit("'")) for x in c]), ", "), F.lit(")"))
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    new = rows.filter("triple1 IS NULL")
    return (
        _issue(rows.filter("id1 <> file"), 1, "error", F.concat(F.lit("id also used in "), F.col("id1")))
        .unionByName(_issue(rows.filter("triple1 IS NOT NULL"), 2, "error", F.concat(F.lit("same fact "), q("entity", "relation", "value"), F.lit(" as "), F.col("triple1"))))
        .unionByName(_issue(new.filter("slot1 IS NOT NULL"), 3, "warning", F.concat(q("entity", "relation"), F.lit(" = "), quoted("value"), F.lit(" but "), F.col("slot1.place"), F.lit(" has "), quoted("slot1.value"))))
        .unionByName(
            _issue(
                new.filter("ev1.relation <> relation"), 4, "warning",
                F.concat(q("entity", "value"), F.lit(" under "), quoted("relation"), F.lit("; "), F.col("ev1.place"), F.lit(" has it under "), quoted("ev1.relation")),
            )
        )
    )


def overlaps(targets: DataFrame, sentences: DataFrame) -> DataFrame:
    """Values that occur as whole tokens in another, different-valued fact's sentences: the first such fact for each value form.

    ``targets``: (a_seq, a_id, a_value, target); ``sentences``: (b_seq, b_id, b_value, text).  Whole tokens
    make every token of a target usable, so its rarest one is joined with the sentences' tokens.
    """
    t = targets.withColumn("needle", X.tokens("target")).filter(F.trim("needle") != "").select("a_seq", "a_id", "a_value", "needle").distinct()
    s = sentences.select("b_seq", "b_id", "b_value", X.tokens(F.coalesce("text", F.lit(""))).alias("hay"))
    split = lambda c: F.array_distinct(F.split(F.trim(c), " "))
    s = s.withColumn("row", F.xxhash64("b_seq", "hay"))
    words = s.select("row", F.explode(split("hay")).alias("word"))
    needles = t.select("*", F.explode(split("needle")).alias("word"))
    often = words.join(needles.select("word").distinct(), "word", "left_semi").groupBy("word").count()
    rare = needles.join(often, "word", "left").groupBy("a_seq", "a_id", "a_value", "needle").agg(F.min_by("word", F.struct(F.coalesce("count", F.lit(0)), "word")).alias("word"))
    hit = words.join(rare, "word").drop("word").distinct().join(s, "row")
    hit = hit.filter((F.col("a_seq") != F.col("b_seq")) & ~F.col("a_value").eqNullSafe(F.col("b_value")) & F.contains("hay", F.col("needle")))
    out = hit.groupBy("a_seq", "a_id", F.trim("needle").alias("target")).agg(F.min_by("b_id", "b_seq").alias("b_id"))
    message = F.concat(F.lit("value form '"), F.col("target"), F.lit("' occurs in "), F.col("b_id"), F.lit("'s sentences"))
    return out.select(F.col("a_seq").alias("seq"), F.col("a_id").alias("fact_id"), "target", "b_id", F.lit("warning").alias("severity"), message.alias("message"))


def bank_overlaps(raw: DataFrame) -> DataFrame:
    """:func:`overlaps` of the facts of banks; file_no and seq give their order."""
    maps = "map<string,string>"
    aliases = F.from_json(F.coalesce(F.get_json_object("raw", "$.value_aliases"), F.lit("{}")), "map<string,array<string>>")
    rows = raw.select(
        (F.col("file_no").cast("long") * (1 << 32) + F.col("seq")).alias("n"), F.coalesce(F.get_json_object("raw", "$.id"), F.lit("None")).alias("id"), F.get_json_object("raw", "$.value").alias("value"), aliases.alias("aliases"),
        F.from_json(F.coalesce(F.get_json_object("raw", "$.surface"), F.lit("{}")), maps).alias("s"), F.from_json(F.coalesce(F.get_json_object("raw", "$.update.surface"), F.lit("{}")), maps).alias("u"),
    )
    own = F.concat(F.array(F.replace(F.coalesce("value", F.lit("None")), F.lit("_"), F.lit(" "))), F.flatten(F.map_values("aliases")))
    targets = rows.select(F.col("n").alias("a_seq"), F.col("id").alias("a_id"), F.col("value").alias("a_value"), F.explode(own).alias("target"))
    sentences = rows.select(F.col("n").alias("b_seq"), F.col("id").alias("b_id"), F.col("value").alias("b_value"), F.explode(F.concat(F.map_values("s"), F.map_values("u"))).alias("text"))
    return overlaps(targets, sentences)


def report_text(raw: DataFrame) -> str:
    """The report of the banks as text; issues are gathered on the driver, as a bank is a hand-written file."""
    lines = []
    issues = validate(raw).orderBy("file", "seq", "rule").collect()
    for r in report(raw).orderBy("file").collect():
        base = r.total_facts - r.total_distractors
        share = f"{r.total_distractors / base:.0%}" if base else "n/a"
        lines += [f"{r.file}: {r.total_facts} facts, {r.total_distractors} distractors ({share} of base facts)", f"domains: {r.domain_counts or {}}", f"facts with updates: {r.total_updates}"]
        for severity, n in (("error", r.errors), ("warning", r.warnings)):
            if n:
                lines.append(f"{n} {severity}(s):")
                lines += [f"  [{x.fact_id}] {x.message}" for x in issues if x.file == r.file and x.severity == severity]
        if not r.errors and not r.warnings:
            lines.append("no issues")
    return "\n".join(lines)

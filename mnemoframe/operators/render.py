"""Fact banks from templates: rule checks as joins, then one projection.

Inputs are DataFrames: ``plan`` (domain, seq, id, relation, entity, value, update,
distractor_of, batch; a distractor has neither relation nor value), ``relations``
(domain, relation, gender, statement, probe, correction, reprobe: maps by language),
``lexicon`` (domain, relation, value, forms: map by language) and ``entities``
(entity, poss_en, poss_hi_stem, poss_hien_stem).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoframe.functions import text as X
from mnemoframe.operators import quality

# Agreement suffixes by gender (masculine, feminine, plural), and languages.
HI_SUFFIX = {"m": "ा", "f": "ी", "p": "े"}
HIEN_SUFFIX = {"m": "a", "f": "i", "p": "e"}
LANGS = ["en", "hi", "hi-en"]
REPROBE_LANGS = ["en", "hi"]
PATTERNS = [("statement", "Statement (plant turn)"), ("probe", "Question (probe)"), ("correction", "Correction turn"), ("reprobe", "Question after correction")]


class TemplateError(ValueError):
    """The plan breaks a rule."""


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def possessive(lang: str, gender: Column) -> Column:
    """The possessor's phrase, from the columns of ``entities``."""
    if lang == "en":
        return F.col("poss_en")
    stem, suffix = {"hi": ("poss_hi_stem", HI_SUFFIX), "hi-en": ("poss_hien_stem", HIEN_SUFFIX)}[lang]
    return F.concat(F.col(stem), F.try_element_at(_literal_map(suffix), gender))


def resolved(plan: DataFrame) -> DataFrame:
    """The plan with each distractor's relation and value taken from its base row; base_found tells whether there is one."""
    base = plan.filter("distractor_of IS NULL").withColumn("_n", F.row_number().over(Window.partitionBy("domain", "id").orderBy(F.col("seq").desc()))).filter("_n = 1")
    base = base.select("domain", F.col("id").alias("distractor_of"), F.col("relation").alias("_r"), F.col("value").alias("_v"), F.lit(True).alias("_f"))
    out = plan.join(base, ["domain", "distractor_of"], "left")
    other = F.col("distractor_of").isNotNull()
    return out.select(
        "domain", "seq", "id", "entity", "distractor_of", "batch", F.when(other, F.col("_r")).otherwise(F.col("relation")).alias("relation"), F.when(other, F.col("_v")).otherwise(F.col("value")).alias("value"),
        F.when(~other, F.col("update")).alias("update"), (~other | F.coalesce("_f", F.lit(False))).alias("base_found"), (other & (F.col("value").isNotNull() | F.col("update").isNotNull())).alias("own_value"),
    )


def violations(plan: DataFrame, relations: DataFrame, lexicon: DataFrame, entities: DataFrame) -> DataFrame:
    """(domain, seq, id, rule, detail) of every broken rule."""
    rows = resolved(plan)
    known = rows.filter("base_found")
    issue = lambda df, rule, detail: df.select("domain", F.col("seq").cast("long"), "id", F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
    nth = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).filter("_n > 1")
    bases = known.filter("distractor_of IS NULL")
    forms = lexicon.select("domain", "relation", F.col("value"))
    values = known.select("domain", "seq", "id", "relation", F.explode(F.array_compact(F.array("value", "update"))).alias("value"))
    planted = bases.select("domain", "relation", F.col("value").alias("update"))
    return reduce(
        DataFrame.unionByName,
        [
            issue(rows.filter("NOT base_found"), "dangling_distractor", F.col("distractor_of")),
            issue(known.join(relations, ["domain", "relation"], "left_anti"), "unknown_relation", F.col("relation")),
            issue(known.join(entities, "entity", "left_anti"), "unknown_entity", F.col("entity")),
            issue(nth(known, "domain", "entity", "relation"), "duplicate_slot", F.concat_ws(",", "entity", "relation")),
            issue(known.filter("own_value"), "distractor_value", F.col("id")),
            issue(nth(bases, "domain", "relation", "value"), "value_planted_twice", F.concat_ws(",", "relation", "value")),
            issue(bases.join(planted, ["domain", "relation", "update"], "left_semi"), "corrected_is_planted", F.concat_ws(",", "relation", "update")),
            issue(values.join(forms, ["domain", "relation", "value"], "left_anti"), "not_in_lexicon", F.concat_ws(",", "relation", "value")),
        ],
    )


def value_aliases(forms: Column) -> Column:
    """The Hindi form, and the transliterated one where it differs from English in more than case."""
    hi = F.create_map(F.lit("hi"), F.array(forms["hi"]))
    other = F.create_map(F.lit("translit"), F.array(forms["hi-en"]))
    return F.when(F.lower(forms["hi-en"]) != F.lower(forms["en"]), F.map_concat(hi, other)).otherwise(hi)


def render(plan: DataFrame, relations: DataFrame, lexicon: DataFrame, entities: DataFrame, batch: int | None = None, check: bool = True) -> DataFrame:
    """The facts of a plan.  All of it is checked; ``batch`` then picks what is returned."""
    if check and (bad := violations(plan, relations, lexicon, entities).orderBy("domain", "seq").first()):
        raise TemplateError(f"{bad.id}: {bad.rule} ({bad.detail})")
    forms = lexicon.select("domain", "relation", "value", F.col("forms"))
    rows = resolved(plan).join(relations, ["domain", "relation"]).join(entities, "entity").join(forms, ["domain", "relation", "value"])
    rows = rows.join(forms.select("domain", "relation", F.col("value").alias("update"), F.col("forms").alias("new")), ["domain", "relation", "update"], "left")
    poss = {lang: possessive(lang, F.try_element_at("gender", F.lit(lang))) for lang in LANGS}
    texts = lambda langs, make: F.map_from_arrays(F.array(*map(F.lit, langs)), F.array(*[make(x) for x in langs]))
    surface = texts(LANGS, lambda x: X.fill(F.col("statement")[x], poss[x], v=F.col("forms")[x]))
    probes = texts(LANGS, lambda x: X.fill(F.col("probe")[x], poss[x]))
    update = F.struct(
        F.col("update").alias("updated_value"),
        texts(LANGS, lambda x: X.fill(F.col("correction")[x], poss[x], old=F.col("forms")[x], new=F.col("new")[x])).alias("surface"),
        texts(REPROBE_LANGS, lambda x: X.fill(F.col("reprobe")[x], poss[x])).alias("probe_questions"),
    )
    if batch is not None:
        rows = rows.filter(F.coalesce("batch", F.lit(1)) == batch)
    return rows.select(
        F.col("seq").cast("long").alias("seq"), "id", "domain", "entity", "relation", "value", value_aliases(F.col("forms")).alias("value_aliases"), "distractor_of",
        surface.alias("surface"), probes.alias("probe_questions"), F.when(F.col("update").isNotNull(), update).alias("update"),
    )


def review_patterns(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """A row for each relation and sentence pattern, with a rendered example that prefers another person than the user.

    ``relations`` has ``ord`` besides, the order of the sheet.
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(k).alias("pattern"), F.lit(label).alias("label"), F.col(k).alias("texts")) for i, (k, label) in enumerate(PATTERNS)])
    rows = relations.select("ord", "domain", "relation", "gender", F.explode(kinds).alias("k")).select("ord", "domain", "relation", "gender", "k.*")
    blocks = {"statement": "surface", "probe": "probe_questions", "correction": "update.surface", "reprobe": "update.probe_questions"}
    of = facts.select("domain", "relation", "id", "seq", "entity", F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(c).alias("block")) for k, c in blocks.items()])).alias("b"))
    of = of.select("domain", "relation", "id", F.struct((F.col("entity") == "user").alias("u"), "seq").alias("o"), "b.pattern", "b.block").filter("block IS NOT NULL")
    example = F.concat_ws("\n", "id", F.array_compact(F.array(*[F.try_element_at("block", F.lit(x)) for x in LANGS])))
    best = of.withColumn("example", example).groupBy("domain", "relation", "pattern").agg(F.min_by("example", "o").alias("example"))
    mismatch = (F.col("pattern") == "statement") & (F.col("gender")["hi"] != F.col("gender")["hi-en"])
    n = F.row_number().over(Window.orderBy("ord", "p"))  # a sheet: four rows for each template
    head = F.col("pattern") == "statement"
    return rows.join(best, ["domain", "relation", "pattern"], "left").select(
        F.format_string("P%03d", n).alias("row"), "domain", "relation", F.col("label").alias("pattern"),
        F.when(head, F.col("gender")["hi"]).otherwise("").alias("hindi_gender"), F.when(head, F.col("gender")["hi-en"]).otherwise("").alias("hinglish_gender"),
        F.coalesce(F.col("texts")["en"], F.lit("")).alias("english"), F.coalesce(F.col("texts")["hi"], F.lit("")).alias("hindi"), F.coalesce(F.try_element_at("texts", F.lit("hi-en")), F.lit("(not used)")).alias("hinglish"),
        F.coalesce("example", F.lit("(no fact in this batch uses a correction)")).alias("example"), mismatch.alias("gender_mismatch"),
    )


def review_values(facts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A row for each value of the lexicon (``ord`` gives the order), with the facts that use it or "(spare)"."""
    used = facts.select("domain", "relation", F.struct("seq", "id").alias("f"), F.explode(F.array_distinct(F.array_compact(F.array("value", F.col("update.updated_value"))))).alias("value"))
    used = used.groupBy("domain", "relation", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["id"]), ", ").alias("ids"))
    n = F.row_number().over(Window.orderBy("ord"))
    return lexicon.join(used, ["domain", "relation", "value"], "left").select(
        F.format_string("V%03d", n).alias("row"), "domain", "relation", "value", F.col("forms")["en"].alias("english"), F.col("forms")["hi"].alias("hindi"), F.col("forms")["hi-en"].alias("hinglish"), F.coalesce("ids", F.lit("(spare)")).alias("used_by")
    )


def review_people(entities: DataFrame) -> DataFrame:
    """A row for each person (``ord`` gives the order), with all forms of the possessive."""
    each = lambda lang: F.concat_ws(" / ", *[possessive(lang, F.lit(g)) for g in ("m", "f", "p")])
    return entities.select(F.format_string("E%03d", F.row_number().over(Window.orderBy("ord"))).alias("row"), "entity", F.col("poss_en").alias("english"), each("hi").alias("hindi"), each("hi-en").alias("hinglish"))


def review_sentences(facts: DataFrame) -> DataFrame:
    """A row for each non-empty block of sentences of hand-written facts (file, seq, ...)."""
    blocks = [("Statement", "surface"), ("Question", "probe_questions"), ("Correction", "update.surface"), ("Question after correction", "update.probe_questions")]
    kinds = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(label).alias("sentence"), F.col(c).alias("t")) for i, (label, c) in enumerate(blocks)])
    rows = facts.select("file", "seq", "id", F.explode(kinds).alias("k")).select("file", "seq", "id", "k.*").filter("size(t) > 0")
    n = F.row_number().over(Window.orderBy("file", "seq", "p"))
    text = lambda lang, other: F.coalesce(F.try_element_at("t", F.lit(lang)), F.lit(other))
    return rows.select(F.format_string("H%03d", n).alias("row"), "file", F.col("id").alias("fact"), "sentence", text("en", "").alias("english"), text("hi", "").alias("hindi"), text("hi-en", "(not used)").alias("hinglish"))


def review_existing(raw: DataFrame) -> DataFrame:
    """A row for each clash and each overlap that validation finds across existing banks (file, file_no, seq, raw)."""
    columns = ["fact_id", "severity", "message"]
    found = quality.collisions(raw).select(F.struct(F.lit(0).alias("p"), "file", "seq", "message").alias("o"), *columns)
    found = found.unionByName(quality.bank_overlaps(raw).select(F.struct(F.lit(1).alias("p"), F.lit("").alias("file"), "seq", "message").alias("o"), *columns))
    n = F.row_number().over(Window.orderBy("o"))  # a sheet
    return found.select(F.format_string("X%03d", n).alias("row"), F.col("fact_id").alias("fact"), "severity", F.col("message").alias("issue"))


#: What the first sheet of a workbook says.
REVIEW_NOTES = [
    "Each row of the other sheets is one thing to judge: a sentence pattern, a value, a person, a sentence or a finding.",
    "Choose OK if a native speaker would say it so, and Fix if not.",
    "For a Fix, write the better wording in the next column, and the reason in the last one.",
    "Words in braces are filled in: {v} is the value, {poss} and {Poss} the person, {old} and {new} the values of a correction.",
    "A row whose gender_mismatch is true has a noun of another gender in Hinglish than in Hindi: check both possessives.",
]
#: Columns for the reviewer's answer.
REVIEW_COLUMNS = ("Verdict (OK / Fix)", "Suggested fix", "Comment")


def review_sheets(facts: DataFrame, relations: DataFrame, lexicon: DataFrame, entities: DataFrame, hand: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """All sheets of a workbook: of templates, and of hand-written banks (:func:`review_sentences`, :func:`review_existing`)."""
    sheets = {
        "Patterns": review_patterns(facts, relations), "Values": review_values(facts, lexicon), "People": review_people(entities),
        "Hand-written facts": review_sentences(hand), "Existing data": review_existing(raw),
    }
    return {k: v.orderBy("row") for k, v in sheets.items()}

import json

from mnemoframe.operators import quality

GOOD = {"en": "a", "hi": "b", "hi-en": "c"}


def item(**kv):
    out = {"id": "f_001", "domain": "work", "entity": "user", "relation": "r", "value": "v", "surface": GOOD, "probe_questions": GOOD, "distractor_of": None, "update": None}
    out |= kv
    return {k: v for k, v in out.items() if v != "ABSENT"}


def raw(spark, *banks):
    rows = [(f"bank{n}.yaml", n, i, json.dumps(x)) for n, b in enumerate(banks) for i, x in enumerate(b)]
    return spark.createDataFrame(rows, "file string, file_no int, seq long, raw string")


def issues(spark, *items):
    return [(r.fact_id, r.severity, r.message) for r in quality.validate(raw(spark, items).drop("file_no")).filter("fact_id <> '<bank>'").orderBy("seq", "rule", "message").collect()]


def test_clean_bank(spark):
    other = item(id="f_001_dist", entity="user_sister", distractor_of="f_001")
    assert issues(spark, item(), other) == []
    r = quality.report(raw(spark, [item(), other]).drop("file_no")).first()
    assert r.is_valid and r.total_facts == 2 and r.total_distractors == 1 and r.domain_counts == {"work": 2}


def test_each_rule(spark):
    assert issues(spark, item(), item())[0] == ("f_001", "error", "duplicate id")
    assert issues(spark, item(id="x1"))[0][1:] == ("warning", "base fact id does not match f_<3digit> pattern")
    assert issues(spark, item(domain=" "))[0][2] == "missing/empty required field 'domain'"
    assert issues(spark, item(value="ABSENT"))[0][2] == "missing/empty required field 'value'"
    assert issues(spark, item(value=None)) == []  # an explicit null reads as text
    assert "is not one of the 8" in issues(spark, item(domain="food"))[0][2]
    assert issues(spark, item(surface={"hi": " ", "en": "x"})) == [("f_001", "error", "surface missing language(s): ['hi-en']"), ("f_001", "error", "surface[hi] is empty")]
    assert issues(spark, item(surface="text"))[0][2] == "surface is not a mapping"
    assert issues(spark, item(surface=None))[0][2] == "surface is not a mapping"
    assert issues(spark, item(probe_questions="ABSENT"))[0][2] == "probe_questions missing language(s): ['en', 'hi', 'hi-en']"
    assert issues(spark, item(id="f_002_dist", distractor_of="f_009"))[0][2] == "distractor_of references unknown fact id 'f_009'"
    assert "neither an entity shift" in issues(spark, item(), item(id="f_001_dist", distractor_of="f_001", relation="q", value="w"))[0][2]
    assert issues(spark, item(), item(id="f_001_dist1", distractor_of="f_001", value="w")) == []
    got = issues(spark, item(update={"updated_value": "", "surface": GOOD, "probe_questions": {"en": "x"}}))
    assert [m for *_, m in got] == ["update.updated_value is missing/empty", "update.probe_questions missing language(s): ['hi']"]


def test_ratio(spark):
    rows = quality.validate(raw(spark, [item(id=f"f_00{i}", value=str(i)) for i in range(5)] + [item(id="f_001_dist", distractor_of="f_001", value="1", entity="x")]).drop("file_no")).filter("fact_id = '<bank>'").collect()
    assert [r.message for r in rows] == ["distractor ratio 20% of base facts is below the target of 30%"]


def test_collisions(spark):
    a = [item(id="f_001", entity="user", relation="r", value="x"), item(id="f_002", relation="r2", value="y"), item(id="f_003", relation="r3", value="z")]
    b = [item(id="f_001", entity="other", value="q"), item(id="f_101", relation="r", value="x"), item(id="f_102", relation="r2", value="yy"), item(id="f_103", relation="r9", value="z")]
    got = {(r.fact_id, r.severity) for r in quality.collisions(raw(spark, a, b)).collect()}
    assert got == {("f_001", "error"), ("f_101", "error"), ("f_102", "warning"), ("f_103", "warning")}


def test_value_overlap(spark):
    said = lambda t: {"en": t, "hi": "h", "hi-en": "k"}
    bank = [
        item(id="f_001", value="chennai", surface=said("I live in Chennai")), item(id="f_002", value="chennai_super_kings", surface=said("I support Chennai Super Kings!")),
        item(id="f_003", value="car", surface=said("I have a car")), item(id="f_004", value="debit_card", surface=said("I use a debit card")),
    ]
    rows = quality.bank_overlaps(raw(spark, bank)).collect()
    assert [(r.fact_id, r.message) for r in rows] == [("f_001", "value form 'chennai' occurs in f_002's sentences")]

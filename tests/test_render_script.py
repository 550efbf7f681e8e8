import pytest

from mnemoframe import cli
from mnemoframe.operators import render, script
from mnemoframe.sources import files

TEMPLATE = """
domain: dining
relations:
  dish:
    gender: {hi: m, hi-en: f}
    statement: {en: "{Poss} dish is {v}.", hi: "{poss} पकवान {v} है।", hi-en: "{Poss} dish {v} hai."}
    probe: {en: "What is {poss} dish?", hi: "{poss} पकवान?", hi-en: "{Poss} dish?"}
    correction: {en: "Not {old}, {new}.", hi: "{old} नहीं {new}", hi-en: "{old} nahi {new}"}
    reprobe: {en: "What is {poss} dish now?", hi: "अब {poss} पकवान?"}
    values:
      dal: {en: dal, hi: दाल, hi-en: Dal}
      karela: {en: bitter gourd, hi: करेला, hi-en: karela}
      dosa: {en: dosa, hi: डोसा, hi-en: dosa}
facts:
%s
"""
ENTITIES = """
entities:
  user: {poss_en: my, poss_hi_stem: मेर, poss_hien_stem: mer}
  user_sister: {poss_en: my sister's, poss_hi_stem: मेरी बहन क, poss_hien_stem: meri sister k}
"""
PLAN = ["{id: f_201, relation: dish, entity: user, value: dal, update: karela}", "{id: f_201_dist, distractor_of: f_201, entity: user_sister, batch: 2}"]


@pytest.fixture
def templates(spark, tmp_path):
    def make(*plan):
        (tmp_path / "t.yaml").write_text(TEMPLATE % "\n".join("  - " + p for p in plan))
        (tmp_path / "e.yaml").write_text(ENTITIES)
        return files.read_templates(spark, [str(tmp_path / "t.yaml")], str(tmp_path / "e.yaml"))

    return make


def test_render(templates):
    t = templates(*PLAN)
    a, b = render.render(t["plan"], t["relations"], t["lexicon"], t["entities"]).orderBy("seq").collect()
    assert a.surface == {"en": "My dish is dal.", "hi": "मेरा पकवान दाल है।", "hi-en": "Meri dish Dal hai."}
    assert a.value_aliases == {"hi": ["दाल"]} and a.update.updated_value == "karela"
    assert a.update.surface["en"] == "Not dal, bitter gourd." and a.update.probe_questions == {"en": "What is my dish now?", "hi": "अब मेरा पकवान?"}
    assert b.surface["hi"] == "मेरी बहन का पकवान दाल है।" and b.update is None and b.distractor_of == "f_201"
    assert [r.id for r in render.render(t["plan"], t["relations"], t["lexicon"], t["entities"], batch=2).collect()] == ["f_201_dist"]


@pytest.mark.parametrize(
    "rule, plan",
    [
        ("duplicate_slot", [*PLAN[:1], "{id: f_202, relation: dish, entity: user, value: dosa}"]), ("value_planted_twice", [*PLAN[:1], "{id: f_202, relation: dish, entity: user_sister, value: dal}"]),
        ("distractor_value", [*PLAN[:1], "{id: f_201_dist, distractor_of: f_201, entity: user_sister, value: dal}"]), ("corrected_is_planted", [*PLAN[:1], "{id: f_202, relation: dish, entity: user_sister, value: karela}"]),
        ("dangling_distractor", ["{id: f_9_dist, distractor_of: f_9, entity: user}"]), ("unknown_relation", ["{id: f_201, relation: x, entity: user, value: dal}"]),
        ("unknown_entity", ["{id: f_201, relation: dish, entity: x, value: dal}"]), ("not_in_lexicon", ["{id: f_201, relation: dish, entity: user, value: x}"]),
    ],
)
def test_violations(templates, rule, plan):
    t = templates(*plan)
    with pytest.raises(render.TemplateError, match=rule):
        render.render(t["plan"], t["relations"], t["lexicon"], t["entities"])


def _workbook(path):
    """{sheet: rows of cell texts}, and the sheets' XML by name."""
    from xml.etree.ElementTree import fromstring
    from zipfile import ZipFile

    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with ZipFile(path) as z:
        names = [x.get("name") for x in fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")]
        parts = {n: z.read(f"xl/worksheets/sheet{i}.xml").decode() for i, n in enumerate(names, 1)}
    return {n: [["".join(c.itertext()) for c in r] for r in fromstring(x).iter(f"{ns}row")] for n, x in parts.items()}, parts


def test_cli_renders_a_bank_and_its_review_workbook(spark, templates, tmp_path):
    """render writes the bank of one batch; review lists templates, hand-written sentences and the clashes between banks."""
    templates(*PLAN)
    t, e, bank, book = (str(tmp_path / x) for x in ("t.yaml", "e.yaml", "bank.yaml", "book.xlsx"))
    assert cli.main(["render", "--template", t, "--entities", e, "--out", bank]) == 0
    assert [r.id for r in files.read_facts(spark, bank).collect()] == ["f_201"]
    (tmp_path / "other.yaml").write_text((tmp_path / "bank.yaml").read_text())
    assert cli.main(["review", "--templates", t, "--entities", e, "--out", book, "--hand", bank, str(tmp_path / "other.yaml")]) == 0
    rows, parts = _workbook(book)
    assert list(rows) == ["How to review", "Patterns", "Values", "People", "Hand-written facts", "Existing data"]
    assert "OK" in rows["How to review"][1][0] and "autoFilter" not in parts["How to review"]
    for name in list(rows)[1:]:
        assert rows[name][0][-3:] == list(render.REVIEW_COLUMNS) and "autoFilter" in parts[name]
        if len(rows[name]) > 1:  # the choice stands in the first of the three columns
            column = chr(65 + len(rows[name][0]) - 3)
            assert f'sqref="{column}2:{column}{len(rows[name])}"' in parts[name]
    hand = rows["Hand-written facts"]
    assert [r[:4] for r in hand[1:5]] == [[f"H00{i}", "bank.yaml", "f_201", x] for i, x in enumerate(["Statement", "Question", "Correction", "Question after correction"], 1)]
    assert len(hand) == 9 and hand[4][6] == "(not used)"
    assert rows["Existing data"][1][:2] == ["X001", "f_201"] and len(rows["Existing data"]) > 1
    with pytest.raises(FileExistsError):
        cli.main(["render", "--template", t, "--entities", e, "--out", bank])


def test_review_workbook_without_hand_written_banks(spark, templates, tmp_path):
    templates(*PLAN)
    t, e, book = (str(tmp_path / x) for x in ("t.yaml", "e.yaml", "book.xlsx"))
    assert cli.main(["review", "--templates", t, "--entities", e, "--out", book]) == 0
    rows, _ = _workbook(book)
    assert len(rows["Hand-written facts"]) == len(rows["Existing data"]) == 1 and len(rows["Patterns"]) == 5


def test_review_sheets(templates, tmp_path):
    t = templates(*PLAN)
    facts = render.render(t["plan"], t["relations"], t["lexicon"], t["entities"])
    p = render.review_patterns(facts, t["relations"]).orderBy("row").collect()
    assert [r.row for r in p] == ["P001", "P002", "P003", "P004"] and p[0].example.startswith("f_201_dist\nMy sister's") and p[0].gender_mismatch and not p[1].gender_mismatch
    assert [(r.value, r.used_by) for r in render.review_values(facts, t["lexicon"]).orderBy("row").collect()] == [("dal", "f_201, f_201_dist"), ("karela", "f_201"), ("dosa", "(spare)")]
    people = render.review_people(t["entities"])
    assert people.orderBy("row").first().hindi == "मेरा / मेरी / मेरे"
    files.write_xlsx(str(tmp_path / "r.xlsx"), {"People": people}, "Verdict")
    from xml.dom.minidom import parseString
    from zipfile import ZipFile

    with ZipFile(tmp_path / "r.xlsx") as z:
        for name in z.namelist():
            parseString(z.read(name))
    with pytest.raises(FileExistsError):
        files.write_xlsx(str(tmp_path / "r.xlsx"), {"People": people})
    assert files.write_bank(facts, str(tmp_path / "b.yaml")) == 2
    assert files.read_facts(people.sparkSession, str(tmp_path / "b.yaml")).count() == 2
    with pytest.raises(FileExistsError):
        files.write_bank(facts, str(tmp_path / "b.yaml"))


def bank(spark, n=12):
    def fact(i):
        out = {"id": f"f_{i:03d}", "domain": "d", "entity": "user", "relation": f"rel_{i}", "value": f"v{i}", "surface": {"en": f"fact {i}"}, "probe_questions": {"en": f"ask {i}"} if i % 2 else {}}
        if i % 3 == 2:
            out |= {"distractor_of": f"f_{i - 1:03d}"}
        elif i % 2 == 0:
            out |= {"update": {"updated_value": "new", "surface": {}, "probe_questions": {"en": ""}}}
        return out

    return files.facts_frame(spark, [fact(i) for i in range(n)])


def test_script_phases(spark):
    turns = script.build_script(bank(spark), "hi", "en", filler_sessions=2, seed=5)
    rows = turns.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    sessions = [r.session_id for r in rows]
    assert sessions == sorted(sessions) and set(sessions) == {1, 2, 3, 4, 5, 6}
    kinds = {s: {r.kind for r in rows if r.session_id == s} for s in set(sessions)}
    assert kinds == {1: {"plant"}, 2: {"filler"}, 3: {"filler"}, 4: {"probe"}, 5: {"correction"}, 6: {"probe"}}
    assert sum(r.kind == "filler" and r.fact_id is not None for r in rows) == 2  # of four distractors, one each session
    assert [r.text for r in rows if r.session_id == 4][:2] == ["What is the user's rel 0?", "ask 1"]
    assert [r.text for r in rows if r.session_id == 5] == ["Correction: the rel_0 is actually new."]
    assert [r.text for r in rows if r.session_id == 6] == ["What is the user's current rel 0?"]
    assert rows == script.build_script(bank(spark), "hi", "en", filler_sessions=2, seed=5).orderBy("seq").collect()
    phases = {r.phase for r in script.split_phases(turns).collect()}
    assert phases == {"plant", "filler", "probe", "correction", "reprobe"}


def test_script_without_updates(spark):
    plain = bank(spark).filter("update IS NULL")
    turns = script.build_script(plain, "en", "hi", filler_sessions=0)
    assert {r.kind for r in turns.collect()} == {"plant", "probe"}
    assert script.split_phases(turns).filter("phase = 'reprobe'").count() == 0
    assert script.correction_subset(bank(spark, 60)).count() == 4  # a fifth of twenty

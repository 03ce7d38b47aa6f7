"""Scores, extraction from tables and lines with anchors and labels, keys, instances."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import values as V


def block(rows=(), kv=(), heading="", label=""):
    return {"heading": heading, "label": label, "rows": [list(r) for r in rows], "kv": dict(kv)}


def test_scores_rank_exact_above_the_rest():
    assert V.candidate_score("upstream valve prop press", "", "Upstream-Valve prop press") == 1.0
    assert V.candidate_score("T1", "Prop Pressure", "propellant pressure upstream") < 1.0
    assert V.candidate_score("measured", "", "measured val") > V.candidate_score("measured", "", "some measured value of it")
    assert V.candidate_score("", "flow rate", "flow rate at") == 0.98 and V.candidate_score("", "flow rate x", "flow rate x and more " + "w " * 15) == 0.97
    assert V.fuzzy_score("upstream valve prop press", "", "upstream valve") < 0.78  # a generic part is no match
    assert V.fuzzy_score("prop press", "", "propellant pressure") == 1.0 and V.fuzzy_score("x", "", "") == 0.0
    assert V.coverage("a b", "") == 0.0 and V.coverage("abcd ef", "abcdef ef") == 1.0
    assert V.header_score("Measured Value", "measured value (psi)") == 1.0 and V.header_score("Meas Val", "Measured Value") >= 0.72 and V.header_score("x", "") == 0.0
    assert V.header_score("Measured", "Target", fuzzy=False) == 0.0
    assert V.ratio("abcd", "abce") == pytest.approx(0.75) and V.ratio("abcd", "wxyz", 0.5) == 0.0


def test_labels():
    assert V.label_fits("", "x") and V.label_fits("Acceptance", "acceptance") and V.label_fits("Acceptance", "Acceptance (2)") and V.label_fits("Acceptance", "Acceptance 3")
    assert not V.label_fits("Acceptance", "Acceptance data") and not V.label_fits("Acceptance", "")


def test_tables_by_key_row_label_and_fuzzy():
    t = V.Term("flow", "Flow rate")
    assert V.from_tables([block(kv=[("flow", "3")])], t)[0] == "3"
    assert V.from_tables([block(kv=[("mainflowtotal", "4")])], t)[0] == "4"
    assert V.from_tables([block(rows=[["Pressure", "1"], ["Flow Rate (kg)", "", "7", ""]])], t)[0] == "7"
    two = [block(rows=[["Flow rate", "1"]], label="First"), block(rows=[["Flow rate", "2"]], label="Second (2)")]
    assert V.from_tables(two, V.Term("flow", "Flow rate", table_label="Second"))[0] == "2" and V.from_tables(two, V.Term("flow", "Flow rate", table_label="Third")) is None
    rows = [["upstream pressure of valve", "1"], ["upstream valve propellant pressure", "2"], ["upstream valve propellant pressure", "3"]]
    fuzzy = V.Term("UVPP", "upstream valve prop press", fuzzy=True)
    assert V.from_tables([block(rows=rows)], fuzzy)[0] == "2"  # the earliest of equals
    assert V.from_tables([block(rows=rows[:1])], fuzzy) is None and V.from_tables([block(rows=rows)], V.Term("UVPP", "upstream valve prop press")) is None
    assert V.from_tables([block(rows=[["Torque", "5"]], heading="Part B")], V.Term("Torque", heading="Part A")) is None
    assert V.from_tables([], t) is None and V.from_tables([block(rows=[["Flow rate"]])], t) is None and V.from_tables([block(kv=[("a", "1")])], V.Term("")) is None


def test_nothing_before_an_anchor_counts():
    rows = [["Torque", "1"], ["START SECTION", ""], ["Torque", "2"]]
    assert V.from_tables([block(rows=rows, kv=[("torque", "1")])], V.Term("Torque", after="start section"))[0] == "2"
    assert V.from_tables([block(rows=rows)], V.Term("Torque", after="missing anchor")) is None
    assert V.from_tables([block(rows=rows[:1]), block(rows=rows[:1], heading="Start Sectoin")], V.Term("Torque", after="start section", least_anchor=0.65))[0] == "1"
    lines = ["torque: 111", "START SECTION", "torque: 222"]
    assert V.from_lines(lines, V.Term("torque", after="start section"))[0] == 222.0
    assert V.from_lines(lines, V.Term("torque", after="not there at all")) is None
    assert V.from_lines(["torque: 1", "here STRT SECTION of it", "torque: 2"], V.Term("torque", after="start section", least_anchor=0.65))[0] == 2.0
    assert V.from_lines(["torque 1", "AB", "torque 2"], V.Term("torque", after="ab"))[0] == 2.0 and V.from_lines(["torque 1", "AC", "torque 2"], V.Term("torque", after="ab")) is None


def test_lines():
    assert V.from_lines(["Torque 1,234.5 Nm"], V.Term("torque"))[0] == 1234.5
    assert V.from_lines(["Torque", "  7 Nm"], V.Term("torque"))[0] == 7.0
    assert V.from_lines(["Torque: high"], V.Term("torque"))[0] == "high"
    assert V.from_lines(["Operator: A. Rivera |"], V.Term("operator", kind="string"))[0] == "A. Rivera"
    assert V.from_lines(["Operator - B"], V.Term("operator", kind="string"))[0] == "B"
    assert V.from_lines(["value 3", "Flow rate 9"], V.Term("value", "flow rate"))[0] == 3.0
    assert V.from_lines(["prop pressure 5"], V.Term("zz", "propellant pressure", fuzzy=True))[0] == 5.0
    assert V.from_lines(["a", "Part", *["x"] * 700, "torque 1"], V.Term("torque", heading="part")) is None
    assert V.from_lines(["torque 1"], V.Term("torque", heading="part")) is None and V.from_lines([], V.Term("torque")) is None


def test_header_and_keys():
    tables = [[["Parameter", "Target", "Measured Val"], ["Flow", "1", "2"], ["Torque", "3", "4"]], [["Parameter", "Measured"], ["Torque", "9"]]]
    assert V.by_header(tables, V.Term("Torque"), "Measured Val") == ("4", 1.0)
    assert V.by_header([], V.Term("Torque"), "x") is None and V.by_header(tables, V.Term("Mass"), "Measured") is None
    keys = ["Upstream Valve Pressure", "Valve Pressure", "Torque"]
    assert V.resolved_key(keys, V.Term("torque")) == "Torque" and V.resolved_key(keys, V.Term("X", "valve-pressure")) == "Valve Pressure"
    assert V.resolved_key(keys, V.Term("valve pressure max")) == "Valve Pressure" and V.resolved_key(keys, V.Term("nothing")) is None
    assert V.resolved_key(keys, V.Term("upstrem upstream valve pres", fuzzy=True, least=0.7)) == "Upstream Valve Pressure" and V.resolved_key(keys, V.Term("zzz", fuzzy=True)) is None


def test_many_documents_and_blocks_of_terms(spark, monkeypatch):
    kind = "doc_id long, blocks array<struct<heading:string,label:string,rows:array<array<string>>,kv:map<string,string>>>, lines array<string>"
    rows = [(1, [("", "", [["Torque", "5"]], None)], ["mass 3"]), (2, None, ["torque 6 Nm"]), (3, None, None), (4, [("h", None, None, {"torque": "8 Nm"})], None)]
    docs = spark.createDataFrame(rows, kind)
    terms = spark.createDataFrame([("Torque",), ("Mass",)], "term string")
    want = {(1, "Torque", 5.0, "table"), (1, "Mass", 3.0, "line"), (2, "Torque", 6.0, "line"), (4, "Torque", 8.0, "table")}
    for n in (4096, 1):
        monkeypatch.setattr(V, "TERMS_AT_ONCE", n)
        assert {(r.doc_id, r.term, r.number, r.source) for r in V.document_values(docs, terms).collect()} == want
    head = spark.createDataFrame([(1, [("", "", [["P", "Measured"], ["Torque", "7"]], None)], None)], kind)
    asked = spark.createDataFrame([("Torque", "Measured")], "term string, heading string")
    assert V.document_values(head, asked, raw=True).first().source == "header"
    keys = spark.createDataFrame([(1, "Valve Torque"), (2, "Mass")], "doc_id long, name string")
    assert [(r.doc_id, r.term, r.resolved) for r in V.acceptance_keys(terms, keys).orderBy("doc_id").collect()] == [(1, "Torque", "Valve Torque"), (2, "Mass", "Mass")]


def test_column_forms(spark):
    heads = ["SN4001", "VALVE01_SN4001", "sn 04002", "x 4001", "Q7b", "", None, "SN9"]
    known = spark.createDataFrame([("SN4001",), ("SN4002",), ("Q7",), ("Q7b",), ("",), (None,)], "serial string")
    got = V.serial_keys(spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string"), known, "h", "s").orderBy("i").collect()
    assert [r.s for r in got] == ["SN4001", "SN4001", "SN4002", "x 4001", "Q7b", "", "", "SN9"]
    tests = spark.createDataFrame([("a", "s1"), ("a", "s1"), ("a", "s2"), ("b", "s1")], "term string, serial string")
    assert sorted((r.term_instance) for r in V.most_instances(tests).collect()) == ["a (1)", "a (2)", "b"]
    rows = spark.createDataFrame([(1, "a", None, 2.0, ""), (1, "b", 1.0, None, "V")], "doc_id int, term string, low double, high double, units string")
    more = spark.createDataFrame([(1, "a", 0.5, 9.0, "A")], "doc_id int, term string, low double, high double, units string")
    assert {tuple(r) for r in V.filled_limits(rows, more).collect()} == {(1, "a", 0.5, 2.0, "A"), (1, "b", 1.0, None, "V")}
    lines = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    golden = spark.createDataFrame([(1, "g"), (2, "g")], "doc_id int, text string")
    assert sorted(map(tuple, V.fallback_lines(lines, golden).collect())) == [(1, "x"), (2, "g")]
    found = [spark.createDataFrame(r, "doc_id int, term string, value string") for r in ([(1, "a", None)], [(1, "a", "x"), (1, "b", "y")], [(1, "a", "z")])]
    assert sorted(map(tuple, V.cascade(found).collect())) == [(1, "a", "x", 2), (1, "b", "y", 2)]
    seen = spark.createDataFrame([(1, "a", 1, 1, 2), (1, "a", 1, 1, 1)], "doc_id int, term string, page int, table_no int, row_no int")
    assert {(r.row_no, r.instance) for r in V.instances_in_order(seen).collect()} == {(1, 1), (2, 2)}


KIND = "doc_id long, blocks array<struct<heading:string,label:string,rows:array<array<string>>,kv:map<string,string>>>, lines array<string>"
WORDS = ["valve", "torque", "max", "pressure", "leak", "rate", "№", "é", "a1", "b", "2", "prop"]


def _some_documents(seed, n):
    r = random.Random(seed)
    text = lambda k: r.choice([" ", "-", ""]).join(r.choice(WORDS) for _ in range(r.randrange(k)))
    return [(i, None if r.random() < 0.2 else [(text(2), r.choice(["", "T", None]), [[text(4), str(r.randrange(99))] for _ in range(r.randrange(4))], {V.key_of(text(3)) or "k": "7"} if r.random() < 0.4 else None) for _ in range(r.randrange(3))], [f"{text(5)} {r.randrange(99)}" for _ in range(r.randrange(4))] if r.random() < 0.8 else None) for i in range(n)]


def _some_terms(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(WORDS)[: r.randrange(2, 9)]
    return sorted({(" ".join(word() for _ in range(r.randrange(1, 4))), r.choice(["", " ".join(word() for _ in range(r.randrange(1, 3)))]), r.choice(["", "", "torque"]), r.random() < 0.4) for _ in range(n)})


@pytest.mark.parametrize("raw", [False, True])
def test_index_loses_no_value(spark, monkeypatch, raw):
    docs = spark.createDataFrame(_some_documents(4, 60), KIND)
    terms = spark.createDataFrame(_some_terms(5, 90) + [("№", "", "", False), ("", "", "", True)], "term string, label string, heading string, fuzzy boolean")
    found = []
    for few, at_once in ((10_000, 4096), (0, 4096), (0, 7)):
        monkeypatch.setattr(V, "FEW_TERMS", few)
        monkeypatch.setattr(V, "TERMS_AT_ONCE", at_once)
        found.append(sorted(map(repr, V.document_values(docs, terms, raw=raw).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_index_leaves_most_pairs_out(spark):
    from gaugeweave.operators import termindex
    from gaugeweave.shared import durable

    cells = spark.range(300).selectExpr("id as doc", "concat('serial ', cast(id + 1000 as string)) as text")
    terms = durable(spark.range(300).selectExpr("id", "concat('Serial-', cast(id + 1000 as string)) as term", "'' as label", "false as by_words"))
    got = termindex.candidates(cells, None, terms).collect()
    assert {(i, i) for i in range(300)} <= {(r.doc, r.id) for r in got} and len(got) < 9000  # of 90,000


def test_index_tells_long_numbered_names_apart(spark):
    from gaugeweave.operators import termindex
    from gaugeweave.shared import durable

    name = "concat('Customer#', lpad(cast(id * 37 as string), 9, '0'))"
    lines = spark.range(400).selectExpr("id as doc", f"concat('paid by ', {name}, ' ', cast(id as string)) as text")
    cells = spark.range(400).selectExpr("id as doc", f"substr({name}, 2) as text")  # part of a name
    terms = durable(spark.range(400).selectExpr("id", f"{name} as term", "'' as label", "false as by_words"))
    for c, x in ((lines, None), (cells, None), (cells.limit(0), lines)):
        got = {(r.doc, r.id) for r in termindex.candidates(c, x, terms).collect()}
        assert {(i, i) for i in range(400)} <= got and len(got) < 1000  # of 160,000


def test_a_name_asked_twice_is_found_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, ["torque 5"])], KIND)
    asked = spark.createDataFrame([("torque",), ("torque",)], "term string")
    for few in (64, 0):
        monkeypatch.setattr(V, "FEW_TERMS", few)
        assert [r.number for r in V.document_values(docs, asked).collect()] == [5.0]


def test_acceptance_keys_equal_the_choice_among_all(spark):
    r = random.Random(9)
    names = [(r.randrange(12), " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 4)))) for _ in range(80)] + [(1, "Torque"), (1, "torque"), (2, None), (None, "torque")]
    terms = [t for t in _some_terms(10, 60) if V.key_of(t[0]) or V.key_of(t[1])]
    got = V.acceptance_keys(spark.createDataFrame(terms, "term string, label string, heading string, fuzzy boolean"), spark.createDataFrame(names, "doc_id long, name string"))
    want = []
    for d in {k for k, _ in names}:
        mine = sorted({n for k, n in names if k == d and n})
        want += [(d, t[0], k) for t in terms if (k := V.resolved_key(mine, V.Term(t[0], t[1], fuzzy=t[3])))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and want

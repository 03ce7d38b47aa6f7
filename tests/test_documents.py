import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import documents, incremental, likeness, metadata
from gaugeweave.sources import readers

TEXT = """=== Page 1 ===
[Header]
Ignore this | please
[Line]
Operator        A. RIVERA
Test Plan | TPL-1000
[TABLE_LABEL]
Acceptance Data
+------+------+
| Parameter | Requirement | Measured | Units |
+======+======+
| Torque | <= 5 | 4.5 (ok) | Nm |
| Leak | 1 - 2 | 3 | sccm |
| Note | tbd | 1 | - |
+------+------+
text
+------+
| Parameter | Measured |
| Mass | 7 |
+------+
=== Page 2 ===
Pressure 12.5 psi
"""


def lines(spark, text=TEXT):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(text.split("\n"))], "doc_id long, line_no int, text string")


def test_tables_and_labels(spark):
    rows = documents.table_rows(lines(spark)).orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r.cells[0], r.label) for r in rows][:2] == [(1, 1, "Parameter", "Acceptance Data"), (1, 2, "Torque", "Acceptance Data")]
    assert [r.label for r in rows if r.table_no == 2] == [None, None]
    assert {r.page for r in rows} == {1}


def test_key_values_skip_headers(spark):
    got = {(r.term, r.value) for r in documents.key_values(lines(spark)).collect()}
    assert got == {("Operator", "A. RIVERA"), ("Test Plan", "TPL-1000")}


def test_key_value_bounds(spark):
    text = "\n".join(f"{'t' * n} | {'v' * m}" for n, m in [(81, 1), (120, 200), (121, 1), (1, 201)])
    assert {(len(r.term), len(r.value)) for r in documents.key_values(lines(spark, text)).collect()} == {(81, 1), (120, 200)}


def test_acceptance_tests(spark):
    got = {r.term: r for r in documents.acceptance_tests(lines(spark)).collect()}
    assert got["Torque"].computed_pass is True and got["Torque"].measured_note == "ok"
    assert got["Leak"].computed_pass is False and got["Note"].computed_pass is True
    assert "Mass" not in got  # a term and a value alone are no acceptance table
    labelled = TEXT.replace("text\n+------+", "[TABLE_LABEL]\nAcceptance of mass\n+------+")
    mass = {r.term: r for r in documents.acceptance_tests(lines(spark, labelled)).collect()}["Mass"]
    assert mass.measured_value == 7 and mass.requirement_type == "unknown"


def table(*rows):
    return "\n".join(["+---+", *("| " + " | ".join(r) + " |" for r in rows), "+---+", "", ""])


def test_column_roles_and_limits(spark):
    text = "=== Page 1 ===\n" + table(["Tag", "Desc", "Minimum", "Max", "Results", "UOM"], ["A", "first", "1", "2", "1.5", "V"], ["B", "second", "", "2", "3", "V"], ["C", "", "4", "", "-", "V"]) + table(["Field", "Value"], ["SERIAL", "SN7"], ["rev", "B"], ["Serial", "SN8"]) + table(["Test date", "x"], ["1", "2"]) + "[TABLE_LABEL]\nCalibration\n" + table(["Channel", "Reading"], ["1", "5"]) + "=== Page 2 ===\n" + table(["Channel", "As-Found"], ["2", "6"]) + table(["Parameter", "Target", "Outcome"], ["D", "5", "PASS"])
    rows = lines(spark, text)
    got = {r.term: r for r in documents.acceptance_tests(rows).collect()}
    assert set(got) == {"A", "B", "C", "D"}, sorted(got)
    assert (got["A"].requirement_raw, got["A"].measured_value, got["A"].computed_pass, got["A"].units, got["A"].description) == ("1 - 2", 1.5, True, "V", "first")
    assert (got["B"].requirement_raw, got["B"].computed_pass) == ("<= 2", False) and (got["C"].requirement_raw, got["C"].computed_pass) == (">= 4", None)
    assert (got["D"].requirement_type, got["D"].result, got["D"].computed_pass) == ("max", "PASS", None)
    at = documents.column_roles(documents.table_rows(rows)).filter("table_no = 1").first()
    assert (at.at_term, at.at_min, at.at_max, at.at_value, at.at_status, at.at_units) == (1, 3, 4, 5, None, 6)
    profile = documents.document_profile(rows).first()
    assert (profile.serial, profile.revision, profile.program) == ("SN8", "B", None)
    assert [[(c.key, c.value) for c in r.cells] for r in documents.calibrations(rows).orderBy("table_no").collect()] == [[("Channel", "1"), ("Reading", "5")], [("Channel", "2"), ("As-Found", "6")]]
    parts = documents.extracted(rows)
    assert set(parts) == {"documents", "acceptance_tests", "kv_pairs", "test_data", "calibration"} and parts["test_data"].count() == 10


def test_line_values_and_cascade(spark):
    terms = spark.createDataFrame([("Pressure",), ("Torque",)], "term string")
    got = documents.line_values(lines(spark), terms).collect()
    assert [(r.term, r.value) for r in got] == [("Pressure", 12.5)]
    c = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("a", 3, "y")], "k string, priority int, value string")
    assert documents.cascade(c, ["k"]).first().value == "x"


def test_empty_documents(spark):
    none = lines(spark).limit(0)
    assert documents.table_rows(none).count() == documents.acceptance_tests(none).count() == documents.key_values(none).count() == 0


def test_scan_changes_and_moves(spark):
    a = spark.createDataFrame([("p1", "f1", True), ("p2", "f2", False), ("p3", "f3", True), ("p4", "f4", True)], "path string, fingerprint string, processed boolean")
    b = spark.createDataFrame([("p1", "f1"), ("p2", "f2"), ("p3", "f3b"), ("p5", "f4")], "path string, fingerprint string")
    c = incremental.changes(a, b)
    assert {r.path: r.state for r in c.collect()} == {"p1": "unchanged", "p2": "pending", "p3": "changed", "p4": "gone", "p5": "new"}
    assert [tuple(r) for r in incremental.moves(c).collect()] == [("p5", "p4")]
    assert {r.path: r.processed for r in incremental.merge(a, b).collect()} == {"p1": True, "p2": False, "p3": False, "p5": False}


def test_allowlist_and_rules(spark):
    blobs = spark.createDataFrame([(1, "the Star Link unit"), (2, "VLV-42A here"), (3, "nothing"), (4, None)], "k int, b string")
    allow = spark.createDataFrame([("Starlink", "star link"), ("Star", "star"), ("VLV-42A", "VLV 42A")], "canonical string, alias string")
    assert {r.k: r.canonical for r in metadata.allowlist(blobs, allow, "k", "b").collect()} == {1: "Starlink", 2: "VLV-42A", 3: "Unknown", 4: "Unknown"}
    assert {r.canonical for r in metadata.allowlist(blobs, allow.limit(0), "k", "b").collect()} == {"Unknown"}
    rules = [metadata.LabelRule("a", 1, any_of=("star",)), metadata.LabelRule("b", 1, all_of=("star", "link")), metadata.LabelRule("c", 2, any_of=("vlv",), none_of=("here",))]
    got = metadata.rule_labels(blobs.withColumn("n", F.length("b")), rules, "b", "n").collect()
    assert {r.k: r.label for r in got} == {1: "b", 2: None, 3: None, 4: None}


def test_line_values_of_long_terms_strings_and_next_lines(spark):
    text = "the one two three four five six seven eight nine term: 4.5 x\n  Proof Pressure\n  77 psi\nOperator : A. RIVERA\nModel - X-5"
    long = "The one two three four five six seven eight nine term"
    terms = spark.createDataFrame([(long,), ("Proof pressure",), ("operator",), ("Model",)], "term string")
    got = {r.term: r.value for r in documents.line_values(lines(spark, text), terms).collect()}
    assert got[long] == 4.5 and got["Proof pressure"] == 77
    got = {r.term: r.value for r in documents.line_values(lines(spark, text), terms, want="string").collect()}
    assert got == {long: "4.5 x", "operator": "A. RIVERA", "Model": "X-5"}


def test_table_rules(spark):
    t = spark.createDataFrame([(1, 1, 1, ["Parameter", "Limit"]), (1, 1, 2, ["Leak \"rate\"", "5"]), (1, 2, 1, ["Parameter"]), (1, 3, 1, ["", None])], "doc_id int, table_no int, row_no int, cells array<string>")
    R = metadata.LabelRule
    label = lambda *rules: {r.table_no: r.label for r in metadata.table_labels(t, list(rules)).collect()}
    assert label(R("wide", min_cols=2), R("any")) == {1: "wide", 2: "any", 3: None}
    assert label(R("two", min_rows=2)) == {1: "two", 2: None, 3: None} and label(R("one", max_rows=1, max_cols=1)) == {1: None, 2: "one", 3: None}
    assert label(R("x", all_of=("leak rate",)))[1] == "x" and label(R("x", all_of=("leak",), scope="header_row"))[1] is None
    assert label(R("x", any_of=("leak",), scope="first_col"))[1] == "x" and label(R("x", any_of=("limit",), scope="first_col"))[1] is None
    with pytest.raises(ValueError):
        metadata.rule_labels(t, [R("x", min_rows=1)], "doc_id", "doc_id")


def test_strict_fields(spark):
    allow = spark.createDataFrame([("Starlink", "star link"), ("VLV-42A", "VLV_42A")], "canonical string, alias string")
    rows = [(1, "Star Link", "vlv 42a", "/a/b.pdf"), (2, None, "the VLV 42A unit", "/star link/x.pdf"), (3, None, "none", "/vlv 42a/starlink_report.pdf"), (4, None, None, "/Star-Link/1/2/3/4/x.pdf"), (5, None, None, "/star link/1/2/3/4/5/x.pdf"), (6, "", "", r"C:\VLV 42A\q\x.pdf"), (7, None, None, "/my starlink folder/x.pdf"), (8, None, None, None)]
    docs = spark.createDataFrame(rows, "k int, labelled string, pages string, path string")
    got = {r.k: r.canonical for r in metadata.strict_field(docs, allow, "k", ["labelled", "pages"], "path").collect()}
    assert got == {1: "Starlink", 2: "VLV-42A", 3: "Starlink", 4: "Starlink", 5: "Unknown", 6: "VLV-42A", 7: "Unknown", 8: "Unknown"}


def test_similar_titles(spark):
    rows = spark.createDataFrame([(1, "Valve Report A"), (2, "valve report b"), (3, "Pump"), (4, " "), (5, None)], "k int, t string")
    got = {r.k: r.group_id for r in likeness.group_similar(rows, "k", "t").collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] == "unknown"


def test_settings():
    assert readers.env_file("# c\nA=1\n\nB = 'x y'\nbad") == {"A": "1", "B": "x y"}
    assert readers.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert readers.split_dirs("Old; tmp,OLD") == {"old", "tmp"}


def test_acceptance_rows_are_computed_once(spark):
    text = ["=== Page 1 ===", "+--+--+", "| Parameter | Min | Max | Measured |", "| P | 1 | 5 | 3 |", "+--+--+"]
    lines = spark.createDataFrame([(d, n, t) for d in range(3) for n, t in enumerate(text)], "doc_id long, line_no int, text string")
    out = documents.acceptance_tests(lines)
    assert sorted((r.doc_id, r.term, r.measured_value, r.computed_pass) for r in out.collect()) == [(d, "P", 3.0, True) for d in range(3)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()

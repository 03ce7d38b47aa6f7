"""Names and codes, metadata from texts, folders and cells, allowlists, population rules."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeweave.functions import identities as I
from gaugeweave.operators import resolvers as R


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names_and_codes(spark):
    assert one(spark, ["My Title-1", None, "!"], I.title_key) == ["mytitle1", "", ""]
    assert one(spark, ["The “Big” A/B - 1.5,  x_y", None], I.phrase_text) == ["the big a/b - 1.5 x_y", ""]
    assert one(spark, ["A b/C  1", None], I.fact_text) == ["a b c 1", ""]
    assert one(spark, ["Run 1", "1x", "  "], I.sheet_table) == ["sheet__Run_1", "sheet___1x", "sheet__sheet"]
    assert one(spark, ["code ab_12 here", "Star Link - 2", "", None], I.program_code) == ["AB_12", "STAR_LINK_2", "", ""]
    got = one(spark, ["/a/Prog_V1_SN1001.xlsx", "P.xlsx", "A_B_sn-x.xlsm", "a_SN5_b.xls"], I.workbook_identity)
    assert [tuple(r) for r in got] == [("Prog", "V1", "SN1001"), ("P", "", ""), ("A", "B", "SN-X"), ("a", "SN5", "SN5")]
    got = one(spark, ["/x/A_B_C_D.pdf", "A_SN1.pdf", "SN1.pdf", "_.pdf"], I.package_identity)
    assert [tuple(r) for r in got] == [("A", "B", "C_D"), ("A", "", "SN1"), ("", "", "SN1"), ("", "", "_")]
    assert [str(x) for x in one(spark, ["2024-01-02 03:04:05", "2024/1/2 3:4:5", "1/2/2024 3:04", "2024-01-02", "x", None], I.run_time)] == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 03:04:00", "2024-01-02 00:00:00", "None", "None"]
    assert one(spark, ["Acceptance Test Plan: ATP 1234", "per TP-001a", "see ATP_77", "no plan", None], I.plan_number) == ["ATP1234", "001A", "77", None, None]
    rows = spark.createDataFrame([("num", None, None), ("title", "number", None), ("", None, "String "), (None, "string", "number"), (None, None, None)], "s string, e string, h string")
    assert [r[0] for r in rows.select(I.return_type(F.col("s"), F.col("e"), F.col("h"))).collect()] == ["number", "string", "string", "string", "number"]
    payload = {"a": "x?>~", "b": 1}
    token = spark.range(1).select(I.pointer_token(F.struct(F.lit("x?>~").alias("a"), F.lit(1).alias("b"))).alias("t")).withColumn("p", I.pointer_payload(F.col("t"))).first()
    assert token.t == "PTR:" + base64.urlsafe_b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode() and json.loads(token.p) == payload
    assert one(spark, [b"abc"], I.file_sha1, "binary") == [hashlib.sha1(b"abc").hexdigest()]
    assert one(spark, [1_700_000_000_123_456_789, 0, None], I.shown_time, "long") == ["2023-11-14 22:13:20", "", ""]
    assert one(spark, [" 1.5 ", "1e3", "1,000", "x", "", None], I.plain_number) == [1.5, 1000.0, None, None, None, None]
    assert one(spark, ['{"a": {"b": "c"}}', '{"a": 1}', "x", None], lambda c: I.json_path(c, "a..b")) == ["c", None, None, None]
    assert one(spark, ["/a/Skip/b", "/a/keep/b", None], lambda c: I.ignored_path(c, ["skip"])) == [True, False, False]
    frame = spark.createDataFrame([(" x ", None)], "term string, OTHER string")
    assert frame.select(I.either_case(frame.columns, "Term").alias("a"), I.either_case(frame.columns, "other").alias("b"), I.either_case(frame.columns, "none").alias("c")).first() == ("x", "", "")
    assert spark.range(1).select(I.first_existing([F.lit("a"), F.lit("b")], F.array(F.lit("b"), F.lit("c"))).alias("x")).first().x == "b"


def test_test_data_documents(spark):
    assert I.short_aliases(["TD", "Test-Data", "T D"]) == (["td"], ["t d", "test data"])
    docs = spark.createDataFrame([(1, "Test Data", None, None), (2, None, "td", None), (3, "EIDP", "EIDP", "a/test_data/x"), (4, None, None, "std/x"), (5, None, None, "x/TD/y")], "i int, t string, a string, p string")
    got = docs.select("i", I.is_test_data(F.col("t"), F.col("a"), [F.col("p")], ["TD", "Test Data"]).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [True, True, True, False, True]


def test_configuration(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "good.json").write_text('{"a":\n 1}')
    assert R.first_json(spark, [f"file://{tmp_path}/none.json", f"file://{tmp_path}/bad.json", f"file://{tmp_path}/good.json"], {}) == {"a": 1} and R.first_json(spark, [], {"d": 2}) == {"d": 2}
    assert R.alias_entries(["A", {"name": "B", "aliases": ["b1", "B"]}, {"aliases": ["c"]}, {}, 5, " "]) == [("A", "A", ["A"]), ("B", "B", ["b1", "B"]), ("c", "c", ["c"])]
    assert R.alias_entries([{"name": "End Item", "acronym": "EIDP"}], True) == [("End Item", "EIDP", ["End Item", "EIDP"])] and R.alias_entries("x") == []
    labels = R.merged_labels({"vendor": ["OEM", "maker"], "unknown": ["x"], "revision": "no list"})
    assert labels["vendor"][-1] == "maker" and labels["vendor"].count("oem") == 1 and "unknown" not in labels
    assert R.merged_part_labels(["SKU", "code"])[-1] == "code" and R.merged_part_labels(None) == R.PART_LABELS


TEXT = """=== Page 1 ===
Program Title: Starlink Bus
| Vendor | Acme Corp |
Part No. - VLV 42A
Revision: b
Test Date
2024/3/5
Report Date: soon
on 3-7-2024 done
valve valve pump SN0012
=== Page 4 ===
Vendor: Other Inc
"""


def test_text_parts(spark):
    assert one(spark, [TEXT], lambda c: R.first_pages(c))[0].endswith("SN0012") and one(spark, ["a\n\n b "], lambda c: R.first_pages(c, most=1)) == ["a"]
    lines = lambda f: one(spark, [TEXT], lambda c: f(R.lines_of(c)))[0]
    assert lines(lambda x: R.label_value(x, "Vendor")) == "Acme Corp" and lines(lambda x: R.label_value(x, "test date")) == "2024/3/5"
    assert lines(lambda x: R.label_value(x, "part no")) == "VLV 42A" and lines(lambda x: R.label_value(x, "missing")) is None
    assert lines(lambda x: R.first_label_value(x, ["missing", "revision"])) == "b" and lines(lambda x: R.first_label_value(x, [])) is None
    assert lines(R.program_title) == "Starlink Bus" and one(spark, ["Program Code: x\nProgram: Y\n| Title | Z |"], lambda c: R.program_title(R.lines_of(c))) == ["Z"]
    assert one(spark, ["| Model | X-1 |\n| P/N | AB-77 |", "| pn | 1 |"], lambda c: R.part_number(R.lines_of(c), R.PART_LABELS)) == ["X-1", None]
    assets = ["Pump", "Valve"]
    assert one(spark, [TEXT], lambda c: R.asset_in_text(c, assets)) == ["Pump"] and one(spark, [TEXT], lambda c: R.asset_by_frequency(c, assets)) == ["Valve"]
    assert one(spark, ["one pump"], lambda c: R.asset_by_frequency(c, assets)) == [None] and one(spark, ["/x/MyValves_1.pdf"], lambda c: R.asset_in_name(c, assets)) == ["Valve"]
    assert one(spark, ["| valve model | x |\n| a | b |", "text"], lambda c: R.asset_in_fields(R.lines_of(c), assets)) == ["Valve", None]
    assert one(spark, [" big  VALVE ", "valve"], lambda c: R.exact_candidate(c, ["Big Valve"])) == ["Big Valve", None]
    assert one(spark, ["End Item Data Package\nvalve\nData package (EIDP)"], lambda c: R.without_type_lines(R.lines_of(c))) == [["valve"]]
    entries = R.alias_entries([{"name": "Test Data", "acronym": "TD"}, {"name": "End Item", "acronym": "EIDP"}], True)
    assert one(spark, ["an EIDP of test data", "none"], lambda c: R.first_type(c, entries)) == ["TD", None]
    assert one(spark, ["a.xlsx", "a.pdf"], lambda c: R.default_type(c, ["eidp"])) == [None, "eidp"]
    assert one(spark, ["a\nReport date: none\nx\n2024-1-2\n2020-1-1", "2021-05-06\n" * 2, "x"], lambda c: R.report_date(R.lines_of(c), R.LABELS["report_date"])) == ["2024-01-02", "2021-05-06", None]
    assert one(spark, ["on 3-7-2024 done", None], R.found_date) == ["2024-03-07", None]


def allowed(spark):
    made = {"program_title": [{"name": "Starlink", "aliases": ["Star Link", "starlink bus"]}], "vendor": ["Acme", "Other Inc"], "part_number": ["VLV-42A"], "asset_type": ["Pump", "Valve"]}
    return {k: R.allow_table(spark, v) for k, v in made.items()} | {"document_type": R.allow_table(spark, [{"name": "Test Data", "acronym": "TD"}, {"name": "End Item Data Package", "acronym": "EIDP"}], True)}


def test_text_metadata(spark):
    docs = spark.createDataFrame([(1, "/data/x/report.pdf", TEXT), (2, "/data/Valve/TD/b.xlsx", "nothing here"), (3, "/d/c.pdf", None), (4, "/Test Data/d.pdf", "")], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in R.text_metadata(docs, allowed(spark)).collect()}
    a = got[1]
    assert (a.program_title, a.vendor, a.part_number, a.revision, a.test_date, a.report_date, a.serial_number, a.document_type) == ("Starlink", "Acme", "VLV-42A", "B", "2024-03-05", "2024-03-07", "SN0012", "EIDP")
    assert (got[2].asset_type, got[2].document_type, got[2].vendor, got[2].acceptance_test_plan_number) == ("Valve", "TD", "Unknown", "Unknown")
    assert (got[3].document_type, got[3].program_title, got[4].document_type) == ("EIDP", "Unknown", "TD") and len(got) == 4
    old = spark.createDataFrame([(1, "Old", "Kept"), (3, "Old", "Unknown")], "doc_id long, vendor string, asset_specific_type string")
    new = {r.doc_id: r for r in R.refreshed(old, docs, allowed(spark)).collect()}
    assert (new[1].vendor, new[1].asset_specific_type, new[3].vendor) == ("Acme", "Kept", "Old")


def test_sanitized_and_sheets(spark):
    meta = spark.createDataFrame([(1, "made by ACME", "x", "y"), (2, "nobody", "x", "test data"), (3, None, None, None)], "doc_id long, vendor string, asset_specific_type string, document_type string").withColumn("secret", F.lit("z"))
    got = {r.doc_id: r for r in R.sanitized(meta, allowed(spark)).collect()}
    assert [(got[i].vendor, got[i].asset_specific_type, got[i].document_type) for i in (1, 2, 3)] == [("Acme", "Unknown", "EIDP"), ("Unknown", "Unknown", "TD"), ("Unknown", "Unknown", "EIDP")]
    assert "secret" not in R.sanitized(meta, {}).columns and R.sanitized(meta, {}).first().document_type == "Unknown"
    cells = spark.createDataFrame([(1, 0, 1, 1, "Vendor:"), (1, 0, 1, 3, "Acme"), (1, 0, 2, 1, "Serial Number"), (1, 0, 3, 1, "SN7"), (1, 7, 1, 1, "Revision"), (1, 7, 1, 2, "A"), (2, 0, 1, 1, "x")], "doc_id long, sheet_no int, row int, col int, value string")
    got = {r.doc_id: r for r in R.sheet_metadata(cells).collect()}
    assert (got[1].vendor, got[1].serial_number, got[1].revision) == ("Acme", "SN7", None) and got[2].vendor is None


def test_population_rules(spark):
    fields = {"program_title": ("program", "programs"), "vendor": ("vendor",)}
    raw = {"programs": ["B ", "A", "A"], "program": "C", "vendor": [], "other": ["x"]}
    assert R.population_rules(raw, fields) == {"program_title": ["A", "B", "C"]} and R.population_rules(raw, fields, lower=True) == {"program_title": ["a", "b", "c"]} and R.population_rules({}, fields) == {}
    assert R.population_description({"vendor": ["b", "a"], "program_title": {"P"}}) == "Continuous plotting enabled by Program: P; Vendor: a, b" and R.population_description({}) == ""
    docs = spark.createDataFrame([("a", None), (" B", "v"), ("z", None), (None, None)], "program_title string, vendor string")
    assert docs.filter(R.matches_population(R.population_rules(raw, fields, lower=True))).count() == 2 and docs.filter(R.matches_population({})).count() == 0


@pytest.mark.parametrize("text", ["", "\n\n", "|", "x" * 100_000])
def test_odd_texts(spark, text):
    docs = spark.createDataFrame([(1, "p.pdf", text)], "doc_id long, path string, text string")
    assert R.text_metadata(docs, {}).first().vendor == "Unknown"


def test_short_and_long_lists_give_the_same(spark, monkeypatch):
    from gaugeweave.operators import metadata as M

    names = [("A", "star link"), ("B", "star"), ("C", "Link Two"), ("D", "link_two"), ("A", "valve"), ("E", "Valve"), ("F", "")]
    table = spark.createDataFrame(names, "canonical string, alias string")
    docs = spark.createDataFrame([(1, "/a/Valve/Star Link/x.pdf", "the Star-Link here"), (2, "/star/valve/x.pdf", None), (3, "/x/link two/starry.pdf", "starlink"), (4, "my_star.pdf", ""), (5, None, "Valve of link two"), (6, "/valve/pumps/star/x", "none")], "doc_id int, path string, text string")
    got = []
    for most in (200, 2):
        monkeypatch.setattr(M, "ALIASES_IN_PLACE", most)
        got.append([sorted(map(tuple, M.allowlist(docs, table, "doc_id", "text").collect())), sorted(map(tuple, M.strict_field(docs, table, "doc_id", ["text"], "path").collect()))])
    assert got[0] == got[1] and dict(got[0][1]) == {1: "A", 2: "A", 3: "C", 4: "B", 5: "C", 6: "A"}


def test_metadata_by_short_lists_stays_in_place_and_equals_that_by_long_ones(spark, monkeypatch):
    from gaugeweave.operators import metadata as M

    texts = [TEXT, None, "", "part | x", "| Vendor of | acme |\n| sn | SN1 |", "Vendor\n+---+\nvendor -\nOther Inc", "| v |\nvendor: | acme", "Rev: |", "20\nreport date\n\n1\n2\n2024-1-2\n2023-1-1", "test_data of star_link\n" + "line\n" * 900 + "vendor: acme"]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate((p, t) for p in ("/data/Valve/eidp/my_pump.pdf", "x.xlsx", None) for t in texts)], "doc_id long, path string, text string")
    got = []
    for most in (200, 1):
        monkeypatch.setattr(M, "ALIASES_IN_PLACE", most)
        got.append(R.text_metadata(docs, allowed(spark)))
    assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, got[1].collect()))
    plan = got[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan

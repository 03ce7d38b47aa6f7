"""Registries, certificates, runs; repository scans; the test-data cache; configuration sheets; sinks."""

import json

import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import cache as C
from gaugeweave.operators import incremental as N
from gaugeweave.operators import registry as G
from gaugeweave.sources import configs, readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_projects(spark):
    none = frame(spark, [], G.PROJECT)
    a = G.create_projects(none, frame(spark, [("P2", None), ("P1", "x")], "name string, description string"))
    assert [(r.id, r.name, r.grouping_strategy) for r in a.orderBy("id").collect()] == [(1, "P1", "program"), (2, "P2", "program")]
    docs = frame(spark, [(1, "Apollo"), (2, "Apollo"), (3, ""), (4, None), (5, "Gemini")], "id long, program string")
    b = G.projects_by_program(a, docs)
    assert [(r.id, r.name) for r in b.orderBy("id").collect()][2:] == [(3, "Apollo Project"), (4, "Gemini Project")] and G.projects_by_program(b, docs).count() == 4
    bridge = G.linked_by_program(b, docs, frame(spark, [(3, 1)], "project_id long, document_id long"))
    assert sorted(map(tuple, bridge.collect())) == [(3, 1), (3, 2), (4, 5)]
    assert G.project(b, 4).first().name == "Gemini Project" and G.project(b, 9).count() == 0
    assert G.project_named(b, "P1").count() == 4 and G.project_named(b, "New").count() == 5
    assert [r.id for r in G.list_projects(b.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))).collect()] == [4, 3, 2, 1]
    settings = frame(spark, [(3, "T", 1)], "project_id long, term_id string, enabled int")
    p, l, s = G.delete_projects(b, bridge, settings, frame(spark, [(3,)], "id long"))
    assert p.count() == 3 and [tuple(r) for r in l.collect()] == [(4, 5)] and s.count() == 0
    assert G.present_projects(b.withColumn("folder", F.col("name")), frame(spark, [("P1",)], "path string")).count() == 1


def test_terms(spark):
    registry = G.default_registry(spark)
    assert registry.count() == 10 and [r.term_id for r in G.terms_of(registry, "timing").collect()] == ["CLOSE_T", "OPEN_T"] and G.terms_of(registry).first().category == "flow" and G.term(registry, "HYST").count() == 1
    tests = frame(spark, [(1, 7, "NEW", "first", "V", "max", None, 5.0), (2, 3, "NEW", "earlier", "A", "min", 1.0, None), (3, 3, "PROOF", "x", "psi", "min", None, None), (4, 3, "", None, None, None, None, None), (5, 3, None, None, None, None, None, None)], "id long, document_id long, term string, description string, units string, requirement_type string, requirement_min double, requirement_max double")
    more = G.register_tests(registry, tests)
    new = more.filter("term_id = 'NEW'").first()
    assert more.count() == 11 and (new.description, new.expected_units, new.default_min, new.category) == ("earlier", "A", 1.0, None) and G.register_tests(more, tests).count() == 11
    bridge = frame(spark, [(1, 3), (1, 7), (2, 7)], "project_id long, document_id long")
    assert sorted(map(tuple, G.used_terms(bridge, tests).collect())) == [(1, "NEW"), (1, "PROOF"), (2, "NEW")]
    none = frame(spark, [], "project_id long, term_id string, enabled int, display_order int, custom_min double, custom_max double")
    on = G.enable_used(none, bridge, tests)
    assert sorted((r.project_id, r.term_id, r.display_order) for r in on.collect()) == [(1, "NEW", 1), (1, "PROOF", 2), (2, "NEW", 1)]
    off = G.disable(on, frame(spark, [(1, "NEW"), (9, "X")], "project_id long, term_id string"))
    assert [r.term_id for r in G.enabled_terms(more, off, 1).collect()] == ["PROOF"] and off.count() == 3
    again = G.enable(off, frame(spark, [(1, "NEW", 9)], "project_id long, term_id string, display_order int"))
    assert [r.term_id for r in G.enabled_terms(more, again, 1).collect()] == ["PROOF", "NEW"]
    assert G.add_columns(registry, {"TERM_ID": "string", "note": "string"}).columns == [*registry.columns, "note"]
    projects, registry2, links, settings = G.set_up(frame(spark, [], G.PROJECT), registry, frame(spark, [(3, "A"), (7, "A")], "id long, program string"), frame(spark, [], "project_id long, document_id long"), none, tests)
    assert (projects.count(), registry2.count(), links.count(), settings.count()) == (1, 11, 2, 2)


def test_certificates(spark):
    docs = frame(spark, [(1, "f1"), (2, "f1"), (3, "f2"), (4, "f3")], "id long, folder string")
    tests = frame(spark, [(1, "a", True), (1, "b", True), (2, "a", False), (2, "b", None), (3, "c", None), (3, "c", True)], "document_id long, term string, computed_pass boolean")
    found = G.certificates(docs, tests)
    got = {r.document_id: r for r in found.collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["CERTIFIED", "FAILED", "PENDING", "NO_DATA"] and got[2].failed_terms == ["a"] and got[2].pending_terms == ["b"] and got[4].total_tests == 0
    back = G.certified_documents(docs, found, F.lit("now"))
    read = {r.id: r for r in G.certificate_of(back).collect()}
    assert (read[2].certification_status, read[2].certification_pass_rate, read[1].certification_pass_rate, read[4].certification_pass_rate, read[1].certification_analyzed_at) == ("FAILED", "0/2", "2/2", "", "now")
    assert G.certified_documents(back, found).columns == back.columns
    by = {r.folder: r.status for r in G.folder_certificates(docs.withColumn("error", F.when(F.col("id") == 3, "bad")), found).collect()}
    assert by == {"f1": "CERTIFIED", "f2": "ERROR", "f3": "NO_DATA"}


def test_runs_and_workspace(spark):
    runs = frame(spark, [("SN1", "2024-01-05 00:00:00", "", "", "r1"), ("SN2", "2024-01-05", "P", "V", "r2"), ("SN3", "bad", "", "", "r3")], "serial string, run_date string, program string, vehicle string, run_folder string")
    folders = frame(spark, [("r1", True), ("r2", False), ("r9", True)], "path string, has_results boolean")
    assert [r.serial for r in G.prune_runs(runs, folders).collect()] == ["SN1"] and G.delete_runs(runs, ["SN1", "x"]).count() == 2
    assert [r.path for r in G.stale_folders(folders, runs, frame(spark, [("zz",)], "run_folder string")).collect()] == ["r9"]
    packs = frame(spark, [("A_V_SN1.pdf", "2024-02-01"), ("B_SN1.pdf", "2024-01-01"), ("SN2.pdf", "2024-01-01"), ("SN3.pdf", "2024-01-01"), ("SN4.pdf", "2024-01-01")], "path string, mtime string").withColumn("mtime", F.to_timestamp("mtime"))
    synced = G.workspace_sync(packs, runs, frame(spark, [("SN1", 2), ("SN2", 0)], "serial string, n int"))
    assert {r.path: (r.reason, r.program, r.vehicle) for r in synced.collect()} == {"A_V_SN1.pdf": ("pdf_newer", "A", "V"), "B_SN1.pdf": ("terms_newer", "B", ""), "SN2.pdf": ("up_to_date", "P", "V"), "SN3.pdf": ("new", "", ""), "SN4.pdf": ("new", "", "")}
    assert G.sync_counts(synced).first().asDict() == {"total": 5, "new": 2, "pdf_newer": 1, "terms_newer": 1, "up_to_date": 1}
    schema = frame(spark, [("Torque", "A"), ("Mass", "A"), ("Leak", ""), ("", "A")], "term_label string, data_group string")
    master = frame(spark, [("torque", "a", "SN1", "5", 1), ("torque", "a", "SN2", "N/A", 1), ("Mass", "A", "SN1", "1", 2), ("mass", "A", "SN1", "", 3), ("Mass", "A", "SN2", "2", 2), ("Program", "", "SN1", "x", 4)], "term_label string, data_group string, serial string, value string, row_no int")
    assert sorted(r.term_label for r in G.missing_term_rows(schema, master, ["SN1", "SN2"]).collect()) == ["Leak", "Mass"] and G.missing_term_rows(schema, master.limit(0), ["SN1"]).count() == 3
    res = frame(spark, [("SN1", "SN1", "T ", "G"), ("SN1", "", "t", "g"), ("SN1", "SN9", "u", ""), ("SN1", None, " ", "")], "serial string, row_serial string, term_label string, data_group string")
    assert [(r.serial, [tuple(t) for t in r.terms]) for r in G.run_terms(res).collect()] == [("SN1", [("t", "g")])]
    assert G.bad_sources(frame(spark, [("OK",), ("error",), (None,)], "status string")).first()[0] == 2


def test_plots_nodes_and_limits(spark):
    rows = frame(spark, [("b", "T", None, "u", ""), (" A ", "", "", "", "y"), ("", "x", "", "", "")], "`Plot Name` string, `Term Label` string, `Data Group` string, Units string, `Y Axis` string")
    assert [r.name for r in G.plot_series(rows).collect()] == ["A", "b"]
    plots = frame(spark, [(None, [" s ", ""], None, " ", "no", None), ("n", None, "y", "T", "1", "off")], "name string, series array<string>, y_axis string, x_axis string, include_min string, include_max string")
    assert [tuple(r) for r in G.proposed_plots(plots).collect()] == [("Plot", ["s"], "", "SN", False, True), ("n", [], "y", "T", True, False)]
    docs = frame(spark, [(1, True, "t", "S1"), (2, True, None, "S2"), (3, False, None, " S3 "), (4, False, None, "")], "id int, is_test_data boolean, workbook_table string, serial string")
    assert [r.id for r in G.project_allowed("test_data", docs).collect()] == [1] and [r.id for r in G.project_allowed("acceptance", docs).collect()] == [3] and [r.serial for r in G.project_serials(docs).collect()] == ["S1", "S2", "S3"]
    table = frame(spark, [("a", "f1")], "name string, folder string")
    assert sorted(r.folder for r in G.migrated(table, frame(spark, [("x", "f1"), ("y", "f2"), ("y2", "f2"), ("", "f3"), ("z", None)], "name string, folder string")).collect()) == ["f1", "f2"]
    assert [r.n for r in G.nodes(frame(spark, [(1, False, 9), (2, True, 1), (3, True, 2)], "n int, enabled boolean, updated_at int")).collect()] == [3, 2, 1]
    done = frame(spark, [(i, ok) for i, ok in enumerate([True, False, True, False, True])], "order_no int, ok boolean")
    assert [r.order_no for r in G.until_successes(done, 2).collect()] == [0, 1, 2]
    files = frame(spark, [("a", 1, True), ("b", 3, False), ("c", 2, True)], "rel_path string, mtime_ns long, needs_processing boolean")
    assert [r.rel_path for r in G.candidates_to_process(files).collect()] == ["c", "a"] and [r.rel_path for r in G.candidates_to_process(files, True).collect()] == ["b", "c", "a"]


def test_index_and_sets(spark):
    docs = frame(spark, [(1, "P", "m1_metadata.json", "g"), (2, "A", "x/f.metadata.json", "g"), (3, "A", "a", None)], "id long, program_title string, metadata_rel string, similarity_group string")
    got = G.index_documents(docs)
    assert [r.id for r in got.collect()] == [3, 2, 1] and got.columns[-1] == "similarity_group" and "vendor" in got.columns
    counts = G.group_counts(docs.withColumn("title_norm", F.lit("t")))
    assert [tuple(r) for r in G.index_groups(counts.unionByName(frame(spark, [("z", "u", 9)], "group_id string, title_norm string, member_count long"))).collect()] == [("z", "u", 9), ("g", "t", 2)]
    files = frame(spark, [("d/m1.pdf", 1), ("f.xlsx", 2), ("none.pdf", 3)], "rel_path string, id long")
    assert [(r.rel_path, r.program_title) for r in G.files_with_metadata(files, docs).collect()] == [("d/m1.pdf", "P"), ("f.xlsx", "A"), ("none.pdf", None)] and [r.id for r in G.support_files(files).collect()] == [1, 2, 3]
    keys = "term string, data_group string"
    assert {tuple(r) for r in G.term_key_difference(frame(spark, [("A", "x"), ("b", None), ("", "q")], keys), frame(spark, [("a ", "X"), ("c", "")], keys)).collect()} == {("b", "", "schema"), ("c", "", "observed")}
    rows = frame(spark, [(1, ["Term ", "VALUE", "x"]), (2, ["term"])], "i int, h array<string>")
    assert [r.i for r in rows.filter(G.has_headers(F.col("h"), ["term", "Value"])).collect()] == [1]
    metas = frame(spark, [('{"selected_metadata_rel": ["b ", "a", "b", ""]}',), ('{"selected_metadata_rel": 1}',), ("x",)], "m string")
    assert [r.x for r in metas.select(G.selected_metadata(F.col("m")).alias("x")).collect()] == [["a", "b"], [], []]
    assert [r.v for r in G.series_by_position(frame(spark, [("t", 2, "y"), ("t", 1, "x"), ("u", 0, "z")], "term string, position int, v string"), "t").collect()] == ["x", "y"]


def state(spark, *rows):
    return frame(spark, [(p, f"{s}:{m}", s, m, 1, seen, done, dm, need) for p, s, m, seen, done, dm, need in rows], N.SCAN)


def test_scan_states(spark):
    old = state(spark, ("same", 1, 10, 50, 20, 10, False), ("wait", 1, 11, 50, None, None, True), ("never", 1, 12, 50, None, None, False), ("edit", 1, 13, 50, 20, 13, False), ("edit2", 1, 99, 50, 20, 14, False), ("gone", 5, 15, 50, 20, 15, False), ("gone2", 6, 16, 50, None, None, True), ("back", 1, 60, 30, 20, 60, False), ("late", 1, 61, 50, 20, 61, False), ("noart", 1, 17, 50, 20, 17, False), ("tok", 1, 18, 50, None, None, True), ("badtok", 1, 19, 50, 20, 19, False), ("left", 9, 9, 50, 20, 9, False))
    seen = [("same", 1, 10), ("wait", 1, 11), ("never", 1, 12), ("edit", 2, 40), ("edit2", 1, 99), ("moved", 5, 15), ("moved copy", 5, 15), ("moved2", 6, 16), ("back", 1, 60), ("late", 1, 61), ("noart", 1, 17), ("tok", 1, 18), ("badtok", 1, 19), ("brand", 7, 5), ("brandtok", 8, 5)]
    listing = frame(spark, [(p, s, m, p in ("tok", "badtok", "brandtok"), p in ("tok", "brandtok"), p not in ("noart",)) for p, s, m in seen], "rel_path string, size_bytes long, mtime_ns long, has_token boolean, token_ok boolean, artifacts_ok boolean")
    got = {r.rel_path: r for r in N.scan(old, listing, 100, 45).collect()}
    want = {"same": None, "wait": "pending", "never": "never_processed", "edit": "changed", "edit2": "new_since_last_scan", "moved": "moved", "moved copy": "new", "moved2": "moved_unprocessed", "back": "reappeared", "late": "new_since_last_scan", "noart": "missing_artifacts", "tok": "metadata_present", "badtok": "metadata_missing_artifacts", "brand": "new", "brandtok": "metadata_present", "left": None}
    want["edit2"] = "changed"  # its time differs from that of the last processing
    assert {p: r.reason for p, r in got.items()} == want
    need = {p for p, r in got.items() if r.needs_processing}
    assert need == set(want) - {"same", "moved", "brandtok", "left"} | set() and got["brandtok"].last_processed_epoch_ns == 100 and got["moved"].last_processed_epoch_ns == 20 and got["left"].last_seen_epoch_ns == 50 and got["brand"].first_seen_epoch_ns == 100
    after = {r.rel_path: r for r in N.processed(N.scan(old, listing, 100, 45), frame(spark, [("wait", True), ("never", False)], "rel_path string, ok boolean"), 200).collect()}
    assert not after["wait"].needs_processing and after["wait"].last_processed_mtime_ns == 11 and after["never"].needs_processing
    assert [r.rel_path for r in N.to_process(old, frame(spark, [("same",)], "rel_path string"), only_forced=True).collect()] == ["same"] and N.to_process(old).count() == 3 and N.to_process(old, frame(spark, [("same",)], "rel_path string")).count() == 4
    assert N.scan(old.limit(0), listing.limit(0), 1).count() == 0


def test_scan_helpers(spark):
    files = frame(spark, [("x/A.pdf",), ("B.xlsx",), ("C.pdf",)], "rel_path string")
    arts = frame(spark, [("debug/ocr/A/combined.txt",), ("debug/ocr/B__excel/B_metadata.json",), ("debug/ocr/C/other.txt",)], "rel_path string")
    assert {r.rel_path: r.artifacts_ok for r in N.with_artifacts(files, arts).collect()} == {"x/A.pdf": True, "B.xlsx": True, "C.pdf": False}
    meta = frame(spark, [("last_scan_epoch_ns", "1"), ("k", "v")], "key string, value string")
    assert sorted(map(tuple, N.watermark(meta, 7).collect())) == [("k", "v"), ("last_scan_epoch_ns", "7")]
    a = frame(spark, [("p", 1, 1), ("q", 1, 1), ("r", 2, 2)], "path string, size_bytes long, mtime_ns long")
    b = frame(spark, [("p", 1, 1), ("q", 1, 2)], "path string, size_bytes long, mtime_ns long")
    assert sorted(r.path for r in N.to_mirror(a, b).collect()) == ["q", "r"] and [r.path for r in N.to_write(a, b).collect()] == ["r"] and N.to_write(a, b, True).count() == 3


def cells(spark):
    sheets = {
        "Config": [["Key", "x"], ["td_run_labeling", '{"enabled": true}'], [], ["Name", "Units"], ["Thrust", "lbf"], ["Isp", None], [], ["Late", "x"]],
        "Sources": [["Serial_Number", "Other", "excel_sqlite_rel"], ["SN1", "a", "w1"], [None, "b", "w2"], ["SN2", None, None]],
        "Data": [["Term", "Header", "Table Label", "Data Group", "Units", "Range (Min)"], ["t", "Thrust", "Average", "Run1", "lbf", "0"], ["t", "Thrust", "rms", "Run1"], [None, None, "mean", None], ["only term"]],
        "master": [["Term Label", "Data Group", "SN1", "SN2"], ["Torque", "A", "5", "N/A"], ["Mass", None, "1", None]],
    }
    rows = [("w.xlsx", s, r, c, v) for s, lines in sheets.items() for r, line in enumerate(lines, 1) for c, v in enumerate(line, 1) if v is not None]
    return frame(spark, rows, "path string, sheet string, excel_row int, excel_col int, value string")


def test_configuration_sheets(spark):
    c = cells(spark)
    assert [(r.place, r.name, r.units) for r in configs.config_columns(c).orderBy("place").collect()] == [(1, "Thrust", "lbf"), (2, "Isp", "")]
    assert sorted((r.serial, r.workbook_table) for r in configs.source_rows(c).collect()) == [("SN1", "w1"), ("SN2", None)]
    got = configs.data_definitions(c).orderBy("row_index").collect()
    assert [(r.row_index, r.stat, r.active, r.min) for r in got] == [(2, "mean", True, "0"), (3, "", False, ""), (4, "", False, "")]
    assert json.loads(configs.key_value_json(c).first().json) == {"enabled": True} and configs.key_value_json(c, "none").count() == 0
    assert sorted((r.term_label, r.serial, r.value) for r in configs.master_rows(c, "master").collect()) == [("Mass", "SN1", "1"), ("Torque", "SN1", "5"), ("Torque", "SN2", "N/A")]
    info = frame(spark, [("a", "S", "sheet__S")], "path string, sheet string, table_name string")
    tables = frame(spark, [("a", "sheet__T"), ("b", "sheet__U"), ("b", "other")], "path string, table_name string")
    assert sorted(r.sheet for r in configs.run_sheets(info, tables).collect()) == ["S", "U"]


def test_configuration_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Term Label,Units\n a ,\nb,N/A\n")
    assert [tuple(r) for r in configs.terms_schema(spark, f"file://{tmp_path}/t.csv").collect()] == [("a", ""), ("b", "N/A")]
    (tmp_path / "p.json").write_text(json.dumps({"page": 1, "tables": [{"table_idx": 2, "cells": [{"row": 0, "col": 1, "candidates": [{"variant_idx": 3, "text": "x"}]}]}]}))
    assert [tuple(r) for r in configs.variant_readings(spark, f"file://{tmp_path}/p.json").collect()] == [(1, 2, 0, 1, 3, "x")]
    assert configs.tolerant_json("{", {}) == {} and configs.tolerant_json("[1]", {}) == {} and configs.tolerant_json('{"a": 1}', {}) == {"a": 1}
    assert configs.report_config({"watch": {"z": 3.0}}, {"fit_degree": 2})["watch"] == {"max_pct": 10.0, "rms_pct": 5.0, "z": 3.0}
    ok = configs.trend_config({"columns": [{"name": "x"}], "statistics": [" Mean "], "statistics_ignore_first_n": "-3", "performance_plotters": [{"x": {"column": "a", "stat": "MAX"}, "y": {"column": "b"}, "fit": {"degree": "2"}}]})
    assert ok["statistics"] == ["mean"] and ok["statistics_ignore_first_n"] == 0 and ok["header_row"] == 0
    assert ok["performance_plotters"] == [{"name": "Performance Plot 1", "x": {"column": "a"}, "y": {"column": "b"}, "stats": ["max"], "fit": {"degree": 2, "normalize_x": True}, "require_min_points": 2}]
    for bad in ({}, {"columns": []}, {"columns": [1], "statistics": [1]}, {"columns": [1], "performance_plotters": {}}, {"columns": [1], "performance_plotters": [{"x": {}}]}, {"columns": [1], "performance_plotters": ["x"]}):
        with pytest.raises(ValueError, match="."):
            configs.trend_config(bad if "performance_plotters" not in bad or bad["performance_plotters"] != {} else bad | {"performance_plotters": {"a": 1}})
    got = spark.createDataFrame([("r.c.s.x",), ("r.c",)], "m string").select(configs.metric_name(F.col("m")).alias("x")).collect()
    assert tuple(got[0].x) == ("r", "c", "s") and got[1].x is None


def test_cache(spark, tmp_path):
    values = frame(spark, [(s, "Run1", r, c, v) for s, k in (("SN1", 1.0), ("SN2", 2.0)) for r in range(4) for c, v in (("time_s", float(r)), ("thrust", k * r), ("other", 9.0))] + [("SN1", "Run2", 0, "thrust", 5.0), ("SN2", "Run1", 9, "thrust", float("nan"))], "serial string, run string, excel_row int, column string, value double")
    sources = frame(spark, [("SN1", "a", 7, 1, None), ("SN2", "b", 8, 1, None), ("SN3", None, None, None, "missing")], "serial string, sqlite_path string, mtime_ns long, size_bytes long, error string")
    wanted = frame(spark, [(None, "Thrust", "lbf", 1), ("Run2", "THRUST", "N", 2)], "run_name string, name string, units string, place int")
    definitions = configs.data_definitions(cells(spark))
    made = C.build(values, sources, wanted, definitions, ["mean", "min", "max", "std", "median", "count"], labels=frame(spark, [("Run1", "Run 1")], "run_name string, display_name string"), now_ns=5)
    folder = f"file://{tmp_path}/td"
    C.write(made, folder)
    t = C.read(spark, folder)
    assert [r.serial for r in C.serials(t).collect()] == ["SN1", "SN2", "SN3"] and [(r.run_name, r.default_x, r.display_name) for r in C.runs(t).collect()] == [("Run1", "Time", "Run 1"), ("Run2", "", "Run2")] and C.run_names(t).count() == 2
    assert {(r.run_name, r.name, r.units, r.kind) for r in t["td_columns"].collect()} == {("Run1", "Thrust", "lbf", "y"), ("Run1", "Time", "", "x"), ("Run2", "THRUST", "N", "y"), ("Run2", "Thrust", "lbf", "y")}
    assert [tuple(r) for r in C.metric_series(t, "Run1", "Thrust", "MAX").collect()] == [("SN1", 3.0), ("SN2", 6.0)] and C.metric_map(t, "Run1", "Thrust", "count").collect()[1].value_num == 4.0
    curve = C.curve_lookup(t, "Run1", "Thrust", "Time", ["SN2"]).first()
    assert curve.x == [0.0, 1.0, 2.0, 3.0] and curve.y == [0.0, 2.0, 4.0, 6.0] and C.curve_lookup(t, "Run1", "Thrust", "Time").count() == 2
    y = C.y_columns(t, "Run1").first()
    assert (y.units, y.range_min, y.range_max) == ("lbf", 0.0, 6.0) and [r.name for r in C.x_columns(t, "Run1").collect()] == ["Time"]
    assert [r.name for r in C.in_config_order(frame(spark, [("a",), ("b",), ("c",)], "name string"), ["c", "a"]).collect()] == ["c", "a", "b"]
    skipped = C.metrics_of(values, C.columns_of(values, wanted), ["min"], ignore_first=2)
    assert {(r.serial, r.value_num) for r in skipped.filter("run_name = 'Run1'").collect()} == {("SN1", 2.0), ("SN2", 4.0)}
    assert C.must_rebuild(None, 1, set(C.TABLES)) and C.must_rebuild(1, 2, set(C.TABLES)) and C.must_rebuild(3, 2, {"td_runs"}) and not C.must_rebuild(3, 2, set(C.TABLES))
    assert C.must_rebuild(3, 2, set(C.TABLES), sources.limit(1), t["td_sources"]) and not C.must_rebuild(3, 2, set(C.TABLES), sources, t["td_sources"])
    assert C.upgraded(frame(spark, [("r", "x")], "run_name string, default_x string"), "td_runs").columns == ["run_name", "default_x", "display_name"]
    messy = frame(spark, [("a", [1.0, None, 3.0, 4.0], [1.0, 2.0, float("nan")]), ("b", [1.0, 2.0, 3.0], [1.0, 2.0]), ("c", [], [])], "serial string, x array<double>, y array<double>")
    assert [(r.serial, r.x) for r in C.clean_curves(messy).collect()] == [("b", [1.0, 2.0])]
    assert set(C.empty(spark)) == set(C.TABLES) and C.build(values.limit(0), sources.limit(0), wanted, definitions.limit(0), ["mean"])["td_metrics"].count() == 0


def test_sinks(spark, tmp_path):
    root = f"file://{tmp_path}"
    docs = frame(spark, [(1, "a"), (2, "b")], "document_id long, title string")
    tests = frame(spark, [(1, "T", 5.0), (1, "S", None)], "document_id long, term string, value double")
    sinks.extraction_json(docs, {"tests": tests}, f"{root}/x.json")
    got = {r.document_id: r for r in spark.read.json(f"{root}/x.json").collect()}
    assert [t.term for t in got[1].tests] == ["S", "T"] and got[2].tests is None
    sinks.trending_json(frame(spark, [(1, "P")], "id int, name string"), docs, tests, f"{root}/t.json")
    t = spark.read.json(f"{root}/t.json").first()
    assert t.project.name == "P" and len(t.documents) == 2 and len(t.summary) == 2
    sinks.replace_tables({"documents": docs}, f"{root}/index")
    assert spark.read.parquet(f"{root}/index/documents").count() == 2
    sinks.workbook_stats(frame(spark, [("c", 1.0, None), ("d", None, "bad")], "column string, value double, error string"), f"{root}/stats")
    assert tuple(spark.read.json(f"{root}/stats/summary.json").select("rows", "errors", "columns").first()) == (2, 1, 2)
    sinks.metadata_files(frame(spark, [(1, "V")], "doc_id long, vendor string"), f"{root}/meta")
    assert json.loads(json.loads(spark.read.text(f"{root}/meta").first().value)["metadata"]) == {"vendor": "V"}
    flow = frame(spark, [(1, 2, 1, "line", "x"), (1, 1, 2, "table", "+-+"), (1, 1, 1, "title", "T")], "doc_id long, page int, position int, kind string, text string")
    assert sinks.combined_text(flow).first().text == "=== Page 1 ===\n\n[Table/Chart Title]\nT\n\n[Table]\n\n+-+\n\n=== Page 2 ===\n\n[Line]\nx\n"
    keys = "doc_id long, page int, n int"
    sinks.page_json(frame(spark, [(1, 1, 2), (1, 1, 1)], keys), frame(spark, [(1, 2, 5)], keys), frame(spark, [], keys), f"{root}/pages")
    assert {(r.page, len(r.tokens or [])) for r in spark.read.json(f"{root}/pages").collect()} == {(1, 2), (2, 0)}
    sinks.report_json({"grades": tests}, f"{root}/report.json", {"z": 2})
    assert spark.read.json(f"{root}/report.json").first().settings == '{"z": 2}'
    sinks.registry_csv(frame(spark, [("b", 1), ("a", 2)], "serial string, n int"), f"{root}/r.csv")
    assert [r.serial for r in spark.read.csv(f"{root}/r.csv", header=True).collect()] == ["a", "b"]
    filled = sinks.back_filled({"columns": [{"name": "x", "units": ""}, {"name": "y", "units": "V"}]}, {"x": {"units": "A"}, "y": {"units": "B"}})
    assert [c["units"] for c in filled["columns"]] == ["A", "V"]
    for text in ("one", "two"):
        sinks.write_with_backup(spark, text, f"{root}/c.json", "stamp")
    assert (tmp_path / "c.json").read_text() == "two" and (tmp_path / "c.json.stamp.bak").read_text() == "one"


def test_workbooks_are_read_back(spark, tmp_path):
    names = sinks.sheet_names(["a" * 40, "a" * 41, "x/y", ""])
    assert names == ["a" * 31, "a" * 29 + "_2", "x_y", "Sheet"]
    data = sinks.workbook_mirror({"t1": frame(spark, [(1, "a<&\"b", 1.5, ["x"])], "n long, s string, d double, l array<string>"), "t2": frame(spark, [(None,)], "z string")})
    (tmp_path / "m.xlsx").write_bytes(data)
    got = {(r.sheet, r.excel_row, r.excel_col): r.value for r in readers.workbooks(spark, f"file://{tmp_path}").collect()}
    assert got["t1", 1, 1] == "n" and got["t1", 2, 1] == "1" and got["t1", 2, 2] == 'a<&"b' and got["t1", 2, 3] == "1.5" and json.loads(got["t1", 2, 4]) == ["x"] and got["t2", 1, 1] == "z"
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.workbook_mirror({"t": spark.range(2)}, most_rows=1)


def test_a_run_ends_without_a_window_over_all_results(spark):
    from gaugeweave.operators import registry

    rows = [(i, None if i % 7 == 0 else i % 3 == 0) for i in range(60)]
    results = spark.createDataFrame(rows, "order_no long, ok boolean").repartition(5)
    for n in (0, 1, 4, 17, 18, 500):
        out = registry.until_successes(results, n)
        want, seen = [], 0
        for i, ok in rows:
            if seen < n:
                want.append(i)
            seen += bool(ok)
        assert sorted(r.order_no for r in out.collect()) == want
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()

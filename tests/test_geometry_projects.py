from pyspark.sql import functions as F

from gaugeweave.functions import fuzzy
from gaugeweave.operators import documents, extraction, geometry, projects, values
from test_documents import TEXT, lines

TOKENS = "doc_id long, page int, token_id int, text string, conf double, x0 double, y0 double, x1 double, y1 double, cx double, cy double"


def tokens(spark, boxes):
    return spark.createDataFrame([(1, 1, i, t, c, x, y, x + w, y + h, x + w / 2, y + h / 2) for i, (t, c, x, y, w, h) in enumerate(boxes)], TOKENS)


def test_lines_paragraphs_segments(spark):
    t = tokens(spark, [("world", 0.9, 60.0, 12.0, 50.0, 10.0), ("Hello", 0.8, 0.0, 10.0, 50.0, 10.0), ("far", 0.9, 400.0, 11.0, 30.0, 10.0), ("Below", 0.9, 0.0, 100.0, 50.0, 10.0)])
    placed = geometry.text_lines(t)
    got = geometry.line_texts(placed).orderBy("line_no").collect()
    assert [r.text for r in got] == ["Hello world far", "Below"]
    assert [r.paragraph for r in geometry.paragraphs(geometry.line_texts(placed)).orderBy("line_no").collect()] == [0, 1]
    assert {r.text: r.segment for r in geometry.split_at_gaps(placed, 600).collect()} == {"Hello": 0, "world": 0, "far": 1, "Below": 0}
    assert {r.text: r.zone for r in geometry.header_footer(t, 1000).collect()}["Hello"] == "header"
    assert geometry.text_lines(t.limit(0)).count() == 0


def test_overlaps(spark):
    t = tokens(spark, [("a", 0.5, 0.0, 0.0, 10.0, 10.0), ("a", 0.9, 0.5, 0.0, 10.0, 10.0), ("b", 0.4, 0.0, 0.0, 10.0, 10.0)])
    assert sorted((r.text, r.conf) for r in geometry.unique_tokens(t).collect()) == [("a", 0.9), ("b", 0.4)]
    assert geometry.suppressed(t).count() == 1
    box = spark.createDataFrame([(1, 1, 0.0, 0.0, 6.0, 10.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert [r.conf for r in geometry.outside_tables(t, box, 0.58).collect()] == [0.9]
    assert geometry.mean_clusters([1, 2, 10, 11, 1.5], 1) == [[1, 1.5, 2], [10, 11]]


def test_cells_to_tables(spark):
    cells = [(1, 1, 10 * r + c, 100.0 * c, 20.0 * r, 100.0 * c + 99, 20.0 * r + 19) for r in range(3) for c in range(2)] + [(1, 1, 90, 0.0, 900.0, 50.0, 920.0), (1, 1, 91, -1.0, -1.0, 200.0, 60.0)]
    df = spark.createDataFrame(cells, "doc_id long, page int, cell_id int, x0 double, y0 double, x1 double, y1 double")
    kept = geometry.without_containers(df)
    assert kept.count() == 7
    tables = geometry.tables_of_cells(kept, 1000)
    assert tables.select("table_id").distinct().count() == 2
    got = {r.cell_id: (r.row, r.col) for r in geometry.row_col_indices(tables).collect()}
    assert got[21] == (2, 1) and got[90] == (0, 0)
    assert geometry.table_bounds(tables).agg(F.max("n_cells")).first()[0] == 6


def test_spreads(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 3.0), ("b", 5.0)], "k string, v double")
    assert {r.k: r.spread for r in geometry.trimmed_spread(rows, ["k"], "v").collect()} == {"a": 8.0, "b": 2.0}
    assert {r.k: r.upper_median for r in geometry.upper_median(rows, ["k"], "v").collect()} == {"a": 5.0, "b": 5.0}
    assert geometry.gap_clusters(rows, ["k"], "v", 1.5).select("k", "cluster").distinct().count() == 3


def test_projects(spark):
    docs = spark.createDataFrame([(1, "SN2", "2024-01-02", "P", "M"), (2, "sn1", "2024-01-01", "P", "N"), (3, "X", "2023-01-01", "Q", "M")], "id long, serial string, test_date string, program string, valve_model string")
    bridge = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "project_id long, document_id long")
    assert [r.serial for r in projects.project_documents(docs, bridge, 7).collect()] == ["sn1", "SN2"]
    assert projects.auto_assign(docs, "serial_prefix", "sn").count() == 2
    assert projects.link(bridge, bridge).count() == 3 and projects.unlink(bridge, bridge.filter("project_id = 7")).count() == 1
    registry = spark.createDataFrame([(5, "A", "x")], "id long, term string, category string")
    settings = spark.createDataFrame([(7, 5, True, 1), (8, 5, True, 2)], "project_id long, term_id long, enabled boolean, display_order int")
    assert [r.display_order for r in projects.project_terms(registry, settings, 9).collect()] == [999]
    tests = spark.createDataFrame([(1, "B"), (2, "C"), (3, "B"), (4, "A")], "id long, term string")
    assert {r.term: r.id for r in projects.register_terms(registry, tests).collect()} == {"A": 5, "B": 6, "C": 7}


def test_run_labels_and_axes(spark):
    values = spark.createDataFrame([("r1", "temp", "20.0"), ("r2", "temp", "20"), ("r3", "temp", "cold")], "run string, variable string, value string")
    assert {r.run: r.label for r in projects.run_labels(values, "T={temp} {gas}").collect()} == {"r1": "T=20 ? — r1", "r2": "T=20 ? — r2", "r3": "T=cold ?"}
    columns = spark.createDataFrame([("r1", "Pulse_Number"), ("r1", "time (s)"), ("r2", "pulse number")], "run string, name string")
    assert {r.run: r.default_x for r in projects.default_axis(columns, ["time (s)", "Pulse Number"]).collect()} == {"r1": "time (s)", "r2": "pulse number"}
    wide = spark.createDataFrame([("t", "1.5 psi", None)], "term string, SN1 string, SN2 string")
    assert {(r.serial, r.position, r.value_num) for r in projects.trending_long(wide, ["term"], ["SN1", "SN2"]).collect()} == {("SN1", 1, 1.5), ("SN2", 2, None)}
    a = spark.createDataFrame([("s1", "f"), ("s2", "f")], "serial string, fingerprint string")
    b = spark.createDataFrame([("s1", "f"), ("s3", "f")], "serial string, fingerprint string")
    assert sorted(r.serial for r in projects.stale(a, b).collect()) == ["s2", "s3"]


def test_value_cascade(spark):
    text = lines(spark)
    packed = values.packed(documents.table_rows(text), text)
    terms = spark.createDataFrame([("Torque", "Measured"), ("Leak", None), ("Pressure", None), ("Absent", None)], "term string, heading string")
    got = {r.term: (r.number, r.source) for r in values.document_values(packed, terms, raw=True).collect()}
    assert got == {"Torque": (4.5, "header"), "Leak": (3.0, "table"), "Pressure": (12.5, "line")} or got["Leak"][1] == "table"
    assert values.packed(documents.table_rows(text).limit(0), text).first().blocks is None


def test_dates_metadata_pages(spark):
    d = spark.createDataFrame([(1, 0, "x 2020-01-01"), (1, 9, "Report Date:"), (1, 11, "3/4/2024"), (2, 1, "2021.5.6"), (3, 50, "2021-05-06")], "doc_id long, line_no int, text string")
    assert {r.doc_id: r.report_date for r in extraction.report_dates(d, ["report date"]).collect()} == {1: "2024-03-04", 2: "2021-05-06"}
    s = "doc_id long, program string"
    a, b, c = (spark.createDataFrame(x, s) for x in ([(1, "unknown"), (2, "P")], [(1, " ")], [(1, "D"), (3, None)]))
    assert {r.doc_id: r.program for r in extraction.canonical_metadata(a, b, c, ["program"]).collect()} == {1: "D", 2: "P", 3: "Unknown"}


def test_instances(spark):
    tests = spark.createDataFrame([(1, 1, 1, 1, "Torque", 1.0, True), (1, 1, 1, 2, "Torque", 2.0, True)], "doc_id long, page int, table_no int, row_no int, term string, measured_value double, computed_pass boolean")
    wanted = spark.createDataFrame([("Torque (2)", 1), ("torque", 2)], "term string, row_order int")
    assert TEXT and {r.wanted: r.measured_value for r in projects.acceptance_candidates(tests, wanted).collect()} == {"Torque (2)": 2.0, "torque": 2.0}


def test_headers_and_pairs(spark):
    heads = spark.createDataFrame([("s", 1, "Thrust (lbf)"), ("s", 2, "Time"), ("s", 3, "thrust"), ("s", 4, "zzz")], "sheet string, position int, header string")
    assert {r.position: r.name for r in fuzzy.assign_headers(heads, ["thrust", "time"], ["sheet"]).collect()} == {3: "thrust", 2: "time"}
    roles = documents.header_roles(spark.createDataFrame([("Measured Value (psi)",), ("Units",), ("x",)], "header string")).collect()
    assert [r.role for r in roles] == ["value", "units", None]
    rows = spark.createDataFrame([(1, 1, t, r, c) for t, cs in {1: [["Test", "Criteria"], ["Leak", "<= 5"], ["Mass", "1 - 2"]], 3: [["Measured", "Units"], ["4", "sccm"]]}.items() for r, c in enumerate(cs, 1)], "doc_id long, page int, table_no long, row_no int, cells array<string>")
    assert [(r.term, r.requirement_raw, r.measured_raw) for r in extraction.paired_tables(rows).collect()] == [("Leak", "<= 5", "4")]


def test_places_need_a_sketch_of_large_keys_only(spark, monkeypatch):
    from pyspark.sql import functions as F

    from gaugeweave.operators import geometry

    sketched = []
    real = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda *a: sketched.append(a) or real(*a))
    few = spark.range(3000).selectExpr("id % 700 as k", "hash(id) % 50 as v")
    both = few.unionByName(spark.range(900).selectExpr("-1L as k", "hash(id) % 50 as v"))
    for rows, accuracy, sketches in ((few, 1000, 0), (both, 100, 1)):
        want = {}
        for r in rows.collect():
            want.setdefault(r.k, []).append(r.v)
        got = {r.k: (r.n, r.low, r.high, r.a, r.b) for r in geometry.at_shares(rows, ["k"], "v", {"a": 0.25, "b": 0.5}, accuracy).collect()}
        assert got == {k: (len(v), min(v), max(v), sorted(v)[len(v) // 4], sorted(v)[len(v) // 2]) for k, v in want.items()}
        assert len(sketched) == sketches


def test_best_cells_equal_the_best_of_all_pairs(spark):
    """Also where a page is dealt into many pairs of blocks, for ties, nulls, NaN and boxes without area; no window over pairs."""
    from gaugeweave.operators import relational

    nan = float("nan")
    odd = [(900, 0, None, 0.1), (901, 0, nan, 0.1), (902, 1, 0.1, nan), (903, None, 0.1, 0.1), (None, 0, 0.1, 0.1)]
    rows = spark.createDataFrame([(i, i % 2, (i * 37 % 101) / 50 - 1, (i * 53 % 97) / 50 - 1) for i in range(120)] * 2 + odd, "i long, page int, x double, y double")
    box = lambda p, size: rows.select(F.col("i").alias("t" if p == "t_" else "cell"), "page", F.col("x").alias(f"{p}x0"), F.col("y").alias(f"{p}y0"), (F.col("x") + size).alias(f"{p}x1"), (F.col("y") + size).alias(f"{p}y1"))
    tokens, cells = box("t_", 0.05), box("c_", 0.3).unionByName(box("c_", 0.0))
    want = relational.best_cell(relational.spatial_join(tokens, cells, ["page"], 0.25).filter("cell <> t"), ["t"], "cell").select("t", "cell")
    want = sorted(map(tuple, want.collect()))
    assert len(want) > 50
    for meet in (4096, 7):
        got = relational.best_cells(tokens, cells, ["page"], 0.25, "t", "cell", meet=meet)
        assert sorted(map(tuple, got.select("t", "cell").collect())) == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()

import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from gaugeweave.operators import relational as R
from gaugeweave.sources import readers, sinks
from gaugeweave.streaming import scans


def workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(64 + c)}{r}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(vs, 1) if v is not None)}</row>' for r, vs in enumerate(rows, 1))
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Run1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook_to_long_values(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Title"], [None, "made by"], ["Time", "Thrust (lbf)", "Thrust (lbf)"], *[[i, i * 2.5, i] for i in range(12)]])
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    cells = readers.workbooks(spark, str(tmp_path))
    assert cells.filter("error is not null").count() == 1
    good = cells.filter("error is null")
    heads = readers.header_rows(good, ["path", "sheet"])
    assert [r.header_row for r in heads.collect()] == [3]
    got = readers.sheet_values(good, heads, ["path", "sheet"]).groupBy("column").agg(F.sum("value").alias("s"), F.count("value").alias("n")).collect()
    assert {r["column"]: (r.s, r.n) for r in got} == {"Time": (66, 12), "Thrust_lbf": (165, 12), "Thrust_lbf_2": (66, 12)}


def test_listing_skips_temporary_and_ignored(spark, tmp_path):
    for name in ("a.pdf", "~$b.xlsx", "Old/c.pdf", "deep/d.xlsm", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = readers.fingerprint(readers.list_files(spark, str(tmp_path), ignore="old")).collect()
    assert sorted(r.name for r in got) == ["a.pdf", "d.xlsm"] and all(r.fingerprint for r in got)


def test_ocr_table(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "t.tsv").write_text(head + "5\t1\t1\t1\t1\t1\t10\t20\t4\t6\t91\tHi\n5\t1\t1\t1\t1\t2\t0\t0\t1\t1\t10\tlow\n4\t1\t1\t1\t1\t0\t0\t0\t1\t1\t99\tx\n5\t1\t1\t1\t1\t3\t0\t0\t1\t1\t99\t \n")
    got = readers.tesseract_tsv(spark, str(tmp_path / "t.tsv")).collect()
    assert [(r.text, r.conf, r.x1, r.cy) for r in got] == [("Hi", 0.91, 14, 23)]


def test_text_sqlite_json_csv(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a\nb\n")
    assert [r.text for r in readers.text_lines(spark, str(tmp_path / "c.txt")).orderBy("line_no").collect()] == ["a", "b", ""]
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("create table t (a integer, b text)")
        c.execute("insert into t values (1, 'q')")
    c.close()
    assert [(r.a, r.b) for r in readers.sqlite_table(spark, str(tmp_path), "select a, b from t", "a long, b string").collect()] == [(1, "q")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m/doc_metadata.json").write_text(json.dumps({"serial": "SN1"}))
    (tmp_path / "m/other.json").write_text("{}")
    assert [r.serial for r in readers.metadata_json(spark, str(tmp_path / "m"), "serial string").collect()] == ["SN1"]
    (tmp_path / "r.csv").write_text("serial,v\nSN1,1\nSN1,N/A\nSN2,3\n")
    assert {r.serial: r.v for r in readers.registry_csv(spark, str(tmp_path / "r.csv")).collect()} == {"SN1": "N/A", "SN2": "3"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "document_id int, term string, v double")
    sinks.facts(rows, str(tmp_path / "f"))
    sinks.facts(spark.createDataFrame([("z", 9.0, 2)], "term string, v double, document_id int").select("document_id", "term", "v"), str(tmp_path / "f"))
    assert {(r.document_id, r.term) for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {(1, "a"), (1, "b"), (2, "z")}
    sinks.documents_json(rows, ["document_id"], str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.trending_csv(R.matrix(rows, "document_id", "term", "v", "v", ["a", "b"]), str(tmp_path / "c"))
    s = R.summary(rows.withColumn("ok", F.lit(True)), "term", "v", "ok")
    sinks.summary_csv(s, str(tmp_path / "s"))
    assert [r.pass_rate for r in spark.read.csv(str(tmp_path / "s"), header=True).collect()] == ["100.0%"]
    assert sinks.text_mirror(rows, 2).count() == 2


def test_streams(spark, tmp_path, sf):
    for n, rows in enumerate(([("p1", "f1"), ("p2", "f2")], [("p1", "f1b")])):
        spark.createDataFrame(rows, "path string, fingerprint string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        src = spark.readStream.schema("path string, fingerprint string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        scans.merge_scans(spark, src, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(60)
    got = {r.path: (r.fingerprint, r.processed) for r in scans.state(spark, str(tmp_path / "state")).collect()}
    assert got == {"p1": ("f1b", False), "p2": ("f2", False)}
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    q = scans.windowed_metrics(stream, "ts", "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from w").first()[0] == events.count()


def test_a_workbook_is_written_and_read_as_a_stream():
    """Memory doesn't grow with a sheet's rows: neither the rows, nor the sheet's text, nor its emptied elements are held."""
    import tracemalloc

    def peak(n):
        rows = ((i, f"text {i} of the row") for i in range(n))
        tracemalloc.start()
        content = sinks.workbook_bytes({"s": (["k", "v"], rows)})
        seen = sum(1 for _ in readers.workbook_cells(content))
        top = tracemalloc.get_traced_memory()[1] - 3 * len(content)  # the file itself, and a copy of it
        tracemalloc.stop()
        assert seen == 2 * n + 2
        return top

    peak(10)  # modules are loaded
    assert peak(20_000) < peak(2_000) + 500_000

"""Queries that write a given table in one of the formats of the sinks, read it back with the sources, and must find what was written."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import functions as F

from gaugeweave.operators import registry
from gaugeweave.operators import relational as R
from gaugeweave.plans.catalog import query
from gaugeweave.session import table
from gaugeweave.shared import new_folder
from gaugeweave.sources import configs, readers, sinks


# OCR tables, reports, listings
def _ocr_table(spark, d):
    folder, k = new_folder(spark, "ocr"), F.col("l_linenumber")
    li = table(spark, d, "lineitem")
    li.select(
        F.when(k == 7, 4).otherwise(5).alias("level"), (F.col("l_orderkey") % 40 + 1).alias("page_num"), k.alias("block_num"), F.lit(1).alias("par_num"), F.col("l_suppkey").alias("line_num"), F.col("l_partkey").alias("word_num"),
        F.col("l_orderkey").alias("left"), k.alias("top"), F.lit(8).alias("width"), F.lit(4).alias("height"), (F.col("l_quantity") * 2).alias("conf"), F.when(k == 6, " ").otherwise(F.concat(F.lit('"'), F.col("l_returnflag"))).alias("text"),
    ).write.option("sep", "\t").option("header", "true").option("quote", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(folder)
    return folder


OCR = """SELECT (l_orderkey % 40 + 1)::INTEGER AS page, l_partkey::INTEGER AS word_num, '"' || l_returnflag AS text, l_quantity * 2 / 100 AS conf, l_orderkey::DOUBLE AS x0, l_orderkey + 8.0::DOUBLE AS x1, l_linenumber + 2.0::DOUBLE AS cy FROM lineitem WHERE l_linenumber < 6 AND l_quantity * 2 >= {}"""


@query(OCR.format(30))
def ocr_tokens(spark, d):
    return readers.tesseract_tsv(spark, _ocr_table(spark, d)).select("page", "word_num", "text", "conf", "x0", "x1", "cy")


@query(f"SELECT page, count(*) AS n, count(*) FILTER (conf < 0.3) AS unsure FROM ({OCR.format(0)}) GROUP BY 1")
def ocr_tokens_of_low_confidence(spark, d):
    t = readers.tesseract_tsv(spark, _ocr_table(spark, d), 0.0)
    return t.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("conf") < 0.3).alias("unsure"))


def _reports(spark, d):
    """A folder for each nation, in it a text file of its customers' names."""
    folder = new_folder(spark, "reports")
    table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value")).repartition("nation").sortWithinPartitions("value").write.partitionBy("nation").text(folder)
    return folder


@query("SELECT c_nationkey AS nation, sum(length(c_name) + 1)::BIGINT AS size_bytes FROM customer WHERE c_nationkey NOT IN (1, 3) GROUP BY 1")
def listed_files(spark, d):
    files = readers.fingerprint(readers.list_files(spark, _reports(spark, d), ("txt",), ignore="NATION=1; nation=3")).filter("fingerprint is not null")
    return files.groupBy(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")).agg(F.sum("size_bytes").alias("size_bytes"))


@query("SELECT c_nationkey AS nation, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) - 1)::INTEGER AS line_no, c_name AS text FROM customer")
def report_lines(spark, d):
    lines = readers.text_lines(spark, _reports(spark, d)).filter("text <> ''")
    return lines.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "line_no", "text")


# JSON and CSV
@query("SELECT n_nationkey AS k, n_name AS vendor, n_regionkey AS region FROM nation")
def metadata_documents(spark, d):
    """Small named files, one for each nation, written through the file system and found by their names."""
    folder = new_folder(spark, "metadata")
    for r in table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("vendor"), F.col("n_regionkey").alias("region"))).alias("j")).collect():
        sinks.write_with_backup(spark, r.j, f"{folder}/d{r.n_nationkey % 3}/x{r.n_nationkey}{'_' if r.n_nationkey % 2 else '.'}metadata.json", "0")
        sinks.write_with_backup(spark, "{}", f"{folder}/d{r.n_nationkey % 3}/x{r.n_nationkey}.json", "0")
    return readers.metadata_json(spark, folder, "k int, vendor string, region int").select("k", "vendor", "region")


@query("SELECT n_nationkey AS k, n_name || ' 2' AS now, n_name || ' 1' AS before FROM nation")
def backed_up_files(spark, d):
    """A file written twice: the second text, and the first beside it under its stamp."""
    folder = new_folder(spark, "backups")
    for r in table(spark, d, "nation").collect():
        for turn in (1, 2):
            sinks.write_with_backup(spark, f"{r.n_name} {turn}", f"{folder}/{r.n_nationkey}.json", "20240101")
    whole = spark.read.text(folder).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json", 1).cast("int").alias("k"), F.endswith(F.col("_metadata.file_name"), F.lit(".20240101.bak")).alias("old"))
    return whole.groupBy("k").agg(F.max(F.when(~F.col("old"), F.col("value"))).alias("now"), F.max(F.when(F.col("old"), F.col("value"))).alias("before"))


@query("SELECT s_suppkey AS doc_id, s_name AS vendor, s_nationkey AS size FROM supplier")
def metadata_files(spark, d):
    folder = new_folder(spark, "metadata")
    sinks.metadata_files(table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("vendor"), F.col("s_nationkey").alias("size")), folder)
    return spark.read.text(folder).select(F.from_json("value", "doc_id long, metadata string").alias("r")).select("r.doc_id", F.from_json("r.metadata", "vendor string, size int").alias("m")).select("doc_id", "m.vendor", "m.size")


def _line_facts(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("v"))


@query("""WITH r AS (SELECT *, l_orderkey % 5 = 0 AND min(l_linenumber) OVER (PARTITION BY l_orderkey) <= 3 AS again FROM lineitem)
SELECT l_orderkey AS document_id, count(*) AS n, sum(CASE WHEN again THEN 1.0 ELSE l_quantity END) AS v FROM r WHERE NOT (again AND l_linenumber > 3) GROUP BY 1""")
def facts_replaced(spark, d):
    """Facts of all documents, then those of every fifth again with other values and fewer rows, if it has any; the others' stay."""
    folder, rows = new_folder(spark, "facts"), _line_facts(spark, d)
    sinks.facts(rows, folder, buckets=8)
    sinks.facts(rows.filter("document_id % 5 = 0 and n <= 3").withColumn("v", F.lit(1.0)), folder, buckets=8)
    return spark.read.parquet(folder).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("SELECT o_orderkey AS document_id, o_orderpriority AS title, l.n AS n, l.parts FROM orders LEFT JOIN (SELECT l_orderkey, count(*)::INTEGER AS n, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def extraction_documents(spark, d):
    path = new_folder(spark, "json")
    sinks.extraction_json(table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("title")), {"tests": _line_facts(spark, d)}, path)
    back = spark.read.schema("document_id long, title string, tests array<struct<n:int,part:long,v:double>>").json(path)
    return back.select("document_id", "title", F.when(F.col("tests").isNotNull(), F.size("tests")).alias("n"), F.array_sort(F.transform("tests", lambda t: t.part)).alias("parts"))


@query("SELECT l_orderkey AS document_id, count(*)::INTEGER AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1")
def documents_as_json(spark, d):
    path = new_folder(spark, "json")
    sinks.documents_json(_line_facts(spark, d), ["document_id"], path)
    back = spark.read.schema("document_id long, rows array<struct<n:int,part:long,v:double>>").json(path)
    return back.select("document_id", F.size("rows").alias("n"), F.aggregate("rows", F.lit(0.0), lambda s, r: s + r.v).alias("v"))


@query("""SELECT l_orderkey AS document_id, max(l_quantity) FILTER (l_returnflag = 'A') AS "A", max(l_quantity) FILTER (l_returnflag = 'N') AS "N" FROM lineitem GROUP BY 1""")
def trending_file(spark, d):
    path = new_folder(spark, "csv")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("term"), "l_quantity").groupBy("document_id", "term").agg(F.max("l_quantity").alias("v"))
    sinks.trending_csv(R.matrix(rows, "document_id", "term", "v", "v", ["A", "N"]), path)
    return spark.read.csv(path, header=True, schema="document_id long, A double, N double")


@query("SELECT p_brand AS term, printf('%.4f', min(l_quantity)) AS min_value, printf('%.4f', max(l_quantity)) AS max_value, count(*) AS total_count, printf('%.1f%%', 100.0 * count(*) FILTER (l_quantity <= 45) / count(*)) AS pass_rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def summary_file(spark, d):
    path = new_folder(spark, "csv")
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sinks.summary_csv(R.summary(li.withColumn("ok", F.col("l_quantity") <= 45), "p_brand", "l_quantity", "ok"), path)
    return spark.read.csv(path, header=True, schema="term string, min_value string, max_value string, avg_value string, total_count long, pass_count long, pass_rate string").select("term", "min_value", "max_value", "total_count", "pass_rate")


@query("SELECT 'P' AS name, (SELECT count(*) FROM supplier)::INTEGER AS documents, (SELECT count(*) FROM nation)::INTEGER AS terms, (SELECT sum(s_suppkey) FROM supplier)::BIGINT AS ids")
def project_file(spark, d):
    path = new_folder(spark, "json")
    sinks.trending_json(spark.createDataFrame([(1, "P")], "id int, name string"), table(spark, d, "supplier").select("s_suppkey", "s_name"), table(spark, d, "nation").select("n_name"), path)
    back = spark.read.schema("project struct<id:int,name:string>, documents array<struct<s_suppkey:long,s_name:string>>, summary array<struct<n_name:string>>").json(path)
    return back.select("project.name", F.size("documents").alias("documents"), F.size("summary").alias("terms"), F.aggregate("documents", F.lit(0).cast("long"), lambda s, r: s + r.s_suppkey).alias("ids"))


@query("SELECT (SELECT sum(s_suppkey) FROM supplier)::BIGINT AS s, (SELECT count(*) FROM nation) AS n, '{\"z\": 2}' AS settings")
def report_file(spark, d):
    path = new_folder(spark, "json")
    sinks.report_json({"grades": table(spark, d, "supplier").select("s_suppkey"), "watch": table(spark, d, "nation").select("n_name")}, path, {"z": 2})
    back = spark.read.schema("settings string, grades array<struct<s_suppkey:long>>, watch array<struct<n_name:string>>").json(path)
    return back.select(F.aggregate("grades", F.lit(0).cast("long"), lambda s, r: s + r.s_suppkey).alias("s"), F.size("watch").cast("long").alias("n"), "settings")


@query("SELECT s_suppkey AS id, s_name AS name, 'b' AS part FROM supplier WHERE s_suppkey % 2 = 0")
def index_tables(spark, d):
    """An index written twice: the second time replaces the first."""
    folder, s = new_folder(spark, "index"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    sinks.replace_tables({"documents": s.withColumn("part", F.lit("a")), "groups": s}, folder)
    sinks.replace_tables({"documents": s.filter("id % 2 = 0").withColumn("part", F.lit("b")), "groups": s.limit(0)}, folder)
    return spark.read.parquet(f"{folder}/documents")


@query("SELECT n_nationkey || ' | ' || n_name || ' | ' || n_regionkey AS line FROM nation")
def mirrored_lines(spark, d):
    return sinks.text_mirror(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT count(*) AS rows, count(*) FILTER (l_tax = 0) AS errors, count(DISTINCT l_returnflag) AS columns, count(*) AS lines FROM lineitem")
def statistics_files(spark, d):
    folder = new_folder(spark, "stats")
    sinks.workbook_stats(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("column"), F.col("l_quantity").alias("value"), F.when(F.col("l_tax") == 0, "no tax").alias("error")), folder)
    summary = spark.read.schema("rows long, errors long, columns long").json(f"{folder}/summary.json")
    return summary.crossJoin(spark.read.text(f"{folder}/rows.jsonl").agg(F.count("*").alias("lines")))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber % 2 + 1 AS page, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN '[Table/Chart Title]' || chr(10) WHEN 1 THEN '[Table]' || chr(10) || chr(10) ELSE '[Line]' || chr(10) END || 'row ' || l_partkey || chr(10) AS t FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)),
p AS (SELECT l_orderkey, page, '=== Page ' || page || ' ===' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY l_linenumber) AS t FROM l GROUP BY 1, 2)
SELECT l_orderkey AS doc_id, string_agg(t, chr(10) ORDER BY page) AS text FROM p GROUP BY 1""")
def combined_reports(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "title").when(F.col("l_linenumber") % 3 == 1, "table").otherwise("line")
    flow = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page"), F.col("l_linenumber").alias("position"), kind.alias("kind"), F.concat(F.lit("row "), F.col("m.l_partkey").cast("string")).alias("text"))
    return sinks.combined_text(flow)


@query("SELECT l_orderkey AS doc_id, l_linenumber AS page, count(*) FILTER (l_returnflag = 'A')::INTEGER AS tokens, count(*) FILTER (l_returnflag = 'N')::INTEGER AS tables, count(*) FILTER (l_returnflag = 'R')::INTEGER AS cells FROM lineitem GROUP BY 1, 2")
def page_files(spark, d):
    path = new_folder(spark, "pages")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_returnflag", F.col("l_partkey").alias("n"))
    sinks.page_json(*(li.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "ANR"), path)
    parts = ("tokens", "tables", "cells")
    back = spark.read.schema("doc_id long, page int, " + ", ".join(f"{p} array<struct<n:long>>" for p in parts)).json(path)
    return back.select("doc_id", "page", *(F.coalesce(F.size(F.coalesce(p, F.array().cast("array<struct<n:bigint>>"))), F.lit(0)).alias(p) for p in parts))


@query("SELECT s_name AS serial, CASE WHEN s_suppkey % 7 = 0 THEN 'N/A' ELSE s_suppkey::VARCHAR END AS n FROM supplier")
def registry_file(spark, d):
    path = new_folder(spark, "csv")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("serial"), F.when(F.col("s_suppkey") % 7 == 0, "N/A").otherwise(F.col("s_suppkey").cast("string")).alias("n"))
    sinks.registry_csv(s, path)
    return readers.registry_csv(spark, path).select("serial", "n")


@query("SELECT p_partkey::VARCHAR AS term, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS grp FROM part")
def terms_file(spark, d):
    path = new_folder(spark, "csv")
    table(spark, d, "part").select(F.col("p_partkey").alias("term"), F.when(F.col("p_size") % 2 == 1, F.col("p_brand")).alias("grp")).write.option("header", "true").csv(path)
    return configs.terms_schema(spark, path).select("term", "grp")


# workbooks and databases
def _files_of(rows, key, make):
    """(path, content): a file for each key, made of its rows in order, which come as a stream: a task holds a batch of them and the file."""
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for value, group in groupby(every, key=itemgetter(at)):
            yield pa.RecordBatch.from_arrays([pa.array([str(value)]), pa.array([make(group)], pa.binary())], names=["path", "content"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last(c) for c in (key, *(c for c in rows.columns if c != key))]
    return rows.repartition(n, key).sortWithinPartitions(*order).mapInArrow(run, "path string, content binary")


@query("SELECT c_nationkey::VARCHAR AS path, 'Data' AS sheet, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1)::INTEGER AS excel_row, c_custkey AS custkey, c_mktsegment AS segment FROM customer")
def workbooks_read_back(spark, d):
    """A workbook for each nation, of its customers; cells come back in long form."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    c_names = c.columns
    book = lambda rows: sinks.workbook_bytes({"Data": (c_names, rows), "Empty": (["a"], [])})
    cells = readers.workbook_rows(_files_of(c, "c_nationkey", book)).filter("sheet = 'Data' and excel_row > 1")
    wide = cells.groupBy("path", "sheet", "excel_row").agg(F.max(F.when(F.col("excel_col") == 2, F.col("value"))).cast("long").alias("custkey"), F.max(F.when(F.col("excel_col") == 3, F.col("value"))).alias("segment"))
    return wide


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_nationkey % 10 = 0 THEN 'BadZipFile' END AS error FROM nation")
def workbook_files(spark, d):
    """Named workbooks in a folder, every tenth of which isn't one."""
    folder = new_folder(spark, "workbooks")
    for r in table(spark, d, "nation").collect():
        good = sinks.workbook_mirror({"t": spark.createDataFrame([(r.n_nationkey, r.n_name)], "k int, name string")}) if r.n_nationkey % 10 else b"no workbook"
        sinks.write_with_backup(spark, good, f"{folder}/{r.n_nationkey}.xlsx", "0")
    cells = readers.workbooks(spark, folder).withColumn("f", F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("int"))
    found = cells.groupBy("f").agg(F.max(F.when((F.col("excel_row") == 2) & (F.col("excel_col") == 2), F.col("value"))).alias("name"), F.max(F.split("error", ":")[0]).alias("error"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("f"), "n_name")
    return found.join(names, "f").select(F.col("f").alias("k"), F.coalesce("name", "n_name").alias("name"), "error")


@query("SELECT s_nationkey::VARCHAR AS path, s_suppkey AS id, s_name AS title_norm, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS balance FROM supplier")
def databases_read_back(spark, d):
    """A database for each nation, of its suppliers."""

    def make(rows: Iterator[tuple]) -> bytes:
        with closing(sqlite3.connect(":memory:")) as c:
            c.execute("create table documents (id integer, title_norm text, balance real)")
            c.executemany("insert into documents values (?, ?, ?)", ((key, name, balance if key % 3 == 0 else None) for _, key, name, balance in rows))
            c.commit()
            return c.serialize()

    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    return readers.sqlite_rows(_files_of(s, "s_nationkey", make), "select id, title_norm, balance from documents", "id long, title_norm string, balance double")


@query("SELECT n_regionkey AS region, count(*) AS documents FROM nation GROUP BY 1")
def indexed_documents(spark, d):
    """Named databases in a folder, whose documents go through the index reader."""
    folder = new_folder(spark, "databases")
    for region in table(spark, d, "region").collect():
        with closing(sqlite3.connect(":memory:")) as c:
            c.execute("create table documents (id integer, title_norm text)")
            c.executemany("insert into documents values (?, ?)", [(r.n_nationkey, r.n_name) for r in table(spark, d, "nation").filter(F.col("n_regionkey") == region.r_regionkey).collect()])
            c.commit()
            sinks.write_with_backup(spark, c.serialize(), f"{folder}/{region.r_regionkey}.sqlite3", "0")
    rows = readers.sqlite_table(spark, folder, "select id, title_norm from documents", "id long, title_norm string")
    return rows.groupBy(F.regexp_extract("path", r"(\d+)\.sqlite3$", 1).cast("int").alias("region")).agg(F.count("*").alias("documents"))


# settings
@query("SELECT upper(replace(n_name, ' ', '_')) AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'later' ELSE n_regionkey::VARCHAR END AS value FROM nation")
def environment_settings(spark, d):
    """Environment files of two layers, the later one over the earlier."""
    rows = table(spark, d, "nation").collect()
    name = lambda r: r.n_name.upper().replace(" ", "_")
    first = "# settings\n" + "\n".join(f"{name(r)} = '{r.n_regionkey}'" for r in rows)
    second = "\n\n".join(f'{name(r)}="later"' for r in rows if r.n_nationkey % 2 == 0)
    return spark.createDataFrame(list(readers.merged(readers.env_file(first), readers.env_file(second)).items()), "name string, value string")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'V' END AS units, ['mean', 'max'] AS statistics FROM nation")
def trend_settings(spark, d):
    """A checked trend configuration, its columns' missing units filled from those found."""
    rows = table(spark, d, "nation").collect()
    raw = {"statistics": ["MEAN", "max"], "columns": [{"name": r.n_name, "units": "" if r.n_nationkey % 2 == 0 else "V"} for r in rows]}
    made = sinks.back_filled(configs.trend_config(raw), {r.n_name: {"units": "A"} for r in rows})
    return spark.createDataFrame([(c["name"], c["units"], made["statistics"]) for c in made["columns"]], "name string, units string, statistics array<string>")

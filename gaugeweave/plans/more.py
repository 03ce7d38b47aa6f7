"""Further registered queries: registries, runs, scans, the test-data cache, names and codes, drawn tables, documents' facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeweave.functions import identities as I
from gaugeweave.functions import scalars as S
from gaugeweave.operators import cache, documents, grids, incremental, layout, registry, resolvers, values
from gaugeweave.plans.catalog import query
from gaugeweave.session import dealt, table
from gaugeweave.shared import new_folder


# registries
def _bridge(spark, d):
    return table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("long").alias("project_id"), F.col("o_orderkey").cast("long").alias("document_id"))


def _term_tests(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"), F.col("l_orderkey").cast("long").alias("document_id"), F.concat(F.lit("T"), (F.col("l_partkey") % 23).cast("string")).alias("term"), F.when(F.col("l_tax") != 0, F.col("l_discount") <= 0.08).alias("computed_pass"))


TERM_TESTS = "SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS id, l_orderkey::BIGINT AS document_id, 'T' || (l_partkey % 23) AS term, CASE WHEN l_tax <> 0 THEN l_discount <= 0.08 END AS computed_pass FROM lineitem"


@query(f"SELECT DISTINCT (o_custkey % 7)::BIGINT AS project_id, term FROM ({TERM_TESTS}) t JOIN orders ON document_id = o_orderkey")
def used_terms(spark, d):
    return registry.used_terms(_bridge(spark, d), _term_tests(spark, d))


@query(f"""WITH f AS (SELECT (o_custkey % 7)::BIGINT AS project_id, term, min(document_id * 1000000000 + id) AS seen FROM ({TERM_TESTS}) t JOIN orders ON document_id = o_orderkey GROUP BY 1, 2)
SELECT project_id, term AS term_id, 1 AS enabled, row_number() OVER (PARTITION BY project_id ORDER BY seen, term)::INTEGER AS display_order FROM f""")
def enable_used_terms(spark, d):
    none = spark.createDataFrame([], "project_id long, term_id string, enabled int, display_order int, custom_min double, custom_max double")
    return registry.enable_used(none, _bridge(spark, d), _term_tests(spark, d)).drop("custom_min", "custom_max")


@query(f"""WITH t AS (SELECT document_id, count(*) AS n, count(*) FILTER (computed_pass) AS p, count(*) FILTER (NOT computed_pass) AS f, count(*) FILTER (computed_pass IS NULL) AS w FROM ({TERM_TESTS}) GROUP BY 1)
SELECT o_orderkey::BIGINT AS id, CASE WHEN f > 0 THEN 'FAILED' WHEN w > 0 THEN 'PENDING' WHEN n > 0 THEN 'CERTIFIED' ELSE 'NO_DATA' END AS certification_status, coalesce(p, 0)::INTEGER AS certification_passed_count, coalesce(f, 0)::INTEGER AS certification_failed_count, coalesce(w, 0)::INTEGER AS certification_pending_count,
  CASE WHEN n > 0 THEN p || '/' || n ELSE '' END AS certification_pass_rate FROM orders LEFT JOIN t ON document_id = o_orderkey""")
def certificates_written_back(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"))
    found = registry.certificates(docs, _term_tests(spark, d))
    return registry.certificate_of(registry.certified_documents(docs, found, F.lit("now"))).drop("certification_analyzed_at")


@query("""SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_name) AS id, r_name || ' Project' AS name, r_name AS grouping_value FROM region UNION ALL SELECT row_number() OVER (ORDER BY n_name), n_name, NULL FROM nation""")
def projects_by_program(spark, d):
    none = spark.createDataFrame([], registry.PROJECT)
    some = registry.create_projects(none, table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return registry.projects_by_program(some, table(spark, d, "region").select(F.col("r_name").alias("program"))).select("id", "name", "grouping_value")


@query("""SELECT 'P_V' || o_custkey || '_SN' || o_orderkey || '.pdf' AS path, 'P' AS program, 'V' || o_custkey AS vehicle, 'SN' || o_orderkey AS serial,
  CASE WHEN o_orderkey % 3 = 0 THEN 'new' WHEN o_orderkey % 5 = 0 THEN 'pdf_newer' WHEN o_orderkey % 7 = 0 THEN 'terms_newer' ELSE 'up_to_date' END AS reason FROM orders""")
def workspace_sync(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    serial = F.concat(F.lit("SN"), k.cast("string"))
    packages = o.select(F.concat(F.lit("P_V"), F.col("o_custkey").cast("string"), F.lit("_"), serial, F.lit(".pdf")).alias("path"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    at = F.when(k % 5 == 0, F.date_sub("o_orderdate", 1)).otherwise(F.date_add("o_orderdate", 1))
    runs = o.filter(k % 3 != 0).select(serial.alias("serial"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("run_date"), F.lit("").alias("program"), F.lit("").alias("vehicle"))
    missing = o.filter(k % 7 == 0).select(serial.alias("serial"), F.lit(2).alias("n"))
    return registry.workspace_sync(packages, runs, missing).drop("run_date")


@query("""WITH s AS (SELECT DISTINCT p_brand AS term_label, p_type AS data_group FROM part), m AS (SELECT lower(p_brand) AS t, lower(p_type) AS g, 'S' || (p_size % 3) AS serial, arg_max(CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'x' END, p_partkey) AS v FROM part GROUP BY 1, 2, 3),
d AS (SELECT t, g, count(*) AS n FROM m WHERE v <> '' AND serial IN ('S0', 'S1') GROUP BY 1, 2) SELECT term_label, data_group FROM s LEFT JOIN d ON lower(term_label) = t AND lower(data_group) = g WHERE coalesce(n, 0) < 2""")
def missing_term_rows(spark, d):
    p = table(spark, d, "part")
    schema = p.select(F.col("p_brand").alias("term_label"), F.col("p_type").alias("data_group")).distinct()
    master = p.select(F.upper("p_brand").alias("term_label"), F.col("p_type").alias("data_group"), F.concat(F.lit("S"), (F.col("p_size") % 3).cast("string")).alias("serial"), F.when(F.col("p_partkey") % 4 == 0, " ").otherwise("x").alias("value"), F.col("p_partkey").alias("row_no"))
    return registry.missing_term_rows(schema, master, ["S0", "S1"])


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def stale_run_folders(spark, d):
    folders = table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), "n_name")
    used = lambda t, k, b: table(spark, d, t).filter(F.col(b) > 9000).select(F.col(k).alias("run_folder"))
    return registry.stale_folders(folders, used("customer", "c_nationkey", "c_acctbal"), used("supplier", "s_nationkey", "s_acctbal")).select(F.col("path").alias("n_nationkey"), "n_name")


# scans
@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
s AS (SELECT k, CASE WHEN k % 17 = 0 THEN 0 ELSE 1 END AS done, k % 19 = 0 AS need, CASE WHEN k % 23 = 0 THEN 30 ELSE 50 END AS seen FROM o WHERE k % 5 <> 0),
f AS (SELECT k, CASE WHEN k % 7 = 0 THEN 2000000000 + k WHEN k % 23 = 0 THEN 1000 + k ELSE k END AS now, CASE WHEN k % 23 = 0 THEN 1000 + k ELSE k END AS old, k % 11 = 0 AS lacks FROM o WHERE k % 13 <> 0),
j AS (SELECT f.k, s.k IS NOT NULL AS known, done, need, CASE WHEN s.k IS NULL THEN 'new' WHEN need THEN 'pending' WHEN done = 0 THEN 'never_processed' WHEN seen < 45 AND now > 45 THEN 'reappeared' WHEN now <> old THEN 'changed' WHEN now > 45 THEN 'new_since_last_scan' END AS why, lacks FROM f LEFT JOIN s ON s.k = f.k)
SELECT 'f' || k AS rel_path, CASE WHEN lacks AND (NOT known OR done <> 0) THEN coalesce(why, 'missing_artifacts') ELSE why END AS reason, (why IS NOT NULL OR (lacks AND (NOT known OR done <> 0)) OR coalesce(need, false)) AS needs_processing FROM j
UNION ALL SELECT 'f' || s.k, NULL, need FROM s WHERE s.k % 13 = 0""")
def scan_states(spark, d):
    k = F.col("k")
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    old = F.when(k % 23 == 0, 1000 + k).otherwise(k)
    done = F.when(k % 17 != 0, F.lit(1).cast("long"))
    state = o.filter(k % 5 != 0).select(
        F.concat(F.lit("f"), k.cast("string")).alias("rel_path"), F.concat_ws(":", k, old).alias("file_fingerprint"), k.alias("size_bytes"), old.alias("mtime_ns"), F.lit(1).cast("long").alias("first_seen_epoch_ns"),
        F.when(k % 23 == 0, 30).otherwise(50).cast("long").alias("last_seen_epoch_ns"), done.alias("last_processed_epoch_ns"), F.when(done.isNotNull(), old).alias("last_processed_mtime_ns"), (k % 19 == 0).alias("needs_processing"),
    )
    now = F.when(k % 7 == 0, 2_000_000_000 + k).otherwise(old)
    listing = o.filter(k % 13 != 0).select(F.concat(F.lit("f"), k.cast("string")).alias("rel_path"), k.alias("size_bytes"), now.alias("mtime_ns"), F.lit(False).alias("has_token"), F.lit(False).alias("token_ok"), (k % 11 != 0).alias("artifacts_ok"))
    return incremental.scan(state, listing, 100, 45).select("rel_path", "reason", "needs_processing")


@query("SELECT o_orderkey AS path, o_custkey AS size_bytes, o_custkey + 1 AS mtime_ns FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def files_to_mirror(spark, d):
    k = F.col("path")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("size_bytes"), (F.col("o_custkey") + 1).alias("mtime_ns"))
    copy = o.filter(k % 3 != 0).withColumn("mtime_ns", F.when(k % 5 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))
    return incremental.to_mirror(o, copy)


# the test-data cache
def _sheet_values(spark, d):
    e = table(spark, d, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2020-01-01").cast("timestamp"))) / 3.6e9
    base = e.select(F.concat(F.lit("SN"), (F.col("user_id") % 7).cast("string")).alias("serial"), F.col("event_type").alias("run"), F.col("event_id").cast("long").alias("excel_row"), hours.alias("time_s"), F.col("value").cast("double").alias("Thrust"))
    return base.unpivot(["serial", "run", "excel_row"], ["time_s", "Thrust"], "column", "value")


SHEET = "SELECT 'SN' || (user_id % 7) AS serial, event_type AS run, event_id AS r, (epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 3.6e9 AS x, value::DOUBLE AS y FROM events"


def _cache(spark, d):
    v = _sheet_values(spark, d)
    sources = v.groupBy("serial").agg(F.lit("w").alias("sqlite_path"), F.lit(1).cast("long").alias("mtime_ns"), F.lit(2).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("error"))
    wanted = spark.createDataFrame([(None, "thrust", "lbf", 1)], "run_name string, name string, units string, place int")
    none = spark.createDataFrame([], "row_index int, term string, header string, table_label string, value_type string, data_group string, term_label string, units string, min string, max string, active boolean, stat string")
    return cache.build(v, sources, wanted, none, ["mean", "min", "max", "std", "median", "count"])


@query(f"""WITH s AS ({SHEET}), w AS (SELECT serial, run AS run_name, avg(y) AS mean, min(y) AS min, max(y) AS max, coalesce(stddev_samp(y), 0) AS std, median(y) AS median, count(y)::DOUBLE AS count FROM s WHERE y IS NOT NULL GROUP BY 1, 2)
SELECT serial, run_name, 'thrust' AS column_name, stat, value_num FROM w UNPIVOT (value_num FOR stat IN (mean, min, max, std, median, count))""")
def td_cache_metrics(spark, d):
    return _cache(spark, d)["td_metrics"].select("serial", "run_name", "column_name", "stat", "value_num")


@query(f"""WITH s AS (SELECT * FROM ({SHEET}) WHERE y IS NOT NULL AND x IS NOT NULL)
SELECT run AS run_name, 'thrust' AS y_name, 'Time' AS x_name, serial, count(*)::INTEGER AS n_points, arg_min(x, r) AS first_x, arg_max(y, r) AS last_y FROM s GROUP BY run, serial""")
def td_cache_curves(spark, d):
    c = _cache(spark, d)["td_curves"]
    return c.select("run_name", "y_name", "x_name", "serial", "n_points", F.element_at("x", 1).alias("first_x"), F.element_at("y", -1).alias("last_y"))


@query(f"""WITH s AS ({SHEET}), m AS (SELECT serial, run AS run_name, CASE WHEN serial IN ('SN1', 'SN4') THEN y + 1 ELSE y END AS y FROM s WHERE y IS NOT NULL AND serial <> 'SN2')
SELECT serial, run_name, max(y) AS value_num, 2::BIGINT AS version FROM m GROUP BY 1, 2""")
def td_cache_versions(spark, d):
    """A cache is written, then three serials are replaced: two have other values, one has none any more; the newest version is read."""
    folder, made = new_folder(spark, "cache"), _cache(spark, d)
    cache.write(made, folder)
    changed = spark.createDataFrame([("SN1",), ("SN2",), ("SN4",)], "serial string")
    fresh = {"td_metrics": made["td_metrics"].filter("serial in ('SN1', 'SN4')").withColumn("value_num", F.col("value_num") + 1), "td_curves": made["td_curves"].filter("serial <> 'SN2'")}
    version = cache.replace(fresh, changed, folder)
    return cache.read(spark, folder)["td_metrics"].filter("stat = 'max'").select("serial", "run_name", "value_num", F.lit(version).cast("long").alias("version"))


@query(f"""SELECT run AS run_name, serial, count(*)::INTEGER AS n_points FROM ({SHEET}) WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2""")
def td_cache_pinned(spark, d):
    """A reader of version 1 is not touched by version 2."""
    folder, made = new_folder(spark, "cache"), _cache(spark, d)
    cache.write(made, folder)
    old = cache.read(spark, folder)
    cache.replace({name: made[name].limit(0) for name in cache.BY_SERIAL}, made["td_sources"].select("serial"), folder)
    return old["td_curves"].select("run_name", "serial", "n_points")


@query("SELECT event_type AS run_name, 'Time' AS default_x, event_type AS display_name FROM events GROUP BY 1")
def td_cache_runs(spark, d):
    return cache.runs(_cache(spark, d))


@query(f"""SELECT serial, max(y) AS value_num FROM ({SHEET}) WHERE run = 'click' AND y IS NOT NULL GROUP BY 1""")
def td_metric_map(spark, d):
    return cache.metric_map(_cache(spark, d), "click", "thrust", "MAX")


# names, codes, texts
@query("""SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9_]+', '_', 'g')) AS code, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '', 'g')) AS key, 'sheet__' || regexp_replace(p_brand, '[^0-9A-Za-z_]+', '_', 'g') AS sheet,
  'A' AS program, 'B' || p_size AS vehicle, 'SN' || p_partkey AS serial, 'TP' || p_partkey AS plan FROM part""")
def names_and_codes(spark, d):
    p = table(spark, d, "part")
    path = F.concat(F.lit("/x/A_B"), F.col("p_size").cast("string"), F.lit("_SN"), F.col("p_partkey").cast("string"), F.lit(".xlsx"))
    plan = F.concat(F.lit("see Test Plan TP"), F.col("p_partkey").cast("string"), F.lit(" of it"))
    out = p.select("p_partkey", I.program_code(F.col("p_name")).alias("code"), I.title_key(F.col("p_name")).alias("key"), I.sheet_table(F.col("p_brand")).alias("sheet"), I.workbook_identity(path).alias("i"), I.plan_number(plan).alias("plan"))
    return out.select("p_partkey", "code", "key", "sheet", "i.program", "i.vehicle", "i.serial", "plan")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'SN' || left(c_custkey::VARCHAR, 3) WHEN c_custkey % 4 = 1 AND c_custkey < 1000 THEN 'SN' || c_custkey WHEN c_custkey % 4 = 1 THEN 'sn 0' || c_custkey ELSE 'no key' END AS serial FROM customer""")
def serial_keys(spark, d):
    c = table(spark, d, "customer").repartition(spark.sparkContext.defaultParallelism)
    k = F.col("c_custkey").cast("string")
    heading = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("SN"), k)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("sn 0"), k)).otherwise("no key")
    known = spark.range(1000).select(F.concat(F.lit("SN"), F.col("id").cast("string")).alias("serial"))
    return values.serial_keys(c.select("c_custkey", heading.alias("header")), known).select("c_custkey", "serial")


@query("SELECT DISTINCT term, unnest(range(1, n + 1))::INTEGER AS instance, CASE WHEN n > 1 THEN term || ' (' || unnest(range(1, n + 1)) || ')' ELSE term END AS term_instance FROM (SELECT term, max(c) AS n FROM (SELECT l_returnflag AS term, l_orderkey, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1)")
def term_instances(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("term"), F.col("l_orderkey").alias("serial"))
    return values.most_instances(t).select("term", "instance", "term_instance")


@query("""WITH p AS (SELECT p_partkey // 10 AS doc_id, (p_partkey % 10)::INTEGER AS row, (p_size % 3)::INTEGER AS col, p_brand FROM part), w AS (SELECT doc_id, max(col) AS n FROM p GROUP BY 1)
SELECT doc_id, row, array_to_string([CASE WHEN i = col THEN p_brand ELSE '' END FOR i IN range(0, n + 1)], '|') AS cells FROM p JOIN w USING (doc_id)""")
def table_matrices(spark, d):
    k = F.col("p_partkey")
    cells = table(spark, d, "part").select(F.floor(k / 10).alias("doc_id"), (k % 10).cast("int").alias("row"), (F.col("p_size") % 3).cast("int").alias("col"), F.col("p_brand").alias("text"), k.alias("cell_id"))
    return layout.table_matrix(cells, ["doc_id"]).withColumn("cells", F.array_join("cells", "|"))


@query("SELECT p_partkey, 2 AS indent, length(p_name) AS width, p_name || '|' || p_brand AS cells, '| ' || p_brand || repeat(' ', 20 - length(p_brand)) || ' |' AS drawn FROM part")
def drawn_rows(spark, d):
    p = table(spark, d, "part")
    border = F.concat(F.lit("  +"), F.repeat(F.lit("-"), F.length("p_name")), F.lit("+--+"))
    at = grids.border_layout(border)
    line = F.concat(F.lit("  | "), F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit(" |  |"))
    return p.select("p_partkey", at["indent"].alias("indent"), F.get(at["widths"], F.lit(0)).alias("width"), F.array_join(grids.pipe_cells(line), "|").alias("cells"), grids.rendered_row(F.array("p_brand"), F.array(F.lit(22)), F.lit(0)).alias("drawn"))


# documents
def _reports(spark, d):
    """A report for each order: a profile and an acceptance table, as lines. One small file would be one task, so rows are dealt over all cores first."""
    o = dealt(table(spark, d, "orders"))
    k = F.col("o_orderkey").cast("string")
    bar = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    q = F.round(F.col("o_totalprice")).cast("long").cast("string")
    lines = F.array(
        F.lit("=== Page 1 ==="), F.lit("+--+--+"), bar(F.lit("Field"), F.lit("Value")), bar(F.lit("Program"), F.col("o_orderpriority")), bar(F.lit("SERIAL"), F.concat(F.lit("SN"), k)), F.lit("+--+--+"), F.lit(""),
        F.lit("+--+--+"), bar(F.lit("Parameter"), F.lit("Minimum"), F.lit("Max"), F.lit("Measured"), F.lit("Units")), bar(F.lit("Price"), F.lit("1000"), F.lit("150000"), q, F.lit("USD")), bar(F.lit("Pending"), F.lit("1"), F.lit(""), F.lit("-"), F.lit("V")), F.lit("+--+--+"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS program, 'SN' || o_orderkey AS serial FROM orders")
def document_profiles(spark, d):
    return documents.document_profile(_reports(spark, d)).select("doc_id", "program", "serial")


@query("""WITH q AS (SELECT o_orderkey AS doc_id, round(o_totalprice)::BIGINT AS v FROM orders)
SELECT doc_id, 'Price' AS term, '1000 - 150000' AS requirement_raw, v::DOUBLE AS measured_value, 'USD' AS units, v BETWEEN 1000 AND 150000 AS computed_pass FROM q UNION ALL SELECT doc_id, 'Pending', '>= 1', NULL, 'V', NULL FROM q""")
def acceptance_facts(spark, d):
    return documents.acceptance_tests(_reports(spark, d)).select("doc_id", "term", "requirement_raw", "measured_value", "units", "computed_pass")


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:800], chr(10)) AS head FROM documents""")
def first_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", resolvers.first_pages(F.col("text")).alias("head"))


@query("""WITH n AS (SELECT doc_id, [len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x = w)) FOR w IN ['the', 'of', 'und']] AS c FROM documents)
SELECT doc_id, CASE WHEN list_max(c) >= 2 THEN ['the', 'of', 'und'][list_position(c, list_max(c))] END AS asset FROM n""")
def asset_by_frequency(spark, d):
    return table(spark, d, "documents").select("doc_id", resolvers.asset_by_frequency(F.col("text"), ["the", "of", "und"]).alias("asset"))


@query("""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'value ' || o_orderkey END AS found FROM orders""")
def label_values(spark, d):
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("| Vendor | "), F.col("o_orderpriority"), F.lit(" |"))).when(k % 3 == 1, F.concat(F.lit("the vendor: value "), k.cast("string"))).otherwise(F.concat(F.lit("Vendor\n value "), k.cast("string")))
    text = F.concat(F.lit("first line\nvendors are many\n"), body, F.lit("\nVendor: late"))
    return table(spark, d, "orders").repartition(spark.sparkContext.defaultParallelism).select(k.alias("doc_id"), resolvers.label_value(resolvers.lines_of(text), "Vendor").alias("found"))


@query("SELECT o_orderkey AS doc_id, 'Price' AS term, round(o_totalprice)::DOUBLE AS number, 'table' AS source FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'Price', o_custkey::DOUBLE, 'line' FROM orders WHERE o_orderkey % 2 = 1")
def document_values(spark, d):
    o = table(spark, d, "orders").repartition(spark.sparkContext.defaultParallelism)  # one small file would be one task
    even = F.col("o_orderkey") % 2 == 0
    row = F.array(F.lit("Unit price"), F.lit("x"), F.round("o_totalprice").cast("long").cast("string"))
    block = F.struct(F.lit("heading").alias("heading"), F.lit(None).cast("string").alias("label"), F.array(F.array(F.lit("Other"), F.lit("1")), row).alias("rows"), F.lit(None).cast("map<string,string>").alias("kv"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.when(even, F.array(block)).alias("blocks"), F.array(F.lit("first 1"), F.concat(F.lit("the price of "), F.col("o_custkey").cast("string"))).alias("lines"))
    asked = spark.createDataFrame([("Price",)], "term string")
    return values.document_values(docs, asked).select("doc_id", "term", "number", "source")


@query("SELECT o_orderkey AS doc_id, c_name AS term, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice) ELSE o_orderkey END::DOUBLE AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'table' ELSE 'line' END AS source FROM orders JOIN customer ON o_custkey = c_custkey")
def values_of_many_terms(spark, d):
    """Every customer's name is asked of every order's document; each document has one of them, in a cell or in a line."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    row = F.array(F.concat(F.lit("Paid by "), F.col("c_name")), F.round("o_totalprice").cast("long").cast("string"))
    block = F.struct(F.lit("heading").alias("heading"), F.lit(None).cast("string").alias("label"), F.array(F.array(F.lit("Other"), F.lit("1")), row).alias("rows"), F.lit(None).cast("map<string,string>").alias("kv"))
    docs = o.select(k.alias("doc_id"), F.when(k % 3 == 0, F.array(block)).alias("blocks"), F.array(F.lit("first 1"), F.when(k % 3 != 0, F.concat_ws(" ", F.lit("paid by"), F.lower("c_name"), k.cast("string"))).otherwise("-")).alias("lines"))
    asked = table(spark, d, "customer").select(F.col("c_name").alias("term"))
    return values.document_values(docs, asked).select("doc_id", "term", "number", "source")


@query("SELECT l_orderkey, count(*) AS n, list_sort(list(l_quantity))[(count(*) // 2 + 1)::BIGINT] AS mid, list_sort(list(l_quantity))[(floor(count(*) * 0.25) + 1)::BIGINT] AS quarter FROM lineitem GROUP BY 1")
def order_places(spark, d):
    from gaugeweave.operators import geometry

    return geometry.at_shares(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", {"quarter": 0.25, "mid": 0.5}).select("l_orderkey", "n", "quarter", "mid")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'number' ELSE 'string' END AS kind, o_orderkey % 10 = 0 AS skipped FROM orders")
def times_and_kinds(spark, d):
    k = F.col("o_orderkey")
    shown = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")).when(k % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy H:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    kind = I.return_type(F.when(k % 2 == 0, "num"), F.lit("string"), F.lit("number"))
    path = F.concat(F.lit("/a/n"), (k % 10).cast("string"), F.lit("/f.pdf"))
    return table(spark, d, "orders").select(k, F.date_format(I.run_time(shown), "yyyy-MM-dd").alias("day"), kind.alias("kind"), I.ignored_path(path, ["N0"]).alias("skipped"))


@query("SELECT p_partkey, p_size::VARCHAR || ' mm' AS spaced FROM part")
def healed_spacing(spark, d):
    return table(spark, d, "part").select("p_partkey", S.heal_spacing(F.concat(F.col("p_size").cast("string"), F.lit("mm"))).alias("spaced"))

"""Queries of registries, project links, cache readers, page geometry, report facts and metadata rules, over rows laid out from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import identities as I
from gaugeweave.functions import scalars as S
from gaugeweave.operators import cache, documents, geometry, incremental, layout, projects, registry, resolvers, trending
from gaugeweave.plans.catalog import query
from gaugeweave.plans.constructed import _orders, _text
from gaugeweave.plans.more import _cache
from gaugeweave.session import table
from gaugeweave.sources import configs


def _placed(rows, *order):
    """``rows`` with their place by ``order``, the order that a listing promises."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


# projects and their documents
def _projects(spark, d):
    n = table(spark, d, "nation")
    old = n.filter("n_nationkey < 5").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"), F.lit("program").alias("grouping_strategy"), F.col("n_name").alias("grouping_value"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    return old, n


@query("SELECT id::BIGINT AS id, name, value FROM (SELECT n_nationkey AS id, n_name AS name, n_name AS value FROM nation WHERE n_nationkey < 5 UNION ALL SELECT 4 + row_number() OVER (ORDER BY n_name), n_name || ' Project', n_name FROM nation WHERE n_nationkey >= 5)")
def projects_made(spark, d):
    """Projects for the programs that have none yet, numbered on."""
    old, n = _projects(spark, d)
    return registry.projects_by_program(old, n.select(F.col("n_name").alias("program"))).select("id", "name", F.col("grouping_value").alias("value"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, (row_number() OVER (ORDER BY n_nationkey DESC))::INTEGER AS place FROM nation WHERE n_nationkey < 5 AND n_nationkey % 2 = 0")
def projects_present(spark, d):
    """Listed projects whose folder is there; the greatest id is first, as all were changed at once."""
    old, n = _projects(spark, d)
    found = registry.present_projects(old.withColumn("folder", F.col("name")), n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("path")))
    return _placed(found.select("id", "name"), F.desc("id"))


@query("SELECT s_nationkey AS project_id, s_suppkey AS document_id, 'link' AS part FROM supplier WHERE s_nationkey % 3 <> 0 UNION ALL SELECT s_nationkey, s_suppkey, 'setting' FROM supplier WHERE s_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, 0, 'project' FROM nation WHERE n_nationkey < 5 AND n_nationkey % 3 <> 0")
def projects_deleted(spark, d):
    """A deleted project takes its links and settings along."""
    old, n = _projects(spark, d)
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("document_id"))
    left = registry.delete_projects(old, s, s, n.filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("id")))
    return left[1].withColumn("part", F.lit("link")).unionByName(left[2].withColumn("part", F.lit("setting"))).unionByName(left[0].select(F.col("id").cast("int").alias("project_id"), F.lit(0).cast("long").alias("document_id"), F.lit("project").alias("part")))


@query("SELECT o_custkey % 7 AS project_id, o_orderkey AS document_id FROM orders WHERE o_orderkey % 4 <> 0 UNION SELECT 9, o_orderkey FROM orders WHERE o_orderkey % 10 = 0")
def links_changed(spark, d):
    b = table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("project_id"), F.col("o_orderkey").alias("document_id"))
    more = b.filter("document_id % 10 = 0").withColumn("project_id", F.lit(9).cast("long"))
    return projects.link(projects.link(projects.unlink(b, b.filter("document_id % 4 = 0")), more), more)


@query("SELECT o_orderkey AS id, o_clerk AS serial, (row_number() OVER (ORDER BY o_orderdate, o_clerk, o_orderkey))::INTEGER AS place FROM (SELECT o_orderkey, o_orderdate, 'SN' || o_custkey AS o_clerk FROM orders WHERE o_custkey % 7 = 3)")
def documents_of_a_project(spark, d):
    o = table(spark, d, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("SN"), F.col("o_custkey").cast("string")).alias("serial"), F.col("o_orderdate").alias("test_date"))
    bridge = o.select((F.col("o_custkey") % 7).alias("project_id"), F.col("o_orderkey").alias("document_id"))
    return _placed(projects.project_documents(docs, bridge, 3), "test_date", "serial", "id").select("id", "serial", "place")


@query("SELECT 'SN' || o_custkey AS serial, kind FROM orders, (VALUES ('acceptance'), ('test_data')) k(kind) WHERE o_orderkey % 5 <> 0 AND CASE kind WHEN 'test_data' THEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 ELSE o_orderkey % 2 <> 0 END GROUP BY ALL")
def serials_a_project_may_hold(spark, d):
    k = F.col("o_orderkey")
    docs = table(spark, d, "orders").select(F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" SN"), F.col("o_custkey").cast("string"))).alias("serial"), (k % 2 == 0).alias("is_test_data"), F.when(k % 3 == 0, "t").alias("workbook_table"))
    return registry.project_serials(registry.project_allowed("acceptance", docs)).withColumn("kind", F.lit("acceptance")).unionByName(registry.project_serials(registry.project_allowed("test_data", docs)).withColumn("kind", F.lit("test_data")))


@query("SELECT o_orderkey AS rel_path, forced FROM orders, (VALUES (true), (false)) f(forced) WHERE forced OR o_orderkey % 3 = 0")
def files_to_process(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("rel_path"), (F.col("o_orderkey") % 3 == 0).alias("needs_processing"), F.col("o_custkey").alias("mtime_ns"))
    return registry.candidates_to_process(f).select("rel_path", F.lit(False).alias("forced")).unionByName(registry.candidates_to_process(f, True).select("rel_path", F.lit(True).alias("forced")))


@query("SELECT o_orderkey AS rel_path, way FROM orders, (VALUES ('needed'), ('forced'), ('both')) w(way) WHERE CASE way WHEN 'needed' THEN o_orderkey % 3 = 0 WHEN 'forced' THEN o_orderkey % 5 = 0 ELSE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 END")
def files_of_a_run(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("rel_path"), (F.col("o_orderkey") % 3 == 0).alias("needs_processing"), F.col("o_custkey").alias("mtime_ns"))
    forced = f.filter("rel_path % 5 = 0").select("rel_path")
    ways = {"needed": incremental.to_process(f), "forced": incremental.to_process(f, forced, True), "both": incremental.to_process(f, forced)}
    parts = [x.select("rel_path", F.lit(w).alias("way")) for w, x in ways.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT o_orderkey AS order_no FROM (SELECT *, sum((o_orderkey % 3 = 0)::INTEGER) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders) WHERE coalesce(before, 0) < 20")
def results_up_to_a_limit(spark, d):
    """Twenty files that went well end a run; failures don't count."""
    return registry.until_successes(table(spark, d, "orders").select(F.col("o_orderkey").alias("order_no"), (F.col("o_orderkey") % 3 == 0).alias("ok")), 20).select("order_no")


@query("SELECT o_orderkey AS path, made FROM orders, (VALUES ('new'), ('all')) m(made) WHERE made = 'all' OR o_orderkey % 4 <> 0 UNION ALL SELECT 5, 'watermark'")
def artifacts_to_write(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    have = o.filter("path % 4 = 0")
    meta = incremental.watermark(spark.createDataFrame([("last_scan_epoch_ns", "1"), ("x", "2")], "key string, value string"), 5)
    mark = meta.filter("key = 'last_scan_epoch_ns'").select(F.col("value").cast("long").alias("path"), F.lit("watermark").alias("made"))
    return incremental.to_write(o, have).withColumn("made", F.lit("new")).unionByName(incremental.to_write(o, have, True).withColumn("made", F.lit("all"))).unionByName(mark)


@query("SELECT n_name AS name, n_regionkey % 2 = 0 AS enabled, (row_number() OVER (ORDER BY n_regionkey % 2 = 0 DESC, n_nationkey DESC))::INTEGER AS place FROM nation")
def listed_nodes(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("enabled"), F.col("n_nationkey").alias("updated_at"))
    return _placed(registry.nodes(rows), F.desc("enabled"), F.desc("updated_at")).select("name", "enabled", "place")


# terms
@query("SELECT t AS term_id, kind FROM (SELECT DISTINCT 'T' || (l_partkey % 23) AS t, 'registered' AS kind FROM lineitem UNION ALL SELECT unnest(['LEAK150', 'CV50', 'CV100', 'OPEN_T', 'CLOSE_T', 'HYST', 'ACT_P', 'PROOF', 'DEADBAND', 'LINEARITY']), 'default' UNION ALL SELECT unnest(['OPEN_T', 'CLOSE_T']), 'timing' UNION ALL SELECT 'HYST', 'one')")
def registered_terms(spark, d):
    """The terms of all tests beside those that a new registry holds."""
    li = table(spark, d, "lineitem")
    none = lambda t: F.lit(None).cast(t)
    tests = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("document_id"), F.concat(F.lit("T"), (F.col("l_partkey") % 23).cast("string")).alias("term"), none("string").alias("description"), none("string").alias("units"), none("string").alias("requirement_type"), none("double").alias("requirement_min"), none("double").alias("requirement_max"))
    base = registry.default_registry(spark)
    whole = registry.terms_of(registry.register_tests(base, tests))
    kind = F.when(F.col("category").isNull(), "registered").otherwise("default")
    out = whole.select("term_id", kind.alias("kind"))
    return out.unionByName(registry.terms_of(base, "timing").select("term_id", F.lit("timing").alias("kind"))).unionByName(registry.term(base, "HYST").select("term_id", F.lit("one").alias("kind")))


@query("SELECT (SELECT count(*) FROM nation) AS projects, (SELECT count(DISTINCT l_partkey % 23) FROM lineitem) + 10 AS terms, (SELECT count(*) FROM orders) AS links, (SELECT count(*) FROM (SELECT DISTINCT n_nationkey, l_partkey % 23 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN nation ON o_custkey % 25 = n_nationkey)) AS settings")
def set_up_after_extraction(spark, d):
    """Projects by program, documents linked, terms registered and switched on."""
    old, n = _projects(spark, d)
    o = table(spark, d, "orders").withColumn("n_nationkey", (F.col("o_custkey") % 25).cast("int")).join(n, "n_nationkey")
    li = table(spark, d, "lineitem")
    none = lambda t: F.lit(None).cast(t)
    tests = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("document_id"), F.concat(F.lit("T"), (F.col("l_partkey") % 23).cast("string")).alias("term"), none("string").alias("description"), none("string").alias("units"), none("string").alias("requirement_type"), none("double").alias("requirement_min"), none("double").alias("requirement_max"))
    docs = o.select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("program"))
    empty = spark.createDataFrame([], "project_id long, document_id long")
    settings = spark.createDataFrame([], "project_id long, term_id string, enabled int, display_order int, custom_min double, custom_max double")
    p, r, links, s = registry.set_up(registry.projects_by_program(old, n.select(F.col("n_name").alias("program"))), registry.default_registry(spark), docs, empty, settings, tests)
    count = lambda x, name: x.agg(F.count("*").alias(name))
    return count(p, "projects").crossJoin(count(r, "terms")).crossJoin(count(links, "links")).crossJoin(count(s, "settings"))


@query("SELECT 'T' || p AS term_id, n AS display_order FROM (SELECT l_partkey % 23 AS p, (min(l_orderkey) % 1000)::INTEGER AS n FROM lineitem WHERE l_partkey % 23 % 2 = 0 GROUP BY 1)")
def terms_switched_on(spark, d):
    """Terms that are on in a project: all were switched on, odd ones off again."""
    li = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 23).alias("p")).agg((F.min("l_orderkey") % 1000).cast("int").alias("display_order"))
    terms = li.select(F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("T"), F.col("p").cast("string")).alias("term_id"), "display_order", "p")
    known = terms.select("term_id", "term_id", *(F.lit(None).cast("string").alias(c) for c in ("description", "expected_units", "category", "requirement_type")), *(F.lit(None).cast("double").alias(c) for c in ("default_min", "default_max"))).toDF("term_id", "display_name", "description", "expected_units", "category", "requirement_type", "default_min", "default_max")
    none = spark.createDataFrame([], "project_id long, term_id string, enabled int, display_order int, custom_min double, custom_max double")
    on = registry.enable(none, terms.drop("p"))
    return registry.enabled_terms(known, registry.disable(on, terms.filter("p % 2 = 1").select("project_id", "term_id")), 1).select("term_id", "display_order")


# runs and their registries
@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS bad_sources")
def bad_sources(spark, d):
    return registry.bad_sources(table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, "OK").when(F.col("o_orderkey") % 2 == 0, "missing").alias("status")))


@query("SELECT o_orderkey AS folder, 'old' AS name FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0")
def migrated_registry(spark, d):
    """A registry takes over an older list's whole entries; keys that it has stay as they are."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("folder"))
    entries = o.select("folder", F.when(F.col("folder").cast("long") % 3 != 0, "new").otherwise(" ").alias("name"))
    return registry.migrated(o.filter("folder % 2 = 0").withColumn("name", F.lit("old")), entries.unionByName(entries)).select(F.col("folder").cast("long").alias("folder"), "name")


@query("SELECT p_brand AS name, ['a'] AS series, 'SN' AS x_axis, p_size % 2 = 0 AS include_min, true AS include_max FROM part")
def proposed_plots(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.array(F.lit(" a "), F.lit(" ")).alias("series"), F.lit("").alias("y_axis"), F.lit(None).cast("string").alias("x_axis"), F.when(F.col("p_size") % 2 == 1, "No").alias("include_min"), F.lit(1).alias("include_max"))
    return registry.proposed_plots(p).select("name", "series", "x_axis", "include_min", "include_max")


@query("SELECT p_brand AS name, p_size::VARCHAR AS units FROM part WHERE p_size % 2 = 0")
def plot_series(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).alias("Plot Name"), F.lit("t").alias("Term Label"), F.lit("g").alias("Data Group"), F.col("p_size").cast("string").alias("Units"), F.lit("").alias("Y Axis"))
    return registry.plot_series(p).select("name", "units")


@query("SELECT s_suppkey AS position, s_acctbal AS value, (row_number() OVER (ORDER BY s_suppkey))::INTEGER AS place FROM supplier WHERE s_nationkey % 2 = 0")
def series_by_position(spark, d):
    s = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "a").otherwise("b").alias("term"), F.col("s_suppkey").alias("position"), F.col("s_acctbal").alias("value"))
    return _placed(registry.series_by_position(s, "a"), "position").select("position", "value", "place")


@query("SELECT p_partkey, p_size % 2 = 0 AS fits, CASE WHEN p_size % 3 = 0 THEN [] ELSE ['a.json', 'b.json'] END AS chosen FROM part")
def sheet_headings_and_selections(spark, d):
    heads = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("TIME  (s)"), F.lit("Thrust"))).otherwise(F.array(F.lit("time"), F.lit("x")))
    meta = F.when(F.col("p_size") % 3 == 0, '{"selected_metadata_rel": 5}').otherwise('{"selected_metadata_rel": ["b.json", " a.json", "b.json", ""]}')
    return table(spark, d, "part").select("p_partkey", registry.has_headers(heads, ["thrust", "Time (S)"]).alias("fits"), registry.selected_metadata(meta).alias("chosen"))


@query("SELECT p_partkey, 'Run1' AS run, 'thrust' AS col, CASE WHEN p_size % 2 = 0 THEN 'max' ELSE 'min' END AS stat FROM part WHERE p_size % 3 <> 0")
def metric_names(spark, d):
    size = F.col("p_size")
    name = F.when(size % 3 == 0, "thrust.max").when(size % 2 == 0, "Run1.thrust.max").otherwise("Run1.thrust.min.x")
    return table(spark, d, "part").select("p_partkey", configs.metric_name(name).alias("m")).filter("m is not null").select("p_partkey", "m.run", F.col("m.column").alias("col"), "m.stat")


@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'Run A' ELSE 'B' END AS sheet, CASE WHEN o_orderkey % 2 = 0 THEN 't1' ELSE 'sheet__B' END AS table_name FROM orders")
def sheets_of_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    info = o.filter("path % 2 = 0").select("path", F.lit("Run A").alias("sheet"), F.lit("t1").alias("table_name"))
    tables = o.select("path", F.explode(F.array(F.lit("sheet__B"), F.lit("other"))).alias("table_name"))
    return configs.run_sheets(info, tables)


# readers of the cache
@query("SELECT 'SN' || (user_id % 7) AS name, 'serial' AS kind FROM events GROUP BY 1 UNION ALL SELECT event_type, 'run' FROM events GROUP BY 1 UNION ALL SELECT 'Time', 'x' UNION ALL SELECT 'thrust', 'y'")
def cache_lists(spark, d):
    t = _cache(spark, d)
    parts = {"serial": cache.serials(t).toDF("name"), "run": cache.run_names(t).toDF("name"), "x": cache.x_columns(t, "click"), "y": cache.y_columns(t, "click").select("name")}
    rows = [x.select("name", F.lit(k).alias("kind")) for k, x in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("SELECT 'thrust' AS name, 'lbf' AS units, min(value)::DOUBLE AS range_min, max(value)::DOUBLE AS range_max FROM events WHERE event_type = 'click'")
def cache_y_columns(spark, d):
    return cache.y_columns(_cache(spark, d), "click")


@query("SELECT 'SN' || (user_id % 7) AS serial, count(*)::INTEGER AS n, sum(value)::DOUBLE AS y FROM events WHERE event_type = 'click' AND value IS NOT NULL AND user_id % 7 IN (1, 2) GROUP BY 1")
def cache_curves_of_serials(spark, d):
    c = cache.curve_lookup(_cache(spark, d), "click", "thrust", "Time", ["SN1", "SN2"])
    return c.select("serial", F.size("x").alias("n"), F.aggregate("y", F.lit(0.0), lambda s, v: s + v).alias("y"))


@query("SELECT p_brand AS name, (row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 9 END, p_brand))::INTEGER AS place FROM (SELECT DISTINCT p_brand FROM part)")
def columns_in_config_order(spark, d):
    found = cache.in_config_order(table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct(), ["Brand#3", "Brand#1"])
    return _placed(found.withColumn("_m", F.monotonically_increasing_id()), "_m").select("name", "place")


@query("SELECT case_no, rebuild FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, (SELECT count(DISTINCT user_id % 7) FROM events) <> 1), (6, false)) v(case_no, rebuild)")
def cache_freshness(spark, d):
    """A cache is made anew if it is missing, older than its workbook, lacks a table, or has other serials."""
    t = _cache(spark, d)
    upgraded = cache.upgraded(t["td_runs"].drop("display_name"), "td_runs")
    have = set(cache.TABLES)
    cases = [cache.must_rebuild(None, 1, have), cache.must_rebuild(1, 2, have), cache.must_rebuild(3, 2, {"td_runs"}), cache.must_rebuild(3, 2, have), cache.must_rebuild(3, 2, have, t["td_sources"].filter("serial = 'SN1'"), t["td_sources"]), upgraded.columns != t["td_runs"].columns or cache.must_rebuild(3, 2, set(cache.empty(spark)), t["td_sources"], t["td_sources"])]
    return spark.createDataFrame(list(enumerate(cases, 1)), "case_no int, rebuild boolean")




# curves of any length
@query("""WITH p AS (SELECT event_type AS run, value::DOUBLE AS y, event_id AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events WHERE value IS NOT NULL)
SELECT *, lead(first_x) OVER (PARTITION BY run ORDER BY chunk_no) AS next_x FROM (SELECT run, (n // 100)::BIGINT AS chunk_no, count(*)::INTEGER AS n_points, min(x)::DOUBLE AS first_x, sum(y) AS y FROM p GROUP BY 1, 2)""")
def td_curve_chunks(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("x"), F.col("value").alias("y"))
    c = trending.curve_chunks(e, ["run"], "x", "y", "x", 100)
    return c.select("run", "chunk_no", "n_points", F.col("x")[0].alias("first_x"), F.aggregate("y", F.lit(0.0), lambda s, v: s + v).alias("y"), "next_x")


@query("SELECT event_type AS run, count(*)::INTEGER AS n_points, arg_min(value, event_id)::DOUBLE AS first_y, arg_max(value, event_id)::DOUBLE AS last_y FROM events WHERE value IS NOT NULL GROUP BY 1")
def td_curves_assembled(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("x"), F.col("value").alias("y"))
    whole = trending.assembled(trending.curve_chunks(e, ["run"], "x", "y", "x", 100), ["run"])
    return whole.select("run", "n_points", F.col("y")[0].alias("first_y"), F.element_at("y", -1).alias("last_y"))


# geometry of pages
def _sheets(spark, d):
    """A page for each supplier: what follows looks at one page at a time."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_nationkey").cast("long").alias("c")).repartition(spark.sparkContext.defaultParallelism)


def _tokens(spark, d):
    """A page for each supplier: six words in two lines, the fourth far to the right; the last repeats the fifth with less confidence."""
    k = F.col("k")
    word = lambda n, x, y, text, conf: F.struct(F.lit(n).alias("token_id"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.lit(float(x + 20)).alias("x1"), F.lit(float(y + 10)).alias("y1"), F.lit(text).alias("text"), F.lit(conf).alias("conf"))
    words = [word(1, 0, 10, "a", 0.9), word(2, 30, 11, "b", 0.9), word(3, 60, 10, "c", 0.9), word(4, 500, 12, "d", 0.9), word(5, 10, 300, "e", 0.9), word(6, 11, 301, "e", 0.5)]
    t = _sheets(spark, d).select(k.alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(*words)).alias("w")).select("doc_id", "page", "w.*")
    return t.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


@query("SELECT s_suppkey AS doc_id, unnest([1, 2, 3, 4, 5]) AS token_id, unnest([0, 0, 0, 1, 0])::BIGINT AS segment, unnest(['header', 'header', 'header', 'header', 'body']) AS zone FROM supplier")
def tokens_in_segments(spark, d):
    """Repeated words dropped, lines found, wide gaps cut, header and footer told apart."""
    lines = geometry.text_lines(geometry.unique_tokens(_tokens(spark, d)))
    return geometry.header_footer(geometry.split_at_gaps(lines, 600.0), 600.0).select("doc_id", "token_id", "segment", "zone")


@query("SELECT s_suppkey AS doc_id, unnest(['a b c d', 'e']) AS text, unnest([0, 1])::BIGINT AS paragraph FROM supplier")
def page_paragraphs(spark, d):
    lines = geometry.line_texts(geometry.text_lines(geometry.unique_tokens(_tokens(spark, d))))
    return geometry.paragraphs(lines).select("doc_id", "text", "paragraph")


@query("SELECT s_suppkey AS doc_id, unnest([1, 5]) AS token_id FROM supplier UNION ALL SELECT s_suppkey, 9 FROM supplier WHERE s_suppkey % 2 = 0")
def suppressed_boxes(spark, d):
    """Of boxes that overlap by more than the ratio the larger stays."""
    t = _tokens(spark, d).filter("token_id in (1, 5, 6)")
    t = t.withColumns({"x1": F.when(F.col("token_id") == 5, F.col("x1") + 2).otherwise(F.col("x1"))})
    far = t.filter("token_id = 1 and doc_id % 2 = 0").withColumns({"token_id": F.lit(9), "x0": F.col("x0") + 900, "x1": F.col("x1") + 900})
    return geometry.suppressed(t.unionByName(far)).select("doc_id", "token_id")


@query("SELECT s_suppkey AS doc_id, unnest([1, 2]) AS cell_id FROM supplier UNION ALL SELECT s_suppkey, 3 FROM supplier WHERE s_suppkey % 2 = 0")
def cells_without_containers(spark, d):
    """A cell that holds two others which cover it goes; one that holds a single other stays."""
    k = F.col("k")
    box = lambda n, x0, x1: F.struct(F.lit(n).alias("cell_id"), F.lit(float(x0)).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(x1)).alias("x1"), F.lit(20.0).alias("y1"))
    cells = F.when(k % 2 == 1, F.array(box(1, 0, 50), box(2, 50, 100), box(3, 0, 100))).otherwise(F.array(box(1, 0, 50), box(2, 200, 300), box(3, 0, 100)))
    rows = _sheets(spark, d).select(k.alias("doc_id"), F.lit(1).alias("page"), F.explode(cells).alias("c")).select("doc_id", "page", "c.*")
    return geometry.without_containers(rows).select("doc_id", "cell_id")


@query("SELECT s_suppkey AS doc_id, 'a b c d e e' AS text, 'abc d e' AS tight, 100.0::DOUBLE AS x1 FROM supplier")
def texts_of_cells(spark, d):
    """A cell's words with blanks, letters that stand close without, and coordinates of another resolution."""
    t = _tokens(spark, d).withColumn("line_no", (F.col("y0") > 100).cast("int"))
    near = t.filter("token_id < 6").withColumns({"x0": F.when(F.col("token_id") == 2, 21.0).when(F.col("token_id") == 3, 42.0).otherwise(F.col("x0")), "x1": F.when(F.col("token_id") == 2, 41.0).when(F.col("token_id") == 3, 62.0).otherwise(F.col("x1"))})
    wide = layout.scaled(t.filter("token_id = 2"), 2.0).select("doc_id", "x1")
    return layout.cell_text(t, ["doc_id"]).join(layout.cell_text(near, ["doc_id"], 0.3).withColumnRenamed("text", "tight"), "doc_id").join(wide, "doc_id")


@query("SELECT s_suppkey AS doc_id, unnest([1, 2, 3, 4, 5, 6]) AS token_id, unnest(['a', CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'b' END, 'c', 'd', 'e', 'e']) AS text FROM supplier")
def surer_readings(spark, d):
    t = _tokens(spark, d)
    again = t.filter("token_id = 2 or token_id = 3").select("doc_id", "page", "token_id", F.upper("text").alias("text"), F.when((F.col("token_id") == 2) & (F.col("doc_id") % 2 == 0), 0.95).otherwise(0.3).alias("conf"))
    return layout.surer_tokens(t, again.unionByName(again.withColumn("conf", F.lit(0.1)))).select("doc_id", "token_id", "text")


@query("SELECT o_orderkey AS doc_id, 'v' || o_custkey AS text, 12::BIGINT AS variants FROM orders")
def cells_read_again(spark, d):
    """The cell at a place of each table, and in how many ways tables are read again."""
    cells = _orders(spark, d).select(F.col("k").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_id"), F.lit(1).alias("row"), F.lit(2).alias("col"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.concat(F.lit("v"), _text(F.col("c"))).alias("t")), F.struct(F.lit(2).alias("n"), F.lit("later").alias("t")))).alias("x")).select("doc_id", "page", "table_id", "row", "col", F.col("x.n").alias("cell_id"), F.col("x.t").alias("text"))
    ways = layout.variant_matrix(spark, [1.0, 1.5, 2.0], [6, 11], ["keep", "drop"]).agg(F.count("*").alias("variants"))
    return layout.cell_at(cells, 1, 2).select("doc_id", "text").crossJoin(F.broadcast(ways))


# facts of reports
def _report(spark, d):
    """Lines of a report for each order: a labelled table of a kind by the key, and a calibration table."""
    k = F.col("k")
    title = F.when(k % 4 == 0, "Leak Test").when(k % 4 == 1, "Cycle log").when(k % 4 == 2, "Raw excerpt").otherwise("Anything")
    rule = F.lit("+------+--------------------+")
    row = lambda a, b: F.concat(F.lit("|"), F.rpad(a, 6, " "), F.lit("|"), F.rpad(b, 20, " "), F.lit("|"))  # room for any long
    lines = F.array(F.lit("=== Page 1 ==="), F.lit("[TABLE_LABEL]"), title, rule, row(F.lit("Name"), F.lit("Value")), rule, row(F.lit("x"), _text(k)), rule, F.lit("text"), F.lit("[TABLE_LABEL]"), F.lit("Gauge calibration"), rule, row(F.lit("Item"), F.lit("Seen")), rule, row(F.lit("g1"), _text(F.col("c"))), rule)
    return _orders(spark, d).select(k.alias("doc_id"), F.posexplode(lines).alias("line_no", "text"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'leak_test' WHEN 1 THEN 'stroke_test' WHEN 2 THEN 'raw_data' ELSE 'other' END AS category, o_orderkey::VARCHAR AS value FROM orders")
def test_data_by_category(spark, d):
    rows = documents.extracted(_report(spark, d))["test_data"].filter("not contains(lower(label), 'calibration')")
    return rows.select("doc_id", "category", F.trim(F.get("cells", F.lit(1))).alias("value"))


@query("SELECT o_orderkey AS doc_id, 'g1' AS item, o_custkey::VARCHAR AS seen FROM orders")
def calibration_rows(spark, d):
    rows = documents.extracted(_report(spark, d))["calibration"]
    cell = lambda name: F.trim(F.try_element_at(F.filter("cells", lambda c: F.trim(c["key"]) == name), F.lit(1))["value"])
    return rows.select("doc_id", cell("Item").alias("item"), cell("Seen").alias("seen"))


# names and metadata rules
@query("SELECT p_partkey, p_brand AS deep, CASE WHEN p_size % 2 = 0 THEN 'own' ELSE '' END AS either, CASE WHEN p_size % 3 = 0 THEN '/b' WHEN p_size % 3 = 1 THEN '/a' END AS found, CASE WHEN p_size = 7 THEN '' ELSE '2024-01-01 00:00:' || lpad(p_size::VARCHAR, 2, '0') END AS shown, 'it s a/b-c d' AS phrase, 'a b 1' AS fact, 'x' AS cell FROM part")
def small_readers(spark, d):
    size = F.col("p_size")
    meta = F.to_json(F.struct(F.struct(F.col("p_brand").alias("c d")).alias("a")))
    there = F.when(size % 3 == 0, F.array(F.lit("/b"))).when(size % 3 == 1, F.array(F.lit("/b"), F.lit("/a"))).otherwise(F.array(F.lit("/z")))
    stamp = F.when(size == 7, 0).otherwise((F.lit(1_704_067_200) + size).cast("long") * 1_000_000_000)
    p = table(spark, d, "part").withColumn("OWNER", F.when(size % 2 == 0, " own "))
    return p.select("p_partkey", I.json_path(meta, ".a.c d").alias("deep"), I.either_case(p.columns, "owner").alias("either"), I.first_existing([F.lit("/a"), F.lit("/b")], there).alias("found"), I.shown_time(stamp).alias("shown"), I.phrase_text(F.lit("It’ s  (a/b-c) d\"")).alias("phrase"), I.fact_text(F.lit(" A  b,1 ")).alias("fact"), S.strip_cell_border(F.lit("| _x ")).alias("cell"))


@query("SELECT p_partkey, p_size::VARCHAR || '-' || (p_size + 1) AS v, p_size % 2 = 0 AS is_range FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, '-' || p_size, false FROM part WHERE p_size % 2 = 1")
def range_texts(spark, d):
    size = F.col("p_size")
    v = F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit("-"), (size + 1).cast("string"))).otherwise(F.concat(F.lit("-"), size.cast("string")))
    return table(spark, d, "part").select("p_partkey", v.alias("v"), S.is_range_like(v).alias("is_range"))


@query("SELECT o_orderkey AS doc_id, 'Title ' || o_custkey AS program, CASE WHEN o_orderkey % 2 = 0 THEN 'PN-' || o_custkey END AS part, CASE WHEN o_orderkey % 3 = 0 THEN 'Valve' ELSE 'Pump' END AS asset, CASE WHEN o_orderkey % 3 = 0 THEN 'Valve' END AS in_name, CASE WHEN o_orderkey % 2 = 0 THEN 'EIDP' ELSE 'ATP' END AS type, 'Pump' AS exact, 4 AS lines FROM orders")
def metadata_finders(spark, d):
    """Program title, part number, asset type and document type of first pages, by rows, lines, words and names."""
    k = F.col("k")
    asset = F.when(k % 3 == 0, "valve").otherwise("pump")
    number = F.when(k % 2 == 0, F.concat(F.lit("| Part Number | PN-"), _text(F.col("c")), F.lit(" |"))).otherwise("| Part Number | -- |")
    text = F.concat_ws("\n", F.concat(F.lit("| Title | Title "), _text(F.col("c")), F.lit(" |")), number, F.concat(F.lit("| "), asset, F.lit(" type | x |")), F.lit(""), F.when(k % 2 == 0, "an End Item Data Package").otherwise("acceptance test procedure"), F.concat(F.lit("the "), asset, F.lit(" and the "), asset))
    docs = _orders(spark, d).select(k.alias("doc_id"), text.alias("t"), F.when(k % 3 == 0, "/x/my valve.pdf").otherwise("/x/y.pdf").alias("path"))
    lines = resolvers.lines_of(F.col("t"))
    entries = resolvers.alias_entries([{"name": "End Item Data Package", "acronym": "EIDP", "aliases": ["end item data package"]}, {"name": "ATP", "acronym": "ATP", "aliases": ["acceptance test procedure"]}], True)
    assets = ["Valve", "Pump"]
    found = F.coalesce(resolvers.asset_in_fields(lines, assets), resolvers.asset_by_frequency(F.col("t"), assets), resolvers.asset_in_text(F.col("t"), assets))
    kept = F.size(resolvers.without_type_lines(lines)) + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(-1)
    return docs.select("doc_id", resolvers.program_title(lines).alias("program"), resolvers.part_number(lines, resolvers.merged_part_labels(["item no"])).alias("part"), found.alias("asset"), resolvers.asset_in_name(F.col("path"), assets).alias("in_name"), resolvers.first_type(F.col("t"), entries).alias("type"), resolvers.exact_candidate(F.lit(" PUMP "), assets).alias("exact"), kept.alias("lines"))


@query("SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Old' WHEN s_suppkey % 3 = 1 THEN 'Acme' ELSE 'Unknown' END AS vendor FROM supplier")
def refreshed_metadata(spark, d):
    """Metadata derived again: what is found replaces what was there, what isn't leaves it."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    old = s.select(k.alias("doc_id"), F.when(k % 3 == 0, "Old").when(k % 3 == 1, "Old too").alias("vendor"))
    docs = s.select(k.alias("doc_id"), F.lit("/a/x.pdf").alias("path"), F.when(k % 3 == 1, "| Vendor | Acme |").otherwise("nothing here").alias("text"))
    allowed = {f: resolvers.allow_table(spark, ["Acme"]) for f in ("vendor",)}
    return resolvers.refreshed(old, docs, allowed).select("doc_id", "vendor")


@query("SELECT 'Continuous plotting enabled by Program: ' || string_agg(n_name, ', ' ORDER BY n_name) AS shown FROM nation WHERE n_regionkey = 1")
def population_sentences(spark, d):
    names = [r.n_name for r in table(spark, d, "nation").filter("n_regionkey = 1").collect()]
    rules = resolvers.population_rules({"programs": names}, {"program_title": ("programs",)})
    return spark.createDataFrame([(resolvers.population_description(rules),)], "shown string")


# grids and lines of a page, by the helpers that work on one page at a time
def _pages(spark, d):
    return _sheets(spark, d).select(F.col("k").alias("doc_id"), F.lit(1).alias("page"), F.col("k"), F.col("c"))


@query("""SELECT s_suppkey AS doc_id, 3 AS bands, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 4 END AS columns, 3 AS rows, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS parts, CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 13 END AS corners, 6 AS cells, 7 AS drawn, 7 AS copied,
  'c' || s_nationkey AS text, [105.0, 300.0]::DOUBLE[] AS means, [105.0, 300.0]::DOUBLE[] AS halves FROM supplier""")
def page_grids(spark, d):
    """A table of three rows whose last one has other columns where the key is odd: bands, bounds, rows, parts, corners, the cells made of them, and both drawings."""

    def parts(pdf):
        k, c = int(pdf["k"].iloc[0]), int(pdf["c"].iloc[0])
        inner = [100.0, 100.0, 60.0 if k % 2 else 100.0]
        cells = [(x0, 40.0 * r, x1, 40.0 * r + 40) for r, x in enumerate(inner) for x0, x1 in ((0.0, x), (x, 200.0))]
        points = layout.corners([(x, y) for b in cells for x in (b[0], b[2]) for y in (b[1], b[3])])
        flat = [(0.0, y, 200.0, y) for y in (0.0, 40.0, 80.0, 120.0)]
        upright = [(x, b[1], x, b[3]) for b in cells for x in (b[0], b[2])]
        texts = [f"c{c}", *"defgh"]
        drawn = layout.ascii_table([texts[i : i + 2] for i in (0, 2, 4)]).split("\n")
        copied = layout.ascii_replica(list(zip(cells, texts, strict=True))).split("\n")
        shown = drawn[1].split("|")[1].strip() if f"c{c}" in copied[1] else ""
        spots = [100.0, 110.0, 300.0]
        return [(len(layout.row_bands(cells)), len(layout.column_bounds(cells)), len(layout.rows_by_centre(cells)), len(layout.split_by_lines(cells)), len(points), len(layout.cells_from_corners(points, flat, upright)), len(drawn), len(copied), shown, layout.merged_means(spots), layout.merged_halves(spots, 20.0))]

    return layout._page_frame(_pages(spark, d), parts, "bands int, columns int, rows int, parts int, corners int, cells int, drawn int, copied int, text string, means array<double>, halves array<double>").drop("page")


@query("""SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Table 1 Leaks ' || s_nationkey ELSE 'Summary ' || s_nationkey END AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'Table 9' END AS other, 2 AS lines, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS bands, [true, false] AS standalone FROM supplier""")
def page_titles(spark, d):
    """The line above a table and another that names one; lines that are one; a title and a subtitle on one baseline; single lines and running text."""
    import numpy as np

    def parts(pdf):
        k, c = int(pdf["k"].iloc[0]), int(pdf["c"].iloc[0])
        lines = [((0.0, 50.0, 120.0, 60.0), f"Table 1 Leaks {c}" if k % 2 == 0 else f"Summary {c}"), ((0.0, 400.0, 100.0, 410.0), "Table 9" if k % 3 == 0 else "nothing of the kind")]
        found = layout.table_titles(lines, [(0.0, 70.0, 200.0, 200.0)])
        other = [t for n, t, _ in found if n is None]
        merged = layout.merged_lines([np.array([[0.0, 0, 20, 10]]), np.array([[30.0, 1, 50, 11]]), np.array([[0.0, 30, 20, 40]])])
        tall = 30.0 if k % 2 == 0 else 10.0
        line = np.array([[0.0, 0, 20, tall], [30.0, 0, 50, tall], [60.0, 0, 80, 10.0]]) + np.array([[0, 0, 0, 0], [0, 0, 0, 0], [0, 40, 0, 40]] if k % 2 == 0 else [[0] * 4] * 3)
        bands = layout.height_bands(line, ["TITLE", "TWO", "small"])
        alone = layout.standalone([[((0.0, 0.0, 50.0, 10.0), "A short line")], [((0.0, 20.0 * i, 300.0, 20.0 * i + 10), "a line of running text that goes on and on") for i in range(3)]])
        return [(next(t for n, t, _ in found if n == 1), other[0] if other else None, len(merged), len(bands), alone)]

    return layout._page_frame(_pages(spark, d), parts, "title string, other string, lines int, bands int, standalone array<boolean>").drop("page")


# what remains of registries and settings
@query("SELECT o_orderkey AS run, 'SN' || o_custkey AS serial FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey NOT IN (1, 4)")
def runs_pruned(spark, d):
    """Registered runs whose folder is there with a result, without those of two serials."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_folder"), F.concat(F.lit("SN"), F.col("o_custkey").cast("string")).alias("serial"))
    folders = o.filter("run_folder % 3 = 0").select(F.col("run_folder").alias("path"), (F.col("run_folder") % 2 == 0).alias("has_results"))
    return registry.delete_runs(registry.prune_runs(o, folders.unionByName(folders)), ["SN1", "SN4"]).select(F.col("run_folder").alias("run"), "serial")


@query("SELECT l_orderkey::VARCHAR AS serial, list_sort(list(DISTINCT 't' || (l_partkey % 23))) AS terms FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1")
def terms_of_runs(spark, d):
    """The distinct terms of each serial's results; rows that name another serial don't count."""
    k, n = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(k.alias("serial"), F.when(n == 2, "other").when(n == 3, F.concat(F.lit(" "), k)).alias("row_serial"), F.concat(F.lit(" T"), (F.col("l_partkey") % 23).cast("string")).alias("term_label"), F.when(n % 2 == 0, " ").alias("data_group"))
    return registry.run_terms(rows).select("serial", F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("terms"))


@query("SELECT c_nationkey::VARCHAR AS path, c_custkey::VARCHAR AS term_label, s AS serial, CASE WHEN s = 'SN2' AND c_custkey % 5 = 0 THEN 'N/A' ELSE (c_custkey * CASE s WHEN 'SN1' THEN 1 ELSE 2 END)::VARCHAR END AS value FROM customer, (VALUES ('SN1'), ('SN2')) x(s) WHERE NOT (s = 'SN1' AND c_custkey % 7 = 0)")
def master_sheets(spark, d):
    """A master sheet for each nation, a row for each of its customers, in long form; a blank cell is none, N/A is text."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("path"), F.col("c_custkey").alias("k"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) + 1).alias("excel_row"))
    cell = lambda col, v: F.struct(F.lit(col).alias("excel_col"), v.alias("value"))
    k = F.col("k")
    body = c.select("path", "excel_row", F.explode(F.array(cell(1, _text(k)), cell(2, F.lit("g")), cell(3, F.when(k % 7 != 0, _text(k)).otherwise(" ")), cell(4, F.when(k % 5 == 0, "N/A").otherwise(_text(2 * k))))).alias("c"))
    heads = c.select("path").distinct().select("path", F.lit(1).alias("excel_row"), F.explode(F.array(*(cell(i, F.lit(h)) for i, h in enumerate(("Term Label", "Data Group", "sn1", " SN2"), 1)))).alias("c"))
    cells = heads.unionByName(body).select("path", F.lit("Master").alias("sheet"), "excel_row", "c.excel_col", "c.value")
    return configs.master_rows(cells, "Master").select("path", "term_label", "serial", "value")


@query("SELECT n_nationkey AS page, v AS variant_no, n_name || v AS text FROM nation, (VALUES (0), (1)) x(v)")
def readings_in_sidecars(spark, d):
    """A JSON file for each page with its cells read again."""
    from gaugeweave.shared import new_folder

    folder = new_folder(spark, "sidecars")
    n = table(spark, d, "nation")
    candidate = lambda v: F.struct(F.lit(v).alias("variant_idx"), F.concat("n_name", F.lit(str(v))).alias("text"))
    cell = F.struct(F.lit(1).alias("row"), F.lit(2).alias("col"), F.array(candidate(0), candidate(1)).alias("candidates"))
    n.select(F.col("n_nationkey").alias("page"), F.array(F.struct(F.lit(1).alias("table_idx"), F.array(cell).alias("cells"))).alias("tables"), F.col("n_nationkey").alias("part")).repartition("part").write.partitionBy("part").json(folder)
    return configs.variant_readings(spark, folder).select("page", "variant_no", "text")


@query("SELECT event_type AS run, (SELECT count(*) FROM (SELECT DISTINCT user_id % 7 FROM events)) AS terms, degree FROM (SELECT DISTINCT event_type FROM events), (VALUES (1), (2)) x(degree)")
def fitted_equations(spark, d):
    """Equations of polynomials through the counts of each event type: as many terms as coefficients, and the settings of the plots that ask for them."""
    e = table(spark, d, "events")
    n = e.select((F.col("user_id") % 7).alias("u")).distinct().count()
    rows = []
    for r in e.select("event_type").distinct().collect():
        for degree in (1, 2):
            plot = configs.plotter({"x": {"column": "a", "stat": "MAX"}, "y": {"column": "b"}, "fit": configs.tolerant_json(f'{{"degree": {degree}}}', {})}, 1)
            shown = trending.equation([1.5] * (plot["fit"]["degree"] + 1))
            good = shown.count("·x") == plot["fit"]["degree"] and plot["stats"] == ["max"] and configs.tolerant_json("[1", []) == []
            rows.append((r.event_type, n if good else -1, degree))
    return spark.createDataFrame(rows, "run string, terms long, degree int")

"""Registered queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeweave.functions import scalars as S
from gaugeweave.operators import documents, extraction, geometry, incremental, likeness, metadata, orderstats, projects, trending
from gaugeweave.operators import relational as R
from gaugeweave.session import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add



def _tests(spark: SparkSession, d: str) -> DataFrame:
    """Acceptance tests: an order is a document, a line a test; pass is null (pending) where the tax is 0."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("term"), "l_linenumber", F.col("l_quantity").alias("measured"), F.when(F.col("l_tax") != 0, F.col("l_discount") <= 0.08).alias("passed"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Series: a run is an event type, a serial one of seven user groups, x the hours since the first event."""
    e = table(spark, d, "events")
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2020-01-01").cast("timestamp"))) / 3.6e9
    return e.select(F.col("event_type").alias("run"), (F.col("user_id") % 7).alias("serial"), hours.alias("x"), F.col("value").alias("y"), F.col("event_id").alias("ord"))


POINTS = "SELECT event_type AS run, user_id % 7 AS serial, (epoch_us(ts) - epoch_us(TIMESTAMP '2020-01-01')) / 3.6e9 AS x, value AS y, event_id AS ord FROM events"


@query("""
SELECT p_brand AS term, min(l_quantity) AS min_value, max(l_quantity) AS max_value, avg(l_quantity) AS avg_value, count(*) AS total_count,
       count(*) FILTER (l_quantity <= 45) AS pass_count, count(*) FILTER (l_quantity <= 45) / count(*) AS pass_rate
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity IS NOT NULL GROUP BY p_brand
""")
def trend_summary(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return R.summary(li.withColumn("ok", F.col("l_quantity") <= 45), "p_brand", "l_quantity", "ok")


@query("""
SELECT l_orderkey AS doc, max_by(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_returnflag = 'A') AS "A", max_by(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_returnflag = 'N') AS "N", max_by(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_returnflag = 'R') AS "R"
FROM lineitem GROUP BY 1
""")
def trending_matrix(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_returnflag", "l_quantity", (F.col("l_linenumber") * 1000 + F.col("l_quantity")).alias("ord"))
    return R.matrix(li, "doc", "l_returnflag", "l_quantity", "ord", ["A", "N", "R"])


CERT = """WITH t AS (SELECT l_orderkey AS doc, 'T' || l_linenumber AS term, CASE WHEN l_tax <> 0 THEN l_discount <= 0.08 END AS passed FROM lineitem),
p AS (SELECT doc, count(*) FILTER (passed) AS p, count(*) FILTER (NOT passed) AS f, count(*) FILTER (passed IS NULL) AS n, list_sort(list(term) FILTER (NOT passed)) AS terms FROM t GROUP BY 1),
c AS (SELECT o_orderkey AS doc, CASE WHEN p.doc IS NULL THEN 'NO_DATA' WHEN f > 0 THEN 'FAILED' WHEN n > 0 THEN 'PENDING' ELSE 'CERTIFIED' END AS status, coalesce(p, 0) AS passed_count, coalesce(f, 0) AS failed_count, coalesce(n, 0) AS pending_count, coalesce(terms, []) AS failed_terms FROM orders LEFT JOIN p ON o_orderkey = p.doc)
"""


@query(CERT + "SELECT doc, status, passed_count, failed_count, pending_count, array_to_string(failed_terms, ',') AS failed_terms FROM c")
def certification(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"))
    return R.certification(docs, _tests(spark, d), "doc", "term", "passed").withColumn("failed_terms", F.array_join("failed_terms", ","))


@query(CERT + """SELECT o_orderpriority AS priority, count(*) AS analyzed_count, count(*) FILTER (status = 'CERTIFIED') AS certified, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS pending,
  CASE WHEN sum(passed_count + failed_count + pending_count) > 0 THEN sum(passed_count)::BIGINT || '/' || sum(passed_count + failed_count + pending_count)::BIGINT END AS pass_rate_text
FROM c JOIN orders ON doc = o_orderkey GROUP BY 1""")
def certification_rollup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("priority"))
    c = R.certification(o, _tests(spark, d), "doc", "term", "passed")
    total = F.sum(F.col("passed_count") + F.col("failed_count") + F.col("pending_count"))
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("CERTIFIED", "certified"), ("FAILED", "failed"), ("PENDING", "pending"))]
    return c.groupBy("priority").agg(F.count("*").alias("analyzed_count"), *counts, F.when(total > 0, F.concat(F.sum("passed_count").cast("string"), F.lit("/"), total.cast("string"))).alias("pass_rate_text"))


@query("""
SELECT l_returnflag, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  count(*) FILTER (l_extendedprice < s_acctbal) AS n_below, count(*) FILTER (l_extendedprice > s_acctbal * 10) AS n_above,
  array_to_string(list_sort(list(DISTINCT s_name) FILTER (l_extendedprice < s_acctbal OR l_extendedprice > s_acctbal * 10)), ',') AS offenders
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""")
def exceedance_stats(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return R.exceedance(x, ["l_returnflag"], "l_extendedprice", F.col("s_acctbal"), F.col("s_acctbal") * 10, "s_name").withColumn("offenders", F.array_join("offenders", ","))


WIDE = "WITH w AS (SELECT user_id, event_type, avg(value) AS mean, min(value) AS min, max(value) AS max, median(value) AS median, stddev_samp(value) AS std, count(value)::DOUBLE AS count FROM events GROUP BY ALL) "


@query(WIDE + "SELECT * FROM (UNPIVOT INCLUDE NULLS w ON mean, min, max, median, std, count INTO NAME stat VALUE value_num)".replace("UNPIVOT INCLUDE NULLS w", "FROM w UNPIVOT INCLUDE NULLS (value_num FOR stat IN (mean, min, max, median, std, count))").split(" ON mean")[0] + ")")
def td_metrics_long(spark, d):
    return R.metrics_long(table(spark, d, "events"), ["user_id", "event_type"], "value")


@query(WIDE + "SELECT * FROM w")
def td_metrics_wide(spark, d):
    return R.metrics_wide(table(spark, d, "events"), ["user_id", "event_type"], "value")


@query("""
SELECT event_type, avg(value) AS mean, count(*)::DOUBLE AS count FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n > 2 GROUP BY 1
""")
def skip_first_metrics(spark, d):
    x = R.skip_first(table(spark, d, "events").filter("value is not null"), ["event_type", "user_id"], "event_id", 2)
    return R.metrics_wide(x, ["event_type"], "value").select("event_type", "mean", "count")


@query(f"WITH p AS ({POINTS}) SELECT run, serial, count(*)::INTEGER AS n_points, sum(x) AS sum_x, list(y ORDER BY ord)[1] AS first_y, list(y ORDER BY ord)[-1] AS last_y FROM p WHERE isfinite(x) AND isfinite(y) GROUP BY 1, 2")
def td_curves(spark, d):
    c = trending.curves(_points(spark, d), ["run", "serial"], "x", "y", "ord")
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return c.select("run", "serial", "n_points", total.alias("sum_x"), F.element_at("y", 1).alias("first_y"), F.element_at("y", -1).alias("last_y"))


DOMAIN = f"""WITH p AS ({POINTS}), r AS (SELECT run, serial, min(x) AS a, max(x) AS b FROM p GROUP BY 1, 2),
d AS (SELECT run, CASE WHEN min(b) - max(a) > 1e-12 THEN max(a) ELSE min(a) END AS lo, CASE WHEN min(b) - max(a) > 1e-12 THEN min(b) ELSE max(b) END AS hi FROM r GROUP BY 1),
dd AS (SELECT * FROM d WHERE hi - lo > 1e-12)"""
GRID = DOMAIN + """, f AS (SELECT run, serial, x, min(y) AS y0 FROM p GROUP BY 1, 2, 3),
s AS (SELECT *, lead(x) OVER w AS x1, lead(y0) OVER w AS y1 FROM f WINDOW w AS (PARTITION BY run, serial ORDER BY x)),
g AS (SELECT run, lo, hi, unnest(range(0, 50))::INTEGER AS grid_idx FROM dd), gx AS (SELECT run, grid_idx, lo + (hi - lo) * grid_idx / 49 AS grid_x FROM g),
v AS (SELECT gx.run, serial, grid_idx, grid_x, CASE WHEN x1 IS NULL OR grid_x = x THEN y0 ELSE y0 + (y1 - y0) * (grid_x - x) / (x1 - x) END AS y
  FROM gx JOIN s ON gx.run = s.run AND grid_x >= x AND (grid_x < x1 OR x1 IS NULL AND grid_x = x)),
m AS (SELECT run, grid_idx, grid_x, median(y) AS master_y, avg(y) AS mean_y, stddev_pop(y) AS std_y FROM v GROUP BY 1, 2, 3)"""
GRADED = GRID + """, sc AS (SELECT *, max(abs(master_y)) OVER (PARTITION BY run) AS sc0 FROM m), q AS (SELECT v.*, v.y - master_y AS res, CASE WHEN sc0 > 0 THEN sc0 ELSE 1 END AS sc FROM v JOIN sc USING (run, grid_idx)),
pr AS (SELECT run, serial, max(abs(res)) AS max_abs, sqrt(avg(res * res)) AS rms, max(sc) AS sc FROM q GROUP BY 1, 2),
z AS (SELECT *, (max_abs - avg(max_abs) OVER w) / CASE WHEN stddev_pop(max_abs) OVER w > 0 THEN stddev_pop(max_abs) OVER w ELSE 1 END AS z FROM pr WINDOW w AS (PARTITION BY run)),
gr AS (SELECT run, serial, max_abs, rms, max_abs / sc * 100 AS max_pct, rms / sc * 100 AS rms_pct, z, CASE WHEN abs(z) <= 1 THEN 'PASS' WHEN abs(z) <= 1.5 THEN 'WATCH' ELSE 'FAIL' END AS grade FROM z)"""


@query(DOMAIN + " SELECT * FROM dd")
def common_domain(spark, d):
    return trending.common_domain(_points(spark, d), ["run"], "serial", "x")


def _gridded(spark, d):
    p = _points(spark, d)
    return trending.on_grid(p, trending.common_domain(p, ["run"], "serial", "x"), ["run"], "serial", "x", "y", 50)


@query(GRID + " SELECT * FROM v")
def grid_interpolation(spark, d):
    return _gridded(spark, d)


@query(GRID + " SELECT * FROM m")
def master_curve(spark, d):
    return trending.master_curve(_gridded(spark, d), ["run"])


def _graded(spark, d):
    out = trending.residual_grading(_gridded(spark, d), ["run"], "serial")
    return out.drop("x_at_max").withColumn("grade", S.grade(F.col("z"), 1.0, 1.5))


@query(GRADED + " SELECT * FROM gr")
def residual_grading(spark, d):
    return _graded(spark, d)


@query(GRADED + " SELECT grade, count(*) AS n FROM gr GROUP BY 1")
def grade_counts(spark, d):
    return _graded(spark, d).groupBy("grade").agg(F.count("*").alias("n"))


@query(GRADED + " SELECT run, serial, max_pct, z FROM gr WHERE max_pct >= 10 OR rms_pct >= 5 OR abs(z) >= 2 ORDER BY max_pct DESC, abs(z) DESC, run, serial LIMIT 12")
def watch_findings_topk(spark, d):
    w = trending.watch(_graded(spark, d))
    return w.orderBy(F.desc("max_pct"), F.desc(F.abs("z")), "run", "serial").limit(12).select("run", "serial", "max_pct", "z")


PERF = """WITH m AS (SELECT user_id, event_type, avg(value) AS x, max(value) AS y FROM events GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM m)"""


@query(PERF + " SELECT user_id, event_type, x, y FROM c WHERE n >= 3")
def perf_points(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("isp"), F.max("value").alias("thrust")).unpivot(["user_id", "event_type"], ["isp", "thrust"], "col", "v").withColumn("stat", F.lit("s"))
    return trending.performance_points(m, "user_id", "event_type", "col", "stat", "v", "isp", "thrust", 3).select("user_id", "event_type", "x", "y")


@query("SELECT event_type, regr_slope(value, user_id) AS slope, regr_intercept(value, user_id) AS intercept, count(*) AS n FROM events GROUP BY 1")
def perf_linear_fit(spark, d):
    return trending.line_fit(table(spark, d, "events"), ["event_type"], "user_id", "value")


@query(f"""WITH p AS ({POINTS}), s AS (SELECT run, avg(x) AS m, stddev_pop(x) AS sd FROM p GROUP BY 1), u AS (SELECT p.run, (x - m) / sd AS u, y, m, sd FROM p JOIN s USING (run)),
t AS (SELECT run, any_value(m) AS m, any_value(sd) AS sd, count(*) AS n, sum(u) AS p1, sum(u * u) AS p2, sum(u * u * u) AS p3, sum(u * u * u * u) AS p4, sum(y) AS q0, sum(u * y) AS q1, sum(u * u * y) AS q2, sum(y * y) AS yy FROM u GROUP BY 1),
d AS (SELECT *, n * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p2 * p3) + p2 * (p1 * p3 - p2 * p2) AS det FROM t),
c AS (SELECT *, (q0 * (p2 * p4 - p3 * p3) - p1 * (q1 * p4 - q2 * p3) + p2 * (q1 * p3 - q2 * p2)) / det AS c0, (n * (q1 * p4 - q2 * p3) - q0 * (p1 * p4 - p2 * p3) + p2 * (p1 * q2 - p2 * q1)) / det AS c1, (n * (p2 * q2 - p3 * q1) - p1 * (p1 * q2 - p2 * q1) + q0 * (p1 * p3 - p2 * p2)) / det AS c2 FROM d)
SELECT run, n, round(c2 / (sd * sd) * 1e6, 4) AS quadratic, round((c1 / sd - 2 * c2 * m / (sd * sd)) * 1e3, 4) AS linear, round(c0 - c1 * m / sd + c2 * m * m / (sd * sd), 4) AS constant,
  round(sqrt(greatest(yy - 2 * (c0 * q0 + c1 * q1 + c2 * q2) + c0 * (c0 * n + c1 * p1 + c2 * p2) + c1 * (c0 * p1 + c1 * p2 + c2 * p3) + c2 * (c0 * p2 + c1 * p3 + c2 * p4), 0) / n), 6) AS rmse FROM c""")
def poly_fit_deg2(spark, d):
    fit = trending.poly_fit(_points(spark, d), ["run"], "x", "y", 2)
    at = lambda i, scale: F.round(F.get("coefficients", F.lit(i)) * scale, 4)
    return fit.select("run", "n", at(0, 1e6).alias("quadratic"), at(1, 1e3).alias("linear"), at(2, 1.0).alias("constant"), F.round("rmse", 6).alias("rmse"))


@query("""
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events WHERE trim(event_type) <> '' GROUP BY 1, 2) WHERE r = 1
""")
def most_common_value(spark, d):
    return R.most_common(table(spark, d, "events"), ["user_id"], "event_type")


@query("""
SELECT user_id, hour, event_type, n FROM (SELECT user_id, hour(ts)::INTEGER AS hour, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY count(*) DESC, min(event_id)) AS r FROM events WHERE trim(event_type) <> '' GROUP BY 1, 2, 3, hour(ts)) WHERE r = 1
""")
def majority_vote(spark, d):
    return R.majority_vote(table(spark, d, "events").withColumn("hour", F.hour("ts")), ["user_id", "hour"], "event_type", "event_id")


@query("SELECT coalesce(nullif(p_type, ''), '(blank)') AS unit, count(*) AS n FROM part GROUP BY 1")
def units_histogram(spark, d):
    return table(spark, d, "part").groupBy(F.coalesce(F.nullif("p_type", F.lit("")), F.lit("(blank)")).alias("unit")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT p_brand, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part GROUP BY 1), t AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2)
SELECT o.p_brand, CASE WHEN o.p_brand LIKE '%1' THEN 'fixed' ELSE p_type END AS units, a AS range_min, CASE WHEN o.p_brand LIKE '%1' THEN 5.0 ELSE b END AS range_max FROM o JOIN t ON o.p_brand = t.p_brand AND r = 1
""")
def range_autofill(spark, d):
    p = table(spark, d, "part")
    seen = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("range_min"), F.max("p_retailprice").alias("range_max")).join(R.most_common(p, ["p_brand"], "p_type").select("p_brand", F.col("p_type").alias("units")), "p_brand")
    one = F.col("p_brand").endswith("1")
    config = p.select("p_brand").distinct().select("p_brand", F.when(one, "fixed").otherwise("").alias("units"), F.lit(None).cast("double").alias("range_min"), F.when(one, 5.0).alias("range_max"))
    return R.range_autofill(config, seen, "p_brand")


@query("""
SELECT p_partkey, p_name, coalesce(q, 999)::BIGINT AS display_order FROM part LEFT JOIN (SELECT l_partkey, min(l_linenumber) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey
""")
def terms_left_join(spark, d):
    settings = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_linenumber").alias("q"))
    p = table(spark, d, "part")
    return p.join(settings, p["p_partkey"] == settings["l_partkey"], "left").select("p_partkey", "p_name", F.coalesce("q", F.lit(999)).cast("long").alias("display_order"))


@query("SELECT n_nationkey, o_orderpriority AS term, count(o_orderkey) = 0 AS missing FROM nation CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN (SELECT c_nationkey, o_orderpriority AS op, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) ON c_nationkey = n_nationkey AND op = o_orderpriority GROUP BY 1, 2")
def missing_terms(spark, d):
    n, o, c = (table(spark, d, t) for t in ("nation", "orders", "customer"))
    wanted = n.select("n_nationkey").crossJoin(o.select(F.col("o_orderpriority").alias("term")).distinct())  # nations by five priorities
    have = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderpriority").alias("term")).distinct().withColumn("have", F.lit(True))
    return wanted.join(have, ["n_nationkey", "term"], "left").select("n_nationkey", "term", F.col("have").isNull().alias("missing"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def best_doc_per_serial(spark, d):
    return R.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT conv_id, turn, role, CASE WHEN n > 1 THEN role || ' (' || n || ')' ELSE role END AS instance_label FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)")
def instance_labels(spark, d):
    return R.instance_labels(table(spark, d, "conversations"), ["conv_id"], "role", ["turn"]).select("conv_id", "turn", "role", "instance_label")


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT a.conv_id, a.n::INTEGER AS n, a.turn AS user_turn, b.turn AS assistant_turn FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.n = b.n AND a.role = 'user' AND b.role = 'assistant'
""")
def instance_alignment(spark, d):
    n = R.numbered(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"])
    side = lambda r: n.filter(F.col("role") == r).select("conv_id", "n", F.col("turn").alias(f"{r}_turn"))
    return side("user").join(side("assistant"), ["conv_id", "n"])


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user FROM conversations")
def forward_fill_marker(spark, d):
    return R.forward_fill(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "last_user").select("conv_id", "turn", "last_user")


@query("WITH i AS (SELECT o_custkey % 10 AS k, o_orderkey AS v, o_orderkey - row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS i FROM orders) SELECT k, min(v) AS first_value, max(v) AS last_value, count(*) AS n FROM i GROUP BY k, i HAVING count(*) >= 2")
def gaps_islands(spark, d):
    return R.integer_runs(table(spark, d, "orders").withColumn("k", F.col("o_custkey") % 10), ["k"], "o_orderkey", "o_orderkey", 2)


@query("""WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) > 3600000000 THEN 1 ELSE 0 END AS nw FROM events)
SELECT user_id, count(*) AS n_events, sum(nw)::BIGINT + 1 AS n_sessions FROM s GROUP BY 1""")
def gap_sessions(spark, d):
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return R.gap_sessions(e, ["user_id"], "us", F.lit(3_600_000_000)).groupBy("user_id").agg(F.count("*").alias("n_events"), (F.max("session") + 1).alias("n_sessions"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity - avg(l_quantity) OVER w) / CASE WHEN stddev_pop(l_quantity) OVER w > 0 THEN stddev_pop(l_quantity) OVER w ELSE 1 END AS z FROM lineitem WINDOW w AS (PARTITION BY l_partkey)")
def zscore_window(spark, d):
    return R.z_scores(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity").select("l_orderkey", "l_linenumber", "z")


@query("""SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, first_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def neighbour_lookup(spark, d):
    return R.neighbours(table(spark, d, "events"), ["user_id"], "event_id", F.when(F.col("value") > 50, F.col("value"))).select("event_id", "above", "below")


@query("""SELECT c_custkey, lower(trim(regexp_replace(c_name || '  ' || c_mktsegment, '\\s+', ' ', 'g'))) AS norm, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS key, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS spaced FROM customer""")
def text_normalize(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.normalize_text(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("norm"), S.normalize_key(F.col("c_name")).alias("key"), S.alnum_spaces(F.col("c_name")).alias("spaced"))


RAW = "CASE p_partkey % 7 WHEN 0 THEN p_size || ' - ' || (p_size + 5) WHEN 1 THEN '<= ' || p_size WHEN 2 THEN p_size || ' < x' WHEN 3 THEN '>= ' || p_size || ',5' WHEN 4 THEN p_size || ' >= x' WHEN 5 THEN p_size::VARCHAR ELSE 'see note' END"


@query(f"""WITH r AS (SELECT p_partkey, p_size, {RAW} AS raw FROM part)
SELECT p_partkey, raw, CASE p_partkey % 7 WHEN 0 THEN 'range' WHEN 1 THEN 'max' WHEN 2 THEN 'max' WHEN 3 THEN 'min' WHEN 4 THEN 'min' WHEN 5 THEN 'max' ELSE 'unknown' END AS type,
 CASE p_partkey % 7 WHEN 0 THEN p_size::DOUBLE WHEN 3 THEN p_size + 0.5::DOUBLE WHEN 4 THEN p_size::DOUBLE END AS req_min, CASE p_partkey % 7 WHEN 0 THEN p_size + 5.0::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size::DOUBLE WHEN 5 THEN p_size::DOUBLE END AS req_max,
 CASE p_partkey % 7 WHEN 0 THEN 25 BETWEEN p_size AND p_size + 5 WHEN 1 THEN 25 <= p_size WHEN 2 THEN 25 <= p_size WHEN 3 THEN 25 >= p_size + 0.5 WHEN 4 THEN 25 >= p_size WHEN 5 THEN 25 <= p_size ELSE true END AS ok FROM r""")
def requirement_parse(spark, d):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 7
    raw = F.when(k == 0, F.concat(size, F.lit(" - "), (F.col("p_size") + 5).cast("string"))).when(k == 1, F.concat(F.lit("<= "), size)).when(k == 2, F.concat(size, F.lit(" < x"))).when(k == 3, F.concat(F.lit(">= "), size, F.lit(",5"))).when(k == 4, F.concat(size, F.lit(" >= x"))).when(k == 5, size).otherwise("see note")
    p = table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("req", S.requirement(F.col("raw")))
    return p.select("p_partkey", "raw", "req.type", F.col("req.min").alias("req_min"), F.col("req.max").alias("req_max"), S.passes(F.col("req"), F.lit(25.0)).alias("ok"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS iso, strftime(o_orderdate + INTERVAL 20 YEAR, '%Y-%m-%d') AS iso_us, NULL::VARCHAR AS iso_old FROM orders")
def date_normalize(spark, d):
    late = F.add_months("o_orderdate", 240)  # the normaliser takes years from 2000 on
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.iso_date(F.date_format(late, "yyyy.M.d")).alias("iso"), S.iso_date(F.date_format(late, "M/d/yyyy")).alias("iso_us"), S.iso_date(F.date_format(F.add_months("o_orderdate", -120), "yyyy-MM-dd")).alias("iso_old"))


@query("SELECT s_suppkey, 'SN' || CASE WHEN length(s_suppkey::VARCHAR) < 4 THEN lpad(s_suppkey::VARCHAR, 4, '0') ELSE s_suppkey::VARCHAR END AS serial FROM supplier")
def serial_normalize(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", S.serial_number(F.concat(F.lit("unit s/n 000"), F.col("s_suppkey").cast("string"))).alias("serial"))


@query("""SELECT event_id, regexp_extract(props, '-?[0-9]+')::DOUBLE AS first_number, (props->>'$.k')::DOUBLE AS k, (value < 0) IS TRUE AS negative FROM events""")
def kv_numbers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.first_number(F.col("props")).alias("first_number"), S.finite_number(F.get_json_object("props", "$.k")).alias("k"), F.coalesce(F.col("value") < 0, F.lit(False)).alias("negative"))


@query("""SELECT n, chr((CASE WHEN n <= 26 THEN n - 1 ELSE (n - 27) // 26 END + 65)::INTEGER) || CASE WHEN n > 26 THEN chr(((n - 27) % 26 + 65)::INTEGER) ELSE '' END AS letters FROM (SELECT r_regionkey * 100 + 1 AS n FROM region)""")
def excel_letters(spark, d):
    n = table(spark, d, "region").select((F.col("r_regionkey") * 100 + 1).alias("n"))
    return n.select("n", S.excel_column(F.col("n")).alias("letters"))


@query("""WITH h AS (SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 1 ELSE 0 END AS a, CASE WHEN contains(lower(text), 'password') THEN 1 ELSE 0 END AS b, CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS c FROM documents)
SELECT doc_id, CASE WHEN b = 1 THEN 'secret' WHEN a = 1 THEN 'licensed' WHEN c = 1 THEN 'long' END AS label FROM h""")
def rule_labels(spark, d):
    rules = [metadata.LabelRule("licensed", priority=5, any_of=("license",)), metadata.LabelRule("secret", priority=9, any_of=("password",)), metadata.LabelRule("long", priority=1, least_chars=5001)]
    return metadata.rule_labels(table(spark, d, "documents"), rules, "text", "n_chars").select("doc_id", "label")


@query("""WITH a AS (SELECT DISTINCT n_name AS canonical, lower(n_name) AS alias FROM nation),
m AS (SELECT c_custkey, canonical, row_number() OVER (PARTITION BY c_custkey ORDER BY length(alias) DESC, canonical) AS r FROM (SELECT c_custkey, ' ' || lower(c_name || ' of ' || n_name) || ' ' AS t FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN a ON contains(t, ' ' || alias || ' '))
SELECT c_custkey, coalesce(canonical, 'Unknown') AS nation FROM customer LEFT JOIN m USING (c_custkey) WHERE coalesce(r, 1) = 1""")
def allowlist_resolve(spark, d):
    n = table(spark, d, "nation")
    blobs = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("c_name", F.lit(" of "), "n_name").alias("blob"))
    allow = n.select(F.col("n_name").alias("canonical"), F.col("n_name").alias("alias"))
    return metadata.allowlist(blobs, allow, "c_custkey", "blob").select("c_custkey", F.col("canonical").alias("nation"))


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) IN ('building', 'machinery') OR lower(n_name) IN ('france', 'nation_3', 'nation_4')")
def population_rules(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.filter(R.any_rule({"c_mktsegment": ["BUILDING", "MACHINERY"], "n_name": ["FRANCE", "NATION_3", "NATION_4"]})).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'license')")
def free_text_filter(spark, d):
    return table(spark, d, "documents").filter(R.free_text(["source", "lang", "text"], "LICENSE")).select("doc_id")


SNAP = """WITH a AS (SELECT o_orderkey AS path, o_custkey AS size, o_orderkey % 3 = 0 AS processed FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS size FROM orders WHERE o_orderkey % 13 <> 0)"""


@query(SNAP + " SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'gone' WHEN a.path IS NULL THEN 'new' WHEN a.size <> b.size THEN 'changed' WHEN NOT processed THEN 'pending' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.path = b.path")
def scan_changes(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.filter(k % 5 != 0).select(k.alias("path"), F.col("o_custkey").alias("fingerprint"), (k % 3 == 0).alias("processed"))
    b = o.filter(k % 13 != 0).select(F.when(k % 11 == 0, -k).otherwise(k).alias("path"), F.when(k % 7 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).alias("fingerprint"))
    return incremental.changes(a, b).select("path", "state")


@query("""WITH c AS (SELECT c_nationkey AS k FROM customer), s AS (SELECT s_nationkey AS k FROM supplier)
SELECT 'both' AS kind, count(*) AS n FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'first_only', count(*) FROM (SELECT k FROM c EXCEPT SELECT k FROM s)""")
def set_ops(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    count = lambda kind, x: x.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", c.intersect(s)).unionByName(count("either", c.union(s).distinct())).unionByName(count("first_only", c.subtract(s)))


@query("SELECT lower(c_mktsegment) AS key, min_by(c_mktsegment, c_custkey) AS c_mktsegment FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1".replace("lower(c_mktsegment) AS key, ", "").replace("GROUP BY 1", "GROUP BY lower(c_mktsegment)"))
def validation_list(spark, d):
    return R.first_spelling(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("SELECT doc_id, source, quality, quality IS NULL AS unlabelled FROM documents LEFT JOIN labels USING (doc_id)")
def files_left_documents(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", "source", "quality", F.col("quality").isNull().alias("unlabelled"))


@query("""WITH b AS (SELECT vec_id, vec_id % 50 AS page, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1] + 0.2::DOUBLE AS x1, embedding[2] + 0.2::DOUBLE AS y1 FROM embeddings),
t AS (SELECT vec_id, page, x0, y0, x0 + 0.05 AS x1, y0 + 0.05 AS y1 FROM b),
o AS (SELECT t.vec_id, b.vec_id AS cell, (least(t.x1, b.x1) - greatest(t.x0, b.x0)) * (least(t.y1, b.y1) - greatest(t.y0, b.y0)) / ((t.x1 - t.x0) * (t.y1 - t.y0)) AS overlap FROM t JOIN b ON t.page = b.page AND least(t.x1, b.x1) > greatest(t.x0, b.x0) AND least(t.y1, b.y1) > greatest(t.y0, b.y0))
SELECT vec_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY overlap DESC, cell) AS r FROM o WHERE overlap >= 0.5 AND cell <> vec_id) WHERE r = 1""")
def spatial_overlap(spark, d):
    e = table(spark, d, "embeddings")
    x, y, page = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double"), F.col("vec_id") % 50
    tokens = e.select("vec_id", page.alias("page"), x.alias("t_x0"), y.alias("t_y0"), (x + 0.05).alias("t_x1"), (y + 0.05).alias("t_y1"))
    cells = e.select(F.col("vec_id").alias("cell"), page.alias("page"), x.alias("c_x0"), y.alias("c_y0"), (x + 0.2).alias("c_x1"), (y + 0.2).alias("c_y1"))
    return R.best_cells(tokens, cells, ["page"], 0.25, "vec_id", "cell").select("vec_id", "cell")


#: (a, b, score) of pairs(a, b, x, y): the longest common substring, the earliest in x and then in y, then the same left and right of it.
RATIO = """part AS (SELECT a, b, x, y, 0 AS m, 0 AS depth FROM pairs UNION ALL
    SELECT a, b, unnest([left(x, i - 1), substr(x, i + l)]), unnest([left(y, j - 1), substr(y, j + l)]), unnest([l, 0]), depth + 1 FROM
        (SELECT *, strpos(y, substr(x, i, l)) AS j FROM
            (SELECT *, best.l AS l, -best.i AS i FROM
                (SELECT *, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda l: CASE WHEN strpos(y, substr(x, i, l)) > 0 THEN {'l': l, 'i': -i} END)))) AS best FROM part WHERE x <> '' AND y <> '')
             WHERE best IS NOT NULL))),
scores AS (SELECT part.a, part.b, 2.0 * sum(m) / any_value(length(p.x) + length(p.y)) AS score FROM part JOIN pairs p ON p.a = part.a AND p.b = part.b GROUP BY 1, 2)"""


@query(rf"""WITH RECURSIVE n AS (SELECT p_partkey, p_name, nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '') AS norm FROM part),
t AS (SELECT norm, row_number() OVER (ORDER BY min(p_partkey)) AS k FROM n WHERE norm IS NOT NULL GROUP BY norm),
pairs AS (SELECT l.k AS a, e.k AS b, l.norm AS x, e.norm AS y FROM t l JOIN t e ON e.k < l.k),
{RATIO},
near AS (SELECT t.k, coalesce(list(b) FILTER (b IS NOT NULL), []) AS earlier FROM t LEFT JOIN (SELECT * FROM scores WHERE score >= 0.86) s ON s.a = t.k GROUP BY t.k),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS heads, 0::BIGINT AS head UNION ALL
    SELECT near.k, CASE WHEN hit IS NULL THEN list_append(heads, near.k) ELSE heads END, coalesce(hit, near.k) FROM
        (SELECT near.k, heads, list_min(list_intersect(earlier, heads)) AS hit FROM walk JOIN near ON near.k = walk.k + 1) near)
SELECT p_partkey, p_name, coalesce(h.norm, 'unknown') AS group_id FROM n LEFT JOIN t USING (norm) LEFT JOIN walk USING (k) LEFT JOIN t h ON h.k = walk.head""")
def similarity_groups(spark, d):
    return likeness.group_similar(table(spark, d, "part"), "p_partkey", "p_name")


@query(rf"""WITH RECURSIVE pairs AS (SELECT DISTINCT c_mktsegment AS a, r_name AS b, lower(c_mktsegment) AS x, lower(r_name) AS y FROM customer, region),
{RATIO}
SELECT a AS c_mktsegment, b AS match, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM scores WHERE score >= 0.3) WHERE r = 1""")
def fuzzy_best_match(spark, d):
    return likeness.best_match(table(spark, d, "customer"), table(spark, d, "region"), "c_mktsegment", "r_name", 0.3)


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY 1")
def summary_report(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'N/A' WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'HOUSEHOLD' END AS v FROM customer""")
def fill_cells(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    existing = F.when(k % 4 == 0, "N/A").when(k % 3 == 0, F.col("c_mktsegment"))
    return c.select("c_custkey", R.fill_cells(existing, F.lit("HOUSEHOLD"), False).alias("v"))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'new' ELSE s_name END AS name FROM supplier UNION ALL SELECT -n_nationkey - 1, n_name FROM nation")
def upsert(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    fresh = old.filter("k % 2 = 0").select("k", F.lit("new").alias("name")).unionByName(table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("k"), F.col("n_name").alias("name")))
    return R.upsert(old, fresh, ["k"])


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(nullif(a.v, ''), b.v) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS v FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) b ON a.k = b.k""")
def merge_instances(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    a = c.filter("k % 5 <> 0").select("k", F.when(F.col("k") % 2 == 0, F.col("c_name")).otherwise("").alias("v"))
    return R.merge_instances(a, c.filter("k % 3 <> 0").select("k", F.col("c_mktsegment").alias("v")), ["k"], ["v"])


@query("""SELECT o_orderpriority, percentile, v FROM (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.1) AS p10, quantile_cont(o_totalprice, 0.5) AS p50, quantile_cont(o_totalprice, 0.9) AS p90 FROM orders GROUP BY 1) UNPIVOT (v FOR percentile IN (p10, p50, p90))""")
def percentiles(spark, d):
    p = orderstats.percentiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return p.unpivot(["o_orderpriority"], ["p10", "p50", "p90"], "percentile", "v")


@query("""WITH n AS (SELECT l_partkey, count(*) AS filled, avg(CASE WHEN l_quantity = floor(l_quantity) THEN 1.0 ELSE 0.0 END) AS share FROM lineitem GROUP BY 1) SELECT l_partkey, share, filled >= 2 AND share >= 0.6 AS numeric_column FROM n""")
def numeric_columns(spark, d):
    share = F.avg(F.when(F.col("l_quantity") == F.floor("l_quantity"), 1.0).otherwise(0.0))
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("filled"), share.alias("share"))
    return n.select("l_partkey", "share", ((F.col("filled") >= 2) & (F.col("share") >= 0.6)).alias("numeric_column"))


@query("SELECT event_type, list_sort(list(value))[(count(value) // 2 + 1)::BIGINT] AS upper_median FROM events GROUP BY 1")
def upper_median(spark, d):
    return geometry.upper_median(table(spark, d, "events").filter("value is not null"), ["event_type"], "value")


@query("""WITH s AS (SELECT user_id, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT user_id, CASE WHEN len(v) < 3 THEN v[-1] - v[1] ELSE v[(floor(len(v) * 0.9) + 1)::BIGINT] - v[(floor(len(v) * 0.1) + 1)::BIGINT] END AS spread FROM s""")
def trimmed_spread(spark, d):
    return geometry.trimmed_spread(table(spark, d, "events").filter("value is not null"), ["user_id"], "value")


@query("""WITH g AS (SELECT p_partkey, p_brand, p_retailprice, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) > 5 THEN 1 ELSE 0 END AS nw FROM part),
c AS (SELECT *, sum(nw) OVER (PARTITION BY p_brand ORDER BY p_retailprice ROWS UNBOUNDED PRECEDING) AS cl FROM g) SELECT p_brand, cl::BIGINT AS cluster, count(*) AS n, min(p_retailprice) AS low, max(p_retailprice) AS high FROM c GROUP BY 1, 2""")
def gap_clusters(spark, d):
    c = geometry.gap_clusters(table(spark, d, "part"), ["p_brand"], "p_retailprice", 5.0)
    return c.groupBy("p_brand", "cluster").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


@query("""SELECT p_partkey, serial, CASE serial WHEN 'p_brand' THEN 1 WHEN 'p_size' THEN 2 ELSE 3 END AS position, value_text, try_cast(nullif(regexp_extract(value_text, '[+-]?[0-9]+(\\.[0-9]+)?'), '') AS DOUBLE) AS value_num
FROM (SELECT p_partkey, p_brand, p_size::VARCHAR AS p_size, p_type FROM part) UNPIVOT INCLUDE NULLS (value_text FOR serial IN (p_brand, p_size, p_type))""")
def trending_long(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"), "p_type")
    return projects.trending_long(p, ["p_partkey"], ["p_brand", "p_size", "p_type"])


@query("""WITH r AS (SELECT r_regionkey::BIGINT AS id, 'Brand#1' || r_regionkey AS term, 'known' AS category FROM region), n AS (SELECT DISTINCT p_brand AS term FROM part WHERE p_brand NOT IN (SELECT term FROM r))
SELECT * FROM r UNION ALL SELECT (SELECT max(id) FROM r) + row_number() OVER (ORDER BY term), term, 'auto' FROM n""")
def register_terms(spark, d):
    registry = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit("Brand#1"), F.col("r_regionkey").cast("string")).alias("term"), F.lit("known").alias("category"))
    return projects.register_terms(registry, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("term")))


@query("""WITH v AS (SELECT event_type AS run, count(*) // 100 AS n FROM events GROUP BY 1), l AS (SELECT run, 'about ' || n || ' hundred' AS label FROM v)
SELECT run, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' — ' || run ELSE label END AS label FROM l""")
def run_labels(spark, d):
    v = table(spark, d, "events").groupBy(F.col("event_type").alias("run")).agg(F.floor(F.count("*") / 100).cast("string").alias("value")).withColumn("variable", F.lit("n"))
    return projects.run_labels(v, "about {n} hundred")


@query("""SELECT coalesce(c_custkey, o_custkey) AS serial FROM (SELECT c_custkey, c_custkey % 3 AS f FROM customer) FULL JOIN (SELECT DISTINCT o_custkey, o_custkey % 2 AS g FROM orders) ON c_custkey = o_custkey WHERE f IS DISTINCT FROM g""")
def stale_serials(spark, d):
    cached = table(spark, d, "customer").select(F.col("c_custkey").alias("serial"), (F.col("c_custkey") % 3).alias("fingerprint"))
    return projects.stale(cached, table(spark, d, "orders").select(F.col("o_custkey").alias("serial"), (F.col("o_custkey") % 2).alias("fingerprint")).distinct())


@query("SELECT DISTINCT o_custkey AS serial FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def append_sources(spark, d):
    have = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("serial"))
    docs = table(spark, d, "orders").withColumnRenamed("o_custkey", "serial")
    return projects.append_sources(have, docs, F.col("o_orderpriority") == "1-URGENT")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'string' WHEN p_partkey % 3 = 0 THEN 'number' WHEN p_size > 25 THEN 'number' ELSE 'string' END AS kind FROM part")
def value_types(spark, d):
    k = F.col("p_partkey")
    units, low = F.when(k % 3 == 0, "psi").otherwise(""), F.when(F.col("p_size") > 25, 1.0)
    term = F.when(k % 5 == 0, "Serial Number").otherwise("Torque")
    return table(spark, d, "part").select("p_partkey", extraction.value_type(term, F.lit(""), units, low, F.lit(None).cast("double")).alias("kind"))


@query("SELECT p_partkey, p_size::VARCHAR AS healed FROM part")
def heal_numbers(spark, d):
    broken = F.translate(F.col("p_size").cast("string"), "01", "OI")
    return table(spark, d, "part").select("p_partkey", S.heal_number(broken).alias("healed"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: x = '')) AS n_blank FROM documents")
def document_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.col("text") == "").alias("n_blank"))


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS t FROM documents),
k AS (SELECT *, regexp_matches(t, '^=== Page [0-9]+ ===\s*$') AS is_page, regexp_matches(t, '^\s*\+[-=+]+\+\s*$') AS is_border, regexp_matches(t, '^\s*\|.*\|\s*$') AS is_row, regexp_matches(t, '^\[[^\]]+\]\s*$') AS is_section FROM l),
p AS (SELECT *, last_value(CASE WHEN is_page THEN regexp_extract(t, '^=== Page ([0-9]+) ===', 1)::INTEGER END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page FROM k),
s AS (SELECT *, last_value(CASE WHEN is_section AND NOT is_page AND NOT is_border AND NOT is_row THEN regexp_extract(t, '^\[([^\]]+)\]', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM p),
x AS (SELECT doc_id, page, section, line_no, regexp_extract(t, '^\s*(\S.*?)(?:\s{8,}|\s+\|\s+)(\S.*?)\s*$', 1) AS term, regexp_extract(t, '^\s*(\S.*?)(?:\s{8,}|\s+\|\s+)(\S.*?)\s*$', 2) AS value FROM s WHERE NOT (is_page OR is_border OR is_row OR is_section))
SELECT doc_id, page, section, min(line_no)::INTEGER AS line_no, term, value FROM (SELECT *, first_value(section) OVER w AS s1, row_number() OVER w AS r FROM x WHERE term <> '' AND regexp_matches(term, '\p{L}') AND length(term) <= 120 AND length(value) <= 200 AND coalesce(lower(section) NOT IN ('header', 'footer'), true)
  WINDOW w AS (PARTITION BY doc_id, term, value, page ORDER BY line_no)) WHERE r = 1 GROUP BY ALL""")
def document_key_values(spark, d):
    return documents.key_values(_lines(spark, d))


@query("""WITH b AS (SELECT vec_id, vec_id % 50 AS page, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), t AS (SELECT * FROM b WHERE vec_id % 2 = 0), c AS (SELECT * FROM b WHERE vec_id % 2 = 1)
SELECT vec_id FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.page = t.page AND greatest(least(t.x + 0.05, c.x + 0.2) - greatest(t.x, c.x), 0) * greatest(least(t.y + 0.05, c.y + 0.2) - greatest(t.y, c.y), 0) / (((t.x + 0.05) - t.x) * ((t.y + 0.05) - t.y)) >= 0.5)""")
def tokens_outside_tables(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("page"), F.lit(1).alias("doc_id"), F.get("embedding", F.lit(0)).cast("double").alias("x0"), F.get("embedding", F.lit(1)).cast("double").alias("y0"))
    boxed = lambda x, w: x.withColumns({"x1": F.col("x0") + w, "y1": F.col("y0") + w})
    return geometry.outside_tables(boxed(e.filter("vec_id % 2 = 0"), 0.05), boxed(e.filter("vec_id % 2 = 1"), 0.2)).select("vec_id")


@query("""WITH RECURSIVE b AS (SELECT vec_id, (vec_id % 50)::INTEGER AS page, 1::BIGINT AS doc_id, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS y0, embedding[1]::DOUBLE + 0.2 AS x1, embedding[2]::DOUBLE + 0.2 AS y1 FROM embeddings),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, vec_id) AS n FROM b),
k(page, n, kept) AS (SELECT DISTINCT page, 0::BIGINT, []::STRUCT(vec_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] FROM o UNION ALL
  SELECT k.page, o.n, CASE WHEN len(list_filter(kept, lambda q: greatest(least(q.x1, o.x1) - greatest(q.x0, o.x0), 0) * greatest(least(q.y1, o.y1) - greatest(q.y0, o.y0), 0)
    / greatest((q.x1 - q.x0) * (q.y1 - q.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(least(q.x1, o.x1) - greatest(q.x0, o.x0), 0) * greatest(least(q.y1, o.y1) - greatest(q.y0, o.y0), 0), 1e-9) >= 0.55)) > 0
    THEN kept ELSE list_append(kept, {'vec_id': o.vec_id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) END FROM k JOIN o ON o.page = k.page AND o.n = k.n + 1),
l AS (SELECT page, kept FROM k QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC) = 1)
SELECT u.q.vec_id AS vec_id, page FROM (SELECT page, unnest(kept) AS q FROM l) u""")
def greedy_nms(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).cast("int").alias("page"), F.lit(1).cast("long").alias("doc_id"), F.get("embedding", F.lit(0)).cast("double").alias("x0"), F.get("embedding", F.lit(1)).cast("double").alias("y0"))
    boxes = e.withColumns({"x1": F.col("x0") + 0.2, "y1": F.col("y0") + 0.2})
    kept = geometry.without_overlaps(boxes, [("_area", False), ("vec_id", True)], 0.55, "iou")
    return kept.select("vec_id", "page")


@query("""SELECT c_custkey, upper(substr(c_mktsegment, 1, 2)) AS revision, coalesce(lower(trim(c_mktsegment)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS truthy, regexp_matches(c_name, '^[0-9]+') AS numeric_like FROM customer""")
def small_normalisers(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.revision(F.substring("c_mktsegment", 1, 2)).alias("revision"), S.truthy(F.col("c_mktsegment")).alias("truthy"), S.is_numeric_like(F.col("c_name")).alias("numeric_like"))


from gaugeweave.plans import constructed, further, more, written  # noqa: E402, F401  register their queries here

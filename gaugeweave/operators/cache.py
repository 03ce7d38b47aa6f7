"""The test-data cache as tables: built from long sheet values in one plan, written as Parquet, read by the reports.

Sheet values are (serial, run, excel_row, column, value). A serial's samples of a column are one group of the aggregates; statistics combine
before the shuffle, and only curves bring a series' points together, which is what a curve is.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import scalars as S
from gaugeweave.operators import orderstats, trending

#: The seven tables; keys are what a row is found by.
TABLES = {
    "td_meta": "key string, value string",
    "td_sources": "serial string, sqlite_path string, mtime_ns long, size_bytes long, status string, last_ingested_epoch_ns long",
    "td_runs": "run_name string, default_x string, display_name string",
    "td_columns": "run_name string, name string, units string, kind string",
    "td_curves": "run_name string, y_name string, x_name string, serial string, x array<double>, y array<double>, n_points int, source_mtime_ns long, computed_epoch_ns long",
    "td_metrics": "serial string, run_name string, column_name string, stat string, value_num double, computed_epoch_ns long, source_mtime_ns long",
    "td_terms": "row_index int, term string, header string, table_label string, value_type string, data_group string, term_label string, units string, min_val string, max_val string, active int, normalized_stat string, computed_epoch_ns long",
}
#: Axes that curves may have, in order of preference, with the column names that stand for them.
AXES = {
    "Time": ["Time", "Time (s)", "Time(s)", "time_s", "time_sec"],
    "Pulse Number": ["Pulse Number", "Pulse #", "Pulse", "pulse_number", "pulsenumber"],
}


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def axis_of(column: Column) -> Column:
    """The axis that a column stands for, by letters and digits alone; null for others."""
    key = S.normalize_key(column)
    names = [(axis, "".join(c for c in n.lower() if c.isalnum())) for axis, ns in AXES.items() for n in ns]
    return reduce(lambda out, x: F.when(key == x[1], x[0]).otherwise(out), reversed(names), F.lit(None).cast("string"))


def columns_of(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_name, name, units, kind, column): configured y columns and axes that a run's sheets have, with the sheets' name of each. ``wanted``: (run_name or null for all, name, units, place)."""
    have = values.select(F.col("run").alias("run_name"), "column").distinct().withColumn("_k", S.normalize_key(F.col("column")))
    w = wanted.withColumn("_k", S.normalize_key(F.col("name")))
    own = have.join(w.filter("run_name is not null"), ["run_name", "_k"])
    shared = have.join(w.filter("run_name is null").drop("run_name"), "_k")
    pick = ["run_name", "name", "units", "column", "place"]
    y = own.select(*pick, F.lit(0).alias("_o")).unionByName(shared.select(*pick, F.lit(1).alias("_o")))
    y = y.groupBy("run_name", "name").agg(F.min_by(F.struct("units", "column", "place"), F.struct("_o", "place", "column")).alias("b")).select("run_name", "name", F.coalesce("b.units", F.lit("")).alias("units"), F.lit("y").alias("kind"), "b.column", "b.place")
    axes = have.withColumn("name", axis_of(F.col("column"))).filter("name is not null").groupBy("run_name", "name").agg(F.min("column").alias("column"))
    x = axes.select("run_name", "name", F.lit("").alias("units"), F.lit("x").alias("kind"), "column", F.lit(-1).alias("place"))
    return y.unionByName(x)


def metrics_of(values: DataFrame, columns: DataFrame, statistics: list[str], ignore_first: int = 0) -> DataFrame:
    """(serial, run_name, column_name, stat, value_num) of y columns: over finite samples behind the first ``ignore_first`` of each series; deviations are of the sample."""
    c = columns.filter("kind = 'y'").select(F.col("run_name").alias("run"), "column", "name")
    v = values.join(F.broadcast(c) if c.count() < 100_000 else c, ["run", "column"]).filter(trending.is_finite(F.col("value")))
    if ignore_first:
        place = F.row_number().over(Window.partitionBy("serial", "run", "name").orderBy("excel_row"))
        v = v.withColumn("_n", place).filter(F.col("_n") > ignore_first)
    known = {"mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "std": F.coalesce(F.stddev_samp("value"), F.lit(0.0)), "count": F.count("value").cast("double")}
    keys, more = ["serial", "run_name", "column_name"], {s: known[s] for s in statistics if s in known}
    v = v.select("serial", F.col("run").alias("run_name"), F.col("name").alias("column_name"), "value")
    wide = orderstats.percentiles(v, keys, "value", {"median": 0.5}, more) if "median" in statistics else v.groupBy(*keys).agg(*(c.alias(s) for s, c in more.items()))
    return wide.unpivot(keys, [s for s in statistics if s in (*more, "median")], "stat", "value_num")


def curves_of(values: DataFrame, columns: DataFrame) -> DataFrame:
    """(run_name, y_name, x_name, serial, x, y, n_points): every y column over every axis of its run, points in row order where both are finite."""
    c = columns.select(F.col("run_name").alias("run"), "column", "name", "kind")
    v = values.join(F.broadcast(c) if c.count() < 100_000 else c, ["run", "column"])
    x = v.filter("kind = 'x'").select("serial", "run", "excel_row", F.col("name").alias("x_name"), F.col("value").alias("xv"))
    y = v.filter("kind = 'y'").select("serial", "run", "excel_row", F.col("name").alias("y_name"), F.col("value").alias("yv"))
    points = y.join(x, ["serial", "run", "excel_row"])
    out = trending.curves(points, ["run", "y_name", "x_name", "serial"], "xv", "yv", "excel_row")
    return out.withColumnRenamed("run", "run_name").filter("n_points > 0")


def build(values: DataFrame, sources: DataFrame, wanted: DataFrame, definitions: DataFrame, statistics: list[str], ignore_first: int = 0, labels: DataFrame | None = None, now_ns: int = 0) -> dict[str, DataFrame]:
    """All tables of the cache. ``sources`` has (serial, sqlite_path, mtime_ns, size_bytes, error), ``labels`` (run_name, display_name) if runs are labelled."""
    spark = values.sparkSession
    cols = columns_of(values, wanted)
    mtime = sources.select("serial", F.col("mtime_ns").alias("source_mtime_ns"))
    stamp = F.lit(now_ns).cast("long").alias("computed_epoch_ns")
    rank = F.array_position(F.array(*map(F.lit, AXES)), F.col("name"))
    default = cols.filter("kind = 'x'").groupBy("run_name").agg(F.min_by("name", rank).alias("default_x"))
    runs = values.select(F.col("run").alias("run_name")).distinct().join(default, "run_name", "left")
    shown = labels if labels is not None else spark.createDataFrame([], "run_name string, display_name string")
    runs = runs.join(shown, "run_name", "left").select("run_name", "default_x", F.coalesce("display_name", "run_name").alias("display_name"))
    made = {
        "td_meta": spark.createDataFrame([("built_epoch_ns", str(now_ns)), ("statistics", ",".join(statistics)), ("statistics_ignore_first_n", str(ignore_first))], TABLES["td_meta"]),
        "td_sources": sources.select("serial", "sqlite_path", "mtime_ns", "size_bytes", F.when(F.col("error").isNull(), "ok").otherwise(F.col("error")).alias("status"), F.lit(now_ns).cast("long").alias("last_ingested_epoch_ns")),
        "td_runs": runs,
        "td_columns": cols.select("run_name", "name", "units", "kind"),
        "td_curves": curves_of(values, cols).join(mtime, "serial", "left").withColumn("computed_epoch_ns", stamp),
        "td_metrics": metrics_of(values, cols, statistics, ignore_first).join(mtime, "serial", "left").withColumn("computed_epoch_ns", stamp),
        "td_terms": definitions.select("row_index", "term", "header", "table_label", "value_type", "data_group", "term_label", "units", F.col("min").alias("min_val"), F.col("max").alias("max_val"), F.col("active").cast("int").alias("active"), F.col("stat").alias("normalized_stat"), stamp),
    }
    return {name: made[name].select(*(F.col(x.split()[0]) for x in schema.split(", "))) for name, schema in TABLES.items()}


#: Tables whose rows belong to a serial; they are kept in as many parts, so that a change rewrites only the parts of the serials that it touches.
BY_SERIAL, PARTS = ("td_sources", "td_curves", "td_metrics"), 16
MANIFEST = "version long, table string, part int, path string"


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, list[tuple[str, int | None, str]]]:
    """(version, [(table, part, path)]) of the newest version of a cache, or of a given one; (0, []) where there is none. A version has at most some 52 rows."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
        rows = rows.filter(F.col("version") == version) if version else rows.join(rows.agg(F.max("version").alias("version")), "version")
        found = [(r.version, r.table, r.part, r.path) for r in rows.collect()]
    except AnalysisException:  # no manifest yet
        found = []
    return (found[0][0], [x[1:] for x in found]) if found else (0, [])


def _part() -> Column:
    return F.pmod(F.xxhash64("serial"), F.lit(PARTS)).cast("int")


def _written(rows: DataFrame, name: str, path: str) -> list[tuple[str, int | None, str]]:
    """Writes a table of a version; which paths hold it."""
    if name not in BY_SERIAL:
        rows.write.parquet(path)
        return [(name, None, path)]
    rows.withColumn("part", _part()).repartition("part").write.partitionBy("part").parquet(path)
    schema = TABLES[name] + ", part int"
    try:
        parts = rows.sparkSession.read.schema(schema).parquet(path).select("part").distinct().collect()
    except AnalysisException:  # a table without rows
        parts = []
    return [(name, r.part, f"{path}/part={r.part}") for r in parts]


def _commit(spark: SparkSession, folder: str, version: int, paths: list[tuple[str, int | None, str]]) -> int:
    """One file, moved to its place last: readers see all of a version or nothing of it."""
    spark.createDataFrame([(version, *p) for p in paths], MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def write(tables: dict[str, DataFrame], folder: str) -> int:
    """A new version of the whole cache; its number. Earlier versions stay as they are, and stay what is read if this fails."""
    spark = next(iter(tables.values())).sparkSession
    last, _ = manifest(spark, folder)
    base = f"{folder}/v{last + 1}-{uuid.uuid4().hex}"
    paths = [p for name, rows in tables.items() for p in _written(rows, name, f"{base}/{name}")]
    return _commit(spark, folder, last + 1, paths)


def replace(tables: dict[str, DataFrame], serials_: DataFrame, folder: str) -> int:
    """A new version in which ``serials_`` (serial) have the rows of ``tables`` and all others keep theirs; its number.

    Of the tables by serial only the parts that such serials are in are written anew; the others' files are shared with the version before. The remaining tables are replaced as a whole if they are given.
    """
    spark = serials_.sparkSession
    last, paths = manifest(spark, folder)
    if not last:
        raise ValueError(f"no cache in {folder}")
    base = f"{folder}/v{last + 1}-{uuid.uuid4().hex}"
    changed = serials_.select("serial").distinct()
    touched = {r.p for r in changed.select(_part().alias("p")).distinct().collect()}  # at most PARTS
    kept = [p for p in paths if p[0] not in tables or p[0] in BY_SERIAL and p[1] not in touched]
    for name, rows in tables.items():
        if name in BY_SERIAL:
            old = [p for t, part, p in paths if t == name and part in touched]
            rows = rows.join(F.broadcast(changed) if changed.count() <= 100_000 else changed, "serial", "left_semi").select(*(x.split()[0] for x in TABLES[name].split(", ")))
            if old:
                rows = rows.unionByName(spark.read.schema(TABLES[name]).parquet(*old).join(changed, "serial", "left_anti"))
        kept += _written(rows, name, f"{base}/{name}")
    return _commit(spark, folder, last + 1, kept)


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version, or of a given one; later writes don't change what they read."""
    found, paths = manifest(spark, folder, version)
    if not found:
        raise ValueError(f"no cache in {folder}" + (f" of version {version}" if version else ""))
    of = {name: [p for t, _, p in paths if t == name] for name in TABLES}
    return {name: spark.read.schema(schema).parquet(*of[name]) if of[name] else spark.createDataFrame([], schema) for name, schema in TABLES.items()}


def prune(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes the folders that none of the last ``keep`` versions refers to (readers of older ones lose them); which they were."""
    newest, _ = manifest(spark, folder)
    used = {p for v in range(max(1, newest - keep + 1), newest + 1) for _, _, p in manifest(spark, folder, v)[1]}
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name != "manifest" and not any(f"/{name}/" in f"{p}/" for p in used):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def upgraded(rows: DataFrame, name: str) -> DataFrame:
    """A table of an older cache with the columns that it lacks, null."""
    want = [x.split(" ", 1) for x in TABLES[name].split(", ")]
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in want))


def must_rebuild(cache_mtime_ns: int | None, workbook_mtime_ns: int, tables: set[str], expected: DataFrame | None = None, sources: DataFrame | None = None) -> bool:
    """Whether a cache is missing, older than its workbook, lacks a table, or holds other serials than expected."""
    if cache_mtime_ns is None or workbook_mtime_ns > cache_mtime_ns or not set(TABLES) <= tables:
        return True
    if expected is None or sources is None:
        return False
    a, b = expected.select("serial").distinct(), sources.select("serial").distinct()
    return not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty()


# readers
def serials(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["td_sources"].filter(F.coalesce(F.trim("serial"), F.lit("")) != "").select("serial").distinct().orderBy("serial")


def runs(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["td_runs"].filter(F.coalesce(F.trim("run_name"), F.lit("")) != "").select("run_name", F.coalesce("default_x", F.lit("")).alias("default_x"), F.coalesce(F.nullif("display_name", F.lit("")), "run_name").alias("display_name")).orderBy("run_name")


def run_names(tables: dict[str, DataFrame]) -> DataFrame:
    return runs(tables).select("run_name")


def y_columns(tables: dict[str, DataFrame], run: str) -> DataFrame:
    """The y columns of a run by name, with the range that metrics span."""
    c = tables["td_columns"].filter((F.col("run_name") == run) & (F.col("kind") == "y"))
    m = tables["td_metrics"].filter((F.col("run_name") == run) & F.col("stat").isin("min", "max")).groupBy(F.col("column_name").alias("name")).agg(F.min("value_num").alias("range_min"), F.max("value_num").alias("range_max"))
    return c.join(m, "name", "left").select("name", "units", "range_min", "range_max").orderBy("name")


def x_columns(tables: dict[str, DataFrame], run: str) -> DataFrame:
    """The axes of a run, its default first, then by name."""
    c = tables["td_columns"].filter((F.col("run_name") == run) & (F.col("kind") == "x")).join(tables["td_runs"].select("run_name", "default_x"), "run_name", "left")
    return c.orderBy(F.when(F.col("name") == F.col("default_x"), 0).otherwise(1), "name").select("name")


def in_config_order(columns: DataFrame, configured: list[str]) -> DataFrame:
    """Configured columns in their order, then the others by name."""
    place = F.array_position(F.array(*map(F.lit, configured)), F.col("name")) if configured else F.lit(0)
    return columns.orderBy(F.when(place > 0, place).otherwise(1 << 30), "name")


def metric_series(tables: dict[str, DataFrame], run: str, column: str, stat: str) -> DataFrame:
    """(serial, value_num) of a statistic, whatever its case, by serial."""
    m = tables["td_metrics"]
    return m.filter((F.col("run_name") == run) & (F.col("column_name") == column) & (F.lower("stat") == stat.lower())).select("serial", "value_num").orderBy("serial")


def metric_map(tables: dict[str, DataFrame], run: str, column: str, stat: str) -> DataFrame:
    """As :func:`metric_series`, finite values alone."""
    return metric_series(tables, run, column, stat).filter(trending.is_finite(F.col("value_num")))


def curve_lookup(tables: dict[str, DataFrame], run: str, y: str, x: str, wanted: list[str] | None = None) -> DataFrame:
    """(serial, x, y) of curves, of all serials or of those wanted."""
    c = tables["td_curves"].filter((F.col("run_name") == run) & (F.col("y_name") == y) & (F.col("x_name") == x))
    return (c if wanted is None else c.filter(F.col("serial").isin(wanted))).select("serial", "x", "y").orderBy("serial")


def clean_curves(curves: DataFrame, least: int = 2) -> DataFrame:
    """Curves cut to the shorter array, without points that aren't finite numbers; those of fewer than ``least`` points go."""
    n = F.least(F.size("x"), F.size("y"))
    points = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(F.get("x", i).alias("x"), F.get("y", i).alias("y"))), lambda p: trending.is_finite(p.x) & trending.is_finite(p.y))
    rest = [c for c in curves.columns if c not in ("x", "y")]
    out = curves.filter(n > 0).select(*rest, points.alias("_p")).filter(F.size("_p") >= least)
    return out.select(*rest, F.transform("_p", lambda p: p.x).alias("x"), F.transform("_p", lambda p: p.y).alias("y"))

"""Workbook sheets and JSON files that configure trending: columns, sources, metric definitions, run labels, plots, reports.

Sheets come in the long form of :func:`~gaugeweave.sources.readers.workbooks`: (path, sheet, excel_row, excel_col, value). A header's columns are
found by name, and each function gives one row for each row of the sheet, for any number of workbooks at once.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions import scalars as S
from gaugeweave.sources.readers import merged

#: Statistics that a metric definition may name, and other names of them.
STATISTICS = ("mean", "min", "max", "std", "median", "count")
STAT_NAMES = {"avg": "mean", "average": "mean", "stdev": "std", "st.dev": "std", "st dev": "std", "stddev": "std", "standard deviation": "std"}
#: Defaults of the trend report.
REPORT = {"fit_degree": 3, "grid_points": 200, "watch": {"max_pct": 10.0, "rms_pct": 5.0, "z": 2.0}, "grade": {"pass_max": 2.0, "watch_max": 3.0}}


def sheet_rows(cells: DataFrame, sheet: str, header_row: int = 1) -> DataFrame:
    """(path, excel_row, values): rows below a sheet's header with a map from lower-case heading to trimmed text; of equal headings the last counts."""
    s = cells.filter(F.col("sheet") == sheet)
    heads = s.filter((F.col("excel_row") == header_row) & (F.trim("value") != "")).withColumn("key", F.lower(S.strip(F.col("value"))))
    heads = heads.groupBy("path", "key").agg(F.max("excel_col").alias("excel_col"))
    body = s.filter((F.col("excel_row") > header_row) & (F.trim("value") != "")).select("path", "excel_row", "excel_col", S.strip(F.col("value")).alias("value"))
    return body.join(heads, ["path", "excel_col"]).groupBy("path", "excel_row").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("values"))


def _named(*names: str) -> Column:
    """The first of several columns that is filled."""
    return F.coalesce(*(F.element_at("values", F.lit(n)) for n in names))


def config_columns(cells: DataFrame, sheet: str = "Config") -> DataFrame:
    """(path, place, name, units): the rows under the first Name/Units header, up to the first row without a name."""
    s = cells.filter((F.col("sheet") == sheet) & F.col("excel_col").isin(1, 2))
    rows = s.groupBy("path", "excel_row").agg(F.max(F.when(F.col("excel_col") == 1, S.strip(F.col("value")))).alias("name"), F.max(F.when(F.col("excel_col") == 2, S.strip(F.col("value")))).alias("units"))
    head = rows.filter((F.lower("name") == "name") & (F.lower("units") == "units")).groupBy("path").agg(F.min("excel_row").alias("_head"))
    below = rows.join(head, "path").filter((F.col("excel_row") > F.col("_head")) & (F.coalesce("name", F.lit("")) != ""))
    place = F.row_number().over(Window.partitionBy("path").orderBy("excel_row"))
    below = below.withColumn("place", place).filter(F.col("excel_row") == F.col("_head") + F.col("place"))  # a gap ends the list
    return below.select("path", "place", "name", F.coalesce("units", F.lit("")).alias("units"))


def source_rows(cells: DataFrame, sheet: str = "Sources") -> DataFrame:
    """(path, serial, workbook_table): rows with a serial number."""
    return sheet_rows(cells, sheet).select("path", _named("serial_number").alias("serial"), _named("excel_sqlite_rel").alias("workbook_table")).filter("serial is not null")


def statistic(c: Column) -> Column:
    """A statistic's canonical name."""
    low = F.lower(S.strip(F.coalesce(c, F.lit(""))))
    return reduce(lambda out, x: F.when(low == x[0], x[1]).otherwise(out), STAT_NAMES.items(), low)


def data_definitions(cells: DataFrame, sheet: str = "Data") -> DataFrame:
    """(path, row_index, data_group, header, table_label, stat, active, and the row's other texts); active if group, header and a known statistic are there. Sheets of computed metrics (first heading 'Metric') hold none."""
    old = cells.filter((F.col("sheet") == sheet) & (F.col("excel_row") == 1) & (F.col("excel_col") == 1) & (F.lower(F.trim("value")) == "metric")).select("path").distinct()
    rows = sheet_rows(cells.join(old, "path", "left_anti"), sheet)
    text = lambda *names: F.coalesce(_named(*names), F.lit(""))
    out = rows.select(
        "path", F.col("excel_row").alias("row_index"), text("data group", "data_group", "datagroup").alias("data_group"), text("header").alias("header"), text("table label", "table_label", "tablelabel").alias("table_label"),
        text("term").alias("term"), text("groupafter").alias("group_after"), text("valuetype", "value type").alias("value_type"), text("term label", "term_label", "termlabel").alias("term_label"),
        text("units").alias("units"), text("min", "range (min)", "range_min").alias("min"), text("max", "range (max)", "range_max").alias("max"),
    )
    out = out.filter((F.col("data_group") != "") | (F.col("header") != "") | (F.col("table_label") != ""))
    stat = statistic(F.col("table_label"))
    active = (F.col("data_group") != "") & (F.col("header") != "") & stat.isin(*STATISTICS)
    return out.withColumns({"active": active, "stat": F.when(active, stat).otherwise("")})


def key_value_json(cells: DataFrame, key: str = "td_run_labeling", sheet: str = "Config") -> DataFrame:
    """(path, json): the JSON object beside a key in the first column; null rows don't come."""
    s = cells.filter((F.col("sheet") == sheet) & (F.col("excel_row") > 1))
    at = s.filter((F.col("excel_col") == 1) & (F.lower(S.strip(F.col("value"))) == key.lower())).groupBy("path").agg(F.min("excel_row").alias("excel_row"))
    found = s.filter("excel_col = 2").join(at, ["path", "excel_row"]).select("path", S.strip(F.col("value")).alias("json"))
    return found.filter(F.startswith("json", F.lit("{")) & F.json_object_keys("json").isNotNull())


def master_rows(cells: DataFrame, sheet: str) -> DataFrame:
    """(path, row_no, term_label, data_group, serial, value): a master sheet in long form; 'N/A' stays text."""
    fixed = ["term label", "data group", "units", "min", "max", "term", "header"]
    rows = sheet_rows(cells, sheet)
    serials = F.filter(F.map_entries("values"), lambda e: ~e.key.isin(*fixed))
    base = rows.select("path", F.col("excel_row").alias("row_no"), F.coalesce(_named("term label"), F.lit("")).alias("term_label"), F.coalesce(_named("data group"), F.lit("")).alias("data_group"), F.explode(serials).alias("e"))
    return base.select("path", "row_no", "term_label", "data_group", F.upper("e.key").alias("serial"), F.col("e.value").alias("value"))


def terms_schema(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a terms file (CSV) with its headings; blank cells are empty texts."""
    rows = spark.read.option("header", "true").option("nullValue", "\u0000").csv(path)
    return rows.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns))


def tolerant_json(text: str | None, default: dict | list) -> dict | list:
    """Parsed JSON of the default's kind, else the default."""
    try:
        found = json.loads(text or "")
    except ValueError:
        return default
    return found if isinstance(found, type(default)) else default


def variant_readings(spark: SparkSession, path: str) -> DataFrame:
    """(page, table_no, row, col, variant_no, text) of sidecar files: one JSON object a page with its tables' cells read again."""
    cell = "struct<row:int,col:int,candidates:array<struct<variant_idx:int,text:string>>>"
    rows = spark.read.schema(f"page int, tables array<struct<table_idx:int,cells:array<{cell}>>>").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    t = rows.select("page", F.explode("tables").alias("t")).select("page", F.col("t.table_idx").alias("table_no"), F.explode("t.cells").alias("c"))
    return t.select("page", "table_no", "c.row", "c.col", F.explode("c.candidates").alias("v")).select("page", "table_no", "row", "col", F.col("v.variant_idx").alias("variant_no"), "v.text")


def report_config(*layers: dict) -> dict:
    """The report's defaults under central and project settings."""
    return merged(REPORT, *layers)


def _statistics(raw: object, default: list[str]) -> list[str]:
    if raw is None:
        return default
    if not isinstance(raw, list) or not all(isinstance(s, str) for s in raw):
        raise ValueError("statistics must be a list of texts")
    return [s.strip().lower() for s in raw if s.strip()] or default


def _whole(raw: object, default: int) -> int:
    try:
        return default if isinstance(raw, bool) else int(str(raw).strip())
    except ValueError:
        return default


def plotter(raw: object, n: int) -> dict:
    """A performance plot's definition with defaults; x and y need a column, and a single old-style statistic counts for both."""
    if not isinstance(raw, dict) or not all(isinstance(raw.get(a) or {}, dict) for a in ("x", "y", "fit")):
        raise ValueError(f"performance plot {n} must be an object with objects x, y and fit")
    axes = {a: str((raw.get(a) or {}).get("column") or "").strip() for a in ("x", "y")}
    if not all(axes.values()):
        raise ValueError(f"performance plot {n} needs x.column and y.column")
    old = next((str(raw[a]["stat"]).strip().lower() for a in ("x", "y") if (raw.get(a) or {}).get("stat")), "mean")
    fit = raw.get("fit") or {}
    return {
        "name": str(raw.get("name") or "").strip() or f"Performance Plot {n}",
        "x": {"column": axes["x"]},
        "y": {"column": axes["y"]},
        "stats": _statistics(raw.get("stats"), [old or "mean"] if raw.get("stats") is None else ["mean"]),
        "fit": {"degree": max(0, _whole(fit.get("degree") or 0, 0)), "normalize_x": bool(fit.get("normalize_x", True))},
        "require_min_points": max(2, _whole(raw.get("require_min_points") or 2, 2)),
    }


def trend_config(raw: dict) -> dict:
    """A trend configuration that has been checked: columns are required, statistics lower case, the number of ignored samples not negative, plots complete."""
    if not isinstance(raw, dict) or not isinstance(raw.get("columns"), list) or not raw["columns"]:
        raise ValueError("the configuration needs a list of columns")
    plots = raw.get("performance_plotters") or []
    if not isinstance(plots, list):
        raise ValueError("performance_plotters must be a list")
    checked = {"statistics": _statistics(raw.get("statistics") or None, list(STATISTICS)), "statistics_ignore_first_n": max(0, _whole(raw.get("statistics_ignore_first_n", 0), 0)), "performance_plotters": [plotter(p, n) for n, p in enumerate(plots, 1)]}
    return {"header_row": 0} | raw | checked


def metric_name(c: Column) -> Column:
    """struct(run, column, stat) of 'run.column.stat': the first three parts, null for fewer."""
    parts = F.split(c, r"\.")
    return F.when(F.size(parts) >= 3, F.struct(parts[0].alias("run"), parts[1].alias("column"), parts[2].alias("stat")))


def run_sheets(info: DataFrame, tables: DataFrame) -> DataFrame:
    """(path, sheet, table_name): the sheets a workbook's table of sheets names, else the tables named sheet__... of workbooks without one."""
    named = info.select("path", "sheet", "table_name")
    rest = tables.join(info.select("path").distinct(), "path", "left_anti").filter(F.startswith("table_name", F.lit("sheet__")))
    return named.unionByName(rest.select("path", F.substring("table_name", 8, 1 << 20).alias("sheet"), "table_name"))


def file_digest(files: DataFrame) -> DataFrame:
    """Files (path, content) with sha1."""
    return files.select("path", F.sha1("content").alias("sha1"))

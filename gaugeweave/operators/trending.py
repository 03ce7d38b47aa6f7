"""Curves of the test-data family: extraction, common grid, interpolation, master curve, residual grading, polynomial models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.functions.scalars import grade
from gaugeweave.operators.orderstats import matched
from gaugeweave.shared import durable


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def curves(rows: DataFrame, key: list[str], x: str, y: str, order: str) -> DataFrame:
    """One row for each key with its points as arrays in order; points need finite x and y."""
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y"))))
    out = rows.filter(is_finite(F.col(x)) & is_finite(F.col(y))).groupBy(*key).agg(points.alias("points"))
    return out.select(*key, F.transform("points", lambda p: p["x"]).alias("x"), F.transform("points", lambda p: p["y"]).alias("y"), F.size("points").alias("n_points"))


def _dealt(rows: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with _part, (key, _part, _n)): rows in ranges of (key, order), so that a key of any size is spread over all tasks; durable, since ranges are drawn by sampling."""
    sorted_ = durable(rows.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()))
    return sorted_, durable(sorted_.groupBy(*key, "_part").agg(F.count("*").alias("_n"), F.min_by(F.struct(*order), F.struct(*order)).alias("_first")))


def followed(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with _next, the struct of the order columns of the key's next row: by a window inside each range, and from the first row of the key's next range at a range's end."""
    sorted_, ranges = _dealt(rows, key, order)
    ahead = ranges.withColumn("_ahead", F.lead("_first").over(Window.partitionBy(*key).orderBy("_part"))).select(*key, "_part", "_ahead")  # a row for each range
    inner = sorted_.withColumn("_next", F.lead(F.struct(*order)).over(Window.partitionBy(*key, "_part").orderBy(*order)))
    return matched(inner, ahead, [*key, "_part"], "left").withColumn("_next", F.coalesce("_next", "_ahead")).drop("_part", "_ahead")


def curve_chunks(rows: DataFrame, key: list[str], x: str, y: str, order: str, length: int = 10_000) -> DataFrame:
    """(key, chunk_no, x, y, next_x, next_y, n_points): a curve in pieces of at most ``length`` points in order, each with the point that follows it; points need finite x and y.

    No row and no task holds a whole series: places in it are numbers in its ranges plus what stands in the ranges before.
    """
    points = rows.filter(is_finite(F.col(x)) & is_finite(F.col(y))).select(*key, F.col(order).alias("_o"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sorted_, ranges = _dealt(points, key, ["_o", "_x", "_y"])
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = matched(sorted_, ranges.withColumn("_before", before).select(*key, "_part", "_before"), [*key, "_part"], "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_o", "_x", "_y")) - 1
    pieces = placed.withColumn("_p", place).groupBy(*key, F.floor(F.col("_p") / length).cast("long").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("_p", "_x", "_y"))).alias("points"))
    pieces = durable(pieces.select(*key, "chunk_no", F.transform("points", lambda p: p["_x"]).alias("x"), F.transform("points", lambda p: p["_y"]).alias("y")))
    firsts = pieces.filter("chunk_no > 0").select(*key, (F.col("chunk_no") - 1).alias("chunk_no"), F.col("x")[0].alias("next_x"), F.col("y")[0].alias("next_y"))
    return matched(pieces, firsts, [*key, "chunk_no"], "left").withColumn("n_points", F.size("x"))


def assembled(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key, x, y, n_points) of the curves of ``chunks``, whole, for those who ask for some."""
    whole = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "x", "y"))).alias("c"))
    out = whole.select(*key, F.flatten(F.transform("c", lambda p: p["x"])).alias("x"), F.flatten(F.transform("c", lambda p: p["y"])).alias("y"))
    return out.withColumn("n_points", F.size("x"))


def common_domain(points: DataFrame, run: list[str], serial: str, x: str) -> DataFrame:
    """Per run the range of x that all series share; the whole range where they share none; runs without any extent go."""
    per = points.groupBy(*run, serial).agg(F.min(x).alias("a"), F.max(x).alias("b"))
    out = per.groupBy(*run).agg(F.max("a").alias("lo"), F.min("b").alias("hi"), F.min("a").alias("lo_all"), F.max("b").alias("hi_all"))
    shared = F.col("hi") - F.col("lo") > 1e-12
    return out.select(*run, F.when(shared, F.col("lo")).otherwise(F.col("lo_all")).alias("lo"), F.when(shared, F.col("hi")).otherwise(F.col("hi_all")).alias("hi")).filter(F.col("hi") - F.col("lo") > 1e-12)


def on_grid(points: DataFrame, domain: DataFrame, run: list[str], serial: str, x: str, y: str, n: int = 200) -> DataFrame:
    """(run, serial, grid_idx, grid_x, y): linear interpolation on a uniform grid; nothing outside a series.

    Each segment finds its grid indexes by arithmetic, so no range join is needed. Of equal x the first y counts.
    """
    first = followed(points.groupBy(*run, serial, x).agg(F.min(y).alias("y0")), [*run, serial], [x, "y0"]).withColumns({"x1": F.col("_next")[x], "y1": F.col("_next")["y0"]}).drop("_next")
    seg = first.join(domain, run)  # one row a run: broadcast at run time if it is small
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / (n - 1)
    low = F.greatest(F.ceil((F.col(x) - F.col("lo")) / step) - 1, F.lit(0))
    high = F.least(F.floor((F.coalesce("x1", F.col(x)) - F.col("lo")) / step) + 1, F.lit(n - 1))
    rows = seg.filter(low <= high).withColumn("grid_idx", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    rows = rows.withColumn("grid_x", at(F.col("grid_idx")))
    inside = (F.col("grid_x") >= F.col(x)) & F.when(F.col("x1").isNull(), F.col("grid_x") == F.col(x)).otherwise(F.col("grid_x") < F.col("x1"))
    value = F.when(F.col("x1").isNull() | (F.col("grid_x") == F.col(x)), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("grid_x") - F.col(x)) / (F.col("x1") - F.col(x)))
    return rows.filter(inside).select(*run, serial, "grid_idx", "grid_x", value.alias("y"))


def master_curve(gridded: DataFrame, run: list[str]) -> DataFrame:
    """Median, mean and population deviation over the series at each grid point."""
    return gridded.groupBy(*run, "grid_idx", "grid_x").agg(F.median("y").alias("master_y"), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("std_y"))


def residual_grading(gridded: DataFrame, run: list[str], serial: str) -> DataFrame:
    """Per series: largest and rms residual from the run's median curve, both also in percent of its largest value, z of the former against its run, grade.

    The median is a window over each grid point, so the grid is made and shuffled once.
    """
    at_point = gridded.withColumn("master_y", F.median("y").over(Window.partitionBy(*run, "grid_idx")))
    r = at_point.withColumn("res", F.col("y") - F.col("master_y"))
    per = r.groupBy(*run, serial).agg(F.max(F.abs("res")).alias("max_abs"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rms"), F.max_by("grid_x", F.struct(F.abs("res"), -F.col("grid_idx"))).alias("x_at_max"), F.max(F.abs("master_y")).alias("_s"))
    w = Window.partitionBy(*run)  # over series, no longer over their points
    largest = F.max("_s").over(w)
    per = per.withColumn("scale", F.when(largest > 0, largest).otherwise(1.0))
    std = F.stddev_pop("max_abs").over(w)
    per = per.withColumn("z", (F.col("max_abs") - F.avg("max_abs").over(w)) / F.when(std > 0, std).otherwise(1.0))
    return per.select(*run, serial, "max_abs", "rms", (F.col("max_abs") / F.col("scale") * 100).alias("max_pct"), (F.col("rms") / F.col("scale") * 100).alias("rms_pct"), "x_at_max", "z", grade(F.col("z")).alias("grade"))


def watch(graded: DataFrame, max_pct: float = 10.0, rms_pct: float = 5.0, z: float = 2.0) -> DataFrame:
    """Series that reach any threshold."""
    return graded.filter(F.coalesce(F.col("max_pct") >= max_pct, F.lit(False)) | F.coalesce(F.col("rms_pct") >= rms_pct, F.lit(False)) | F.coalesce(F.abs("z") >= z, F.lit(False)))


def performance_points(metrics: DataFrame, serial: str, run: str, column: str, stat: str, value: str, x: str, y: str, least: int = 2) -> DataFrame:
    """Points (x, y) from two columns' equal statistics; series with at least ``least`` points."""
    wide = metrics.filter(F.col(column).isin(x, y)).groupBy(serial, run, stat).agg(F.max(F.when(F.col(column) == x, F.col(value))).alias("x"), F.max(F.when(F.col(column) == y, F.col(value))).alias("y")).dropna(subset=["x", "y"])
    return wide.withColumn("_n", F.count("*").over(Window.partitionBy(serial, stat))).filter(F.col("_n") >= least).drop("_n")


def poly_fit(points: DataFrame, key: list[str], x: str, y: str, degree: int) -> DataFrame:
    """(key, coefficients highest power first, rmse, n): least squares by the normal equations of standardised x.

    The sums of powers are one aggregate, so groups of any size are fitted without bringing their points together; only the
    (degree + 1)^2 sums reach the solver. Groups of fewer than degree + 1 distinct x, whose sums are singular, are left out.
    """
    import numpy as np
    import pandas as pd

    stats = points.filter(is_finite(F.col(x)) & is_finite(F.col(y))).groupBy(*key).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    rows = points.filter(is_finite(F.col(x)) & is_finite(F.col(y))).join(stats.filter(F.col("_s") > 0), key)
    u = (F.col(x) - F.col("_m")) / F.col("_s")
    sums = [F.sum(F.pow(u, F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow(u, F.lit(k)) * F.col(y)).alias(f"q{k}") for k in range(degree + 1)]
    total = rows.groupBy(*key, "_m", "_s").agg(*sums, F.sum(F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n"))
    names = [*key, "coefficients", "rmse", "n"]

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.array([[getattr(r, f"p{i + j}") for j in range(degree + 1)] for i in range(degree + 1)])
                q = np.array([getattr(r, f"q{i}") for i in range(degree + 1)])
                if np.linalg.matrix_rank(a / max(r.n, 1), tol=1e-10) <= degree:
                    continue
                c = np.linalg.solve(a, q)
                rmse = float(np.sqrt(max(r.yy - 2 * c @ q + c @ a @ c, 0) / r.n))
                poly = np.poly1d(c[::-1])(np.poly1d([1 / r[len(key) + 1], -r[len(key)] / r[len(key) + 1]]))
                coefficients = np.zeros(degree + 1)
                coefficients[degree + 1 - len(poly.coeffs) :] = poly.coeffs
                out.append((*r[: len(key)], coefficients.tolist(), rmse, int(r.n)))
            yield pd.DataFrame(out, columns=names)

    types = dict(points.dtypes)
    return total.mapInPandas(solve, ", ".join(f"{k} {types[k]}" for k in key) + ", coefficients array<double>, rmse double, n long")


def line_fit(points: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of each key, built in."""
    return points.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def equation(coefficients: list[float]) -> str:
    """'+1.5·x^2 -0.3·x +2' of coefficients, highest power first."""
    top = len(coefficients) - 1
    return " ".join(f"{c:+.4g}" + ("" if top - i == 0 else "·x" if top - i == 1 else f"·x^{top - i}") for i, c in enumerate(coefficients))

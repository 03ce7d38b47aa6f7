"""Joins, aggregates, windows and set operations of the trending and certification families, as DataFrame functions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeweave.operators import orderstats
from gaugeweave.shared import durable, sized_join

STATS = ("mean", "min", "max", "median", "std", "count")


def summary(tests: DataFrame, term: str, measured: str, passed: str) -> DataFrame:
    """Per term: range, mean, count and passes of measured rows, and their share."""
    rows = tests.filter(F.col(measured).isNotNull())
    out = rows.groupBy(F.col(term).alias("term")).agg(F.min(measured).alias("min_value"), F.max(measured).alias("max_value"), F.avg(measured).alias("avg_value"), F.count("*").alias("total_count"), F.count_if(F.col(passed)).alias("pass_count"))
    return out.withColumn("pass_rate", F.col("pass_count") / F.col("total_count"))


def matrix(tests: DataFrame, doc: str, term: str, value: str, order: str, terms: list[str]) -> DataFrame:
    """Documents by terms, the last value by ``order`` in each cell; terms are given so that the plan is fixed."""
    return tests.groupBy(doc).pivot(term, terms).agg(F.max_by(value, order))


def certification(documents: DataFrame, tests: DataFrame, doc: str, term: str, passed: str) -> DataFrame:
    """Documents with their status: FAILED over PENDING over CERTIFIED, NO_DATA without tests; counts and sorted term lists."""
    per = tests.groupBy(doc).agg(
        F.count("*").alias("n"), F.count_if(F.col(passed)).alias("passed_count"), F.count_if(~F.col(passed)).alias("failed_count"), F.count_if(F.col(passed).isNull()).alias("pending_count"),
        F.array_sort(F.collect_list(F.when(~F.col(passed), F.col(term)))).alias("failed_terms"),
    )
    status = F.when(F.col("n").isNull(), "NO_DATA").when(F.col("failed_count") > 0, "FAILED").when(F.col("pending_count") > 0, "PENDING").otherwise("CERTIFIED")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("passed_count", "failed_count", "pending_count")}
    return documents.join(per, doc, "left").select(*documents.columns, status.alias("status"), *zero.values(), F.coalesce("failed_terms", F.array().cast("array<string>")).alias("failed_terms"))


def exceedance(rows: DataFrame, key: list[str], value: str, low: Column, high: Column, serial: str) -> DataFrame:
    """Per key: count, mean, population deviation, range, values outside limits, and the serials that have any."""
    below, above = F.col(value) < low, F.col(value) > high
    return rows.groupBy(*key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count_if(below).alias("n_below"), F.count_if(above).alias("n_above"), F.array_sort(F.collect_set(F.when(below | above, F.col(serial)))).alias("offenders"),
    )


def metrics_wide(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Six statistics of each key; the deviation is that of a sample."""
    more = {"mean": F.avg(value), "min": F.min(value), "max": F.max(value), "std": F.stddev_samp(value), "count": F.count(value).cast("double")}
    return orderstats.percentiles(rows, key, value, {"median": 0.5}, more).select(*key, *STATS)


def metrics_long(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """As :func:`metrics_wide`, one row for each statistic, nulls kept."""
    return metrics_wide(rows, key, value).unpivot(key, list(STATS), "stat", "value_num")


def skip_first(rows: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """Without each key's first n rows."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > n).drop("_n")


def most_common(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each key's most frequent non-blank value; ties go to the smaller text."""
    counts = rows.filter(F.trim(value) != "").groupBy(*key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def majority_vote(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Each key's most frequent non-blank value; ties go to the one seen first."""
    counts = rows.filter(F.trim(value) != "").groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.groupBy(*key).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first_seen"))).alias(value), F.max("n").alias("n"))


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Each key's last row by ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_spelling(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values whatever their case, in the spelling seen first."""
    return rows.filter(F.trim(value) != "").groupBy(F.lower(value).alias("key")).agg(F.min_by(value, order).alias(value)).drop("key")


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def instance_labels(rows: DataFrame, key: list[str], label: str, order: list[str], name: str = "instance_label") -> DataFrame:
    """'Label', 'Label (2)', … in order."""
    n = F.row_number().over(Window.partitionBy(*key, label).orderBy(*order))
    return rows.withColumn(name, F.when(n > 1, F.concat(F.col(label), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(label)))


def forward_fill(rows: DataFrame, key: list[str], order: list[str], marker: Column, name: str) -> DataFrame:
    """The last marker seen up to each row."""
    return rows.withColumn(name, F.last(marker, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def neighbours(rows: DataFrame, key: list[str], order: str, value: Column) -> DataFrame:
    """The nearest values before and after each row."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumns({"above": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "below": F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})


def integer_runs(rows: DataFrame, key: list[str], order: str, value: str, least: int = 5) -> DataFrame:
    """Runs n, n+1, … of at least ``least`` consecutive rows: key, first and last value, length."""
    island = F.col(value) - F.row_number().over(Window.partitionBy(*key).orderBy(order))
    runs = rows.withColumn("_i", island).groupBy(*key, "_i").agg(F.min(value).alias("first_value"), F.max(value).alias("last_value"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).drop("_i")


def gap_sessions(rows: DataFrame, key: list[str], order: str, gap: Column, name: str = "session") -> DataFrame:
    """A number for each run of rows whose step to the row before stays within ``gap``."""
    w = Window.partitionBy(*key).orderBy(order)
    step = F.col(order) - F.lag(order).over(w)
    return rows.withColumn("_new", F.when(step > gap, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def z_scores(rows: DataFrame, key: list[str], value: str, name: str = "z") -> DataFrame:
    """(value - mean) / population deviation over the key's rows; a deviation of 0 counts as 1."""
    w = Window.partitionBy(*key)
    std = F.stddev_pop(value).over(w)
    return rows.withColumn(name, (F.col(value) - F.avg(value).over(w)) / F.when(std > 0, std).otherwise(1.0))


def any_rule(rules: dict[str, list[str]]) -> Column:
    """True if any field's normalised value is among its allowed ones."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.trim(F.col(f))).isin([v.lower() for v in vs]), F.lit(False)) for f, vs in rules.items()], F.lit(False))


def free_text(columns: list[str], needle: str) -> Column:
    return F.instr(F.lower(F.concat_ws(" ", *columns)), needle.lower()) > 0


def fill_cells(existing: Column, new: Column, overwrite: bool) -> Column:
    """Workbook cell policy: new values go where cells are empty, or everywhere if told so."""
    return F.coalesce(new, existing) if overwrite else F.coalesce(existing, new)


def merge_instances(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows of two sources aligned by key; blanks of the first are filled from the second."""
    right = b.select(*key, *[F.col(f).alias(f"_{f}") for f in fields])
    return a.join(right, key, "full_outer").select(*key, *[F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}")).alias(f) for f in fields])


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace those with their key."""
    return table.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def range_autofill(config: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Config rows with blank units and limits filled from what was observed (key, units, range_min, range_max)."""
    seen = observed.select(key, *[F.col(c).alias(f"_{c}") for c in ("units", "range_min", "range_max")])
    return config.join(seen, key, "left").select(key, F.coalesce(F.nullif(F.col("units"), F.lit("")), "_units").alias("units"), F.coalesce("range_min", "_range_min").alias("range_min"), F.coalesce("range_max", "_range_max").alias("range_max"))


def spatial_join(tokens: DataFrame, cells: DataFrame, page: list[str], band: float, least: float = 0.5) -> DataFrame:
    """Tokens with the cells of their page that hold at least ``least`` of their area: an equi-join on page and horizontal band, then the boxes.

    A token is looked for in the bands that it touches, so a pair may meet in several; it counts in the first band they share.
    """
    from gaugeweave.functions.scalars import overlap_share

    def banded(df: DataFrame, p: str) -> DataFrame:
        bands = F.sequence(F.floor(F.col(f"{p}y0") / band), F.floor(F.col(f"{p}y1") / band))
        return df.withColumn(f"{p}first", F.floor(F.col(f"{p}y0") / band)).withColumn("_band", F.explode(bands))

    joined = banded(tokens, "t_").join(banded(cells, "c_"), [*page, "_band"]).filter(F.col("_band") == F.greatest("t_first", "c_first"))
    box = lambda p: tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1"))
    return joined.withColumn("overlap", overlap_share(box("t_"), box("c_"))).filter(F.col("overlap") >= least).drop("_band", "t_first", "c_first")


#: Tokens and cells of a page and band that meet in one group at most, about.
MEET = 4096


def best_cells(tokens: DataFrame, cells: DataFrame, page: list[str], band: float, token: str, cell: str, least: float = 0.5, meet: int = MEET) -> DataFrame:
    """(token, cell, overlap): :func:`best_cell` of :func:`spatial_join`, without the cell of a token's own number. ``least`` is above 0, numbers are whole.

    No pair is kept: tokens and cells of a page and band are dealt into pairs of blocks of about ``meet`` rows, so that a group is of bounded size on pages of any
    size; each group tells a token's best cell, and the best of these is the token's.
    """
    keys = [*page, "_band"]

    def banded(df: DataFrame, p: str, name: str) -> DataFrame:
        x0, y0, x1, y1 = box = [f"{p}{c}" for c in ("x0", "y0", "x1", "y1")]
        whole = df.select(*(F.col(c).alias(c) for c in page), F.col(name).cast("long").alias("_id"), *(F.col(c).cast("double").alias(c) for c in box))
        for c in ("_id", *box):
            whole = whole.filter(F.col(c).isNotNull())  # dropna would drop NaN as well
        return whole.withColumn("_band", F.explode(F.sequence(F.floor(F.col(y0) / band), F.floor(F.col(y1) / band))))

    def best(t: pa.Table, c: pa.Table) -> pa.Table:
        c = c.sort_by("_id")
        ids, own = (x["_id"].to_numpy() for x in (t, c))
        tb, cb = (np.stack([x[f"{p}{k}"].to_numpy() for k in ("x0", "y0", "x1", "y1")]) for x, p in ((t, "t_"), (c, "c_")))
        area = ((tb[2] - tb[0]) * (tb[3] - tb[1]))[:, None]
        more = lambda x: (x > 0) | np.isnan(x)  # noqa: E731  NaN is the largest number, as it is for Spark and SQL
        at, share = np.zeros(len(ids), np.int64), np.full(len(ids), -1.0)
        with np.errstate(all="ignore"):
            for i in range(0, len(ids) if len(own) else 0, 64):
                b = tb[:, i : i + 64, None]
                w, h = np.fmin(b[2], cb[2]) - np.maximum(b[0], cb[0]), np.fmin(b[3], cb[3]) - np.maximum(b[1], cb[1])
                s = w * h / area[i : i + 64]
                s[np.isnan(s)] = np.inf
                s[~(more(w) & more(h) & more(area[i : i + 64])) | (ids[i : i + 64, None] == own)] = -1
                k = s.argmax(axis=1)  # the first of equals, so the smallest number
                at[i : i + 64], share[i : i + 64] = k, s[np.arange(len(k)), k]
        hit = np.flatnonzero(share >= least)
        return pa.table({"_id": ids[hit], "_cell": own[at[hit]], "_share": share[hit]})

    a, b = banded(tokens, "t_", token), banded(cells, "c_", cell)
    counts = a.groupBy(*keys).count().unionByName(b.groupBy(*keys).count()).groupBy(*keys).agg(F.max("count").alias("_n")).filter(F.col("_n") > meet)
    sizes = durable(counts.select(*keys, F.ceil(F.col("_n") / meet).cast("int").alias("_blocks")))
    one = F.coalesce("_blocks", F.lit(1))
    mine, every = F.pmod(F.xxhash64("_id"), one).cast("int"), F.explode(F.sequence(F.lit(0), one - 1))
    a = sized_join(a, sizes, keys, "left").withColumn("_i", mine).withColumn("_j", every).drop("_blocks")
    b = sized_join(b, sizes, keys, "left").withColumn("_j", mine).withColumn("_i", every).drop("_blocks")
    n, group = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "_i", "_j"]
    found = a.repartition(n, *group).groupBy(*group).cogroup(b.repartition(n, *group).groupBy(*group)).applyInArrow(best, "_id long, _cell long, _share double")
    top = found.groupBy("_id").agg(F.max(F.struct("_share", (-F.col("_cell")).alias("_less"))).alias("_top"))
    share = F.when(F.col("_top._share") == float("inf"), float("nan")).otherwise(F.col("_top._share"))
    return top.select(F.col("_id").alias(token), (-F.col("_top._less")).alias(cell), share.alias("overlap"))


def best_cell(assigned: DataFrame, token: list[str], cell: str) -> DataFrame:
    """The cell of the largest overlap for each token; the first cell on ties."""
    w = Window.partitionBy(*token).orderBy(F.desc("overlap"), cell)
    return assigned.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

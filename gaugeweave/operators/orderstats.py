"""Medians and percentiles of keys of any size: several shares at once, interpolated, without a key's values in one place.

A sketch of bounded size, made in the same aggregate as the other statistics, tells for each share a narrow range that holds the two places that the share lies between (its error is at most n /
accuracy places). Values below a range are counted, those inside are counted by value, and running sums over these find the places. Keys of few values have no range to be narrowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def matched(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join on keys that may be null, as groups may."""
    named = right.select(*(F.col(k).alias(f"_r_{k}") for k in key), *(c for c in right.columns if c not in key))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key))
    return left.join(named, on, how).drop(*(f"_r_{k}" for k in key))


def percentiles(rows: DataFrame, key: list[str], value: str, shares: dict[str, float], more: dict[str, Column] | None = None, accuracy: int = 1000) -> DataFrame:
    """(key, a column for each of ``more``, which are aggregates, and for each share): the value at place (n - 1) * share in order, from 0, between two places in proportion.

    Nulls don't count; a key without values has nulls. Numbers that aren't numbers come last.
    """
    v = rows.withColumn("_v", F.col(value).cast("double"))
    near = [min(1.0, max(0.0, s + d)) for s in shares.values() for d in (-2 / accuracy, 2 / accuracy)]
    taken = [*key, *(more or {})]
    if {"_n", "_b", "_low", "_high", "_v"} & set(taken):
        raise ValueError("columns named _n, _b, _low, _high or _v are taken")
    stats = v.groupBy(*key).agg(*(c.alias(name) for name, c in (more or {}).items()), F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.percentile_approx("_v", near, accuracy).alias("_b"))
    small = F.col("_n") <= 4 * accuracy
    lo = lambda i: F.when(small | F.lit(near[2 * i] <= 0), F.col("_low")).otherwise(F.get("_b", F.lit(2 * i)))
    hi = lambda i: F.when(small | F.lit(near[2 * i + 1] >= 1), F.col("_high")).otherwise(F.get("_b", F.lit(2 * i + 1)))
    picks = F.array(*(F.struct(F.lit(i).alias("which"), lo(i).alias("lo"), hi(i).alias("hi"), ((F.col("_n") - 1) * F.lit(float(s))).alias("place")) for i, s in enumerate(shares.values())))
    wanted = stats.filter("_n > 0").select(*key, F.explode(picks).alias("_p")).select(*key, "_p.*")
    met = matched(v.filter("_v is not null").groupBy(*key, "_v").agg(F.count("*").alias("_c")), wanted, key, "inner").filter(F.col("_v") <= F.col("hi"))
    few = met.withColumn("_in", F.when(F.col("_v") >= F.col("lo"), F.col("_v"))).groupBy(*key, "which", "place", "_in").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*key, "which").orderBy(F.col("_in").asc_nulls_first()))
    counted = few.withColumn("_upto", upto).filter("_in is not null")
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_in")))
    low, high = F.floor("place"), F.ceil("place")
    found = counted.groupBy(*key, "which", "place").agg(at(low).alias("a"), at(high).alias("b"))
    between = F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b"))
    wide = found.withColumn("x", between).groupBy(*key).agg(*(F.max(F.when(F.col("which") == i, F.col("x"))).alias(name) for i, name in enumerate(shares)))
    return matched(stats, wide, key, "left").select(*taken, *shares)

"""Percentiles by selection against sorting; versions of the cache, failed writes among them."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gaugeweave.operators import cache as C
from gaugeweave.operators import orderstats
from gaugeweave.operators import relational as R


def between(values, share):
    s = sorted(values)
    place = (len(s) - 1) * share
    lo = int(place)
    hi = lo + (place > lo)
    return s[lo] if s[lo] == s[hi] else (hi - place) * s[lo] + (place - lo) * s[hi]


@pytest.mark.parametrize("accuracy", [2, 20, 100, 1000])
def test_percentiles_equal_sorting(spark, accuracy):
    r = random.Random(accuracy)
    rows = [(k, float(r.choice([r.randint(0, 5), r.random() * 1000, -r.expovariate(1)]))) for k in range(8) for _ in range((1, 2, 3, 7, 50, 999, 4001, 6000)[k])]
    rows += [(None, 4.0), (None, 6.0), (9, None), (8, 1.0), (8, None)] + [(10, float(i // 1000)) for i in range(5000)]
    shares = {"low": 0.0, "tenth": 0.1, "quarter": 0.25, "mid": 0.5, "most": 0.97, "high": 1.0}
    got = orderstats.percentiles(spark.createDataFrame(rows, "k int, v double").repartition(3), ["k"], "v", shares, {"n": F.count("v"), "all": F.count("*")}, accuracy).collect()
    assert len(got) == 12
    for x in got:
        mine = [v for k, v in rows if k == x.k and v is not None]
        assert x.n == len(mine) and x["all"] == sum(k == x.k for k, _ in rows)
        for name, s in shares.items():
            assert x[name] == (between(mine, s) if mine else None), (x.k, name)


def test_metrics_have_no_buffer_of_a_key(spark):
    rows = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 3 < 2, (F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    wide = R.metrics_wide(rows, ["k"], "v")
    plan = wide._jdf.queryExecution().toString()
    assert " median(" not in plan and " percentile(" not in plan and "collect_list" not in plan
    got = {r.k: r for r in wide.collect()}
    mine = [float(i * 7919 % 1000) for i in range(10_000) if i % 3 == 1]
    assert got[1].median == statistics.median(mine) and got[1]["count"] == len(mine) and got[2].median is None and got[2]["count"] == 0
    with pytest.raises(ValueError, match="taken"):
        orderstats.percentiles(rows.withColumnRenamed("k", "_n"), ["_n"], "v", {"m": 0.5})


def made(spark, serials, value):
    e = C.empty(spark)
    rows = [(s, "run", "thrust", "max", value, 1, 1) for s in serials]
    return e | {"td_metrics": spark.createDataFrame(rows, C.TABLES["td_metrics"]), "td_sources": spark.createDataFrame([(s, "p", 1, 1, "ok", 1) for s in serials], C.TABLES["td_sources"]), "td_meta": spark.createDataFrame([("k", str(value))], C.TABLES["td_meta"])}


def metrics(spark, folder, version=None):
    return {r.serial: r.value_num for r in C.read(spark, folder, version)["td_metrics"].collect()}


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    with pytest.raises(ValueError, match="no cache"):
        C.read(spark, folder)
    with pytest.raises(ValueError, match="no cache"):
        C.replace({}, spark.createDataFrame([("a",)], "serial string"), folder)
    serials = [f"SN{i}" for i in range(40)]
    assert C.write(made(spark, serials, 1.0), folder) == 1
    before = C.read(spark, folder)["td_metrics"]
    paths = set(C.manifest(spark, folder)[1])
    changed = spark.createDataFrame([("SN3",), ("SN4",), ("new",)], "serial string")
    fresh = made(spark, ["SN3", "new", "SN9"], 2.0)  # SN9 isn't among the changed ones
    assert C.replace({n: fresh[n] for n in ("td_metrics", "td_sources")}, changed, folder) == 2
    assert metrics(spark, folder) == {s: 1.0 for s in serials if s not in ("SN3", "SN4")} | {"SN3": 2.0, "new": 2.0}
    now = set(C.manifest(spark, folder)[1])
    assert len(now & paths) > len(paths) / 2 and now != paths  # untouched parts are shared
    assert {r.serial: r.value_num for r in before.collect()} == metrics(spark, folder, 1) == dict.fromkeys(serials, 1.0)
    assert C.write(made(spark, [], 3.0), folder) == 3
    assert metrics(spark, folder) == {} and C.read(spark, folder)["td_meta"].first().value == "3.0" and len(metrics(spark, folder, 2)) == 40


@pytest.mark.parametrize("at", ["td_meta", "td_columns", "td_metrics", "td_terms"])
def test_a_failed_write_leaves_the_version_before(spark, tmp_path, at):
    folder = f"file://{tmp_path}/c"
    C.write(made(spark, ["a", "b"], 1.0), folder)
    fresh = made(spark, ["a"], 2.0)
    c = fresh[at].columns[0]
    broken = spark.range(1).select(*(F.raise_error(F.lit("disk full")).cast(t).alias(n) if n == c else F.lit(None).cast(t).alias(n) for n, t in fresh[at].dtypes))
    with pytest.raises(Exception, match="disk full"):
        C.write(fresh | {at: broken}, folder)
    if at in C.BY_SERIAL:
        with pytest.raises(Exception, match="disk full"):
            C.replace({at: broken.withColumn("serial", F.lit("a"))} if c != "serial" else {at: broken}, spark.createDataFrame([("a",)], "serial string"), folder)
    assert metrics(spark, folder) == {"a": 1.0, "b": 1.0} and C.read(spark, folder)["td_meta"].first().value == "1.0"
    assert C.write(fresh, folder) == 2 and metrics(spark, folder) == {"a": 2.0}

import pytest
from pyspark.sql import functions as F

from gaugeweave.functions import scalars as S
from gaugeweave.operators import trending


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "want"),
    [("5 - 10", ("range", 5, 10)), ("<= 7,5", ("max", None, 7.5)), ("3 <", ("max", None, 3)), (">= 2", ("min", 2, None)), ("4 >", ("min", 4, None)), ("12", ("max", None, 12)), ("see note", ("unknown", None, None)), ("", ("unknown", None, None))],
)
def test_requirement(spark, raw, want):
    assert tuple(value(spark, S.requirement(F.lit(raw)))) == want


def test_lone_number_is_a_minimum_in_workbooks(spark):
    assert tuple(value(spark, S.requirement_range(F.lit("12")))) == (12, None)


def test_passes(spark):
    req = S.requirement(F.lit("nothing"))
    assert value(spark, S.passes(req, F.lit(1.0))) is True
    assert value(spark, S.passes(req, F.lit(None).cast("double"))) is None
    assert value(spark, S.passes(S.requirement(F.lit("<= 3")), F.lit(3.5))) is False


@pytest.mark.parametrize(("raw", "want"), [("1,200", 1200), ("nan", None), ("inf", None), ("1d", None), ("12 kohm", None), (".5", 0.5), (" 5 ", 5), ("", None), (None, None), ("1e3", 1000)])
def test_finite_number(spark, raw, want):
    assert value(spark, S.finite_number(F.lit(raw).cast("string"))) == want


def test_strict_number_needs_a_leading_digit(spark):
    assert value(spark, S.strict_number(F.lit(".5"))) is None


@pytest.mark.parametrize(("raw", "want"), [("2024-1-5", "2024-01-05"), ("1/5/2024", "2024-01-05"), ("13.40.2024", "2024-13-40"), ("1999-1-1", None), ("x", None)])
def test_iso_date(spark, raw, want):
    assert value(spark, S.iso_date(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("SN7", "SN0007"), ("s/n 00012", "SN0012"), ("unit SN 123456", "SN123456"), ("none", None)])
def test_serial_number(spark, raw, want):
    assert value(spark, S.serial_number(F.lit(raw))) == want


@pytest.mark.parametrize(("n", "want"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")])
def test_excel_column(spark, n, want):
    assert value(spark, S.excel_column(F.lit(n))) == want


def test_healing(spark):
    assert value(spark, S.heal_number(F.lit("1O.5"))) == "10.5"
    assert value(spark, S.heal_number(F.lit("1,234"))) == "1234"
    assert value(spark, S.heal_number(F.lit("Oil"))) == "Oil"
    assert value(spark, S.heal_spacing(F.lit("1 to4"))) == "1 to 4"
    assert value(spark, S.heal_spacing(F.lit("12psi"))) == "12 psi"
    assert value(spark, S.strip_cell_border(F.lit("| _text"))) == "text"


def test_ranges_and_instances(spark):
    assert value(spark, S.is_range_like(F.lit("20-30"))) and not value(spark, S.is_range_like(F.lit("-40")))
    assert tuple(value(spark, S.split_instance(F.lit("Torque (2)")))) == ("Torque", 2)
    assert tuple(value(spark, S.measured_value(F.lit("[5.5 (ok)]")))) == (5.5, "ok")


def test_poly_fit_is_exact_on_a_parabola(spark):
    rows = [("a", float(x), 2.0 * x * x - 3 * x + 1) for x in range(10)] + [("b", 1.0, 1.0), ("b", 1.0, 2.0)]
    got = trending.poly_fit(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 2).collect()
    assert [r.k for r in got] == ["a"]
    assert got[0].coefficients == pytest.approx([2, -3, 1]) and got[0].rmse == pytest.approx(0, abs=1e-6)
    assert trending.equation([2, -3, 1]) == "+2·x^2 -3·x +1"


def test_master_curve_of_two_series(spark):
    rows = [("R", s, float(x), float(x * m)) for s, m in (("SN1", 1), ("SN2", 2)) for x in range(4)]
    p = spark.createDataFrame(rows, "run string, serial string, x double, y double")
    g = trending.on_grid(p, trending.common_domain(p, ["run"], "serial", "x"), ["run"], "serial", "x", "y", 4)
    m = {r.grid_idx: r.master_y for r in trending.master_curve(g, ["run"]).collect()}
    assert m == pytest.approx({0: 0, 1: 1.5, 2: 3, 3: 4.5})

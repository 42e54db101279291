import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prodlake.functions import expr


def evaluate(spark, values, kind, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in frame.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def python_humanize(v, suffix="", dp=1):
    if v is None or math.isnan(v):
        return "—"
    for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        if abs(v) >= size:
            return f"{v / size:.{dp}f}{unit}{suffix}"
    return f"{v:.{dp}f}{suffix}"


def test_parsing_never_throws(spark):
    frame = spark.createDataFrame(
        [("12.5", "2020-01-01"), ("abc", "2020-13-45"), ("1,234", "2020-1-1"), (None, None)],
        "n string, d string",
    )
    got = frame.select(
        expr.number_or_null("n"), expr.grouped_number_or_null("n"),
        expr.date_or_null("d").cast("string"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (12.5, 12.5, "2020-01-01"), (None, None, None), (None, 1234.0, None), (None, None, None),
    ]


def test_normalize_key_keeps_blank(spark):
    frame = spark.createDataFrame([(" hess ",), ("HESS",), (" ",), (None,)], "k string")
    assert [r[0] for r in frame.select(expr.normalize_key("k")).collect()] == ["HESS", "HESS", "", None]


def test_categories(spark):
    ratios = [4.999, 5.0, 15.0, 15.001, None]
    assert evaluate(spark, ratios, "double", expr.flaring_category) == [
        "Low", "Medium", "Medium", "High", "High",
    ]
    assert evaluate(spark, [0.3, 0.3001, None], "double", expr.basin_category) == [
        "Dry Gas", "Liquid-Rich", "Dry Gas",
    ]
    tier = lambda v: expr.percentile_tier(v, F.lit(3.0), F.lit(7.0))
    assert evaluate(spark, [3.0, 3.5, 7.0, None], "double", tier) == ["Low", "Medium", "High", "Medium"]


def test_ratio_and_growth_need_a_positive_base(spark):
    frame = spark.createDataFrame([(5.0, 0.0), (5.0, None), (5.0, -1.0), (6.0, 4.0)], "a double, b double")
    got = frame.select(
        expr.safe_ratio(F.col("a"), F.col("b")), expr.growth_pct(F.col("a"), F.col("b"))
    ).collect()
    assert [tuple(r) for r in got] == [(None, None)] * 3 + [(1.5, 50.0)]


@pytest.mark.parametrize(
    "name", ["PETRO-HUNT LLC", "o'neil 3d oil", "A.B.c", "", "kodiak oil & gas", "2nd WELL_one"]
)
def test_title_case(spark, name):
    assert evaluate(spark, [name], "string", expr.title_case) == [name.title()]


def test_labels(spark):
    frame = spark.createDataFrame(
        [("A very long well name indeed", "33-053-10000"), (None, "33-053-10000"), ("", "x")],
        "name string, id string",
    )
    got = frame.select(expr.short_name(F.col("name"), F.col("id")), expr.id_tail(F.col("id"))).collect()
    assert [tuple(r) for r in got] == [
        ("A very long well nam", "-10000"), ("33-053-10000", "-10000"), ("x", "x"),
    ]
    assert evaluate(spark, ["Bakken Shale, US"], "string", expr.without_country) == ["Bakken Shale"]


def test_quarters(spark):
    frame = spark.sql("SELECT explode(sequence(DATE'2018-01-01', DATE'2018-12-01', INTERVAL 1 MONTH)) AS d")
    got = [r[0] for r in frame.orderBy("d").select(expr.period_label("d")).collect()]
    assert got == [f"2018Q{q}" for q in (1, 2, 3, 4) for _ in range(3)]


TIES = [0.25, 0.35, 1.15, 1250000.0, 1150000.0, 999.95, 999999.0, 0.05, -0.25, 2.5e9, 1e3, 0.0, None]


LARGE = [2.0**52, 2.0**53, 2.0**53 + 2, 1e15, 1e15 + 0.5, 123456789012345.67, 1e18, 2.0**70 + 2.0**20, 1e22, 1.1e25, 1e30, 2.0**99, 9.9e37, 4503599627370495.5]


def test_large_values_print_every_digit(spark):
    for places in (0, 1, 2, 4):
        got = evaluate(spark, LARGE, "double", lambda v: expr.fixed_point(v, places))
        assert got == [f"{v:.{places}f}" for v in LARGE]
        got = evaluate(spark, [-v for v in LARGE], "double", lambda v: expr.fixed_point(v, places))
        assert got == [f"{-v:.{places}f}" for v in LARGE]
    got = evaluate(spark, [3e28, float("inf"), float("-inf")], "double", expr.humanize)
    assert got == ["30000000000000000000.0B", "infB", "-infB"]


def test_humanize_ties(spark):
    got = evaluate(spark, TIES, "double", lambda v: expr.humanize(v, " BBL"))
    assert got == [python_humanize(v, " BBL") for v in TIES]


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.floats(-1e12, 1e12), st.integers(-40_000_000, 40_000_000).map(lambda n: n / 20)
        ),
        min_size=30, max_size=80,
    ),
    st.integers(0, 3),
)
def test_humanize_agrees_with_exact_rounding(spark, values, places):
    got = evaluate(spark, values, "double", lambda v: expr.humanize(v, "", places))
    want = [python_humanize(v, "", places) for v in values]
    # a negative zero keeps no sign here
    assert [g for g, v in zip(got, values) if v] == [w for w, v in zip(want, values) if v]

"""Growth and fits by the calendar, for series that skip months."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import fact, month, production, rows
from prodlake.functions import fit
from prodlake.harness import bindings as bind
from prodlake.operators import forecast, kpi


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def growth(spark, facts, mode):
    return rows(kpi.basin_production_trends(production(spark, facts), mode), "production_month", "prev_month_production", "mom_growth_pct", "yoy_growth_pct")


def test_a_missing_month_has_no_growth_by_calendar(spark):
    facts = [fact(t=0, value=10), fact(t=1, value=20), fact(t=3, value=30), fact(t=12, value=40), fact(t=15, value=60)]
    assert growth(spark, facts, "calendar") == [
        (month(0), None, None, None), (month(1), 10.0, 100.0, None), (month(3), None, None, None),
        (month(12), None, None, 300.0), (month(15), None, None, 100.0),
    ]
    by_row = growth(spark, facts, "row")
    assert by_row[2] == (month(3), 20.0, 50.0, None) and by_row[3][1:3] == (30.0, pytest.approx(100 / 3))


def test_without_gaps_both_modes_agree(spark):
    facts = [fact(f"w{w}", t, g, 3 * w + t % 5 + 1, play=f"P{w % 2}") for w in range(4) for t in range(30) for g in "OG"]
    assert growth(spark, facts, "calendar") == growth(spark, facts, "row")


def test_days_inside_a_month_and_null_months(spark):
    monthly = spark.createDataFrame(
        [("P", "O", "2020-01-05", 1.0), ("P", "O", "2020-01-20", 2.0), ("P", "O", "2020-02-11", 6.0), ("P", "O", None, 9.0), ("P", "O", None, 9.0), ("P", "G", "2020-02-01", 5.0)],
        "shale_play string, oil_and_gas_group string, day string, total_production double",
    ).withColumn("production_month", F.col("day").cast("date"))
    got = kpi.with_month_growth(monthly, "calendar").select("day", "prev_month_production", "mom_growth_pct").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [("2020-01-05", None, None), ("2020-01-20", None, None), ("2020-02-11", 3.0, 100.0), (None, None, None), (None, None, None), ("2020-02-01", None, None)], key=repr
    )
    with pytest.raises(ValueError):
        kpi.with_month_growth(monthly, "lunar")


def test_both_distances_share_one_sort(spark):
    monthly = kpi.basin_monthly(production(spark, [fact(t=t) for t in range(20)]))
    for mode in kpi.MODES:
        plan = plan_of(kpi.with_growth(monthly, mode))
        assert plan.count("Sort [") == 1 and "Join" not in plan


def decline(t, qi=900.0, di=0.05):
    return qi * np.exp(-di * np.asarray(t, float))


def test_the_fit_sees_the_gaps():
    times = [0, 1, 2, 5, 6, 9, 14, 15, 16, 17, 25, 26]
    by_calendar = fit.fit_batch([decline(times)], [times]).iloc[0]
    assert by_calendar.di == pytest.approx(0.05, rel=1e-6) and by_calendar.r2 == pytest.approx(1)
    assert fit.fit_batch([decline(times)]).iloc[0].di > 0.06


def test_without_gaps_both_fits_agree():
    draw = np.random.default_rng(3)
    series = [decline(range(n)) * draw.normal(1, 0.1, n) for n in draw.integers(6, 90, 40)] + [np.zeros(9), np.array([1.0, np.nan, 2.0])]
    one, other = fit.fit_batch(series), fit.fit_batch(series, [range(len(s)) for s in series])
    assert one.equals(other)


def test_very_long_axes_are_cut_into_small_chunks(monkeypatch):
    monkeypatch.setattr(fit, "_CELLS", 5000)
    times = [[0, 1, 2, 3, 4, 5, 1200], list(range(8)), [0, 2, 4, 6, 8, 10, 12]]
    got = fit.fit_batch([decline(t, di=0.02) for t in times], times)
    assert got.di.tolist() == pytest.approx([0.02] * 3, rel=1e-5)


def panel(spark, facts):
    return forecast.entity_panel(production(spark, facts))


def gappy(skip=(3, 4, 9, 17)):
    return [fact("w1", t, "O", float(decline(t))) for t in range(24) if t not in skip] + [fact("w1", t, "G", float(decline(t, 500, 0.02))) for t in range(24) if t not in skip]


def test_series_by_calendar(spark):
    got = forecast.entity_series(panel(spark, gappy()), calendar=True).filter("entity_type = 'well'").first()
    assert got.series_t == [t for t in range(24) if t not in (3, 4, 9, 17)]
    assert (got.months, got.last_t, got.last_month) == (20, 23, month(23))
    assert forecast.entity_series(panel(spark, gappy()[:5]), calendar=True).count() == 0


def test_rows_of_one_month_are_added_up(spark):
    facts = gappy(()) + [fact("w1", 2, "O", 7.0, operator="other")]
    series = forecast.entity_series(panel(spark, facts), calendar=True).filter("entity_type = 'well'").first()
    assert series.months == 24 and series.oil[2] == pytest.approx(float(decline(2)) + 7)


def test_forecast_by_calendar(spark):
    table = forecast.forecast_table(production(spark, gappy()), 3, levels=("well",), calendar=True)
    got = {r.forecast_month: (r.forecast_oil_bbl, r.forecast_gas_mcf) for r in table.collect()}
    assert sorted(got) == [month(24), month(25), month(26)]
    for t in (24, 25, 26):
        assert got[month(t)] == pytest.approx((float(decline(t)), float(decline(t, 500, 0.02))), rel=1e-6)
    by_row = forecast.forecast_table(production(spark, gappy()), 1, levels=("well",)).first()
    assert by_row.forecast_oil_bbl != pytest.approx(float(decline(24)), rel=1e-2)


def test_fitted_curve_by_calendar(spark):
    fitted = forecast.fit_series(forecast.entity_series(panel(spark, gappy()), calendar=True))
    got = forecast.fitted_curve(fitted).filter("entity_type = 'well'").orderBy("t").collect()
    assert [r.t for r in got] == [t for t in range(24) if t not in (3, 4, 9, 17)]
    assert [r.oil_fitted for r in got] == pytest.approx([r.oil_production for r in got], rel=1e-6)


def test_the_calendar_fit_is_as_good_as_the_grid(spark):
    draw = np.random.default_rng(5)
    facts = [
        fact(f"w{w}", int(t), g, float(decline(t) * draw.normal(1, 0.2)))
        for w in range(6) for t in sorted(draw.choice(60, 30, replace=False)) for g in "OG"
    ]
    series = forecast.entity_series(panel(spark, facts), calendar=True)
    grid = forecast.arps_grid_fit(series, "oil", [i / 100 for i in range(1, 16)], [i / 10 for i in range(11)]).select("entity_type", "entity_id", F.col("r2").alias("grid"))
    both = forecast.fit_series(series).join(grid, ["entity_type", "entity_id"]).select(F.col("oil_fit.r2").alias("r2"), "grid").collect()
    assert both and all(r.r2 >= r.grid - 1e-9 for r in both)


def test_the_grid_is_laid_over_series_once_and_keeps_sql_rules(spark):
    days = [month(n) for n in (0, 1, 3, 4, 7, 8)]
    series = {
        "hyper": [100 / (1 + 0.4 * 0.05 * t) ** (1 / 0.4) for t in (0, 1, 3, 4, 7, 8)],
        "flat": [5.0] * 6, "blank": [None, 7.0, 6.0, None, 4.0, 0.0], "nan": [1.0, float("nan"), 2.0, 3.0, 4.0, 5.0],
        "endless": [float("inf"), 3.0, 2.0, 2.0, 1.0, 1.0],
    }
    panel = spark.createDataFrame(
        [("well", name, m, q, 0.0) for name, rates in series.items() for m, q in zip(days, rates, strict=True)],
        "entity_type string, entity_id string, production_month date, oil_production double, gas_production double",
    )
    made = forecast.arps_grid_fit(
        forecast.entity_series(panel, calendar=True), "oil", [i / 100 for i in range(1, 16)], [i / 10 for i in range(11)]
    )
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(" not in plan  # no loop over cells in expressions
    got = {r.entity_id: r for r in made.collect()}
    assert (got["hyper"].model, got["hyper"].b, got["hyper"].di) == ("hyperbolic", 0.4, 0.05) and abs(got["hyper"].r2 - 1) < 1e-12
    assert got["flat"].r2 == 0.0
    # null and zero rates count as the floor, the first of which limits qi
    assert abs(got["blank"].qi - 0.01) < 1e-15
    for name in ("nan", "endless"):
        assert got[name].r2 != got[name].r2 and (got[name].b, got[name].di) == (0.0, 0.01)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
def test_no_task_makes_the_months_of_all_wells(spark):
    made = bind.decline_production(spark, "/root/testdata/sf0.01")
    of_task = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert len(of_task) > 1 and max(of_task) < 0.5 * sum(of_task)

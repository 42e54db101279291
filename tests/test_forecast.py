import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import fact, fields, month, production, rows
from prodlake import schemas
from prodlake.functions import decline
from prodlake.operators import forecast


def declining(well, months=12, operator="OP", play="P", qi=100.0):
    return [
        fact(well, t, g, qi * k * 0.9**t, operator, play)
        for t in range(months) for g, k in (("O", 1), ("G", 4))
    ]


def test_levels_of_the_panel(spark):
    facts = production(
        spark,
        declining("a", 2) + declining("b", 2, qi=50.0) + [fact("c", 0, "X", 7, operator="OQ", play=None)],
    )
    panel = forecast.entity_panel(facts, top_n=1)
    assert rows(panel, "*") == [
        ("basin", "P", month(0), 150.0, 600.0), ("basin", "P", month(1), 135.0, 540.0),
        ("operator", "OP", month(0), 150.0, 600.0), ("operator", "OP", month(1), 135.0, 540.0),
        ("operator", "OQ", month(0), 0.0, 0.0),
        ("well", "a", month(0), 100.0, 400.0), ("well", "a", month(1), 90.0, 360.0),
    ]
    separate = forecast.entity_panel(facts, 1, ("well",)).unionByName(
        forecast.entity_panel(facts, 1, ("operator", "basin"))
    )
    assert rows(separate, "*") == rows(panel, "*")


def test_single_levels_equal_their_own_rollups(spark):
    facts = production(spark, declining("a", 4) + declining("b", 3, "OQ", "Q"))
    for level, table in (
        ("operator", forecast.operator_monthly(facts)), ("basin", forecast.play_monthly(facts)),
    ):
        got = forecast.entity_panel(facts, None, (level,)).drop("entity_type")
        assert rows(got, "*") == rows(table, "*")


def test_a_month_under_two_operators_gives_two_rows(spark):
    facts = production(spark, [fact("a", 0, "O", 1, "A"), fact("a", 0, "G", 2, "B")])
    panel = forecast.entity_panel(facts, None, ("well",))
    assert rows(panel, "entity_id", "oil_production", "gas_production") == [("a", 0.0, 2.0), ("a", 1.0, 0.0)]


def test_short_histories_and_gaps(spark):
    gaps = [f for f in declining("gap", 9) if f[3] != month(4)]
    facts = production(spark, declining("five", 5) + declining("six", 6) + gaps)
    series = forecast.entity_series(forecast.entity_panel(facts, None, ("well",)))
    assert rows(series, "entity_id", "months", "last_month") == [("gap", 8, month(8)), ("six", 6, month(5))]


def test_forecast_of_an_exact_decline(spark):
    table = forecast.forecast_table(production(spark, declining("a") + declining("b", qi=30.0)), 3)
    assert fields(table.schema) == fields(schemas.GOLD_FORECAST)
    assert table.count() == 3 * (2 + 1 + 1)
    for r in table.where("entity_id = 'a'").collect():
        t = (r.forecast_month.year - 2018) * 12 + r.forecast_month.month - 1
        assert r.forecast_oil_bbl == pytest.approx(100 * 0.9**t)
        assert r.forecast_gas_mcf == pytest.approx(400 * 0.9**t)
        assert (r.model_type, r.b_factor) == ("exponential", 0.0)
        assert r.r2_score == pytest.approx(1.0)


def test_zero_gas_reports_the_oil_parameters(spark):
    facts = production(spark, [fact("a", t, "O", 100 * 0.9**t) for t in range(8)])
    got = forecast.forecast_table(facts, 2, levels=("well",)).collect()
    assert all(r.forecast_gas_mcf == 0.0 and r.model_type == "exponential" for r in got)
    assert got[0].qi == pytest.approx(100.0)


def fitted(spark, oil, gas, last=dt.date(2020, 1, 31), months=6):
    kind = "struct<model:string,qi:double,di:double,b:double,r2:double>"
    return spark.createDataFrame(
        [("well", "w", months, last, oil, gas)],
        f"entity_type string, entity_id string, months int, last_month date, oil_fit {kind}, gas_fit {kind}",
    )


def test_projection_months_and_dominant_fit(spark):
    flat, better = ("flat", 5.0, 0.0, 0.0, 0.0), ("harmonic", 8.0, 0.5, 1.0, 0.7)
    got = forecast.project_forward(fitted(spark, flat, better), 3).orderBy("forecast_month").collect()
    assert [r.forecast_month for r in got] == [dt.date(2020, 2, 29), dt.date(2020, 3, 31), dt.date(2020, 4, 30)]
    assert [r.forecast_oil_bbl for r in got] == [5.0, 5.0, 5.0]
    assert [r.forecast_gas_mcf for r in got] == pytest.approx([8 / (1 + 0.5 * t) for t in (6, 7, 8)])
    assert {(r.model_type, r.qi) for r in got} == {("harmonic", 8.0)}
    tie = forecast.project_forward(fitted(spark, ("flat", 5.0, 0.0, 0.0, 0.7), better), 1).first()
    assert tie.model_type == "flat"  # oil wins ties


def test_projection_is_never_negative(spark):
    fit = ("exponential", -3.0, 0.1, 0.0, 0.5)
    assert forecast.project_forward(fitted(spark, fit, fit), 1).first().forecast_oil_bbl == 0.0


def test_the_fit_is_called_once_per_series(spark):
    facts = production(spark, declining("a"))
    plan = forecast.forecast_table(facts, top_n=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "LeftOuter" in plan and "TakeOrderedAndProject" in plan  # the top wells stay on the cluster


def test_band(spark):
    band = forecast.forecast_band(forecast.project_forward(fitted(spark, *[("flat", 10.0, 0.0, 0.0, 0.0)] * 2), 1))
    r = band.first()
    assert (r.oil_low, r.oil_high) == pytest.approx((8.5, 11.5))


def test_top_wells_break_ties_by_id(spark):
    facts = production(spark, [fact(w, 0, "O", 5) for w in ("c", "a", "b")] + [fact("d", 0, "G", 99)])
    assert [r.api_number for r in forecast.top_wells(facts, 2).collect()] == ["a", "b"]
    assert "LeftSemi" in forecast.top_well_panel(facts, 2)._jdf.queryExecution().executedPlan().toString()


def test_best_model_order(spark):
    scores = spark.createDataFrame(
        [("a", "harmonic", 0.9), ("a", "hyperbolic", 0.9), ("b", "harmonic", 0.9), ("b", "exponential", 0.8)],
        "k string, model string, r2 double",
    )
    assert rows(forecast.best_model(scores, ["k"]), "k", "model") == [("a", "hyperbolic"), ("b", "harmonic")]


def test_r2(spark):
    frame = spark.createDataFrame(
        [("const", 7.0, 6.0), ("const", 7.0, 8.0), ("exact", 1.0, 1.0), ("exact", 2.0, 2.0), ("half", 0.0, 1.0), ("half", 2.0, 2.0)],
        "k string, y double, p double",
    )
    assert rows(decline.r2_score(frame, ["k"], "y", "p"), "k", "r2") == [
        ("const", 0.0), ("exact", 1.0), ("half", 0.5),
    ]


def test_curves_at_the_edges(spark):
    frame = spark.range(1).select(
        decline.hyperbolic(F.lit(-100.0), F.lit(1.0), F.lit(0.5), F.lit(0.5)).alias("floored"),
        decline.curve(F.lit("hyperbolic"), F.lit(3.0), F.lit(2.0), F.lit(0.0), F.lit(0.0)).alias("flat"),
    )
    r = frame.first()
    assert r.floored > 0 and r.flat == 2.0


def test_fitted_curve_covers_every_month(spark):
    series = forecast.entity_series(forecast.entity_panel(production(spark, declining("a", 8)), None, ("well",)))
    got = forecast.fitted_curve(forecast.fit_series(series)).orderBy("t").collect()
    assert [r.production_month for r in got] == [month(t) for t in range(8)]
    assert [r.oil_fitted for r in got] == pytest.approx([r.oil_production for r in got])

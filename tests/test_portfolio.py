import pytest

from helpers import fact, production, rows
from prodlake.operators import clean, kpi, portfolio, quality


def flaring(spark, volumes):
    data = [(f"OP {i}", float(v) if v is not None else None) for i, v in enumerate(volumes)]
    return spark.createDataFrame(data, "operator string, total_flared_gas_mcf double")


def test_tiers(spark):
    tiered = portfolio.volume_tier(flaring(spark, [1, 2, 7, 11, 20]))
    assert rows(tiered, "total_flared_gas_mcf", "volume_category") == [
        (1.0, "Low"), (11.0, "High"), (2.0, "Low"), (20.0, "High"), (7.0, "Medium"),
    ]
    r = portfolio.flaring_kpis(tiered).first()
    assert (r.total_flared, r.top_flared_volume, r.top_flarer, r.median_flared) == (41.0, 20.0, "OP 4", 7.0)
    assert (r.n_operators, r.n_high, r.top_flarer_label) == (5, 2, "Op 4")
    cuts = portfolio.flaring_percentiles(tiered).first()
    assert cuts.p33 == pytest.approx(3.6)


def test_largest_flarer_of_a_tie_is_the_first_name(spark):
    assert portfolio.flaring_kpis(portfolio.volume_tier(flaring(spark, [5, 5, None]))).first().top_flarer == "OP 0"


def test_null_keys_are_left_out_and_empty_sums_are_zero(spark):
    wells = spark.createDataFrame([("a", "P"), ("b", "P"), ("c", None)], "api_number string, shale_play string")
    assert rows(portfolio.wells_per_play(wells), "*") == [("P", 2)]
    ethane = spark.createDataFrame(
        [("A", 2018, None, 3.0), ("A", 2019, None, 1.0), (None, 2018, 5.0, 5.0)],
        "operator string, production_year int, liquid_rich_production double, dry_gas_production double",
    )
    assert rows(portfolio.commodity_split_top_n(ethane, 5), "*") == [("A", 0.0, 4.0, 4.0)]
    assert rows(portfolio.liquid_share_by_year(ethane), "production_year", "liquid_rich_pct") == [
        (2018, pytest.approx(500 / 13)), (2019, 0.0),
    ]


def test_top_n_is_shown_smallest_first(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None), ("d", 2.0)], "k string, v double")
    assert [tuple(r) for r in portfolio.top_n(frame, "v", 2, "k").collect()] == [("d", 2.0), ("b", 3.0)]


def test_quarter_matrix_is_zero_off_the_year(spark):
    facts = production(spark, [fact("a", 0, "O", 4), fact("a", 13, "O", 6), fact("a", 0, "G", 9)])
    want = [(2018, 4.0, 0.0), (2019, 0.0, 6.0)]
    assert rows(portfolio.quarter_matrix(facts), "*") == want
    assert rows(portfolio.quarter_matrix(facts, ["2018Q1", "2019Q1"]), "*") == want


def test_quarters_follow_the_data(spark):
    facts = production(spark, [fact("a", -250, "O", 4), fact("a", 13, "O", 6)])
    assert rows(portfolio.quarter_matrix(facts), "production_year", "1997Q1", "2019Q1") == [(1997, 4.0, 0.0), (2019, 0.0, 6.0)]


def test_portfolio_kpis(spark):
    facts = production(
        spark,
        [fact("a", 0, "O", 4, "A"), fact("a", 1, "G", 6, "A"), fact("a", 1, "O", 1, "B"), fact("g", 0, "G", 5, "C"), fact("x", 0, "X", 9, "D")],
    )
    assert rows(portfolio.portfolio_kpis(facts), "total_oil", "total_gas", "n_operators", "n_wells") == [(5.0, 11.0, 3, 1)]
    assert rows(portfolio.portfolio_kpis(facts.limit(0)), "total_oil", "n_wells") == [(0.0, 0)]


def test_entity_history_has_both_commodities(spark):
    facts = production(spark, [fact("a", 0, "O", 4, "A", "P"), fact("b", 1, "O", 6, "A", "Q")])
    for kind, key, count in (("well", "a", 1), ("operator", "A", 2), ("basin", "Q", 1)):
        got = portfolio.entity_history(facts, kind, key)
        assert got.columns == ["production_month", "oil_production", "gas_production"]
        assert got.count() == count and got.first().gas_production == 0.0


def test_portfolio_uses_only_existing_columns(spark):
    wells = kpi.well_summary(production(spark, [fact("a", 0, "O", 1_250_000)])).drop("basin")
    table = portfolio.well_portfolio(wells)
    assert "Basin" not in table.columns
    r = table.first()
    assert (r["Cumulative Oil Bbl"], r["Cumulative Gas Mcf"]) == ("1.2M", "—")


def forecasts(spark):
    data = [
        (kind, key, f"2024-{m:02d}-01", 1.0 * m, 4.0, model, r2)
        for kind, key, model, r2 in (
            ("well", "w1", "hyperbolic", 0.5), ("well", "w2", "harmonic", 0.9),
            ("operator", "A", "hyperbolic", 1.0), ("basin", "P", "hyperbolic", 0.8),
        )
        for m in (1, 2)
    ]
    frame = spark.createDataFrame(
        data, "entity_type string, entity_id string, m string, forecast_oil_bbl double, "
        "forecast_gas_mcf double, model_type string, r2_score double",
    )
    return frame.withColumn("forecast_month", frame.m.cast("date")).drop("m")


def test_forecast_reports(spark):
    table = forecasts(spark)
    r = portfolio.forecast_kpis(table).first()
    assert (r.avg_r2, r.pct_hyperbolic) == (pytest.approx(0.8), 75.0)
    assert (r.n_wells, r.n_operators, r.n_basins, r.horizon) == (2, 1, 1, "Feb 2024")
    assert rows(portfolio.model_mix(table), "*") == [
        ("basin", "hyperbolic", 1), ("operator", "hyperbolic", 1), ("well", "harmonic", 1), ("well", "hyperbolic", 1),
    ]
    assert rows(portfolio.operator_forecast_top(table), "*") == [("A", 3.0)]
    one = portfolio.forecast_slice(table, "well", "w1").collect()
    assert [str(x.forecast_month) for x in one] == ["2024-01-01", "2024-02-01"]
    assert {str(x.forecast_start) for x in one} == {"2024-01-01"}
    assert [x.entity_id for x in portfolio.forecast_summary(table).collect()] == ["P", "A", "w1", "w2"]
    assert rows(portfolio.well_fit_quality(table), "*") == [("w1", 0.5), ("w2", 0.9)]


def test_histogram(spark):
    scores = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.5, 1.0, 1.0, None)], "r2_score double")
    got = portfolio.r2_histogram(scores, 10).orderBy("bin").collect()
    assert [r.wells for r in got] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 2]
    assert (got[0].bin_low, got[9].bin_high, got[0].mean_r2) == (0.0, 1.0, pytest.approx(0.52))
    same = spark.createDataFrame([(0.3,), (0.3,)], "r2_score double")
    flat = portfolio.r2_histogram(same, 4).orderBy("bin").collect()
    assert [r.wells for r in flat] == [0, 0, 2, 0]


def test_quality_reports(spark):
    facts = production(spark, [fact("a", 0), fact("a", 1), fact("b", 2, operator="OQ"), fact("b", 3, value=None)])
    raw = spark.createDataFrame([("a", ""), (None, "x"), ("", None), ("b", " "), ("c", "y")], "k string, v string")
    assert rows(quality.dq_null_profile(raw), "k", "v") == [(2, 2)]
    assert [tuple(x) for x in quality.rows_per(facts, "api_number").collect()] == [("a", 2), ("b", 2)]
    assert [x[0] for x in quality.distinct_values(raw, "k").collect()] == ["", "a", "b", "c"]
    assert rows(quality.table_counts({"x": raw, "y": facts}), "*") == [("x", 5), ("y", 4)]


def test_summary_is_what_cleaning_leaves(spark):
    text = [
        ("a", "n", "OP", "2018-01-01", "O", "5"), ("a", None, "oq ", "2018-01-01", "O", "4"), ("a", "n", "OP", "2018-01-01", "O", "5"),
        ("a", "n", "OP", "2018-02-01", "O", "-5"), ("b", "n", "OP", "2018-13-01", "O", "5"), (None, "n", "OP", "2018-01-01", "O", "5"),
        ("b", "n", "OR", "2018-03-01", "G", "NaN"), ("b", "n", "OR", "2018-04-01", "G", "Infinity"), ("b", "n", "OR", "2018-05-01", "G", "-Infinity"),
        ("b", "n", None, "2018-01-01", "O", "x"),
    ]
    raw = spark.createDataFrame(
        [(*t, "P", "B") for t in text],
        "api_number string, well_name string, operator string, production_month string, oil_and_gas_group string, "
        "production string, shale_play string, basin string",
    )
    kept = clean.clean_production(raw)
    r = quality.dq_summary(raw).first()
    assert (r.raw_rows, r.clean_rows, r.non_finite, r.null_productions) == (10, kept.count(), 3, 0) == (10, 3, 3, 0)
    assert (r.unique_wells, r.unique_operators) == (2, kept.select("operator").distinct().count())
    assert (r.first_month, r.last_month) == tuple(kept.selectExpr("min(production_month)", "max(production_month)").first())
    assert r.retention_pct == 30.0
    assert quality.dq_summary(raw.limit(0)).first().retention_pct is None


def test_profile_of_timestamps(spark):
    frame = spark.sql("SELECT CAST(NULL AS TIMESTAMP) AS load_timestamp, 'x' AS k")
    assert rows(quality.dq_null_profile(frame), "*") == [(1, 0)]


def test_period_reports(spark):
    facts = production(spark, [fact("a", t, "O", t + 1) for t in range(13)])
    quarters = quality.operator_quarterly(facts).collect()
    assert [(r.production_year, r.production_quarter, r.total_production) for r in quarters][:2] == [
        (2018, "Q1", 6.0), (2018, "Q2", 15.0),
    ]
    growth = quality.avg_yoy_growth(kpi.basin_production_trends(facts)).collect()
    assert [tuple(r) for r in growth] == [("P", "O", 1200.0)]

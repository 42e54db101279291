"""What the plans must look like over stored tables."""

import pytest
from pyspark.sql import functions as F

from helpers import fact, production
from prodlake import schemas
from prodlake.operators import forecast, kpi, portfolio, quality
from prodlake.sources import tables


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("silver") / "silver_production")
    data = [fact(f"w{i % 9}", i % 30, "OG"[i % 2], i, f"OP{i % 4}") for i in range(300)]
    tables.write_table(production(spark, data), path, ["production_year"], rebalance=True)
    return tables.scan_table(spark, path, schemas.SILVER_PRODUCTION)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


BUILDS = {
    "operator_oil_gas": kpi.operator_oil_gas,
    "operator_month_rollup": kpi.operator_month_rollup,
    "basin_production_trends": kpi.basin_production_trends,
    "ethane_dry_gas": kpi.ethane_dry_gas,
    "well_summary": kpi.well_summary,
    "well_peak_month": kpi.well_peak_month,
    "monthly_wide_panel": forecast.monthly_wide_panel,
    "entity_panel": lambda p: forecast.entity_panel(p, None),
    "operator_drilldown": lambda p: portfolio.operator_drilldown(p, "OP1"),
    "input_profile": quality.input_profile,
}


@pytest.mark.parametrize("name", BUILDS)
def test_one_scan_no_python_and_partial_aggregation(facts, name):
    plan = plan_of(BUILDS[name](facts))
    assert plan.count("FileScan") == 1
    assert "Python" not in plan
    assert "partial_" in plan
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_only_needed_columns_are_read(facts):
    plan = plan_of(kpi.operator_oil_gas(facts))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {f.split(":")[0] for f in schema.split(",")} == {
        "api_number", "operator", "oil_and_gas_group", "production",
    }


def test_filters_reach_the_scan(facts):
    plan = facts.filter(F.col("oil_and_gas_group") == "O").groupBy("operator").count()
    assert "EqualTo(oil_and_gas_group,O)" in plan_of(plan)
    assert "EqualTo(operator,OP1)" in plan_of(portfolio.operator_drilldown(facts, "OP1"))
    assert "EqualTo(shale_play,P)" in plan_of(portfolio.entity_history(facts, "basin", "P"))


def test_trends_share_one_sort_for_both_lags(facts):
    # one window for the two lags, one for the rank
    assert plan_of(kpi.basin_production_trends(facts)).count("Window [") == 2


def test_top_n_keeps_a_bounded_heap_per_task(facts):
    assert "TakeOrderedAndProject" in plan_of(forecast.top_wells(facts, 5))


def test_windows_over_the_facts_are_partitioned(facts):
    for build in (kpi.basin_production_trends, kpi.well_summary):
        assert "SinglePartition" not in plan_of(build(facts))

"""The batch pipeline: raw, clean, KPI and forecast stages.

Stages meet only in stored tables, so each can run, and be run again, on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from prodlake import schemas
from prodlake.operators import clean, forecast, kpi
from prodlake.session import checkpoint_root, stored
from prodlake.sources import feeds
from prodlake.sources.tables import TablePaths, scan_table, write_table, written_rows

STAGES = ("bronze", "silver", "gold", "forecast")


def _store(
    spark: SparkSession, paths: TablePaths, table: str, df: DataFrame,
    partition_by: list[str] | None = None,
) -> int:
    write_table(df, paths.of(table), partition_by, rebalance=True)
    return written_rows(spark, paths.of(table))


def _side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], int]]) -> dict[str, int]:
    """Run independent table builds at the same time, so that the last tasks of one
    leave no executor idle.  Results come in the order of ``jobs``."""
    with ThreadPoolExecutor(max_workers=len(jobs) or 1) as pool:
        in_thread = inheritable_thread_target(spark)
        running = {name: pool.submit(in_thread(job)) for name, job in jobs.items()}
        return {name: future.result() for name, future in running.items()}


def run_bronze(
    spark: SparkSession, paths: TablePaths, raw_dir: str, keep_broken: bool = False
) -> dict[str, int]:
    """Land every feed whose file is present; ``keep_broken`` lands lines with a wrong number of
    fields in tables of their own instead of among the rows."""
    found = feeds.present(spark, raw_dir)
    if keep_broken:
        return {
            table: rows for feed, path in found for table, rows in feeds.ingest_checked(spark, feed, path, paths).items()
        }
    return _side_by_side(
        spark,
        {
            feed.table: lambda feed=feed, path=path: feeds.ingest(spark, feed, path, paths)
            for feed, path in found
        },
    )


def run_silver(spark: SparkSession, paths: TablePaths) -> dict[str, int]:
    """Wells and flaring first; production needs the wells."""

    def raw(table: str) -> DataFrame:
        return scan_table(spark, paths.of(table))

    counts = _side_by_side(
        spark,
        {
            "silver_wells": lambda: _store(
                spark, paths, "silver_wells", clean.clean_wells(raw("bronze_well_metadata"))
            ),
            "silver_flaring": lambda: _store(
                spark, paths, "silver_flaring", clean.clean_flaring(raw("bronze_flaring"))
            ),
        },
    )
    wells = scan_table(spark, paths.of("silver_wells"), schemas.SILVER_WELLS)
    production = clean.enrich_production(
        clean.clean_production(raw("bronze_well_production")), wells
    )
    counts["silver_production"] = _store(
        spark, paths, "silver_production", production, ["production_year"]
    )
    return counts


def silver_production(spark: SparkSession, paths: TablePaths) -> DataFrame:
    return scan_table(spark, paths.of("silver_production"), schemas.SILVER_PRODUCTION)


def run_gold(spark: SparkSession, paths: TablePaths) -> dict[str, int]:
    """Five tables from two passes over the facts.

    One pass makes the well summary, the other a roll-up over wells (operators times months,
    so small against the facts) that the remaining tables are built from.
    """
    production = silver_production(spark, paths)
    flaring = scan_table(spark, paths.of("silver_flaring"), schemas.SILVER_FLARING)

    def store(table: str, build: Callable[[], DataFrame]) -> Callable[[], int]:
        return lambda: _store(spark, paths, table, build())

    made: dict[str, DataFrame] = {}

    def write_rollup() -> int:
        made["rollup"] = stored(kpi.operator_month_rollup(production), "operator_months")
        return 0

    counts = _side_by_side(
        spark,
        {
            "rollup": write_rollup,
            "gold_well_summary": store("gold_well_summary", lambda: kpi.well_summary(production)),
        },
    )
    del counts["rollup"]
    wells = scan_table(spark, paths.of("gold_well_summary"), schemas.GOLD_WELL_SUMMARY)
    jobs = {table: store(table, build) for table, build in kpi_builds(made["rollup"], wells, flaring).items()}
    return {**_side_by_side(spark, jobs), **counts}


def kpi_builds(rollup: DataFrame, wells: DataFrame, flaring: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """The KPI tables that need no facts, from the roll-up over wells and the well summary."""
    return {
        "gold_operator_performance": lambda: kpi.operator_performance(
            kpi.oil_gas_from_rollup(rollup, wells), flaring
        ),
        "gold_basin_production_trends": lambda: kpi.basin_production_trends(rollup),
        "gold_flaring_intensity": lambda: kpi.flaring_intensity(rollup, flaring),
        "gold_ethane_dry_gas": lambda: kpi.ethane_dry_gas(rollup),
    }


def run_forecast(
    spark: SparkSession, paths: TablePaths, n_months: int = 24, top_n: int | None = None
) -> dict[str, int]:
    """``top_n`` limits the wells to those with the most oil; by default all are forecast."""
    table = "gold_production_forecast"
    forecasts = forecast.forecast_table(silver_production(spark, paths), n_months, top_n)
    return {table: _store(spark, paths, table, forecasts)}


def run(
    spark: SparkSession, raw_dir: str, root: str, stage: str = "all", top_wells: int | None = None,
    keep_broken: bool = False,
) -> dict[str, int]:
    """Run one stage or all of them; returns rows per written table."""
    if stage != "all" and stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}, expected one of {('all', *STAGES)}")
    checkpoint_root(spark)  # fail before any work if the cluster names no shared folder
    paths = TablePaths(root)
    jobs = {
        "bronze": lambda: run_bronze(spark, paths, raw_dir, keep_broken),
        "silver": lambda: run_silver(spark, paths),
        "gold": lambda: run_gold(spark, paths),
        "forecast": lambda: run_forecast(spark, paths, top_n=top_wells),
    }
    counts: dict[str, int] = {}
    for name in STAGES:
        if stage in ("all", name):
            counts.update(jobs[name]())
    return counts

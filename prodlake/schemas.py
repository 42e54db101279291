"""Table schemas, enforced by ``conform`` at the end of every table operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_S, _D, _I, _L, _DATE, _TS = (
    StringType(), DoubleType(), IntegerType(), LongType(), DateType(), TimestampType(),
)


def _schema(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


SILVER_WELLS = _schema(api_number=_S, well_name=_S, well_length_ft=_D, load_timestamp=_TS)

SILVER_FLARING = _schema(operator=_S, total_flared_gas_mcf=_D, load_timestamp=_TS)

SILVER_PRODUCTION = _schema(
    api_number=_S, well_name=_S, operator=_S, production_month=_DATE, production_year=_I,
    production_quarter=_S, oil_and_gas_group=_S, production=_D, shale_play=_S, basin=_S,
    well_length_ft=_D,
)

GOLD_OPERATOR_PERFORMANCE = _schema(
    operator=_S, total_oil_bbl=_D, well_count=_L, avg_monthly_production=_D, total_gas_mcf=_D,
    total_flaring_mcf=_D, flaring_intensity_ratio=_D, production_rank=_I,
)

GOLD_BASIN_TRENDS = _schema(
    shale_play=_S, production_month=_DATE, oil_and_gas_group=_S, total_production=_D,
    prev_month_production=_D, mom_growth_pct=_D, yoy_growth_pct=_D, production_rank=_I,
)

GOLD_FLARING_INTENSITY = _schema(
    operator=_S, total_flared_gas_mcf=_D, total_gas_production_mcf=_D,
    flaring_intensity_ratio=_D, flaring_rank=_I, flaring_category=_S,
)

GOLD_ETHANE_DRY_GAS = _schema(
    operator=_S, production_year=_I, shale_play=_S, liquid_rich_production=_D,
    dry_gas_production=_D, ethane_dry_gas_ratio=_D, basin_category=_S,
)

GOLD_WELL_SUMMARY = _schema(
    api_number=_S, well_name=_S, operator=_S, first_production_month=_DATE,
    last_production_month=_DATE, cumulative_oil_bbl=_D, cumulative_gas_mcf=_D,
    peak_oil_month=_DATE, peak_oil_production=_D, well_length_ft=_D, active_months=_L,
    shale_play=_S, basin=_S,
)

GOLD_FORECAST = _schema(
    entity_type=_S, entity_id=_S, forecast_month=_DATE, forecast_oil_bbl=_D,
    forecast_gas_mcf=_D, model_type=_S, r2_score=_D, qi=_D, di=_D, b_factor=_D,
)

SILVER_TABLES = {
    "silver_wells": SILVER_WELLS,
    "silver_flaring": SILVER_FLARING,
    "silver_production": SILVER_PRODUCTION,
}

KPI_TABLES = {
    "gold_operator_performance": GOLD_OPERATOR_PERFORMANCE,
    "gold_basin_production_trends": GOLD_BASIN_TRENDS,
    "gold_flaring_intensity": GOLD_FLARING_INTENSITY,
    "gold_ethane_dry_gas": GOLD_ETHANE_DRY_GAS,
    "gold_well_summary": GOLD_WELL_SUMMARY,
    "gold_production_forecast": GOLD_FORECAST,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project onto ``schema``: its columns, its order, its types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

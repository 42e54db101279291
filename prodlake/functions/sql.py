"""The column helpers as SQL functions, for queries written as text.

``register_functions`` makes temporary functions of a session from SQL bodies, which Catalyst
inlines: nothing runs outside the JVM, and pushdown works as if the body had been written out.
``forecast_slice`` is a table function over the view of the forecast table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Same rules as in ``expr``.
SCALAR = {
    "safe_ratio": "(numerator DOUBLE, denominator DOUBLE) RETURNS DOUBLE RETURN CASE WHEN denominator > 0 THEN numerator / denominator END",
    "growth_pct": "(value DOUBLE, previous DOUBLE) RETURNS DOUBLE RETURN CASE WHEN previous > 0 THEN (value - previous) / previous * 100 END",
    "share_pct": "(part DOUBLE, other DOUBLE) RETURNS DOUBLE RETURN CASE WHEN part + other > 0 THEN part / (part + other) * 100 END",
    "flaring_class": "(ratio_pct DOUBLE) RETURNS STRING RETURN CASE WHEN ratio_pct < 5 THEN 'Low' WHEN ratio_pct BETWEEN 5 AND 15 THEN 'Medium' ELSE 'High' END",
    "basin_class": "(ratio DOUBLE, threshold DOUBLE DEFAULT 0.3D) RETURNS STRING RETURN CASE WHEN ratio > threshold THEN 'Liquid-Rich' ELSE 'Dry Gas' END",
    "quarter_label": "(day DATE) RETURNS STRING RETURN concat('Q', CAST(quarter(day) AS STRING))",
    "period_label": "(day DATE) RETURNS STRING RETURN concat(CAST(year(day) AS STRING), 'Q', CAST(quarter(day) AS STRING))",
}

FORECAST_SLICE = """(kind STRING, id STRING)
    RETURNS TABLE (forecast_month DATE, forecast_oil_bbl DOUBLE, forecast_gas_mcf DOUBLE, model_type STRING, r2_score DOUBLE)
    RETURN SELECT forecast_month, forecast_oil_bbl, forecast_gas_mcf, model_type, r2_score
           FROM gold_production_forecast WHERE entity_type = kind AND entity_id = id"""


def register_functions(spark: SparkSession, tables: bool = True) -> None:
    """Make the functions known to the session.  The table function needs the view
    ``gold_production_forecast``; ``tables=False`` leaves it out."""
    for name, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    if tables:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION forecast_slice{FORECAST_SLICE}")

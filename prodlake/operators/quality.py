"""Profiles and data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prodlake.operators import clean


def operator_quarterly(production: DataFrame) -> DataFrame:
    """Quarterly total and number of producing wells per operator and commodity."""
    quarter = ["operator", "production_year", "production_quarter"]
    return (
        production.groupBy(*quarter, "oil_and_gas_group")
        .agg(
            F.round(F.sum("production"), 2).alias("total_production"),
            F.count_distinct("api_number").alias("active_wells"),
        )
        .orderBy(*quarter, "oil_and_gas_group")
    )


def avg_yoy_growth(trends: DataFrame) -> DataFrame:
    """Mean yearly growth per play and commodity, months without a value left out."""
    series = ["shale_play", "oil_and_gas_group"]
    mean = F.round(F.avg("yoy_growth_pct"), 2).alias("avg_yoy_growth_pct")
    known = trends.filter(F.col("yoy_growth_pct").isNotNull())
    return known.groupBy(*series).agg(mean).orderBy(*series)


def top_flaring_intensity(flaring: DataFrame, n: int = 5) -> DataFrame:
    """The operators that flare the largest share of their gas."""
    known = flaring.filter(F.col("flaring_intensity_ratio").isNotNull())
    return known.orderBy("flaring_rank", "operator").limit(n).select(
        "operator",
        F.round("flaring_intensity_ratio", 2).alias("flaring_pct"),
        "flaring_category",
        "flaring_rank",
    )


def rows_per(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().orderBy(column)


def dq_null_profile(df: DataFrame) -> DataFrame:
    """Null or empty values of every column, in one pass and one row."""

    def missing(field):
        column = F.col(f"`{field.name}`")
        blank = column == "" if isinstance(field.dataType, StringType) else F.lit(False)
        return F.count_if(column.isNull() | blank).alias(field.name)

    return df.agg(*[missing(field) for field in df.schema])


def dq_summary(raw: DataFrame) -> DataFrame:
    """Raw and clean rows, retention, distinct wells and operators, dates, odd measures.

    One pass over the raw rows.  Rows that cleaning drops share one group per operator and well
    with their count, rows that it keeps are grouped by its key, so the kept groups are
    the clean rows and all counts add up to the raw ones.  ``non_finite`` counts raw rows whose
    production reads as NaN or infinite.
    """
    typed = clean.typed_production(raw)
    measure = F.col("production")
    # NaN is larger than any number, so it passes like in the cleaning
    kept = F.col("api_number").isNotNull() & F.col("production_month").isNotNull() & F.col("operator").isNotNull() & F.coalesce(measure >= 0, F.lit(False))
    key = [F.when(kept, F.col(c)).alias(c) for c in clean.PRODUCTION_KEY]
    odd = F.isnan(measure) | (F.abs(measure) == float("inf"))
    smallest = F.min(F.when(kept, F.struct(F.col("well_name"), F.col("operator"))))
    groups = typed.groupBy(*key, kept.alias("kept")).agg(
        F.count("*").alias("rows"), smallest["operator"].alias("operator"), F.count_if(odd).alias("odd")
    )
    pairs = groups.groupBy("api_number", "operator").agg(
        F.sum("rows").alias("raw_rows"), F.count_if("kept").alias("clean_rows"), F.sum("odd").alias("odd"),
        F.min("production_month").alias("first"), F.max("production_month").alias("last"),
    )
    return pairs.agg(
        F.coalesce(F.sum("raw_rows"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum("clean_rows"), F.lit(0)).alias("clean_rows"),
        F.count_distinct("api_number").alias("unique_wells"),
        F.count_distinct("operator").alias("unique_operators"),
        F.min("first").alias("first_month"),
        F.max("last").alias("last_month"),
        F.lit(0).cast("bigint").alias("null_productions"),  # cleaning drops every null
        F.coalesce(F.sum("odd"), F.lit(0)).alias("non_finite"),
    ).withColumn(
        "retention_pct", F.when(F.col("raw_rows") > 0, F.col("clean_rows") / F.col("raw_rows") * 100)
    )


def input_profile(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.count("*").alias("row_count"),
        F.count_distinct("api_number").alias("well_count"),
        F.min("production_month").alias("first_month"),
        F.max("production_month").alias("last_month"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted picker values without null."""
    return df.select(column).dropna().distinct().orderBy(column)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count, as one distributed query."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)

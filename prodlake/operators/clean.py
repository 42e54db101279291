"""Raw all-string tables to typed, de-duplicated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlake import schemas
from prodlake.functions import expr
from prodlake.operators.temporal import asof_join

PRODUCTION_KEY = ["api_number", "production_month", "oil_and_gas_group"]


def filter_not_null(df: DataFrame, *columns: str) -> DataFrame:
    for column in columns:
        df = df.filter(F.col(column).isNotNull())
    return df


def filter_non_negative(df: DataFrame, column: str) -> DataFrame:
    """Keeps zero; drops negative values and nulls."""
    return df.filter(F.col(column) >= 0)


def filter_commodity(df: DataFrame, group: str) -> DataFrame:
    return df.filter(F.col("oil_and_gas_group") == group)


def dedup(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the smallest by the remaining columns, nulls first.

    ``min`` of a struct combines map-side, so a key with very many copies is reduced
    before the shuffle; a ``row_number`` window would sort all copies in one task.
    The aggregation sorts by the keys as given, which also leaves the rows of one well
    together: leading with a hash of the keys sorts faster, but doubled the shuffled
    bytes and made the stored table larger and slower to scan.
    """
    rest = [c for c in df.columns if c not in keys]
    smallest = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return smallest.select(*keys, "_row.*").select(*df.columns)


def wells_columns() -> list[Column]:
    """The typed columns of well metadata over the raw ones, without lineage."""
    return [F.col("api_number"), F.col("well_name"), expr.number_or_null("squarerootsum").alias("well_length_ft")]


def clean_wells(raw: DataFrame) -> DataFrame:
    kept = filter_not_null(raw.select(*wells_columns(), "load_timestamp"), "api_number")
    return schemas.conform(dedup(kept, ["api_number"]), schemas.SILVER_WELLS)


def flaring_columns() -> list[Column]:
    """The typed columns of flaring over the raw ones, without lineage."""
    return [
        expr.normalize_key("operator").alias("operator"),
        expr.grouped_number_or_null("totalflaredgas_mcf").alias("total_flared_gas_mcf"),
    ]


def clean_flaring(raw: DataFrame) -> DataFrame:
    typed = raw.select(*flaring_columns(), "load_timestamp")
    kept = filter_not_null(typed, "operator", "total_flared_gas_mcf")
    return schemas.conform(dedup(kept, ["operator"]), schemas.SILVER_FLARING)


def production_columns() -> list[Column]:
    """The typed columns of production over the raw ones; what cannot be read is null."""
    return [
        F.col("api_number"),
        F.col("well_name"),
        expr.normalize_key("operator").alias("operator"),
        expr.date_or_null("production_month").alias("production_month"),
        F.col("oil_and_gas_group"),
        expr.number_or_null("production").alias("production"),
        F.col("shale_play"),
        F.col("basin"),
    ]


def typed_production(raw: DataFrame) -> DataFrame:
    return raw.select(*production_columns())


def clean_production(raw: DataFrame) -> DataFrame:
    """Typed production rows, one per (well, month, commodity).

    The texts "NaN" and "Infinity" are numbers and not negative, so they stay;
    ``quality.dq_summary`` counts them.
    """
    kept = filter_not_null(typed_production(raw), "api_number", "production_month", "operator")
    return dedup(filter_non_negative(kept, "production"), PRODUCTION_KEY)


def enrich_production(production: DataFrame, wells: DataFrame) -> DataFrame:
    """Attach well metadata (kept where missing) and the calendar columns.

    No join hint: a small ``wells`` table is broadcast by its measured size, a large one
    is sort-merge joined and adaptive execution splits wells with very many rows.
    """
    metadata = wells.select(
        "api_number", F.col("well_name").alias("_metadata_name"), "well_length_ft"
    )
    return _with_calendar(production.join(metadata, "api_number", "left"))


def enrich_production_asof(production: DataFrame, versions: DataFrame) -> DataFrame:
    """``enrich_production`` with the metadata valid in the month of production.

    ``versions`` holds api_number, valid_from, well_name and well_length_ft; a month before the
    first version of a well has none.
    """
    known = versions.select("api_number", "valid_from", F.col("well_name").alias("_metadata_name"), "well_length_ft")
    return _with_calendar(
        asof_join(production, known, "api_number", "production_month", "valid_from", ["_metadata_name", "well_length_ft"])
    )


def _with_calendar(joined: DataFrame) -> DataFrame:
    named = (
        joined.withColumn("well_name", F.coalesce("well_name", "_metadata_name"))
        .withColumn("production_year", F.year("production_month"))
        .withColumn("production_quarter", expr.quarter_label("production_month"))
    )
    return schemas.conform(named, schemas.SILVER_PRODUCTION)

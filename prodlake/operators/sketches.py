"""Mergeable sketches: percentiles and distinct counts of any grouping from one stored table.

A sketch is an aggregate state kept as a column.  ``production_sketches`` makes a quantile sketch
of the volumes and a distinct-count sketch of the wells for every operator, play, month and
commodity; ``roll_up`` merges them to any coarser grouping (quarter, year, play, everything)
without a second look at the facts.  Both kinds combine map-side and have a fixed size however
many rows they saw, so a group with a third of all rows costs no more than others.

The quantile sketch draws at random; its rank is off by less than ``RANK_ERROR`` (three times the
error that 99 % of sketches of this size keep to).  The distinct count is off by less than
``COUNT_ERROR`` (three standard errors).  ``ranking.percentiles`` stays the exact path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE_SIZE = 400  # k of the quantile sketch
COUNT_BITS = 12  # 2**12 registers
RANK_ERROR = 3 * 2.296 / QUANTILE_SIZE**0.9723
COUNT_ERROR = 3 * 1.04 / 2 ** (COUNT_BITS / 2)

GRAIN = ("operator", "shale_play", "production_month", "oil_and_gas_group")


def quantile_sketches(df: DataFrame, keys: list[str], column: str, size: int = QUANTILE_SIZE) -> DataFrame:
    """``keys, sketch``; nulls and NaN are not counted."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), size).alias("sketch"))


def merge_quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _quantile(sketch: str, point: float):
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(point))))


def quantiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """A column per point in place of the sketch; null where the sketch saw nothing."""
    return sketches.withColumns({name: _quantile("sketch", p) for name, p in points.items()}).drop("sketch")


def distinct_sketches(df: DataFrame, keys: list[str], column: str, bits: int = COUNT_BITS) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, bits).alias("sketch"))


def merge_distinct(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def production_sketches(production: DataFrame) -> DataFrame:
    """The table to store: one row per operator, play, month and commodity."""
    return production.groupBy(*GRAIN).agg(
        F.kll_sketch_agg_double("production", QUANTILE_SIZE).alias("volumes"),
        F.hll_sketch_agg("api_number", COUNT_BITS).alias("wells"),
        F.count("production").alias("reports"),
    )


def roll_up(sketches: DataFrame, *keys) -> DataFrame:
    """Merge the rows of ``production_sketches``; ``keys`` are names or columns."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("volumes").alias("volumes"),
        F.hll_union_agg("wells").alias("wells"),
        F.sum("reports").alias("reports"),
    )


def estimates(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """Percentiles of the volume, and the number of wells, in place of the sketches."""
    found = {name: _quantile("volumes", p) for name, p in points.items()}
    return sketches.withColumns(found).withColumn("wells", F.hll_sketch_estimate("wells")).drop("volumes")

"""Joins over time without a range condition in the plan: as-of and interval overlap.

**As-of.** The last version that is valid at a fact's time comes from a union of facts and
versions and one window.  The window is partitioned by key and time slice, so that a key with a
third of all rows is spread over its slices; the version that is valid when a slice starts is
carried in from the slices before, which needs one row per key and slice only.

**Overlap.** Every interval gets a level, the smallest power of two of the bucket width that is
no shorter than itself, and stands at this and every higher level in the buckets it touches: at
most two a level.  Two intervals meet at the higher one of their levels, in the bucket where the
later one of them starts, so every pair comes out exactly once, however long an interval is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 24  # bucket widths from 1 to 2**23 times the base width


def asof_join(facts: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str, columns: list[str], slice_of=None) -> DataFrame:
    """``facts`` with ``columns`` of the last version of their key with ``valid_from <= at``.

    Facts without such a version, or with a null key or time, keep null columns; versions with a null key or
    time are never valid.  Of versions with the same key and time the greatest one by
    ``columns`` counts.  ``slice_of`` maps a time column to its slice (by default the year) and
    must not decrease with time.
    """
    slice_of = slice_of or F.year
    version = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
    known = versions.filter(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).groupBy(
        F.col(key).alias("_key"), F.col(valid_from).alias("_at")
    ).agg(F.max(version).alias("_version")).withColumn("_slice", slice_of(F.col("_at")))
    rows = facts.select(
        F.col(key).alias("_key"), F.col(at).alias("_at"), slice_of(F.col(at)).alias("_slice"), F.struct(*[F.col(f"`{c}`") for c in facts.columns]).alias("_fact")
    )
    # one row per key and slice: the last version in it, and whether facts are in it
    last = known.groupBy("_key", "_slice").agg(F.max_by("_version", "_at").alias("_last"))
    wanted = rows.filter(F.col("_slice").isNotNull()).groupBy("_key", "_slice").agg(F.lit(True).alias("_wanted"))
    nothing = F.lit(None).cast(last.schema["_last"].dataType)
    slices = last.withColumn("_wanted", F.lit(None).cast("boolean")).unionByName(wanted.withColumn("_last", nothing))
    slices = slices.groupBy("_key", "_slice").agg(F.max("_last").alias("_last"), F.max("_wanted").alias("_wanted"))
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("_version", F.last("_last", ignorenulls=True).over(before)).filter("_wanted AND _version IS NOT NULL")
    # carried versions come first, then by time, versions before the facts of the same time
    no_fact = F.lit(None).cast(rows.schema["_fact"].dataType)
    no_time = F.lit(None).cast(rows.schema["_at"].dataType)
    line = (
        carried.select("_key", "_slice", no_time.alias("_at"), F.lit(0).alias("_kind"), "_version", no_fact.alias("_fact"))
        .unionByName(known.select("_key", "_slice", "_at", F.lit(1).alias("_kind"), "_version", no_fact.alias("_fact")))
        .unionByName(rows.select("_key", "_slice", "_at", F.lit(2).alias("_kind"), nothing.alias("_version"), "_fact"))
    )
    so_far = Window.partitionBy("_key", "_slice").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    valid = F.when(F.col("_at").isNotNull() & F.col("_key").isNotNull(), F.last("_version", ignorenulls=True).over(so_far))
    joined = line.withColumn("_valid", valid).filter("_fact IS NOT NULL")
    return joined.select("_fact.*", *[F.col(f"_valid._{i}").alias(c) for i, c in enumerate(columns)])


def _buckets(df: DataFrame, start: Column, end: Column, width: int, side: str) -> DataFrame:
    """The rows of ``df`` at their own and every higher level, once per bucket there."""
    size = F.greatest(end - start, F.lit(1).cast("bigint"))
    # the number of times the width doubles until it is no shorter than the interval
    level = F.aggregate(
        F.sequence(F.lit(0), F.lit(LEVELS - 2)), F.lit(0), lambda found, i: F.when(size > width * F.pow(F.lit(2.0), i), i + 1).otherwise(found)
    )
    rows = df.withColumn(f"_{side}_own", level).withColumn("_level", F.explode(F.sequence(F.col(f"_{side}_own"), F.lit(LEVELS - 1))))
    span = F.lit(width) * F.expr("shiftleft(1L, _level)")
    return rows.withColumn("_bucket", F.explode(F.sequence(F.floor(start / span), F.floor((end - 1) / span))))


def overlap_join(left: DataFrame, right: DataFrame, key: str, left_interval: tuple[str, str], right_interval: tuple[str, str], width: int = 32) -> DataFrame:
    """Pairs of rows of the same key whose half-open date intervals ``[start, end)`` overlap.

    Columns of both sides must have different names, but for ``key``.  Rows with a null key or
    bound, or that end before they start, overlap nothing; an empty interval neither.  ``width``
    is the smallest bucket in days.
    """

    def days(column: str) -> Column:
        return F.unix_date(F.col(column)).cast("bigint")

    def side(df: DataFrame, interval: tuple[str, str], name: str) -> DataFrame:
        start, end = (days(c) for c in interval)
        rows = df.filter(F.col(key).isNotNull() & (end > start)).withColumn(f"_{name}_start", start).withColumn(f"_{name}_end", end)
        return _buckets(rows, F.col(f"_{name}_start"), F.col(f"_{name}_end"), width, name)

    one, other = side(left, left_interval, "left"), side(right, right_interval, "right")
    met = one.join(other, [key, "_level", "_bucket"])
    later = F.greatest("_left_start", "_right_start")
    span = F.lit(width) * F.expr("shiftleft(1L, _level)")
    once = (F.col("_level") == F.greatest("_left_own", "_right_own")) & (F.col("_bucket") == F.floor(later / span))
    overlapping = (F.col("_left_start") < F.col("_right_end")) & (F.col("_right_start") < F.col("_left_end"))
    return met.filter(once & overlapping).select(*left.columns, *[c for c in right.columns if c != key])

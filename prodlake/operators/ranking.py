"""Ranks and percentiles over a whole table without gathering it in one task.

A window without ``partitionBy`` would move every row to one task.  Instead approximate
quantiles of the stored values cut them into ranges, as many as the session has shuffle
partitions.  The distinct values of a range are counted (combining map-side, so ties cost
nothing), ranked inside it and shifted by the number of rows in the ranges before.  The cuts
only balance the work: any cuts give the same result, and there is one path for all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlake.session import stored


def _range_of(stable: DataFrame, column: str) -> Column:
    """The number of the range a value falls into, ascending.

    The cut points (one number a range) come to the driver once and go into the plans as a
    literal, so every plan cuts at the same places.
    """
    ranges = int(stable.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = [i / ranges for i in range(1, ranges)]
    cuts = points and stable.agg(F.percentile_approx(column, F.lit(points), F.lit(100 * ranges))).first()[0]
    return F.size(F.filter(F.lit(sorted(set(cuts or [])) or [0.0]), lambda cut: cut < F.col(column)))


def value_offsets(stable: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Distinct non-null values with ``n`` rows each and ``before`` rows ahead of them.

    ``stable`` is read more than once and has to give the same rows each time.
    """
    known = stable.where(F.col(column).isNotNull()).withColumn("_range", _range_of(stable, column))
    order = F.col(column).desc() if descending else F.col(column).asc()
    values = known.groupBy("_range", column).agg(F.count("*").alias("n"))
    # one entry a range
    sizes = known.groupBy("_range").agg(F.count("*").alias("_size")).agg(F.collect_list(F.struct("_range", "_size")).alias("_all"))

    def ahead(own: Column) -> Column:
        others = F.filter("_all", lambda o: o["_range"] > own["_range"] if descending else o["_range"] < own["_range"])
        return F.aggregate(others, F.lit(0).cast("bigint"), lambda total, o: total + o["_size"])

    starts = sizes.select(F.inline(F.transform("_all", lambda s: F.struct(s["_range"].alias("_of"), ahead(s).alias("_start")))))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(starts, F.col("_range") == F.col("_of")).select(column, "n", (F.col("_start") + F.col("_inside")).alias("before"))


def global_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """``rank()`` by ``column`` descending over the whole table; nulls last, tied.

    Stores ``df`` when called, as it is read twice and sums of doubles may differ in between.
    """
    stable = stored(df, "ranked")
    places = value_offsets(stable, column, descending=True).select(F.col(column).alias("_value"), "before")
    known = F.coalesce(stable.agg(F.count(column)).scalar(), F.lit(0))
    return stable.join(places, F.col(column) == F.col("_value"), "left").select(
        *stable.columns, (F.coalesce("before", known) + 1).cast("int").alias(out)
    )


def percentiles_of(stable: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles of a stored table: one row, one column per point."""
    offsets = value_offsets(stable, column)
    rows = stable.agg(F.count(column)).scalar()

    def value_at(position: Column) -> Column:
        holds = (F.col("before") <= position) & (F.col("before") + F.col("n") > position)
        return F.max(F.when(holds, F.col(column)))

    found = {}
    for name, p in points.items():
        position = (rows - 1) * F.lit(float(p))
        lower = F.floor(position)
        weight = position - lower
        upper = F.least(lower + 1, rows - 1)
        found[name] = value_at(lower) * (1 - weight) + value_at(upper) * weight
    return offsets.agg(*[value.alias(name) for name, value in found.items()])


def percentiles(df: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """``percentiles_of`` any table; its column is stored when called."""
    return percentiles_of(stored(df.select(column), "values"), column, points)

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prodlake.operators import ranking


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, v double")


def skewed(n=3000):
    """A third ties, a third nulls, the rest spread over many magnitudes."""
    draw = random.Random(1)
    return [7.0] * (n // 3) + [None] * (n // 3) + [10 ** draw.uniform(-3, 9) for _ in range(n // 3)]


@pytest.mark.parametrize("ranges", ["1", "8", "70"])
def test_ranges_equal_a_plain_window(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep the ranges apart
    try:
        data = frame(spark, skewed()).repartition(6)
        spread = ranking.global_rank(data, "v", "r")
        plain = data.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc_nulls_last())))
        assert dict(spread.dtypes)["r"] == dict(plain.dtypes)["r"]
        assert sorted(map(tuple, spread.select("id", "r").collect())) == sorted(
            map(tuple, plain.select("id", "r").collect())
        )
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rank_of_ties_and_nulls(spark):
    got = ranking.global_rank(frame(spark, [3.0, 3.0, 1.0, None, None]), "v", "r")
    assert [r.r for r in got.orderBy("id").collect()] == [1, 1, 3, 4, 4]
    got = ranking.global_rank(frame(spark, [None, None]), "v", "r")
    assert [r.r for r in got.collect()] == [1, 1]
    assert ranking.global_rank(frame(spark, [1.0]).limit(0), "v", "r").count() == 0


def test_no_window_over_one_partition(spark):
    data = frame(spark, skewed(300))
    for made in (ranking.value_offsets(data, "v"), ranking.global_rank(data, "v", "r"), ranking.percentiles(data, "v", {"p": 0.5})):
        lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Window [" in line:
                below = next(x for x in lines[i:] if "Exchange" in x or "Scan" in x)
                assert "SinglePartition" not in below


@pytest.mark.parametrize("values", [[1.0, 2.0, 7.0, 11.0, 20.0], [5.0], [4.0] * 10, [v for v in skewed(600) if v]])
def test_percentiles_interpolate(spark, values):
    points = {"p33": 0.33, "p50": 0.5, "p67": 0.67, "p0": 0.0, "p100": 1.0}
    got = ranking.percentiles(frame(spark, [*values, None]), "v", points).first()
    for name, p in points.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_percentiles_of_nothing(spark):
    assert ranking.percentiles(frame(spark, [None]), "v", {"p": 0.5}).first()["p"] is None

import datetime as dt

from pyspark.sql import functions as F

from helpers import fields, rows
from prodlake import schemas
from prodlake.operators import clean

RAW = (
    "api_number string, well_name string, operator string, production_month string, "
    "oil_and_gas_group string, production string, shale_play string, basin string"
)


def raw(spark, *cases):
    base = {
        "api_number": "w1", "well_name": "n", "operator": "OP", "production_month": "2020-01-01",
        "oil_and_gas_group": "O", "production": "1", "shale_play": "P", "basin": "B",
    }
    return spark.createDataFrame([tuple({**base, **c}.values()) for c in cases], RAW)


def wells(spark, *data):
    return spark.createDataFrame(
        [(*d, dt.datetime(2024, 1, 1)) for d in data],
        "api_number string, well_name string, well_length_ft double, load_timestamp timestamp",
    )


def test_bad_rows_are_dropped(spark):
    frame = raw(
        spark,
        {"production": "abc"}, {"production": "1,234"}, {"production": "-1"}, {"production": None},
        {"production_month": "2020-13-45"}, {"production_month": "2020-1-1"},
        {"api_number": None}, {"operator": None},
        {"production": "0", "api_number": "zero"},
        {"operator": " hess ", "api_number": "padded"}, {"operator": " ", "api_number": "blank"},
    )
    got = rows(clean.clean_production(frame), "api_number", "operator", "production")
    assert got == [("blank", "", 1.0), ("padded", "HESS", 1.0), ("zero", "OP", 0.0)]


def test_duplicates_keep_the_same_row_whatever_the_order(spark):
    cases = [{"production": str(p), "well_name": n} for p, n in ((5, "b"), (3, "b"), (9, "a"), (1, None))]
    frame = raw(spark, *cases)
    for ordered in (frame, frame.orderBy(F.desc("production")), frame.repartition(5)):
        assert rows(clean.clean_production(ordered), "well_name", "production") == [(None, 1.0)]


def test_a_hot_key_is_reduced_before_the_shuffle(spark):
    """A third of the rows are copies of one key."""
    many = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("api_number"),
        (F.col("id") % 97).cast("string").alias("squarerootsum"),
        F.lit("name").alias("well_name"),
        F.lit("2024-01-01").cast("timestamp").alias("load_timestamp"),
    )
    got = clean.clean_wells(many)
    assert got.count() == 20_001
    assert got.where("api_number = 'hot'").first().well_length_ft == 0.0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange")  # below the exchange


def test_flaring_accepts_thousands_commas(spark):
    frame = spark.createDataFrame(
        [(" hess ", "1,234", None), ("HESS", "1,200.5", None), ("X", "pending", None), (None, "5", None)],
        "operator string, totalflaredgas_mcf string, load_timestamp timestamp",
    )
    got = clean.clean_flaring(frame)
    assert fields(got.schema) == fields(schemas.SILVER_FLARING)
    assert rows(got, "operator", "total_flared_gas_mcf") == [("HESS", 1200.5)]


def test_enrichment_keeps_wells_without_metadata(spark):
    facts = clean.clean_production(
        raw(
            spark,
            {"api_number": "known", "well_name": None}, {"api_number": "unknown", "well_name": "own"},
            {"api_number": "both", "well_name": "fact", "production_month": "2021-12-01"},
        )
    )
    got = clean.enrich_production(facts, wells(spark, ("known", "meta", 9.5), ("both", "meta", 1.0)))
    assert fields(got.schema) == fields(schemas.SILVER_PRODUCTION)
    assert rows(got, "api_number", "well_name", "well_length_ft", "production_year", "production_quarter") == [
        ("both", "fact", 1.0, 2021, "Q4"), ("known", "meta", 9.5, 2020, "Q1"),
        ("unknown", "own", None, 2020, "Q1"),
    ]


def test_unreadable_lengths_keep_the_well(spark):
    frame = spark.createDataFrame(
        [("n/a", "name", "w", None), ("7", "x", None, None)],
        "squarerootsum string, well_name string, api_number string, load_timestamp timestamp",
    )
    assert rows(clean.clean_wells(frame), "api_number", "well_length_ft") == [("w", None)]

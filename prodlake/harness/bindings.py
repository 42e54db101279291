"""The data model read from the supplied tables.

well = supplier, operator = nation, play and basin = region, commodity = line status,
month = month of shipping, production = extended price, well length = account balance,
flared gas = a tenth of the urgent order value by customer nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlake.functions import decline, expr
from prodlake.sources import tables
from prodlake.sources.feeds import sanitize_columns

START_MONTH = "1995-01-01"
LOAD_TIME = "2024-01-01 00:00:00"


# Column types of the supplied tables; naming them saves a job per table that would read
# a file footer only to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.scan_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def _month() -> Column:
    return F.trunc(F.col("l_shipdate").cast("date"), "month")


def _commodity() -> Column:
    return F.when(F.col("l_linestatus") == "O", "O").otherwise("G")


def _wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per well with its operator and play."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return table(spark, sf_dir, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )


TASK_BYTES = 8 << 20  # of the file of line items for one task that sums them by well and month


def _shipped(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Line items with their month; ``dealt`` out by well and month for sums over all of them.

    A well has hardly two line items of a month in one split of the file, so sums before the shuffle
    hold nearly every row of a split in memory, and spill it, to send as many rows on.  The number of
    tasks follows the bytes of the file: adaptive execution would merge tasks up to its advisory size.
    """
    items = table(spark, sf_dir, "lineitem").withColumn("month", _month())
    if not dealt:
        return items
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    columns = ["l_suppkey", "l_linestatus", "l_returnflag", "l_extendedprice", "month"]
    return items.select(*columns).repartition(tasks, "l_suppkey", "month")


def production(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Clean production: one row per well, month and commodity.

    Line items are summed before the well attributes are joined on.
    """
    monthly = (
        _shipped(spark, sf_dir, dealt)
        .groupBy("l_suppkey", F.col("month").alias("production_month"), "l_linestatus")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("production"))
    )
    return monthly.join(
        _wells(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        F.col("l_suppkey").cast("string").alias("api_number"),
        F.col("s_name").alias("well_name"),
        F.col("n_name").alias("operator"),
        "production_month",
        F.year("production_month").alias("production_year"),
        expr.quarter_label("production_month").alias("production_quarter"),
        _commodity().alias("oil_and_gas_group"),
        "production",
        F.col("r_name").alias("shale_play"),
        F.col("r_name").alias("basin"),
        F.col("s_acctbal").alias("well_length_ft"),
    )


def _orders_by_nation(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0.0)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", *keys)
        .agg(F.round(F.sum(urgent), 2).alias("volume"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def flaring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators with flared volume; region names stand for operators without gas."""
    flared = _orders_by_nation(spark, sf_dir).select(
        F.col("n_name").alias("operator"),
        F.round(F.col("volume") * 0.1, 2).alias("total_flared_gas_mcf"),
    )
    without_gas = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("operator"),
        ((F.col("r_regionkey") + 1) * 1000.0).alias("total_flared_gas_mcf"),
    )
    return flared.unionByName(without_gas)


# --- raw feeds: every value text, with the defects the cleaning has to handle -----------


def raw_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per business key (one per return flag), some of them defective:

    thousands commas and slashed dates on flag R, negative volumes in March on flag N,
    missing well names on flag A, padded lower-case operators on flag R.
    """
    flag, month, amount = F.col("l_returnflag"), F.col("month"), F.col("amount")
    monthly = (
        _shipped(spark, sf_dir, dealt=True)
        .groupBy("l_suppkey", "month", "l_linestatus", "l_returnflag")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
        .withColumn("amount", F.col("value").cast("decimal(18,2)"))
    )
    text = (
        F.when((flag == "R") & (amount >= 100000), F.format_number(amount, 2))
        .when((flag == "N") & (F.month(month) == 3), F.concat(F.lit("-"), amount.cast("string")))
        .otherwise(amount.cast("string"))
    )
    pattern = F.when((flag == "R") & (F.month(month) == 7), F.date_format(month, "yyyy/MM/dd"))
    return monthly.join(
        _wells(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")
    ).select(
        F.col("l_suppkey").cast("string").alias("api_number"),
        F.when(flag != "A", F.col("s_name")).alias("well_name"),
        F.when(flag == "R", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
        .otherwise(F.col("n_name"))
        .alias("operator"),
        F.coalesce(pattern, F.date_format(month, "yyyy-MM-dd")).alias("production_month"),
        _commodity().alias("oil_and_gas_group"),
        text.alias("production"),
        F.col("r_name").alias("shale_play"),
        F.col("r_name").alias("basin"),
    )


def raw_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable lengths where negative, a second row for rich wells, no id for the poorest."""
    wells = table(spark, sf_dir, "supplier")
    api_number = F.when(F.col("s_acctbal") > -800, F.col("s_suppkey").cast("string"))
    balance = F.col("s_acctbal").cast("decimal(18,2)")
    first = wells.select(
        F.when(F.col("s_acctbal") < 0, "n/a").otherwise(balance.cast("string")).alias("SquareRootSum"),
        F.col("s_name").alias("Well Name"),
        api_number.alias("API Number"),
    )
    second = wells.filter(F.col("s_acctbal") >= 5000).select(
        (balance + F.lit(1000).cast("decimal(18,2)")).cast("string").alias("SquareRootSum"),
        F.upper("s_name").alias("Well Name"),
        F.col("s_suppkey").cast("string").alias("API Number"),
    )
    return first.unionByName(second)


def raw_flaring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per operator, volumes with thousands commas, one unreadable status."""
    status = F.col("o_orderstatus")
    by_status = _orders_by_nation(spark, sf_dir, "o_orderstatus").select(
        F.when(status == "P", F.concat(F.lit(" "), F.lower("n_name")))
        .otherwise(F.col("n_name"))
        .alias("Operator"),
        F.when(status == "F", "pending")
        .otherwise(F.format_number(F.col("volume").cast("decimal(18,2)"), 2))
        .alias("TotalFlaredGas_MCf"),
    )
    regions = table(spark, sf_dir, "region").select(
        F.when(F.col("r_name") != "ASIA", F.col("r_name")).alias("Operator"),
        F.format_number((F.col("r_regionkey") + 1) * 1000, 2).alias("TotalFlaredGas_MCf"),
    )
    return by_status.unionByName(regions)


def raw_operator_well_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wells(spark, sf_dir).groupBy(F.col("n_name").alias("Reported Operator")).agg(
        F.count("*").cast("string").alias("UniqueOperatorCount")
    )


def raw_shale_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = (
        production(spark, sf_dir, dealt=True)
        .groupBy("shale_play", "production_month", "oil_and_gas_group")
        .agg(F.sum("production").cast("decimal(18,2)").alias("total"))
    )
    return totals.select(
        F.col("shale_play").alias("Shale Plays"),
        F.date_format("production_month", "yyyy-MM").alias("Month"),
        F.col("oil_and_gas_group").alias("OilAndGasGroup"),
        F.col("total").cast("string").alias("Total Production"),
        F.when(F.col("oil_and_gas_group") == "O", "1").alias("Rank"),
    )


RAW_FEEDS = {
    "bronze_flaring": raw_flaring,
    "bronze_operator_well_counts": raw_operator_well_counts,
    "bronze_shale_production": raw_shale_production,
    "bronze_well_metadata": raw_wells,
    "bronze_well_production": raw_production,
}


def landed(raw: DataFrame) -> DataFrame:
    """A raw table as the cleaning sees it, with a fixed load time."""
    return sanitize_columns(raw).withColumn("load_timestamp", F.lit(LOAD_TIME).cast("timestamp"))


# --- noise-free decline series -----------------------------------------------------------


def decline_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per well ``qi`` from the logarithm of its balance; ``di`` and ``b`` by play only.

    The logarithm keeps values off rounding ties.  Sums over an operator or a play are then exact curves of the same family, so the
    true forecast of every level is known in closed form.
    """
    region = F.col("r_regionkey")
    return _wells(spark, sf_dir).select(
        F.col("s_suppkey").cast("string").alias("api_number"),
        F.col("s_name").alias("well_name"),
        F.col("n_name").alias("operator"),
        F.col("r_name").alias("shale_play"),
        F.col("r_name").alias("basin"),
        (F.log(F.col("s_acctbal") + 1100) * 1000).alias("qi"),
        (F.lit(0.03) + F.lit(0.02) * region).alias("di"),
        F.when(region == 0, 0.0).when(region == 4, 1.0).otherwise(0.1 + 0.2 * region).alias("b"),
    )


def last_month_position(spark: SparkSession, sf_dir: str) -> Column:
    """Position of the last shipping month, as a scalar subquery."""
    shipped = F.col("l_shipdate").cast("date")
    return (
        table(spark, sf_dir, "lineitem")
        .agg(F.max((F.year(shipped) - 1995) * 12 + F.month(shipped) - 1).alias("t"))
        .scalar()
    )


def decline_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oil and gas rows that follow the curves exactly, over all months of the data.

    A well of a few bytes becomes a row per month and commodity, so wells are dealt out by number
    first: as many as fit one split of a file would give one task all months of all of them.
    """
    model = (
        F.when(F.col("b") == 0, "exponential").when(F.col("b") == 1, "harmonic").otherwise("hyperbolic")
    )
    months = F.sequence(F.lit(0), last_month_position(spark, sf_dir))
    rate = decline.curve(model, F.col("t").cast("double"), F.col("qi"), F.col("di"), F.col("b"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: adaptive execution would merge them by bytes
    expanded = (
        decline_parameters(spark, sf_dir)
        .repartition(tasks, "api_number")
        .withColumn("t", F.explode(months))
        .withColumn("rate", rate)
        .withColumn("production_month", F.add_months(F.lit(START_MONTH).cast("date"), F.col("t")))
    )
    return expanded.select(
        "api_number", "well_name", "operator", "production_month", "shale_play", "basin",
        F.inline(
            F.array(
                F.struct(F.lit("O").alias("oil_and_gas_group"), F.col("rate").alias("production")),
                F.struct(
                    F.lit("G").alias("oil_and_gas_group"),
                    (F.col("rate") * 4).alias("production"),
                ),
            )
        ),
    )

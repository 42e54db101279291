"""Aggregates behind the portfolio, trend, flaring and forecast reports.

Unlike the KPI tables these leave out null keys and treat the sum of nothing as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodlake.functions import expr
from prodlake.functions.expr import GAS, OIL, commodity_value
from prodlake.operators.ranking import percentiles, percentiles_of
from prodlake.session import stored

ENTITY_KEY = {"well": "api_number", "operator": "operator", "basin": "shale_play"}

# Fixed value: the columns shown, in this order.
PORTFOLIO_COLUMNS = [
    "well_name", "operator", "shale_play", "basin", "first_production_month",
    "last_production_month", "cumulative_oil_bbl", "cumulative_gas_mcf",
    "peak_oil_production", "active_months",
]
_HUMANIZED = {"cumulative_oil_bbl", "cumulative_gas_mcf", "peak_oil_production"}


def total(value: str | Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


# --- portfolio ---------------------------------------------------------------


def portfolio_kpis(production: DataFrame) -> DataFrame:
    """Oil and gas totals, operators with either and wells with oil: one pass over the facts.

    The facts are first summed per operator and well, so the distinct counts do not multiply them.
    """
    pairs = production.filter(F.col("oil_and_gas_group").isin(OIL, GAS)).groupBy("operator", "api_number").agg(
        F.sum(commodity_value(OIL)).alias("oil"),
        F.sum(commodity_value(GAS)).alias("gas"),
        F.count_if(F.col("oil_and_gas_group") == OIL).alias("oil_rows"),
    )
    return pairs.agg(
        total("oil").alias("total_oil"),
        total("gas").alias("total_gas"),
        F.count_distinct("operator").alias("n_operators"),
        F.count_distinct(F.when(F.col("oil_rows") > 0, F.col("api_number"))).alias("n_wells"),
    )


def top_n(df: DataFrame, column: str, n: int, key: str) -> DataFrame:
    """The ``n`` largest rows, smallest first (the order of a horizontal bar chart)."""
    largest = df.dropna(subset=[column]).orderBy(F.col(column).desc(), key).limit(n)
    return largest.orderBy(F.col(column).asc(), F.col(key).desc())


def wells_per_play(wells: DataFrame) -> DataFrame:
    return (
        wells.dropna(subset=["shale_play"])
        .groupBy("shale_play")
        .agg(F.count("api_number").alias("wells"))
    )


def oil_gas_mix(performance: DataFrame) -> DataFrame:
    """Operators with both commodities."""
    return performance.dropna(subset=["total_oil_bbl", "total_gas_mcf"]).select(
        "operator", "total_oil_bbl", "total_gas_mcf", "well_count", "flaring_intensity_ratio"
    )


def well_portfolio(wells: DataFrame) -> DataFrame:
    """The display columns that exist, volumes as short text, headings in title case."""
    return wells.select(
        [
            (expr.humanize(F.col(c)) if c in _HUMANIZED else F.col(c)).alias(
                c.replace("_", " ").title()
            )
            for c in PORTFOLIO_COLUMNS
            if c in wells.columns
        ]
    )


# --- trends ------------------------------------------------------------------


def trend_slice(trends: DataFrame, plays: list[str], groups: list[str]) -> DataFrame:
    return trends.filter(
        F.col("shale_play").isin(plays) & F.col("oil_and_gas_group").isin(groups)
    ).orderBy("production_month")


def growth_series(trends: DataFrame, column: str) -> DataFrame:
    return (
        trends.dropna(subset=[column])
        .select("shale_play", "oil_and_gas_group", "production_month", column)
        .orderBy("production_month")
    )


def quarter_matrix(production: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Oil per year (rows) and year-qualified quarter (columns), 0 where there is none.

    The columns are the quarters that have oil (their labels, bounded by the calendar, reach
    the driver) unless the caller names them.  The facts are read once either way: the quarterly
    sums are stored before their labels are looked up.
    """
    quarterly = (
        production.filter(F.col("oil_and_gas_group") == OIL)
        .groupBy(
            F.year("production_month").alias("production_year"),
            expr.period_label("production_month").alias("period"),
        )
        .agg(F.sum("production").alias("production"))
    )
    if labels is None:
        quarterly = stored(quarterly, "quarterly")
    return quarterly.groupBy("production_year").pivot("period", labels).agg(F.sum("production")).fillna(0)


def entity_history(production: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """Monthly oil and gas of one entity; both columns always exist."""
    return (
        production.filter(F.col(ENTITY_KEY[entity_type]) == entity_id)
        .groupBy("production_month")
        .agg(
            total(commodity_value(OIL)).alias("oil_production"),
            total(commodity_value(GAS)).alias("gas_production"),
        )
        .orderBy("production_month")
    )


def operator_drilldown(production: DataFrame, operator: str) -> DataFrame:
    return (
        production.filter(F.col("operator") == operator)
        .groupBy("production_month", "oil_and_gas_group")
        .agg(total("production").alias("production"))
        .orderBy("production_month", "oil_and_gas_group")
    )


# --- flaring -----------------------------------------------------------------


FLARING_POINTS = {"p33": 0.33, "p50": 0.5, "p67": 0.67}


def flaring_percentiles(flaring: DataFrame, points: dict[str, float] | None = None) -> DataFrame:
    return percentiles(flaring, "total_flared_gas_mcf", points or {"p33": 0.33, "p67": 0.67})


def volume_tier(flaring: DataFrame) -> DataFrame:
    """Adds the volume tier by percentile thresholds of the whole table, and the median.

    The input is stored once: thresholds and rows then come from the same numbers, and a row
    that is itself the threshold keeps its tier in every run.
    """
    stable = stored(flaring, "flaring")
    cuts = percentiles_of(stable, "total_flared_gas_mcf", FLARING_POINTS)
    low, median, high = (cuts.select(p).scalar() for p in FLARING_POINTS)
    tier = expr.percentile_tier(F.col("total_flared_gas_mcf"), low, high)
    return stable.withColumn("volume_category", tier).withColumn("_median", median)


def flaring_kpis(tiered: DataFrame) -> DataFrame:
    """Totals, the largest flarer, the median and the number of High-volume operators."""
    volume = F.col("total_flared_gas_mcf")
    top = F.min(F.when(volume.isNotNull(), F.struct((-volume).alias("minus"), "operator")))
    return tiered.agg(
        total(volume).alias("total_flared"),
        F.max(volume).alias("top_flared_volume"),
        top["operator"].alias("top_flarer"),
        F.count("*").alias("n_operators"),
        F.count_if(F.col("volume_category") == "High").alias("n_high"),
        F.max("_median").alias("median_flared"),
    ).withColumn("top_flarer_label", expr.title_case(F.col("top_flarer")))


def tier_distribution(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("volume_category").agg(F.count("*").alias("operators"))


def tier_summary(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("volume_category").agg(
        F.count("operator").alias("operators"),
        total("total_flared_gas_mcf").alias("total_flared"),
        F.avg("total_flared_gas_mcf").alias("avg_flared"),
    )


def tier_report(summary: DataFrame) -> DataFrame:
    """The tier summary as shown: volumes as short text."""
    return summary.select(
        F.col("volume_category").alias("Tier"),
        F.col("operators").alias("# Operators"),
        expr.humanize(F.col("total_flared")).alias("Total Flared"),
        expr.humanize(F.col("avg_flared")).alias("Avg per Operator"),
    )


def commodity_split_top_n(ethane: DataFrame, n: int = 14) -> DataFrame:
    """Operators with the largest liquid plus dry total."""
    return (
        ethane.dropna(subset=["operator"])
        .groupBy("operator")
        .agg(
            total("liquid_rich_production").alias("liquid_rich_production"),
            total("dry_gas_production").alias("dry_gas_production"),
        )
        .withColumn("total", F.col("liquid_rich_production") + F.col("dry_gas_production"))
        .orderBy(F.col("total").desc(), "operator")
        .limit(n)
    )


def liquid_share_by_year(ethane: DataFrame) -> DataFrame:
    yearly = (
        ethane.dropna(subset=["production_year"])
        .groupBy("production_year")
        .agg(
            total("liquid_rich_production").alias("liquid_rich_production"),
            total("dry_gas_production").alias("dry_gas_production"),
        )
    )
    share = expr.share_pct(F.col("liquid_rich_production"), F.col("dry_gas_production"))
    return yearly.withColumn("liquid_rich_pct", share)


# --- forecasts ---------------------------------------------------------------


def _entities(forecast: DataFrame) -> DataFrame:
    """One row per forecast entity; its fit columns are the same on all of its rows."""
    return forecast.groupBy("entity_type", "entity_id").agg(
        F.max("model_type").alias("model_type"),
        F.max("r2_score").alias("r2_score"),
        F.count("*").alias("rows"),
        F.count_if(F.col("model_type") == "hyperbolic").alias("hyperbolic_rows"),
        F.min("forecast_month").alias("first_month"),
        F.max("forecast_month").alias("last_month"),
    )


def forecast_kpis(forecast: DataFrame) -> DataFrame:
    """Mean fit over entities, hyperbolic share over rows, entity counts, horizon."""

    def entities_of(kind: str) -> Column:
        return F.count_if(F.col("entity_type") == kind)

    return _entities(forecast).agg(
        F.avg("r2_score").alias("avg_r2"),
        (F.sum("hyperbolic_rows") / F.sum("rows") * 100).alias("pct_hyperbolic"),
        entities_of("well").alias("n_wells"),
        entities_of("operator").alias("n_operators"),
        entities_of("basin").alias("n_basins"),
        expr.month_year(F.max("last_month")).alias("horizon"),
    )


def forecast_slice(forecast: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """One entity's forecast in month order with its first forecast month."""
    chosen = forecast.filter(
        (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)
    )
    whole = Window.partitionBy("entity_type", "entity_id")  # one row per forecast month
    start = F.min("forecast_month").over(whole)
    return chosen.withColumn("forecast_start", start).orderBy("forecast_month")


def model_mix(forecast: DataFrame) -> DataFrame:
    return (
        _entities(forecast)
        .dropna(subset=["model_type"])
        .groupBy("entity_type", "model_type")
        .agg(F.count("*").alias("entities"))
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    return (
        forecast.dropna(subset=["entity_type", "entity_id", "model_type", "r2_score"])
        .groupBy("entity_type", "entity_id", "model_type", "r2_score")
        .agg(
            total("forecast_oil_bbl").alias("forecast_oil_bbl"),
            total("forecast_gas_mcf").alias("forecast_gas_mcf"),
        )
        .orderBy("entity_type", F.col("forecast_oil_bbl").desc(), "entity_id")
    )


def forecast_report(summary: DataFrame) -> DataFrame:
    """The forecast summary as shown: volumes as short text, four decimals of the fit."""
    return summary.select(
        F.col("entity_type").alias("Type"),
        F.col("entity_id").alias("Entity"),
        F.col("model_type").alias("Model"),
        expr.fixed_point(F.col("r2_score"), 4).alias("R²"),
        expr.humanize(F.col("forecast_oil_bbl")).alias("Forecast Oil"),
        expr.humanize(F.col("forecast_gas_mcf")).alias("Forecast Gas"),
    )


def model_card(forecast: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """Model, fit quality, initial rate and decline of one entity, as text."""
    first = forecast_slice(forecast, entity_type, entity_id).limit(1)
    return first.select(
        expr.title_case(F.col("model_type")).alias("model"),
        expr.fixed_point(F.col("r2_score"), 4).alias("r2_score"),
        expr.humanize(F.col("qi")).alias("initial_rate"),
        F.concat(expr.fixed_point(F.col("di"), 4), F.lit("/month")).alias("decline_rate"),
    )


def operator_forecast_top(forecast: DataFrame, n: int = 12) -> DataFrame:
    totals = (
        forecast.filter(F.col("entity_type") == "operator")
        .groupBy("entity_id")
        .agg(total("forecast_oil_bbl").alias("forecast_oil_bbl"))
    )
    return top_n(totals, "forecast_oil_bbl", n, "entity_id")


def well_fit_quality(forecast: DataFrame) -> DataFrame:
    return _entities(forecast).filter(F.col("entity_type") == "well").select("entity_id", "r2_score")


def r2_histogram(quality: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, empty bins included.

    The last bin is closed.  If all values agree the range is one unit around them.
    """
    scores = quality.dropna(subset=["r2_score"])
    equal = F.col("low") == F.col("high")
    bounds = scores.agg(
        F.min("r2_score").alias("low"), F.max("r2_score").alias("high"),
        F.avg("r2_score").alias("mean"),
    ).select(
        F.struct(
            F.when(equal, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(equal, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
            "mean",
        )
    )
    placed = scores.select("r2_score", bounds.scalar().alias("b"))
    position = F.floor((F.col("r2_score") - F.col("b.low")) * bins / (F.col("b.high") - F.col("b.low"))).cast("int")
    inside = F.greatest(F.least(position, F.lit(bins - 1)), F.lit(0))
    counts = placed.groupBy(inside.alias("bin")).agg(F.count("*").alias("wells"))
    frame = quality.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), bounds.scalar().alias("b")
    ).withColumn("width", (F.col("b.high") - F.col("b.low")) / bins)
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("b.low") + F.col("bin") * F.col("width")).alias("bin_low"),
        (F.col("b.low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
        F.coalesce("wells", F.lit(0)).alias("wells"),
        F.col("b.mean").alias("mean_r2"),
    )

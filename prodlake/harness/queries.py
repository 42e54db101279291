"""One query per operator over the supplied tables; all whole-table.

Doubles are rounded to four decimals, because sums of doubles depend on the order of
the rows.  The text of the matching SQL is in ``oracles``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prodlake import schemas
from prodlake.functions import decline, expr
from prodlake.functions import sql as sql_functions
from prodlake.harness import bindings as bind
from prodlake.operators import clean, forecast, kpi, portfolio, quality, ranking, reconcile, sketches, temporal
from prodlake.plans import refresh, stages
from prodlake.session import scratch_path, stored
from prodlake.sources import feeds, tables
from prodlake.sources.tables import TablePaths
from prodlake.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DECIMALS = 4
ETHANE_THRESHOLD = 1.0  # the supplied tables hold about as much oil as gas
OPERATOR, PLAY, WELL = "NATION_8", "EUROPE", "8"
TOP_WELLS = 100  # of the queries whose feature it is: top_wells and forecast_wells
DI_GRID = [i / 100 for i in range(1, 16)]
B_GRID = [i / 10 for i in range(11)]


def rounded(df: DataFrame) -> DataFrame:
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(f"`{name}`", DECIMALS) for name in doubles})


def query(make: Query) -> Query:
    """Register a query under its function's name."""
    QUERIES[make.__name__] = lambda spark, sf_dir: rounded(make(spark, sf_dir))
    return make


def over_production(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(bind.production(spark, sf_dir)))


def over_kpi(name: str, source: Query, operator: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(operator(source(spark, sf_dir)))


def counts_frame(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "table_name string, row_count bigint")


# --- sources and sinks -------------------------------------------------------------------


def _write_feed(df: DataFrame, path: str) -> None:
    writer = df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)


def _feed_on_disk(spark: SparkSession, sf_dir: str, feed: feeds.Feed, folder: str) -> str:
    path = f"{folder}/{feed.file_name}"
    _write_feed(bind.RAW_FEEDS[feed.table](spark, sf_dir), path)
    return path


@query
def scan_csv_strings(spark, sf_dir):
    feed = feeds.FEEDS["bronze_well_production"]
    path = _feed_on_disk(spark, sf_dir, feed, scratch_path(spark, "raw"))
    return feeds.scan_csv_strings(spark, path)


def _ingested(table: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        feed = feeds.FEEDS[table]
        csv_path = _feed_on_disk(spark, sf_dir, feed, scratch_path(spark, "raw"))
        paths = TablePaths(scratch_path(spark, "tables"))
        feeds.ingest(spark, feed, csv_path, paths)
        landed = tables.scan_table(spark, paths.of(table))
        if feed.partition_by_load_year:
            same = F.col("ingest_year").cast("int") == F.year("load_timestamp")
            landed = landed.withColumn("ingest_year_is_load_year", same).drop("ingest_year")
        return landed.drop("load_timestamp")

    return run


for _table in feeds.FEEDS:
    QUERIES[f"ingest_{_table.removeprefix('bronze_')}"] = _ingested(_table)


@query
def write_overwrite(spark, sf_dir):
    """The second write replaces rows and schema of the first."""
    path = scratch_path(spark, "silver_flaring")
    flaring = bind.flaring(spark, sf_dir)
    tables.write_table(bind.production(spark, sf_dir), path)
    tables.write_table(flaring, path)
    return tables.scan_table(spark, path)


@query
def write_partitioned(spark, sf_dir):
    """A partitioned write, then one year rewritten alone."""
    path = scratch_path(spark, "silver_production")
    production = bind.production(spark, sf_dir)
    tables.write_table(production, path, ["production_year"], rebalance=True)
    doubled = production.filter(F.col("production_year") == 1996).withColumn(
        "production", F.col("production") * 2
    )
    tables.write_table(doubled, path, ["production_year"], rebalance=True, only_touched_partitions=True)
    stored = tables.scan_table(spark, path, schemas.SILVER_PRODUCTION)
    return stored.groupBy("production_year").agg(
        F.count("*").alias("row_count"), F.sum("production").alias("production")
    )


@query
def scan_table(spark, sf_dir):
    return tables.scan_table(spark, f"{sf_dir}/supplier.parquet")


@query
def table_counts(spark, sf_dir):
    names = ["lineitem", "nation", "orders", "region", "supplier"]
    return quality.table_counts({name: bind.table(spark, sf_dir, name) for name in names})


@query
def register_views(spark, sf_dir):
    """Stored tables as views, queried with SQL text."""
    paths = TablePaths(scratch_path(spark, "tables"))
    tables.write_table(bind.production(spark, sf_dir), paths.of("silver_production"))
    tables.write_table(bind.flaring(spark, sf_dir), paths.of("silver_flaring"))
    tables.register_views(spark, paths, ["silver_production", "silver_flaring"])
    return spark.sql(
        """SELECT p.operator, f.total_flared_gas_mcf, SUM(p.production) AS total_production
           FROM silver_production p JOIN silver_flaring f ON p.operator = f.operator
           GROUP BY p.operator, f.total_flared_gas_mcf"""
    )


@query
def load_trends_sample(spark, sf_dir):
    """The same for a table with a date column."""
    path = scratch_path(spark, "gold_basin_production_trends.csv")
    _write_feed(_trends(spark, sf_dir), path)
    return tables.read_csv_table(spark, path, schemas.GOLD_BASIN_TRENDS)


@query
def load_kpi_sample(spark, sf_dir):
    """A KPI table exported as CSV and read back with its enforced schema."""
    path = scratch_path(spark, "gold_ethane_dry_gas.csv")
    _write_feed(_ethane(spark, sf_dir), path)
    return tables.read_csv_table(spark, path, schemas.GOLD_ETHANE_DRY_GAS)


# --- cleaning ----------------------------------------------------------------------------


@query
def sanitize_columns(spark, sf_dir):
    return feeds.sanitize_columns(bind.raw_wells(spark, sf_dir))


@query
def add_lineage(spark, sf_dir):
    landed = feeds.add_lineage(bind.raw_flaring(spark, sf_dir), "flaring.csv", "public_feed")
    return landed.drop("load_timestamp")


def _raw_production(spark, sf_dir):
    return bind.landed(bind.raw_production(spark, sf_dir))


def _raw_flaring(spark, sf_dir):
    return bind.landed(bind.raw_flaring(spark, sf_dir))


def _raw_wells(spark, sf_dir):
    return bind.landed(bind.raw_wells(spark, sf_dir))


@query
def normalize_operator(spark, sf_dir):
    raw = _raw_production(spark, sf_dir)
    return raw.groupBy(expr.normalize_key("operator").alias("operator")).agg(
        F.count("*").alias("row_count")
    )


@query
def filter_not_null(spark, sf_dir):
    raw = _raw_production(spark, sf_dir).select("api_number", "well_name", "production_month")
    return clean.filter_not_null(raw, "well_name", "production_month")


@query
def filter_non_negative(spark, sf_dir):
    raw = _raw_production(spark, sf_dir).select(
        "api_number", expr.number_or_null("production").alias("production")
    )
    return clean.filter_non_negative(raw, "production")


@query
def clean_production(spark, sf_dir):
    return clean.clean_production(_raw_production(spark, sf_dir))


@query
def clean_flaring(spark, sf_dir):
    return clean.clean_flaring(_raw_flaring(spark, sf_dir)).drop("load_timestamp")


@query
def clean_wells(spark, sf_dir):
    return clean.clean_wells(_raw_wells(spark, sf_dir)).drop("load_timestamp")


@query
def enrich_production(spark, sf_dir):
    return clean.enrich_production(
        clean.clean_production(_raw_production(spark, sf_dir)),
        clean.clean_wells(_raw_wells(spark, sf_dir)),
    )


@query
def dedup_wells(spark, sf_dir):
    return clean.dedup(_raw_wells(spark, sf_dir), ["api_number"]).drop("load_timestamp")


@query
def dedup_flaring(spark, sf_dir):
    return clean.dedup(_raw_flaring(spark, sf_dir), ["operator"]).drop("load_timestamp")


@query
def dedup_production(spark, sf_dir):
    return clean.dedup(_raw_production(spark, sf_dir), clean.PRODUCTION_KEY).drop("load_timestamp")


# --- quality -----------------------------------------------------------------------------


@query
def dq_null_profile(spark, sf_dir):
    return quality.dq_null_profile(bind.raw_production(spark, sf_dir))


@query
def dq_summary(spark, sf_dir):
    return quality.dq_summary(_raw_production(spark, sf_dir))


@query
def input_profile(spark, sf_dir):
    return quality.input_profile(bind.raw_production(spark, sf_dir))


@query
def rows_per_partition(spark, sf_dir):
    return quality.rows_per(bind.production(spark, sf_dir), "production_year")


@query
def rows_per_commodity(spark, sf_dir):
    return quality.rows_per(_raw_production(spark, sf_dir), "oil_and_gas_group")


over_production("distinct_operators", lambda p: quality.distinct_values(p, "operator"))
over_production("distinct_wells", lambda p: p.select("api_number").distinct())


@query
def operator_quarterly(spark, sf_dir):
    return quality.operator_quarterly(bind.production(spark, sf_dir))


@query
def avg_yoy_growth(spark, sf_dir):
    return quality.avg_yoy_growth(_trends(spark, sf_dir))


@query
def top5_flaring_intensity(spark, sf_dir):
    return quality.top_flaring_intensity(_intensity(spark, sf_dir))


# --- KPI tables --------------------------------------------------------------------------


def _performance(spark, sf_dir):
    return kpi.operator_performance(
        kpi.operator_oil_gas(bind.production(spark, sf_dir)), bind.flaring(spark, sf_dir)
    )


def _trends(spark, sf_dir):
    return kpi.basin_production_trends(bind.production(spark, sf_dir))


def _intensity(spark, sf_dir):
    return kpi.flaring_intensity(bind.production(spark, sf_dir), bind.flaring(spark, sf_dir))


def _ethane(spark, sf_dir):
    return kpi.ethane_dry_gas(bind.production(spark, sf_dir), ETHANE_THRESHOLD)


def _summary(spark, sf_dir):
    return kpi.well_summary(bind.production(spark, sf_dir))


for _name, _table_query in {
    "operator_performance": _performance,
    "basin_production_trends": _trends,
    "flaring_intensity": _intensity,
    "ethane_dry_gas": _ethane,
    "well_summary": _summary,
}.items():
    over_kpi(_name, _table_query, lambda df: df)

over_production("filter_commodity", lambda p: clean.filter_commodity(p, "O"))
over_production("operator_oil_rollup", kpi.operator_oil_rollup)
over_production("operator_gas_rollup", kpi.operator_gas_rollup)
over_production("operator_oil_gas_outer", kpi.operator_oil_gas)
over_production("basin_monthly", kpi.basin_monthly)
over_production("basin_mom", lambda p: kpi.with_month_growth(kpi.basin_monthly(p)))
over_production("basin_yoy", lambda p: kpi.with_year_growth(kpi.basin_monthly(p)))
over_production("basin_rank", lambda p: kpi.with_month_rank(kpi.basin_monthly(p)))
over_production("well_lifetime", kpi.well_lifetime)
over_production("well_gas_total", kpi.well_gas_total)
over_production("well_peak_month", kpi.well_peak_month)
over_production(
    "operator_rank",
    lambda p: ranking.global_rank(kpi.operator_oil_gas(p), "total_oil_bbl", "production_rank").select(
        "operator", "total_oil_bbl", "production_rank"
    ),
)


@query
def flaring_rank(spark, sf_dir):
    ratio = kpi.flaring_ratio(bind.production(spark, sf_dir), bind.flaring(spark, sf_dir))
    return ranking.global_rank(ratio, "flaring_intensity_ratio", "flaring_rank").select(
        "operator", "flaring_intensity_ratio", "flaring_rank"
    )


@query
def flaring_category(spark, sf_dir):
    ratio = kpi.flaring_ratio(bind.production(spark, sf_dir), bind.flaring(spark, sf_dir))
    return ratio.select(
        "operator", expr.flaring_category(F.col("flaring_intensity_ratio")).alias("flaring_category")
    )


over_kpi(
    "basin_category", _ethane,
    lambda e: e.select(
        "operator", "production_year", "shale_play",
        expr.basin_category(F.col("ethane_dry_gas_ratio"), ETHANE_THRESHOLD).alias("basin_category"),
    ),
)
over_production(
    "safe_ratio",
    lambda p: kpi.operator_oil_gas(p).select(
        "operator", expr.safe_ratio(F.col("total_oil_bbl"), F.col("total_gas_mcf")).alias("oil_gas_ratio")
    ),
)
over_production(
    "quarter_label",
    lambda p: p.select(
        "production_month",
        F.year("production_month").alias("production_year"),
        F.month("production_month").alias("month_number"),
        expr.quarter_label("production_month").alias("production_quarter"),
    ).distinct(),
)

# --- portfolio ---------------------------------------------------------------------------


over_production("portfolio_kpis", portfolio.portfolio_kpis)


@query
def volume_tier(spark, sf_dir):
    return _tiered(spark, sf_dir).drop("_median")


def _tiered(spark, sf_dir):
    return portfolio.volume_tier(bind.flaring(spark, sf_dir))


over_kpi("top10_operators", _performance, lambda d: portfolio.top_n(d, "total_oil_bbl", 10, "operator"))
over_kpi("oil_gas_mix", _performance, portfolio.oil_gas_mix)
over_kpi("wells_per_play", _summary, portfolio.wells_per_play)
over_kpi("well_portfolio", _summary, portfolio.well_portfolio)
over_kpi("trend_slice", _trends, lambda t: portfolio.trend_slice(t, [PLAY, "ASIA"], ["O"]))
over_kpi("growth_series", _trends, lambda t: portfolio.growth_series(t, "mom_growth_pct"))
over_kpi("yoy_series", _trends, lambda t: portfolio.growth_series(t, "yoy_growth_pct"))
over_production("basin_trends_calendar", lambda p: kpi.basin_production_trends(p, "calendar"))
over_production("well_trends_calendar", kpi.well_production_trends)
over_production("quarter_matrix", portfolio.quarter_matrix)
over_production("well_history", lambda p: portfolio.entity_history(p, "well", WELL))
over_production("operator_history", lambda p: portfolio.entity_history(p, "operator", OPERATOR))
over_production("distinct_plays", lambda p: quality.distinct_values(p, "shale_play"))
over_production("entity_history", lambda p: portfolio.entity_history(p, "basin", PLAY))
over_production("operator_drilldown", lambda p: portfolio.operator_drilldown(p, OPERATOR))
over_kpi("flaring_percentiles", bind.flaring, portfolio.flaring_percentiles)
over_kpi("flaring_kpis", _tiered, portfolio.flaring_kpis)
over_kpi("tier_distribution", _tiered, portfolio.tier_distribution)
over_kpi("tier_summary", _tiered, portfolio.tier_summary)
over_kpi("tier_report", _tiered, lambda t: portfolio.tier_report(portfolio.tier_summary(t)))
over_kpi(
    "top10_flaring", _tiered,
    lambda d: portfolio.top_n(d.drop("_median"), "total_flared_gas_mcf", 10, "operator").withColumn(
        "operator_label", expr.title_case(F.col("operator"))
    ),
)
over_kpi("commodity_split_top_n", _ethane, lambda e: portfolio.commodity_split_top_n(e, 14))
over_kpi(
    "commodity_split_scaled", _ethane,
    lambda e: portfolio.commodity_split_top_n(e, 14).select(
        "operator",
        (F.col("liquid_rich_production") / 1e6).alias("liquid_rich_millions"),
        (F.col("dry_gas_production") / 1e6).alias("dry_gas_millions"),
    ),
)
over_kpi(
    "trends_scaled", _trends,
    lambda t: t.filter(F.col("oil_and_gas_group") == "O").select(
        "shale_play", "production_month", (F.col("total_production") / 1e3).cast("decimal(20,5)").cast("string").alias("thousand_bbl")
    ),
)
over_kpi("liquid_share_by_year", _ethane, portfolio.liquid_share_by_year)


@query
def title_case(spark, sf_dir):
    """Names with letters, digits and punctuation."""
    customers = bind.table(spark, sf_dir, "customer").select(
        F.concat_ws("-", "c_mktsegment", F.upper("c_name")).alias("name")
    )
    return customers.withColumn("label", expr.title_case(F.col("name")))


@query
def humanize_number(spark, sf_dir):
    """Order values, larger multiples of them and an occasional null."""
    price = F.col("o_totalprice")
    return bind.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        expr.humanize(price, " BBL").alias("price"),
        expr.humanize(price * price).alias("large"),
        expr.humanize(price * price * 1e17).alias("huge"),
        expr.fixed_point(price * price * price * price, 1).alias("all_digits"),
        expr.humanize(F.when(F.col("o_orderstatus") != "P", price / 1000)).alias("small"),
    )


over_kpi(
    "entity_labels", _summary,
    lambda s: s.select(
        "api_number",
        expr.short_name(F.col("well_name"), F.col("api_number")).alias("short_name"),
        expr.id_tail(F.col("well_name")).alias("tail"),
        expr.without_country(F.concat("shale_play", F.lit(", US"))).alias("play"),
    ),
)
over_kpi(
    "horizon_label", _summary,
    lambda s: s.select("api_number", expr.month_year(F.col("last_production_month")).alias("horizon")),
)

# --- panels ------------------------------------------------------------------------------

over_production("monthly_wide_panel", forecast.monthly_wide_panel)
over_production("operator_monthly", forecast.operator_monthly)
over_production("play_monthly", forecast.play_monthly)
over_production("play_monthly_oil", forecast.play_monthly_oil)
over_production("top_wells", lambda p: forecast.top_wells(p, TOP_WELLS))
over_production("top3_wells", forecast.top_named_wells)
over_production("top_wells_semi", lambda p: forecast.top_well_panel(p, 20))
over_production("entity_panel", lambda p: forecast.entity_panel(p, 20))
over_production("entity_panel_grouping_sets", lambda p: forecast.entity_panel(p, None))

# --- decline curves ----------------------------------------------------------------------


def _curve_query(rate) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        months = F.explode(F.sequence(F.lit(0), bind.last_month_position(spark, sf_dir)))
        wells = bind.decline_parameters(spark, sf_dir).withColumn("t", months)
        t = F.col("t").cast("double")
        return rounded(wells.select("api_number", "t", rate(t).alias("rate")))

    return run


QUERIES["arps_exponential"] = _curve_query(
    lambda t: decline.exponential(t, F.col("qi"), F.col("di"))
)
QUERIES["arps_hyperbolic"] = _curve_query(
    lambda t: decline.hyperbolic(t, F.col("qi"), F.col("di"), F.col("b") * 0.9 + 0.05)
)
QUERIES["arps_harmonic"] = _curve_query(lambda t: decline.harmonic(t, F.col("qi"), F.col("di")))


def _quality(spark, sf_dir):
    """R-squared per well of a slow exponential against the real production rows."""
    t = (F.year("production_month") - 1995) * 12 + F.month("production_month") - 1
    predicted = bind.production(spark, sf_dir).withColumn(
        "predicted", decline.exponential(t.cast("double"), F.lit(60000.0), F.lit(0.001))
    )
    return decline.r2_score(predicted, ["api_number"], "production", "predicted")


@query
def r2_score(spark, sf_dir):
    return _quality(spark, sf_dir)


@query
def r2_histogram(spark, sf_dir):
    """Scores rounded first, so that both engines bin the same numbers."""
    scores = _quality(spark, sf_dir).select("api_number", F.round("r2", 9).alias("r2_score"))
    return portfolio.r2_histogram(scores)


def _decline_panel(spark, sf_dir):
    return forecast.entity_panel(bind.decline_production(spark, sf_dir))


def _decline_fits(spark, sf_dir):
    return forecast.fit_series(forecast.entity_series(_decline_panel(spark, sf_dir)))


@query
def best_model(spark, sf_dir):
    """Each model with the well's true parameters as candidate, the best one chosen."""
    wells = bind.decline_parameters(spark, sf_dir).select("api_number", "qi", "di", "b")
    t = (F.year("production_month") - 1995) * 12 + F.month("production_month") - 1
    oil = bind.decline_production(spark, sf_dir).filter(F.col("oil_and_gas_group") == "O")
    rows = (
        oil.select("api_number", t.cast("double").alias("t"), "production")
        .join(wells, "api_number")
        .withColumn("model", F.explode(F.lit(list(forecast.MODELS))))
    )
    shape = F.when(F.col("b") == 0, 0.5).otherwise(F.least("b", F.lit(0.999)))
    rate = decline.curve(F.col("model"), F.col("t"), F.col("qi"), F.col("di"), shape)
    scores = decline.r2_score(
        rows.withColumn("predicted", rate), ["api_number", "model"], "production", "predicted"
    )
    return forecast.best_model(scores, ["api_number"])


@query
def arps_fit(spark, sf_dir):
    return forecast.arps_fit(_decline_fits(spark, sf_dir))


@query
def arps_grid_fit(spark, sf_dir):
    series = forecast.entity_series(_decline_panel(spark, sf_dir))
    return forecast.arps_grid_fit(series, "oil", DI_GRID, B_GRID)


def _measured_series(spark, sf_dir, calendar: bool = False):
    """All entities of the measured production, gaps and noise included."""
    return forecast.entity_series(forecast.entity_panel(bind.production(spark, sf_dir)), calendar=calendar)


@query
def arps_grid_fit_measured(spark, sf_dir):
    return forecast.arps_grid_fit(_measured_series(spark, sf_dir), "oil", DI_GRID, B_GRID)


@query
def arps_grid_fit_calendar(spark, sf_dir):
    """The grid over months since the first one: gaps are steps of their own."""
    return forecast.arps_grid_fit(_measured_series(spark, sf_dir, calendar=True), "oil", DI_GRID, B_GRID)


def _against_grid(series):
    """Whether the fit of measured oil and gas explains at least as much as the best grid cell."""
    fitted = forecast.arps_fit(forecast.fit_series(series)).select("entity_type", "entity_id", "oil_and_gas_group", "months", "r2")
    grids = None
    for group, value in (("O", "oil"), ("G", "gas")):
        grid = forecast.arps_grid_fit(series, value, DI_GRID, B_GRID).select(
            F.col("entity_type").alias("_type"), F.col("entity_id").alias("_id"), F.lit(group).alias("_group"), F.col("r2").alias("_r2")
        )
        grids = grid if grids is None else grids.union(grid)
    same = (F.col("entity_type") == F.col("_type")) & (F.col("entity_id") == F.col("_id")) & (F.col("oil_and_gas_group") == F.col("_group"))
    return fitted.join(grids, same).select(
        "entity_type", "entity_id", "oil_and_gas_group", "months", (F.col("r2") >= F.col("_r2") - 1e-9).alias("at_least_grid")
    )


@query
def fit_against_grid(spark, sf_dir):
    return _against_grid(stored(_measured_series(spark, sf_dir), "series"))


@query
def fit_against_grid_calendar(spark, sf_dir):
    return _against_grid(stored(_measured_series(spark, sf_dir, calendar=True), "series"))


@query
def forecast_months_calendar(spark, sf_dir):
    """The same months as with row time, projected from the last one on the calendar axis."""
    series = _measured_series(spark, sf_dir, calendar=True)
    known = F.struct(F.lit("exponential").alias("model"), F.lit(1.0).alias("qi"), F.lit(0.01).alias("di"), F.lit(0.0).alias("b"), F.lit(1.0).alias("r2"))
    projected = forecast.project_forward(series.withColumn("oil_fit", known).withColumn("gas_fit", known), 3)
    return projected.select("entity_type", "entity_id", "forecast_month", "forecast_oil_bbl")


@query
def forecast_months_measured(spark, sf_dir):
    """Which months the forecast of measured production covers, per entity."""
    table = forecast.forecast_table(bind.production(spark, sf_dir))
    return table.groupBy("entity_type", "entity_id").agg(
        F.count("*").alias("months"), F.min("forecast_month").alias("first_month"), F.max("forecast_month").alias("last_month"),
        F.count_if((F.col("forecast_oil_bbl") < 0) | (F.col("forecast_gas_mcf") < 0)).alias("negative"),
    )


@query
def fitted_curve(spark, sf_dir):
    return forecast.fitted_curve(_decline_fits(spark, sf_dir))


@query
def project_forward(spark, sf_dir):
    """The known parameters projected, without a fit."""
    last = bind.last_month_position(spark, sf_dir)
    model = F.when(F.col("b") == 0, "exponential").when(F.col("b") == 1, "harmonic")
    fit = F.struct(F.coalesce(model, F.lit("hyperbolic")).alias("model"), "qi", "di", "b", F.lit(1.0).alias("r2"))
    known = bind.decline_parameters(spark, sf_dir).select(
        F.lit("well").alias("entity_type"),
        F.col("api_number").alias("entity_id"),
        (last + 1).alias("months"),
        F.add_months(F.lit(bind.START_MONTH).cast("date"), last).alias("last_month"),
        fit.alias("oil_fit"),
        fit.withField("qi", F.col("qi") * 4).alias("gas_fit"),
    )
    return forecast.project_forward(known, 24)


@query
def forecast_calendar(spark, sf_dir):
    """Months after the last production day of each well, clamped to the month's end."""
    days = bind.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.max(F.col("l_shipdate").cast("date")).alias("last_day")
    )
    return days.select(
        "l_suppkey", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("step"), "last_day"
    ).withColumn("forecast_day", F.add_months("last_day", F.col("step")))


def _forecast(spark, sf_dir):
    return forecast.forecast_table(bind.decline_production(spark, sf_dir))


def _forecast_level(level: str) -> Query:
    return lambda spark, sf_dir: rounded(
        forecast.forecast_table(bind.decline_production(spark, sf_dir), 24, TOP_WELLS, (level,))
    )


QUERIES["forecast_wells"] = _forecast_level("well")
QUERIES["forecast_operators"] = _forecast_level("operator")
QUERIES["forecast_plays"] = _forecast_level("basin")
over_kpi("forecast_table", _forecast, lambda f: f)


@query
def forecast_entity(spark, sf_dir):
    """Twelve months for the entities of one panel."""
    panel = _decline_panel(spark, sf_dir).filter(F.col("entity_id") == OPERATOR)
    return forecast.forecast_entities(panel, 12)


@query
def forecast_table_gaps(spark, sf_dir):
    """The same future from series that lack every April: time goes by the calendar."""
    reported = bind.decline_production(spark, sf_dir).filter(F.month("production_month") != 4)
    return forecast.forecast_table(reported, calendar=True)


@query
def arps_fit_gaps(spark, sf_dir):
    reported = bind.decline_production(spark, sf_dir).filter(F.month("production_month") != 4)
    return forecast.arps_fit(forecast.fit_series(forecast.entity_series(forecast.entity_panel(reported), calendar=True)))


over_kpi("forecast_band", _forecast, forecast.forecast_band)
over_kpi("forecast_slice", _forecast, lambda f: portfolio.forecast_slice(f, "operator", OPERATOR))
over_kpi("forecast_kpis", _forecast, portfolio.forecast_kpis)
over_kpi("model_mix", _forecast, portfolio.model_mix)
over_kpi(
    "forecast_summary", _forecast,
    lambda f: portfolio.forecast_summary(f.withColumn("r2_score", F.round("r2_score", 6))),
)
over_kpi("forecast_report", _forecast, lambda f: portfolio.forecast_report(portfolio.forecast_summary(f)))
over_kpi("model_card", _forecast, lambda f: portfolio.model_card(f, "operator", OPERATOR))
over_kpi("operator_forecast_top", _forecast, portfolio.operator_forecast_top)


# --- stages ------------------------------------------------------------------------------

# Tables of the stages that already ran, per session and state of the data folder, so that
# each stage query runs (and times) only its own stage.
_STAGED: dict[tuple, tuple[TablePaths, str, set[str]]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """When each given table was last written."""
    times = []
    for name in bind.SCHEMAS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        times.append(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime())
    return tuple(times)


def _staged(spark: SparkSession, sf_dir: str, stage: str) -> tuple[TablePaths, str]:
    """Folders in which every stage before ``stage`` has run."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _STAGED:
        root = scratch_path(spark, "staged")
        for feed in feeds.FEEDS.values():
            _feed_on_disk(spark, sf_dir, feed, f"{root}/raw")
        _STAGED[key] = (TablePaths(f"{root}/tables"), f"{root}/raw", set())
    paths, raw_dir, done = _STAGED[key]
    for earlier in stages.STAGES[: stages.STAGES.index(stage)]:
        if earlier not in done:
            stages.run(spark, raw_dir, paths.root, earlier)
            done.add(earlier)
    return paths, raw_dir


def _stage_query(stage: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths, raw_dir = _staged(spark, sf_dir, stage)
        return counts_frame(spark, stages.run(spark, raw_dir, paths.root, stage))

    return run


for _stage in stages.STAGES:
    QUERIES[f"stage_{_stage}"] = _stage_query(_stage)


def _stored(table: str, stage: str, schema) -> Query:
    """What the stages leave in a table, read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "stored")
        for feed in feeds.FEEDS.values():
            _feed_on_disk(spark, sf_dir, feed, f"{root}/raw")
        paths = TablePaths(f"{root}/tables")
        for name in stages.STAGES[: stages.STAGES.index(stage) + 1]:
            stages.run(spark, f"{root}/raw", paths.root, name)
        return rounded(tables.scan_table(spark, paths.of(table), schema).drop("load_timestamp"))

    return run


for _table, _schema in schemas.SILVER_TABLES.items():
    QUERIES[f"stored_{_table}"] = _stored(_table, "silver", _schema)
for _table, _schema in schemas.KPI_TABLES.items():
    if _table != "gold_production_forecast":
        QUERIES[f"stored_{_table}"] = _stored(_table, "gold", _schema)


@query
def stored_gold_production_forecast(spark, sf_dir):
    """Which entities and months the stored forecast holds."""
    table = _stored("gold_production_forecast", "forecast", schemas.GOLD_FORECAST)(spark, sf_dir)
    return table.groupBy("entity_type", "entity_id").agg(
        F.count("*").alias("months"), F.min("forecast_month").alias("first_month"), F.max("forecast_month").alias("last_month")
    )


@query
def stage_counts(spark, sf_dir):
    """All stages into a fresh root."""
    _, raw_dir = _staged(spark, sf_dir, "bronze")
    return counts_frame(spark, stages.run(spark, raw_dir, scratch_path(spark, "root"), "all"))


# --- refresh -----------------------------------------------------------------------------

# Months of the second feed file: a whole year that is new, and rows of a year that has others.
SECOND_FEED = "production_month LIKE '2001%' OR (production_month LIKE '1997%' AND well_name IS NULL)"
_REFRESHED: dict[tuple, tuple[TablePaths, DataFrame]] = {}


def _partition_files(spark: SparkSession, paths: TablePaths) -> DataFrame:
    return stages.silver_production(spark, paths).select("production_year", F.col("_metadata.file_path").alias("file")).distinct()


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[TablePaths, DataFrame]:
    """Tables after a refresh from most of the raw rows and another one from a second file, and the
    files of silver production in between; once per session and state of the data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _REFRESHED:
        root = scratch_path(spark, "refreshed")
        paths = TablePaths(f"{root}/tables")
        feed = feeds.FEEDS["bronze_well_production"]
        raw = bind.RAW_FEEDS[feed.table](spark, sf_dir)
        second = F.coalesce(F.expr(SECOND_FEED), F.lit(False))
        _write_feed(raw.filter(~second), f"{root}/raw/{feed.file_name}")
        _write_feed(raw.filter(second), f"{root}/raw/second.csv")
        for table in ("bronze_flaring", "bronze_well_metadata"):
            feeds.ingest_more(spark, feeds.FEEDS[table], _feed_on_disk(spark, sf_dir, feeds.FEEDS[table], f"{root}/raw"), paths)
        feeds.ingest_more(spark, feed, f"{root}/raw/{feed.file_name}", paths)
        refresh.refresh(spark, paths)
        between = stored(_partition_files(spark, paths), "files")
        feeds.ingest_more(spark, feed, f"{root}/raw/second.csv", paths)
        refresh.refresh(spark, paths)
        _REFRESHED[key] = (paths, between)
    return _REFRESHED[key]


def _refreshed_table(table: str, schema) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths, _ = _refreshed(spark, sf_dir)
        return rounded(tables.scan_table(spark, paths.of(table), schema).drop("load_timestamp"))

    return run


for _table, _schema in (schemas.SILVER_TABLES | schemas.KPI_TABLES).items():
    if _table not in ("gold_production_forecast", "gold_operator_performance"):
        QUERIES[f"refreshed_{_table}"] = _refreshed_table(_table, _schema)


@query
def refreshed_gold_operator_performance(spark, sf_dir):
    """The number of oil reports in place of their mean, which can lie on a rounding tie."""
    table = _refreshed_table("gold_operator_performance", schemas.GOLD_OPERATOR_PERFORMANCE)(spark, sf_dir)
    reports = F.round(F.col("total_oil_bbl") / F.col("avg_monthly_production")).cast("bigint")
    return table.withColumn("oil_reports", reports).drop("avg_monthly_production")


@query
def refreshed_years(spark, sf_dir):
    """Which years the second refresh wrote again: the others keep their files."""
    paths, between = _refreshed(spark, sf_dir)
    before = between.groupBy("production_year").agg(F.collect_set("file").alias("_before"))
    after = _partition_files(spark, paths).groupBy("production_year").agg(F.collect_set("file").alias("_after"))
    same = F.coalesce(F.sort_array("_before") == F.sort_array("_after"), F.lit(False))
    return after.join(before, "production_year", "left").select("production_year", (~same).alias("rewritten"))


# --- sketches ----------------------------------------------------------------------------


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(sketches.production_sketches(bind.production(spark, sf_dir)), "sketches")


@query
def sketch_percentiles(spark, sf_dir):
    """Percentiles of the volume by play, year and commodity from the stored sketches, and whether
    their exact ranks are within the bound."""
    points = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    keys = ["shale_play", "production_year", "oil_and_gas_group"]
    year = F.year("production_month").alias("production_year")
    found = stored(sketches.estimates(sketches.roll_up(_sketches(spark, sf_dir), "shale_play", year, "oil_and_gas_group"), points), "estimates")
    facts = bind.production(spark, sf_dir).select(*keys, "production").join(found.drop("reports", "wells"), keys)
    exact = []
    for name, p in points.items():
        below, upto = F.avg((F.col("production") < F.col(name)).cast("double")), F.avg((F.col("production") <= F.col(name)).cast("double"))
        exact.append(((below - sketches.RANK_ERROR <= p) & (upto + sketches.RANK_ERROR >= p)).alias(f"{name}_within"))
    return facts.groupBy(*keys).agg(F.count("*").alias("reports"), *exact)


@query
def sketch_wells(spark, sf_dir):
    """Distinct wells per operator and quarter, operator and year, play and year, and in all, from one
    stored table; exact numbers and whether the estimates are within the bound."""
    table, production = _sketches(spark, sf_dir), bind.production(spark, sf_dir)
    year, quarter = F.year("production_month").cast("string"), expr.period_label("production_month")
    levels = {
        "operator_quarter": (F.col("operator"), quarter), "operator_year": (F.col("operator"), year),
        "play_year": (F.col("shale_play"), year), "all": (F.lit("all"), F.lit("all")),
    }
    keys = ["level", "entity", "period"]
    estimated, exact = [], []
    for level, (entity, period) in levels.items():
        own = [F.lit(level).alias("level"), entity.alias("entity"), period.alias("period")]
        estimated.append(sketches.estimates(sketches.roll_up(table, *own), {}).select(*keys, F.col("wells").alias("estimate")))
        exact.append(production.groupBy(*own).agg(F.count_distinct("api_number").alias("wells")))
    both = reduce(DataFrame.unionByName, exact).join(reduce(DataFrame.unionByName, estimated), keys)
    near = F.abs(F.col("estimate") - F.col("wells")) <= F.greatest(F.col("wells") * sketches.COUNT_ERROR, F.lit(1.0))
    return both.select(*keys, "wells", near.alias("within"))


# --- reconciliation and broken lines -----------------------------------------------------


@query
def reconcile_production(spark, sf_dir):
    return reconcile.production_ledger(_raw_production(spark, sf_dir))


@query
def reconcile_wells(spark, sf_dir):
    return reconcile.wells_ledger(_raw_wells(spark, sf_dir))


@query
def reconcile_flaring(spark, sf_dir):
    return reconcile.flaring_ledger(_raw_flaring(spark, sf_dir))


@query
def reconcile_totals(spark, sf_dir):
    """Rows per outcome of all three feeds."""
    made = {"production": reconcile_production, "wells": reconcile_wells, "flaring": reconcile_flaring}
    parts = [reconcile.totals(of(spark, sf_dir)).select(F.lit(feed).alias("feed"), "outcome", "rows") for feed, of in made.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query
def dropped_production(spark, sf_dir):
    """Typed rows that the clean table does not hold, as often as they are dropped."""
    raw = _raw_production(spark, sf_dir)
    return reconcile.bag_difference(clean.typed_production(raw), stored(clean.clean_production(raw), "clean"))


@query
def unchanged_production(spark, sf_dir):
    """Typed rows that the clean table holds as they are."""
    raw = _raw_production(spark, sf_dir)
    return reconcile.bag_intersection(clean.typed_production(raw), stored(clean.clean_production(raw), "clean"))


@query
def broken_lines(spark, sf_dir):
    """A feed with a short and a long line and one with an open quote per well: what lands as rows,
    and which lines are kept apart."""
    feed = feeds.FEEDS["bronze_well_metadata"]
    folder = scratch_path(spark, "raw")
    path = f"{folder}/{feed.file_name}"
    _write_feed(bind.RAW_FEEDS[feed.table](spark, sf_dir), path)
    supplier = bind.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    lines = F.array(F.concat(F.lit("1.5,short "), key), F.concat(F.lit("2.5,long,"), key, F.lit(",more")), F.concat(F.lit('3.5,"open '), key, F.lit(",x")))
    broken = supplier.select(F.explode(lines).alias("value"), F.lit(1).alias("place"))
    header = spark.createDataFrame([(",".join(feed.columns), 0)], "value string, place int")
    header.union(broken).repartition(1).sortWithinPartitions("place").select("value").write.mode("append").text(path)
    paths = TablePaths(f"{folder}/tables")
    feeds.ingest_checked(spark, feed, path, paths)
    good = tables.scan_table(spark, paths.of(feed.table)).select(F.lit("row").alias("kind"), F.concat_ws("|", "squarerootsum", "well_name", "api_number").alias("content"))
    apart = tables.scan_table(spark, paths.of(f"{feed.table}_broken")).select(F.lit("broken").alias("kind"), F.col("line").alias("content"))
    return good.union(apart)


# --- joins over time ---------------------------------------------------------------------


def _well_versions(spark, sf_dir):
    """Versions of a well's metadata: orders of the customer of the same number, by their date."""
    orders = bind.table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").cast("string").alias("api_number"), F.col("o_orderdate").cast("date").alias("valid_from"),
        F.col("o_orderpriority").alias("status"), F.col("o_totalprice").alias("rate"),
    )


@query
def asof_metadata(spark, sf_dir):
    """The metadata valid on the first day of each month of production."""
    facts = bind.production(spark, sf_dir).select("api_number", "production_month", "oil_and_gas_group", "production")
    return temporal.asof_join(facts, _well_versions(spark, sf_dir), "api_number", "production_month", "valid_from", ["status", "rate"])


@query
def enrich_production_asof(spark, sf_dir):
    """Production with the name and length of the well that were valid in its month."""
    versions = _well_versions(spark, sf_dir).select(
        "api_number", "valid_from", F.concat(F.lit("Well "), "status").alias("well_name"), F.col("rate").alias("well_length_ft")
    )
    return clean.enrich_production_asof(clean.clean_production(_raw_production(spark, sf_dir)), versions)


@query
def ownership_overlap(spark, sf_dir):
    """Periods of ownership (an order's date and the days its price makes, up to decades) against
    the spells in which a well reports every month."""
    owned = _well_versions(spark, sf_dir).groupBy("api_number", F.col("valid_from").alias("owned_from")).agg(F.max("rate").alias("rate")).select(
        "api_number", "owned_from", F.date_add("owned_from", F.floor(F.pow(F.col("rate") / 50000, F.lit(4.0))).cast("int")).alias("owned_to"), "rate"
    )
    months = bind.production(spark, sf_dir).select("api_number", "production_month").distinct()
    number = (F.year("production_month") * 12 + F.month("production_month")).alias("number")
    spell = F.col("number") - F.row_number().over(Window.partitionBy("api_number").orderBy("number"))
    spells = months.select("api_number", "production_month", number).withColumn("spell", spell).groupBy("api_number", "spell").agg(
        F.min("production_month").alias("reports_from"), F.add_months(F.max("production_month"), 1).alias("reports_to")
    ).drop("spell")
    return temporal.overlap_join(owned, spells, "api_number", ("owned_from", "owned_to"), ("reports_from", "reports_to"))


# --- windows over a stream ---------------------------------------------------------------


def _streamed(build: Callable[[DataFrame], DataFrame]) -> Query:
    """The windows that a run over the events closes; times as text, free of the session's zone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "stream")
        made = build(windows.event_stream(spark, sf_dir, pattern="events.parquet"))
        windows.run_to_table(made, f"{root}/table", f"{root}/checkpoint")
        table = spark.read.schema(made.schema).parquet(f"{root}/table")
        return rounded(table.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("window_start", "window_end")}))

    return run


QUERIES["stream_tumbling"] = _streamed(lambda e: windows.tumbling(e, "6 hours"))
QUERIES["stream_sliding"] = _streamed(lambda e: windows.sliding(e, "1 day", "6 hours"))
QUERIES["stream_sessions"] = _streamed(lambda e: windows.sessions(e, "30 minutes"))


# --- SQL functions -----------------------------------------------------------------------


def _with_functions(view: str, source: Query, text: str) -> Query:
    """A query written as SQL text over a stored table registered as a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = TablePaths(scratch_path(spark, "tables"))
        tables.write_table(source(spark, sf_dir), paths.of(view))
        tables.register_views(spark, paths, [view])
        sql_functions.register_functions(spark, tables=view == "gold_production_forecast")
        return rounded(spark.sql(text))

    return run


QUERIES["sql_operator_quarterly"] = _with_functions(
    "silver_production", bind.production,
    """SELECT operator, production_year, quarter_label(production_month) AS production_quarter, oil_and_gas_group,
              round(sum(production), 2) AS total_production, count(DISTINCT api_number) AS active_wells
       FROM silver_production GROUP BY ALL""",
)
QUERIES["sql_avg_yoy_growth"] = _with_functions(
    "gold_basin_production_trends", lambda spark, sf_dir: kpi.basin_monthly(bind.production(spark, sf_dir)),
    """SELECT shale_play, oil_and_gas_group, round(avg(growth_pct(total_production, previous)), 2) AS avg_yoy_growth_pct
       FROM (SELECT *, lag(total_production, 12) OVER (PARTITION BY shale_play, oil_and_gas_group ORDER BY production_month) AS previous
             FROM gold_basin_production_trends)
       GROUP BY shale_play, oil_and_gas_group""",
)
QUERIES["sql_top5_flaring_intensity"] = _with_functions(
    "gold_flaring_intensity", lambda spark, sf_dir: kpi.flaring_ratio(bind.production(spark, sf_dir), bind.flaring(spark, sf_dir)).select(
        "operator", "total_flared_gas_mcf", "total_gas_production_mcf"
    ),
    """SELECT operator, round(ratio, 2) AS flaring_pct, flaring_class(ratio) AS flaring_category
       FROM (SELECT operator, 100 * safe_ratio(total_flared_gas_mcf, total_gas_production_mcf) AS ratio FROM gold_flaring_intensity)
       WHERE ratio IS NOT NULL ORDER BY ratio DESC, operator LIMIT 5""",
)
QUERIES["sql_forecast_slice"] = _with_functions(
    "gold_production_forecast", lambda spark, sf_dir: _forecast(spark, sf_dir), f"SELECT * FROM forecast_slice('operator', '{OPERATOR}')"
)
QUERIES["sql_shares"] = _with_functions(
    "gold_ethane_dry_gas", _ethane,
    f"""SELECT operator, production_year, shale_play, share_pct(liquid_rich_production, dry_gas_production) AS liquid_pct,
               basin_class(safe_ratio(liquid_rich_production, dry_gas_production), {ETHANE_THRESHOLD}D) AS basin_category,
               basin_class(safe_ratio(liquid_rich_production, dry_gas_production)) AS default_category
        FROM gold_ethane_dry_gas""",
)

"""Monthly panels, distributed decline fits and projections.

Data stays on the cluster: grouping sets build the panels of all levels in one pass, each
entity's months (already aggregated, so bounded by the calendar) become one row of
arrays, the fit runs on Arrow batches of such rows, and the projection is plain
expressions again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlake import schemas
from prodlake.functions import decline
from prodlake.functions.expr import GAS, OIL, commodity_value
from prodlake.functions.fit import MODELS, RATE_FLOOR, fit_decline, fit_decline_at, fit_grid
from prodlake.operators.portfolio import total

LEVELS = ("well", "operator", "basin")
MIN_MONTHS = 6


# --- panels ------------------------------------------------------------------


def _oil_and_gas() -> list[Column]:
    return [
        total(commodity_value(OIL)).alias("oil_production"),
        total(commodity_value(GAS)).alias("gas_production"),
    ]


def monthly_wide_panel(production: DataFrame) -> DataFrame:
    return production.groupBy(
        "api_number", "well_name", "operator", "shale_play", "production_month"
    ).agg(*_oil_and_gas())


def operator_monthly(production: DataFrame) -> DataFrame:
    return production.groupBy("operator", "production_month").agg(*_oil_and_gas())


def play_monthly(production: DataFrame) -> DataFrame:
    return production.groupBy("shale_play", "production_month").agg(*_oil_and_gas())


def play_monthly_oil(production: DataFrame) -> DataFrame:
    oil = production.filter(F.col("oil_and_gas_group") == OIL)
    return oil.groupBy("shale_play", "production_month").agg(
        F.sum("production").alias("total_oil")
    )


def top_wells(production: DataFrame, n: int = 100) -> DataFrame:
    """The wells with the largest cumulative oil; ties go to the smaller id."""
    cumulative = production.groupBy("api_number").agg(total(commodity_value(OIL)).alias("cum_oil"))
    return cumulative.orderBy(F.col("cum_oil").desc(), "api_number").limit(n)


def top_named_wells(production: DataFrame, n: int = 3) -> DataFrame:
    return (
        production.filter(F.col("oil_and_gas_group") == OIL)
        .groupBy("api_number", "well_name")
        .agg(F.sum("production").alias("cum_oil"))
        .orderBy(F.col("cum_oil").desc(), "api_number", "well_name")
        .limit(n)
    )


def top_well_panel(production: DataFrame, n: int = 100) -> DataFrame:
    """Panel rows of the top wells.  The ids stay on the cluster."""
    return monthly_wide_panel(
        production.join(top_wells(production, n).select("api_number"), "api_number", "left_semi")
    )


def entity_panel(
    production: DataFrame, top_n: int | None = None, levels: tuple[str, ...] = LEVELS
) -> DataFrame:
    """Monthly oil and gas of wells, operators and plays from one scan of the facts.

    ``top_n`` limits the well level to the wells with the most oil (``None`` keeps all).
    Wells outside it have their well columns blanked before the aggregation, so they
    collapse map-side instead of being shuffled.  A well's attributes stay in the key: a
    month reported under two operators gives two rows.
    """
    attributes = ["api_number", "well_name", "operator", "shale_play"]
    rows = production
    keep = F.lit(True)
    if "well" in levels and top_n is not None:
        top = top_wells(production, top_n).select(F.col("api_number").alias("_top"))
        rows = rows.join(top, F.col("api_number") == F.col("_top"), "left")
        keep = F.col("_top").isNotNull()
    rows = rows.select(
        "production_month", "oil_and_gas_group", "production",
        F.col("operator").alias("_operator"), F.col("shale_play").alias("_play"),
        *[F.when(keep, F.col(c)).alias(f"_well_{c}") for c in attributes],
    )
    well = [f"_well_{c}" for c in attributes]
    sets = {"well": well, "operator": ["_operator"], "basin": ["_play"]}
    chosen = [[F.col(c) for c in [*sets[level], "production_month"]] for level in levels]
    columns = [F.col(c) for c in [*well, "_operator", "_play", "production_month"]]
    grouped = rows.groupingSets(chosen, *columns).agg(
        # grouping() tells a rolled-up key from a key that is null in the data
        F.grouping("_well_api_number").alias("_no_well"),
        F.grouping("_operator").alias("_no_operator"),
        *_oil_and_gas(),
    )
    is_well, is_operator = F.col("_no_well") == 0, F.col("_no_operator") == 0
    return grouped.select(
        F.when(is_well, "well").when(is_operator, "operator").otherwise("basin").alias("entity_type"),
        F.when(is_well, F.col("_well_api_number"))
        .when(is_operator, F.col("_operator"))
        .otherwise(F.col("_play"))
        .alias("entity_id"),
        "production_month", "oil_production", "gas_production",
    ).filter(F.col("entity_id").isNotNull())


# --- fits --------------------------------------------------------------------


def entity_series(panel: DataFrame, min_months: int = MIN_MONTHS, calendar: bool = False) -> DataFrame:
    """One row per entity with its months in order.  Entities shorter than ``min_months`` drop.

    Time is the row ordinal, the position in the arrays, as gaps collapse.  With ``calendar`` it is
    the number of months since the first one and stands in ``series_t``: the arrays hold reported
    months only, rows of one month are added up, rows without a month drop, and ``last_t`` counts the gaps too.
    """
    if calendar:
        month = F.trunc("production_month", "month")
        panel = panel.filter(F.col("production_month").isNotNull()).groupBy(
            "entity_type", "entity_id", month.alias("production_month")
        ).agg(F.sum("oil_production").alias("oil_production"), F.sum("gas_production").alias("gas_production"))
    rows = F.sort_array(
        F.collect_list(F.struct("production_month", "oil_production", "gas_production"))
    )
    series = (
        panel.groupBy("entity_type", "entity_id")
        .agg(rows.alias("_rows"))
        .filter(F.size("_rows") >= min_months)
        .select(
            "entity_type",
            "entity_id",
            F.size("_rows").alias("months"),
            F.col("_rows.production_month").alias("series_month"),
            F.element_at("_rows", -1)["production_month"].alias("last_month"),
            F.col("_rows.oil_production").alias("oil"),
            F.col("_rows.gas_production").alias("gas"),
        )
    )
    if not calendar:
        return series
    first = F.element_at("series_month", 1)
    since = F.transform("series_month", lambda m: (F.year(m) - F.year(first)) * 12 + F.month(m) - F.month(first))
    return series.withColumn("series_t", since).withColumn("last_t", F.element_at("series_t", -1))


def fit_series(series: DataFrame) -> DataFrame:
    """Adds the best decline model of each commodity as a struct."""
    if "series_t" in series.columns:
        return series.withColumn("oil_fit", fit_decline_at("series_t", "oil")).withColumn(
            "gas_fit", fit_decline_at("series_t", "gas")
        )
    return series.withColumn("oil_fit", fit_decline("oil")).withColumn(
        "gas_fit", fit_decline("gas")
    )


def arps_fit(fitted: DataFrame) -> DataFrame:
    """Long fit table: one row per entity and commodity."""

    def row(group: str, fit: str) -> Column:
        return F.struct(
            F.lit(group).alias("oil_and_gas_group"),
            *[F.col(f"{fit}.{c}").alias(c) for c in ("model", "qi", "di", "b", "r2")],
        )

    return fitted.select(
        "entity_type", "entity_id", "months",
        F.inline(F.array(row(OIL, "oil_fit"), row(GAS, "gas_fit"))),
    )


def best_model(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The model with the largest ``r2`` per key; ties go to the order of ``MODELS``."""
    order = F.array_position(F.lit(list(MODELS)), F.col("model"))
    best = F.max_by(F.struct("model", "r2"), F.struct("r2", (-order).alias("order")))
    return scores.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def arps_grid_fit(
    series: DataFrame, value: str, di_grid: list[float], b_grid: list[float]
) -> DataFrame:
    """Best cell of a fixed (di, b) grid per series; the smallest b, then di, wins ties.

    ``b = 0`` is the exponential, ``b = 1`` the harmonic model.  Workers lay each cell over a
    whole batch of series.  Written as expressions, the projection above a series was folded into the
    loop over the cells and its time axis made again for every cell.
    """
    floored = F.transform(value, lambda q: F.greatest(q, F.lit(RATE_FLOOR)))
    times = ["series_t"] if "series_t" in series.columns else []
    best = series.withColumn("_best", fit_grid(di_grid, b_grid)(*times, floored))
    return best.select(
        "entity_type", "entity_id", _model_of(F.col("_best.b")).alias("model"), "_best.qi", "_best.di", "_best.b", "_best.r2"
    )


def _model_of(b: Column) -> Column:
    return F.when(b == 0, "exponential").when(b == 1, "harmonic").otherwise("hyperbolic")


def fitted_curve(fitted: DataFrame) -> DataFrame:
    """Actual and in-sample fitted rate of every month."""
    series = ["series_month", "oil", "gas"]
    calendar = "series_t" in fitted.columns
    rows = fitted.select(
        "entity_type", "entity_id", "oil_fit", "gas_fit",
        F.posexplode(F.arrays_zip(*series, *["series_t"] * calendar)).alias("_place", "_row"),
    ).withColumn("t", F.col("_row.series_t") if calendar else F.col("_place"))
    return rows.select(
        "entity_type", "entity_id", "t",
        F.col("_row.series_month").alias("production_month"),
        F.col("_row.oil").alias("oil_production"),
        F.col("_row.gas").alias("gas_production"),
        _rate("oil_fit", F.col("t")).alias("oil_fitted"),
        _rate("gas_fit", F.col("t")).alias("gas_fitted"),
    )


# --- projection --------------------------------------------------------------


def _rate(fit: str, t: Column) -> Column:
    model, qi, di, b = (F.col(f"{fit}.{c}") for c in ("model", "qi", "di", "b"))
    return decline.curve(model, t.cast("double"), qi, di, b)


def project_forward(fitted: DataFrame, n_months: int = 24) -> DataFrame:
    """Rates of the ``n_months`` after the last month, never negative.

    The fit columns report the commodity with the better R-squared, oil on ties.
    """
    ahead = fitted.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(n_months))))
    last_t = F.col("last_t") if "last_t" in fitted.columns else F.col("months") - 1
    t = last_t + F.col("_step")
    oil_leads = F.col("oil_fit.r2") >= F.col("gas_fit.r2")
    best = {
        c: F.when(oil_leads, F.col(f"oil_fit.{c}")).otherwise(F.col(f"gas_fit.{c}"))
        for c in ("model", "r2", "qi", "di", "b")
    }
    projected = ahead.select(
        "entity_type",
        "entity_id",
        F.add_months("last_month", F.col("_step")).alias("forecast_month"),
        F.greatest(_rate("oil_fit", t), F.lit(0.0)).alias("forecast_oil_bbl"),
        F.greatest(_rate("gas_fit", t), F.lit(0.0)).alias("forecast_gas_mcf"),
        best["model"].alias("model_type"),
        best["r2"].alias("r2_score"),
        best["qi"].alias("qi"),
        best["di"].alias("di"),
        best["b"].alias("b_factor"),
    )
    return schemas.conform(projected, schemas.GOLD_FORECAST)


def forecast_entities(panel: DataFrame, n_months: int = 24, calendar: bool = False) -> DataFrame:
    return project_forward(fit_series(entity_series(panel, calendar=calendar)), n_months)


def forecast_table(
    production: DataFrame,
    n_months: int = 24,
    top_n: int | None = None,
    levels: tuple[str, ...] = LEVELS,
    calendar: bool = False,
) -> DataFrame:
    """Forecasts of the wells (all, or the ``top_n`` with the most oil), operators and plays.

    ``calendar`` fits against months since the first one instead of row ordinals, see
    ``entity_series``.
    """
    return forecast_entities(entity_panel(production, top_n, levels), n_months, calendar)


def forecast_band(forecast: DataFrame, width: float = 0.15) -> DataFrame:
    """Adds a symmetric relative band around both forecasts."""
    bounds = {}
    for column, name in (("forecast_oil_bbl", "oil"), ("forecast_gas_mcf", "gas")):
        bounds[f"{name}_low"] = F.col(column) * (1 - width)
        bounds[f"{name}_high"] = F.col(column) * (1 + width)
    return forecast.withColumns(bounds)

"""Where every raw row went: kept, a copy, superseded, or rejected and why.

Equal raw rows are counted first (combining map-side), so a row that is repeated very often is
one row from then on, with its number.  ``ledger`` accounts for all of them: the ``rows`` of its
outcomes add up to the raw rows, one ``kept`` row for each row of the clean table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlake.operators import clean

KEPT, COPY, SUPERSEDED = "kept", "copy", "superseded"


def _first_reason(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(broken, reason) for reason, broken in rules.items()])


def ledger(raw: DataFrame, typed: list[Column], rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """The distinct rows of ``raw`` with ``outcome`` and ``rows``.

    ``typed`` are the columns of the clean table over raw columns, ``rules`` conditions on them
    under which a row is rejected; the first one that holds is the outcome.  Of the others, the
    smallest row per key is kept once, by the typed columns and then the raw ones.  Rows with the
    same typed values are copies of it, all others of the key are superseded.
    """
    names = raw.columns
    bag = raw.groupBy(*names).agg(F.count("*").alias("_n"))
    rows = bag.select(F.struct(*names).alias("_raw"), "_n", *typed)
    columns = [c for c in rows.columns if c not in ("_raw", "_n")]
    rows = rows.withColumn("_reason", _first_reason(rules)).withColumn("_typed", F.struct(*[c for c in columns if c not in keys]))
    good = rows.filter(F.col("_reason").isNull())
    best = good.groupBy(*keys).agg(F.min(F.struct("_typed", "_raw")).alias("_best"))
    first = good.select("_raw", "_n", "_typed", *keys).join(best, keys)
    is_best = F.col("_raw").eqNullSafe(F.col("_best._raw"))
    other = F.when(F.col("_typed").eqNullSafe(F.col("_best._typed")), COPY).otherwise(SUPERSEDED)
    outcomes = F.array(
        F.struct(F.lit(KEPT).alias("outcome"), F.when(is_best, 1).otherwise(0).cast("bigint").alias("rows")),
        F.struct(other.alias("outcome"), F.when(is_best, F.col("_n") - 1).otherwise(F.col("_n")).alias("rows")),
    )
    accepted = first.select("_raw.*", F.inline(F.filter(outcomes, lambda o: o["rows"] > 0)))
    rejected = rows.filter(F.col("_reason").isNotNull()).select("_raw.*", F.col("_reason").alias("outcome"), F.col("_n").alias("rows"))
    return accepted.unionByName(rejected)


def production_ledger(raw: DataFrame) -> DataFrame:
    """All rows of the raw production feed; lineage columns are left out."""
    rules = {
        "no api_number": F.col("api_number").isNull(),
        "unreadable month": F.col("production_month").isNull(),
        "no operator": F.col("operator").isNull(),
        "unreadable volume": F.col("production").isNull(),
        "negative volume": F.col("production") < 0,
    }
    return ledger(_bare(raw), clean.production_columns(), rules, clean.PRODUCTION_KEY)


def wells_ledger(raw: DataFrame) -> DataFrame:
    return ledger(_bare(raw), clean.wells_columns(), {"no api_number": F.col("api_number").isNull()}, ["api_number"])


def flaring_ledger(raw: DataFrame) -> DataFrame:
    rules = {"no operator": F.col("operator").isNull(), "unreadable volume": F.col("total_flared_gas_mcf").isNull()}
    return ledger(_bare(raw), clean.flaring_columns(), rules, ["operator"])


def _bare(raw: DataFrame) -> DataFrame:
    return raw.drop("load_timestamp", "source_file", "data_source", "ingest_year")


def totals(outcomes: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return outcomes.groupBy("outcome").agg(F.sum("rows").alias("rows"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of ``left`` without those of ``right``, each as often as it is left over."""
    return left.select(*right.columns).exceptAll(right)


def bag_intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows both have, each as often as in the one that has it less often."""
    return left.select(*right.columns).intersectAll(right)

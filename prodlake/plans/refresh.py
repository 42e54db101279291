"""Refresh of the clean and KPI tables from what is new in the raw tables.

Raw tables grow by whole feed files (``feeds.ingest_more``).  A refresh finds the files it has
not seen by their lineage columns and works on the years they touch:

* new rows are typed and reduced to one per key, and merged by key into the clean facts of
  the touched years; "smallest row" is a minimum, so merging gives the rows a full rebuild
  gives;
* a change of a well's metadata touches the years in which that well has rows;
* silver production and two tables of partial aggregates (a roll-up over wells, and sums and
  extremes per well and year) are made again for the touched years only;
* the KPI tables are put together from the partials, without reading the facts.

Every merge is stored before it replaces partitions, so no table is written while it is read.
Files count as seen only at the end, and the touched years are noted before a table changes: a
refresh that fails half-way is simply run again, and merging the same rows twice changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlake import schemas
from prodlake.operators import clean, kpi
from prodlake.plans import stages
from prodlake.session import checkpoint_root, stored
from prodlake.sources import feeds
from prodlake.sources.tables import TablePaths, append_table, path_exists, scan_table, write_table, written_rows

YEAR = "production_year"
SEEN = "table_name string, source_file string, load_timestamp timestamp"


@dataclass
class Refresh:
    """What a refresh did: new files per raw table, touched years, rows of the written tables."""

    files: dict[str, list[str]] = field(default_factory=dict)
    years: list[int] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


def _seen(spark: SparkSession, paths: TablePaths) -> DataFrame:
    path = paths.of("silver_seen_files")
    return scan_table(spark, path, SEEN) if path_exists(spark, path) else spark.createDataFrame([], SEEN)


def _unseen(spark: SparkSession, paths: TablePaths, table: str) -> DataFrame:
    """The files of a raw table that no refresh has worked on: one row each."""
    path = paths.of(table)
    if not path_exists(spark, path):
        return spark.createDataFrame([], SEEN)
    files = scan_table(spark, path).select(F.lit(table).alias("table_name"), "source_file", "load_timestamp").distinct()
    return files.join(_seen(spark, paths), ["table_name", "source_file", "load_timestamp"], "left_anti")


def _new_rows(spark: SparkSession, paths: TablePaths, table: str, files: list) -> DataFrame:
    """The raw rows of some files; the first load time among them skips older row groups.

    A feed file holds any number of rows, so the rows must not be dealt by their file.  The list has
    one row a file and comes from the driver, without a size that Spark could measure, hence the hint.
    """
    listed = F.broadcast(spark.createDataFrame(files, SEEN).drop("table_name"))
    raw = scan_table(spark, paths.of(table)).filter(F.col("load_timestamp") >= F.lit(min(f.load_timestamp for f in files)))
    return raw.join(listed, ["source_file", "load_timestamp"], "left_semi")


def _years(df: DataFrame) -> list[int]:
    """The years of a table, bounded by the calendar."""
    return sorted(row[0] for row in df.select(YEAR).distinct().collect())


def _merged_dimension(spark: SparkSession, paths: TablePaths, table: str, changes: DataFrame, key: str, schema) -> tuple[DataFrame, DataFrame]:
    """A small table with cleaned rows merged into it, and the keys whose rows change."""
    known = _or_empty(spark, paths, table, schema)
    merged = stored(clean.dedup(known.unionByName(changes), [key]), table)
    facts = [c for c in merged.columns if c != "load_timestamp"]
    return merged, merged.select(*facts).exceptAll(known.select(*facts)).select(key)


def _note(spark: SparkSession, paths: TablePaths, years: set[int]) -> None:
    """Keep the years that are being worked on, until the refresh is through."""
    write_table(spark.createDataFrame([(y,) for y in sorted(years)], f"{YEAR} int"), paths.of("silver_open_years"))


def _merge_facts(spark: SparkSession, paths: TablePaths, changes: DataFrame, years: list[int]) -> None:
    """Merge typed rows by key into the facts of the years they are in."""
    path = paths.of("silver_facts")
    rows = changes
    if path_exists(spark, path):
        rows = scan_table(spark, path).filter(F.col(YEAR).isin(years)).select(*changes.columns).unionByName(changes)
    merged = clean.dedup(rows.drop(YEAR), clean.PRODUCTION_KEY).withColumn(YEAR, F.year("production_month"))
    write_table(stored(merged, "merged"), path, [YEAR], rebalance=True, only_touched_partitions=True)


def refresh(spark: SparkSession, paths: TablePaths) -> Refresh:
    """Bring the clean and KPI tables up to date with the raw tables."""
    checkpoint_root(spark)  # fail before any work if the cluster names no shared folder
    done = Refresh()
    new = {}
    for table in ("bronze_flaring", "bronze_well_metadata", "bronze_well_production"):
        if files := _unseen(spark, paths, table).collect():  # one row a feed file
            new[table] = files
            done.files[table] = sorted(f.source_file for f in files)
    if not new:
        return done

    years = set(_years(_or_empty(spark, paths, "silver_open_years", f"{YEAR} int")))  # of a refresh that failed
    if files := new.get("bronze_flaring"):
        rows = clean.clean_flaring(_new_rows(spark, paths, "bronze_flaring", files))
        merged, _ = _merged_dimension(spark, paths, "silver_flaring", rows, "operator", schemas.SILVER_FLARING)
        write_table(merged, paths.of("silver_flaring"))
    if files := new.get("bronze_well_production"):
        rows = clean.clean_production(_new_rows(spark, paths, "bronze_well_production", files))
        changes = stored(rows.withColumn(YEAR, F.year("production_month")), "changes")
        if in_changes := _years(changes):
            years.update(in_changes)
            _note(spark, paths, years)
            _merge_facts(spark, paths, changes, in_changes)
    facts = paths.of("silver_facts")
    if files := new.get("bronze_well_metadata"):
        rows = clean.clean_wells(_new_rows(spark, paths, "bronze_well_metadata", files))
        merged, changed = _merged_dimension(spark, paths, "silver_wells", rows, "api_number", schemas.SILVER_WELLS)
        if path_exists(spark, facts):
            years.update(_years(scan_table(spark, facts).join(changed, "api_number", "left_semi")))
            _note(spark, paths, years)
        write_table(merged, paths.of("silver_wells"))

    done.years = sorted(years)
    if years:
        _refresh_years(spark, paths, done.years)
    done.counts = _refresh_kpis(spark, paths)
    _note(spark, paths, set())
    append_table(spark.createDataFrame([f for files in new.values() for f in files], SEEN), paths.of("silver_seen_files"))
    return done


def land(spark: SparkSession, raw_dir: str, paths: TablePaths) -> list[str]:
    """Add the feed files of a folder that the raw tables do not hold yet; returns their names."""
    return [path.rstrip("/").rsplit("/", 1)[-1] for feed, path in feeds.arrived(spark, raw_dir) if feeds.ingest_more(spark, feed, path, paths)]


def _or_empty(spark: SparkSession, paths: TablePaths, table: str, schema) -> DataFrame:
    path = paths.of(table)
    return scan_table(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _refresh_years(spark: SparkSession, paths: TablePaths, years: list[int]) -> None:
    """Silver production and the partial aggregates of some years."""

    def write(df: DataFrame, table: str) -> DataFrame:
        write_table(df, paths.of(table), [YEAR], rebalance=True, only_touched_partitions=True)
        return df

    facts = scan_table(spark, paths.of("silver_facts")).filter(F.col(YEAR).isin(years)).drop(YEAR)
    wells = _or_empty(spark, paths, "silver_wells", schemas.SILVER_WELLS)
    write(clean.enrich_production(facts, wells), "silver_production")
    touched = stages.silver_production(spark, paths).filter(F.col(YEAR).isin(years))
    write(kpi.operator_month_rollup(touched), "gold_operator_months")
    write(kpi.well_partials(touched, YEAR), "gold_well_years")


def _refresh_kpis(spark: SparkSession, paths: TablePaths) -> dict[str, int]:
    """The KPI tables from the partial aggregates."""
    if not path_exists(spark, paths.of("gold_operator_months")):
        return {}
    rollup = scan_table(spark, paths.of("gold_operator_months"))
    flaring = _or_empty(spark, paths, "silver_flaring", schemas.SILVER_FLARING)
    write_table(kpi.well_summary_of(kpi.merge_well_partials(scan_table(spark, paths.of("gold_well_years")))), paths.of("gold_well_summary"))
    wells = scan_table(spark, paths.of("gold_well_summary"), schemas.GOLD_WELL_SUMMARY)
    for table, build in stages.kpi_builds(rollup, wells, flaring).items():
        write_table(build(), paths.of(table))
    return {table: written_rows(spark, paths.of(table)) for table in ("gold_well_summary", *stages.kpi_builds(rollup, wells, flaring))}

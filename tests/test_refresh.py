"""Refreshing stored tables against building them from all raw rows at once."""

import pytest

from helpers import rows
from prodlake import schemas
from prodlake.plans import refresh, stages
from prodlake.sources import feeds, tables
from prodlake.sources.tables import TablePaths

HEADER = "api_number,well_name,operator,production_month,oil_and_gas_group,production,shale_play,basin"
CHECKED = [t for t in (*schemas.SILVER_TABLES, *schemas.KPI_TABLES) if t != "gold_production_forecast"]


def line(well, t, group="O", value=1.0, operator="Hess", name=""):
    return f"{well},{name},{operator},{2018 + t // 12}-{t % 12 + 1:02d}-01,{group},{value},Bakken,B"


FIRST = [line(w, t, g, 100 + 8 * t, f"op{w}") for w in ("w1", "w2", "w3") for t in range(36) for g in "OG"]
# a smaller row for a known key, the same row again, a larger one, a broken one, a new well and a new year
SECOND = [line("w1", 13, "O", 5), FIRST[0], line("w2", 14, "O", 999, "opw2"), line("w2", 15, "O", -1), line("w9", 14, "G", 3), line("w1", 40, "O", 6, "opw1")]
WELLS = ["SquareRootSum,Well Name,API Number", "5.5,one,w1", ",two,w2"]
FLARING = ["Operator,TotalFlaredGas_MCf", '"hess ","1,234"', "OPW1,99"]


class Load:
    """Feed files in a folder, landed one by one."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.paths = spark, folder, TablePaths(str(folder / "tables"))

    def land(self, table, name, lines):
        (self.folder / name).write_text("\n".join(lines) + "\n")
        return feeds.ingest_more(self.spark, feeds.FEEDS[table], str(self.folder / name), self.paths)

    def refresh(self):
        return refresh.refresh(self.spark, self.paths)

    def table(self, name):
        schema = (schemas.SILVER_TABLES | schemas.KPI_TABLES)[name]
        return tables.scan_table(self.spark, self.paths.of(name), schema).drop("load_timestamp")

    def files(self):
        found = stages.silver_production(self.spark, self.paths).select("production_year", "_metadata.file_path").distinct().collect()
        return {y: sorted(f for year, f in found if year == y) for y, _ in found}


def rebuilt(spark, folder, production, wells, flaring):
    folder.mkdir()
    for name, lines in (("synthetic_well_production.csv", production), ("well_metadata.csv", wells), ("flaring.csv", flaring)):
        (folder / name).write_text("\n".join(lines) + "\n")
    root = str(folder / "tables")
    stages.run(spark, str(folder), root)
    return root


def assert_equal_tables(load, root):
    for name in CHECKED:
        schema = (schemas.SILVER_TABLES | schemas.KPI_TABLES)[name]
        want = tables.scan_table(load.spark, TablePaths(root).of(name), schema).drop("load_timestamp")
        got, expected = rows(load.table(name), *want.columns), rows(want, "*")
        assert len(got) == len(expected), name
        for g, e in zip(got, expected, strict=True):
            assert g == pytest.approx(e) if all(x is None or isinstance(x, float) for x in g) else [x if not isinstance(x, float) else pytest.approx(x) for x in e] == list(g), name


def test_a_second_file_changes_its_years_only(spark, tmp_path):
    load = Load(spark, tmp_path)
    assert load.refresh() == refresh.Refresh()
    load.land("bronze_well_production", "one.csv", [HEADER, *FIRST])
    load.land("bronze_well_metadata", "wells.csv", WELLS)
    load.land("bronze_flaring", "flaring.csv", FLARING)
    assert load.refresh().years == [2018, 2019, 2020]
    before = load.files()
    assert load.land("bronze_well_production", "two.csv", [HEADER, *SECOND])
    done = load.refresh()
    # the second file repeats a row of 2018, which is a change of no value but of that year's files
    assert (done.files, done.years) == ({"bronze_well_production": ["two.csv"]}, [2018, 2019, 2021])
    after = load.files()
    assert after[2020] == before[2020] and after[2019] != before[2019] and sorted(after) == [2018, 2019, 2020, 2021]
    assert_equal_tables(load, rebuilt(spark, tmp_path / "all", [HEADER, *FIRST, *SECOND], WELLS, FLARING))
    # nothing new: nothing to do; a file name that is known is not landed again
    assert not load.land("bronze_well_production", "two.csv", [HEADER, *SECOND])
    assert load.refresh() == refresh.Refresh() and load.files() == after


def test_new_metadata_touches_the_years_of_its_wells(spark, tmp_path):
    load = Load(spark, tmp_path)
    late = [line("w5", 40, "O", 7)]
    load.land("bronze_well_production", "one.csv", [HEADER, *FIRST, *late])
    load.land("bronze_well_metadata", "wells.csv", WELLS)
    load.refresh()
    before = load.files()
    load.land("bronze_well_metadata", "more.csv", [WELLS[0], "8.5,five,w5", "5.5,one,w1", "9,zzz,w2", "1,none,w8"])
    load.land("bronze_flaring", "flaring.csv", FLARING)
    assert load.refresh().years == [2021]
    after = load.files()
    assert {y for y in after if after[y] != before[y]} == {2021}
    assert rows(load.table("silver_production").filter("api_number = 'w5'"), "well_name", "well_length_ft") == [("five", 8.5)]
    wells = [*WELLS, "8.5,five,w5", "5.5,one,w1", "9,zzz,w2", "1,none,w8"]
    assert_equal_tables(load, rebuilt(spark, tmp_path / "all", [HEADER, *FIRST, *late], wells, FLARING))


def test_a_refresh_that_fails_is_run_again(spark, tmp_path, monkeypatch):
    load = Load(spark, tmp_path)
    load.land("bronze_well_production", "one.csv", [HEADER, *FIRST])
    load.land("bronze_well_metadata", "wells.csv", WELLS)
    load.land("bronze_flaring", "flaring.csv", FLARING)
    load.refresh()
    load.land("bronze_well_production", "two.csv", [HEADER, *SECOND])
    load.land("bronze_well_metadata", "more.csv", [WELLS[0], "7.5,three,w3"])

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(refresh, "_refresh_years", broken)
        with pytest.raises(OSError):
            load.refresh()
    assert load.refresh().years == [2018, 2019, 2020, 2021]
    assert_equal_tables(load, rebuilt(spark, tmp_path / "all", [HEADER, *FIRST, *SECOND], [*WELLS, "7.5,three,w3"], FLARING))


def test_files_that_arrive_in_a_folder(spark, tmp_path):
    raw, paths = tmp_path / "raw", TablePaths(str(tmp_path / "tables"))
    raw.mkdir()
    (raw / "synthetic_well_production.csv").write_text("\n".join([HEADER, *FIRST]) + "\n")
    (raw / "flaring.csv").write_text("\n".join(FLARING) + "\n")
    assert sorted(refresh.land(spark, str(raw), paths)) == ["flaring.csv", "synthetic_well_production.csv"]
    assert refresh.refresh(spark, paths).years == [2018, 2019, 2020]
    (raw / "synthetic_well_production_2.csv").write_text("\n".join([HEADER, line("w1", 40)]) + "\n")
    assert refresh.land(spark, str(raw), paths) == ["synthetic_well_production_2.csv"]
    done = refresh.refresh(spark, paths)
    assert done.years == [2021] and done.counts["gold_flaring_intensity"] == 2


def test_the_facts_of_other_years_are_not_read(spark, tmp_path):
    load = Load(spark, tmp_path)
    load.land("bronze_well_production", "one.csv", [HEADER, *FIRST])
    load.refresh()
    touched = stages.silver_production(spark, load.paths).filter("production_year IN (2019)")
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [production_year" in plan or "PartitionFilters: [isnotnull(production_year" in plan


def test_rows_of_a_feed_file_are_not_dealt_by_their_file(spark, tmp_path):
    load = Load(spark, tmp_path)
    load.land("bronze_well_production", "synthetic_well_production.csv", [HEADER, *FIRST])
    load.land("bronze_well_production", "synthetic_well_production_2.csv", [HEADER, *SECOND])
    files = refresh._unseen(spark, load.paths, "bronze_well_production").collect()
    first = [f for f in files if f.source_file == "synthetic_well_production.csv"]
    for wanted, lines in ((files, len(FIRST) + len(SECOND)), (first, len(FIRST))):
        found = refresh._new_rows(spark, load.paths, "bronze_well_production", wanted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert found.count() == lines

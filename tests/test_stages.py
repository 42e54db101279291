import os

import pytest

from helpers import rows
from prodlake import schemas
from prodlake.harness import bindings as bind
from prodlake.plans import stages
from prodlake.sources import feeds, tables
from prodlake.sources.tables import TablePaths

PRODUCTION_HEADER = "api_number,well_name,operator,production_month,oil_and_gas_group,production,shale_play,basin"


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    (folder / "flaring.csv").write_text('Operator,TotalFlaredGas_MCf\n"hess ","1,234"\nHESS,99\nX,\n')
    (folder / "well_metadata.csv").write_text("SquareRootSum,Well Name,API Number\n5.5,one,w1\n,two,w2\n7,,\n")
    lines = [PRODUCTION_HEADER]
    for well, operator in (("w1", "Hess"), ("w2", "hess "), ("w3", "Oasis")):
        for t in range(14):
            for group, scale in (("O", 1), ("G", 4)):
                day = f"{2018 + t // 12}-{t % 12 + 1:02d}-01"
                lines.append(f'{well},,{operator},{day},{group},{100 * scale * 0.9**t:.2f},"Bakken Shale, US",B')
    lines.append("w1,,Hess,2018-13-01,O,5,P,B")
    lines.append("w1,,Hess,2018-01-01,O,-5,P,B")
    (folder / "synthetic_well_production.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


@pytest.fixture(scope="module")
def root(spark, raw_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    counts = stages.run(spark, raw_dir, folder)
    return folder, counts


def test_counts_of_all_stages(root):
    assert root[1] == {
        "bronze_flaring": 3, "bronze_well_metadata": 3, "bronze_well_production": 86,  # two feeds absent
        "silver_wells": 2, "silver_flaring": 1, "silver_production": 84,
        "gold_operator_performance": 2, "gold_basin_production_trends": 28, "gold_flaring_intensity": 1,
        "gold_ethane_dry_gas": 4, "gold_well_summary": 3,
        "gold_production_forecast": 24 * (3 + 2 + 1),
    }


def test_raw_tables_are_strings_with_lineage(spark, root):
    raw = tables.scan_table(spark, TablePaths(root[0]).of("bronze_well_production"))
    kinds = dict(raw.dtypes)
    assert kinds.pop("load_timestamp") == "timestamp"
    assert kinds.pop("ingest_year") in ("int", "string")  # a folder name
    assert set(kinds.values()) == {"string"}
    assert rows(raw.select("source_file", "data_source").distinct(), "*") == [
        ("synthetic_well_production.csv", "modelled_feed")
    ]
    assert raw.where("well_name IS NULL").count() == 86


def test_stored_tables_have_their_schemas(spark, root):
    for name, schema in schemas.KPI_TABLES.items():
        stored = tables.scan_table(spark, TablePaths(root[0]).of(name))
        assert [(f.name, f.dataType) for f in stored.schema] == [(f.name, f.dataType) for f in schema]


def test_year_filter_prunes_folders_and_columns(spark, root):
    facts = stages.silver_production(spark, TablePaths(root[0]))
    plan = facts.where("production_year = 2019").select("operator")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(production_year" in plan
    assert "ReadSchema: struct<operator:string>" in plan


def test_a_stage_runs_on_its_own_and_again(spark, root, raw_dir):
    assert stages.run(spark, raw_dir, root[0], "gold")["gold_well_summary"] == 3
    assert stages.run(spark, raw_dir, root[0], "silver")["silver_production"] == 84
    with pytest.raises(ValueError):
        stages.run(spark, raw_dir, root[0], "platinum")


def test_broken_lines_do_not_reach_the_raw_table(spark, raw_dir, tmp_path):
    for name in ("well_metadata.csv", "flaring.csv"):
        (tmp_path / name).write_text(open(f"{raw_dir}/{name}").read() + "1,2,3,4\n")
    counts = stages.run(spark, str(tmp_path), str(tmp_path / "tables"), "bronze", keep_broken=True)
    assert counts == {"bronze_flaring": 3, "bronze_flaring_broken": 1, "bronze_well_metadata": 3, "bronze_well_metadata_broken": 1}


def test_colliding_names_are_refused(spark):
    frame = spark.createDataFrame([(1, 2)], "`Well Name` int, well_name int")
    with pytest.raises(ValueError):
        feeds.sanitize_columns(frame)
    odd = spark.createDataFrame([(1, 2)], "`  API (Number); ` int, `a=b` int")
    assert feeds.sanitize_columns(odd).columns == ["api_number", "a_b"]


def test_csv_keeps_blanks_and_reads_empty_as_null(spark, tmp_path):
    (tmp_path / "f.csv").write_text('A,B\n" ",\n1,2.50\n')
    frame = feeds.scan_csv_strings(spark, str(tmp_path / "f.csv"))
    assert frame.dtypes == [("A", "string"), ("B", "string")]
    assert rows(frame, "*") == [(" ", None), ("1", "2.50")]


def test_a_missing_column_is_named(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Operator,More\nx,1\n")
    with pytest.raises(ValueError, match="TotalFlaredGas_MCf"):
        feeds.scan_csv_strings(spark, str(tmp_path / "f.csv"), feeds.FEEDS["bronze_flaring"].columns)
    frame = feeds.scan_csv_strings(spark, str(tmp_path / "f.csv"), ("Operator",))
    assert rows(frame, "*") == [("x", "1")]


def test_forecast_of_the_largest_wells_only(spark, root):
    counts = stages.run_forecast(spark, TablePaths(root[0]), top_n=1)
    assert counts["gold_production_forecast"] == 24 * (1 + 2 + 1)
    stages.run_forecast(spark, TablePaths(root[0]))


def test_overwrite_replaces_schema_and_dynamic_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "y int, v string")
    tables.write_table(frame.withColumnRenamed("v", "old"), path)
    tables.write_table(frame, path, ["y"], rebalance=True)
    assert rows(tables.scan_table(spark, path), "v", "y") == [("a", 1), ("b", 2)]
    one = spark.createDataFrame([(2, "c")], "y int, v string")
    tables.write_table(one, path, ["y"], only_touched_partitions=True)
    assert rows(tables.scan_table(spark, path), "v", "y") == [("a", 1), ("c", 2)]


def test_rebalance_writes_few_files(spark, tmp_path):
    path = tmp_path / "t"
    frame = spark.range(4000).selectExpr("id", "id % 5 AS y").repartition(40)
    tables.write_table(frame, str(path), ["y"], rebalance=True)
    assert len(list(path.glob("y=*/*.parquet"))) <= 10


def test_views(spark, root):
    tables.register_views(spark, TablePaths(root[0]), ["silver_flaring"])
    assert spark.sql("SELECT COUNT(*) FROM silver_flaring").first()[0] == 1


def test_checkpoint_folder_must_be_shared(spark, monkeypatch):
    from prodlake import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are not here")
@pytest.mark.parametrize("feed", ["raw_production", "raw_shale_production"])
def test_line_items_of_a_feed_are_summed_after_their_shuffle(spark, monkeypatch, feed):
    """Sums before it held nearly every row of a split of the file, however large, and spilled them."""
    made = getattr(bind, feed)(spark, "/root/testdata/sf0.01")
    lines = made._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next((i for i, line in enumerate(lines) if "hashpartitioning(l_suppkey" in line and "REPARTITION_BY_NUM" in line), None)
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "l_extendedprice" in line)
    assert dealt is not None and not any("Aggregate" in line for line in lines[dealt:scan])
    monkeypatch.setattr(bind, "TASK_BYTES", 50_000)
    tasks = bind._shipped(spark, "/root/testdata/sf0.01", dealt=True).rdd.getNumPartitions()
    assert tasks == -(-os.path.getsize("/root/testdata/sf0.01/lineitem.parquet") // 50_000)

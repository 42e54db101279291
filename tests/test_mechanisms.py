"""Sketches, joins over time, reconciliation, broken lines, stream windows and SQL functions."""

import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import fact, production, rows
from prodlake.functions import expr
from prodlake.functions import sql as sql_functions
from prodlake.operators import clean, reconcile, sketches, temporal
from prodlake.sources import feeds, tables
from prodlake.sources.tables import TablePaths
from prodlake.streaming import windows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sketches ----------------------------------------------------------------------------


def test_any_subset_from_stored_sketches(spark, tmp_path):
    draw = random.Random(2)
    facts = [fact(f"w{draw.randrange(3000)}", draw.randrange(24), "OG"[i % 2], draw.lognormvariate(3, 2), f"OP{min(draw.randrange(6), 2)}", f"P{i % 3}") for i in range(12000)]
    path = str(tmp_path / "sketches")
    tables.write_table(sketches.production_sketches(production(spark, facts)), path)
    table = tables.scan_table(spark, path)
    for wanted in (lambda f: True, lambda f: f[2] == "OP2", lambda f: f[8] == "P1" and f[4] == 2018):
        subset = [f for f in facts if wanted(f)]
        where = {0: "true", 1: "operator = 'OP2'", 2: "shale_play = 'P1' AND year(production_month) = 2018"}
        chosen = table.filter(where[[len(subset) == len(facts), all(f[2] == "OP2" for f in subset), all(f[8] == "P1" for f in subset)].index(True)])
        got = sketches.estimates(sketches.roll_up(chosen), {"p5": 0.05, "p50": 0.5, "p99": 0.99}).first()
        values = sorted(f[7] for f in subset)
        assert got.reports == len(values)
        for name, p in (("p5", 0.05), ("p50", 0.5), ("p99", 0.99)):
            below = sum(v < got[name] for v in values) / len(values)
            assert abs(below - p) <= sketches.RANK_ERROR + 1 / len(values)
        exact = len({f[0] for f in subset})
        assert abs(got.wells - exact) <= max(1, exact * sketches.COUNT_ERROR)


def test_sketches_of_nothing(spark):
    facts = production(spark, [fact(value=None), fact("w2", 1, value=3)])
    table = sketches.production_sketches(facts)
    got = {r.production_month.month: (r.p50, r.reports, r.wells) for r in sketches.estimates(table, {"p50": 0.5}).collect()}
    assert got == {1: (None, 0, 1), 2: (3.0, 1, 1)}
    one = sketches.merge_quantiles(sketches.quantile_sketches(facts, ["operator"], "production"), [])
    assert sketches.quantiles(one, {"p50": 0.5}).first().p50 == 3.0
    assert sketches.merge_distinct(sketches.distinct_sketches(facts, ["operator"], "api_number"), []).select(F.hll_sketch_estimate("sketch")).first()[0] == 2


# --- joins over time ---------------------------------------------------------------------

day = st.integers(0, 1500).map(lambda n: dt.date(2017, 1, 1) + dt.timedelta(n))
keys = st.sampled_from(["a", "a", "a", "b", None])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(keys, st.one_of(day, st.none())), min_size=1, max_size=60), st.lists(st.tuples(keys, st.one_of(day, st.none()), st.integers(0, 5)), max_size=40))
def test_asof_equals_brute_force(spark, facts, versions):
    left = spark.createDataFrame([(i, k, d) for i, (k, d) in enumerate(facts)], "id int, well string, day date")
    right = spark.createDataFrame(versions, "well string, since date, status int")
    want = []
    for i, (k, d) in enumerate(facts):
        valid = [(s, v) for w, s, v in versions if w == k and k is not None and s is not None and d is not None and s <= d]
        want.append((i, k, d, max(valid)[1] if valid else None))
    got = temporal.asof_join(left, right, "well", "day", "since", ["status"])
    assert got.columns == ["id", "well", "day", "status"]
    assert sorted(map(tuple, got.collect())) == want


def test_asof_spreads_a_hot_key(spark):
    """No range join, and a key's rows are sorted slice by slice."""
    left = spark.range(1000).select(F.lit("hot").alias("well"), F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int") * 5).alias("day"))
    right = spark.createDataFrame([("hot", dt.date(2011, 5, 5), "x")], "well string, since date, status string")
    joined = temporal.asof_join(left, right, "well", "day", "since", ["status"])
    plan = plan_of(joined)
    assert "Join" not in plan
    assert "hashpartitioning(_key" in plan and any("_slice" in part for part in plan.split("hashpartitioning(")[1:])
    assert rows(joined.groupBy("status").count(), "*") == sorted([(None, 98), ("x", 902)], key=repr)


def interval():
    return st.tuples(keys, st.integers(0, 9000), st.one_of(st.integers(0, 40), st.integers(0, 9000)))


@settings(max_examples=12, deadline=None)
@given(st.lists(interval(), max_size=40), st.lists(interval(), max_size=40), st.sampled_from([1, 7, 32]))
def test_overlap_equals_brute_force(spark, left, right, width):
    def dated(rows_, names):
        start = dt.date(1990, 1, 1)
        made = [(i, k, start + dt.timedelta(a), start + dt.timedelta(a + n)) for i, (k, a, n) in enumerate(rows_)]
        return spark.createDataFrame(made, f"{names}_id int, well string, {names}_from date, {names}_to date")

    want = Counter((i, j) for i, (k, a, n) in enumerate(left) for j, (k2, b, m) in enumerate(right) if k is not None and k == k2 and n and m and a < b + m and b < a + n)
    joined = temporal.overlap_join(dated(left, "l"), dated(right, "r"), "well", ("l_from", "l_to"), ("r_from", "r_to"), width)
    assert joined.columns == ["l_id", "well", "l_from", "l_to", "r_id", "r_from", "r_to"]
    assert Counter((r.l_id, r.r_id) for r in joined.collect()) == want


def test_a_long_interval_stands_in_few_buckets(spark):
    long = spark.createDataFrame([("a", 0, 3_000_000)], "well string, s bigint, e bigint")
    placed = temporal._buckets(long, F.col("s"), F.col("e"), 1, "left")
    assert placed.count() <= 2 * temporal.LEVELS
    some = spark.createDataFrame([("a", dt.date(1, 1, 1), dt.date(9999, 1, 1))], "well string, f date, t date")
    joined = temporal.overlap_join(some, some.toDF("well", "f2", "t2"), "well", ("f", "t"), ("f2", "t2"), 1)
    assert joined.count() == 1 and "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


# --- reconciliation ----------------------------------------------------------------------

RAW = "api_number string, well_name string, operator string, production_month string, oil_and_gas_group string, production string, shale_play string, basin string"


def test_every_raw_row_is_accounted_for(spark):
    draw = random.Random(4)
    pick = draw.choice
    data = [
        (pick(["w1", "w2", None]), pick(["x", None]), pick([" hess", "HESS", "b", None]), pick(["2020-01-01", "2020-02-01", "2020/01/01", "bad"]),
         pick("OG"), pick(["1", "1.0", "2", "-3", "1,000", None]), "P", None)
        for _ in range(3000)
    ]
    raw = spark.createDataFrame(data, RAW)
    got = reconcile.production_ledger(raw.withColumn("source_file", F.lit("f")))
    assert got.columns == [*raw.columns, "outcome", "rows"]
    # the raw rows come back as often as they are there
    back = got.groupBy(*raw.columns).agg(F.sum("rows").alias("n"))
    assert Counter({tuple(r)[:-1]: r.n for r in back.collect()}) == Counter(data)
    totals = {r.outcome: r.rows for r in reconcile.totals(got).collect()}
    kept = clean.clean_production(raw)
    assert sum(totals.values()) == len(data) and totals["kept"] == kept.count()
    assert set(totals) == {"kept", "copy", "superseded", "no api_number", "unreadable month", "no operator", "unreadable volume", "negative volume"}
    # kept raw rows are the clean rows
    typed = clean.typed_production(got.filter("outcome = 'kept'"))
    assert rows(typed, "*") == rows(kept, *typed.columns)
    dropped = reconcile.bag_difference(clean.typed_production(raw), kept)
    assert dropped.count() == len(data) - totals["kept"]
    assert reconcile.bag_intersection(clean.typed_production(raw), kept).count() == totals["kept"]


def test_a_row_that_a_third_of_all_repeat(spark):
    raw = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("api_number"), F.lit("n").alias("well_name"), F.lit("1").alias("squarerootsum")
    ).select("squarerootsum", "well_name", "api_number")
    got = reconcile.wells_ledger(raw)
    assert rows(reconcile.totals(got), "*") == [("copy", 2999), ("kept", 6001)]
    plan = plan_of(got)
    assert "Window" not in plan and "partial_count" in plan


def test_broken_lines_are_kept_apart(spark, tmp_path):
    feed = feeds.FEEDS["bronze_well_metadata"]
    lines = ["SquareRootSum,Well Name,API Number", "1,one,w1", "2,two", "3,three,w3,more", '4,"a, b",w4', '5,"open,w5', ",,", "6,,w6", '7,"line,\\"q\\"",w7']
    (tmp_path / feed.file_name).write_text("\n".join(lines) + "\n")
    paths = TablePaths(str(tmp_path / "tables"))
    counts = feeds.ingest_checked(spark, feed, str(tmp_path / feed.file_name), paths)
    assert counts == {"bronze_well_metadata": 5, "bronze_well_metadata_broken": 3}
    good = tables.scan_table(spark, paths.of(feed.table))
    assert {k for c, k in good.dtypes if c != "load_timestamp"} == {"string"}
    assert rows(good, "squarerootsum", "well_name", "api_number") == sorted(
        [("1", "one", "w1"), ("4", "a, b", "w4"), (None, None, None), ("6", None, "w6"), ("7", 'line,"q"', "w7")], key=repr
    )
    broken = tables.scan_table(spark, paths.of(f"{feed.table}_broken"))
    assert rows(broken, "line", "source_file") == [(x, feed.file_name) for x in sorted([lines[2], lines[3], lines[5]], key=lambda x: repr((x,)))]
    with pytest.raises(ValueError):
        feeds.ingest_checked(spark, feeds.FEEDS["bronze_flaring"], str(tmp_path / feed.file_name), paths)


# --- windows over a stream ---------------------------------------------------------------


def events(spark, rows_):
    made = [(i, dt.datetime.fromisoformat(ts), user, "click", float(value), None) for i, (ts, user, value) in enumerate(rows_)]
    return spark.createDataFrame(made, windows.EVENTS)


def run(spark, folder, build):
    made = build(windows.event_stream(spark, str(folder / "in"), files_at_once=1))
    windows.run_to_table(made, str(folder / "out"), str(folder / "checkpoint"))
    got = spark.read.schema(made.schema).parquet(str(folder / "out"))
    return sorted((r.window_start.strftime("%d %H:%M"), r.window_end.strftime("%d %H:%M"), r.events, r.value) for r in got.collect())


def test_tumbling_windows_and_a_late_row(spark, tmp_path):
    events(spark, [("2024-01-01 00:10:00", 1, 1), ("2024-01-01 00:50:00", 2, 2), ("2024-01-01 03:05:00", 1, 4)]).coalesce(1).write.parquet(str(tmp_path / "in"))
    build = lambda e: windows.tumbling(e, "1 hour")
    first = [("01 00:00", "01 01:00", 2, 3.0)]
    assert run(spark, tmp_path, build) == first
    # behind the watermark of 02:05: too late; before the latest event, but not behind it: counted
    late = [("2024-01-01 00:20:00", 1, 100), ("2024-01-01 02:30:00", 1, 8), ("2024-01-01 06:00:00", 1, 16)]
    events(spark, late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path, build) == [*first, ("01 02:00", "01 03:00", 1, 8.0), ("01 03:00", "01 04:00", 1, 4.0)]
    assert len(run(spark, tmp_path, build)) == 3  # nothing new


def test_sliding_windows_and_sessions(spark, tmp_path):
    data = [("2024-01-01 00:10:00", 1, 1), ("2024-01-01 00:25:00", 1, 2), ("2024-01-01 01:30:00", 1, 4), ("2024-01-01 00:20:00", 2, 8), ("2024-01-02 00:00:00", 3, 0)]
    for name in ("sliding", "sessions"):
        events(spark, data).coalesce(1).write.parquet(str(tmp_path / name / "in"))
    got = run(spark, tmp_path / "sliding", lambda e: windows.sliding(e, "1 hour", "30 minutes"))
    assert got == [("01 00:00", "01 01:00", 3, 11.0), ("01 01:00", "01 02:00", 1, 4.0), ("01 01:30", "01 02:30", 1, 4.0), ("31 23:30", "01 00:30", 3, 11.0)]
    got = run(spark, tmp_path / "sessions", lambda e: windows.sessions(e, "30 minutes"))
    assert got == [("01 00:10", "01 00:55", 2, 3.0), ("01 00:20", "01 00:50", 1, 8.0), ("01 01:30", "01 02:00", 1, 4.0)]


# --- SQL functions -----------------------------------------------------------------------


def test_functions_equal_the_column_helpers(spark):
    sql_functions.register_functions(spark, tables=False)
    values = [None, -1.0, 0.0, 0.2, 0.3, 0.31, 4.99, 5.0, 15.0, 15.1, float("inf")]
    spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double").createOrReplaceTempView("pairs")
    got = spark.sql("SELECT safe_ratio(a, b) AS r, growth_pct(a, b) AS g, share_pct(a, b) AS s, flaring_class(a) AS f, basin_class(a) AS c, basin_class(a, 5) AS c5 FROM pairs")
    a, b = F.col("a"), F.col("b")
    want = spark.table("pairs").select(
        expr.safe_ratio(a, b).alias("r"), expr.growth_pct(a, b).alias("g"), expr.share_pct(a, b).alias("s"), expr.flaring_category(a).alias("f"),
        expr.basin_category(a).alias("c"), expr.basin_category(a, 5).alias("c5"),
    )
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Python" not in plan_of(got)
    assert spark.sql("SELECT quarter_label(DATE '2018-05-03'), period_label(DATE '2018-05-03'), quarter_label(NULL)").first()[:] == ("Q2", "2018Q2", None)


def test_table_function_pushes_its_filter_down(spark, tmp_path):
    paths = TablePaths(str(tmp_path))
    rows_ = [("operator", "A", dt.date(2020, 1, 1), 1.0, 2.0, "flat", 0.5, 1.0, 0.0, 0.0), ("well", "A", dt.date(2020, 1, 1), 9.0, 9.0, "flat", 0.5, 1.0, 0.0, 0.0)]
    from prodlake import schemas

    tables.write_table(spark.createDataFrame(rows_, schemas.GOLD_FORECAST), paths.of("gold_production_forecast"))
    tables.register_views(spark, paths, ["gold_production_forecast"])
    sql_functions.register_functions(spark)
    got = spark.sql("SELECT * FROM forecast_slice('operator', 'A')")
    assert rows(got, "forecast_oil_bbl", "model_type") == [(1.0, "flat")]
    assert "EqualTo(entity_type,operator)" in plan_of(got)

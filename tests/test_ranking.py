"""Places without one task per group, against plain sorting."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import runs
from lexmill.operators.ranking import ranked


@pytest.fixture(scope="module")
def rows(spark):
    data = [(("a", "b", None, "")[i % 7 % 4], i * 37 % 101 if i % 11 else None, i) for i in range(2_000)]
    return spark.createDataFrame(data, "g string, v int, i int").withColumn("place_of", F.lit("x")).repartition(5)


def test_places_equal_sorting(rows):
    found = ranked(rows, ["g"], [F.desc_nulls_last("v"), "i"])
    assert found.columns == [*rows.columns, "place"]
    got = sorted((r["g"] or "", r["g"] is None, r["place"], r["i"]) for r in found.collect())
    expected = []
    for g in ("a", "b", None, ""):
        mine = sorted((r for r in rows.collect() if r["g"] == g), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["i"]))
        expected += [(g or "", g is None, place, r["i"]) for place, r in enumerate(mine, 1)]
    assert got == sorted(expected)


def test_places_of_a_whole_table(rows):
    got = [(r["place"], r["i"]) for r in ranked(rows, [], ["i"], "place").collect()]
    assert sorted(got) == [(i + 1, i) for i in range(2_000)]


def test_repeated_rows_spread_over_ranges(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = _ranked_copies(spark)
    finally:
        spark.conf.unset(setting)
    assert found.agg(F.count_distinct("place"), F.min("place"), F.max("place")).first() == (40_000, 1, 40_000)
    path = found.inputFiles()[0].rsplit("/", 1)[0]
    parts = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 20_000


def _ranked_copies(spark):
    same = spark.range(40_000).select(F.lit("a").alias("g"), F.lit(1).alias("v"))
    return ranked(same, ["g"], ["v"])


def test_nothing_has_no_places(spark):
    nothing = spark.createDataFrame([], "g string, v int")
    assert ranked(nothing, ["g"], ["v"]).count() == 0
    assert ranked(nothing, [], ["v"]).count() == 0


def test_no_window_holds_an_experiment(rows):
    board = runs.run_leaderboard(rows.select(F.col("g").alias("experiment"), "v", F.col("i").alias("run_id")), "v")
    plan = board._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("experiment" not in line and "_rank_g" not in line for line in windows)

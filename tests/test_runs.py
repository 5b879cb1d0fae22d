import pytest
from hypothesis import given, settings, strategies as st

from lexmill.operators import runs

ENTRIES = "run_id string, best_step bigint, pos int, step bigint, eval_f1 double, train_runtime double, train_loss double"


def test_best_metrics_prefers_the_row_with_the_metric(spark):
    rows = [
        ("a", 20, 0, 10, 0.1, None, None),
        ("a", 20, 1, 20, None, None, None),
        ("a", 20, 2, 20, 0.7, None, None),
        ("a", 20, 3, 20, None, 9.0, 0.3),
        ("b", 5, 0, 5, None, None, None),
        ("b", 5, 1, 6, 0.2, 1.0, 0.1),
        ("b", 5, 2, 6, 0.2, 2.0, 0.2),
    ]
    frame = spark.createDataFrame(rows, ENTRIES)
    got = {r["run_id"]: tuple(r)[1:] for r in runs.best_metrics(frame, ["eval_f1"], "eval_f1").collect()}
    assert got == {"a": (20, 0.7, 9.0, 0.3), "b": (5, None, 1.0, 0.1)}


def test_best_checkpoint_tie_goes_to_the_earliest_epoch(spark):
    frame = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("a", 4, None)], "run_id string, epoch int, metric double")
    assert tuple(runs.best_checkpoint(frame).first()) == ("a", 2, 0.9)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([0.1, 0.2, 0.3]), min_size=1, max_size=6), st.integers(1, 4))
def test_retention_table_equals_the_rule(spark, values, limit):
    metric_of = {i + 1: v for i, v in enumerate(values)}
    frame = spark.createDataFrame([("a", e, m) for e, m in metric_of.items()], "run_id string, epoch int, metric double")
    kept = runs.checkpoint_retention(frame, limit).where("kept").collect()
    assert sorted(r["epoch"] for r in kept) == runs.checkpoints_to_keep(metric_of, limit)


@pytest.fixture
def store(spark, tmp_path):
    return runs.RunStore(spark, str(tmp_path))


def test_empty_store(store):
    assert store.runs().count() == 0
    with pytest.raises(LookupError, match="Production"):
        store.resolve("m")


def test_log_and_leaderboard(store):
    for run_id, f1 in (("r1", 0.5), ("r2", 0.8), ("r3", None)):
        store.log_run("exp", run_id, "bayes", {"eval_f1": f1}, {"epochs": 3})
    board = store.leaderboard("eval_f1").orderBy("place").collect()
    assert [(r["run_id"], r["place"]) for r in board] == [("r2", 1), ("r1", 2)]
    assert store.runs().where("run_id = 'r1'").first()["params"] == {"epochs": "3"}


def test_versions_and_stages(store):
    assert [store.register("m", r) for r in ("r1", "r2", "r3")] == [1, 2, 3]
    assert store.register("other", "r9") == 1
    store.move("m", 1, "Production")
    store.move("m", 2, "Production")
    store.move("other", 1, "Production")
    got = store.resolve("m")
    assert (got["version"], got["run_id"]) == (2, "r2")
    assert got["artifact_root"] + "/model" == got["source"]
    store.move("m", 2, "Archived")
    assert store.resolve("m")["version"] == 1
    assert store.resolve("m", "None")["version"] == 3
    with pytest.raises(LookupError):
        store.resolve("m", "Staging")
    with pytest.raises(ValueError):
        store.move("m", 1, "Elsewhere")


def test_leaderboard_ties_are_broken_by_run(spark):
    frame = spark.createDataFrame([("e", "b", 1.0), ("e", "a", 1.0), ("e", "c", 0.5)], "experiment string, run_id string, f1 double")
    got = runs.run_leaderboard(frame, "f1", top=2).orderBy("place").collect()
    assert [r["run_id"] for r in got] == ["a", "b"]

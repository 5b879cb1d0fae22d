import numpy as np
import pytest

from lexmill.operators.metrics import evaluate
from lexmill.operators.runs import checkpoints_to_keep
from lexmill.operators.scoring import score
from lexmill.operators.softmax import fit_softmax, load_softmax, softmax_predictor
from lexmill.sources import log_history, read_log_history


@pytest.fixture(scope="module")
def run(spark, split, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("softmax"))
    return fit_softmax(*split, path, 4, "doc_id", batch_size=8, epochs=3, parallelism=2, save_total_limit=2)


def test_learns(spark, split, run):
    model, state = run
    losses = [e["loss"] for e in state.log_history if "loss" in e]
    assert losses == sorted(losses, reverse=True)
    got = evaluate(score(split[1], softmax_predictor(spark, model)))
    assert got["f1"] > got["majority_f1"]
    assert got["f1"] == pytest.approx(state.best_metric)


def test_best_checkpoint_can_be_restored(spark, run):
    model, state = run
    again = load_softmax(spark, state.path, state.best_epoch)
    assert np.allclose(again.weights, model.weights) and again.bits == model.bits


def test_at_most_the_limit_of_checkpoints_stay(run):
    import os

    _, state = run
    folders = sorted(f for f in os.listdir(state.path) if f.startswith("epoch="))
    assert folders == [f"epoch={e}" for e in state.kept_epochs]
    assert len(folders) == 2 and state.best_epoch in state.kept_epochs


def test_log_history_has_two_entries_per_epoch_and_a_summary(spark, run):
    _, state = run
    rows = log_history(read_log_history(spark, f"{state.path}/trainer_state", multi_line=False)).orderBy("pos").collect()
    assert len(rows) == 7 and rows[-1]["train_runtime"] > 0
    assert [r["eval_f1"] is not None for r in rows[:-1]] == [False, True] * 3


def test_same_seed_same_model(spark, split, run, tmp_path):
    model, _ = fit_softmax(*split, str(tmp_path), 4, "doc_id", batch_size=8, epochs=3, parallelism=2)
    assert np.allclose(model.weights, run[0].weights, atol=1e-9)


def test_lazy_run_stops_at_its_step_budget(spark, split, tmp_path):
    _, state = fit_softmax(
        *split, str(tmp_path), 4, "doc_id", batch_size=8, epochs=5, parallelism=1, lazy=True, max_steps=20
    )
    assert state.global_step == 20


def test_one_large_partition_gets_the_steps_of_idle_workers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"w{i % 7} x{i % 3}", i % 2) for i in range(1100)], "doc_id long, text string, label int")
    _, state = fit_softmax(
        rows.coalesce(1), rows, str(tmp_path), 2, "doc_id", batch_size=10, epochs=10, parallelism=2, lazy=True, max_steps=550
    )
    assert state.global_step == 550
    assert len([e for e in state.log_history if "eval_f1" in e]) == 10


def test_evaluates_by_steps(split, tmp_path):
    n = split[0].count()
    steps = -(-n // 16)  # two workers of eight rows
    _, state = fit_softmax(
        *split, str(tmp_path), 4, "doc_id", batch_size=8, epochs=2, parallelism=2, eval_steps=-(-steps // 2)
    )
    evaluations = [e for e in state.log_history if "eval_f1" in e]
    assert [e["epoch"] for e in evaluations] == [0.5, 1.0, 1.5, 2.0]
    assert all(e["eval_loss"] > 0 for e in evaluations)


def test_weights_are_bounded(split, tmp_path):
    with pytest.raises(ValueError, match="at most"):
        fit_softmax(*split, str(tmp_path), 4, "doc_id", bits=24)


def test_null_text_scores_null(spark, run):
    frame = spark.createDataFrame([(None,), ("",)], "text string")
    got = [r["probabilities"] for r in score(frame, softmax_predictor(spark, run[0])).collect()]
    assert sorted(p is None for p in got) == [False, True]


@pytest.mark.parametrize(
    "metric_of, limit, want",
    [
        ({1: 0.5}, 1, [1]),
        ({1: 0.9, 2: 0.5, 3: 0.6}, 1, [1, 3]),
        ({1: 0.9, 2: 0.5, 3: 0.6}, 2, [1, 3]),
        ({1: 0.5, 2: 0.5, 3: 0.5, 4: 0.1}, 3, [1, 3, 4]),
        ({1: 0.1, 2: 0.2}, 10, [1, 2]),
    ],
)
def test_retention(metric_of, limit, want):
    assert checkpoints_to_keep(metric_of, limit) == want


def test_a_killed_run_goes_on_where_it_was(spark, split, run, tmp_path, monkeypatch):
    from lexmill.operators import softmax

    path, whole_epoch, calls = str(tmp_path / "run"), softmax._run_epoch, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return whole_epoch(*args)

    options = {"batch_size": 8, "epochs": 3, "parallelism": 2, "save_total_limit": 2}
    monkeypatch.setattr(softmax, "_run_epoch", killed)
    with pytest.raises(KeyboardInterrupt):
        fit_softmax(*split, path, 4, "doc_id", **options)
    monkeypatch.setattr(softmax, "_run_epoch", whole_epoch)
    # What a run killed while it saved leaves: a checkpoint without its progress.
    softmax.save_checkpoint(spark, softmax.load_softmax(spark, path, 2), softmax.TrainingState(path), 3)
    assert softmax.newest_checkpoint(spark, path).metric_of.keys() == {1, 2}
    model, state = fit_softmax(*split, path, 4, "doc_id", resume=True, **options)
    want, whole = run
    assert np.allclose(model.weights, want.weights, atol=1e-9)
    assert (state.global_step, state.kept_epochs, state.best_epoch) == (whole.global_step, whole.kept_epochs, whole.best_epoch)
    pick = [(e["step"], e["epoch"], e.get("eval_f1")) for e in state.log_history]
    assert pick == [(e["step"], e["epoch"], e.get("eval_f1")) for e in whole.log_history]


def test_resuming_nothing_is_a_new_run(spark, split, run, tmp_path):
    model, _ = fit_softmax(*split, str(tmp_path), 4, "doc_id", batch_size=8, epochs=3, parallelism=2, resume=True)
    assert np.allclose(model.weights, run[0].weights, atol=1e-9)


def test_quotas_add_up_to_the_budget():
    from lexmill.operators.softmax import step_quotas

    assert step_quotas([100, 100], 10, 20) is None
    assert step_quotas([], 10, 0) is None
    for rows in ([1000, 10, 1, 0], [7] * 13, [5, 500]):
        whole = [-(-n // 10) for n in rows]
        for steps in range(sum(whole)):
            quotas = step_quotas(rows, 10, steps)
            assert sum(quotas) == steps and all(q <= w for q, w in zip(quotas, whole))


def test_a_budget_is_spent_over_uneven_partitions(spark, tmp_path):
    rows = spark.range(1_300).selectExpr("id as doc_id", "concat('w', id % 7) as text", "cast(id % 2 as int) as label")
    path = str(tmp_path / "in")
    for low, high in ((0, 1_000), (1_000, 1_010), (1_010, 1_200), (1_200, 1_201), (1_201, 1_300)):
        rows.where(f"doc_id >= {low} and doc_id < {high}").coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    _, state = fit_softmax(table, table, str(tmp_path / "m"), 2, "doc_id", batch_size=10, epochs=9, parallelism=3, lazy=True, max_steps=65)
    assert state.global_step == 65


def test_only_touched_features_leave_a_worker(spark, tmp_path):
    from pyspark.sql import functions as F

    from lexmill.operators import softmax

    rows = spark.range(400).selectExpr("id as doc_id", "concat('w', id % 9) as text", "cast(id % 2 as int) as label")
    features = rows.select("label", softmax.hashed_tokens("text", 17).alias("features")).repartition(4)
    model = softmax.SoftmaxModel(np.zeros((2**17 + 1, 2)), 17)
    task = softmax._epoch_task(spark.sparkContext.broadcast(model.weights), 8, 1.0, None)
    sent = features.mapInArrow(task, "feature int, moved array<double>, n bigint, loss double, steps bigint")
    assert sent.count() == 4 * (9 + 1)
    weights, _, steps = softmax._run_epoch(features, model, 8, 1.0, 0.0, None)
    assert steps == sent.agg(F.sum("steps")).first()[0] and np.count_nonzero(weights.any(axis=1)) <= 10


def test_tasks_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from lexmill.operators import softmax

    monkeypatch.setattr(softmax, "PARTITION_ROWS", 100)
    rows = spark.range(0, 1_000, 1, 20).selectExpr("id as doc_id", "concat('w', id % 7) as text", "cast(id % 2 as int) as label")
    whole, sizes = softmax._run_epoch, []

    def seen(visited, *args):
        sizes.append(softmax.partition_rows(visited))
        return whole(visited, *args)

    monkeypatch.setattr(softmax, "_run_epoch", seen)
    options = {"batch_size": 10, "epochs": 2, "parallelism": 2}
    for lazy, most in ((False, None), (True, 80)):
        _, state = fit_softmax(rows, rows, str(tmp_path / str(lazy)), 2, "doc_id", lazy=lazy, max_steps=most, **options)
        assert state.global_step == 80 if lazy else state.global_step >= 100
        assert all(len(n) == 10 and max(n) < 200 and sum(n) == 1_000 for n in sizes)


def test_lots_do_not_grow_with_the_table(spark, monkeypatch, tmp_path):
    from lexmill.operators import softmax
    from lexmill.plans import queries

    monkeypatch.setattr(softmax, "PARTITION_ROWS", 10)
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.step_budget(spark, "/root/testdata/sf0.001").first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got["spent"]
    lots = [r["count"] for r in spark.read.parquet(str(tmp_path / "lots")).selectExpr("input_file_name() as f").groupBy("f").count().collect()]
    assert len(lots) == 4 and max(lots) < 0.45 * sum(lots)  # one lot alone had 4 of 7 rows

import pytest
from pyspark.sql import functions as F

from lexmill.config import ScoringJob, TrainingConfig
from lexmill.functions import first_tokens
from lexmill.operators.bayes import load_bayes, score_bayes
from lexmill.operators.metrics import evaluate
from lexmill.operators.prepare import LabelWatch
from lexmill.operators.runs import RunStore
from lexmill.operators.softmax import fit_softmax
from lexmill.plans import run_scoring, run_sweep, run_training
from lexmill.session import scratch_path, shared_dir


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return RunStore(spark, str(tmp_path_factory.mktemp("store")))


@pytest.mark.parametrize("model_type, mode", [("bayes", "True"), ("softmax", "False")])
def test_train_register_score(spark, split, store, tmp_path, model_type, mode):
    config = TrainingConfig(
        model_type=model_type, num_labels=4, num_train_epochs=2, batch_size=8, parallelism=2, experiment_location="e"
    )
    run_id = run_training(spark, config, store, *split)
    row = store.runs().where(f"run_id = '{run_id}'").first()
    assert row["metrics"]["eval_f1"] > 0.4 and row["metrics"]["train_runtime"] > 0
    assert row["params"]["model_type"] == model_type and row["params"]["train_batch_size"] == "8"

    store.move(model_type, store.register(model_type, run_id), "Production")
    split[1].write.parquet(str(tmp_path / "in"))
    params = {
        "model_name": model_type,
        "input_table": str(tmp_path / "in"),
        "output_table": str(tmp_path / "out"),
        "batch_inference": mode,
        "df_repartition_num": "3",
    }
    written = run_scoring(spark, ScoringJob.from_params(params), store)
    assert written.count() == split[1].count()
    kept = ["doc_id", "text", "label"] if mode == "True" else ["text"]
    assert written.columns == [*kept, "probabilities", "predicted_probability", "predicted_class"]
    assert spark.read.parquet(f"{store.model_path(run_id)}/input_example").count() == 5


@pytest.mark.parametrize("mode, length", [("True", -1), ("False", 12)])
def test_published_model_scores_as_the_join_does(spark, split, store, tmp_path, mode, length):
    name = f"published-{mode}"
    config = TrainingConfig(model_type="bayes", num_labels=4, max_token_length=length, experiment_location=name)
    run_id = run_training(spark, config, store, *split)
    store.move(name, store.register(name, run_id), "Production")
    nulls = split[1].limit(2).withColumn("text", F.lit(None).cast("string"))
    rows = split[1].unionByName(nulls).unionByName(split[1].limit(3))
    rows.write.parquet(str(tmp_path / "in"))
    scored = run_scoring(spark, ScoringJob(name, str(tmp_path / "in"), str(tmp_path / "out"), batch_inference=mode == "True"), store)
    body = F.col("text") if length == -1 else first_tokens("text", length - 2)
    model = load_bayes(spark, store.model_path(run_id))
    joined = score_bayes(rows.withColumn("_body", body), model, "doc_id", "_body", None if mode == "True" else 4)
    joined = joined.select(scored.columns)
    assert scored.count() == joined.count() == split[1].count() + 5
    both = [sorted(map(str, frame.collect())) for frame in (scored, joined)]
    assert both[0] == both[1]


def test_lazy_training_logs_its_best_epoch(spark, split, store):
    config = TrainingConfig(
        num_labels=4, num_train_epochs=2, batch_size=8, parallelism=1, streaming_read=True, experiment_location="lazy"
    )
    run_id = run_training(spark, config, store, *split)
    row = store.runs().where(f"run_id = '{run_id}'").first()
    assert row["params"]["best_checkpoint"].startswith("epoch=")
    assert row["params"]["streaming_read"] == "True"


def test_sweep_logs_one_run_per_config(spark, split, store):
    configs = [
        TrainingConfig(model_type="bayes", num_labels=4, max_vocab=n, experiment_location="sweep") for n in (10, 5000)
    ]
    ids = run_sweep(spark, configs, store, *split, side_by_side=2)
    board = store.leaderboard("eval_f1").where("experiment = 'sweep'").orderBy("place").collect()
    assert [r["run_id"] for r in board] == ids[::-1]


def test_labels_are_checked_before_training(spark, split, store):
    with pytest.raises(ValueError, match="outside"):
        run_training(spark, TrainingConfig(model_type="bayes", num_labels=2), store, *split)


def test_scratch_paths_are_fresh_and_below_the_shared_folder(spark):
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one != two and one.startswith(shared_dir(spark))


def test_count_based_model_honours_the_token_length(spark, store, tmp_path):
    rows = [(i, ("red " if i % 2 else "blue ") + "filler " * 5 + ("blue " if i % 2 else "red ") * 4, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    config = TrainingConfig(model_type="bayes", num_labels=2, max_token_length=3, experiment_location="short")
    run_id = run_training(spark, config, store, frame, frame)
    assert store.runs().where(f"run_id = '{run_id}'").first()["metrics"]["eval_f1"] == 1.0
    store.move("short", store.register("short", run_id), "Production")
    frame.write.parquet(str(tmp_path / "in"))
    job = ScoringJob("short", str(tmp_path / "in"), str(tmp_path / "out"))
    assert run_scoring(spark, job, store).where("label <> predicted_class").count() == 0


def input_records(spark, path, work):
    """Records that tasks read of the files below a path, from Spark's own accounting of a job group."""
    table = spark.read.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    work(table.mapInArrow(count, table.schema))
    return seen.value


@pytest.mark.parametrize("side", ["train", "test"])
def test_sweep_reads_texts_once_however_many_configs(spark, split, store, tmp_path, side):
    place = ["train", "test"].index(side)
    split[place].write.parquet(str(tmp_path / "side"))
    read = []
    for sizes in ((10, 5000), (10, 20, 50, 100, 200, 500, 1000, 2000, 5000, None)):
        configs = [TrainingConfig(model_type="bayes", num_labels=4, max_vocab=n, experiment_location=f"once-{side}") for n in sizes]

        def work(frame):
            sides = list(split)
            sides[place] = frame
            run_sweep(spark, configs, store, *sides)

        read.append(input_records(spark, str(tmp_path / "side"), work))
    # The example of a model's input looks at the first partition of the train side.
    n = split[place].count()
    assert read[0] == read[1] <= (2 * n if side == "train" else n)


def test_swept_models_equal_models_of_their_own(spark, split, store):
    sizes = (30, None, 700)
    configs = [TrainingConfig(model_type="bayes", num_labels=4, max_vocab=n, max_token_length=50, experiment_location="own") for n in sizes]
    swept = run_sweep(spark, configs, store, *split)
    for config, run_id in zip(configs, swept):
        alone = run_training(spark, config, store, *split)
        one, two = (store.runs().where(f"run_id = '{r}'").first()["metrics"] for r in (run_id, alone))
        assert {m: v for m, v in one.items() if m != "train_runtime"} == pytest.approx({m: v for m, v in two.items() if m != "train_runtime"})
        weights = [load_bayes(spark, store.model_path(r)).weights(spark) for r in (run_id, alone)]
        assert weights[0].exceptAll(weights[1]).isEmpty() and weights[1].exceptAll(weights[0]).isEmpty()
        model = load_bayes(spark, store.model_path(run_id))
        scored = score_bayes(split[1].withColumn("_body", first_tokens("text", 48)), model, "doc_id", "_body")
        assert evaluate(scored)["f1"] == pytest.approx(one["eval_f1"])


@pytest.mark.parametrize("model_type", ["bayes", "softmax"])
def test_labels_are_checked_while_they_are_read(spark, split, store, model_type):
    train, test = split
    config = TrainingConfig(model_type=model_type, num_labels=4, num_train_epochs=1, parallelism=2, experiment_location=f"audit-{model_type}")
    text = F.col("label").cast("string")
    bad = {
        "have no rows": (train.where("label <> 2"), test),
        "are not integers": (train.withColumn("label", F.when(F.col("label") == 1, "x").otherwise(text)), test),
        "null labels": (train, test.withColumn("label", F.when(F.col("label") != 3, F.col("label")))),
        "outside 0..3": (train, test.withColumn("label", F.col("label") + 1)),
    }
    for words, sides in bad.items():
        with pytest.raises(ValueError, match=words):
            run_training(spark, config, store, *sides)
    assert store.runs().where(f"experiment = 'audit-{model_type}'").count() == 0
    run_id = run_training(spark, config, store, train, test.where("label <> 3"))
    assert store.runs().where(f"run_id = '{run_id}'").first()["params"]["test_labels_missing"] == "[3]"


def test_labels_of_nothing(spark, split):
    watch = LabelWatch(4)
    assert watch.watch(split[0].limit(0)).count() == 0
    with pytest.raises(ValueError, match="have no rows"):
        watch.require()
    watch.require(dense=False)


def test_a_run_is_resumed_by_its_id(spark, split, store):
    config = TrainingConfig(num_labels=4, num_train_epochs=2, parallelism=2, batch_size=8, experiment_location="resume")
    run_id = store.new_run_id()
    fit_softmax(*split, store.model_path(run_id), 4, "doc_id", batch_size=8, epochs=1, parallelism=2)
    assert run_training(spark, config, store, *split, run_id=run_id) == run_id
    whole = run_training(spark, config, store, *split)
    one, two = (store.runs().where(f"run_id = '{r}'").first()["metrics"] for r in (run_id, whole))
    assert one["eval_f1"] == pytest.approx(two["eval_f1"])

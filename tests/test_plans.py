"""What the physical plans must and must not contain."""

import re

import pytest

from conftest import DATA
from lexmill.operators import bayes, encode, metrics, prepare, runs
from lexmill.operators.scoring import bayes_predictor, score
from lexmill.plans.inference import score_counted


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanged(frame):
    """Names of all columns that cross an exchange of the plan, payload included."""
    names = set()

    def visit(node):
        if "ShuffleExchange" in node.getClass().getSimpleName():
            names.update(node.output().apply(i).name() for i in range(node.output().size()))
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            visit(node.executedPlan())
        for i in range(node.children().size()):
            visit(node.children().apply(i))

    visit(frame._jdf.queryExecution().executedPlan())
    return names


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_python_model_is_evaluated_once(spark, table, model):
    text = plan(score(table, bayes_predictor(spark, model), mode="udf"))
    assert len(re.findall(r"ArrowEvalPython", text)) == 1
    assert "ReadSchema: struct<text:string>" in text


def test_batch_scoring_has_no_shuffle(spark, table, model):
    text = plan(score(table, bayes_predictor(spark, model), mode="batch"))
    assert "Exchange" not in text


def test_batched_encoding_has_no_shuffle(table):
    text = plan(encode.encode_batched(table, ["a", "b"]))
    assert "Exchange" not in text and len(re.findall("ArrowEvalPython", text)) == 1


def test_token_counts_combine_before_the_shuffle(table):
    text = plan(bayes.token_counts(table.withColumnRenamed("lang", "label").withColumn("label", prepare.F.lit(1))))
    assert len(re.findall(r"Exchange", text)) == 1 and "partial_count" in text
    assert "ReadSchema: struct<text:string>" in text


def test_scoring_by_join_shuffles_sums_not_texts(table, model):
    text = plan(bayes.bayes_logits(table, model, "doc_id"))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert exchanged(bayes.bayes_logits(table, model, "doc_id"))
    assert not any("text" in column for column in exchanged(bayes.bayes_logits(table, model, "doc_id")))


def test_predictions_by_a_model_that_workers_hold_move_no_row(table, model):
    assert exchanged(score_counted(table, model, "text", decimals=4)) == set()


def test_metrics_shuffle_cells(table):
    pairs = table.selectExpr("cast(doc_id % 2 as int) as label", "doc_id % 3 as predicted_class")
    text = plan(metrics.weighted_metrics(metrics.confusion_matrix(pairs)))
    assert "partial_count" in text and "text" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_leaderboard_limits_groups_before_the_shuffle(spark):
    frame = spark.range(10).selectExpr("cast(id % 2 as string) as experiment", "id as run_id", "cast(id as double) as f1")
    text = plan(runs.run_leaderboard(frame, "f1", top=3))
    assert text.count("WindowGroupLimit") == 2


def test_stages_are_hash_aggregated(spark):
    events = spark.range(10).selectExpr("'m' || id as name", "1 as version", "'None' as stage", "id as event_order")
    assert "SortAggregate" not in plan(runs.current_stages(events))


def test_shuffle_ranks_in_buckets(table):
    text = plan(prepare.shuffle_rows(table.select("doc_id", "lang"), "doc_id"))
    assert "hashpartitioning(_bucket" in text
    # The only one-task step is the running total over bucket sizes.
    single = [line for line in text.splitlines() if "SinglePartition" in line]
    assert len(single) == 1


def test_filters_reach_the_scan(table):
    text = plan(prepare.project_feature(table.where("doc_id < 10"), "text"))
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,10)]" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_token_that_is_rare_in_training_but_hot_in_scoring_is_split(spark, tmp_path, monkeypatch):
    """Adaptive execution splits the partition of a hot token in the join with the tail weights."""
    monkeypatch.setattr(bayes, "HOT_TOKENS", 2)
    train = spark.range(400).selectExpr("concat('a b t', id % 200) as text", "cast(id % 2 as int) as label")
    fitted = bayes.fit_bayes(train, str(tmp_path), 2)
    assert fitted.has_tail
    # Every text has the token t7, which training saw twice.
    queries = spark.range(0, 20000, 1, 8).selectExpr("id", "concat('t7 t', id % 200, ' t', id % 190) as text")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        scored = bayes.bayes_logits(queries, fitted, "id")
        split = {r["id"]: r["logits"] for r in scored.collect()}
        assert "skew=true" in plan(scored)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    whole = {r["id"]: r["logits"] for r in bayes.bayes_logits(queries, fitted, "id").collect()}
    assert split == whole and len(whole) == 20000

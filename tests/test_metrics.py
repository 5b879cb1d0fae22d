import pytest
from hypothesis import given, settings, strategies as st
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from lexmill.operators import metrics


def plain(pairs):
    """Weighted precision, recall, f1 by hand."""
    out = {"precision": 0.0, "recall": 0.0, "f1": 0.0}
    for c in {a for a, _ in pairs} | {b for _, b in pairs}:
        support = sum(a == c for a, _ in pairs)
        predicted = sum(b == c for _, b in pairs)
        tp = sum(a == b == c for a, b in pairs)
        p = tp / predicted if predicted else 0.0
        r = tp / support if support else 0.0
        f = 2 * p * r / (p + r) if p + r else 0.0
        for name, value in (("precision", p), ("recall", r), ("f1", f)):
            out[name] += value * support / len(pairs)
    return out


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, predicted_class bigint")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=30))
def test_weighted_metrics_equal_plain_formula(spark, pairs):
    got = metrics.evaluate(scored(spark, pairs))
    for name, value in plain(pairs).items():
        assert got[name] == pytest.approx(value, abs=1e-12)


def test_equal_to_mllib_evaluator(spark):
    frame = spark.range(1000).select(
        (F.col("id") % 5).cast("int").alias("label"), F.floor(F.col("id") * 7 % 11 / 2).cast("bigint").alias("predicted_class")
    )
    doubles = frame.select(F.col("label").cast("double"), F.col("predicted_class").cast("double").alias("prediction"))
    got = metrics.evaluate(frame)
    for ours, theirs in (("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName=theirs)
        assert got[ours] == pytest.approx(evaluator.evaluate(doubles), abs=1e-12)


def test_weighted_recall_is_accuracy(spark):
    pairs = [(0, 0), (0, 1), (1, 1), (2, 0), (2, 2)]
    assert metrics.evaluate(scored(spark, pairs))["recall"] == pytest.approx(3 / 5)


def test_class_never_predicted_and_prediction_never_labelled(spark):
    cells = metrics.confusion_matrix(scored(spark, [(0, 0), (1, 0), (0, 2)]))
    rows = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in metrics.per_class_metrics(cells).collect()}
    assert rows[1] == (0.0, 0.0, 0.0, 1) and rows[2] == (0.0, 0.0, 0.0, 0)
    assert rows[0][0] == pytest.approx(0.5) and rows[0][1] == pytest.approx(0.5)


def test_single_class(spark):
    got = metrics.evaluate(scored(spark, [(0, 0)] * 3))
    assert (got["f1"], got["majority_f1"], got["n_rows"]) == (1.0, 1.0, 3)


def test_majority_baseline(spark):
    got = metrics.evaluate(scored(spark, [(0, 0)] * 9 + [(1, 0)]))
    assert got["f1"] == pytest.approx(got["majority_f1"])


def test_log_loss(spark):
    frame = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 0.0], 1), (None, 1)], "logits array<double>, label int")
    row = metrics.log_loss(frame).first()
    assert row["n_rows"] == 2 and row["log_loss"] == pytest.approx(0.6931471805599453)


def test_mean_loss_comes_with_the_metrics(spark):
    frame = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 1, 2.0)], "label int, predicted_class bigint, x double")
    got = metrics.evaluate(frame, loss=F.col("x"))
    assert got["loss"] == pytest.approx(2.0) and got["recall"] == pytest.approx(2 / 3)

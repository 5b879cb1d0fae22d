import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.config import ScoringJob
from lexmill.operators import encode
from lexmill.operators.scoring import batch_model, bayes_predictor, empty_encoding, encoded_model, encoding_predictor, score

TEXTS = [(1, "aa"), (2, None), (3, "bbbb"), (4, "")]


def by_length():
    """A user model: two classes, by text length. Near tie for 'aa'."""

    def make_predict_fn():
        def predict(texts):
            n = np.array([len(t) for t in texts], dtype=np.float64)
            low = np.where(n == 2, 0.49999, 1.0 / (1.0 + n))
            return np.column_stack([low, 1.0 - low]).astype(np.float32)

        return predict

    return batch_model(make_predict_fn)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, text string")


def test_batch_mode_keeps_all_columns(texts):
    got = score(texts, by_length(), mode="batch")
    assert got.columns == ["id", "text", "probabilities", "predicted_probability", "predicted_class"]
    assert dict(got.dtypes)["probabilities"] == "array<float>"


def test_udf_mode_keeps_the_feature_and_rounds(texts):
    got = score(texts, by_length(), mode="udf")
    assert got.columns == ["text", "probabilities", "predicted_probability", "predicted_class"]
    row = got.where("text = 'aa'").first()
    assert row["probabilities"] == [0.5, 0.5] and row["predicted_class"] == 0


def test_rounding_decides_near_ties(texts):
    unrounded = score(texts, by_length(), mode="batch").where("text = 'aa'").first()
    assert unrounded["predicted_class"] == 1


def test_null_text_gives_null(texts):
    row = score(texts, by_length()).where("id = 2").first()
    assert (row["probabilities"], row["predicted_probability"], row["predicted_class"]) == (None, None, None)


def test_null_text_as_literal(texts):
    row = score(texts, by_length(), null_policy="literal").where("id = 2").first()
    assert row["probabilities"][0] == pytest.approx(1 / (1 + len("None")))


@pytest.mark.parametrize("option", [{"mode": "x"}, {"keep": "x"}, {"null_policy": "x"}])
def test_unknown_options_are_refused(texts, option):
    with pytest.raises(ValueError):
        score(texts, by_length(), **option)


def test_flag_values():
    base = {"model_name": "m", "input_table": "i", "output_table": "o"}
    assert ScoringJob.from_params({**base, "batch_inference": "False", "df_repartition_num": "8"}).df_repartition_num == 8
    assert ScoringJob.from_params({**base, "df_repartition_num": "None"}).df_repartition_num is None
    with pytest.raises(ValueError):
        ScoringJob.from_params({**base, "batch_inference": "yes"})


def test_batch_size_reaches_the_model(spark):
    def make_predict_fn():
        return lambda texts: np.full((len(texts), 1), len(texts), dtype=np.float32)

    rows = spark.range(0, 250, 1, 1).select(F.col("id").cast("string").alias("text"))
    got = score(rows, batch_model(make_predict_fn), batch_size=100, partitions=1)
    sizes = got.groupBy(F.col("probabilities")[0].alias("n")).count().collect()
    assert {r["n"]: r["count"] for r in sizes} == {100.0: 200, 50.0: 50}


def test_vector_feature(spark):
    def make_predict_fn():
        return lambda vectors: vectors / vectors.sum(axis=1, keepdims=True)

    frame = spark.createDataFrame([([1.0, 3.0],), (None,)], "v array<float>")
    got = score(frame, batch_model(make_predict_fn, tensor_shape=[2]), "v", empty=F.array(F.lit(1.0), F.lit(1.0)).cast("array<float>"))
    assert [r["predicted_class"] for r in got.orderBy(F.col("v").isNull()).collect()] == [1, None]


def test_probabilities_sum_to_one(spark, split, model):
    predictor = bayes_predictor(spark, model)
    for mode, slack in (("batch", 1e-5), ("udf", 4 * 5e-5)):
        sums = [sum(r["probabilities"]) for r in score(split[1], predictor, mode=mode).collect()]
        assert max(abs(s - 1) for s in sums) <= slack


def by_mask():
    """A user model over encoded texts: two classes, by the number of used places and the sum of the ids."""

    def make_predict_fn():
        def predict(input_ids, attention_mask):
            used = attention_mask.sum(axis=1)
            return np.column_stack([used, (input_ids * attention_mask).sum(axis=1)]).astype(np.float32)

        return predict

    return encoded_model(make_predict_fn, 6)


@pytest.mark.parametrize("mode", ["batch", "udf"])
def test_encoding_inside_scoring_equals_encoding_before(spark, mode):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (4, "zzz a a a a a a")], "id int, text string")
    vocab = ["a", "b"]
    inside = score(rows, encoding_predictor(spark, vocab, by_mask(), 6), mode=mode, keep="all")
    encoded = encode.encode_batched(rows, vocab, max_length=6)
    pair = F.when(F.col("input_ids").isNotNull(), F.struct("input_ids", "attention_mask"))
    before = score(encoded.withColumn("pair", pair), by_mask(), "pair", mode=mode, keep="all", empty=empty_encoding(6))
    want = {1: [4.0, 2 + 4 + 5 + 3], 2: None, 3: [2.0, 5.0], 4: [6.0, 2 + 1 + 4 + 4 + 4 + 3]}
    for scored in (inside, before):
        assert {r["id"]: r["probabilities"] for r in scored.collect()} == want

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import bayes
from lexmill.operators.scoring import bayes_predictor, score


def plain_weights(rows, k):
    """Weights by hand from (text, label) pairs."""
    counts, docs = {}, [0] * k
    for text, label in rows:
        docs[label] += 1
        for token in text.lower().split():
            counts.setdefault(token, [0] * k)[label] += 1
    total = [sum(c[i] for c in counts.values()) for i in range(k)]
    weights = {
        t: [round(1e6 * (math.log(c[i] + 1) - math.log(total[i] + len(counts)))) for i in range(k)]
        for t, c in counts.items()
    }
    prior = [round(1e6 * math.log(d / sum(docs))) if d else bayes.ABSENT_CLASS for d in docs]
    return weights, prior


TRAIN = [("a b a", 0), ("b c", 1), ("a", 0), ("c c d", 1)]


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    frame = spark.createDataFrame(TRAIN, "text string, label int")
    return bayes.fit_bayes(frame, str(tmp_path_factory.mktemp("toy")), 3)


def test_weights_equal_plain_formula(spark, toy):
    weights, prior = plain_weights(TRAIN, 3)
    got = {r["token"]: r["w"] for r in toy.weights(spark).collect()}
    assert got.pop(bayes.TEXT_MARK) == prior
    assert got == weights


def test_logits_edge_cases(spark, toy):
    weights, prior = plain_weights(TRAIN, 3)
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "unknown words"), (4, "A zzz d")], "id int, text string")
    got = {r["id"]: r["logits"] for r in bayes.bayes_logits(frame, toy, "id").collect()}
    assert got[1] is None
    assert got[2] == got[3] == prior
    assert got[4] == [prior[i] + weights["a"][i] + weights["d"][i] for i in range(3)]


def test_absent_class_gets_no_probability(spark, toy):
    frame = spark.createDataFrame([(1, "a")], "id int, text string")
    row = bayes.score_bayes(frame, toy, "id").first()
    assert row["probabilities"][2] == 0.0 and row["predicted_class"] == 0


def test_rows_without_text_or_label_do_not_count(spark, toy, tmp_path):
    frame = spark.createDataFrame([*TRAIN, (None, 0)], "text string, label int")
    again = bayes.fit_bayes(frame, str(tmp_path), 3)
    assert again.weights(spark).exceptAll(toy.weights(spark)).isEmpty()


def test_row_key_may_have_any_name(spark, toy):
    for name in ("token", "w", "n", "id", "label"):
        frame = spark.createDataFrame([(7, "a b")], f"{name} int, text string")
        assert bayes.score_bayes(frame, toy, name).first()["predicted_class"] == 0


def test_load_equals_fit(spark, toy, model):
    assert bayes.load_bayes(spark, toy.path) == toy
    assert bayes.load_bayes(spark, model.path) == model


def test_tiers_do_not_change_scores(spark, split, model, tmp_path, monkeypatch):
    """With a tiny hot tier most tokens take the shuffled way; the scores stay."""
    monkeypatch.setattr(bayes, "HOT_TOKENS", 50)
    small = bayes.fit_bayes(split[0], str(tmp_path), 4)
    assert small.has_tail and small.weights(spark, "hot").count() <= 51
    one = {r["doc_id"]: r["logits"] for r in bayes.bayes_logits(split[1], small, "doc_id").collect()}
    other = {r["doc_id"]: r["logits"] for r in bayes.bayes_logits(split[1], model, "doc_id").collect()}
    assert one == other and len(one) == split[1].count()


def test_long_tokens_stay_out_of_the_broadcast_tier(spark, tmp_path):
    long = "x" * (bayes.HOT_TOKEN_CHARS + 1)
    frame = spark.createDataFrame([(f"{long} a", 0), ("b", 1)], "text string, label int")
    fitted = bayes.fit_bayes(frame, str(tmp_path), 2)
    assert fitted.has_tail
    assert [r["token"] for r in fitted.weights(spark, "tail").collect()] == [long]
    query = spark.createDataFrame([(1, long)], "id int, text string")
    assert bayes.score_bayes(query, fitted, "id").first()["predicted_class"] == 0


def test_partitioning_does_not_change_anything(spark, split, model, tmp_path):
    again = bayes.fit_bayes(split[0].repartition(9), str(tmp_path), 4)
    assert again.weights(spark).exceptAll(model.weights(spark)).isEmpty()


def test_wide_and_long_counting_agree(spark, split, model, tmp_path, monkeypatch):
    monkeypatch.setattr(bayes, "WIDE_SUM_CLASSES", 0)
    again = bayes.fit_bayes(split[0], str(tmp_path), 4)
    assert again.weights(spark).exceptAll(model.weights(spark)).isEmpty()


def test_join_and_batched_scores_agree(spark, split, model):
    joined = {r["doc_id"]: (r["probabilities"], r["predicted_class"]) for r in bayes.score_bayes(split[1], model, "doc_id", decimals=4).collect()}
    shipped = score(split[1], bayes_predictor(spark, model), mode="udf", keep="all")
    assert joined == {r["doc_id"]: (r["probabilities"], r["predicted_class"]) for r in shipped.collect()}


def test_beats_the_majority_class(spark, split, model):
    from lexmill.operators.metrics import evaluate

    got = evaluate(bayes.score_bayes(split[1], model, "doc_id"))
    assert got["f1"] > 0.9 > got["majority_f1"]


def test_hot_label_and_hot_token(spark, tmp_path):
    """A third of all rows with one label and one token: counts are exact."""
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 97).cast("string"))).alias("text"),
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 5 + 1).cast("int")).alias("label"),
    )
    counts = {(r["token"], r["label"]): r["n"] for r in bayes.token_counts(frame).collect()}
    assert counts[("hot", 0)] == 2000 and counts[(bayes.TEXT_MARK, 0)] == 1000


def test_long_batches_are_cut_into_chunks(spark, split, model, monkeypatch):
    from lexmill.operators import scoring

    whole = score(split[1], bayes_predictor(spark, model)).select("doc_id", "probabilities").collect()
    monkeypatch.setattr(scoring, "CHARS_PER_CHUNK", 1000)
    cut = score(split[1], bayes_predictor(spark, model)).select("doc_id", "probabilities").collect()
    as_dict = lambda rows: {r["doc_id"]: r["probabilities"] for r in rows}
    one, two = as_dict(whole), as_dict(cut)
    assert one.keys() == two.keys() and all(np.array_equal(one[k], two[k]) for k in one)


def test_scoring_keeps_rows_with_null_and_repeated_keys(spark, split, model):
    texts = [r["text"] for r in split[1].limit(3).collect()]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[0]), (2, texts[1]), (2, texts[1]), (None, None)]
    got = bayes.score_bayes(spark.createDataFrame(rows, "doc_id long, text string"), model, "doc_id").collect()
    assert len(got) == len(rows)
    single = [(n, t) for n, t in enumerate(texts)] + [(9, None)]
    alone = bayes.score_bayes(spark.createDataFrame(single, "doc_id long, text string"), model, "doc_id")
    expected = {r["text"]: r["probabilities"] for r in alone.collect()}
    assert all(r["probabilities"] == expected[r["text"]] for r in got)


def test_chunked_counts_are_those_of_single_tokens(spark, monkeypatch):
    texts = [None, "", " ", "\t\n", "Der\tHund\r\nund  die KATZE ", "the cat\x0bthe cat", "İstanbul ÉTÉ été", " the  the", "x y " * 50]
    rows = [(t, label) for t in texts for label in (0, 1, 1, None, 7, -1)]
    frame = spark.createDataFrame(rows, "text string, label int").coalesce(2)
    single = bayes.token_rows(frame).withColumn("n", F.lit(1).cast("bigint"))
    want = sorted(map(str, bayes.vocabulary(single, 3).collect()))
    # One chunk a batch, one text a chunk, and chunks that end between batches.
    for size in (bayes.COUNTED_BYTES, 1, 40):
        monkeypatch.setattr(bayes, "COUNTED_BYTES", size)
        counts = bayes.fit_counts(frame, 3)
        assert sorted(map(str, bayes.vocabulary(counts, 3).collect())) == want
    assert bayes.fit_counts(frame.limit(0), 3).isEmpty()


def test_a_token_is_one_row_per_class_and_chunk(spark):
    frame = spark.range(900).selectExpr("'to be or not to be' text", "cast(id % 3 as int) label").coalesce(1)
    assert bayes.fit_counts(frame, 3).count() == 3 * 5


def test_one_whole_vocabulary_is_written_once(spark, docs, tmp_path, monkeypatch):
    extra = []
    keep = bayes.written
    monkeypatch.setattr(bayes, "written", lambda df, label: extra.append(label) or keep(df, label))
    (alone,) = bayes.fit_bayes_family(docs, [str(tmp_path / "a")], 4, [None])
    assert not extra
    whole, _ = bayes.fit_bayes_family(docs, [str(tmp_path / "b"), str(tmp_path / "c")], 4, [None, 50])
    assert extra == ["counts"]
    assert alone.weights(spark).exceptAll(whole.weights(spark)).isEmpty()

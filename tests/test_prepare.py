import pytest
from pyspark.errors import NumberFormatException
from pyspark.sql import functions as F

from lexmill.operators import prepare


def test_strict_cast_raises_and_lenient_gives_null(spark):
    frame = spark.createDataFrame([("a", "1"), ("b", "x")], "text string, label string")
    with pytest.raises(NumberFormatException):
        prepare.cast_label(frame).collect()
    assert [r["label"] for r in prepare.cast_label(frame, strict=False).collect()] == [1, None]


def test_hash_split_keeps_copies_together_and_ignores_partitioning(docs):
    one = prepare.hash_split(docs, "text")
    sides = one.groupBy("text").agg(F.count_distinct("split").alias("n"))
    assert sides.where("n > 1").count() == 0
    other = prepare.hash_split(docs.repartition(7), "text")
    assert one.select("doc_id", "split").exceptAll(other.select("doc_id", "split")).isEmpty()


def test_split_pair_is_disjoint_and_complete(docs):
    train, test = prepare.split_pair(docs, "doc_id")
    assert train.join(test, "doc_id").isEmpty()
    assert train.count() + test.count() == docs.count()
    paired = prepare.pair_splits(train, test)
    assert paired.count() == docs.count()


def test_null_split_key_lands_on_one_side(spark):
    frame = spark.createDataFrame([(None,)] * 5, "k string")
    assert prepare.hash_split(frame, "k").select("split").distinct().count() == 1


@pytest.mark.parametrize(
    "labels, valid",
    [
        (["0", "1", "2"], True),
        (["0", "2"], False),
        (["-1", "0"], False),
        (["0", "x"], False),
        (["0", None], False),
        (["0"], True),
        ([None], False),
    ],
)
def test_label_audit(spark, labels, valid):
    frame = spark.createDataFrame([(v,) for v in labels], "label string")
    assert prepare.label_audit(frame).first()["is_valid"] is valid


def test_require_valid_labels_names_the_problem(spark):
    frame = spark.createDataFrame([("0",), ("5",)], "label string")
    with pytest.raises(ValueError, match="outside 0..1"):
        prepare.require_valid_labels(frame, "label", 2)


def test_shuffle_is_a_seeded_permutation(docs):
    ranked = prepare.shuffle_rows(docs.select("doc_id"), "doc_id", seed=1)
    rows = {r["doc_id"]: r["shuffle_rank"] for r in ranked.collect()}
    assert sorted(rows.values()) == list(range(1, docs.count() + 1))
    again = prepare.shuffle_rows(docs.select("doc_id").repartition(5), "doc_id", seed=1)
    assert rows == {r["doc_id"]: r["shuffle_rank"] for r in again.collect()}
    other = prepare.shuffle_rows(docs.select("doc_id"), "doc_id", seed=2)
    assert rows != {r["doc_id"]: r["shuffle_rank"] for r in other.collect()}


def test_shuffle_without_key_handles_exact_copies(spark, tmp_path):
    spark.range(300).select(F.lit("same").alias("text")).write.parquet(str(tmp_path / "t"))
    ranked = prepare.shuffle_rows(spark.read.parquet(str(tmp_path / "t")))
    assert ranked.columns == ["text", "shuffle_rank"]
    assert sorted(r["shuffle_rank"] for r in ranked.collect()) == list(range(1, 301))


@pytest.mark.parametrize("n", [None, 0])
def test_repartition_unset_leaves_the_frame(docs, n):
    assert prepare.repartition_for_scoring(docs, n) is docs


def test_repartition_count_holds_under_adaptive_execution(spark, docs):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    spread = prepare.repartition_for_scoring(docs.select("doc_id"), 7)
    assert spread.select(F.spark_partition_id()).distinct().count() == 7


@pytest.mark.parametrize("n, epochs, workers", [(100, 1, 1), (640, 10, 4), (0, 10, 1), (100, 10, 1), (64, 10, 4)])
def test_step_plan(spark, n, epochs, workers):
    row = prepare.step_plan(spark.range(n), 64, epochs, workers).first()
    max_steps = epochs * n // (64 * workers)
    assert (row["max_steps"], row["eval_steps"]) == (max_steps, max_steps // epochs)
    assert row["eval_every"] == max(1, max_steps // epochs)


def test_random_split_is_disjoint_and_repeatable(docs):
    train, test = prepare.random_split(docs.select("doc_id"))
    assert train.intersect(test).isEmpty()
    assert train.count() + test.count() == docs.count()
    again, _ = prepare.random_split(docs.select("doc_id"))
    assert train.exceptAll(again).isEmpty()


def test_shuffle_keeps_rows_with_null_keys(spark):
    frame = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c"), (2, "d"), (None, "c")], "k long, v string")
    got = prepare.shuffle_rows(frame, "k").collect()
    assert sorted(r["shuffle_rank"] for r in got) == [1, 2, 3, 4, 5]
    assert sorted(r["v"] for r in got) == ["a", "b", "c", "c", "d"]


def test_labels_must_start_at_zero(spark):
    with pytest.raises(ValueError, match="start at 0"):
        prepare.require_valid_labels(spark.createDataFrame([(1,), (2,)], "label int"), "label", 3)

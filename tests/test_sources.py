import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lexmill import sources


@pytest.fixture
def saved(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).withColumn("k", F.col("id") % 3).write.partitionBy("k").parquet(path)
    return path


def test_manifest_counts_every_row(spark, saved):
    rows = sources.file_manifest(spark.read.parquet(saved)).collect()
    assert sum(r["n_rows"] for r in rows) == 100
    assert all(r["file_bytes"] > 0 and r["file_path"].endswith(r["file_name"]) for r in rows)


def test_file_list_with_base_path_keeps_partition_columns(spark, saved):
    assert [r.split(":", 1)[-1] for r in sources.input_roots(spark.read.parquet(saved).groupBy().count())] == [saved]
    files = sources.input_files(spark.read.parquet(saved))
    assert "k" not in sources.read_files(spark, files).columns
    whole = sources.read_files(spark, files, base_path=saved)
    assert whole.exceptAll(spark.read.parquet(saved)).isEmpty() and whole.count() == 100


def test_own_input_is_not_overwritten_whatever_reads_it(spark, saved):
    for sources_v1 in ("parquet", ""):
        spark.conf.set("spark.sql.sources.useV1SourceList", sources_v1)
        try:
            frame = spark.read.parquet(saved).groupBy("k").count()
            for target in (saved, saved.rsplit("/", 1)[0]):
                with pytest.raises(ValueError, match="read by the frame"):
                    sources.write_table(frame, target)
        finally:
            spark.conf.unset("spark.sql.sources.useV1SourceList")


def test_empty_file_list(spark):
    assert sources.input_files(spark.createDataFrame([], "a int")) == []
    assert sources.input_roots(spark.createDataFrame([], "a int")) == []
    assert sources.read_files(spark, [], schema="a int").count() == 0
    with pytest.raises(ValueError):
        sources.read_files(spark, [])


def test_overwrite_and_append_managed_table(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS lexmill_test LOCATION '{tmp_path}/db'")
    frame = spark.range(5)
    sources.write_table(frame, "lexmill_test.t")
    sources.write_table(frame, "lexmill_test.t")
    sources.write_table(frame, "lexmill_test.t", mode="append")
    assert sources.read_table(spark, "t", "lexmill_test").count() == 10
    with pytest.raises(AnalysisException, match="UNSUPPORTED_OVERWRITE"):
        sources.write_table(spark.table("lexmill_test.t"), "lexmill_test.t")
    spark.sql("DROP DATABASE lexmill_test CASCADE")


def test_overwriting_the_path_being_read_is_refused(spark, saved):
    with pytest.raises(ValueError, match="read by the frame"):
        sources.write_table(spark.read.parquet(saved), saved)
    assert spark.read.parquet(saved).count() == 100


def test_unknown_mode_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sources.write_table(spark.range(1), str(tmp_path / "x"), mode="ignore")


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_ingest_formats(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    frame = spark.createDataFrame([("a b", 1), ("c", 0)], "text string, label int")
    frame.write.format(fmt).save(path)
    assert sources.ingest(spark, path, fmt, schema="text string, label int").exceptAll(frame).isEmpty()


def test_text_formats_need_a_schema(spark):
    with pytest.raises(ValueError):
        sources.ingest(spark, "/nowhere", "csv")


def test_ragged_log_history(spark, tmp_path):
    state = {
        "global_step": 20,
        "log_history": [
            {"step": 20, "epoch": 1.0, "loss": 0.5},
            {"step": 20, "epoch": 1.0, "eval_f1": 0.7},
            {"step": 20, "epoch": 1.0, "train_runtime": 3.5, "train_loss": 0.4},
        ],
    }
    path = tmp_path / "trainer_state.json"
    path.write_text(json.dumps(state, indent=2))
    rows = sources.log_history(sources.read_log_history(spark, str(path))).orderBy("pos").collect()
    assert [r["eval_f1"] for r in rows] == [None, 0.7, None]
    assert rows[2]["train_runtime"] == 3.5 and rows[0]["global_step"] == 20


def test_input_example(spark):
    frame = spark.range(50).select(F.col("id"), F.col("id").cast("string").alias("text"))
    assert [r["text"] for r in sources.input_example(frame, "text", order_by="id").collect()] == list("01234")
    assert sources.input_example(frame, "text").count() == 5


def test_ordered_input_example_reads_features_behind_the_key_filter(spark, saved):
    frame = spark.read.parquet(saved).withColumn("text", F.col("id").cast("string"))
    assert [r["text"] for r in sources.input_example(frame, "text", 3, order_by="id").collect()] == ["0", "1", "2"]
    assert sources.input_example(frame.where("id < 2"), "text", 3, order_by="id").count() == 2

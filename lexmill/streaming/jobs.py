"""Arriving files as streams: read, score, append, count.

Queries run with ``availableNow``: they take what has arrived, in bounded
micro-batches, and stop; starting them again continues at their checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexmill.operators.bayes import BayesModel, score_bayes, token_counts
from lexmill.operators.levels import FAN, LevelledTable
from lexmill.operators.runs import RunStore
from lexmill.operators.scoring import UDF_DECIMALS, Predictor, score
from lexmill.session import put_if_absent, read_text


def read_arriving(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """A stream over the parquet files of a folder or path pattern, ``files_per_batch`` at a time.

    Without a schema the one of the files already there is used.
    """
    known = schema if schema is not None else spark.read.parquet(path).schema
    return spark.readStream.schema(known).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_stream(stream: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Append all that has arrived to a folder, exactly once, and return when done."""
    query = (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()


def score_stream(stream: DataFrame, predictor: Predictor, feature_col: str = "text", **options) -> DataFrame:
    """Score a stream as ``score`` does a table. Row-local, so it keeps no state."""
    return score(stream, predictor, feature_col, **{"mode": "udf", "keep": "all", **options})


def each_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand all that has arrived to ``handle(rows, batch id)``, batch by batch, and return when done.

    A batch that was cut short comes again under its id.
    """
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_stream_by_join(
    stream: DataFrame,
    model: BayesModel,
    target: str,
    checkpoint: str,
    row_key: str,
    feature_col: str = "text",
    decimals: int | None = UDF_DECIMALS,
) -> None:
    """Score what has arrived with weights that are joined to each batch, as ``score_bayes`` does a table.

    Needs no file that workers can open. Every batch has its folder, which a
    replay overwrites, so each row is in the result once.
    """

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_bayes(batch, model, row_key, feature_col, decimals)
        scored.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    each_batch(stream, checkpoint, score_batch)


def score_stream_by_stage(
    stream: DataFrame,
    store: RunStore,
    name: str,
    predictor_of: Callable[[str], Predictor],
    target: str,
    checkpoint: str,
    stage: str = "Production",
    feature_col: str = "text",
    batch_size: int = 1000,
    decimals: int | None = UDF_DECIMALS,
) -> None:
    """Score every batch with the version that is in the stage when it comes; ``model_version`` says which.

    ``predictor_of`` gives the predictor of a run id. What a batch was scored with is noted before it is scored, and a replay goes
    by the note: moving the stage meanwhile does not change it.
    """
    opened: dict[str, Predictor] = {}

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        note = f"{target}/_versions/{batch_id:012d}"
        version = store.resolve(name, stage)
        if not put_if_absent(spark, note, json.dumps({"version": version["version"], "run_id": version["run_id"]})):
            version = json.loads(read_text(spark, note))
        run_id = version["run_id"]
        if run_id not in opened:
            opened[run_id] = predictor_of(run_id)
        scored = score(batch, opened[run_id], feature_col, "udf", batch_size, keep="all", decimals=decimals)
        scored = scored.withColumn("model_version", F.lit(version["version"]))
        scored.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    each_batch(stream, checkpoint, score_batch)


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all batches, each with its ``batch_id``."""
    return spark.read.parquet(target)


COUNT_SCHEMA = "token string, label int, n bigint"


def count_table(spark: SparkSession, path: str, fan: int = FAN) -> LevelledTable:
    """Counts of batches, added up as their folders are merged."""

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("token", "label").agg(F.sum("n").alias("n"))

    return LevelledTable(spark, path, COUNT_SCHEMA, added, "batch_id", fan)


def stream_token_counts(
    stream: DataFrame, path: str, checkpoint: str, text: str = "text", label: str = "label", fan: int = FAN
) -> None:
    """Count the tokens of every micro-batch into its own folder, and merge folders by levels.

    A replayed batch overwrites its folder with the same counts, or is left out
    where a merge holds it already, so the sum over batches equals the counts of
    one pass over all rows. After n batches some multiple of log n folders are read.
    """

    def count_batch(batch: DataFrame, batch_id: int) -> None:
        table = count_table(batch.sparkSession, path, fan)
        table.append(token_counts(batch, text, label), str(batch_id))
        table.compact()

    each_batch(stream, checkpoint, count_batch)


def summed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(token, label, n) over all batches, ready for ``finish_bayes``."""
    return count_table(spark, path).read().groupBy("token", "label").agg(F.sum("n").alias("n"))

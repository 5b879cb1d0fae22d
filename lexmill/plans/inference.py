"""The scoring job: a registered model, an input table, a predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.config import ScoringJob
from lexmill.functions import first_tokens
from lexmill.operators.bayes import BayesModel, load_bayes
from lexmill.operators.encode import SPECIAL_TOKENS_PER_TEXT
from lexmill.operators.runs import RunStore
from lexmill.operators.scoring import UDF_DECIMALS, Predictor, bayes_predictor, score
from lexmill.operators.softmax import load_softmax, softmax_predictor
from lexmill.sources import read_back, read_table, write_table


def counted_predictor(spark: SparkSession, model: BayesModel, max_token_length: int = -1) -> Predictor:
    """A predictor of a count-based model that sees the tokens that fit."""
    published = bayes_predictor(spark, model)
    return lambda column, size: published(_cut(column, max_token_length), size)


def score_counted(
    df: DataFrame,
    model: BayesModel,
    feature_col: str,
    decimals: int | None = None,
    max_token_length: int = -1,
    batch_size: int = 1000,
    partitions: int | None = None,
) -> DataFrame:
    """All columns plus the three of a prediction, by a count-based model of any size; nothing is shuffled."""
    predictor = counted_predictor(df.sparkSession, model, max_token_length)
    return score(df, predictor, feature_col, decimals=decimals, batch_size=batch_size, partitions=partitions)


def _cut(text: Column, max_token_length: int) -> Column:
    return text if max_token_length == -1 else first_tokens(text, max_token_length - SPECIAL_TOKENS_PER_TEXT)


def run_scoring(spark: SparkSession, job: ScoringJob, store: RunStore) -> DataFrame:
    """Score the job's input table with the model in its stage; returns the written table."""
    version = store.resolve(job.model_name, job.stage)
    source = read_table(spark, job.input_table, job.input_database)
    if not job.batch_inference:
        source = source.select(job.feature_col)
    decimals = None if job.batch_inference else UDF_DECIMALS
    partitions = None if job.batch_inference else job.df_repartition_num
    predictor = run_predictor(store, version["run_id"])
    scored = score(
        source, predictor, job.feature_col, decimals=decimals, batch_size=job.batch_size, partitions=partitions
    )
    target = f"{job.output_database}.{job.output_table}" if job.output_database else job.output_table
    write_table(scored, target, job.write_mode)
    return read_back(spark, target)


def run_predictor(store: RunStore, run_id: str) -> Predictor:
    """A predictor from the model of a logged run."""
    spark = store.spark
    row = store.runs().where(F.col("run_id") == run_id).first()
    if row is None:
        raise LookupError(f"no run {run_id!r}")
    path = store.model_path(run_id)
    if row["params"]["model_type"] == "bayes":
        return counted_predictor(spark, load_bayes(spark, path), int(row["params"]["max_token_length"]))
    return softmax_predictor(spark, load_softmax(spark, f"{path}/best", 0))

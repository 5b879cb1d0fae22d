"""The training job: tables in, a logged run with a saved model out."""

from __future__ import annotations

import platform
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pyspark
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.config import TrainingConfig
from lexmill.functions import argmax, first_tokens, negative_log_likelihood
from lexmill.operators.bayes import MICRO, fit_bayes_family
from lexmill.operators.encode import SPECIAL_TOKENS_PER_TEXT
from lexmill.operators.metrics import weighted_metrics
from lexmill.operators.prepare import LabelWatch, select_configured, step_plan
from lexmill.operators.runs import RunStore, best_metrics
from lexmill.operators.scoring import bayes_family_logits
from lexmill.operators.softmax import fit_softmax, save_checkpoint, TrainingState
from lexmill.session import written
from lexmill.sources import input_example, log_history, read_log_history, read_table, write_table

EVAL_METRICS = ("eval_f1", "eval_precision", "eval_recall", "eval_loss")


def run_training(
    spark: SparkSession,
    config: TrainingConfig,
    store: RunStore,
    train: DataFrame | None = None,
    test: DataFrame | None = None,
    run_id: str | None = None,
) -> str:
    """Fit, evaluate, save and log one model; returns its run id.

    Tables come from the configuration unless frames are passed. Labels of both
    are checked while they are read: the train table must have every class, and
    classes that the test table lacks are logged. With the ``run_id`` of a softmax
    run that was cut short, it goes on from its newest checkpoint.
    """
    if config.model_type == "bayes":
        return _run_family(spark, [config], store, train, test)[0]
    train, test = _tables(spark, config, train, test)
    watched = LabelWatch(config.num_labels), LabelWatch(config.num_labels)
    resume, run_id = run_id is not None, run_id or store.new_run_id()
    path = store.model_path(run_id)
    workers = config.parallelism or spark.sparkContext.defaultParallelism
    metrics, best = _run_softmax(spark, config, train, test, path, workers, resume, watched)
    write_table(input_example(train, "text"), f"{path}/input_example")
    missing = watched[1].missing()
    store.log_run(config.experiment_location, run_id, config.model_type, metrics, _params(spark, config, best, missing))
    return run_id


def _tables(
    spark: SparkSession, config: TrainingConfig, train: DataFrame | None, test: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """The row key, text and label of both sides."""
    train = read_table(spark, config.train_table_name, config.database_name) if train is None else train
    test = read_table(spark, config.test_table_name, config.database_name) if test is None else test
    return tuple(select_configured(side, config.feature_col, config.label_col, [config.row_key]) for side in (train, test))


def _params(spark: SparkSession, config: TrainingConfig, best: str, test_missing: Sequence[int]) -> dict:
    """What is logged of a run besides its metrics."""
    return {
        **config.as_params(),
        "train_batch_size": config.batch_size,
        "eval_batch_size": config.batch_size,
        "workers": config.parallelism or spark.sparkContext.defaultParallelism,
        "epochs": config.num_train_epochs,
        "best_checkpoint": best,
        "test_labels_missing": list(test_missing),
        "runtime_version": pyspark.__version__,
        "python_version": platform.python_version(),
    }


def _run_family(
    spark: SparkSession,
    configs: Sequence[TrainingConfig],
    store: RunStore,
    train: DataFrame | None,
    test: DataFrame | None,
) -> list[str]:
    """Runs of count-based models that differ in their vocabulary limit alone: one pass over the train texts, one over the test texts."""
    first = configs[0]
    train, test = _tables(spark, first, train, test)
    if first.max_token_length != -1:
        cut = first_tokens("text", first.max_token_length - SPECIAL_TOKENS_PER_TEXT)
        train, test = train.withColumn("text", cut), test.withColumn("text", cut)
    run_ids = [store.new_run_id() for _ in configs]
    paths = [store.model_path(run_id) for run_id in run_ids]
    watched = LabelWatch(first.num_labels), LabelWatch(first.num_labels)
    started = time.time()
    counts = watched[0].watch(train).where(F.col("label").between(0, first.num_labels - 1))
    models = fit_bayes_family(counts, paths, first.num_labels, [c.max_vocab for c in configs])
    watched[0].require()
    runtime = time.time() - started

    logits = bayes_family_logits(spark, models)
    scored = watched[1].watch(test).select("label", logits.alias("logits"))
    k = first.num_labels
    own = F.transform(F.sequence(F.lit(0), F.lit(len(models) - 1)), lambda i: F.slice(F.col("logits"), i * k + 1, F.lit(k)))
    each = scored.select("label", F.posexplode_outer(own).alias("model", "logits"))
    loss = F.sum(negative_log_likelihood("logits", "label", MICRO)).alias("loss")
    cells = each.groupBy("model", F.col("label").cast("bigint").alias("label"), argmax("logits").alias("predicted_class"))
    cells = written(cells.agg(F.count(F.lit(1)).alias("n"), loss), "cells")  # classes times classes per model
    watched[1].require(dense=False)

    example = input_example(train, "text").collect()  # five rows
    for place, (config, run_id, path) in enumerate(zip(configs, run_ids, paths)):
        found = weighted_metrics(cells.where(F.col("model") == place).drop("model")).first().asDict()
        metrics = {f"eval_{m}": found[m] for m in ("f1", "precision", "recall", "loss")}
        metrics |= {"train_runtime": runtime, "majority_f1": found["majority_f1"]}
        write_table(spark.createDataFrame(example, "text string"), f"{path}/input_example")
        params = _params(spark, config, "counts", watched[1].missing())
        store.log_run(config.experiment_location, run_id, config.model_type, metrics, params)
    return run_ids


def _run_softmax(
    spark: SparkSession,
    config: TrainingConfig,
    train: DataFrame,
    test: DataFrame,
    path: str,
    workers: int,
    resume: bool,
    watched: tuple[LabelWatch, LabelWatch],
) -> tuple[dict, str]:
    max_steps = None
    if config.streaming_read:
        plan = step_plan(train, config.batch_size, config.num_train_epochs, workers).first()
        max_steps = max(1, plan["max_steps"])
    model, state = fit_softmax(
        watched[0].watch(train),
        watched[1].watch(test),
        path,
        num_labels=config.num_labels,
        row_key=config.row_key,
        batch_size=config.batch_size,
        epochs=config.num_train_epochs,
        learning_rate=config.learning_rate,
        weight_decay=config.weight_decay,
        bits=config.feature_bits,
        seed=config.seed,
        parallelism=workers,
        lazy=config.streaming_read,
        max_steps=max_steps,
        eval_steps=config.eval_steps,
        max_token_length=config.max_token_length,
        metric=config.metric_for_best_model,
        save_total_limit=config.save_total_limit,
        resume=resume,
    )
    watched[0].require()
    watched[1].require(dense=False)
    # The best checkpoint is what scoring loads.
    save_checkpoint(spark, model, TrainingState(f"{path}/best", state.log_history, state.best_step), 0)
    entries = log_history(read_log_history(spark, f"{path}/trainer_state", multi_line=False))
    entries = entries.withColumn("run_id", F.lit("run")).withColumn("best_step", F.lit(state.best_step))
    row = best_metrics(entries, EVAL_METRICS, f"eval_{config.metric_for_best_model}").first()
    metrics = {name: value for name, value in row.asDict().items() if name not in ("run_id", "step")}
    return metrics, f"epoch={state.best_epoch}"


def run_sweep(
    spark: SparkSession,
    configs: Sequence[TrainingConfig],
    store: RunStore,
    train: DataFrame | None = None,
    test: DataFrame | None = None,
    side_by_side: int = 1,
) -> list[str]:
    """One run per configuration, all in one run table; returns run ids in order.

    Count-based models that differ in their vocabulary limit or experiment alone
    share their passes over both tables, however many they are. The others are
    distributed jobs of their own; ``side_by_side`` of them are submitted at a time
    and share the cluster.
    """
    groups: dict[object, list[int]] = {}
    for place, config in enumerate(configs):
        shared = replace(config, max_vocab=None, experiment_location="") if config.model_type == "bayes" else place
        groups.setdefault(shared, []).append(place)

    def fit(places: list[int]) -> list[str]:
        mine = [configs[place] for place in places]
        if mine[0].model_type == "bayes":
            return _run_family(spark, mine, store, train, test)
        return [run_training(spark, mine[0], store, train, test)]

    with ThreadPoolExecutor(side_by_side) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(fit), groups.values()))
    by_place = {place: run_id for places, ids in zip(groups.values(), found) for place, run_id in zip(places, ids)}
    return [by_place[place] for place in range(len(configs))]

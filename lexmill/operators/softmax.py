"""k-class text classifier trained in epochs of mini-batches, data-parallel on Spark.

Texts become sets of hashed tokens in the JVM. Each epoch, every partition runs
mini-batch gradient steps from the same starting weights, and sends on how far
the features that its rows touched have moved. Moves are added up by feature,
weighted by rows, and combined before they shuffle. Weights number
``(2**bits + 1) * num_labels`` at most, fixed by arguments and checked; the driver
gets those of features that some row has.

A checkpoint holds the weights that are not zero and the progress of the run, so
a run that was cut short goes on from the newest one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.functions import tokens
from lexmill.operators.encode import SPECIAL_TOKENS_PER_TEXT
from lexmill.operators.metrics import evaluate
from lexmill.operators.runs import checkpoints_to_keep
from lexmill.operators.scoring import PROBABILITIES, Predictor, score, stable_softmax
from lexmill.session import delete_path, list_names, shared_dir, written

MAX_WEIGHTS = 16_000_000
#: Training rows for which there is a partition, where that makes more partitions than workers.
PARTITION_ROWS = 20_000


def hashed_tokens(text: Column | str, bits: int, max_token_length: int = -1) -> Column:
    """The set of hash buckets of a text's tokens, as ``array<int>``."""
    words = tokens(text)
    if max_token_length != -1:
        words = F.slice(words, 1, max_token_length - SPECIAL_TOKENS_PER_TEXT)
    return F.array_distinct(F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(2**bits)).cast("int")))


@dataclass
class SoftmaxModel:
    """Weights of one checkpoint: one row per hash bucket and, last, the bias."""

    weights: np.ndarray
    bits: int
    max_token_length: int = -1

    @property
    def num_labels(self) -> int:
        return self.weights.shape[1]


@dataclass
class TrainingState:
    """What a run leaves behind besides its checkpoints."""

    path: str
    log_history: list[dict] = field(default_factory=list)
    global_step: int = 0
    best_epoch: int = 0
    best_step: int = 0
    best_metric: float = float("-inf")
    kept_epochs: list[int] = field(default_factory=list)
    metric_of: dict[int, float] = field(default_factory=dict)
    loss_sum: float = 0.0
    runtime: float = 0.0


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a list column, whatever slice it is."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _logits(features: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logits, row of each feature, value of each feature); every row has unit length."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    value = (1.0 / np.sqrt(np.maximum(sizes, 1)))[row]
    logits = np.column_stack(
        [np.bincount(row, weights=value * weights[features, c], minlength=len(sizes)) for c in range(weights.shape[1])]
    )
    return logits + weights[-1], row, value


def _epoch_task(shared, batch_size: int, rate: float, quotas: list[int] | None):
    """The work of one partition in one epoch: mini-batch steps over its rows, then how far its weights moved.

    ``quotas`` has the steps that each partition may take.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = None
        if quotas is not None:
            partition = TaskContext.get().partitionId()
            most = quotas[partition] if partition < len(quotas) else 0
        before = shared.value
        weights = before.copy()
        touched = np.zeros(len(weights), bool)
        n_classes = weights.shape[1]
        rows = steps = 0
        loss = 0.0
        for batch in batches:
            if most is not None and steps >= most:
                break
            labels = batch.column(0).to_numpy()
            features, offsets = _flat(batch.column(1))
            for start in range(0, len(labels), batch_size):
                if most is not None and steps >= most:
                    break
                end = min(start + batch_size, len(labels))
                low, high = offsets[start], offsets[end]
                used, own = features[low:high], labels[start:end]
                logits, row, value = _logits(used, offsets[start : end + 1] - low, weights)
                error = stable_softmax(logits)
                picked = error[np.arange(len(own)), own]
                loss -= float(np.log(np.maximum(picked, 1e-300)).sum())
                error[np.arange(len(own)), own] -= 1.0
                error /= len(own)
                # Only features of these rows move.
                mine, which = np.unique(used, return_inverse=True)
                for c in range(n_classes):
                    weights[mine, c] -= rate * np.bincount(which, weights=value * error[row, c], minlength=len(mine))
                weights[-1] -= rate * error.sum(axis=0)
                touched[mine] = True
                rows += len(own)
                steps += 1
        if rows:
            touched[-1] = True
            at = np.flatnonzero(touched)
            moved = (weights[at] - before[at]) * rows
            last = np.zeros(len(at))
            last[-1] = 1.0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at.astype(np.int32)),
                    pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * n_classes, pa.array(moved.ravel())),
                    pa.array((last * rows).astype(np.int64)),
                    pa.array(last * loss),
                    pa.array((last * steps).astype(np.int64)),
                ],
                names=["feature", "moved", "n", "loss", "steps"],
            )

    return run


def _run_epoch(rows: DataFrame, model: SoftmaxModel, batch_size: int, rate: float, decay: float, quotas: list[int] | None):
    """(new weights, mean loss, steps of all workers) after one pass over the training rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.weights)
    task = _epoch_task(shared, batch_size, rate, quotas)
    pieces = rows.select("label", "features").mapInArrow(
        task, "feature int, moved array<double>, n bigint, loss double, steps bigint"
    )
    k = model.num_labels
    sums = [F.sum(F.col("moved")[c]).alias(f"m{c}") for c in range(k)]
    sums += [F.sum(c).alias(c) for c in ("n", "loss", "steps")]
    table = pieces.groupBy("feature").agg(*sums).toPandas().sort_values("feature")
    shared.destroy()
    if table.empty:
        return model.weights, 0.0, 0
    # The bias is the last feature; its row has the totals.
    last = table.iloc[-1]
    weights = model.weights.copy()
    weights[table["feature"].to_numpy()] += table[[f"m{c}" for c in range(k)]].to_numpy() / float(last["n"])
    return weights * (1.0 - decay), float(last["loss"] / last["n"]), int(last["steps"])


def partition_rows(df: DataFrame) -> list[int]:
    """Rows of each partition of a frame; over files this reads their footers alone."""
    counted = df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {row["part"]: row["n"] for row in counted}
    return [found.get(part, 0) for part in range(max(found, default=-1) + 1)]


def spread(rows: int, workers: int) -> int:
    """Partitions of so many training rows: one for each worker, more of a large table, so that none grows with it."""
    return max(workers, -(-rows // PARTITION_ROWS))


def step_quotas(rows: Sequence[int], batch_size: int, steps: int) -> list[int] | None:
    """Steps for each partition, together exactly ``steps``, in proportion to what a whole pass would take.

    None if a whole pass takes no more than that.
    """
    whole = [-(-n // batch_size) for n in rows]
    total = sum(whole)
    if total <= steps:
        return None
    quotas = [n * steps // total for n in whole]
    # What rounding left goes to the largest remainders.
    by_remainder = sorted(range(len(whole)), key=lambda i: (-(whole[i] * steps % total), i))
    for i in by_remainder[: steps - sum(quotas)]:
        quotas[i] += 1
    return quotas


def softmax_predictor(spark: SparkSession, model: SoftmaxModel, hashed: bool = False) -> Predictor:
    """A predictor for texts, or for their hashed tokens.

    Hashing runs in the JVM, the products in Arrow batches.
    """
    shared = spark.sparkContext.broadcast(model.weights)

    @F.arrow_udf(PROBABILITIES)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.value
        k = weights.shape[1]
        for column in batches:
            features, offsets = _flat(column)
            logits, _, _ = _logits(features, offsets, weights)
            flat = stable_softmax(logits).astype(np.float32).ravel()
            yield pa.ListArray.from_arrays(np.arange(len(offsets), dtype=np.int32) * k, pa.array(flat))

    if hashed:
        return lambda column, batch_size: predict(column)
    return lambda column, batch_size: predict(hashed_tokens(column, model.bits, model.max_token_length))


def save_checkpoint(spark: SparkSession, model: SoftmaxModel, state: TrainingState, epoch: int) -> None:
    """Write one epoch's weights, those that are not zero and the bias, and the log so far."""
    held = model.weights.any(axis=1)
    held[-1] = True
    at = np.flatnonzero(held)
    frame = pa.table(
        {
            "feature": pa.array(at.astype(np.int32)),
            "w": pa.ListArray.from_arrays(
                np.arange(len(at) + 1, dtype=np.int32) * model.num_labels, pa.array(model.weights[at].ravel())
            ),
        }
    )
    folder = f"{state.path}/epoch={epoch}"
    weights = spark.createDataFrame(frame)
    sizes = [F.lit(model.bits).alias("bits"), F.lit(model.max_token_length).alias("max_token_length")]
    weights.select("feature", "w", *sizes).coalesce(1).write.mode("overwrite").parquet(f"{folder}/weights")
    save_state(spark, state.log_history, state.global_step, f"{folder}/trainer_state")


def save_state(spark: SparkSession, entries: list[dict], global_step: int, path: str) -> None:
    """Write a log history as training-state JSON: one object with all entries, absent keys left out."""
    state = json.dumps({"global_step": global_step, "log_history": entries})
    spark.range(0, 1, 1, 1).select(F.lit(state).alias("value")).write.mode("overwrite").text(path)


def load_softmax(spark: SparkSession, path: str, epoch: int) -> SoftmaxModel:
    """The model of one checkpoint."""
    table = spark.read.parquet(f"{path}/epoch={epoch}/weights").toPandas()
    held = np.vstack(table["w"].to_numpy())
    bits = int(table["bits"].iloc[0])
    weights = np.zeros((2**bits + 1, held.shape[1]))
    weights[table["feature"].to_numpy()] = held
    return SoftmaxModel(weights, bits, int(table["max_token_length"].iloc[0]))


def _save_progress(spark: SparkSession, state: TrainingState, epoch: int) -> None:
    """Write where the run stands, after all else of an epoch: a checkpoint that has this is whole."""
    progress = json.dumps({name: value for name, value in asdict(state).items() if name != "path"})
    frame = spark.range(0, 1, 1, 1).select(F.lit(progress).alias("value"))
    frame.write.mode("overwrite").text(f"{state.path}/epoch={epoch}/progress")


def newest_checkpoint(spark: SparkSession, path: str) -> TrainingState | None:
    """The state of a run at its newest whole checkpoint; None where it has none."""
    names = [name for name in list_names(spark, path) if name.startswith("epoch=")]
    for epoch in sorted((int(name.removeprefix("epoch=")) for name in names), reverse=True):
        if "_SUCCESS" in list_names(spark, f"{path}/epoch={epoch}/progress"):
            saved = json.loads(spark.read.text(f"{path}/epoch={epoch}/progress").first()["value"])
            saved["metric_of"] = {int(e): value for e, value in saved["metric_of"].items()}
            return TrainingState(path, **saved)
    return None


def fit_softmax(
    train: DataFrame,
    test: DataFrame,
    path: str,
    num_labels: int,
    row_key: str,
    text: str = "text",
    label: str = "label",
    batch_size: int = 64,
    epochs: int = 3,
    learning_rate: float = 10.0,
    weight_decay: float = 0.01,
    bits: int = 14,
    seed: int = 123,
    parallelism: int | None = None,
    lazy: bool = False,
    max_steps: int | None = None,
    max_token_length: int = -1,
    metric: str = "f1",
    save_total_limit: int = 10,
    eval_steps: int | None = None,
    resume: bool = False,
) -> tuple[SoftmaxModel, TrainingState]:
    """Train, evaluate once per epoch or about every ``eval_steps`` steps, keep checkpoints, return the best one.

    ``lazy=False`` hashes the texts once into reliable checkpoint files, spread
    evenly by ``row_key`` (which must identify the row), and visits training rows
    in a new seeded order each epoch. ``lazy=True`` reads the table anew each
    epoch, in file order, as it is partitioned, whatever its size. Partitions are as
    many as workers, or more by PARTITION_ROWS: a task does not grow with the table.
    ``max_steps`` bounds the steps over all epochs, counted as those of all workers
    together divided by ``parallelism``, their number: a worker with many rows uses
    its own share and that of idle ones, not everyone's. In the last pass every
    partition has a quota in proportion to its rows, so the budget is spent where
    rows have texts and labels. ``weight_decay`` shrinks the weights once per epoch.
    With ``eval_steps`` an epoch falls into rounds by a hash of the row key; each is
    merged, evaluated and saved under its number like an epoch. ``resume`` goes on
    from the newest whole checkpoint below ``path``, if there is one, with the same
    arguments as before; a run resumed is the run it would have been.
    """
    spark = train.sparkSession
    if (2**bits + 1) * num_labels > MAX_WEIGHTS:
        raise ValueError(f"(2**bits + 1) * num_labels may be at most {MAX_WEIGHTS}")
    workers = parallelism or spark.sparkContext.defaultParallelism

    def features(df: DataFrame) -> DataFrame:
        labelled = df.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(row_key, text, label)
        return labelled.select(
            F.col(row_key).alias("row_key"),
            F.col(label).cast("int").alias("label"),
            hashed_tokens(text, bits, max_token_length).alias("features"),
        )

    if lazy:
        tasks = spread(sum(partition_rows(train)), workers)
        rows, held_out = features(train).coalesce(tasks), features(test)
    else:
        shared_dir(spark)
        hashed = written(features(train), "features")
        tasks = spread(hashed.count(), workers)
        rows = hashed.repartition(tasks, "row_key").checkpoint()
        held_out = features(test).checkpoint()

    sizes = None
    if max_steps is not None:
        sizes = partition_rows(train.coalesce(tasks) if lazy else rows)
    parts = 1
    if eval_steps:
        steps_per_epoch = -(-rows.count() // (batch_size * workers))
        parts = max(1, -(-steps_per_epoch // eval_steps))
    decay = weight_decay if parts == 1 else 1.0 - (1.0 - weight_decay) ** (1.0 / parts)

    model = SoftmaxModel(np.zeros((2**bits + 1, num_labels)), bits, max_token_length)
    best = model
    state = (newest_checkpoint(spark, path) if resume else None) or TrainingState(path)
    done = max(state.metric_of, default=0)
    if done:
        model, best = load_softmax(spark, path, done), load_softmax(spark, path, state.best_epoch)
        _delete_epochs(spark, path, state.kept_epochs)
    no_features = F.array().cast("array<int>")
    started = time.time() - state.runtime
    for epoch in range(done + 1, epochs * parts + 1):
        left = None if max_steps is None else max_steps - state.global_step
        if left is not None and left <= 0:
            break
        quotas = None
        if left is not None:
            quotas = step_quotas([-(-n // parts) for n in sizes], batch_size, left * workers)
        whole, part = divmod(epoch - 1, parts)
        order = F.md5(F.concat_ws(":", F.lit(seed), F.lit(whole + 1), F.col("row_key").cast("string")))
        visited = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(order), F.lit(parts)) == part)
        visited = visited if lazy else visited.sortWithinPartitions(order)
        weights, loss, steps = _run_epoch(visited, model, batch_size, learning_rate, decay, quotas)
        if steps == 0:
            if parts > 1:
                continue
            break
        model = SoftmaxModel(weights, bits, max_token_length)
        state.global_step += -(-steps // workers)
        state.loss_sum += loss
        scored = score(held_out, softmax_predictor(spark, model, hashed=True), "features", empty=no_features)
        found = evaluate(scored, loss=-F.log(F.greatest(F.get("probabilities", F.col("label")), F.lit(1e-30))))
        state.log_history.append({"step": state.global_step, "epoch": epoch / parts, "loss": loss})
        state.log_history.append(
            {
                "step": state.global_step,
                "epoch": epoch / parts,
                **{f"eval_{m}": found[m] for m in ("f1", "precision", "recall", "loss")},
            }
        )
        state.metric_of[epoch] = found[metric]
        # Greater is better; a tie keeps the earlier epoch.
        if found[metric] > state.best_metric:
            best, state.best_metric = model, found[metric]
            state.best_epoch, state.best_step = epoch, state.global_step
        state.kept_epochs = checkpoints_to_keep(state.metric_of, save_total_limit)
        state.runtime = time.time() - started
        save_checkpoint(spark, model, state, epoch)
        _save_progress(spark, state, epoch)
        _delete_epochs(spark, path, state.kept_epochs)
    done = len(state.metric_of)
    state.log_history.append(
        {
            "step": state.global_step,
            "epoch": done / parts,
            "train_runtime": time.time() - started,
            "train_loss": state.loss_sum / max(done, 1),
        }
    )
    save_state(spark, state.log_history, state.global_step, f"{path}/trainer_state")
    return best, state


def _delete_epochs(spark: SparkSession, path: str, kept: Sequence[int]) -> None:
    """Remove all checkpoints but the kept ones, also what a run that was cut short left behind."""
    for name in list_names(spark, path):
        if name.startswith("epoch=") and int(name.removeprefix("epoch=")) not in kept:
            delete_path(spark, f"{path}/{name}")

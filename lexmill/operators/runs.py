"""Runs, checkpoints, model versions and stages as tables.

Picks of the "last" or "best" row are aggregations (max_by / min_by), which
combine map-side: one run or model holding most rows costs no large group.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexmill.functions import class_index, drop_last_segment
from lexmill.operators.levels import LevelledTable
from lexmill.operators.ranking import ranked
from lexmill.session import put_if_absent

# The stages a model version can be in.
STAGES = ("None", "Staging", "Production", "Archived")

RUN_SCHEMA = (
    "experiment string, run_id string, run_name string, logged_at timestamp, "
    "metrics map<string,double>, params map<string,string>"
)
VERSION_SCHEMA = "name string, version int, run_id string, source string, registered_at timestamp"
EVENT_SCHEMA = "name string, version int, stage string, event_order bigint"


def best_checkpoint(epochs: DataFrame, run: str = "run_id", metric: str = "metric") -> DataFrame:
    """(run, best_epoch, best_metric): the maximum, ties to the earliest epoch."""
    rank = F.struct(F.col(metric), (-F.col("epoch")).alias("earliness"))
    known = epochs.where(F.col(metric).isNotNull())
    return known.groupBy(run).agg(F.max_by("epoch", rank).alias("best_epoch"), F.max(metric).alias("best_metric"))


def checkpoint_retention(epochs: DataFrame, limit: int, run: str = "run_id", metric: str = "metric") -> DataFrame:
    """All rows plus ``is_best`` and ``kept``: the best epoch and the newest others, ``limit`` in all.

    With a limit of 1 the newest checkpoint is kept besides the best. A run
    has one row per epoch, which bounds the window.
    """
    per_run = Window.partitionBy(run)
    rank = F.struct(F.col(metric), (-F.col("epoch")).alias("earliness"))
    best = epochs.withColumn("is_best", F.col("epoch") == F.max_by("epoch", rank).over(per_run))
    newest_other = F.row_number().over(per_run.orderBy("is_best", F.desc("epoch")))
    return best.withColumn("kept", F.col("is_best") | (newest_other <= max(limit - 1, 1)))


def checkpoints_to_keep(metric_of: Mapping[int, float], limit: int) -> list[int]:
    """The same rule for the epochs of one run in progress."""
    best = max(metric_of, key=lambda epoch: (metric_of[epoch], -epoch))
    others = sorted((e for e in metric_of if e != best), reverse=True)
    return sorted([best, *others[: max(limit - 1, 1)]])


def best_metrics(entries: DataFrame, metrics: Sequence[str], required: str, run: str = "run_id") -> DataFrame:
    """Metrics of the log row at the best step, with the run's train runtime and loss.

    ``entries`` holds (run, best_step, pos, step, <metrics>, train_runtime,
    train_loss). Of several rows at the best step the first one that has the
    ``required`` metric counts, or else the first one.
    """
    picked = F.struct("step", *metrics)
    order = F.struct(F.col(required).isNull().alias("lacks"), F.col("pos").alias("pos"))
    at_best = F.when(F.col("step") == F.col("best_step"), order)
    has_runtime = F.when(F.col("train_runtime").isNotNull(), F.col("pos"))
    rows = entries.groupBy(run).agg(
        F.min_by(picked, at_best).alias("best"),
        F.min_by(F.struct("train_runtime", "train_loss"), has_runtime).alias("total"),
    )
    return rows.select(run, "best.*", "total.*")


def run_leaderboard(runs: DataFrame, metric: str, group: str = "experiment", top: int | None = None) -> DataFrame:
    """All runs of every experiment, or its ``top`` ones, with their place, best first.

    An experiment may hold any number of runs: without ``top`` runs are ranked by
    ranges of the metric; with it, a rank filter on a window lets each task drop
    all but its own ``top`` rows per experiment before the shuffle.
    """
    measured = runs.where(F.col(metric).isNotNull())
    if top is None:
        placed = ranked(measured, [group], [F.desc(metric), F.col("run_id")])
        return placed.withColumn("place", F.col("place").cast("int"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(metric), "run_id"))
    return measured.withColumn("place", place).where(F.col("place") <= top)


def current_stages(events: DataFrame) -> DataFrame:
    """(name, version, current_stage): the last stage event of every model version.

    Stages are aggregated as numbers: with fixed-width buffers Spark hashes,
    where for strings it would sort all events first.
    """
    last = events.groupBy("name", "version").agg(F.max_by(class_index("stage", STAGES), "event_order").alias("stage"))
    stage = F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return last.select("name", "version", stage.alias("current_stage"))


def versions_in_stage(versions: DataFrame, events: DataFrame, stage: str = "Production") -> DataFrame:
    """The newest version of every model in a stage: name, version, run_id, source, artifact_root."""
    staged = current_stages(events).where(F.col("current_stage") == stage)
    newest = staged.groupBy("name").agg(F.max("version").alias("version"))
    found = versions.join(newest, ["name", "version"])
    return found.select("name", "version", "run_id", "source", drop_last_segment("source").alias("artifact_root"))


class RunStore:
    """Run, version and stage tables below one folder, for any number of writers at once.

    Appends only, merged by levels as they grow. A version number or a place in
    the order of stage events is claimed by a file that one writer alone can
    create; who comes second takes the next number.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _levels(self, name: str, schema: str) -> LevelledTable:
        return LevelledTable(self.spark, f"{self.root}/{name}", schema)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self._levels(name, schema).read()

    def _append(self, name: str, rows: DataFrame, schema: str) -> None:
        """Every append gets its own folder, so that jobs running side by side do not meet."""
        table = self._levels(name, schema)
        table.append(rows)
        table.compact()

    def _append_row(self, name: str, row: tuple, schema: str) -> None:
        self._append(name, self.spark.createDataFrame([row], schema).coalesce(1), schema)

    def _claim(self, kind: str, least: int, claimant: str) -> int:
        """The first number from ``least`` on that nobody has claimed, claimed."""
        number = least
        while not put_if_absent(self.spark, f"{self.root}/claims/{kind}/{number:08d}", claimant):
            number += 1
        return number

    def new_run_id(self) -> str:
        return uuid.uuid4().hex

    def model_path(self, run_id: str) -> str:
        return f"{self.root}/artifacts/{run_id}/model"

    def log_run(
        self, experiment: str, run_id: str, run_name: str, metrics: Mapping[str, float], params: Mapping[str, str]
    ) -> None:
        numbers = {k: float(v) for k, v in metrics.items() if v is not None}
        texts = {k: str(v) for k, v in params.items()}
        self._append_row("runs", (experiment, run_id, run_name, datetime.now(), numbers, texts), RUN_SCHEMA)

    def log_runs(self, runs: DataFrame) -> None:
        """Append many run records at once; ``runs`` has the columns of ``RUN_SCHEMA``."""
        self._append("runs", runs, RUN_SCHEMA)

    def runs(self) -> DataFrame:
        return self._table("runs", RUN_SCHEMA)

    def leaderboard(self, metric: str, top: int | None = None) -> DataFrame:
        flat = self.runs().select("experiment", "run_id", "run_name", F.col("metrics")[metric].alias(metric))
        return run_leaderboard(flat, metric, top=top)

    def register(self, name: str, run_id: str) -> int:
        """A new version of a model, in stage None; returns its number."""
        known = self.versions().where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = self._claim(f"version-{name.encode().hex()}", (known or 0) + 1, run_id)
        self._append_row("versions", (name, version, run_id, self.model_path(run_id), datetime.now()), VERSION_SCHEMA)
        self.move(name, version, "None")
        return version

    def move(self, name: str, version: int, stage: str) -> None:
        """Move a version to a stage; other versions stay where they are."""
        if stage not in STAGES:
            raise ValueError(f"stage must be one of {STAGES}, got {stage!r}")
        known = self.events().agg(F.max("event_order")).first()[0] or 0
        order = self._claim("event", known + 1, f"{name} {version} {stage}")
        self._append_row("stage_events", (name, version, stage, order), EVENT_SCHEMA)

    def versions(self) -> DataFrame:
        return self._table("versions", VERSION_SCHEMA)

    def events(self) -> DataFrame:
        return self._table("stage_events", EVENT_SCHEMA)

    def resolve(self, name: str, stage: str = "Production") -> dict:
        """The newest version of a model in a stage; an error names what is missing."""
        mine = F.col("name") == name
        row = versions_in_stage(self.versions().where(mine), self.events().where(mine), stage).first()
        if row is None:
            raise LookupError(f"no version of {name!r} is in stage {stage!r}")
        return row.asDict()

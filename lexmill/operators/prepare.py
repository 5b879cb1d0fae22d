"""Prepare labelled tables: casts, contracts, splits, shuffles, step plans."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from lexmill.functions import hash_fraction

# Hex digits of an md5 that name a shuffle bucket: 16**4 buckets at most, which
# bounds the one-task running total over bucket sizes to 65,536 rows.
BUCKET_DIGITS = 4


def cast_label(df: DataFrame, text: str = "text", label: str = "label", strict: bool = True) -> DataFrame:
    """``text`` and an integer ``label``. Strict casts raise on bad labels, lenient ones give null."""
    value = F.col(label).cast("int") if strict else F.col(label).try_cast("int")
    return df.select(F.col(text).alias("text"), value.alias("label"))


def select_configured(df: DataFrame, feature_col: str, label_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """The configured feature and label columns under the names ``text`` and ``label``."""
    return df.select(*keep, F.col(feature_col).alias("text"), F.col(label_col).alias("label"))


def project_feature(df: DataFrame, feature_col: str) -> DataFrame:
    """Only the feature column; the scan below reads nothing else."""
    return df.select(feature_col)


def split_name(key: Column | str, train: float = 0.7, seed: int = 12345) -> Column:
    """'train' or 'test' from the md5 of a key.

    Row-local, so it needs no shuffle, survives re-partitioning and keeps equal
    keys (exact copies, when the key is the text) on one side.
    """
    # A null key hashes like the empty string, so every row lands on one side.
    safe = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.when(hash_fraction(safe, f"{seed}:") < F.lit(train), "train").otherwise("test")


def hash_split(df: DataFrame, key: Column | str, train: float = 0.7, seed: int = 12345) -> DataFrame:
    """Both splits in one frame, told apart by a ``split`` column."""
    return df.withColumn("split", split_name(key, train, seed))


def split_pair(df: DataFrame, key: Column | str, train: float = 0.7, seed: int = 12345) -> tuple[DataFrame, DataFrame]:
    """(train, test) as two frames over the same scan."""
    name = split_name(key, train, seed)
    return df.where(name == "train"), df.where(name == "test")


def pair_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Named splits as one frame, matched by column name."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def random_split(df: DataFrame, weights: Sequence[float] = (0.7, 0.3), seed: int = 12345) -> list[DataFrame]:
    """Spark's row-wise random split; the outcome depends on the input's partitioning."""
    return df.randomSplit(list(weights), seed=seed)


def label_audit(df: DataFrame, label: str = "label") -> DataFrame:
    """One row that says whether a label column keeps the contract.

    Labels are first counted per raw value, so the work after the shuffle is per
    distinct label however many rows one label holds.
    """
    raw = F.col(label).cast("string")
    counts = df.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    parsed = counts.withColumn("value", F.col("raw").try_cast("int"))
    audit = parsed.agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("raw").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(
            F.sum(F.when(F.col("raw").isNotNull() & F.col("value").isNull(), F.col("n"))), F.lit(0)
        ).alias("n_not_integer"),
        F.min("value").alias("min_label"),
        F.max("value").alias("max_label"),
        F.count_distinct("value").alias("num_labels"),
    )
    dense = (F.col("min_label") == 0) & (F.col("max_label") + 1 == F.col("num_labels"))
    clean = (F.col("n_null") == 0) & (F.col("n_not_integer") == 0)
    return audit.withColumn("is_valid", F.coalesce(dense & clean, F.lit(False)))


def require_valid_labels(df: DataFrame, label: str, num_labels: int) -> None:
    """Raise unless labels are integers 0..num_labels-1. One counting job."""
    problems = _label_problems(label_audit(df, label).first().asDict(), num_labels, start=True)
    if problems:
        raise ValueError("; ".join(problems))


def _label_problems(row: dict, num_labels: int, start: bool = False) -> list[str]:
    """What is wrong with labels of which ``row`` has the counts and bounds, in words."""
    problems = []
    if row["n_null"]:
        problems.append(f"{row['n_null']} null labels")
    if row["n_not_integer"]:
        problems.append(f"{row['n_not_integer']} labels are not integers")
    if start and row["min_label"] != 0:
        problems.append("labels must start at 0")
    elif row["min_label"] is not None and row["min_label"] < 0:
        problems.append(f"label {row['min_label']} is outside 0..{num_labels - 1}")
    if row["max_label"] is not None and row["max_label"] >= num_labels:
        problems.append(f"label {row['max_label']} is outside 0..{num_labels - 1}")
    return problems


class LabelWatch:
    """The label contract, checked by whatever job reads the rows anyway.

    ``watch`` gives the frame with integer labels, null where they are none, to be
    used in one job that reads all rows; ``require`` then raises if that job saw
    labels that break the contract. No pass of its own, and what is kept of the
    labels is one entry per class.
    """

    def __init__(self, num_labels: int, label: str = "label") -> None:
        self.num_labels, self.label = num_labels, label
        self.observation = Observation(f"labels-{uuid.uuid4().hex}")

    def watch(self, df: DataFrame) -> DataFrame:
        raw, value = F.col(self.label), F.col(self.label).cast("string").try_cast("int")
        inside = value.between(0, self.num_labels - 1)
        seen = df.observe(
            self.observation,
            F.count(F.lit(1)).alias("n_rows"),
            F.count(F.when(raw.isNull(), 1)).alias("n_null"),
            F.count(F.when(raw.isNotNull() & value.isNull(), 1)).alias("n_not_integer"),
            F.min(value).alias("min_label"),
            F.max(value).alias("max_label"),
            F.collect_set(F.when(inside, value)).alias("labels"),
        )
        return seen.withColumn(self.label, value)

    def missing(self) -> list[int]:
        """Classes that no row had."""
        return sorted(set(range(self.num_labels)) - set(self.observation.get["labels"]))

    def require(self, dense: bool = True) -> None:
        """Raise unless the labels seen are integers 0..num_labels-1 and, if ``dense``, each of them occurs."""
        seen = self.observation.get
        problems = _label_problems(seen, self.num_labels)
        if dense and not problems and self.missing():
            problems.append(f"labels {self.missing()} have no rows")
        if problems:
            raise ValueError("; ".join(problems))


def row_identity() -> Column:
    """Identity of a row in a file-based frame: its file and its position in it."""
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))


def shuffle_rows(df: DataFrame, key: Column | str | None = None, seed: int = 123) -> DataFrame:
    """Give every row its place ``shuffle_rank`` (1..n) in a seeded random order.

    ``key`` must identify the row (a primary key); rows whose key is null go by
    their contents, equal ones in any order. Without a key, the row's file and
    position are used, which holds for exact copies too.

    The order is that of ``md5(seed:key)``. Rows are ranked inside hash buckets,
    which are even because the keys are distinct, and bucket offsets come from a
    running total over the bucket sizes: rows never meet in one task.
    """
    identity = row_identity() if key is None else (F.col(key) if isinstance(key, str) else key)
    named = identity.cast("string")
    if key is not None:
        named = F.coalesce(named, F.to_json(F.struct("*")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), named))
    hashed = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))

    # Only the digest is needed for the sizes, so this scan reads the key alone.
    sizes = (
        df.select(F.substring(digest, 1, BUCKET_DIGITS).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))

    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest"))
    # At most 16**BUCKET_DIGITS offsets, so the broadcast is bounded.
    return (
        hashed.withColumn("_within", within)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("shuffle_rank", F.col("_offset") + F.col("_within"))
        .drop("_digest", "_bucket", "_within", "_offset")
    )


def repartition_for_scoring(df: DataFrame, n: int | None) -> DataFrame:
    """Spread rows evenly over ``n`` partitions; unset or 0 leaves the frame alone.

    An explicit ``repartition(n)`` is kept by adaptive execution, so that stays on.
    """
    return df.repartition(n) if n else df


def step_plan(
    df: DataFrame, batch_size: int, epochs: int, parallelism: int = 1, accumulation: int = 1
) -> DataFrame:
    """Steps a run takes over a table, and how often it evaluates to do so once per epoch.

    ``eval_steps`` is the plain quotient, which is 0 when there are fewer steps
    than epochs; ``eval_every`` is the same kept at 1 or more.
    """
    effective = batch_size * accumulation * parallelism
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    planned = counted.select(
        "n_rows",
        F.lit(effective).cast("bigint").alias("effective_batch"),
        F.floor(F.col("n_rows") * epochs / F.lit(effective)).cast("bigint").alias("max_steps"),
    )
    steps = planned.withColumn("eval_steps", F.floor(F.col("max_steps") / epochs).cast("bigint"))
    return steps.withColumn("eval_every", F.greatest(F.lit(1).cast("bigint"), "eval_steps"))

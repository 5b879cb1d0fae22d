"""Table sinks and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexmill.session import path_exists
from lexmill.sources.readers import input_files

WRITE_MODES = ("overwrite", "append")


def _is_path(target: str) -> bool:
    return "/" in target


def _reads_from(df: DataFrame, path: str) -> bool:
    """Does the frame read the existing path, or a file below it, whatever its source is?"""
    if not path_exists(df.sparkSession, path):
        return False
    target, *files = ("/" + p.split(":", 1)[-1].strip("/") + "/" for p in (path, *input_files(df)))
    return any(file.startswith(target) for file in files)


def write_table(
    df: DataFrame, target: str, mode: str = "overwrite", fmt: str = "parquet", partition_by: tuple[str, ...] = ()
) -> None:
    """Overwrite or append to a managed table, or to a path when the target holds a ``/``.

    Overwriting what the frame itself reads is refused before any data is
    touched: by Spark for tables, here for paths, where Spark would delete first.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}, got {mode!r}")
    if mode == "overwrite" and _is_path(target) and _reads_from(df, target):
        raise ValueError(f"{target} is read by the frame that would overwrite it")
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if _is_path(target):
        writer.save(target)
    else:
        writer.saveAsTable(target)


def read_back(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """Read what ``write_table`` wrote."""
    return spark.read.format(fmt).load(target) if _is_path(target) else spark.table(target)


def input_example(df: DataFrame, feature: str, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The feature column of ``n`` rows; with ``order_by``, the first ones by that column.

    The last key wanted is looked up from the key column alone, so that features
    are read only where the scan finds keys up to it.
    """
    if order_by is None:
        return df.select(feature).limit(n)
    last = df.select(F.col(order_by).alias("_key")).orderBy("_key").limit(n).agg(F.max("_key")).scalar()
    return df.where(F.col(order_by) <= last).orderBy(order_by).limit(n).select(feature)

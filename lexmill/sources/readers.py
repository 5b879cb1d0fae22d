"""Table scans, file manifests and ingest."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexmill.functions import last_segment
from lexmill.functions.text import MOUNT_FOLDER, MOUNT_SCHEME

INGEST_FORMATS = ("parquet", "json", "csv", "orc")


def read_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """A catalog table, or a parquet path when the name holds a ``/``."""
    if "/" in name:
        return spark.read.parquet(name)
    return spark.table(f"{database}.{name}" if database else name)


def file_manifest(df: DataFrame) -> DataFrame:
    """One row per file behind a file-based frame: path, name, bytes and rows.

    ``_metadata`` is constant within a file, so map-side aggregation leaves one
    row per file and task; no column data is read.
    """
    return (
        df.groupBy(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_bytes"),
        )
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("file_name", last_segment("file_path"))
    )


def input_files(df: DataFrame) -> list[str]:
    """Paths of the files behind a table, with a mount prefix rewritten; may be empty.

    A list on the driver, a line per file; ``file_manifest`` has the same as a table.
    """
    return [_unmounted(path) for path in df.inputFiles()]


def input_roots(df: DataFrame) -> list[str]:
    """The folders that hold the files behind a frame, without the partition folders in them."""
    folders = {re.sub("^file:/+", "file:/", path.rsplit("/", 1)[0]) for path in input_files(df)}
    return sorted({re.sub("(/[^/=]+=[^/]*)+$", "", folder) for folder in folders})


def _unmounted(path: str) -> str:
    return re.sub(f"^{MOUNT_SCHEME}:/*", f"{MOUNT_FOLDER}/", path)


def read_files(
    spark: SparkSession,
    files: Sequence[str],
    schema: T.StructType | str | None = None,
    base_path: str | None = None,
) -> DataFrame:
    """Read an explicit file list as one table.

    The scan is lazy: each task iterates its own file splits, so the same frame
    serves eager and forward-only reading. Pass ``base_path`` to keep partition
    columns. An empty list needs a schema and gives an empty frame.
    """
    if not files:
        if schema is None:
            raise ValueError("an empty file list needs a schema")
        return spark.createDataFrame([], schema)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.parquet(*files)


def ingest(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Load an external data set for the table writer.

    Text formats need a schema: inferring one would scan the whole input first.
    """
    if fmt not in INGEST_FORMATS:
        raise ValueError(f"format must be one of {INGEST_FORMATS}, got {fmt!r}")
    if fmt in ("json", "csv") and schema is None:
        raise ValueError(f"{fmt} ingest needs a schema")
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path if isinstance(path, str) else list(path))


def read_log_history(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool = True, schema: T.StructType | str | None = None
) -> DataFrame:
    """Training-state JSON: ``global_step`` and ``log_history`` (ragged entries, absent keys null)."""
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path if isinstance(path, str) else list(path))


def log_history(states: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per log entry with its position ``pos`` in the history.

    ``keep`` names columns of the state row to carry along, e.g. a run id.
    """
    entry = states.schema["log_history"].dataType.elementType
    exploded = states.select(*keep, "global_step", F.posexplode("log_history").alias("pos", "entry"))
    return exploded.select(*keep, "global_step", "pos", *[F.col(f"entry.`{f.name}`").alias(f.name) for f in entry])

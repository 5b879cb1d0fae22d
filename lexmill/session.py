"""Session helpers: a local session for tests and benches, and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "lexmill") -> SparkSession:
    """A local session. On a cluster, pass the cluster's own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so that is refused.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lexmill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once below the shared folder and read again: what follows survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path, as Hadoop objects."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder written before, on whatever file system it is."""
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; nothing where it is missing."""
    fs, target = _hadoop(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, target = _hadoop(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file, whole or not at all; false if the path was taken already, also by a writer at the same time.

    The text goes to a file of its own, which then takes the path: on a local or
    mounted file system by a link, elsewhere by a rename that refuses an existing
    path, as HDFS does in one step.
    """
    fs, target = _hadoop(spark, path)
    draft_path = f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}"
    _, draft = _hadoop(spark, draft_path)
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if target.toUri().getScheme() in (None, "file") and fs.getScheme() == "file":
            os.link(_local(draft_path), _local(path))
            return True
        return not fs.exists(target) and fs.rename(draft, target)
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path

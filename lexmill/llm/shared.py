"""What the corpus operators share: words, row keys, and tables written to the shared folder."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.session import scratch_path

#: Blanks as every word rule here means them; ``bytes.split()`` uses the same set.
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows that a Python worker turns into Python objects at a time.
SLICE_ROWS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once below the shared folder and read again.

    This cuts the lineage: whatever follows survives lost executors without
    computing the rows again, and the planner knows their size.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_merging(df: DataFrame) -> DataFrame:
    """The rows, as a side of a join that shuffles both of its sides and broadcasts neither.

    The planner takes a written table for as large as its files, and an exploded row
    for one row still: tables that it thinks small may not fit into the driver.
    """
    return df.hint("merge")


def whole_text(text: Column | str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Runs between blanks, as an array."""
    return F.array_remove(F.split(text, BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart that share a doc_id; rows with equal id and text are interchangeable."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), whole_text(text))


def _all_held() -> dict[str, Any]:
    """What this process holds. Functions travel by value, and globals of their module with them, so it lies elsewhere."""
    return vars(sys.modules.setdefault("_lexmill_held", ModuleType("_lexmill_held"))).setdefault("held", {})


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task under a name, until work begins that does not ask for it."""
    known = _all_held()
    if name not in known:
        known[name] = make()
    return known[name]


def slices(batches: Iterator[pa.RecordBatch], keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS.

    Workers serve one stage after another, and there are more of them than cores: what
    is held under any name but ``keep`` goes first.
    """
    known = _all_held()
    for name in known.keys() - {keep}:
        del known[name]
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)

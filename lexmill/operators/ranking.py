"""Places in a total order, without one task per group.

A window partitioned by a group sorts the whole group in one task. Here rows are
cut into ranges of the full order by sampled splitters, sorted inside each range
and written once; a row's place then follows from its position in its range and
from the sizes of the ranges, of which there are as many as shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.session import written

#: ``monotonically_increasing_id`` is the partition above this many bits, the row in it below.
ROW_BITS = 33


def ranked(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "place", size: str | None = None
) -> DataFrame:
    """All rows and columns plus ``name``: the row's place (from 1) in its group by ``order``.

    With ``size``, a column of that name has the number of rows in the group.
    Rows that ``order`` does not tell apart get places in any order, spread over
    ranges like others, so a group may consist of one repeated row. Null groups
    are a group; an empty table gives an empty result. Columns beginning with
    ``_rank`` are used on the way.
    """
    salted = df.withColumn("_rank_salt", F.monotonically_increasing_id())
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order] + [F.col("_rank_salt")]
    ranges = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_rank_salt")
    rows = written(ranges.withColumn("_rank_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_rank_at", ROW_BITS).alias("_rank_part")
    within = F.col("_rank_at").bitwiseAND((1 << ROW_BITS) - 1).alias("_rank_within")
    rows = rows.select("*", part, within).drop("_rank_at")

    # One row per range, and one per range and group in it: a group's rows lie next to each other.
    sizes = rows.groupBy("_rank_part").agg(F.count(F.lit(1)).alias("_rank_size"))
    before = F.sum("_rank_size").over(Window.orderBy("_rank_part")) - F.col("_rank_size")
    total = F.sum("_rank_size").over(Window.partitionBy()).alias("_rank_total")
    offsets = sizes.select("_rank_part", before.alias("_rank_offset"), total)
    if not group:
        place = F.col("_rank_offset") + F.col("_rank_within") + 1
        return _finished(rows.join(F.broadcast(offsets), "_rank_part"), place, name, size, df.columns)
    names = [f"_rank_g{i}" for i in range(len(group))]
    keyed = [F.col(g).alias(n) for g, n in zip(group, names)]
    starts = rows.groupBy("_rank_part", *keyed).agg(
        F.min("_rank_within").alias("_rank_start"), F.count(F.lit(1)).alias("_rank_rows")
    )
    starts = starts.join(F.broadcast(offsets.drop("_rank_total")), "_rank_part")
    first = starts.groupBy(*names).agg(
        F.min(F.col("_rank_offset") + F.col("_rank_start")).alias("_rank_first"), F.sum("_rank_rows").alias("_rank_total")
    )
    again = [F.col(n).alias(f"{n}f") for n in names]
    same = [F.col(n).eqNullSafe(F.col(f"{n}f")) for n in names]
    starts = starts.drop("_rank_start", "_rank_rows").join(first.select(*again, "_rank_first", "_rank_total"), same)
    mine = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)]
    starts = starts.withColumnRenamed("_rank_part", "_rank_in")
    found = rows.join(starts, [F.col("_rank_part") == F.col("_rank_in"), *mine])
    place = F.col("_rank_offset") + F.col("_rank_within") - F.col("_rank_first") + 1
    return _finished(found, place, name, size, df.columns)


def _finished(rows: DataFrame, place: Column, name: str, size: str | None, columns: Sequence[str]) -> DataFrame:
    extra = [F.col("_rank_total").alias(size)] if size else []
    return rows.select(*[F.col(f"`{c}`") for c in columns], place.cast("bigint").alias(name), *extra)

"""Sharding by fixed virtual slots: a versioned slot-to-shard map, edited when it is rebalanced.

Every record is hashed into one of a few thousand virtual slots. Bytes are summed
per slot, and only these sums (one per slot, however large the table is) decide
how slots are spread over the shards. The map is a stored table of (slot, shard),
a folder a version; rebalancing reads the newest and adds one that moves as few
slots as it needs.

Rows that repeat would all share a slot. Where they fill a good part of a shard,
each of them is hashed with its place among the records as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexmill.llm.shared import kept, whole_text
from lexmill.session import list_names, scratch_path

SHARDS = 16
#: Virtual slots; also the number of rows of any map, which bounds its broadcast.
SLOTS = 4096
#: Repeats of a record are spread if they have more bytes than this part of a shard.
HEAVY_PER_SHARD = 100


def initial_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Shard of each slot: neighbouring slots in equal stretches."""
    return [slot * shards // slots for slot in range(slots)]


def rebalance(current: list[int], load: dict[int, int], shards: int = SHARDS) -> list[int]:
    """An edited map: slots move from the fullest to the emptiest shard while that narrows the gap.

    ``load`` has the bytes per slot; slots without any stay where they are. The
    slot that comes closest to closing half of the gap moves. When no single
    move helps, a pair of slots is exchanged; when neither helps, it is done.
    """
    edited = list(current)
    total = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, size in load.items():
        total[edited[slot]] += size
        held[edited[slot]].add(slot)
    for _ in range(8 * len(current)):
        full = max(range(shards), key=lambda s: (total[s], -s))
        empty = min(range(shards), key=lambda s: (total[s], s))
        gap = total[full] - total[empty]
        moves = [(abs(gap - 2 * load[s]), s, None) for s in held[full] if 0 < load[s] < gap]
        if not moves or min(moves)[0] * 4 > gap:
            near = sorted(held[empty], key=lambda s: (load[s], s))
            sizes = [load[s] for s in near]
            for s in held[full]:
                for t in _around(sizes, load[s] - gap // 2):
                    if 0 < load[s] - sizes[t] < gap:
                        moves.append((abs(gap - 2 * (load[s] - sizes[t])), s, near[t]))
        if not moves:
            break
        _, slot, other = min(moves, key=lambda m: (m[0], m[1], -1 if m[2] is None else m[2]))
        for one, source, target in ((slot, full, empty), (other, empty, full)):
            if one is not None:
                edited[one] = target
                held[source].discard(one)
                held[target].add(one)
                total[source] -= load[one]
                total[target] += load[one]
    return edited


def _around(sizes: list[int], wanted: int) -> range:
    """Places of the sizes next to the wanted one."""
    from bisect import bisect_left

    at = bisect_left(sizes, wanted)
    return range(max(0, at - 1), min(len(sizes), at + 1))


def newest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """(version, shard of each slot) of the newest stored map; at most a row per slot."""
    versions = [int(n.removeprefix("version=")) for n in list_names(spark, path) if n.startswith("version=")]
    whole = [v for v in sorted(versions) if "_SUCCESS" in list_names(spark, f"{path}/version={v}")]
    if not whole:
        return None
    rows = spark.read.schema("slot int, shard int").parquet(f"{path}/version={whole[-1]}").collect()
    return whole[-1], [shard for _, shard in sorted(rows)]


def store_map(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    """Write a version of the map, which must be new."""
    listed = F.split(F.lit(",".join(map(str, shards))), ",").cast("array<int>")
    spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).write.parquet(f"{path}/version={version}")


def edit_map(spark: SparkSession, path: str, load: dict[int, int], slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Rebalance the newest stored map by the bytes per slot and store what comes out as the next version.

    Without a stored map the initial one is stored first; a map that needs no
    move is left as it is. Returns the newest map.
    """
    found = newest_map(spark, path)
    if found is None:
        store_map(spark, path, 0, initial_map(slots, shards))
        found = newest_map(spark, path)
    version, current = found
    if len(current) != slots:
        raise ValueError(f"the map at {path} has {len(current)} slots, not {slots}")
    edited = rebalance(current, load, shards)
    if edited != current:
        store_map(spark, path, version + 1, edited)
    return edited


def virtual_slot(*columns: str, slots: int = SLOTS) -> Column:
    """Slot of a record. All given columns are hashed, so that null or repeated ids still spread."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.pmod(F.xxhash64(*texts), F.lit(slots)).cast("int")


def _spread_repeats(records: DataFrame, slots: int, shards: int) -> DataFrame:
    """Records with another slot for those that repeat so often that they fill a good part of a shard.

    Slots with that many bytes are few, and so are repeated records in them: both are bounded by the share.
    """
    total = F.coalesce(F.sum("size"), F.lit(0))
    share = records.agg(total).first()[0] / (shards * HEAVY_PER_SHARD)
    full = records.groupBy("virtual_slot").agg(F.sum("size").alias("held")).where(F.col("held") > share)
    full = F.broadcast(full.select("virtual_slot"))
    same = records.join(full, "virtual_slot").groupBy("record").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    heavy = F.broadcast(same.where((F.col("held") > share) & (F.col("n") > 1)).select("record", F.lit(True).alias("heavy")))
    own = virtual_slot("record", "place", slots=slots)
    slot = F.when(F.col("heavy"), own).otherwise(F.col("virtual_slot"))
    return records.join(heavy, "record", "left").withColumn("virtual_slot", slot).drop("record", "place", "heavy")


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot of every row.

    The law is ``bytes``: sizes (UTF-8 bytes and one) are near equal over the
    shards, as far as single records allow. ``slot`` is the place in the shard,
    from 0 and gapless, ``grown_shard`` is null. A null text has size 1 and the
    checksum of nothing; null and repeated ids are rows like any other, and rows
    that repeat often are spread. An empty table gives an empty result. Further
    input columns are not read. ``map_path`` has the stored map to edit; by
    default one is begun in the shared folder.
    """
    spark = docs.sparkSession
    text = whole_text()
    records = kept(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            virtual_slot("doc_id", "text", slots=slots).alias("virtual_slot"),
            F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).alias("record"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shard-records",
    )
    records = kept(_spread_repeats(records, slots, shards), "shard-slots-of-records")
    per_slot = kept(
        records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows")),
        "shard-slots",
    )
    load = {row[0]: row[1] for row in per_slot.select("virtual_slot", "slot_bytes").collect()}  # one row a slot
    path = map_path or scratch_path(spark, "shard-map")
    edit_map(spark, path, load, slots, shards)
    version, _ = newest_map(spark, path)
    newest = spark.read.schema("slot int, shard int").parquet(f"{path}/version={version}")
    newest = newest.select(F.col("slot").alias("virtual_slot"), "shard")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = per_slot.join(F.broadcast(newest), "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)).alias("slot_start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("slot_start") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )

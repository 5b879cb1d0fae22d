"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: every source gets its share by weight of the wanted total; a source
above its cap (so many passes over its data) is clamped, and what is left over
goes to the others by weight, again until none is above. Each round is one small
aggregate over the sources. Taken: whole passes first, then a fraction of a pass.

The fraction is a seeded sample, documents in hash order up to a cut. Eighteen
documents of each source are held back from it: its twelve largest, which a cut
would not fit around, and six by hash. First it is settled about which of the
largest are in, so that the rest can make up the target; the cut comes where the
held back ones can still go either way; then of all choices among them the one
is taken that brings the source closest to its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexmill.llm.shared import kept, whole_text, word_count

MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the hash that name a bucket; 4,096 buckets a source.
BUCKET_DIGITS = 3
#: Documents of a source that are held back: those that are settled first, further large ones, and some by hash.
LARGEST, LARGE, BY_HASH = 6, 6, 6
HELD = LARGEST + LARGE + BY_HASH


def _ranked_sources(sizes: DataFrame) -> DataFrame:
    """source, source_size, weight: weights 1, 2, 3, repeating, by code point, null last."""
    spark = sizes.sparkSession
    order = sizes.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size")
    ranked = order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1] % 3 + 1))
    fields = [StructField("source", StringType()), StructField("source_size", LongType()), StructField("weight", LongType())]
    return spark.createDataFrame(ranked, StructType(fields))


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``: the shares of the total size by weight, clamped at the caps."""
    cap = (F.col("source_size") * max_epochs).cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rest, weights = float(total), 0.0
    share = F.lit(0.0)
    while total:
        above = cap < share
        found = sources.agg(
            F.sum(F.when(above, F.col("source_size"))).alias("clamped"), F.sum(F.when(~above, F.col("weight"))).alias("weights")
        ).first()
        if not found["weights"] or float(found["weights"]) == weights:
            break
        rest, weights = float(total - max_epochs * (found["clamped"] or 0)), float(found["weights"])
        share = F.lit(rest) * F.col("weight") / F.lit(weights)
    return sources.withColumn("target", F.when(cap < share, cap).otherwise(share))


def _targets(units: DataFrame, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """Sizes by source and bucket, and one row per source: source_size, weight, target, whole passes, what they leave."""
    buckets = kept(
        units.groupBy("source", F.substring("h", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("size")),
        "mix-buckets",
    )
    sources = kept(_ranked_sources(buckets.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sources")
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(max_epochs))).otherwise(0)
    plan = kept(
        water_fill(sources, max_epochs)
        .withColumn("whole", whole.cast("long"))
        .withColumn("want", F.col("target") - F.col("whole") * size),
        "mix-targets",
    )
    return buckets, plan


def subset_sums(sizes: list[int]) -> np.ndarray:
    """The sum of each subset, at the place that has the bits of its members."""
    sums = np.zeros(1, np.int64)
    for size in sizes:
        sums = np.concatenate([sums, sums + size])
    return sums


def settle(sizes: list[int], want: float, source_size: int) -> int:
    """The sum of those of the largest units that are in.

    What they leave of ``want`` must be no more than all other units have, and
    not negative; of the choices that come nearest to that, the one whose share
    of the units is most like the source's.
    """
    sums = subset_sums(sizes)
    total = int(sums[-1])
    over = np.maximum(np.maximum(sums - want, (want - sums) - (source_size - total)), 0.0)
    share = np.abs(sums - want / source_size * total) if source_size else sums
    return int(sums[np.lexsort((np.arange(len(sums)), share, over))[0]])


def held_back(units: DataFrame) -> DataFrame:
    """(source, held): the units a source holds back, by size and hash or by hash, as structs of h and size.

    Ranks are cut down in each task before anything shuffles, so a source may have any number of units.
    """
    by_size = Window.partitionBy("source").orderBy(F.desc("size"), "h")
    by_hash = Window.partitionBy("source").orderBy("h")
    most = LARGEST + LARGE
    tops = units.withColumn("k", F.row_number().over(by_size)).where(F.col("k") <= most)
    # Whichever of these are among the largest, enough others are left.
    firsts = units.withColumn("k", F.row_number().over(by_hash)).where(F.col("k") <= HELD)
    unit = F.struct("k", "h", "size")
    pick = F.collect_list(F.when(F.col("large"), unit)), F.collect_list(F.when(~F.col("large"), unit))
    both = tops.withColumn("large", F.lit(True)).unionByName(firsts.withColumn("large", F.lit(False)))
    lists = both.groupBy("source").agg(F.array_sort(pick[0]).alias("tops"), F.array_sort(pick[1]).alias("firsts"))
    others = F.slice(F.filter("firsts", lambda u: ~F.array_contains(F.transform("tops", lambda t: t["h"]), u["h"])), 1, BY_HASH)
    held = F.transform(F.concat("tops", others), lambda u: F.struct(u["h"].alias("h"), u["size"].alias("size")))
    return lists.select("source", held.alias("held"))


def mixing_plan(units: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, whole passes, cut hash, hashes held back and those of them that are in.

    ``units`` has (source, h, size), one row per hash. A unit is taken once more
    than the whole passes if it is in, or not held back and its hash at most the
    cut's.
    """
    _, plan = _targets(units, max_epochs)
    held = held_back(units)
    wide = plan.alias("p").join(held.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left").select("p.*", "held")

    def aim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            goals = []
            for want, size, units in zip(frame["want"], frame["source_size"], frame["held"]):
                sizes = [int(u["size"]) for u in units]
                fine = sum(sizes[LARGEST:])
                rest = int(size) - sum(sizes)
                middle = want - settle(sizes[:LARGEST], want, int(size)) - fine / 2.0
                goals.append(float(min(max(middle, 0.0), float(rest))))
            yield frame.assign(goal=goals)

    fields = "source string, source_size long, weight long, target double, whole long, want double, held array<struct<h:string,size:long>>"
    aimed = kept(wide.select(*[f.split()[0] for f in fields.split(", ")]).mapInPandas(aim, f"{fields}, goal double"), "mix-aimed")

    hashes = F.transform("held", lambda u: u["h"])
    others = (
        units.alias("u")
        .join(aimed.select("source", "goal", hashes.alias("hashes")).alias("p"), F.col("u.source").eqNullSafe(F.col("p.source")))
        .where(~F.array_contains("hashes", F.col("h")))
        .select("u.source", "h", "size", "goal", F.substring("h", 1, BUCKET_DIGITS).alias("bucket"))
    )
    sums = others.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.any_value("goal").alias("goal"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = kept(sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), "mix-buckets")
    edge = sums.where((F.col("before") <= F.col("goal")) & (F.col("before") + F.col("size") > F.col("goal")))
    edge = kept(edge.select(F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"), "before"), "mix-edge")
    upto = Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        others.join(edge, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("bucket") == F.col("in_bucket")))
        .select("source", "h", "goal", (F.col("before") + F.sum("size").over(upto)).alias("reached"))
        .where(F.col("reached") <= F.col("goal"))
        .groupBy("source")
        .agg(F.max("h").alias("last"), F.max("reached").alias("reached"))
    )
    whole = sums.groupBy("source").agg(F.sum("size").alias("all"))
    cuts = (
        aimed.alias("p")
        .join(edge.alias("e"), F.col("p.source").eqNullSafe(F.col("e.in_source")), "left")
        .join(inside.alias("i"), F.col("p.source").eqNullSafe(F.col("i.source")), "left")
        .join(whole.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")), "left")
        .select(
            *[f"p.{f.split()[0]}" for f in fields.split(", ")],
            F.coalesce("last", "in_bucket", F.lit("g")).alias("cut_hash"),  # behind all hex digits
            F.coalesce("reached", "before", "all", F.lit(0)).cast("long").alias("reached"),
        )
    )

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chosen = []
            for want, reached, units in zip(frame["want"], frame["reached"], frame["held"]):
                off = np.abs((want - reached) - subset_sums([int(u["size"]) for u in units]))
                best = int(np.argmin(off))  # the first of the closest
                chosen.append([u["h"] for place, u in enumerate(units) if best >> place & 1])
            hashes = [[u["h"] for u in units] for units in frame["held"]]
            yield frame.assign(held=hashes, chosen=chosen)[["source", "source_size", "target", "whole", "cut_hash", "held", "chosen"]]

    result = "source string, source_size long, target double, whole long, cut_hash string, held array<string>, chosen array<string>"
    return kept(cuts.mapInPandas(choose, result), "mix-plan")


def seeded_hash(seed: str = SEED):
    """32 hex digits of id and text; rows with equal id and text have equal hashes and are taken alike."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return F.md5(F.concat_ws("|", F.lit(seed), doc_id, F.md5(whole_text())))


def mix(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Columns ``row`` (the input row), size, source_size, target, copies.

    Sizes are word counts, a null text has none. A null source is a source of its
    own, after all others. Rows with equal id and text get equal copies. Sources
    without words have target 0, an empty table gives an empty result. Input
    columns of any name are carried inside ``row``. Equal input gives equal
    output, however it is partitioned.
    """
    units, rows = _units(docs, seed)
    plan = mixing_plan(units, max_epochs)
    more = F.when(F.array_contains("held", F.col("h")), F.array_contains("chosen", F.col("h")))
    return _with_copies(rows, plan, more.otherwise(F.col("h") <= F.col("cut_hash")))


def _units(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """(source, h, size) of every hash, size being that of all its rows, and every row with its source, hash and size."""
    h = seeded_hash(seed)
    narrow = docs.select(F.col("source").cast("string").alias("source"), h.alias("h"), word_count(whole_text()).alias("size"))
    units = kept(narrow.groupBy("source", "h").agg(F.sum("size").alias("size")), "mix-units")
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("source").cast("string").alias("source"),
        h.alias("h"),
        word_count(whole_text()).alias("size"),
    )
    return units, rows


def _with_copies(rows: DataFrame, plan: DataFrame, more: Column) -> DataFrame:
    copies = F.col("whole") + F.when(more, 1).otherwise(0)
    return (
        rows.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))
    )


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the input's columns.

    Nulls, repeats and empty tables are as in ``mix``; documents without words come
    as often as their hash says.
    """
    repeated = mix(docs, max_epochs, seed).select(
        "row", F.explode(F.expr("case when copies > 0 then sequence(1, copies) end")).alias("_copy")
    )
    return repeated.select("row.*")

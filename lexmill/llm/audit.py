"""Filter interaction audit: what each filter removes, in every order the filters can be applied in.

Documents are counted per part and per set of filters they fail, at most 32 cells
a part. A walk over all subsets of filters in Gray-code order toggles one filter
at a time: each cell counts how many of the active filters it fails, and joins or
leaves the running survivors as that count reaches or leaves zero. The 32 states
are stored, and every step of every order is a difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexmill.llm.shared import kept, whole_text, words

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is counted in a cell: documents, good ones, toxic ones.
COUNTED = ("n", "good", "toxic")

RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_failures(text: Column) -> list[Column]:
    """Of a text without nulls, whether it fails each of the filters that look at it alone."""
    split = words(text)
    n_words, distinct = F.size(split), F.size(F.array_distinct(split))
    upper = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [
        n_words < MIN_WORDS,
        F.lit(100) * distinct < F.lit(MIN_DISTINCT_PERCENT) * n_words,
        F.lit(100) * upper > F.lit(MAX_UPPER_PERCENT) * F.length(text),
        text.rlike(MARKS),
    ]


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """(part, doc_id, mask) of every row: bit i of the mask says that it fails filter i.

    The last filter looks for the same text under a smaller doc_id. Its smallest
    id is found per text digest, with partial aggregates; rows meet it by digest
    and id together, so that copies of one text spread over all tasks.
    """
    text = whole_text()
    mask = F.lit(0)
    for i, fails in enumerate(text_failures(text)):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    rows = kept(
        docs.select(
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            "doc_id",
            F.unhex(F.sha2(text, 256)).alias("digest"),
            mask.alias("mask"),
        ),
        "audit-masks",
    )
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("digest", "doc_id", F.lit(True).alias("is_first"))
    named = rows.where("doc_id is not null").join(firsts, ["digest", "doc_id"], "left")
    copy = F.when(F.col("is_first").isNull(), 1 << (len(FILTERS) - 1)).otherwise(0)
    nameless = rows.where("doc_id is null").select("part", "doc_id", "mask")
    return named.select("part", "doc_id", (F.col("mask") + copy).alias("mask")).unionByName(nameless)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters."""
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"),
    )
    rows = failures(docs, part)
    # Rows of one id, part and mask are one row from here on; null ids have no label and are not joined.
    by_id = rows.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    labelled = by_id.join(judged, "doc_id", "left").select(
        "part",
        "mask",
        "n",
        F.when(F.col("is_good"), F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("is_toxic"), F.col("n")).otherwise(0).alias("toxic"),
    )
    nothing = F.lit(0).cast("bigint")
    nameless = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    nameless = nameless.select("part", "mask", "n", nothing.alias("good"), nothing.alias("toxic"))
    sums = [F.sum(c).alias(c) for c in COUNTED]
    return labelled.unionByName(nameless).groupBy("part", "mask").agg(*sums)


def survivors(counts: dict[int, Sequence[int]], filters: int) -> list[list[int]]:
    """For each subset of filters, by its bits, the sums over cells that fail none of them."""
    failing = dict.fromkeys(counts, 0)
    running = [sum(column) for column in zip(*counts.values())] if counts else [0] * len(COUNTED)
    states: list[list[int]] = [[]] * (1 << filters)
    active = 0
    states[active] = list(running)
    for step in range(1, 1 << filters):
        toggled = (step & -step).bit_length() - 1  # the one bit in which neighbouring Gray codes differ
        on = not active >> toggled & 1
        active ^= 1 << toggled
        for mask, counted in counts.items():
            if not mask >> toggled & 1:
                continue
            failing[mask] += 1 if on else -1
            if failing[mask] == (1 if on else 0):
                sign = -1 if on else 1
                running = [r + sign * c for r, c in zip(running, counted)]
        states[active] = list(running)
    return states


def steps(counts: dict[int, Sequence[int]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, ..., shapley) of every order and step, from the counts of the cells."""
    k = len(filters)
    states = survivors(counts, k)
    everything = (1 << k) - 1
    bit = {name: 1 << i for i, name in enumerate(filters)}
    fails = {f: states[0][0] - states[b][0] for f, b in bit.items()}
    alone = {f: states[everything ^ b][0] - states[everything][0] for f, b in bit.items()}
    # A filter comes after exactly the subset S in |S|! (k - |S| - 1)! orders.
    shapley = {
        f: sum(
            factorial(s.bit_count()) * factorial(k - s.bit_count() - 1) * (states[s][0] - states[s | b][0])
            for s in range(1 << k)
            if not s & b
        )
        for f, b in bit.items()
    }
    rows = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | bit[f]
            lost = [x - y for x, y in zip(states[before], states[after])]
            rows.append(("".join(order), step, states[after][0], lost[0], fails[f] - lost[0], alone[f], lost[1], lost[2], shapley[f]))
            before = after
    return rows


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Every part has all 120 orders of five steps, zeros included. A null part is
    the empty one. A null text is empty, and equal to an empty one. A row with a
    null id is no copy of any other, none of it, and has no label; rows that
    share id and text are no copies of each other. An id with several labels
    is good or toxic if one of them says so. An empty table gives an empty
    result. Further columns are not read.
    """
    found = cells(docs, labels, part)
    # At most 32 cells a part.
    grouped = found.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTED)).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = steps({cell["mask"]: [cell[c] for c in COUNTED] for cell in held})
                orders, at, *numbers = zip(*rows)
                columns = [pa.array([name] * len(rows)), pa.array(orders), pa.array(at, pa.int32())]
                columns += [pa.array(column, pa.int64()) for column in numbers]
                yield pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in RESULT.split(", ")])

    return grouped.mapInArrow(walk, RESULT)

"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits. Each bit
position gets a vector of RADIUS + 1 bits; mask v (any non-zero vector) keeps the
bits whose vector has an even product with v removed, that is those where the
product is odd. The vectors of at most RADIUS differing bits span no more than
RADIUS dimensions, so some v is orthogonal to all of them: under that mask the
pair agrees. Hence every pair within the radius meets in one of the
2^(RADIUS+1) - 1 tables, for certain.

Buckets hold different fingerprints only: copies share one. Members of a bucket
are compared in blocks of bounded size and give a spanning forest of their links,
not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.shared import LOWER, UPPER, by_merging, kept, row_key, slices, whole_text

RADIUS = 4
SHINGLE = 4
HASH_SEED = 42
#: Fingerprints of a bucket that one comparison holds on either side.
BLOCK = 512
MASK_SEED = 20_250


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of a text that is lower-cased already; 0 without words."""
    import xxhash

    words = text.encode("utf-8").split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)]
    else:
        line, ends, at = b" ".join(words), [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        begins = [0, *[e + 1 for e in ends[:-SHINGLE]]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], HASH_SEED) for a, b in zip(begins, ends[SHINGLE - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[start : start + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _lower(text: str) -> str:
    return text.translate(_ASCII_LOWER) if not text.isascii() else text.lower()


_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and fingerprint (signed 64 bits) of every row; null texts have no words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(_lower(t)) for t in batch.column("text").to_pylist()]
            found = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), found], ["doc_id", "row_key", "fingerprint"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole_text().alias("text"))
    return rows.mapInArrow(compute, "doc_id long, row_key long, fingerprint long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks; any two words within the radius agree under one of them.

    Bit positions get the non-zero vectors in turn, shuffled by a seed, so that
    every mask keeps about half of the bits.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    vectors = np.random.default_rng(MASK_SEED).permutation(vectors)
    return [
        sum(1 << bit for bit, m in enumerate(vectors) if bin(int(m) & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))
    ]


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of the groups that links make among a bounded number of fingerprints."""
    n = len(prints)
    if n == 2:
        a, b = sorted(prints.tolist())
        return [(b, a)] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius else []
    bits = prints.view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    left, out = np.ones(n, bool), []
    for start in range(n):
        if left[start]:
            group = np.zeros(n, bool)
            group[start] = True
            edge = group
            while edge.any():
                edge = near[edge].any(axis=0) & ~group
                group |= edge
            left &= ~group
            if group.sum() > 1:
                members = prints[group].tolist()
                root = min(members)
                out += [(m, root) for m in members if m != root]
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with b < a: a forest that connects what links connect. ``prints`` has different fingerprints."""
    masks = F.array(*[F.lit(m - 2**64 if m >= 2**63 else m) for m in covering_masks(radius)])
    tabled = prints.select("fingerprint", F.posexplode(masks).alias("t", "mask")).select(
        "fingerprint", F.xxhash64("t", F.col("fingerprint").bitwiseAND(F.col("mask"))).alias("bucket")
    )
    shared = tabled.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    members = (
        tabled.join(by_merging(shared), "bucket")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    )
    blocks = members.groupBy(
        "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    ).agg(F.collect_list("fingerprint").alias("prints"))  # about 2 x BLOCK at most

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            lists = batch.column("prints")
            values, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b - a > 1:
                    found.update(_forest(np.ascontiguousarray(values[a:b]), radius))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"]
            )

    return blocks.select("prints").mapInArrow(compare, "a long, b long").distinct()


def _signature(edges: DataFrame) -> tuple:
    """Tells different sets of edges apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    Edges (a, b) point from a larger to a smaller node. Each round hangs every
    neighbour of a node below the node's smallest neighbour, larger ones first,
    then smaller ones (two of the same join), until all edges are stars. Each
    round's edges are written to the shared folder. A hub's rows meet one row with
    its smallest neighbour, so a skewed join can be split.
    """
    current = kept(edges, "links")
    while True:
        both = current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(by_merging(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = kept(large.where("a > b").distinct(), "stars-large")
        least = stars.groupBy("a").agg(F.min("b").alias("low"))
        joined = stars.join(by_merging(least), "a")
        small = joined.select("b", "low").where("b > low").unionAll(least.select(F.col("a").alias("b"), "low"))
        after = kept(small.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "stars-small")
        ends, current = _signature(current), after
        if ends == _signature(after):
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted_rows(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, row_key, fingerprint, component_id and the component's smallest fingerprint (root) of every row."""
    prints = kept(fingerprints(docs), "prints")
    different = kept(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints-different")
    stars = components(links(different.select("fingerprint"), radius))
    rooted = kept(
        different.join(by_merging(stars), F.col("fingerprint") == F.col("node"), "left").select(
            "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
        ),
        "prints-rooted",
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(by_merging(named), "root").select("fingerprint", "component_id", "root")
    return prints.join(by_merging(by_print), "fingerprint").select("doc_id", "row_key", "fingerprint", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, row_key, fingerprint (signed) and component_id of every row.

    Null and empty texts have fingerprint 0 and are linked like any other, as are
    texts of any length. Rows with a null id belong to a component but never name
    it; a component of such rows alone has a null id. Repeated rows come out
    repeated. An empty table gives an empty result. Further columns are not read.
    """
    return _rooted_rows(docs, radius).drop("root")


def one_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``rooted`` (doc_id, row_key, root), all columns as they came.

    That with the smallest id, then row key; rows without an id come last.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")
    keep = rooted.groupBy("root").agg(least).select("least.doc_id", "least.row_key")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("key"))
    joined = rows.alias("d").join(
        keep.alias("k"), F.col("key").eqNullSafe(F.col("k.row_key")) & F.col("id").eqNullSafe(F.col("k.doc_id")), "left_semi"
    )
    return joined.dropDuplicates(["id", "key"]).select("row.*")


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with or without ids; all columns as they came.

    Null and empty texts have the fingerprint zero and are one component. Of
    repeated rows one stays, of rows that share an id one of each component. The
    smallest id stays, null ids come last. An empty table gives an empty result.
    """
    return one_of_each(docs, _rooted_rows(docs, radius))

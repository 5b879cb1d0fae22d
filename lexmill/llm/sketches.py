"""Document fingerprints: bottom-k sketches of shingle hashes, made and compared by column functions only.

A sketch is the sorted array of the k smallest different hashes of a text's
five-word shingles. Sketches of parts merge into the sketch of the whole. Two of
them estimate resemblance and containment, one estimates how many different
shingles there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexmill.llm.shared import kept, row_key, whole_text, words

SHINGLE = 5
K = 128
#: Ranges of ids that are ordered one by one, at least and at most; also bounds the table of their first rows.
BUCKETS = 4096, 65_536
#: What a range should hold.
ROWS_PER_BUCKET = 10_000
HASHES = 2.0**64


def shingle_hashes(word_array: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of all runs of ``shingle`` words; of the whole sequence, if it is shorter; none without words.

    ``word_array`` must be a column of its own: an expression would be evaluated again for every run.
    """
    n = F.size(word_array)
    runs = F.transform(F.sequence(F.lit(1), n - (shingle - 1)), lambda i: F.xxhash64(F.slice(word_array, i, shingle)))
    return (
        F.when(n == 0, F.array().cast("array<bigint>")).when(n <= shingle, F.array(F.xxhash64(word_array))).otherwise(runs)
    )


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both; 1 if neither has any."""
    both = merge(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below k."""
    kth = F.element_at(a, k).cast("double") + HASHES / 2
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * HASHES / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has as well."""
    both = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * both / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_string(sketch: Column) -> Column:
    """The sketch as base64 of its big-endian 64-bit hashes."""
    return F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def sketch(docs: DataFrame, shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """doc_id and sketch of every row; null texts have no shingles."""
    split = docs.select("doc_id", words(whole_text()).alias("w"))
    return split.select("doc_id", bottom_k(shingle_hashes(F.col("w"), shingle), k).alias("sketch"))


def _splitters(docs: DataFrame, buckets: int) -> list[int]:
    """Approximate quantiles of the ids of all rows, rising; an id that holds many rows stands there several times."""
    if buckets < 2:
        return []
    shares = F.lit(",".join(str(i / buckets) for i in range(1, buckets)))
    quantiles = F.percentile_approx("doc_id", F.split(shares, ",").cast("array<double>"), 10 * buckets)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(quantiles).first()[0] or []


def _rank(splitters: list[int], doc_id: Column, equal: bool) -> Column:
    """How many splitters are below the id, or at most as large, by halving."""
    if not splitters:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, splitters))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in range(len(splitters).bit_length() - 1, -1, -1)])

    def step(at: Column, size: Column) -> Column:
        other = F.get(known, at + size - 1)
        return F.when(other <= doc_id if equal else other < doc_id, at + size).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def _in_ranges(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, key, text and the bucket of the id; larger ids, and of one id larger keys, in larger buckets.

    Ranges hold about equally many rows, wherever the ids lie. An id that fills
    several ranges is cut by the keys of its rows. Rows without an id come after
    all others, in buckets of their own by key.
    """
    splitters = _splitters(docs, buckets)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), whole_text().alias("text"))
    doc_id = F.col("doc_id")
    rows = rows.withColumn("below", _rank(splitters, doc_id, False)).withColumn("upto", _rank(splitters, doc_id, True))
    own = F.col("upto") - F.col("below") - 1  # ranges of this id alone
    part = F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * own)
    ranged = F.when(own > 0, F.col("below") + 1 + F.least(part, own - 1)).otherwise(F.col("upto")).cast("long")
    by_key = -1 - F.pmod("key", F.lit(buckets))
    return rows.withColumn("bucket", F.when(doc_id.isNull(), by_key).otherwise(ranged)).drop("below", "upto")


def fingerprint_neighbours(docs: DataFrame, shingle: int = SHINGLE, k: int = K, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is the one with the next smaller id, after the last the
    first; rows with equal ids follow each other by a hash of their texts, rows
    without an id come last. A text's second half (rounded down) is replaced by as
    many code points from the front of the next text. Null texts are empty; a text
    without words has an empty sketch, like only to another such (1). A single
    document follows itself. An empty table gives an empty result. Further columns
    are not read.

    Ids are ordered inside ranges of about equally many rows, so nothing is sorted
    in one place: texts are shuffled once, and behind each range's last row comes
    one more, the first of the next range. By default a range has some ten
    thousand rows, as long as the number of ranges stays in BUCKETS.
    """
    if buckets is None:
        buckets = min(max(docs.count() // ROWS_PER_BUCKET, BUCKETS[0]), BUCKETS[1])
    rows = _in_ranges(docs.select("doc_id", "text"), buckets)
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    first = F.max(F.struct(F.col("doc_id"), F.col("key"))).alias("first")
    heads = rows.groupBy("bucket").agg(first).select("bucket", "first.doc_id", "first.key")
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("bucket").desc())  # a row a range
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = kept(
        heads.select(
            F.coalesce(F.lag("bucket").over(down), F.last("bucket").over(everything)).alias("before"), "bucket", "doc_id", "key"
        ),
        "sketch-heads",
    )
    same = (F.col("r.bucket") == F.col("h.bucket")) & (F.col("r.key") == F.col("h.key")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id"))
    after = (
        rows.alias("r")
        .join(F.broadcast(heads).alias("h"), same)  # at most two rows a bucket number
        .select("r.doc_id", "r.key", "r.text", F.col("before").alias("bucket"), F.lit(True).alias("ahead"))
        .dropDuplicates(["bucket"])
    )
    inside = Window.partitionBy("bucket").orderBy("ahead", *order)
    n, half = F.col("n_chars"), F.expr("cast(n_chars div 2 as int)")
    joined = (
        rows.withColumn("ahead", F.lit(False))
        .unionByName(after)
        .withColumn("next_text", F.lead("text").over(inside))
        .withColumn("n_chars", F.char_length("text").cast("long"))
        .withColumn("w", words(F.col("text")))
        .withColumn("sketch", bottom_k(shingle_hashes(F.col("w"), shingle), k))
        .drop("w")
        .withColumn("next_sketch", F.lead("sketch").over(inside))
        .where(~F.col("ahead"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half)))
        .drop("text", "next_text")
        .withColumn("w", words(F.col("edited")))
        .withColumn("edited_sketch", bottom_k(shingle_hashes(F.col("w"), shingle), k))
    )
    return joined.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )

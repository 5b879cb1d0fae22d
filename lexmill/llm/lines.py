"""Line dedup: two Bloom filters find the lines that may repeat, and only those shuffle.

Every task notes the keys of its documents in a filter of keys seen once and, where
a key was there already, in a filter of keys seen twice. Filters merge by
segments: a key that two tasks saw once was seen twice. A key that repeats is
always in the merged filter, so only keys it holds are sent anywhere: they are
counted exactly, by their 128-bit digests, and the repeated ones go back to
their documents.

A line's key is the line without blanks at both ends, in lower case (A-Z). It
counts once per document, however often it stands there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexmill.llm.shared import kept, row_key, whole_text

MIN_DOCUMENTS = 10
MIN_CHARS = 1
#: Blanks, stripped from both ends of a line.
BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: A filter is cut into segments of this many bits; each key lies in one of them.
SEGMENT_BITS = 1 << 20
#: At most this many segments: a filter then has 64 MB, which bounds what is collected and broadcast.
#: With more lines than that suits, more keys are suspected and shuffled; what is found stays the same.
MAX_SEGMENTS = 512
BITS_PER_LINE = 16
#: Digests a task looks up in one go.
CHUNK = 200_000
#: A repeated key in more than this share of all suspected rows is joined by broadcast: fewer than a thousand such exist.
HEAVY_SHARE = 1000


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes]:
    """The digest of each line of a text, empty for lines with too short a key."""
    keys = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(BLANK_BYTES).lower()
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
        keys.append(hashlib.blake2b(key, digest_size=16).digest() if long_enough else b"")
    return keys


def segments_for(n_lines: int) -> int:
    """A power of two of segments that gives every line its bits, up to the limit."""
    segments = 1
    while segments < MAX_SEGMENTS and segments * SEGMENT_BITS < BITS_PER_LINE * n_lines:
        segments *= 2
    return segments


def _places(digests: np.ndarray, segments: int) -> np.ndarray:
    """(n, 2): the two bits of each digest, both in its segment. ``digests`` holds the first eight bytes of each."""
    start = (digests % np.uint64(segments)) * np.uint64(SEGMENT_BITS)
    mask = np.uint64(SEGMENT_BITS - 1)
    pair = (digests >> np.uint64(9)) & mask, (digests >> np.uint64(29)) & mask
    return np.stack([start + p for p in pair], axis=1).astype(np.int64)


def _heads(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8")[::2]


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(bits: np.ndarray, places: np.ndarray) -> None:
    flat = np.unique(places)
    np.bitwise_or.at(bits, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def _packed(bits: np.ndarray) -> bytes:
    """A segment as places of its bits where they are few, or else as it is."""
    few = np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype("<u4").tobytes()
    return few if len(few) < len(bits) else bits.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) == SEGMENT_BITS // 8:
        return np.frombuffer(data, np.uint8)
    bits = np.zeros(SEGMENT_BITS, np.uint8)
    bits[np.frombuffer(data, "<u4")] = 1
    return np.packbits(bits, bitorder="little")


def _chunks(texts: pa.Array, min_chars: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, digests): each text's distinct keys, a bounded number of them at a time beside what one text has."""
    rows, digests = [], []
    for row in range(len(texts)):
        mine = [d for d in dict.fromkeys(line_keys(texts[row].as_py(), min_chars)) if d]
        rows += [row] * len(mine)
        digests += mine
        if len(digests) >= CHUNK:
            yield rows, digests
            rows, digests = [], []
    if digests:
        yield rows, digests


def twice_seen(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, segments: int | None = None) -> np.ndarray:
    """The filter of keys that at least two documents may hold, as packed bits.

    Each task sends the segments it has bits in; a segment's parts are merged
    as they come, one at a time. The merged filter is bounded by MAX_SEGMENTS.
    """
    if segments is None:
        n_lines = docs.agg(F.sum(F.size(F.split(whole_text(text), "\n")))).first()[0] or 0
        segments = segments_for(n_lines)
    size = SEGMENT_BITS // 8

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(segments * size, np.uint8), np.zeros(segments * size, np.uint8)
        for batch in batches:
            for _, digests in _chunks(batch.column(0), min_chars):
                heads, counts = np.unique(_heads(digests), return_counts=True)
                places = _places(heads, segments)
                _set(twice, places[(counts > 1) | _has(once, places)])
                _set(once, places)
        for segment in range(segments):
            cut = slice(segment * size, (segment + 1) * size)
            if once[cut].any():
                row = [pa.array([segment], pa.int32())]
                row += [pa.array([_packed(bits[cut])], pa.binary()) for bits in (once, twice)]
                yield pa.RecordBatch.from_arrays(row, ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(segment, twice):
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()])], ["segment", "twice"])

        at = once = twice = None
        for batch in batches:
            for segment, first, second in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first, second = _unpacked(first), _unpacked(second)
                if segment == at:
                    twice = twice | second | (once & first)
                    once = once | first
                    continue
                if at is not None:
                    yield row(at, twice)
                at, once, twice = segment, first, second
        if at is not None:
            yield row(at, twice)

    parts = docs.select(text).mapInArrow(note, "segment int, once binary, twice binary")
    ordered = parts.repartition(F.col("segment")).sortWithinPartitions("segment")
    merged = np.zeros(segments * size, np.uint8)
    for row in ordered.mapInArrow(merge, "segment int, twice binary").collect():  # at most MAX_SEGMENTS rows
        merged[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["twice"], np.uint8)
    return merged


def suspects(docs: DataFrame, min_chars: int = MIN_CHARS, segments: int | None = None) -> DataFrame:
    """(doc_id, row_key, digest): once per document each key that the filter of twice-seen keys holds."""
    found = twice_seen(docs, "text", min_chars, segments)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    count = len(found) // (SEGMENT_BITS // 8)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            for rows, digests in _chunks(batch.column(2), min_chars):
                held = np.flatnonzero(_has(twice, _places(_heads(digests), count)))
                ids = [batch.column(i).take(pa.array(np.array(rows)[held])) for i in (0, 1)]
                kinds = pa.array([digests[i] for i in held], pa.binary())
                yield pa.RecordBatch.from_arrays([*ids, kinds], ["doc_id", "row_key", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    return rows.mapInArrow(probe, f"doc_id {kind}, row_key bigint, digest binary")


def repeated_keys(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, dropped, first): per document the keys that enough documents hold, and those it is first of.

    Counts are exact and combined before they shuffle. A key in a great share of
    the documents goes back to them by broadcast, the others by a shuffle.
    """
    rows = kept(suspects(docs, min_chars), "line-suspects")
    # The document with the smallest id is a key's first; ids that are null come last.
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key")
    counted = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    counts = kept(counted.where(F.col("n") >= min_documents), "line-counts")
    total = rows.count()
    is_heavy = F.col("n") * HEAVY_SHARE > total
    heavy = F.broadcast(counts.where(is_heavy))
    light = counts.where(~is_heavy)
    rest = rows.join(heavy.select("digest"), "digest", "left_anti")
    found = rows.join(heavy, "digest").unionByName(rest.join(light, "digest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    # At most as many entries as the document has lines.
    return found.groupBy("doc_id", "row_key").agg(
        F.collect_set("digest").alias("dropped"), F.collect_set(F.when(is_first, F.col("digest"))).alias("first")
    )


def _kept_lines(spark: SparkSession, text: Column, dropped: Column, first: Column, min_chars: int) -> Column:
    """A struct of n_lines, n_dropped and the text of the lines that stay."""

    @F.arrow_udf("n_lines bigint, n_dropped bigint, text string")
    def cut(texts: pa.Array, dropped: pa.Array, first: pa.Array) -> pa.Array:
        out = []
        for text, gone, stays in zip(texts.to_pylist(), dropped.to_pylist(), first.to_pylist()):
            lines, left = (text or "").split("\n"), []
            if not gone:
                out.append({"n_lines": len(lines), "n_dropped": 0, "text": text or ""})
                continue
            gone, stays = set(gone), set(stays or ())
            for line, key in zip(lines, line_keys(text, min_chars)):
                if key in stays:
                    stays.discard(key)
                elif key in gone:
                    continue
                left.append(line)
            out.append({"n_lines": len(lines), "n_dropped": len(lines) - len(left), "text": "\n".join(left)})
        kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
        return pa.array(out, kind)

    return cut(text, dropped, first)


def dedup_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS, keep_first: bool = False
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row.

    Lines whose key has at least ``min_chars`` code points and stands in at least
    ``min_documents`` rows go, from all of them; with ``keep_first`` the first
    such line of the row with the smallest doc_id stays. Every row is a document,
    also where ids are null or repeated. A null or empty text is one empty line,
    whose key is too short to go. Repeated rows are told apart when they are
    counted, and lose the same lines (with ``keep_first``, keep the same). An
    empty table gives an empty result. Further columns are not read. The filters
    find what repeats, so ``min_documents`` must be at least 2.
    """
    if min_documents < 2:
        raise ValueError("a line repeats in two documents or more")
    found = repeated_keys(docs, min_documents, min_chars).select(
        F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key"), "dropped", "first"
    )
    if not keep_first:
        found = found.withColumn("first", F.lit(None).cast("array<binary>"))
    rows = docs.select("doc_id", row_key().alias("row_key"), "text")
    same = (F.col("row_key") == F.col("found_key")) & F.col("doc_id").eqNullSafe(F.col("found_id"))
    joined = rows.join(found, same, "left")
    left = _kept_lines(docs.sparkSession, F.col("text"), F.col("dropped"), F.col("first"), min_chars)
    lines = joined.select("doc_id", left.alias("lines"))
    return lines.select("doc_id", "lines.n_lines", "lines.n_dropped", F.col("lines.text").alias("kept_text"))

"""Best-fit packing planned on a histogram of lengths.

Documents become token ids once, in tasks; what is kept is one narrow row per
piece. Best-fit decreasing then runs over *counts* per length, of which there are
as many as a sequence has places, however many documents there are. The plan is a
list of runs: so many pieces of one length, so many to a sequence, from this
sequence and offset on. Pieces take their place by rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lexmill.llm.shared import held, kept, slices, whole_text

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words remembered by a task, and the longest word worth remembering; neither changes a result.
MEMO_WORDS, MEMO_CHARS = 500_000, 64
# The tokenizer's pattern, for text in lower case made of the letters that ``UNCOMMON`` leaves.
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Anything but ASCII signs and plain Latin letters (no digits of other kinds, no letter that grows in
#: lower case), or the mark that begins a special token.
UNCOMMON = re.compile("[^!-~¡-±´-¸º»¿-įı-ɏ]|<\\|")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in the tokenizer's vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


BYTE_SIGNS = _byte_signs()
END_ID = 0

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"
PLAN = "length int, rank_from long, rank_to long, per_sequence int, sequence_from long, place int"


class _Encoder:
    """Token ids as little-endian bytes, word by word and piece by piece.

    The tokenizer drops white space and never merges across it, so a text's ids
    are the ids of its words in a row, and words come again and again. A new word
    of common letters, digits and signs falls into the pieces of the tokenizer's
    pattern, and only new pieces go through its merges. Any other word goes through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join([BYTE_SIGNS[b] for b in piece.encode("utf-8")])
        known = b"".join([self.ids[t.id] for t in self.model.tokenize(shown)])
        if len(self.pieces) >= MEMO_WORDS:
            self.pieces.clear()
        if len(piece) <= MEMO_CHARS:
            self.pieces[piece] = known
        return known

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8")
        if UNCOMMON.search(word):
            return b"".join([self.ids[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
        known, make = self.pieces.get, self._piece
        return b"".join([known(p) or make(p) for p in PIECE.findall(word.lower())])

    def __call__(self, text: str) -> bytes:
        raws = text.encode("utf-8").split()
        fresh = {raw: self._word(raw) for raw in set(raws).difference(self.words)}
        if not fresh:
            return b"".join(map(self.words.__getitem__, raws))
        known = self.words.get
        out = b"".join([known(raw) or fresh.get(raw, b"") for raw in raws])
        if len(self.words) + len(fresh) > MEMO_WORDS:
            self.words.clear()
        self.words.update((raw, ids) for raw, ids in fresh.items() if len(raw) <= MEMO_CHARS)
        return out


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most ``capacity`` ids; (part, length, rank) names it. Not yet written."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path(TOKENIZER))
        name = f"encoder of {path}"
        encode, part, ranks = held(name, lambda: _Encoder(path)), TaskContext.get().partitionId(), Counter()
        end = END_ID.to_bytes(4, "little")
        for batch in slices(batches, keep=name):
            columns: list[list[int | None]] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[start : start + 4 * capacity]
                    length = len(cut) // 4
                    row = (doc_id, piece, start // 4, length, zlib.crc32(cut), part, ranks[length])
                    ranks[length] += 1
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(pieces, PIECES)


def plan_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts, as rows of PLAN.

    Sequences with the same free room and layout stand in groups. Longer lengths
    come first; each fills the groups with the least sufficient room, as many to a
    sequence as fit, then new sequences. Filling a whole group leaves less than
    half of its room, and a length breaks up one group at most, so that the plan
    has fewer than 3 x 12 rows per length: at most about 74,000 for 2,048.
    """
    rows, next_sequence = [], 0
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first = capacity, next_sequence
                count = -(-left // (capacity // length))
                next_sequence += count
            each = room // length
            placed = min(left, each * count)
            rows.append((length, rank, rank + placed, each, first, capacity - room))
            full, part = divmod(placed, each)
            add(room - each * length, first, full)
            add(room - part * length, first + full, 1 if part else 0)
            add(room, first + full + (1 if part else 0), count - full - (1 if part else 0))
            left, rank = left - placed, rank + placed
    return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    Null and empty texts are the end id alone. Texts of any length are cut into
    pieces of ``capacity``, the last may be shorter. Repeated rows and null ids are
    packed like others, row by row. An empty table gives an empty result. Further
    columns are not read.
    """
    spark = docs.sparkSession
    pieces = kept(tokenize_pieces(docs, tokenizer_path, capacity), "pack-pieces")
    counts = kept(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {row[0]: row[1] for row in counts.groupBy("length").agg(F.sum("n")).collect()}  # a row a length
    plan = spark.createDataFrame(plan_lengths(histogram, capacity), PLAN)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    nth = F.col("rank") - F.col("rank_from")
    placed = ranked.alias("r").join(
        F.broadcast(plan).alias("p"),  # bounded, see plan_lengths
        (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("r.length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("sequence_from") + F.expr("(rank - rank_from) div per_sequence")).alias("sequence_id"),
        (F.col("place") + F.pmod(nth, F.col("per_sequence")) * F.col("r.length")).cast("long").alias("offset"),
    )

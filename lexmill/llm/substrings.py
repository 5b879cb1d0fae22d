"""Exact substring deduplication: Rabin-Karp hashes of every window of 50 words, counted in Spark.

A word goes if it lies in a window whose words also start a window in a document
with a smaller id. Windows are named by two 64-bit Rabin-Karp hashes, computed for
whole documents with array operations.

Most windows occur once, and their number is that of the words. To count only those
that can matter, each window also has a landmark: the smallest hash of its
25-word runs. Equal windows have equal landmarks, neighbouring windows share one,
so a document has few. Windows whose landmark occurs in a single document are
certainly unique; all others are counted. Nothing is dropped by this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexmill.llm.shared import by_merging, kept, row_key, slices, whole_text

WINDOW = 50
MEMO_WORDS, MEMO_CHARS = 500_000, 64
#: Keys with more than one in this many rows are joined by broadcast; there are fewer than this many such keys.
HOT_PARTS = 1_000
#: Odd multipliers of the two rolling hashes (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def _rolled(values: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of all runs of ``length`` values, mixed at the end.

    Doubling: the hash of a run of 2k is that of its first half times base^k plus
    that of its second half.
    """
    runs, have, out, done = values, 1, None, 0
    n = len(values)
    while True:
        if length & have:
            if out is None:
                out, done = runs, have
            else:
                count = n - done - have + 1
                out = out[:count] * np.uint64(pow(base, have, 2**64)) + runs[done : done + count]
                done += have
        if 2 * have > length:
            break
        count = n - 2 * have + 1
        runs = runs[:count] * np.uint64(pow(base, have, 2**64)) + runs[have : have + count]
        have *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _smallest(values: np.ndarray, length: int) -> np.ndarray:
    """The minimum of every run of ``length`` values, by doubling."""
    have, best = 1, values
    while 2 * have <= length:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    rest = length - have
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def _landmarks(values: np.ndarray, window: int) -> np.ndarray:
    run = (window + 1) // 2
    return _smallest(_rolled(values, run, BASES[0]), window - run + 1)


def _profiles(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row_key, n_words, words_sha256 and the different landmarks of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in slices(batches):
            counts, digests, marks = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    values = np.array([hashes[w] for w in words], np.uint64)
                    marks.append(np.unique(_landmarks(values, window)).view(np.int64))
                else:
                    marks.append(np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            flat = np.concatenate(marks) if marks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["doc_id", "row_key", "n_words", "words_sha256", "landmarks"],
            )

    schema = "doc_id long, row_key long, n_words long, words_sha256 string, landmarks array<long>"
    return _keyed(docs).mapInArrow(compute, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), whole_text().alias("text"))


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row_key, start, h1, h2) of windows with one of the row's listed landmarks."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        names = ["doc_id", "row_key", "start", "h1", "h2"]
        for batch in slices(batches):
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist()
            lists = batch.column("landmarks")
            for i, text in enumerate(batch.column("text").to_pylist()):
                values = np.array([hashes[w] for w in text.encode("utf-8").split()], np.uint64)
                wanted = lists[i].values.to_numpy().view(np.uint64)
                starts = np.flatnonzero(np.isin(_landmarks(values, window), wanted))
                if len(starts):
                    h1, h2 = (_rolled(values, window, b)[starts].view(np.int64) for b in BASES)
                    same = [np.full(len(starts), x, np.int64) for x in (ids[i], keys[i])]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (*same, starts, h1, h2)], names)

    return docs.mapInArrow(compute, "doc_id long, row_key long, start long, h1 long, h2 long")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, row_key, n_removed, kept_text, kept_sha256 of rows with the ``starts`` of covered windows."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, texts, digests = [], [], []
            lists = batch.column("starts")
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.encode("utf-8").split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = lists[i].values.to_numpy()
                edge[starts] += 1
                edge[starts + window] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                line = b" ".join([w for w, gone in zip(words, covered.tolist(), strict=True) if not gone])
                removed.append(int(covered.sum()))
                texts.append(line.decode("utf-8"))
                digests.append(hashlib.sha256(line).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.string()),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "row_key", "n_removed", "kept_text", "kept_sha256"],
            )

    schema = "doc_id long, row_key long, n_removed long, kept_text string, kept_sha256 string"
    return docs.mapInArrow(compute, schema)


def _meet(rows: DataFrame, found: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``found``, a written table that has each key once with the number ``n`` of its rows.

    ``total`` is at least the number of rows. A key of more than its HOT_PARTS-th part stays where its rows
    are; there are fewer than HOT_PARTS of them, whatever the size. The others are shuffled.
    """
    is_hot = F.col("n") * HOT_PARTS > total
    hot, rest = F.broadcast(found.where(is_hot).drop("n")), found.where(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(by_merging(rest), key))


def removals(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, row_key, n_words, n_removed, kept_sha256 (and kept_text, null if nothing goes) of every row.

    Null and empty texts have no words. Rows with a null id have no smaller one:
    they stay whole and cover nothing. Rows that share an id do not cover each
    other. Repeated rows come out repeated. An empty table gives an empty result.
    Further columns are not read.
    """
    rows = kept(_profiles(docs, window), "substring-rows")
    long_rows = rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # A row whose words are all those of a smaller id loses every word and names no first window.
    groups = long_rows.groupBy("words_sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    firsts = _meet(long_rows, kept(groups, "substring-groups"), ["words_sha256"], long_rows.count())
    judged = kept(firsts.select("doc_id", "row_key", "first_id", "landmarks"), "substring-firsts")
    originals = judged.where("doc_id = first_id").dropDuplicates(["doc_id", "row_key"])
    marks = originals.select("doc_id", "row_key", F.explode("landmarks").alias("mark"))
    spans = (F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    repeated = kept(marks.groupBy("mark").agg(*spans).where("low < high").select("mark", "n"), "substring-marks")
    n_marks = judged.agg(F.coalesce(F.sum(F.size("landmarks")), F.lit(0))).first()[0]
    found = _meet(marks, repeated, ["mark"], n_marks)
    wanted = found.groupBy("doc_id", "row_key").agg(F.collect_list("mark").alias("landmarks"))
    windows = kept(_windows(_keyed(docs).join(by_merging(wanted), ["doc_id", "row_key"]), window), "substring-windows")
    least = kept(windows.groupBy("h1", "h2").agg(*spans).where("low < high").drop("high"), "substring-least")
    covered = _meet(windows, least, ["h1", "h2"], windows.count()).where("doc_id > low")
    # Repeated rows share a key: a set, so that their starts count once.
    starts = covered.groupBy("doc_id", "row_key").agg(F.collect_set("start").alias("starts"))
    cut = _cut(_keyed(docs).join(by_merging(starts), ["doc_id", "row_key"]), window).dropDuplicates(["doc_id", "row_key"])
    cut = kept(cut if with_text else cut.drop("kept_text"), "substring-cut")
    copies = judged.where("doc_id > first_id").select("doc_id", "row_key").distinct()
    gone = copies.withColumn("all_gone", F.lit(True))
    out = rows.drop("landmarks").join(by_merging(cut), ["doc_id", "row_key"], "left")
    out = out.join(gone, ["doc_id", "row_key"], "left")
    is_gone = F.coalesce("all_gone", F.lit(False))
    return out.select(
        "doc_id",
        "row_key",
        "n_words",
        F.when(is_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
        *([F.when(is_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated windows cut out of their texts, ``n_chars`` following; other columns as they came.

    Texts that lose nothing stay as they are, white space included; texts that
    lose every word stay as empty texts.
    """
    changed = (
        removals(docs, window, with_text=True)
        .where("n_removed > 0")
        .select("doc_id", "row_key", "kept_text")
        .dropDuplicates(["doc_id", "row_key"])
    )
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), row_key().alias("key"))
    joined = rows.alias("d").join(
        changed.alias("c"), (F.col("id") == F.col("c.doc_id")) & (F.col("key") == F.col("c.row_key")), "left"
    )
    text = F.coalesce("kept_text", F.col("row")["text"])
    found = {"text": text}
    if "n_chars" in docs.columns:
        counted = F.char_length("kept_text").cast("long")
        found["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(counted)
    return joined.select(*[found.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

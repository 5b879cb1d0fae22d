"""Vocabularies and fixed-length id / mask arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexmill.functions import tokens
from lexmill.operators.lookup import SharedLookup, publish
from lexmill.operators.ranking import ranked

# Reserved ids, in front of the vocabulary.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4
SPECIAL_TOKENS_PER_TEXT = 2

# What Python workers load as a list has at most this many entries; published or joined, a vocabulary may have any size.
MAX_VOCAB = 200_000

# Tokens in id order, or a published vocabulary.
Vocabulary = Sequence[str] | SharedLookup


def token_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each token occurs; hot tokens are combined before the shuffle."""
    return df.select(F.explode(tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _count_cutoff(totals: DataFrame, size: int) -> Column:
    """Scalar: a count that at least ``size`` tokens reach (0 when there are fewer tokens).

    The running total goes over distinct counts, not tokens; ``d`` distinct
    counts need at least ``d**2 / 2`` token occurrences, so it stays small.
    """
    sizes = totals.groupBy("n").agg(F.count(F.lit(1)).alias("n_tokens"))
    reach = F.sum("n_tokens").over(Window.orderBy(F.desc("n")))
    reached = sizes.select("n", reach.alias("reach")).where(F.col("reach") >= size)
    return F.coalesce(reached.agg(F.max("n")).scalar(), F.lit(0))


def top_tokens(totals: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent tokens of a (token, n, ...) frame; ties go to the smaller token.

    The cutoff leaves about ``size`` candidates in all rather than ``size`` per
    partition, so the final top-k merge stays small at any scale.
    """
    candidates = totals.where(F.col("n") >= _count_cutoff(totals, size))
    return candidates.orderBy(F.desc("n"), "token").limit(size)


def build_vocab(df: DataFrame, text: str = "text", size: int | None = 30_000) -> DataFrame:
    """(token, n, id) for all tokens or the ``size`` most frequent ones, ids from 4 on by (n desc, token).

    With a size, one task holds that many tokens at the end, whatever the table;
    without one, tokens are ranked by ranges and no task holds them all.
    """
    if size is None:
        whole = ranked(token_totals(df, text), [], [F.desc("n"), F.col("token")], "id")
        return whole.withColumn("id", (F.col("id") + (FIRST_TOKEN_ID - 1)).cast("int"))
    if size < 1:
        raise ValueError("vocabulary size must be 1 or more")
    top = top_tokens(token_totals(df, text), size)
    # At most `size` rows reach this window.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return top.select("token", "n", (place + (FIRST_TOKEN_ID - 1)).cast("int").alias("id"))


def resolve_max_length(max_length: int, model_max_length: int | None = None) -> int:
    """The length to pad and cut to; -1 means the model's maximum, which must be given then.

    It is never taken from the table: one long text would pad every row to its length.
    """
    if max_length == -1:
        if not model_max_length:
            raise ValueError("max_length -1 needs the model's maximum")
        return model_max_length
    if max_length < SPECIAL_TOKENS_PER_TEXT:
        raise ValueError(f"max_length must be -1 or at least {SPECIAL_TOKENS_PER_TEXT}")
    return max_length


def _body(text: Column | str, max_length: int) -> Column:
    """The tokens that fit between the start and the end mark."""
    return F.slice(tokens(text), 1, max_length - SPECIAL_TOKENS_PER_TEXT)


def _frame(ids: Column, max_length: int) -> tuple[Column, Column]:
    """(input_ids, attention_mask) of ``max_length`` around the ids of a text's tokens."""
    used = F.size(ids) + SPECIAL_TOKENS_PER_TEXT
    padding = F.array_repeat(F.lit(PAD_ID), F.lit(max_length) - used)
    input_ids = F.concat(F.array(F.lit(CLS_ID)), ids, F.array(F.lit(SEP_ID)), padding)
    mask = F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), F.lit(max_length) - used))
    return input_ids, mask


def encode(df: DataFrame, vocab: DataFrame, row_key: str, text: str = "text", max_length: int = 40) -> DataFrame:
    """(row_key, input_ids, attention_mask), by joining token positions with the vocabulary.

    Every row gives one, also where ``row_key`` is null or repeated. Texts are cut
    to ``max_length`` before they are exploded, so a group that is collected back
    holds at most that many entries and the shuffle carries encoded arrays, never
    texts. Spark broadcasts the vocabulary only if it is small by its measured
    size. Null texts give null arrays.
    """
    # A token outside the vocabulary becomes UNK; a text without tokens keeps one
    # null entry through the outer explode, which is filtered out again below.
    rows = df.select(row_key, text).withColumn("_row", F.monotonically_increasing_id())
    split = rows.select("_row", row_key, F.col(text).isNull().alias("_missing"), _body(text, max_length).alias("_tokens"))
    places = split.select("_row", row_key, "_missing", F.posexplode_outer("_tokens").alias("_pos", "_token"))
    known = vocab.select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    found = places.join(known, "_token", "left")
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_id", F.lit(UNK_ID)).alias("_id")))
    # collect_list skips the null entries of empty texts.
    rows = found.groupBy("_row", row_key).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"), F.first("_missing").alias("_missing")
    )
    ids = rows.select(row_key, "_missing", F.col("_entries._id").alias("_ids"))
    input_ids, mask = _frame(F.col("_ids"), max_length)
    return ids.select(
        row_key,
        F.when(~F.col("_missing"), input_ids).alias("input_ids"),
        F.when(~F.col("_missing"), mask).alias("attention_mask"),
    )


def load_vocab(vocab: DataFrame) -> list[str]:
    """The vocabulary in id order, on the driver; refused beyond ``MAX_VOCAB`` entries."""
    rows = vocab.select("id", "token").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"a loaded vocabulary holds at most {MAX_VOCAB} tokens")
    return [token for _, token in sorted(rows)]


def publish_vocab(vocab: DataFrame) -> SharedLookup:
    """A vocabulary of any size as files that workers search."""
    return publish(vocab.select("token", F.array("id").alias("ids")), "token", "ids", 1, "vocabulary")


def encode_batched(df: DataFrame, vocab: Vocabulary, text: str = "text", max_length: int = 40) -> DataFrame:
    """All columns plus ``input_ids`` and ``attention_mask``, without any shuffle.

    Splitting, cutting and padding stay in the JVM; only the cut token arrays go
    through Arrow, where each distinct token of a batch is looked up once.
    """
    with_ids = df.withColumn("_ids", _lookup(df.sparkSession, vocab)(_body(text, max_length)))
    input_ids, mask = _frame(F.col("_ids"), max_length)
    return with_ids.withColumn("input_ids", input_ids).withColumn("attention_mask", mask).drop("_ids")


def encoded_struct(spark: SparkSession, text: Column | str, vocab: Vocabulary, max_length: int = 40) -> Column:
    """A struct of ``input_ids`` and ``attention_mask`` of a text, to encode inside a larger expression."""
    input_ids, mask = _frame(_lookup(spark, vocab)(_body(text, max_length)), max_length)
    return F.struct(input_ids.alias("input_ids"), mask.alias("attention_mask"))


def training_rows(
    df: DataFrame,
    vocab: Vocabulary,
    text: str = "text",
    label: str = "label",
    max_length: int = 40,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``keep``, ``input_ids``, ``attention_mask`` and an integer label: what a model is trained and measured on."""
    encoded = encode_batched(df.select(*keep, text, F.col(label).cast("int").alias(label)), vocab, text, max_length)
    return encoded.select(*keep, "input_ids", "attention_mask", label)


def used_ids(input_ids: Column | str = "input_ids", attention_mask: Column | str = "attention_mask") -> Column:
    """The ids that the mask shows."""
    ids, mask = (F.col(c) if isinstance(c, str) else c for c in (input_ids, attention_mask))
    return F.filter(ids, lambda x, i: F.get(mask, i) == 1)


def _lookup(spark: SparkSession, vocab: Vocabulary):
    """Arrays of tokens to arrays of ids; a worker has one table for all its batches."""
    published = isinstance(vocab, SharedLookup)
    shared = vocab if published else spark.sparkContext.broadcast(list(vocab))

    @F.arrow_udf("array<int>")
    def lookup(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if published:
            table = shared.open()
        else:
            id_of = {token: place + FIRST_TOKEN_ID for place, token in enumerate(shared.value)}
        for column in batches:
            coded = column.values.dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False)
            if published:
                found, known = table.find(distinct)
                ids = np.where(known, found[:, 0], UNK_ID)
            else:
                ids = np.fromiter((id_of.get(token, UNK_ID) for token in distinct), np.int64, len(distinct))
            values = pa.array(ids, pa.int32()).take(coded.indices)
            yield pa.ListArray.from_arrays(column.offsets, values, mask=column.is_null())

    return lookup


def token_length_profile(df: DataFrame, group: str, text: str = "text", max_length: int = 40) -> DataFrame:
    """Token-count quantiles per group and the share of texts a maximum length would cut.

    Lengths are counted per (group, length) first: the exact percentiles then
    work on weighted distinct lengths, whatever the size of a group.
    """
    lengths = df.groupBy(group, F.size(tokens(text)).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    cut = F.sum(F.when(F.col("length") > max_length - SPECIAL_TOKENS_PER_TEXT, F.col("n")).otherwise(0))
    return lengths.groupBy(group).agg(
        F.sum("n").alias("n_texts"),
        F.min("length").alias("min_tokens"),
        F.max("length").alias("max_tokens"),
        F.expr("percentile(length, 0.5, n)").alias("median_tokens"),
        F.expr("percentile(length, 0.95, n)").alias("p95_tokens"),
        F.round(cut / F.sum("n"), 6).alias("truncated_share"),
    )

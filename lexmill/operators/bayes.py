"""Count-based k-class text classifier (multinomial naive Bayes) as Spark jobs.

Weights are integers, in millionths of a logit, so a document's score is an
integer sum: the same whatever the row order, partitioning or retry.

Every text carries one extra token, a single blank, which no real token can be.
Its count per class is the number of texts, its weight the class prior: one
pass over the texts yields both, and scoring adds the prior like any token.

A fitted model is a folder of two tables:
  vocab    (token, n, by_class)           counts the weights come from
  weights  (token, n, w), tier=hot|tail   hot is bounded in rows and bytes
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from lexmill.functions import decode, round_half_even, softmax, tokens
from lexmill.functions.arrow import coded_tokens, cuts
from lexmill.operators.encode import top_tokens
from lexmill.session import written

MICRO = 1_000_000
TEXT_MARK = " "
# The mark counts as more frequent than any token, so a vocabulary limit keeps it.
MARK_COUNT = 2**62
# Up to this many classes, counts per class are summed in one wide aggregation.
WIDE_SUM_CLASSES = 16
# Bytes of text that are counted in one go, to bound a worker's memory.
COUNTED_BYTES = 16_000_000
# A class without training rows: a logit no document can make up for.
ABSENT_CLASS = -(10**15)

# The broadcast tier of the weights: at most this many tokens, each at most this
# many characters, and at most this many weights in all.
HOT_TOKENS = 50_000
HOT_TOKEN_CHARS = 128
HOT_WEIGHTS = 8_000_000


def marked_tokens(text: Column | str) -> Column:
    """The tokens of a text and the mark; null text gives null."""
    return F.array_append(tokens(text), F.lit(TEXT_MARK))


def _marked(df: DataFrame, text: str) -> Column:
    """Marked tokens of a text column, or of a column of ids, each of which counts as a token."""
    if isinstance(df.schema[text].dataType, T.ArrayType):
        return F.array_append(F.col(text).cast("array<string>"), F.lit(TEXT_MARK))
    return marked_tokens(text)


def token_rows(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(token, label), one row per token of every text and one for its mark; rows without a text are left out."""
    rows = df.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    return rows.select(F.explode(_marked(rows, "text")).alias("token"), "label")


def token_counts(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(token, label, n), the mark included.

    Counts are combined map-side, so a hot token or label shuffles as one row
    per task.
    """
    return token_rows(df, text, label).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, num_labels: int, max_vocab: int | None = None) -> DataFrame:
    """(token, n, by_class) of the mark and all tokens, or the ``max_vocab`` most frequent ones.

    ``counts`` is (token, label, n) with any number of rows per token and label.
    """
    per_class = [
        F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)) for c in range(num_labels)
    ]
    by_token = counts.groupBy("token").agg(F.sum("n").alias("n"), F.array(*per_class).alias("by_class"))
    ranked = by_token.withColumn(
        "n", F.when(F.col("token") == TEXT_MARK, F.lit(MARK_COUNT).cast("bigint")).otherwise(F.col("n"))
    )
    return ranked if max_vocab is None else top_tokens(ranked, max_vocab + 1)


def vocabulary_stats(vocab: DataFrame, num_labels: int) -> DataFrame:
    """One row: texts and tokens per class, tokens, bytes, and where the hot tier ends.

    ``hot_floor`` is the smallest count that at most the tier's limit of tokens
    exceed, 0 when all fit. Rows are grouped by count first: the running total
    then goes over distinct counts, of which there are few (see ``top_tokens``).
    """
    limit = min(HOT_TOKENS, HOT_WEIGHTS // num_labels)
    by_count = vocab.groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.octet_length("token")).alias("bytes"),
        F.count(F.when(F.length("token") > HOT_TOKEN_CHARS, 1)).alias("long"),
        *[F.sum(F.col("by_class")[c]).alias(f"c{c}") for c in range(num_labels)],
    )
    is_mark = F.col("n") == MARK_COUNT
    above = F.sum(F.when(is_mark, 0).otherwise(F.col("rows"))).over(Window.orderBy(F.desc("n")))
    ranked = by_count.withColumn("above", above - F.col("rows"))

    def per_class(which: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(which, F.col(f"c{c}"))), F.lit(0)) for c in range(num_labels)])

    size = F.sum(F.when(~is_mark, F.col("rows")))
    return ranked.agg(
        per_class(is_mark).alias("class_texts"),
        per_class(~is_mark).alias("class_tokens"),
        F.coalesce(size, F.lit(0)).alias("vocab_size"),
        F.sum("bytes").alias("token_bytes"),
        F.sum("long").alias("n_long"),
        F.when(size <= limit, F.lit(0)).otherwise(F.min(F.when(F.col("above") <= limit, F.col("n")))).alias("hot_floor"),
    )


def _micro(value: Column) -> Column:
    return F.rint(F.lit(float(MICRO)) * value).cast("bigint")


def bayes_weights(vocab: DataFrame, num_labels: int, stats: Row | None = None) -> DataFrame:
    """(token, n, w): add-one smoothed log likelihoods, and the log prior under the mark.

    The totals are a row of ``vocabulary_stats`` taken before, or else a scalar
    subquery; either way no row is joined to them.
    """
    if stats is None:
        totals = vocabulary_stats(vocab, num_labels).select(F.struct("*").alias("stats")).scalar()
        texts, words, size = (totals.getField(f) for f in ("class_texts", "class_tokens", "vocab_size"))
    else:
        texts, words, size = (F.lit(stats[f]) for f in ("class_texts", "class_tokens", "vocab_size"))
    classes = range(num_labels)
    all_texts = sum((texts[c] for c in classes[1:]), texts[0])
    likelihood = [_micro(F.log(F.col("by_class")[c] + 1.0) - F.log((words[c] + size).cast("double"))) for c in classes]
    absent = F.lit(ABSENT_CLASS).cast("bigint")
    prior = [F.when(texts[c] > 0, _micro(F.log(texts[c] / all_texts))).otherwise(absent) for c in classes]
    weight = F.when(F.col("token") == TEXT_MARK, F.array(*prior)).otherwise(F.array(*likelihood))
    return vocab.select("token", "n", weight.alias("w"))


@dataclass(frozen=True)
class BayesModel:
    """A fitted model: its folder, classes, whether any weight lies outside the hot tier, and its size."""

    path: str
    num_labels: int
    has_tail: bool
    size_bytes: int

    def weights(self, spark: SparkSession, tier: str | None = None) -> DataFrame:
        schema = "token string, n bigint, w array<bigint>, tier string"
        frame = spark.read.schema(schema).parquet(f"{self.path}/weights")
        return frame.where(F.col("tier") == tier).drop("tier") if tier else frame.drop("tier")


def fit_bayes(
    df: DataFrame,
    path: str,
    num_labels: int,
    text: str = "text",
    label: str = "label",
    max_vocab: int | None = None,
) -> BayesModel:
    """Fit on a labelled frame and write the model tables; ``text`` is a column of texts, or of ids."""
    return finish_bayes(fit_counts(df, num_labels, text, label), path, num_labels, max_vocab)


def fit_counts(df: DataFrame, num_labels: int, text: str = "text", label: str = "label") -> DataFrame:
    """What ``vocabulary`` sums up per token: rows that count one each, or counts per label.

    With few classes a row of per-class sums is built at once, combined map-side,
    in a single shuffle; texts are counted in chunks before, so that sums meet a token
    once a chunk. With many, wide sums per token and task would cost more than counting
    per (token, label) first.
    """
    if num_labels > WIDE_SUM_CLASSES:
        return token_counts(df, text, label)
    if isinstance(df.schema[text].dataType, T.ArrayType):
        return token_rows(df, text, label).withColumn("n", F.lit(1).cast("bigint"))
    number = F.col(label).cast("int")
    known = F.when(number.between(0, num_labels - 1), number).alias("label")
    rows = df.where(F.col(text).isNotNull()).select(F.lower(text).alias("text"), known)
    return rows.mapInArrow(_chunk_counts(num_labels), "token string, label int, n bigint")


def _chunk_counts(num_labels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(token, label, n) of every COUNTED_BYTES of lower-cased texts, the mark included; a null label counts as one class more."""
    names, width = ["token", "label", "n"], num_labels + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.string())
            classes = batch.column(1).fill_null(num_labels).to_numpy(zero_copy_only=False).astype(np.int64)
            for start, stop in cuts(texts, COUNTED_BYTES):
                coded, row = coded_tokens(texts.slice(start, stop - start))
                own = classes[start:stop]
                # The mark comes last, after the tokens; the empty token is none.
                tokens_found = pa.concat_arrays([coded.dictionary, pa.array([TEXT_MARK])])
                cells = coded.indices.to_numpy().astype(np.int64) * width + own[row]
                marks = np.bincount(own, minlength=width)
                counts = np.r_[np.bincount(cells, minlength=width * len(coded.dictionary)), marks]
                place = np.flatnonzero(counts)
                label = place % width
                columns = [
                    tokens_found.take(pa.array(place // width)),
                    pa.array(label, pa.int32(), mask=label == num_labels),
                    pa.array(counts[place], pa.int64()),
                ]
                found = pa.RecordBatch.from_arrays(columns, names)
                yield found.filter(pc.not_equal(found.column(0), ""))

    return count


def finish_bayes(counts: DataFrame, path: str, num_labels: int, max_vocab: int | None = None) -> BayesModel:
    """Turn (token, label, n) into the model tables."""
    counted = vocabulary(counts, num_labels)
    # A cutoff looks at all counts first: from a table, the texts are read once.
    return finish_counted(counted if max_vocab is None else written(counted, "counts"), path, num_labels, max_vocab)


def finish_counted(counted: DataFrame, path: str, num_labels: int, max_vocab: int | None = None) -> BayesModel:
    """Turn (token, n, by_class) of ``vocabulary`` into the model tables.

    The vocabulary goes to a table first: everything after reads that instead of
    the texts, and a lost executor costs no second pass over them.
    """
    spark = counted.sparkSession
    limited = counted if max_vocab is None else top_tokens(counted, max_vocab + 1)
    limited.write.mode("overwrite").parquet(f"{path}/vocab")
    vocab = spark.read.parquet(f"{path}/vocab")
    stats = vocabulary_stats(vocab, num_labels).first()
    is_hot = (F.col("n") > (stats["hot_floor"] or 0)) & (F.length("token") <= HOT_TOKEN_CHARS)
    tiered = bayes_weights(vocab, num_labels, stats).withColumn("tier", F.when(is_hot, "hot").otherwise("tail"))
    tiered.write.mode("overwrite").partitionBy("tier").parquet(f"{path}/weights")
    has_tail = bool(stats["hot_floor"] or stats["n_long"])
    size_bytes = (stats["token_bytes"] or 0) + 8 * num_labels * ((stats["vocab_size"] or 0) + 1)
    return BayesModel(path, num_labels, has_tail, size_bytes)


def fit_bayes_family(
    df: DataFrame, paths: Sequence[str], num_labels: int, max_vocabs: Sequence[int | None], text: str = "text", label: str = "label"
) -> list[BayesModel]:
    """One model per vocabulary limit, all from one table of counts: the texts are read once."""
    counted = vocabulary(fit_counts(df, num_labels, text, label), num_labels)
    if len(paths) > 1 or max_vocabs[0] is not None:  # a single whole vocabulary is the table of counts
        counted = written(counted, "counts")
    return [finish_counted(counted, path, num_labels, limit) for path, limit in zip(paths, max_vocabs)]


def family_weights(spark: SparkSession, models: Sequence[BayesModel]) -> DataFrame:
    """(token, w): the weights of several models side by side, zeros where a model lacks the token."""
    if len(models) == 1:
        return models[0].weights(spark).select("token", "w")
    k = models[0].num_labels
    parts = [m.weights(spark).select("token", F.lit(i).alias("model"), "w") for i, m in enumerate(models)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    nothing = F.array_repeat(F.lit(0).cast("bigint"), k)
    # A token has one row per model at most.
    own = [F.coalesce(F.any_value(F.when(F.col("model") == i, F.col("w")), True), nothing) for i in range(len(models))]
    return rows.groupBy("token").agg(F.concat(*own).alias("w"))


def load_bayes(spark: SparkSession, path: str) -> BayesModel:
    """A model written before, from its folder."""
    weights = BayesModel(path, 0, False, 0).weights(spark)
    num_labels = len(weights.where(F.col("token") == TEXT_MARK).first()["w"])
    sizes = spark.read.parquet(f"{path}/weights").agg(
        F.count(F.when(F.col("tier") == "tail", 1)).alias("n_tail"),
        F.sum(F.octet_length("token")).alias("token_bytes"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    return BayesModel(path, num_labels, sizes["n_tail"] > 0, sizes["token_bytes"] + 8 * num_labels * sizes["n"])


def bayes_logits(
    df: DataFrame, model: BayesModel, row_key: str, text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(row_key, *carry, logits): integer logits of every row, null for null texts.

    Exploded tokens meet the bounded hot tier in a broadcast join and are summed
    per row map-side, so what is shuffled is one row of sums per text. Only
    tokens outside the hot tier are shuffled, and those are rare by definition.
    Rows with equal ``row_key``, ``carry`` and text come out as one. ``carry`` names
    narrow columns to pass along, such as a label, or what tells rows apart that
    share a key.
    """
    spark, k = df.sparkSession, model.num_labels
    key = [row_key, *carry]
    rows = df.select(*key, F.col(text).alias("_text"))
    split = rows.select(*key, _marked(rows, "_text").alias("_tokens"))
    # A null text keeps one null token, which matches nothing and sums to null.
    places = split.select(*key, F.explode_outer("_tokens").alias("_token"))
    sums = [F.sum(F.col("_w")[c]).alias(f"_s{c}") for c in range(k)]
    # Each text has one mark: equal rows are as many as their marks.
    marks = F.count(F.when(F.col("_token") == TEXT_MARK, 1)).alias("_rows")

    hot = F.broadcast(_for_join(model.weights(spark, "hot")))
    totals = places.join(hot, "_token", "left").groupBy(*key).agg(marks, *sums)
    if model.has_tail:
        rare = places.join(hot.select("_token"), "_token", "left_anti")
        # No hint: Spark broadcasts the tail where its files are small, and shuffles otherwise.
        extra = rare.join(_for_join(model.weights(spark, "tail")), "_token").groupBy(*key).agg(marks, *sums)
        again = [F.sum(c).alias(c) for c in ("_rows", *[f"_s{c}" for c in range(k)])]
        totals = totals.unionByName(extra).groupBy(*key).agg(*again)
    logits = F.array(*[F.expr(f"_s{c} div greatest(_rows, 1)") for c in range(k)])
    return totals.select(*key, F.when(F.col("_s0").isNotNull(), logits).alias("logits"))


def _for_join(weights: DataFrame) -> DataFrame:
    """Weights under names no input column is expected to have."""
    return weights.select(F.col("token").alias("_token"), F.col("w").alias("_w"))


def micro_probabilities(logits: Column | str, decimals: int | None = None) -> Column:
    """``array<float>`` probabilities of integer logits, optionally rounded."""
    exact = softmax(logits, scale=MICRO).cast("array<float>")
    return exact if decimals is None else round_half_even(exact, decimals)


def score_bayes(
    df: DataFrame, model: BayesModel, row_key: str, text: str = "text", decimals: int | None = None
) -> DataFrame:
    """All input columns plus ``probabilities``, ``predicted_probability``, ``predicted_class``.

    Every row is kept, also where ``row_key`` is null or repeated.
    """
    content = F.xxhash64(text).alias("_content")
    logits = bayes_logits(df.select("*", content), model, row_key, text, carry=["_content"])
    scored = logits.select(
        F.col(row_key).alias("_key"),
        F.col("_content").alias("_scored"),
        micro_probabilities("logits", decimals).alias("probabilities"),
    )
    same = F.col(row_key).eqNullSafe(F.col("_key")) & (F.col("_content") == F.col("_scored"))
    return decode(df.select("*", content).join(scored, same).drop("_content", "_key", "_scored"))

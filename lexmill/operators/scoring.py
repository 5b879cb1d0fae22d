"""Score tables with batched Python models.

A *predictor* turns a feature column into a probability column:
``predictor(column, batch_size) -> Column``. ``batch_model`` builds one from any
user model; ``bayes_predictor`` and ``softmax_predictor`` do for fitted models.
Scoring is row-local: no shuffle unless a partition count is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexmill.functions import decode, round_half_even, stringify
from lexmill.functions.arrow import coded_tokens, cuts
from lexmill.operators.bayes import MICRO, TEXT_MARK, BayesModel, family_weights
from lexmill.operators.encode import Vocabulary, encoded_struct
from lexmill.operators.lookup import Lookup, publish
from lexmill.operators.prepare import repartition_for_scoring

Predictor = Callable[[Column, int], Column]
PROBABILITIES = T.ArrayType(T.FloatType())

MODES = ("batch", "udf")
KEEPS = ("all", "feature")
NULL_POLICIES = ("null", "literal")
# Decimals of probabilities in udf mode; batch mode leaves them as they are.
UDF_DECIMALS = 4

# Bytes of text a model looks at in one go, to bound a worker's memory.
CHARS_PER_CHUNK = 4_000_000


def batch_model(
    make_predict_fn: Callable, tensor_shape: list[int] | None = None, prepare: Callable[[Column], Column] | None = None
) -> Predictor:
    """A predictor from a user model.

    ``make_predict_fn()`` runs once per Python worker: load the model there and
    return ``predict(inputs) -> (n, k) array``. ``tensor_shape`` is for array
    features of fixed shape, ``prepare`` for a JVM-side expression in front.
    """

    def predictor(column: Column, batch_size: int) -> Column:
        udf = predict_batch_udf(
            make_predict_fn,
            return_type=PROBABILITIES,
            batch_size=batch_size,
            input_tensor_shapes=[tensor_shape] if tensor_shape else None,
        )
        return udf(prepare(column) if prepare else column)

    return predictor


def encoded_model(make_predict_fn: Callable, max_length: int) -> Predictor:
    """A predictor from a user model over structs of ``input_ids`` and ``attention_mask``.

    ``make_predict_fn()`` returns ``predict(input_ids, attention_mask) -> (n, k) array``,
    both inputs being (n, max_length) arrays.
    """

    def predictor(column: Column, batch_size: int) -> Column:
        udf = predict_batch_udf(
            make_predict_fn,
            return_type=PROBABILITIES,
            batch_size=batch_size,
            input_tensor_shapes=[[max_length], [max_length]],
        )
        return udf(column["input_ids"], column["attention_mask"])

    return predictor


def encoding_predictor(spark: SparkSession, vocab: Vocabulary, model: Predictor, max_length: int) -> Predictor:
    """A predictor of texts that encodes them itself and hands the pairs of arrays to ``model``."""
    return lambda column, batch_size: model(encoded_struct(spark, column, vocab, max_length), batch_size)


def empty_encoding(max_length: int) -> Column:
    """What a model over encoded texts sees in place of a null."""
    zeros = F.array_repeat(F.lit(0), max_length)
    return F.struct(zeros.alias("input_ids"), zeros.alias("attention_mask"))


def predict_column(
    feature: Column | str,
    predictor: Predictor,
    batch_size: int = 1000,
    null_policy: str = "null",
    decimals: int | None = None,
    empty: Column | None = None,
) -> Column:
    """``array<float>`` probabilities of a feature column.

    Null features give null, or are scored as the text ``None`` with
    ``null_policy='literal'``. Python models see ``empty`` in their place, as
    Python evaluation cannot be skipped for single rows.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}, got {null_policy!r}")
    column = F.col(feature) if isinstance(feature, str) else feature
    if null_policy == "literal":
        result = predictor(stringify(column), batch_size)
    else:
        stand_in = F.lit("") if empty is None else empty
        result = F.when(column.isNotNull(), predictor(F.coalesce(column, stand_in), batch_size))
    return result if decimals is None else round_half_even(result, decimals)


def score(
    df: DataFrame,
    predictor: Predictor,
    feature_col: str = "text",
    mode: str = "batch",
    batch_size: int = 1000,
    partitions: int | None = None,
    keep: str | None = None,
    decimals: int | None = None,
    null_policy: str = "null",
    empty: Column | None = None,
) -> DataFrame:
    """Append ``probabilities``, ``predicted_probability`` and ``predicted_class``.

    ``mode='batch'`` keeps all columns and unrounded probabilities, ``mode='udf'``
    keeps the feature column and rounds to 4 decimals before decoding; ``keep``
    and ``decimals`` override either.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    keep = keep or ("all" if mode == "batch" else "feature")
    if keep not in KEEPS:
        raise ValueError(f"keep must be one of {KEEPS}, got {keep!r}")
    if decimals is None and mode == "udf":
        decimals = UDF_DECIMALS
    source = df if keep == "all" else df.select(feature_col)
    source = repartition_for_scoring(source, partitions)
    probabilities = predict_column(feature_col, predictor, batch_size, null_policy, decimals, empty)
    return decode(source.withColumn("probabilities", probabilities))


def bayes_predictor(spark: SparkSession, model: BayesModel) -> Predictor:
    """A predictor from a fitted count-based model of any size.

    The weights are published as files that workers search in place; a batch
    holds the weights of its own distinct tokens, and nothing is shuffled.
    """
    shared = publish(model.weights(spark), "token", "w", model.num_labels, "model")

    def predictor(column: Column, batch_size: int) -> Column:
        @F.arrow_udf(PROBABILITIES)
        def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weights = shared.open()
            prior = weights.find([TEXT_MARK])[0][0].astype(np.float64)
            for texts in batches:
                logits = _chunked_sums(texts, weights, prior, batch_size)
                flat = stable_softmax(logits / MICRO).astype(np.float32).ravel()
                yield pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(prior), pa.array(flat))

        return predict(F.lower(column))

    return predictor


def bayes_encoded_predictor(spark: SparkSession, model: BayesModel, max_length: int) -> Predictor:
    """A predictor over encoded texts from a model of any size that was fitted on their used ids."""
    shared = publish(model.weights(spark), "token", "w", model.num_labels, "model")

    def make_predict_fn():
        weights = shared.open()
        prior = weights.find([TEXT_MARK])[0][0].astype(np.float64)

        def predict(input_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray:
            row, place = np.nonzero(attention_mask == 1)
            ids, which = np.unique(input_ids[row, place].astype(np.int64), return_inverse=True)
            found, _ = weights.find([str(i) for i in ids])
            logits = _row_sums(found, which, row, len(input_ids)) + prior
            return stable_softmax(logits / MICRO).astype(np.float32)

        return predict

    return encoded_model(make_predict_fn, max_length)


def bayes_family_logits(spark: SparkSession, models: Sequence[BayesModel], text: Column | str = "text") -> Column:
    """An array with the integer logits of each model in turn, null for null texts; texts are taken apart once for all."""
    width = models[0].num_labels * len(models)
    shared = publish(family_weights(spark, models), "token", "w", width, "models")

    @F.arrow_udf("array<bigint>")
    def logits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = shared.open()
        prior = weights.find([TEXT_MARK])[0][0].astype(np.float64)
        for column in batches:
            sums = _chunked_sums(column.fill_null(""), weights, prior).astype(np.int64)
            offsets = pa.array(np.arange(len(column) + 1, dtype=np.int32) * width)
            yield pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()), mask=column.is_null())

    return logits(F.lower(text))


def _chunked_sums(texts: pa.Array, weights: Lookup, prior: np.ndarray, most: int | None = None) -> np.ndarray:
    """``_logit_sums`` of all texts, of CHARS_PER_CHUNK bytes (or one text) and ``most`` rows at a time."""
    texts = texts.cast(pa.string())
    parts = [_logit_sums(texts.slice(a, b - a), weights, prior) for a, b in cuts(texts, CHARS_PER_CHUNK, most)]
    return np.vstack(parts) if parts else np.zeros((0, len(prior)))


def _logit_sums(texts: pa.StringArray, weights: Lookup, prior: np.ndarray) -> np.ndarray:
    """Sums of the weights of each lower-cased text's tokens, and the prior."""
    coded, row = coded_tokens(texts)  # empty tokens have no weight
    found, _ = weights.find(coded.dictionary.to_numpy(zero_copy_only=False))
    return _row_sums(found, coded.indices.to_numpy(), row, len(texts)) + prior


def _row_sums(weights: np.ndarray, which: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, k) sums over each row's tokens, ``which`` of ``weights``: of integers far below 2**53, so exact in any order."""
    return np.column_stack([np.bincount(row, weights=of_class[which], minlength=n) for of_class in weights.T.astype(np.float64, "C")])


def stable_softmax(logits: np.ndarray) -> np.ndarray:
    """Row-wise softmax, shifted by the row maximum."""
    parts = np.exp(logits - logits.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)

"""Column expressions over per-class arrays: softmax, rounding, decoding.

All of these stay in the JVM and touch one row at a time, so they never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted_exp(logits: Column, scale: float) -> Column:
    # zip_with against a repeated maximum evaluates the maximum once per row;
    # array_max inside the lambda would evaluate it once per element.
    top = F.array_repeat(F.array_max(logits), F.size(logits))
    return F.zip_with(logits, top, lambda x, m: F.exp((x - m) / F.lit(scale)))


def _total(values: Column) -> Column:
    """Sum in array order."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column | str, scale: float = 1.0) -> Column:
    """``array<double>`` probabilities of ``logits / scale``, shifted by the maximum.

    The denominator is summed in class order, so the result does not depend on
    partitioning.
    """

    def normalised(parts: Column) -> Column:
        return F.zip_with(parts, F.array_repeat(_total(parts), F.size(parts)), lambda x, s: x / s)

    return _let(_shifted_exp(_col(logits), float(scale)), normalised)


def negative_log_likelihood(logits: Column | str, label: Column | str, scale: float = 1.0) -> Column:
    """``-ln p[label]`` as a log-sum-exp, finite even where the probability underflows."""
    values, target = _col(logits), _col(label)
    own = F.get(values, target.cast("int"))
    return F.log(_total(_shifted_exp(values, float(scale)))) - (own - F.array_max(values)) / F.lit(float(scale))


def round_half_even(values: Column | str, decimals: int = 4) -> Column:
    """Round each element to ``decimals`` places in float32, ties to even.

    Elements are cast to float first: the scaled product has to be a float32
    product for ties to fall where float32 rounding puts them.
    """
    factor = F.lit(float(10**decimals)).cast("float")
    return F.transform(_col(values), lambda x: (F.rint(x.cast("float") * factor) / factor).cast("float"))


def predicted_probability(probabilities: Column | str) -> Column:
    """Highest probability; null for null or empty arrays, nulls inside are skipped."""
    return F.array_max(_col(probabilities))


def predicted_class(probabilities: Column | str) -> Column:
    """0-based position of the highest probability (bigint); ties go to the lowest class."""
    values = _col(probabilities)
    return F.array_position(values, F.array_max(values)) - F.lit(1)


def argmax(values: Column | str) -> Column:
    """First position of the maximum of any numeric array (logits included)."""
    return predicted_class(values)


def decode(df: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Append ``predicted_probability`` and ``predicted_class`` to all columns.

    Chained, so the second expression reads the first one's column and a Python
    model feeding ``probabilities`` is planned once.
    """
    highest = df.withColumn("predicted_probability", F.array_max(F.col(probabilities)))
    place = F.array_position(F.col(probabilities), F.col("predicted_probability"))
    return highest.withColumn("predicted_class", place - F.lit(1))

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexmill.functions import (
    class_index,
    decode,
    drop_last_segment,
    last_segment,
    negative_log_likelihood,
    normalized_text,
    rewrite_mount_prefix,
    round_half_even,
    softmax,
    stringify,
    tokens,
)

NAN = float("nan")


def decoded(spark, arrays):
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, probabilities array<float>")
    return [
        (r["predicted_probability"], r["predicted_class"]) for r in decode(frame).orderBy("i").collect()
    ]


def test_decode_edge_cases(spark):
    got = decoded(spark, [[0.2, 0.5, 0.3], [0.4, 0.4, 0.2], [], None, [None, 0.3], [None]])
    want = [(0.5, 1), (0.4, 0), (None, None), (None, None), (0.3, 1), (None, None)]
    for (p, c), (wp, wc) in zip(got, want):
        assert c == wc
        assert p is None if wp is None else p == pytest.approx(wp)


def test_decode_treats_nan_as_largest(spark):
    (p, c), = decoded(spark, [[NAN, 0.9]])
    assert math.isnan(p) and c == 0


def test_decode_types(spark):
    frame = decode(spark.createDataFrame([([0.5, 0.5],)], "probabilities array<float>"))
    assert dict(frame.dtypes)["predicted_probability"] == "float"
    assert dict(frame.dtypes)["predicted_class"] == "bigint"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 0.1, 0.25, 0.5])), max_size=6), min_size=1, max_size=20))
def test_decode_is_first_maximum(spark, arrays):
    for values, (p, c) in zip(arrays, decoded(spark, arrays)):
        known = [v for v in values if v is not None]
        if not known:
            assert (p, c) == (None, None)
        else:
            assert c == values.index(max(known)) and p == pytest.approx(max(known))


def test_rounding_equals_numpy_float32(spark):
    values = (np.arange(20001, dtype=np.float32) / np.float32(20000)).astype(np.float32)
    frame = spark.createDataFrame([(values.tolist(),)], "p array<float>")
    got = np.array(frame.select(round_half_even("p")).first()[0], dtype=np.float32)
    assert np.array_equal(got, np.around(values, decimals=4))


def test_softmax_is_stable_and_ordered(spark):
    frame = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([0.0],), (None,)], "l array<double>")
    got = [r[0] for r in frame.select(softmax("l")).collect()]
    assert got == [[0.5, 0.5, 0.0], [1.0], None]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=8))
def test_softmax_equals_numpy(spark, logits):
    frame = spark.createDataFrame([(logits,)], "l array<double>")
    shifted = np.exp(np.array(logits) - max(logits))
    assert np.allclose(frame.select(softmax("l")).first()[0], shifted / shifted.sum(), atol=1e-12)


def test_negative_log_likelihood_stays_finite(spark):
    frame = spark.createDataFrame([([0.0, 5000.0], 0), ([1.0, 1.0], 1)], "l array<double>, label int")
    got = [r[0] for r in frame.select(negative_log_likelihood("l", "label")).collect()]
    assert got[0] == pytest.approx(5000.0) and got[1] == pytest.approx(math.log(2))


def test_tokens(spark):
    texts = [None, "", " \t\n ", "One", "a\tB\n\nc\r\nd ", "Été ÇA"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in frame.select(tokens("t")).collect()]
    assert got == [None, [], [], ["one"], ["a", "b", "c", "d"], ["été", "ça"]]
    assert frame.select(normalized_text("t")).collect()[4][0] == "a b c d"


def test_paths(spark):
    frame = spark.createDataFrame([("dbfs:/a/b/c",), ("s3://x/y",), ("name",)], "p string")
    got = frame.select(rewrite_mount_prefix("p"), drop_last_segment("p"), last_segment("p")).collect()
    assert [tuple(r) for r in got] == [
        ("/dbfs/a/b/c", "dbfs:/a/b", "c"),
        ("s3://x/y", "s3://x", "y"),
        ("name", "", "name"),
    ]


def test_stringify_and_class_index(spark):
    frame = spark.createDataFrame([(1, "b"), (None, "z"), (3, None)], "n int, c string")
    got = frame.select(stringify("n"), class_index("c", ["a", "b"])).collect()
    assert [tuple(r) for r in got] == [("1", 1), ("None", None), ("3", None)]
    assert frame.select(class_index("c", ["a", "b"]).alias("c")).dtypes == [("c", "int")]


def test_softmax_probabilities_sum_to_one(spark):
    frame = spark.range(50).select(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.sin(i * F.col("id"))).alias("l"))
    sums = [sum(r[0]) for r in frame.select(softmax("l")).collect()]
    assert max(abs(s - 1) for s in sums) < 1e-12

"""Published tables against plain dictionaries."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import tokens
from lexmill.operators import encode, lookup
from lexmill.operators.scoring import bayes_predictor, score


@pytest.fixture(scope="module")
def numbers(spark):
    rows = spark.range(150_000).select(F.concat(F.lit("k"), "id").alias("key"), F.array("id", F.col("id") * 2).alias("v"))
    return lookup.publish(rows.unionByName(spark.createDataFrame([(None, [1, 2]), ("", [3, 4]), ("é\x00", [5, 6])], "key string, v array<bigint>")), "key", "v", 2)


def test_every_key_is_found_and_no_other(numbers):
    table = numbers.open()
    assert table is numbers.open()
    keys = [f"k{i}" for i in range(0, 160_000, 7)] + ["", "é\x00", "K1"]
    values, found = table.find(keys)
    known = np.arange(0, 160_000, 7)
    assert (found[:-3] == (known < 150_000)).all() and found[-3:].tolist() == [True, True, False]
    assert (values[:-3, 0] == np.where(known < 150_000, known, 0)).all()
    assert values[-3:].tolist() == [[3, 4], [5, 6], [0, 0]]
    assert len(numbers.firsts) > 1 and (np.diff(numbers.firsts) > 0).all()


def test_nothing_is_found_in_nothing(spark):
    nothing = lookup.publish(spark.createDataFrame([], "key string, v array<int>"), "key", "v", 1)
    values, found = nothing.open().find(["a", "b"])
    assert not found.any() and not values.any()
    assert nothing.open().find([])[0].shape == (0, 1)


def test_hash_is_that_of_the_session(spark):
    words = ["", "a", "é", "long " * 50, "\x00"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] for r in got] == [lookup.key_hash(w) for w in words]


def test_many_keys_are_hashed_at_once(numbers, monkeypatch):
    """The same hashes as one by one, and no call for each key but for the long ones."""
    words = ["aé€😀z"[i % 5] * (i % 40) + str(i) for i in range(2_000)] + ["", "\x00", "x" * 31, "x" * 32]
    column = pa.array(["in front", *words]).slice(1)
    one_by_one = lookup.key_hash
    asked = []
    monkeypatch.setattr(lookup, "key_hash", lambda key: asked.append(key) or one_by_one(key))
    assert lookup.key_hashes(column).tolist() == [one_by_one(w) for w in words]
    assert asked == [w for w in words if len(w.encode()) >= 32]
    asked.clear()
    values, found = numbers.open().find([f"k{i}" for i in range(149_000, 151_000)])
    assert not asked and found.tolist() == [True] * 1_000 + [False] * 1_000
    assert values[:1_000].tolist() == [[i, 2 * i] for i in range(149_000, 150_000)]


def test_many_keys_of_one_hash_are_told_apart(tmp_path, monkeypatch):
    schema = pa.schema([("hash", pa.int64()), ("key", pa.string()), ("values", pa.list_(pa.int64(), 1))])
    name, keys = str(tmp_path / "a.arrow"), [f"k{i:03d}" for i in range(400)]
    with pa.OSFile(name, "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for start in range(0, 400, 100):
            part = range(start, start + 100)
            fixed = pa.FixedSizeListArray.from_arrays(pa.array(list(part), pa.int64()), 1)
            hashes = pa.array([i // 150 for i in part], pa.int64())
            writer.write_batch(pa.RecordBatch.from_arrays([hashes, pa.array(keys[start : start + 100]), fixed], schema=schema))
    shared = lookup.SharedLookup(str(tmp_path), 1, (name,), np.array([0, 0, 1, 2]), np.zeros(4, int), np.arange(4))
    monkeypatch.setattr(lookup, "key_hashes", lambda asked: np.array([int(k.as_py()[1:]) // 150 for k in asked]))
    values, found = lookup.Lookup(shared).find([*keys[::-1], "k0001", "k9999"])
    assert values[:400].ravel().tolist() == list(range(399, -1, -1)) and found.tolist() == [True] * 400 + [False] * 2


def test_keys_of_one_hash_are_told_apart_across_blocks(tmp_path, monkeypatch):
    """Rows of one hash that fill blocks: the walk goes on through them."""
    schema = pa.schema([("hash", pa.int64()), ("key", pa.string()), ("values", pa.list_(pa.int64(), 1))])
    name = str(tmp_path / "a.arrow")
    blocks = [[(1, "a", 10), (5, "b", 11)], [(5, "c", 12), (5, "d", 13)], [(5, "e", 14), (9, "f", 15)]]
    with pa.OSFile(name, "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for rows in blocks:
            hashes, keys, values = zip(*rows)
            fixed = pa.FixedSizeListArray.from_arrays(pa.array(values, pa.int64()), 1)
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(keys), fixed], schema=schema))
    firsts = np.array([rows[0][0] for rows in blocks])
    shared = lookup.SharedLookup(str(tmp_path), 1, (name,), firsts, np.zeros(3, int), np.arange(3))
    hashes = {k: h for rows in blocks for h, k, _ in rows} | {"x": 5, "y": 0, "z": 7, "w": 10}
    monkeypatch.setattr(lookup, "key_hash", hashes.get)
    values, found = lookup.Lookup(shared).find(list("fedcbaxyzw"))
    assert values.ravel().tolist() == [15, 14, 13, 12, 11, 10, 0, 0, 0, 0]
    assert found.tolist() == [True] * 6 + [False] * 4


def test_whole_vocabulary_is_ranked_and_published(spark, docs):
    whole = encode.build_vocab(docs, size=None)
    cut = encode.build_vocab(docs, size=10**6)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    published = encode.encode_batched(docs, encode.publish_vocab(whole), max_length=12)
    listed = encode.encode_batched(docs, encode.load_vocab(cut), max_length=12)
    pick = ["doc_id", "input_ids", "attention_mask"]
    assert sorted(map(str, published.select(pick).collect())) == sorted(map(str, listed.select(pick).collect()))


def test_a_model_is_neither_collected_nor_broadcast(spark, docs, model):
    """What a task is sent of a model is a few numbers per block, and no row moves."""
    predictor = bayes_predictor(spark, model)
    plan = score(docs, predictor)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1
    shared = lookup.publish(model.weights(spark), "token", "w", 4)
    assert len(shared.firsts) <= 1 + model.weights(spark).count() // 1_000
    words = docs.select(F.explode(tokens("text")).alias("t")).distinct().limit(500).collect()
    mine = {r["token"]: r["w"] for r in model.weights(spark).collect()}
    values, found = shared.open().find([w["t"] for w in words])
    for word, row, known in zip(words, values, found):
        assert known == (word["t"] in mine) and (not known or row.tolist() == mine[word["t"]])


def test_a_store_that_python_cannot_open_is_named(spark, docs, model):
    with pytest.raises(RuntimeError, match=lookup.FOLDER_SETTING):
        lookup.file_system("viewfs://store/in")

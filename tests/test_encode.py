import pytest

from lexmill.operators import encode


@pytest.fixture(scope="module")
def small(spark):
    texts = [None, "", " \n ", "a", "a b c", "a b c d", "a b c d e", "zzz a", "B\tA"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([("a", 9, 4), ("b", 8, 5), ("c", 7, 6), ("d", 6, 7), ("e", 1, 8)], "token string, n bigint, id int")


WANT = {
    0: (None, None),
    1: ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]),
    2: ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0]),
    3: ([2, 4, 3, 0, 0, 0], [1, 1, 1, 0, 0, 0]),
    4: ([2, 4, 5, 6, 3, 0], [1, 1, 1, 1, 1, 0]),
    5: ([2, 4, 5, 6, 7, 3], [1] * 6),
    6: ([2, 4, 5, 6, 7, 3], [1] * 6),
    7: ([2, 1, 4, 3, 0, 0], [1, 1, 1, 1, 0, 0]),
    8: ([2, 5, 4, 3, 0, 0], [1, 1, 1, 1, 0, 0]),
}


def rows(frame, key="id"):
    return {r[key]: (r["input_ids"], r["attention_mask"]) for r in frame.collect()}


def test_encode_by_join(small, vocab):
    assert rows(encode.encode(small, vocab, "id", max_length=6)) == WANT


def test_encode_by_lookup(small, vocab):
    assert rows(encode.encode_batched(small, encode.load_vocab(vocab), max_length=6)) == WANT


def test_both_ways_agree_on_documents(docs):
    vocab = encode.build_vocab(docs, size=500)
    joined = rows(encode.encode(docs, vocab, "doc_id"), "doc_id")
    looked_up = rows(encode.encode_batched(docs, encode.load_vocab(vocab)), "doc_id")
    assert joined == looked_up
    assert all(len(ids) == len(mask) == 40 for ids, mask in joined.values())


def test_shortest_lengths(small, vocab):
    got = rows(encode.encode(small, vocab, "id", max_length=2))
    assert got[6] == ([2, 3], [1, 1])
    with pytest.raises(ValueError):
        encode.resolve_max_length(1)


def test_max_length_sentinel():
    with pytest.raises(ValueError, match="maximum"):
        encode.resolve_max_length(-1)
    assert encode.resolve_max_length(-1, model_max_length=512) == 512
    assert encode.resolve_max_length(40) == 40


def test_vocab_ties_and_cutoff(spark):
    frame = spark.createDataFrame([("x y z y x w w q",)], "text string")
    got = [(r["token"], r["id"]) for r in encode.build_vocab(frame, size=4).orderBy("id").collect()]
    assert got == [("w", 4), ("x", 5), ("y", 6), ("q", 7)]
    assert encode.build_vocab(frame, size=100).count() == 5


@pytest.mark.parametrize("size", [1, 7, 50, 5000])
def test_top_tokens_equals_plain_sort(docs, size):
    totals = encode.token_totals(docs)
    want = sorted(((r["n"], r["token"]) for r in totals.collect()), key=lambda t: (-t[0], t[1].encode()))[:size]
    got = {(r["n"], r["token"]) for r in encode.top_tokens(totals, size).collect()}
    assert got == set(want)


def test_loaded_vocabulary_is_bounded_a_joined_one_is_not(docs, monkeypatch):
    with pytest.raises(ValueError):
        encode.build_vocab(docs, size=0)
    whole = encode.build_vocab(docs, size=2 * encode.MAX_VOCAB)
    assert whole.count() == encode.token_totals(docs).count()
    monkeypatch.setattr(encode, "MAX_VOCAB", 10)
    with pytest.raises(ValueError):
        encode.load_vocab(whole)


def test_rows_with_null_and_repeated_keys_stay(spark):
    rows = [(1, "a b"), (1, "c"), (None, "a"), (None, None), (2, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 9, 4), ("b", 8, 5), ("c", 7, 6)], "token string, n long, id int")
    got = encode.encode(frame, vocab, "doc_id", max_length=4).collect()
    want = [(1, [2, 4, 5, 3]), (1, [2, 6, 3, 0]), (None, [2, 4, 3, 0]), (None, None), (2, [2, 3, 0, 0])]
    assert sorted(map(str, ((r["doc_id"], r["input_ids"]) for r in got))) == sorted(map(str, want))

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.operators import lookup, scoring
from lexmill.operators.bayes import score_bayes


def _mapped(files):
    with open("/proc/self/maps") as lines:
        return {line.split()[-1] for line in lines} & set(files)


def test_a_worker_maps_one_file_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "shared_dir", lambda _: str(tmp_path))
    frame = spark.range(2_000).select(F.concat(F.lit("w"), "id").alias("key"), F.array(F.col("id"), -F.col("id")).alias("v"))
    spread = frame.repartitionByRange(7, "key")
    shared = lookup.publish(spread, "key", "v", 2)
    opened = lookup.Lookup(shared)
    keys = [f"w{i}" for i in range(0, 3_000, 3)]
    for _ in range(2):
        values, found = opened.find(keys)
        assert found.tolist() == [i < 2_000 for i in range(0, 3_000, 3)]
        assert values[found].tolist() == [[i, -i] for i in range(0, 2_000, 3)]
        assert len(_mapped(shared.files)) <= 1


def test_sums_go_by_rows_and_bytes(monkeypatch):
    class Weights:
        most = 0

        def find(self, keys):
            Weights.most = max(Weights.most, len(keys))
            return np.array([[len(k), 1 if k else 0] for k in keys], np.int64).reshape(-1, 2), np.ones(len(keys), bool)

    texts = ["", "a bb\tccc\n\r d", " é  é ", "x" * 90, "", "a b c d e f"] * 5
    want = [[sum(map(len, t.split())), len(t.split())] for t in texts]
    for size, rows in ((10**6, None), (8, None), (10**6, 4), (1, 1)):
        monkeypatch.setattr(scoring, "CHARS_PER_CHUNK", size)
        for column in (pa.array(texts), pa.array(["z z", *texts]).slice(1), pa.array(texts, pa.large_string())):
            got = scoring._chunked_sums(column, Weights(), np.zeros(2), rows)
            assert got.tolist() == want
    assert scoring._chunked_sums(pa.array([], pa.string()), Weights(), np.zeros(2)).shape == (0, 2)


def test_predictor_agrees_with_the_join_on_odd_blanks(spark, model):
    texts = [None, "", " ", "\t\n", "Der\tHund\r\nund  die KATZE ", "the cat\x0bthe cat", "İstanbul ÉTÉ été", " the  the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = scoring.score(rows, scoring.bayes_predictor(spark, model), batch_size=3).select("id", "probabilities")
    want = score_bayes(rows, model, "id").select("id", "probabilities")
    both = got.join(want.withColumnRenamed("probabilities", "other"), "id").collect()
    assert len(both) == len(texts)
    for r in both:
        assert (r["probabilities"] is None) == (r["other"] is None)
        assert r["other"] is None or np.allclose(r["probabilities"], r["other"], atol=1e-6)

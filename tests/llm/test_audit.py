"""The filter audit against applying every order one filter after the other."""

import re
from collections import defaultdict
from itertools import permutations

import pytest
import reference as ref

from lexmill.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    text = text or ""
    words = ref.words(text)
    upper = sum("A" <= c <= "Z" for c in text)
    found = {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * upper > 5 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
    }
    return {f for f, bad in found.items() if bad}


def expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for _, i, text in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    parts = defaultdict(list)
    for source, i, text in rows:
        copy = i is not None and least[text or ""] < i
        parts[source or ""].append((i, fails(text) | ({"E"} if copy else set())))
    out = []
    for part, docs in parts.items():
        mine, removed_by = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                bad = [d for d in docs if f in d[1]]
                removed_by[f] += len(gone)
                mine.append([
                    part, "".join(order), step, len(left), len(gone), len(bad) - len(gone), sum(d[1] == {f} for d in bad),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ])
        out += [(*row, removed_by[row[1][row[2] - 1]]) for row in mine]
    return sorted(out)


def check(docs, labels):
    rows = [(r["source"], r["doc_id"], r["text"]) for r in docs.select("source", "doc_id", "text").collect()]
    got = audit.interactions(docs, labels).collect()
    assert sorted(map(tuple, got)) == expected(rows, [tuple(r) for r in labels.collect()])
    return got


def test_whole_sample(spark, sample):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic")
    assert len(check(sample, labels)) == 600 * sample.select("source").distinct().count()


def test_edge_rows(spark, edge):
    marks = [(1, 1, 0), (1, 0, 1), (3, None, 1), (None, 1, 1), (5, 1, None), (99, 1, 1), (12, 0, 1)]
    check(edge, spark.createDataFrame(marks, LABELS))


def test_ties_bounds_and_nulls(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [
        (None, 1, words), ("", 2, words), ("", 2, words), ("a", 2, words), ("a", None, words), ("a", 3, words),
        ("a", 4, " ".join(["x"] * 50)), ("b", 5, None), ("b", 6, ""), ("b", None, None), ("b", 7, "A" + "b" * 19), ("b", 8, "A" + "b" * 18),
        ("b", 9, "$ " + words), ("b", -1, " ".join(f"w{i % 33}" for i in range(51))), ("b", 10, " ".join(f"w{i % 13}" for i in range(20))),
    ]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").selectExpr("*", "1 as mask", "'q' as digest", "2 as n")
    check(docs, spark.createDataFrame([(2, 1, 1), (9, 1, 0), (9, 1, 0)], LABELS))


def test_nothing(spark, no_docs, no_labels, sample):
    assert audit.interactions(no_docs, no_labels).collect() == []
    check(sample.limit(40), no_labels)


@pytest.mark.parametrize("filters", [0, 1, 3, 5])
def test_walk_equals_each_subset_on_its_own(filters):
    counts = {m: (m * 7 % 11 + 1, m % 3, m % 2) for m in range(1 << filters) if m % 5 != 4}
    states = audit.survivors(counts, filters)
    for subset, state in enumerate(states):
        left = [c for m, c in counts.items() if not m & subset]
        assert state == [sum(column) for column in zip(*left)] or (not left and state == [0, 0, 0])

"""The Merkle manifest against hashing one list after the other."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def climb(level, fan_out):
    """The top of a list of digests, and for each its siblings level by level as (before, after)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        runs = [level[i : i + fan_out] for i in range(0, len(level), fan_out)]
        for k, place in enumerate(at):
            run, slot = runs[place // fan_out], place % fan_out
            paths[k].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[k] = place // fan_out
        level = [h(*run) for run in runs]
    return level[0], paths


def expected(rows, fan_out=3):
    sources = defaultdict(list)
    for row in rows:
        even = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
        cut = row["text"].replace("\n", "") if even and row["text"] is not None else row["text"]
        sources[row["source"]].append((row["doc_id"], leaf(row, row["text"]), leaf(row, cut)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in names:
        sources[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        tops[s] = climb([x[1] for x in sources[s]], fan_out)
    root, upper = climb([tops[s][0] for s in names], fan_out)
    out = []
    for s, above in zip(names, upper):
        for (i, own, cut), path in zip(sources[s], tops[s][1]):
            way, at = path + above, cut
            for before, after in way:
                at = h(before, at, after)
            out.append((i, own, tops[s][0], root, h(*[b + a for b, a in way]), at, at == root))
    return sorted(out, key=repr)


def check(df):
    got = sorted(map(tuple, manifest.tamper_check(df).collect()), key=repr)
    assert got == expected([r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    return got


def test_whole_sample(sample):
    got = check(sample)
    assert {r[-1] for r in got} == {True, False}


def test_edge_rows(edge):
    check(edge)


def test_sources_of_every_size(spark):
    rows = []
    for size, source in [(1, None), (1, ""), (2, "b"), (3, "ä"), (4, "B"), (9, "z"), (10, "="), (28, "long"), (1, "one")]:
        rows += [(len(rows) * 7 % 101 + 1000 * size, f"t{i}\n" * (i % 3), None if i % 2 else "en", source, None if i % 5 else i) for i in range(size)]
    rows += [(None, None, None, "z", None), (None, "x\n", None, "z", None), (5, "p\n", "en", "z", 1), (5, "q", "en", "z", 1), (5, "q", "en", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    check(df.selectExpr("*", "'t' as tree", "1 as n", "1 as place", "'x' as leaf", "'r' as root", "'p' as path", "0 as up"))


def test_one_record_and_one_source(spark, no_docs):
    one = spark.createDataFrame([(1, "a\nb", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = check(one)
    assert row[1] == row[2] == row[3] and row[4] == h("")
    check(one.unionAll(one).unionAll(one.withColumn("doc_id", F.lit(2))))
    assert manifest.tamper_check(no_docs).collect() == []


def test_repeated_rows_of_a_hot_source(spark):
    rows = spark.range(2_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 10 < 9, "hot").otherwise((F.col("id") % 50).cast("string")).alias("source"), F.lit(4).cast("bigint").alias("n_chars"),
    )
    check(rows.repartition(7))


@pytest.mark.parametrize("fan_out", [2, 4])
def test_other_fan_outs_lead_to_the_root(spark, sample, fan_out):
    rows = manifest.manifest(sample, fan_out=fan_out)
    tops = expected([r.asDict() for r in sample.collect()], fan_out)
    assert {r["root"] for r in rows.select("root").distinct().collect()} == {tops[0][3]}
    folded = manifest.fold(F.col("leaf"), F.col("path"))
    assert rows.where(folded != F.col("root")).count() == 0
    with pytest.raises(ValueError):
        manifest.manifest(sample, fan_out=1)

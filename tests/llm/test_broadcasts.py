"""What joins send to the driver: nothing that Spark may take for smaller than it is."""

import pytest

import corpus_pipeline
from lexmill.llm import shared, simhash, substrings

DATA = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def broadcasts(text):
    """What each broadcast of a plan is made of, as its next lines."""
    lines = text.splitlines()
    return ["\n".join(lines[i + 1 : i + 3]) for i, line in enumerate(lines) if "BroadcastExchange" in line]


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that the operators write, by label."""
    found = {}

    def kept(df, label):
        found.setdefault(label, []).append(plan(df))
        return shared.kept(df, label)

    monkeypatch.setattr(simhash, "kept", kept)
    return found


def test_near_dedup_broadcasts_nothing_that_grows(sample, plans):
    last = plan(simhash.near_duplicates(sample))
    assert {"links", "stars-large", "stars-small", "prints-rooted"} <= plans.keys()
    for text in [last, *sum(plans.values(), [])]:
        assert "Broadcast" not in text
    assert all("SortMergeJoin" in text for text in [last, *plans["links"], *plans["prints-rooted"]])


def test_masked_fingerprints_are_not_broadcast(spark):
    """A file of 2,000 fingerprints is below the limit, the 62,000 rows that they become are far above."""
    wide = [((i * 0x9E3779B97F4A7C15) & (2**63 - 1),) for i in range(1, 1_999)]
    rows = shared.kept(spark.createDataFrame([*wide, (6,), (7,)], "fingerprint long"), "prints")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "100k")
    try:
        found = simhash.links(rows)
        assert [tuple(r) for r in found.collect()] == [(7, 6)]
        assert "Broadcast" not in plan(found)
    finally:
        spark.conf.set(limit, before)


def test_pipeline_broadcasts_frequent_keys_only(spark, sample, monkeypatch):
    """Of the two deduplicating stages: landmarks are exploded, cut texts are larger than their files."""
    found = []

    def kept(df, label):
        found.append(plan(df))
        return shared.kept(df, label)

    for module in (simhash, substrings):
        monkeypatch.setattr(module, "kept", kept)
    rest = corpus_pipeline.drop_near_duplicates(spark, sample, DATA)
    corpus_pipeline.cut_repeats(spark, shared.kept(rest, "rest"), DATA)
    sent = [lines for text in found for lines in broadcasts(text)]
    frequent = f" * {substrings.HOT_PARTS}) > "
    assert sent and all(frequent in lines for lines in sent)

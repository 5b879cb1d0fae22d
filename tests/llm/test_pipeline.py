"""The pipeline, stage by stage, on the smallest given tables."""

import reference as ref

import corpus_pipeline
from lexmill.llm.shared import kept

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark, sample):
    docs = sample
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, kept(stage(spark, docs, DATA), name)
        seen[name] = (before, docs)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name][1].columns == sample.columns

    before, after = seen["simhash_near_dedup"]
    expected = ref.components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in expected.values()})

    before, after = seen["substring_dedup"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    removed = {i: (gone, line) for i, _, gone, line in ref.removed_words(list(texts.items()))}
    for r in after.collect():
        gone, line = removed[r["doc_id"]]
        assert r["text"] == (line if gone else texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])

    before, after = seen["source_mixing"]
    counts = ref.grouped(after.collect(), "doc_id")
    assert set(counts) <= {r["doc_id"] for r in before.collect()}
    assert max(map(len, counts.values())) <= 3
    sizes, taken = ({}, {})
    for total, rows in ((sizes, before.collect()), (taken, after.collect())):
        for r in rows:
            total[r["source"]] = total.get(r["source"], 0) + len(ref.words(r["text"]))
    for source, target in ref.targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 0.02 * target

    before, after = seen["best_fit_packing"]
    starts = [r for r in after.collect() if r["start"] == 0]
    assert len(starts) == before.count()
    held = ref.grouped(after.collect(), "sequence_id").values()
    for pieces in held:
        ends = [0]
        for piece in sorted(pieces, key=lambda p: p["offset"]):
            assert piece["offset"] == ends[-1]
            ends.append(piece["offset"] + piece["length"])
        assert ends[-1] <= 2048
    # Best fit leaves at most one sequence no fuller than half.
    assert sum(sum(p["length"] for p in pieces) <= 1024 for pieces in held) <= 1


def test_pipeline_of_odd_rows(spark, edge, tmp_path):
    folder = str(tmp_path / "tables")
    edge.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_of_nothing(spark, no_docs, no_labels, tmp_path):
    folder = str(tmp_path / "tables")
    no_docs.write.parquet(f"{folder}/documents.parquet")
    no_labels.write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_workers_hold_little_and_let_go():
    import pyarrow as pa

    from lexmill.llm import shared

    shared.held("old", lambda: 1), shared.held("own", lambda: 2)
    batch = pa.record_batch([pa.array(range(1_000))], ["n"])
    found = list(shared.slices(iter([batch, batch.slice(0, 0), batch.slice(300)]), keep="own"))
    assert [n for part in found for n in part.column(0).to_pylist()] == [*range(1_000), *range(300, 1_000)]
    assert max(part.num_rows for part in found) <= shared.SLICE_ROWS
    assert shared.held("own", lambda: 3) == 2 and shared.held("old", lambda: 4) == 4


def test_tokenizer_leaves_workers_with_its_stage(spark, sample, monkeypatch):
    from lexmill.llm import packing, shared, simhash

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.record_batch([pa.array([name for name in shared._all_held()] or ["nothing"])], ["name"])

    one = sample.coalesce(1)
    assert packing.tokenize_pieces(one).count() > 0
    assert "nothing" not in {r["name"] for r in one.select("doc_id").mapInArrow(held, "name string").collect()}
    for _ in range(20):  # workers take turns
        simhash.fingerprints(one).count()
    names = [one.select("doc_id").mapInArrow(held, "name string").collect() for _ in range(3)]
    assert {r["name"] for rows in names for r in rows} == {"nothing"}

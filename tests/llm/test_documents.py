"""Operators on documents against plain Python, on edge cases and on the smallest given table."""

import zlib

import numpy as np
import pytest
import reference as ref
from pyspark.sql import functions as F

from lexmill.llm import licenses, mixing, packing, sharding, simhash, sketches, substrings


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# -- simhash -----------------------------------------------------------------


def test_masks_cover_every_pair_within_the_radius():
    import itertools
    import random

    masks = simhash.covering_masks()
    assert len(masks) == 31
    assert all(24 <= bin(m).count("1") <= 40 for m in masks)
    rng = random.Random(1)
    pairs = [rng.sample(range(64), 4) for _ in range(20_000)] + [list(c) for c in itertools.combinations(range(20), 4)]
    for bits in pairs:
        difference = sum(1 << b for b in bits)
        assert any(not m & difference for m in masks)


def test_simhash_components_equal_all_pairs(sample, sample_rows):
    found = {r["doc_id"]: r for r in rows_of(simhash.near_duplicates(sample))}
    expected = ref.components(sample_rows)
    assert {i: (r["fingerprint"] % 2**64, r["component_id"]) for i, r in found.items()} == expected
    assert len({c for _, c in expected.values()}) < len(expected)


def test_simhash_edge_rows(edge):
    found = rows_of(simhash.near_duplicates(edge))
    expected = ref.components(ref.EDGE_TEXTS)
    assert len(found) == edge.count()
    for r in found:
        if r["doc_id"] is not None:
            assert (r["fingerprint"] % 2**64, r["component_id"]) == expected[r["doc_id"]]
        else:
            assert r["component_id"] == 1
    kept = rows_of(simhash.without_near_duplicates(edge))
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in expected.values()})
    assert set(kept[0]) == set(edge.columns)


def test_simhash_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    chain = [(1 << 4 * n) - 1 for n in range(16)]  # each four bits from the next, the ends far apart
    near = [0xABCDEF << 40 | 1 << n for n in range(40)]
    prints = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in chain + near], "fingerprint long")
    stars = simhash.components(simhash.links(prints)).collect()
    roots = {}
    for r in stars:
        roots.setdefault(r["root"], set()).update({r["node"], r["root"]})
    assert sorted(len(g) for g in roots.values()) == [16, 40]


def test_simhash_keeps_one_row_of_each_component_without_ids(spark):
    unlike = [" ".join(f"{c}{n}" for n in range(60)) for c in "abcde"]
    rows = [(None, unlike[0]), (None, unlike[0] + " "), (None, unlike[1]), (None, unlike[2]), (7, unlike[3]), (7, unlike[4])]
    kept = rows_of(simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert len(kept) == 5
    assert {(r["doc_id"], r["text"].strip()) for r in kept} == {(i, t.strip()) for i, t in rows}


# -- substrings --------------------------------------------------------------


def test_rolled_hashes_are_equal_for_equal_windows_only():
    import numpy as np

    values = np.array([5, 6, 7, 8, 9] * 30, np.uint64)
    for length in (1, 2, 25, 50, 63):
        h = substrings._rolled(values, length, substrings.BASES[0])
        assert len(h) == len(values) - length + 1
        assert len(set(h.tolist())) == 5 and (h[:5] == h[5:10]).all()
        low = substrings._smallest(values, length)
        assert low.tolist() == [min(values[i : i + length]) for i in range(len(h))]


def test_substrings_equal_brute_force(sample, sample_rows):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows_of(substrings.removals(sample))}
    expected = {i: (n, gone, ref.sha(line)) for i, n, gone, line in ref.removed_words(sample_rows)}
    assert found == expected
    assert any(gone for _, gone, _ in expected.values())


def test_substrings_edge_rows(edge):
    found = rows_of(substrings.removals(edge))
    assert len(found) == edge.count()
    expected = {i: (n, gone, ref.sha(line)) for i, n, gone, line in ref.removed_words(ref.EDGE_TEXTS)}
    expected[None] = (120, 0, ref.sha(ref.PROSE))
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]] for r in found)
    kept = {r["doc_id"]: r for r in rows_of(substrings.without_repeats(edge))}
    assert kept[3]["text"] == "" and kept[3]["n_chars"] == 0
    assert kept[2]["text"] == "before it all" and kept[4]["text"] is None and kept[6]["text"] == ref.EDGE_TEXTS[5][1]
    assert list(kept[2]) == edge.columns


# -- packing -----------------------------------------------------------------


def test_plan_fills_sequences_without_gaps():
    import random

    rng = random.Random(3)
    for cap, kinds in ((10, 10), (2048, 300), (2048, 2048)):
        histogram = {rng.randint(1, cap): rng.randint(1, 50) for _ in range(kinds)}
        plan = packing.plan_lengths(histogram, cap)
        taken, ranks = {}, {}
        for length, a, b, each, first, place in plan:
            for rank in range(a, b):
                ranks.setdefault(length, []).append(rank)
                seq, off = first + (rank - a) // each, place + (rank - a) % each * length
                taken.setdefault(seq, []).append((off, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        for parts in taken.values():
            parts.sort()
            assert parts[0][0] == 0 and sum(parts[-1]) <= cap
            assert all(sum(p) == q[0] for p, q in zip(parts, parts[1:], strict=False))
        total = sum(k * n for k, n in histogram.items())
        assert len(taken) <= 1.23 * total / cap + 1
        assert len(plan) <= 36 * len(histogram)


def test_encoder_equals_the_tokenizer(sample_rows):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    rng = random.Random(9)
    signs = "abcXYZéÉßñÑ019 \t\n\r\x0b.,!?'’\"-_&%$#<|>²½ªºİıſKé́\xa0\x85\x1c\x1f​　漢字ДжΣς😀ŉǅ\xad\x00\x7f"
    texts = [t for _, t in sample_rows] + ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(20_000)]
    texts += ["I'LL don't WE'VE 's't 'RE !'s ''d it's", "<|startoftext|> a<|endoftext|>b", "".join(map(chr, range(0x250)))]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder(text) == b"".join(i.to_bytes(4, "little") for i in ids), repr(text)


@pytest.mark.parametrize("which", ["edge", "sample"])
def test_packing_cuts_and_places_every_document(which, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    found = rows_of(packing.pack(docs))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    many = ref.grouped(docs.collect(), "doc_id")
    for doc_id, pieces in ref.grouped(found, "doc_id").items():
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        expected = []
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            expected += [(n, start, len(part), crc)] * len(many[doc_id])
        assert sorted((p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == expected
    for parts in ref.grouped(found, "sequence_id").values():
        spans = sorted((p["offset"], p["length"]) for p in parts)
        assert spans[0][0] == 0 and sum(spans[-1]) <= 2048
        assert all(sum(p) == q[0] for p, q in zip(spans, spans[1:], strict=False))


# -- mixing ------------------------------------------------------------------


@pytest.mark.parametrize("which", ["edge", "sample"])
def test_mixing_meets_targets(which, request):
    docs = request.getfixturevalue(which)
    rows = docs.select("source", "text").collect()
    sizes = {r["source"]: 0 for r in rows}
    for r in rows:
        sizes[r["source"]] += len(ref.words(r["text"]))
    expected = ref.targets(sizes)
    found = [{**r["row"].asDict(), **{k: r[k] for k in ("size", "source_size", "target", "copies")}} for r in mixing.mix(docs).collect()]
    assert len(found) == len(rows)
    for source, parts in ref.grouped(found, "source").items():
        assert parts[0]["source_size"] == sizes[source]
        assert parts[0]["target"] == pytest.approx(expected[source], rel=1e-12)
        taken = sum(p["size"] * p["copies"] for p in parts)
        assert abs(taken - expected[source]) <= max(p["size"] for p in parts)
        assert all(0 <= p["copies"] <= 3 for p in parts)
    again = mixing.mix(docs.repartition(7))
    key = lambda r: (r["row"]["doc_id"] or -1, r["copies"])
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, again.collect()))


def _worst_miss(found):
    rows = [{"s": r["row"]["source"], "t": r["target"], "n": r["size"] * r["copies"]} for r in found.collect()]
    parts = ref.grouped(rows, "s").values()
    return max(abs(sum(r["n"] for r in p) - p[0]["t"]) / p[0]["t"] for p in parts if p[0]["t"])


def test_mix_fits_around_long_documents(spark):
    """Sources with one document as long as all others together, or with a few of a large part each."""
    sizes = {(s, n): 100 + n % 17 for s in "abcd" for n in range(60)} | {(s, 60): 6000 for s in "abc"} | {("d", 60 + n): 900 for n in range(9)}
    rows = [(n, " ".join("w" * size), s) for n, ((s, _), size) in enumerate(sizes.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs)
    assert _worst_miss(taken) < 0.005
    assert all(0 <= r["copies"] <= 3 for r in taken.select("copies").collect())
    assert sum(r["size"] * r["copies"] for r in taken.collect()) == mixing.mixed_documents(docs).selectExpr("sum(size(split(text, ' ')))").first()[0]


def test_mix_of_few_documents_is_the_closest_there_is(spark, sample):
    """Up to eighteen documents a source: no choice among all subsets comes closer."""
    assert _worst_miss(mixing.mix(sample)) < 0.01
    found = [{"s": r["row"]["source"], "t": r["target"], "n": r["size"], "c": r["copies"]} for r in mixing.mix(sample).collect()]
    few = [parts for parts in ref.grouped(found, "s").values() if len(parts) <= 18]
    assert few
    for parts in few:
        total = sum(p["n"] for p in parts)
        whole = min(int(parts[0]["t"] // total), 3)
        sums = mixing.subset_sums([p["n"] for p in parts])
        best = np.abs(parts[0]["t"] - whole * total - sums).min()
        assert abs(sum(p["n"] * p["c"] for p in parts) - parts[0]["t"]) == pytest.approx(best)


@pytest.mark.parametrize("sizes", [[5, 3, 1], [1000, 1], [7], []])
def test_settling_leaves_what_the_rest_can_make_up(sizes):
    total = sum(sizes)
    for rest in (0, 4, 100):
        for want in (0.0, 0.3 * (total + rest), total + rest - 1.0, float(total + rest)):
            taken = mixing.settle(sizes, want, total + rest)
            best = min(max(t - want, want - t - rest, 0.0) for t in mixing.subset_sums(sizes).tolist())
            assert max(taken - want, want - taken - rest, 0.0) == best


def test_mixed_documents_keep_columns(edge):
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns


def test_water_filling_of_many_sources(spark):
    import random

    rng = random.Random(5)
    sizes = {f"s{n:03}": rng.choice([0, 1, 5, 40, 1000, 90_000]) for n in range(90)}
    docs = spark.createDataFrame([(n, " ".join("w" * min(s, 1000)), k) for n, (k, s) in enumerate(sizes.items())], "doc_id long, text string, source string")
    sizes = {k: min(s, 1000) for k, s in sizes.items()}
    found = {r["row"]["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert found == pytest.approx(ref.targets(sizes), rel=1e-12)


# -- sharding ----------------------------------------------------------------


@pytest.mark.parametrize("which", ["edge", "sample"])
def test_shards_are_gapless_and_balanced(which, request):
    docs = request.getfixturevalue(which)
    found = rows_of(sharding.shard_documents(docs))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert len(found) == docs.count()
    for r in found:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]))
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    totals = []
    for parts in ref.grouped(found, "shard").values():
        assert sorted(p["slot"] for p in parts) == list(range(len(parts)))
        totals.append(sum(p["size"] for p in parts))
    if which == "sample":
        mean, largest = sum(totals) / 16, max(r["size"] for r in found)
        assert max(totals) <= max(1.02 * mean, largest)


def test_rebalance_moves_few_slots():
    import random

    rng = random.Random(2)
    load = {s: rng.randint(900, 1100) for s in range(4096)}
    first = sharding.initial_map()
    edited = sharding.rebalance(first, load)
    totals = [0] * 16
    for s, n in load.items():
        totals[edited[s]] += n
    assert max(totals) - min(totals) < 100
    assert sum(a != b for a, b in zip(first, edited, strict=True)) < 200
    assert sharding.rebalance(edited, load) == edited


def test_repeated_rows_spread_over_shards(spark):
    """A third of all rows equal, without an id; and a text that few shards could hold."""
    docs = spark.range(3_000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.expr("repeat(string(id), 10)")).otherwise("the same text, again").alias("text")
    )
    found = rows_of(sharding.shard_documents(docs.repartition(5)))
    totals = [sum(p["size"] for p in parts) for parts in ref.grouped(found, "shard").values()]
    mean = sum(totals) / 16
    assert len(found) == 3_000 and len(totals) == 16 and max(totals) <= 1.02 * mean and min(totals) >= 0.98 * mean
    for parts in ref.grouped(found, "shard").values():
        assert sorted(p["slot"] for p in parts) == list(range(len(parts)))


def test_a_stored_map_is_edited(spark, sample, tmp_path):
    path = str(tmp_path / "map")
    first = {r["doc_id"]: r["shard"] for r in rows_of(sharding.shard_documents(sample, map_path=path))}
    assert sharding.newest_map(spark, path)[0] == 1
    # The same documents need no other map.
    assert {r["doc_id"]: r["shard"] for r in rows_of(sharding.shard_documents(sample, map_path=path))} == first
    version, before = sharding.newest_map(spark, path)
    assert version == 1
    more = sample.unionByName(sample.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 10**6))
    found = rows_of(sharding.shard_documents(more, map_path=path))
    version, after = sharding.newest_map(spark, path)
    assert version == 2 and before != after
    moved = sum(a != b for a, b in zip(before, after))
    assert moved < sharding.SLOTS // 10
    assert sum(first[r["doc_id"]] == r["shard"] for r in found if r["doc_id"] in first) > 0.5 * len(first)
    with pytest.raises(ValueError, match="slots"):
        sharding.edit_map(spark, path, {}, slots=8)


# -- sketches ----------------------------------------------------------------


def test_fingerprints_of_edited_texts(sample, sample_rows):
    found = rows_of(sketches.fingerprint_neighbours(sample))
    texts, edited = dict(sample_rows), ref.edited_texts(sample_rows)
    errors = []
    for r in found:
        n, text, following = edited[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, ref.sha(text))
        errors.append(abs(r["near_edited"] - ref.jaccard(texts[r["doc_id"]], text)))
        errors.append(abs(r["near_next"] - ref.jaccard(texts[r["doc_id"]], texts[following])))
    assert len(found) == len(texts) and max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    by_text = ref.grouped([{"t": texts[r["doc_id"]], "f": r["fingerprint"]} for r in found], "t")
    assert all(len({p["f"] for p in parts}) == 1 for parts in by_text.values())


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_fingerprints_do_not_depend_on_ranges(edge, buckets):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = rows_of(sketches.fingerprint_neighbours(docs, buckets=buckets))
    edited = ref.edited_texts(ref.EDGE_TEXTS)
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found} == {
        i: (n, ref.sha(text)) for i, (n, text, _) in edited.items()
    }
    whole = rows_of(sketches.fingerprint_neighbours(edge, buckets=buckets))
    assert len(whole) == edge.count()
    near = {r["doc_id"]: r["near_next"] for r in found}
    assert near[5] == 1.0 and near[7] == 0.0


def test_ranges_hold_like_numbers_of_rows(spark):
    """Wherever ids lie, and if a third of the rows has one id."""
    outlying = spark.range(4_000).select(F.when(F.col("id") == 7, 2**62).otherwise(F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    one_id = spark.range(4_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 10**6).alias("doc_id"), F.col("id").cast("string").alias("text"))
    for docs in (outlying, one_id):
        ranges = sketches._in_ranges(docs, 40)
        assert ranges.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 250
        order = [(r["bucket"], r["doc_id"], r["key"]) for r in ranges.collect()]
        assert sorted(order) == sorted(order, key=lambda r: r[1:])
    found = {r["doc_id"]: r["edited_sha256"] for r in sketches.fingerprint_neighbours(outlying, buckets=40).collect()}
    edited = ref.edited_texts([(r["doc_id"], r["text"]) for r in outlying.collect()])
    assert found == {i: ref.sha(text) for i, (_, text, _) in edited.items()}


def test_long_first_texts_are_not_copied_along(spark):
    """A range's rows carry one text each and that of their next; the next range's first text comes as a row."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    plan = sketches.fingerprint_neighbours(docs, buckets=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "head_text" not in plan and "Union" in plan


def test_sketches_merge_and_estimate(spark):
    one, two = ["a%d" % i for i in range(4000)], ["a%d" % i for i in range(1000, 9000)]
    df = spark.createDataFrame([(one, two, one + two)], "a array<string>, b array<string>, c array<string>")
    hashed = df.select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "abc"])
    s = hashed.select(*[sketches.bottom_k(F.col(c)).alias(c) for c in "abc"])
    r = s.select(
        (sketches.merge(F.col("a"), F.col("b")) == F.col("c")).alias("merged"),
        sketches.resemblance(F.col("a"), F.col("b")).alias("near"),
        sketches.containment(F.col("a"), F.col("b")).alias("inside"),
        sketches.distinct_shingles(F.col("c")).alias("n"),
    ).first()
    assert r["merged"]
    assert r["near"] == pytest.approx(3000 / 9000, abs=0.13)
    assert r["inside"] == pytest.approx(0.75, abs=0.25)
    assert r["n"] == pytest.approx(9000, rel=0.3)


# -- licenses ----------------------------------------------------------------


@pytest.mark.parametrize("which", ["edge", "sample"])
def test_licenses_equal_brute_force(which, request):
    docs = request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = rows_of(licenses.scan(docs))
    assert len(found) == docs.count()
    for r in found:
        n, places = ref.license_places(texts[r["doc_id"]])
        at = [p for p, _ in places]
        labels = {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert not labels or r["score"] == 1


def test_license_spans_with_changed_words(spark):
    text = "permission is hereby granted without free of charge to any person who is obtaining a copy of this fine software"
    docs = spark.createDataFrame([(1, text), (2, "permission is granted to any person")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[1]["labels"] == "mit" and found[1]["n_base"] == 0 and 0.5 < found[1]["score"] < 1
    assert found[2]["labels"] == ""


NOTICE_CASES = [
    ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "agpl"),
    ("You can redistribute it and/or modify it under the terms of the GNU General Public License, as you wish.", "gpl"),
    ("the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
    ("Text licensed under CC BY-NC-SA 4.0 by its authors", "cc-by-nc,cc-by-nc-sa"),
    ("Text licensed under CC BY-SA 4.0 by its authors", "cc-by-sa"),
    ("Text licensed under CC BY 4.0 by its authors", "cc-by"),
    ("See the Mozilla Public License 2.0 for this", "mpl-2"),
    ("subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above notice stays", "isc"),
    ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", "mit"),
    ("// SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("// SPDX-License-Identifier: MIT", "mit"),
    ("// SPDX-License-Identifier: GPL-3.0-only", "gpl-3"),
    ("// SPDX-License-Identifier: nothing we know", ""),
    ("Licensed under the Apache License, Version 1.1", ""),
    ("a license of the general public, in mozilla and other words the software is provided", ""),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache-2"),
]


def test_license_notices_are_told_apart(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(NOTICE_CASES)], "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert {NOTICE_CASES[i][0]: labels for i, labels in found.items()} == dict(NOTICE_CASES)


@pytest.mark.parametrize("which", ["edge", "sample", "notices"])
def test_license_labels_and_scores_equal_brute_force(which, request, spark):
    if which == "notices":
        filler = "some other words of the software and the license in between here"
        rows = [(i, f"{filler} {a} {filler[: i % 40]} {b} {a}") for i, ((a, _), (b, _)) in enumerate(zip(NOTICE_CASES, NOTICE_CASES[3:]))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    else:
        docs = request.getfixturevalue(which)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    listed = licenses.template_runs()
    for r in rows_of(licenses.scan(docs)):
        labels, score = ref.license_labels(texts[r["doc_id"]], listed)
        assert (r["labels"], r["score"]) == (",".join(sorted(labels)), pytest.approx(score))


# -- empty tables ------------------------------------------------------------


@pytest.mark.parametrize(
    "apply",
    [
        simhash.near_duplicates,
        simhash.without_near_duplicates,
        substrings.removals,
        substrings.without_repeats,
        packing.pack,
        mixing.mixed_documents,
        sharding.shard_documents,
        sketches.fingerprint_neighbours,
        licenses.scan,
    ],
)
def test_empty_table(no_docs, apply):
    assert apply(no_docs).collect() == []

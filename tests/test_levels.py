"""Levelled tables and claims, with many writers at once."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from lexmill.operators import levels
from lexmill.operators.levels import LevelledTable
from lexmill.operators.runs import RunStore
from lexmill.session import list_names, put_if_absent, read_text


def side_by_side(spark, work, arguments, threads=10):
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), arguments))


def test_one_of_many_takes_a_path(spark, tmp_path):
    path = f"file://{tmp_path}/a b/taken"
    won = side_by_side(spark, lambda i: put_if_absent(spark, path, f"writer {i}"), range(20))
    assert sum(won) == 1
    assert read_text(spark, path) == f"writer {won.index(True)}"
    assert list_names(spark, f"file://{tmp_path}/a b") == ["taken"]
    assert list_names(spark, f"{tmp_path}/nowhere") == []


def test_reads_touch_few_folders(spark, tmp_path):
    table = LevelledTable(spark, str(tmp_path / "t"), "i long", fan=3)
    assert table.read().count() == 0 and not table.compact()
    for i in range(30):
        table.append(spark.range(i, i + 1).select(F.col("id").alias("i")))
        table.compact()
        assert sorted(r["i"] for r in table.read().collect()) == list(range(i + 1))
    assert len(table.folders()) <= 8  # thirty appends, three levels
    assert len(list_names(spark, str(tmp_path / "t" / "_manifest"))) <= 3
    # What merges replaced is gone but for the last one's.
    assert len(list_names(spark, str(tmp_path / "t"))) <= 8


def test_merges_at_once_lose_and_repeat_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(6):
        LevelledTable(spark, root, "i long").append(spark.range(i, i + 1).select(F.col("id").alias("i")))
    merged = side_by_side(spark, lambda _: LevelledTable(spark, root, "i long", fan=3).compact(), range(6))
    assert sum(merged) >= 1
    assert sorted(r["i"] for r in LevelledTable(spark, root, "i long").read().collect()) == list(range(6))


def test_an_unfinished_append_is_not_read(spark, tmp_path):
    table = LevelledTable(spark, str(tmp_path / "t"), "i long")
    table.append(spark.range(3).select(F.col("id").alias("i")), "done")
    table.append(spark.range(9).select(F.col("id").alias("i")), "cut")
    (tmp_path / "t" / "batch=cut" / "_SUCCESS").unlink()
    assert table.read().count() == 3


def add(spark, table, *numbers):
    for i in numbers:
        table.append(spark.range(i, i + 1).select(F.col("id").alias("i")), str(i))


def test_a_merge_that_stops_before_clearing_repeats_nothing(spark, tmp_path, monkeypatch):
    table = LevelledTable(spark, str(tmp_path / "t"), "i long", fan=3)
    add(spark, table, 0, 1, 2)
    assert table.compact()
    add(spark, table, 3, 4, 5)

    def stopped(*_):
        raise InterruptedError

    with monkeypatch.context() as patched:
        patched.setattr(levels, "delete_path", stopped)
        with pytest.raises(InterruptedError):
            table.compact()
    assert sorted(r["i"] for r in table.read().collect()) == list(range(6))
    add(spark, table, 6, 7, 8)
    assert table.compact()
    assert sorted(r["i"] for r in table.read().collect()) == list(range(9))
    # Nothing of the stopped merge's work is left.
    assert {n for n in list_names(spark, str(tmp_path / "t")) if n.startswith("batch=")} == {"batch=6", "batch=7", "batch=8"}


def test_a_merge_that_later_ones_overtook_gives_way(spark, tmp_path):
    root = str(tmp_path / "t")
    quick = LevelledTable(spark, root, "i long", fan=3)
    add(spark, quick, 0, 1, 2)

    def overtaken(rows):
        assert quick.compact()
        add(spark, quick, 3, 4, 5)
        assert quick.compact()  # clears what ``rows`` would read
        return rows

    assert not LevelledTable(spark, root, "i long", overtaken, fan=3).compact()
    assert sorted(r["i"] for r in quick.read().collect()) == list(range(6))


def test_a_merge_that_fails_on_its_own_says_so(spark, tmp_path):
    def broken(rows):
        raise ValueError("no")

    table = LevelledTable(spark, str(tmp_path / "t"), "i long", broken, fan=3)
    add(spark, table, 0, 1, 2)
    with pytest.raises(ValueError, match="no"):
        table.compact()
    assert table.read().count() == 3


def test_writers_at_once_get_versions_of_their_own(spark, tmp_path):
    root = str(tmp_path / "store")
    versions = side_by_side(spark, lambda i: RunStore(spark, root).register("m", f"run{i}"), range(20))
    assert sorted(versions) == list(range(1, 21))
    store = RunStore(spark, root)
    assert {(r["version"], r["run_id"]) for r in store.versions().collect()} == {(v, f"run{i}") for i, v in enumerate(versions)}
    side_by_side(spark, lambda v: RunStore(spark, root).move("m", v, "Production"), range(1, 21))
    orders = [r["event_order"] for r in store.events().collect()]
    assert len(orders) == len(set(orders)) == 40
    assert store.resolve("m")["version"] == 20
    assert len(store._levels("stage_events", "name string").folders()) < 20

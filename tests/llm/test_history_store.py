"""The stored history: only a missing folder counts as empty."""

import pytest

from glyphtrail.llm import incremental

ARGS = {"key": ["session_id", "cap"], "new_id": "block_id", "text": "otext", "rect": "rect"}
ROWS = [(1, "s", 1, [0.0, 0.0, 100.0, 20.0], "abcdefghij")]


def batch(spark, rows):
    return spark.createDataFrame(rows, "block_id long, session_id string, cap int, rect array<double>, otext string")


def test_damaged_history_is_an_error(spark, tmp_path):
    folder = tmp_path / "index"
    index = incremental.HistoryIndex(str(folder), buckets=2)
    assert index.check(batch(spark, ROWS), **ARGS).count() == 0
    files = list(folder.rglob("*.parquet"))
    assert files
    for f in [*files, *folder.rglob(".*.crc")]:
        f.unlink() if f.suffix == ".crc" else f.write_bytes(b"damaged footer")
    with pytest.raises(Exception):
        index.check(batch(spark, ROWS), **ARGS).count()
    assert sorted(folder.rglob("*.parquet")) == sorted(files), "nothing was appended"


def test_history_without_rows_is_empty(spark, tmp_path):
    index = incremental.HistoryIndex(str(tmp_path / "index"), buckets=2)
    assert index.check(batch(spark, []), **ARGS).count() == 0
    assert index.check(batch(spark, ROWS), **ARGS).count() == 0
    assert [r.block_id for r in index.check(batch(spark, [(2, *ROWS[0][1:])]), **ARGS).collect()] == [2]


def test_a_batch_reads_only_what_it_visits(spark, tmp_path):
    index = incremental.HistoryIndex(str(tmp_path / "index"), buckets=64)
    place = lambda i: [0.0, 40.0 * i, 100.0, 40.0 * i + 20.0]
    history = [(1000 * c + i, "s", c, place(i), f"line {i} of capture {c}") for c in range(40) for i in range(20)]
    index.append(incremental._rows(batch(spark, history), "block_id", ARGS["key"], "otext", "rect"))
    fresh = batch(spark, [(90_000, "s", 7, place(3), "line 3 of capture 8"), (90_001, "s", 7, place(4), "quite new"), (90_002, "s", 7, place(4), "quite neu")])
    rows = incremental.placement.visits(incremental._rows(fresh, "block_id", ARGS["key"], "otext", "rect"), ["scope"])
    living = index.visited(rows)
    assert 0 < living.count() <= 3
    plan = living._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    read = {f.parent.name for f in (tmp_path / "index").rglob("*.parquet")}
    assert len(read) > 20, "the history fills many buckets, the batch names one"
    assert sorted(r.block_id for r in index.check(fresh, **ARGS).collect()) == [90_000, 90_002]
    again = batch(spark, [(90_003, "s", 7, place(4), "quite new!")])
    assert [r.block_id for r in index.check(again, **ARGS).collect()] == [90_003]


def test_batches_are_taken_in_turn(spark):
    R = [0.0, 0.0, 100.0, 20.0]
    new = spark.createDataFrame([(1, "s", 1, R, "aaaaaaaaaa", 1), (2, "s", 1, R, "aaaaaaaabb", 1), (3, "s", 1, R, "aaaaaabbbb", None), (4, "s", 1, R, "aaaaaabbbb", 3), (5, "s", 1, R, "zzzz", 3)], "block_id long, session_id string, cap int, rect array<double>, otext string, batch_no int")
    old = batch(spark, [(9, "s", 1, R, "zzzz")])
    one = incremental.repeated_rows(new, old, history_id="block_id", **ARGS)
    turns = incremental.repeated_rows(new, old, history_id="block_id", batch="batch_no", **ARGS)
    assert sorted(r[0] for r in one.collect()) == sorted(r[0] for r in turns.collect()) == [2, 4, 5]
    assert incremental.repeated_rows(new.limit(0), old, history_id="block_id", batch="batch_no", **ARGS).count() == 0

import random

import pytest

from glyphtrail import queries as tracker
from glyphtrail.sources import queries as sources
from oracle import rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(tracker.ORACLE))
def test_equals_sql(spark, data, name):
    columns, got = rows_of(tracker.QUERIES[name](spark, data))
    names, want = sql_rows(tracker.ORACLE[name], data)
    assert columns == names
    assert got == want
    assert got, "a comparison of nothing proves nothing"


@pytest.mark.parametrize("name", ["q_containment", "q_track_session", "q_track_census", "q_paragraphs", "q_paragraph_decisions", "q_pregroup", "q_step_rule"])
def test_runs(spark, data, name):
    assert tracker.QUERIES[name](spark, data).count() > 0


def test_best_window_reads_the_whole_fragment(spark, tmp_path):
    rng = random.Random(6)
    held = ["".join(rng.choice("abcde") for _ in range(n)) for n in (60, 55, 40, 30, 12, 3)]
    fresh = [held[0][5:50], held[1][:20] + "zzzzzzzzzz" + held[1][30:], held[2][:12] + "z" * 20, held[3] + "a", held[4][2:9], held[5]]
    rows = [(i, h, f) for i, (h, f) in enumerate(zip(held, fresh))] + [(90, None, "abcd"), (91, "abcd", None), (92, "a b-c d!", "A, bcd")]
    spark.createDataFrame(rows, "freeze_id long, heldtext string, freshtext string").write.parquet(str(tmp_path / "freezes.parquet"))
    got = {r.id: r.score for r in tracker.QUERIES["q_best_window"](spark, str(tmp_path)).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def best(f, w):
        n = len(f)
        return max(1 - distance(f, w[i : i + n]) / n for i in range(len(w) - n + 1)) if 4 <= n <= len(w) else 0.0

    assert got == {i: round(best(f, h), 6) for i, (h, f) in enumerate(zip(held, fresh))} | {92: 0.75}
    assert got[0] == 1.0 and got[2] < 0.7


def test_entry_lists_every_query(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(tracker.QUERIES) | set(sources.QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).count() > 0

"""The path for very many sources gives what the one for few gives."""

import random

from glyphtrail.llm import survivor


def test_both_paths_agree(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for e in range(60):
        for s, careful in (("a", 0.95), ("b", 0.8), ("c", 0.4), ("d", 0.7)):
            rows += [(e, s, f"t{k}") for k in range(2) if rng.random() < careful]
            rows += [(e, s, f"f{k}") for k in range(4) if rng.random() < (1 - careful) / 2]
    df = spark.createDataFrame(rows, "e int, source string, val string")
    result = lambda: sorted(tuple(r) for r in survivor.true_values(df, ["e"], "source", "val", rounds=5).collect())
    few = result()
    monkeypatch.setattr(survivor, "MAX_SOURCES", 0)
    many = result()
    assert [r[:3] for r in few] == [r[:3] for r in many] and all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(few, many))

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphtrail.functions import confidence, coordinates, geometry, stats, text
from glyphtrail.plans import scalar


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_white_space_and_scripts(spark):
    s = F.lit("　a  b\n漢字﻿ ")
    assert tuple(one(spark, text.normalize_whitespace(s), text.cjk_only(s), text.significant(s), text.short_head(F.lit("😀bc"), 2))) == ("a b 漢字", "漢字", "ab漢字", "😀b")
    assert one(spark, text.cjk_fraction(F.lit("漢a")), text.cjk_fraction(F.lit(""))) == (0.5, 0.0)


def test_similarity_edges(spark):
    lev = lambda a, b: text.levenshtein_ratio(F.lit(a), F.lit(b))
    jac = lambda a, b: text.jaccard(text.char_set(F.lit(a)), text.char_set(F.lit(b)))
    assert tuple(one(spark, lev("", ""), lev("", "a"), lev("kitten", "sitting"), jac("", ""), jac("", "a"), jac("abc", "bcd"))) == (1.0, 0.0, 1 - 3 / 7, 1.0, 0.0, 0.5)
    assert tuple(one(spark, text.best_window(F.lit("abcd"), F.lit("xxabcdyy")), text.best_window(F.lit("abc"), F.lit("abc")), text.best_window(F.lit("abcde"), F.lit("abcd")))) == (1.0, 0.0, 0.0)


@settings(max_examples=60, deadline=None)
@given(st.text("abcé漢", max_size=12), st.text("abcé漢", max_size=12))
def test_scalar_distance_and_common_subsequence(a, b):
    row, common = list(range(len(b) + 1)), [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            common[i][j] = common[i - 1][j - 1] + 1 if x == y else max(common[i - 1][j], common[i][j - 1])
    assert scalar.distance(a, b) == row[-1]
    assert text.lcs_length(a, b) == common[-1][-1]


def test_fnv_and_containment(spark):
    df = spark.createDataFrame([("", "abc"), ("a", "xay"), (None, "a")], ["a", "b"])
    rows = df.select(text.fnv1a64_hex("a").alias("h"), text.containment_ratio("a", "b").alias("r")).collect()
    assert [tuple(r) for r in rows] == [("cbf29ce484222325", 0.0), ("af63dc4c8601ec8c", 1.0), (None, None)]


def test_geometry(spark):
    a, b = geometry.Box(*map(F.lit, (0.0, 0.0, 10.0, 10.0))), geometry.Box(*map(F.lit, (10.0, 0.0, 20.0, 10.0)))
    same = geometry.inverse_transform(a, [F.lit(float(x)) for x in (1, 0, 0, 1, 3, 4)])
    flat = geometry.inverse_transform(a, [F.lit(float(x)) for x in (1, 2, 2, 4, 0, 0)])
    row = one(spark, a.overlaps(b), geometry.overlap_ratio(a, b), geometry.overlap_ratio(a, b, 1.0), same.left, flat.right, geometry.block_height(F.lit(-1.0)))
    assert tuple(row) == (False, 0.0, 0.1, -3.0, 10.0, 16.0)


def test_array_statistics(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    low, high = stats.hinges(arr(1, 2, 4, 9, 12))
    row = one(spark, stats.median(arr(1, 2, 4, 9)), stats.mad(arr(1, 2, 4, 9)), low, high, stats.iqr(arr(1, 2, 3)), stats.nearest_rank(arr(1, 2, 3, 4), 0.5), stats.share(F.lit(1), F.lit(0)), stats.mad(arr(5)))
    assert tuple(row) == (3.0, 1.4826 * 1.5, 1.5, 10.5, None, 3.0, None, 0.0)


def test_ranks_of_hot_groups(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), float(rng.randrange(50))) for _ in range(3000)] + [(None, 1.0)]
    got = {r.g: r for r in stats.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()}
    for g in {r[0] for r in rows}:
        v = sorted(x for k, x in rows if k == g)
        assert got[g].n == len(v) and got[g].median == scalar.median(v)
        if len(v) > 1:
            assert (got[g].q1, got[g].q3) == scalar.hinges(v)


def test_otsu_matches_scalar(spark):
    rng = random.Random(2)
    groups = {f"g{n}": [float(rng.choice((1, 2, 30, 31))) for _ in range(n)] for n in (1, 2, 4, 7, 12, 40)} | {"flat": [3.0] * 12}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], ["g", "v"])
    got = {r.g: r.threshold for r in stats.otsu(df, ["g"], "v").collect()}
    for g, v in groups.items():
        want = scalar.otsu(v)
        assert got[g] is None if want is None else math.isclose(got[g], want)


def test_confidence_and_keys(spark):
    row = one(spark, confidence.freshness(F.lit(100)), confidence.freshness(F.lit(1100)), confidence.stability(F.lit(None).cast("double"), F.lit(10.0)), confidence.stability(F.lit(35.0), F.lit(None).cast("double")), confidence.raw_text_confidence(F.lit(""), F.lit(1.0), F.lit(1.0)))
    assert [round(x, 6) for x in row] == [1.0, 0.65, 0.5, 0.65, 0.3]
    key = lambda k: coordinates.region_index(F.lit(k))
    assert tuple(one(spark, key("normal:3"), key("ic:a:-2"), key("x"))) == (3, -2, 0)
    sig = coordinates.group_signature
    assert one(spark, sig(F.array(F.lit("a"))) == 0, sig(F.array(F.lit("a"), F.lit("b"))) == sig(F.array(F.lit("b"), F.lit("a")))) == (True, True)


@pytest.mark.parametrize("x,y", [(-0.5, -1), (0.5, 1), (2.5, 3), (2.4, 2)])
def test_rounding_is_half_away(spark, x, y):
    assert scalar.half_up(x) == y == one(spark, F.round(F.lit(x)))[0]


def test_stretches_see_what_whole_groups_do(spark):
    import random

    from glyphtrail.functions import stats
    from glyphtrail.operators import drift

    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40), i, rng.choice([None, f"v{i}"]), rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, cap int, id long, v string, dx double, dy double")
    want, last = {}, {}
    for k, _, i, v, _, _ in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        last[k] = v or last.get(k)
        want[i] = last[k]
    assert {r.id: r.v for r in stats.carried(df, ["k"], ["cap", "id"], "v", size=7).collect()} == want
    few = df.withColumn("h", F.lit(24.0))
    whole = {r.id: (r.samples, r.drift_x, r.margin) for r in drift.running(few, ["k"], ["cap", "id"], "dx", "dy", "h").collect()}
    drift.STRETCH, kept = 25, drift.STRETCH
    try:
        assert {r.id: (r.samples, r.drift_x, r.margin) for r in drift.running(few, ["k"], ["cap", "id"], "dx", "dy", "h").collect()} == whole and len(whole) == 400
    finally:
        drift.STRETCH = kept
    assert stats.carried(df.limit(0), ["k"], ["cap", "id"], "v").count() == 0

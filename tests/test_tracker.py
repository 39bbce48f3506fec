import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from glyphtrail.operators import blocks as B
from glyphtrail.operators import match
from glyphtrail.plans import paragraphs, replay, tracker
from glyphtrail.plans.paragraphs import Knobs, Line
from glyphtrail.plans.tracker import Block, Config, Session, fit
from glyphtrail.streaming import tracker as stream


def block(i, top, text, left=16.0, width=300.0, height=20.0, **more):
    return Block(i, (left, float(top), left + width, float(top) + height), text, more.pop("pconf", 0.8), more.pop("tconf", 0.8), **more)


def page(n, dy=0.0, start=0, **more):
    words = ("amber", "brisk", "cobalt", "dusty", "ember", "fallow", "gentle", "hollow", "ivory", "jagged")
    return [block(start + i, 40 * i + dy, f"{words[i % 10]} line {i * 7919 % 1000} of {words[(i * 3 + 1) % 10]}", **more) for i in range(n)]


def test_first_sight_is_admitted_and_second_merges():
    s = Session()
    assert s.step(page(5))["admitted"] == 5
    r = s.step(page(5, 2.0))
    assert (r["merged"], r["admitted"], r["dropped"]) == (5, 0, 0)
    assert all(t.obs == 2 and 40 * i <= t.rect[1] < 40 * i + 2 for i, t in enumerate(s.tracks))


def test_dedup_is_greedy_in_arrival_order():
    s = Session()
    same = [block(i, 0, "same text", left=200.0 * i + 8, width=100) for i in range(3)]
    kept, _ = s.dedup(same)
    assert [b.id for b in kept] == [0, 2]


def test_overlap_evicts_the_weaker():
    s = Session()
    kept, _ = s.dedup([block(1, 0, "alpha beta", tconf=0.1, pconf=0.1), block(2, 1, "gamma delta", tconf=0.9, pconf=0.9)])
    assert [b.id for b in kept] == [2]


def test_coherent_shift_moves_all_members():
    s = Session()
    s.step(page(6))
    r = s.step(page(6, 130.0))
    assert r["shift"]["members"] == 6 and abs(r["shift"]["ty"] - 130) < 1e-9
    assert all(abs(t.rect[1] - (40 * i + 130)) < 1e-6 for i, t in enumerate(s.tracks))


def test_plan_does_not_depend_on_arrival():
    rng, want = random.Random(1), None
    for _ in range(5):
        s = Session()
        s.step(page(8))
        moved = page(8, 130.0)
        rng.shuffle(moved)
        got = s.step(moved)["shift"]
        want = want or got
        assert got == want


def test_retention_and_empty_captures():
    s = Session(Config(missed_frames=1))
    s.step(page(3))
    assert len(s.step([])["retained"]) == 3
    assert s.step([])["dropped"] == 3 and not s.tracks


def test_band_admission_freezes_then_promotes():
    s = Session(Config(band_mode="admit", band_observations=1, band_captures=2))
    s.step([block(1, 0, "abcdefghij")])
    s.step([block(2, 0, "abcdefWXYZ")])
    assert s.tracks[0].provisional and s.tracks[0].remaining == 2
    held = s.tracks[0].rect
    s.step([block(3, 3, "abcdefghij")])
    assert s.tracks[0].rect == held and s.tracks[0].remaining == 1
    s.step([block(4, 3, "abcdefghij")])
    assert not s.tracks[0].provisional


def test_nested_fragment_confirms_its_host():
    s = Session()
    s.step([block(1, 0, "the whole line of the page", width=400, height=40)])
    r = s.step([block(2, 10, "whole line", width=120, height=20)])
    assert r["merged"] == 1 and s.tracks[0].text == "the whole line of the page" and s.tracks[0].obs == 2


def test_grouping_contradiction():
    s = Session()
    for i in range(3):
        s.step([block(i, 0, "upper half lower half", height=60)])
    r = s.step([block(8, 0, "upper half", height=28), block(9, 30, "lower half", height=28)])
    assert len(r["grouping"]) == 1 and [b.id for b in r["grouping"][0][1]] == [8, 9]


def test_confidence_out_of_range_is_named():
    with pytest.raises(ValueError, match="block 1"):
        Session().step([block(1, 0, "a"), block(2, 40, "b", pconf=float("nan"))])
    with pytest.raises(ValueError, match="min_share"):
        Config(min_share=2)


def test_state_stays_bounded():
    rng, s = random.Random(3), Session(Config(missed_frames=2))
    lines = page(120)
    for cap in range(120):
        top = (cap * 200) % 4000
        seen = [block(b.id, b.rect[1] + rng.uniform(-1, 1), b.text + ("x" if rng.random() < 0.1 else "")) for b in lines if top <= b.rect[1] < top + 1000]
        s.step(seen)
        assert len(s.tracks) <= 160
    assert all(len(t.votes) <= 5 for t in s.tracks)
    assert all(len(r) <= 20 for r in s.drift.rings.values())


def test_dump_and_load_continue_alike():
    a = Session()
    for i in range(3):
        a.step(page(5, i))
    b = Session.load(a.dump())
    x, y = a.step(page(5, 3.0)), b.step(page(5, 3.0))
    assert replay.digest(x) == replay.digest(y)


def test_drift_propagation_and_clearing():
    s = Session(Config(step="damp"))
    s.step(page(5))
    s.step(page(5, 12.0))
    told = s.drift.propagate()
    assert told and told[0][0] == "normal:0" and not s.drift.propagate()
    s.drift.clear_region(0, 499)
    assert "normal:0" not in s.drift.rings and s.drift.propagated
    s.drift.reset_propagation()
    assert not s.drift.propagated


def test_fit_finds_a_zoom():
    pts = [(float(x), float(y)) for x in (0, 100, 250) for y in (0, 40, 300)]
    found = fit([(x, y, 1.25 * x + 5, 1.25 * y - 3) for x, y in pts] + [(0.0, 0.0, 400.0, 400.0)])
    assert abs(found["scale"] - 1.25) < 1e-9 and found["rejected"] == 1
    assert fit([(0.0, 0.0, 1.0, 1.0)] * 5) is None and fit([]) is None


def _frame(spark, captures):
    rows = [("s", cap, i, b.id, b.kind, b.hz, b.cid, 0.0, *b.rect, b.text, b.pconf, b.tconf, 0, 1, False) for cap, members in captures for i, b in enumerate(members)]
    schema = "session_id string, cap int, seq int, id long, kind string, hz int, cid string, inner_top double, l double, t double, r double, b double, text string, pconf double, tconf double, srcq int, obs int, provisional boolean"
    return B.enrich(spark.createDataFrame(rows, schema))


def test_kernel_and_native_match_agree(spark):
    rng = random.Random(7)
    first = page(40)
    second = [block(100 + b.id, b.rect[1] + rng.uniform(-2, 2), b.text if rng.random() < 0.7 else b.text[:-1] + "q") for b in first]
    both = _frame(spark, [(1, first), (2, second)])
    fresh, old = match.consecutive(both)
    native = {(r.f_id, r.c_id) for r in match.primary_match(fresh, old, ["session_id", "cap"]).collect()}
    s = Session(Config(step="damp"))
    s.step(first)
    kernel = {(b.id, t.id) for how, b, t, _, _ in s.step(second)["log"] if how == "primary"}
    assert native == kernel and len(native) > 30


def test_replay_does_not_depend_on_row_order(spark):
    rng = random.Random(4)
    caps = [(c, page(12, rng.uniform(-2, 2), 100 * c)) for c in range(1, 5)]
    df = _frame(spark, caps)
    digests = [sorted((r.cap, r.digest) for r in replay.replay(x).where("event = 'capture'").collect()) for x in (df, df.orderBy(F.rand(1)).repartition(7))]
    assert digests[0] == digests[1] and len(digests[0]) == 4


def test_stream_equals_batch(spark, tmp_path):
    caps = [(c, page(8, 1.5 * c, 100 * c)) for c in range(1, 5)]
    df = stream.with_last(_frame(spark, caps)).select(*stream.INPUT)
    want = sorted((r.cap, r.digest) for r in replay.replay(df).where("event = 'capture'").collect())
    source, names = str(tmp_path / "in"), stream.INPUT
    df.where("cap <= 2").coalesce(1).write.parquet(source)
    live = stream.track(spark.readStream.schema(df.schema).parquet(source).select(*names))
    q = live.writeStream.format("memory").queryName("steps").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [r.cap for r in spark.table("steps").where("event = 'capture'").collect()] == [1]  # 2 may go on
        df.where("cap > 2").withColumn("last", F.col("cap") == 4).coalesce(1).write.mode("append").parquet(source)
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r.cap, r.digest) for r in spark.table("steps").where("event = 'capture'").collect())
    assert got == want


def test_empty_table_replays_to_nothing(spark):
    assert replay.replay(_frame(spark, [])).count() == 0


def line(i, top, text="some words here", left=0.0, width=200.0, height=20.0, lines=()):
    return Line(i, (left, float(top), left + width, float(top) + height), text, list(lines))


def test_paragraphs_follow_gaps_and_caps():
    found, told = paragraphs.group([line(i, t) for i, t in enumerate((0, 28, 56, 140, 168))])
    assert [[b.id for b in p] for p in found] == [[0, 1, 2], [3, 4]]
    assert [t[2] for t in told if not t[1]] == [["gap", "block_count"]]


def test_paragraph_guards():
    found, told = paragraphs.group([line(0, 0), line(1, 2, left=400.0), line(2, 300, height=0.0)])
    assert len(found) == 2 and ("inline_peer" in told[0][2]) and told[-1][2] == ["degenerate_box"]
    two = line(5, 0, "一。二", lines=[("一。", (0.0, 0.0, 50.0, 10.0)), ("二", (0.0, 10.0, 50.0, 20.0))])
    assert [[b.text for b in p] for p in paragraphs.group([two])[0]] == [["一。"], ["二"]]
    assert paragraphs.by_lines([two]) == [[two]] and paragraphs.group([]) == ([], [])
    with pytest.raises(ValueError):
        Knobs(times=0)


def test_bucket_policies():
    s = Session()
    assert replay.median_cells(s) is None
    s.step(page(5, height=60.0))
    assert replay.median_cells(s) == (120.0, 120.0)
    assert replay.viewport_cells(412, 3000)(s) == (80.0, 220.0)


def test_drift_rows_are_logged(spark):
    caps = [(1, page(6)), (2, page(6, 14.0, 100))]
    log = replay.replay(_frame(spark, caps), {"damp": Config(step="damp")}, policy=replay.median_cells)
    assert [(r.how, r.dy) for r in log.where("event = 'drift'").collect()] == [("normal:0", 14.0)]


def test_hooks():
    far = Session(Config(band_mode="admit", band_observations=1), spatial=lambda b, t: True, merger=lambda t, b, out: replace(out, srcq=99))
    far.step([block(1, 0, "abcdefghij")])
    far.step([block(2, 60, "abcdefWXYZ")], check=lambda b, t: True)
    assert far.tracks[0].provisional and far.tracks[0].srcq == 99
    near = Session(Config(band_mode="admit", band_observations=1))
    near.step([block(1, 0, "abcdefghij")])
    assert near.step([block(2, 60, "abcdefWXYZ")])["admitted"] == 1 and near.stats["spatial"] == 1
    checked = Session()
    checked.step([block(1, 0, "steady text")])
    assert checked.step([block(2, 1, "steady text")], check=lambda b, t: True)["invalidated"] == ["steady text"]


def test_hooks_spaces_logger_and_clock():
    class OneSpace(tracker.Spaces):
        size = 1000.0

        def key(self, b):
            return f"all:{int(b.rect[1] // self.size)}"

        def drifts(self, b):
            return b.id != 3

    said = []
    s = tracker.Session(spaces=OneSpace(), logger=said.append, clock=lambda: "noon")
    rows = lambda dy: [tracker.Block(i, (0.0, 100.0 * i + dy, 200.0, 100.0 * i + 20 + dy), f"line number {i} here", 0.9, 0.9) for i in range(6)]
    for k in range(4):
        s.step(rows(float(k)))
    assert set(s.drift.rings) == {"all:0"} and s.drift.total == 15
    assert said[0].startswith("step at noon: 0 merged, 6 admitted") and len(said) == 4
    s.drift.clear_region(0, 900)
    assert not s.drift.rings
    broken = tracker.Session(logger=lambda m: 1 / 0)
    broken.step(rows(0.0))
    assert broken.logger is None and len(broken.tracks) == 6


def test_grid_is_cleared_and_rebuilt():
    a, b = (tracker.Block(i, (0.0, 300.0 * i, 50.0, 300.0 * i + 20), "x", 0.5, 0.5) for i in range(2))
    grid = tracker.Grid(tracker.Config(), [a, b])
    grid.remove(a)
    assert grid.all == [b] and a not in grid.near(a)
    grid.rebuild([a], 80.0, 80.0)
    assert grid.all == [a] and grid.near(a) == [a] and grid.w == 80.0
    grid.clear()
    assert grid.all == [] and grid.near(a) == []


def test_lever_arguments():
    assert replay.parse_levers([]).adopt is False and replay.parse_levers(["--floor=390", "--adopt", "other"]) == tracker.Config(floor_px=390.0, adopt=True)
    assert replay.parse_levers(["--reanchor=2", "--reanchor=3"]).reanchor_blocks == 3
    for bad in ("--floor=0", "--floor", "--floor=nan", "--floor=inf", "--reanchor=x", "--reanchor=0", "--adopt=1"):
        with pytest.raises(ValueError):
            replay.parse_levers([bad])
    assert replay.bucket_policy("fixed") is None and replay.bucket_policy("median") is replay.median_cells and replay.bucket_policy("viewport:1000x1000")(None) == (180.0, 150.0)
    with pytest.raises(ValueError):
        replay.bucket_policy("viewport:-1x2")


def test_window_of_many_incoherent_movers_is_the_first_largest():
    import random
    import time

    rng = random.Random(4)
    make = lambda i, dy: (tracker.Block(i, (0.0, 1000.0 + dy, 100.0, 1020.0 + dy), "t", 0.9, 0.9), tracker.Block(-i - 1, (0.0, 1000.0, 100.0, 1020.0), "t", 0.9, 0.9))
    pairs = [make(i, rng.choice((-1, 1)) * rng.uniform(100, 900_000)) for i in range(1500)] + [make(9000 + i, 400.0 + i) for i in range(8)]
    began = time.perf_counter()
    assert tracker.Session(tracker.Config(min_share=0.0)).plan(pairs)["ty"] == 403.5
    assert time.perf_counter() - began < 20


def test_largest_firing_floor(spark):
    rows = []
    for cap in range(8):
        for i in range(3):
            y = 400.0 * i + (900.0 if cap >= 4 and i == 0 else 0.0)
            rows.append(("s", cap, i, 100 * cap + i, "page", -1, None, 0.0, 0.0, y, 200.0, y + 20, f"quite long line {i}", 0.9, 0.9, 0, 1, False))
    names = "session_id string, cap int, seq int, id long, kind string, hz int, cid string, inner_top double, l double, t double, r double, b double, text string, pconf double, tconf double, srcq int, obs int, provisional boolean"
    found = replay.largest_firing_floor(spark.createDataFrame(rows, names), 100, 1000)
    assert found is None or 100 <= found <= 1000

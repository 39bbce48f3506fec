"""Arms that share a state give what each gives alone, and reports ask for little of the log."""

import random

import pytest

from glyphtrail.plans import replay
from glyphtrail.plans import scalar as S
from glyphtrail.plans.tracker import Block, Session


def stream(seed):
    """Captures of one page whose rows are read with faults, jitter, jump, come and go."""
    rng = random.Random(seed)
    words = ["ladder", "needle", "ruler", "scanner", "字幕位置", "carousel", "fence", "bucket", "标题", "block"]
    page = [(20 + 300 * (i % 2), 30 + 45 * (i // 2), f"{rng.choice(words)} {rng.choice(words)} {rng.randrange(999)}") for i in range(14)]
    at, captures = 0, []
    for cap in range(24):
        jump = rng.choice([0, 0, 0, 130, 420]) if cap % 5 == 4 else 0
        page = [(x, y + jump, text) for x, y, text in page]
        rows = []
        for x, y, text in page:
            if rng.random() < 0.8:
                letters = list(text)
                for _ in range(rng.choice([0, 0, 1, 3, 7])):
                    letters[rng.randrange(len(letters))] = rng.choice("abx字0")
                dx, dy = rng.gauss(0, 3), rng.gauss(0, 3) + (60 if rng.random() < 0.06 else 0)
                at += 1
                rows.append(Block(at, (x + dx, y + dy, x + dx + 180, y + dy + rng.choice([16, 18, 34])), "".join(letters), rng.uniform(0.4, 1), rng.uniform(0.4, 1), hz=rng.choice([-1] * 9 + [1])))
        captures.append(rows if cap != 9 else [])
    return captures


@pytest.mark.parametrize("seed", range(6))
def test_shared_states_decide_as_single_arms(seed):
    captures, want, got, steps = stream(seed), {}, {}, 0
    for arm, config in replay.ARMS.items():
        session = Session(config)
        for cap, rows in enumerate(captures):
            want[arm, cap] = [*replay.log_rows("s", arm, cap, session.step([b.twin() for b in rows])), *replay.drift_rows(session, {"arm": arm})]
    for names in replay.families(replay.ARMS):
        family = replay.Family({a: replay.ARMS[a] for a in names})
        for cap, rows in enumerate(captures):
            for arms, session, result in family.step([b.twin() for b in rows]):
                steps += 1
                drifts = replay.drift_rows(session, {})
                for arm in arms:
                    assert (arm, cap) not in got
                    got[arm, cap] = [*replay.log_rows("s", arm, cap, result), *({**r, "arm": arm} for r in drifts)]
    assert got == want
    assert steps < len(want)


def test_a_calm_stream_is_stepped_once_for_a_family():
    rows = [Block(i, (10.0, 40.0 * i, 200.0, 40.0 * i + 18), f"row number {i} of the page", 0.9, 0.9) for i in range(8)]
    names = max(replay.families(replay.ARMS), key=len)
    family = replay.Family({a: replay.ARMS[a] for a in names})
    for _ in range(5):
        assert [sorted(arms) for arms, _, _ in family.step([b.twin() for b in rows])] == [sorted(names)]


def test_match_gives_up_no_pair_that_matches():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abcdĀ字") for _ in range(rng.randrange(14)))
        b = "".join(c if rng.random() < 0.8 else rng.choice("abeŁ字") for c in a)[rng.randrange(3) :] + rng.choice(["", "ab"])
        lev, jac = S.levenshtein_ratio(a, b), S.jaccard(a, b)
        want = lev if a and b and (lev >= 0.7 or jac >= 0.8) else None
        assert S.match(S.traits(a), S.traits(b), 0.7, 0.8) == want


# What of the log each report of the arms has no use for.
UNUSED = {
    "q_ab_bands": ("digest", "residual", "session_id", "top_lag"),
    "q_arm_digests": ("top_lag", "residual", "how", "dx"),
    "q_arm_summary": ("digest", "residual", "session_id", "dx"),
    "q_half_of_damp": ("digest", "residual", "how", "dx"),
    "q_step_rule": ("digest", "residual", "how", "dx"),
}


@pytest.mark.parametrize("name", UNUSED)
def test_a_report_asks_for_its_columns_and_equals_that_of_the_whole_log(spark, data, name):
    from glyphtrail import queries as tracker
    from glyphtrail.plans import reports

    got = tracker.QUERIES[name](spark, data)
    made = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "MapInArrow" in x]
    assert len(made) == 1, "a report that replays the sessions more than once"
    assert not any(f"{c}#" in line.partition("[")[2].partition("]")[0] for line in made for c in UNUSED[name])
    report = {"q_ab_bands": "displacement_bands", "q_arm_summary": "arm_summary", "q_arm_digests": "arm_digests", "q_half_of_damp": "half_of_damp", "q_step_rule": "step_rule"}[name]
    alone = None
    for arm, config in replay.ARMS.items():
        log = replay.replay(tracker._obs(spark, data), {arm: config}, tracker.table(spark, data, "captures"))
        alone = log if alone is None else alone.unionByName(log)
    whole = getattr(reports, report)(alone)
    assert got.columns == whole.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect()))

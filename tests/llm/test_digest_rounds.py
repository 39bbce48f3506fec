"""The rank bound holds however often a digest is compressed."""

import numpy as np
import pytest

from glyphtrail.llm import qdigest, queries


def test_inner_nodes_stay_within_the_share():
    rng, k, leaf = np.random.default_rng(1), 100, 1 << qdigest.BITS
    x, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _ in range(40):
        x, c = np.append(x, leaf + qdigest.quantize(rng.normal(0, 9, 2_000))), np.append(c, np.ones(2_000, np.int64))
        _, x, c = qdigest.compress(np.zeros(len(x), np.int64), x, c, k)
    n = int(c.sum())
    assert n == 80_000 and c[x < leaf].max() <= n // k and len(x) <= 4 * k + 1
    assert all(high - low <= qdigest.BITS * n / k for _, _, _, low, high in qdigest.ask(x, c))


@pytest.mark.parametrize("order", ["rising", "falling", "inside out", "one value"])
def test_rank_error_after_hundreds_of_rounds(order):
    k, leaf, rounds, each = qdigest.factor(0.01), 1 << qdigest.BITS, 220, 1_600
    values = np.sort(np.random.default_rng(2).lognormal(0, 3, rounds * each))
    fed = {"rising": values, "falling": values[::-1], "inside out": values[np.argsort(np.abs(np.arange(len(values)) - len(values) / 2))], "one value": np.ones(len(values))}[order]
    x, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in np.split(fed, rounds):
        x, c = np.append(x, leaf + qdigest.quantize(part)), np.append(c, np.ones(each, np.int64))
        _, x, c = qdigest.compress(np.zeros(len(x), np.int64), x, c, k)
    n, ranked = len(fed), np.sort(fed)
    cells = qdigest.quantize(ranked)
    for q, value, total, low, high in qdigest.ask(x, c):
        cell = qdigest.quantize(np.array([value]))[0]
        first, last = np.searchsorted(cells, cell, "left") + 1, np.searchsorted(cells, cell, "right")
        assert total == n and high - low <= 0.01 * n
        assert first - 0.01 * n <= q * n <= last + 0.01 * n, (order, q)


def test_stored_digests_roll_up_within_the_bound(spark, data):
    direct = {(r.scope, r.field_name, r.group_id, r.q): r for r in queries.QUERIES["p5_percentiles"](spark, data).where("scope <> 'session'").collect()}
    rolled = {(r.scope, r.field_name, r.day, r.q): r for r in queries.QUERIES["p5_rollup"](spark, data).collect()}
    assert direct.keys() == rolled.keys() and len(direct) > 20
    for key, r in rolled.items():
        assert r.n == direct[key].n and r.rank_high - r.rank_low <= 0.01 * r.n
        assert key[3] * r.n <= r.rank_high and key[3] * r.n <= direct[key].rank_high

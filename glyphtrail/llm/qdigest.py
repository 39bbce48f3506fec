"""Percentiles with deterministic rank error from digests that merge by addition.

A value is quantized to one of 2**BITS ordered cells: the leading bits of its IEEE
pattern, flipped so that cell order is value order. A digest holds counts of nodes of
the dyadic tree over the cells. Compression moves the counts of two siblings to their
parent while all three together hold at most n/k, so an inner node never holds more than
that, however often a digest is compressed: the rank error is at most BITS * n / k. A
digest has at most about 4k nodes.

Digests are rows (group..., node, count). Merging adds the counts of equal nodes, which
keeps the guarantee; the order of merging does not matter to it. Every task compresses
its own part before the shuffle; a group of any size is merged over salts first.

Defined results: nulls and NaN do not count; infinities count as the largest and
smallest cells; a group without any value has no row; a group of one value returns it
(within its cell, a relative width of 2**-19); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Depth of the dyadic tree: sign, 11 bits of exponent and 20 of fraction.
BITS = 32
#: Rank error at most, as a share of n.
EPSILON = 0.01
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def factor(epsilon: float = EPSILON) -> int:
    return int(np.ceil(BITS / epsilon))


def quantize(values: np.ndarray) -> np.ndarray:
    """Ordered cells 0 .. 2**BITS - 1 of float64 values; minus zero equals zero."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.uint64)
    flipped = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return (flipped >> np.uint64(64 - BITS)).astype(np.int64)


def cell_value(cells: np.ndarray) -> np.ndarray:
    """The middle of each cell; zero stays zero."""
    low = np.asarray(cells).astype(np.uint64) << np.uint64(64 - BITS)
    positive = (low >> np.uint64(63)).astype(bool)
    edge = np.where(positive, low ^ np.uint64(1 << 63), ~low)
    half = np.uint64(1 << (63 - BITS))
    zero = (edge == 0) | (~positive & (edge == np.uint64((1 << 64) - 1)))
    middle = np.where(positive, edge | half, edge ^ half)
    middle = np.where(zero, np.uint64(0), middle)
    out = middle.view(np.float64).copy()
    wild = ~np.isfinite(out)
    out[wild] = np.where(positive[wild], np.inf, -np.inf)
    return out


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed nodes of many digests at once.

    ``node`` numbers the tree like a heap: 1 is the root, 2x and 2x + 1 the children of
    x, leaves start at 2**BITS. ``group`` must be small whole numbers.
    """
    size = np.bincount(group, weights=count).astype(np.int64)
    limit = size // k
    keep: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = np.floor(np.log2(node.astype(np.float64))).astype(np.int64)
    g, x, c = group[:0], node[:0], count[:0]
    for level in range(BITS, 0, -1):
        here = depth == level
        g, x, c = np.concatenate([g, group[here]]), np.concatenate([x, node[here]]), np.concatenate([c, count[here]])
        if not len(x):
            continue
        order = np.lexsort((x, g))
        g, x, c = g[order], x[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]))
        g, x, c = g[first], x[first], np.add.reduceat(c, first)
        up = x >> 1
        pair = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (up[1:] != up[:-1])]))
        total = np.add.reduceat(c, pair)
        owner = np.repeat(np.arange(len(pair)), np.diff(np.concatenate([pair, [len(x)]])))
        above = depth == level - 1
        lift = total + _held(group[above], node[above], count[above], g[pair], up[pair]) <= limit[g[pair]]
        stay = ~lift[owner]
        keep.append((g[stay], x[stay], c[stay]))
        g, x, c = g[pair][lift], up[pair][lift], total[lift]
    top = depth == 0
    keep.append((np.concatenate([g, group[top]]), np.concatenate([x, node[top]]), np.concatenate([c, count[top]])))
    g, x, c = (np.concatenate(parts) for parts in zip(*keep))
    order = np.lexsort((x, g))
    g, x, c = g[order], x[order], c[order]
    if not len(x):
        return g, x, c
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]))
    return g[first], x[first], np.add.reduceat(c, first)


def _held(group: np.ndarray, node: np.ndarray, count: np.ndarray, g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What (group, node), which may repeat, hold at each (g, x)."""
    key, asked = (group.astype(np.int64) << (BITS + 1)) | node, (g.astype(np.int64) << (BITS + 1)) | x
    order = np.argsort(key, kind="stable")
    key, running = key[order], np.concatenate([[0], np.cumsum(count[order])])
    return running[np.searchsorted(key, asked, "right")] - running[np.searchsorted(key, asked, "left")]


def ask(node: np.ndarray, count: np.ndarray, quantiles: tuple[float, ...] = QUANTILES) -> list[tuple[float, float, int, int, int]]:
    """(quantile, value, n, lowest and highest possible rank of the value) of one digest."""
    depth = np.floor(np.log2(node.astype(np.float64))).astype(np.int64)
    span = BITS - depth
    high = ((node + 1) << span) - 1 - (1 << BITS)
    low = (node << span) - (1 << BITS)
    order = np.lexsort((-low, high))  # by upper edge, smaller nodes first
    running = np.cumsum(count[order])
    n = int(running[-1])
    out = []
    for q in quantiles:
        target = max(1, int(np.ceil(q * n)))
        cell = high[order][np.searchsorted(running, target)]
        value = float(cell_value(np.array([cell]))[0])
        sure = int(count[high <= cell].sum())
        maybe = int(count[(low <= cell) & (high > cell)].sum())
        out.append((q, value, n, sure, sure + maybe))
    return out


def build(values: DataFrame, keys: list[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """Digest rows (keys..., node, count) of the values of every group.

    Keys must be strings. Each task folds its rows into one digest per group and emits
    compressed nodes; equal nodes of several tasks are added after one shuffle.
    """
    k = factor(epsilon)
    number = F.col(value).cast("double")
    rows = values.select(*[F.col(x).cast("string").alias(x) for x in keys], number.alias("value")).where(number.isNotNull() & ~F.isnan(number))
    fold_at = 2_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            frame = batch.to_pandas()
            frame["node"] = quantize(frame.pop("value").to_numpy()) + (1 << BITS)
            frame = frame.groupby([*keys, "node"], dropna=False, sort=False).size().rename("count").reset_index()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) > fold_at:
                held = _shrink(held, keys, k)
                if len(held) > fold_at // 2:
                    yield _out(held, keys)
                    held = None
        if held is not None and len(held):
            yield _out(_shrink(held, keys, k), keys)

    schema = ", ".join([*(f"`{x}` string" for x in keys), "node long, count long"])
    return rows.mapInArrow(run, schema).groupBy(*keys, "node").agg(F.sum("count").alias("count"))


def _shrink(frame: pd.DataFrame, keys: list[str], k: int) -> pd.DataFrame:
    codes, uniques = pd.factorize(pd.MultiIndex.from_frame(frame[keys]))
    g, x, c = compress(codes.astype(np.int64), frame["node"].to_numpy(np.int64), frame["count"].to_numpy(np.int64), k)
    out = uniques.to_frame(index=False, name=keys).iloc[g].reset_index(drop=True)
    out["node"], out["count"] = x, c
    return out


def _out(frame: pd.DataFrame, keys: list[str]) -> pa.RecordBatch:
    types = [*([pa.string()] * len(keys)), pa.int64(), pa.int64()]
    columns = [frame[x].where(frame[x].notna(), None) if x in keys else frame[x] for x in [*keys, "node", "count"]]
    return pa.RecordBatch.from_arrays([pa.array(c.tolist() if t == pa.string() else c.to_numpy(), t) for c, t in zip(columns, types)], names=[*keys, "node", "count"])


def roll_up(digests: DataFrame, keys: list[str], salts: int = 32, epsilon: float = EPSILON) -> DataFrame:
    """Digests of coarser groups: ``keys`` is a part of the key columns, or empty.

    Nodes are added, then compressed once per salt and once per group, so that no task
    holds more than the nodes of one salt.
    """
    k = factor(epsilon)
    named = keys or ["_all"]
    rows = digests if keys else digests.withColumn("_all", F.lit("all"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "count"]), F.lit(salts)).cast("string"))
    for by in ([*named, "_salt"], named):
        salted = _squeeze(salted.groupBy(*by, "node").agg(F.sum("count").alias("count")), by, k)
    return salted if keys else salted.drop("_all")


def _squeeze(digests: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Every group compressed on its own; groups are read as runs of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            # All groups but the last one read are whole.
            last = held[keys].iloc[-1]
            open_rows = np.logical_and.reduce([(held[x] == last[x]) | (held[x].isna() & pd.isna(last[x])) for x in keys])
            whole = held[~open_rows]
            if len(whole) > 100_000:
                yield _out(_shrink(whole, keys, k), keys)
                held = held[open_rows]
            elif len(held) > 2_000_000:
                held = _shrink(held, keys, k)
        if held is not None and len(held):
            yield _out(_shrink(held, keys, k), keys)

    schema = ", ".join([*(f"`{x}` string" for x in keys), "node long, count long"])
    return digests.select(*keys, "node", "count").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def percentiles(digests: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Rows (keys..., q, value, n, rank_low, rank_high) of every digest."""
    named = keys or ["_all"]
    rows = digests if keys else digests.withColumn("_all", F.lit("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held[named].iloc[-1]
            open_rows = np.logical_and.reduce([(held[x] == last[x]) | (held[x].isna() & pd.isna(last[x])) for x in named])
            if not open_rows.all():
                yield answers(held[~open_rows])
                held = held[open_rows]
        if held is not None and len(held):
            yield answers(held)

    def answers(frame: pd.DataFrame) -> pa.RecordBatch:
        out = []
        for name, part in frame.groupby(named, dropna=False, sort=False):
            for row in ask(part["node"].to_numpy(np.int64), part["count"].to_numpy(np.int64), quantiles):
                out.append((*(None if pd.isna(x) else x for x in name), *row))
        types = [*([pa.string()] * len(named)), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*named, "q", "value", "n", "rank_low", "rank_high"])

    schema = ", ".join([*(f"`{x}` string" for x in named), "q double, value double, n long, rank_low long, rank_high long"])
    out = rows.select(*named, "node", "count").repartition(*named).sortWithinPartitions(*named).mapInArrow(run, schema)
    return out if keys else out.drop("_all")


#: Between the parts of a group's key, and in place of a null part.
_CUT, _NULL = "\x1f", "\x00"
#: Nodes of one key that a task holds before it compresses them.
MAX_RUN = 2_000_000


class _Folder:
    """Counts of (group, node) of one task, compressed whenever they grow large."""

    def __init__(self, k: int, limit: int = 2_000_000) -> None:
        self.k, self.limit, self.names, self.parts, self.size = k, limit, {}, [], 0

    def add(self, group: np.ndarray, node: np.ndarray, count: np.ndarray | None = None) -> None:
        order = np.lexsort((node, group))
        g, x = group[order], node[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])]))
        counts = np.diff(np.append(first, len(g))) if count is None else np.add.reduceat(count[order], first)
        self.parts.append((g[first], x[first], counts))
        self.size += len(first)
        if self.size > self.limit:
            folded = self.fold()
            self.parts, self.size = [folded], len(folded[0])
            self.limit = max(self.limit, 2 * self.size)

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return compress(*(np.concatenate(p) for p in zip(*self.parts)), self.k)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        g, x, c = self.fold()
        names = pa.array(list(self.names), pa.string())
        for at in range(0, len(g), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(g[part])), pa.array(x[part]), pa.array(c[part].astype(np.int64))], names=["key", "node", "count"])


def build_scopes(values: DataFrame, base: list[str], scopes: dict[str, str | None], value: str, epsilon: float = EPSILON) -> DataFrame:
    """Partial digests (key, node, count) of several groupings in one pass over the rows.

    A group is a scope's name, the ``base`` columns and the scope's own column, if any.
    Every task folds its rows into all scopes and emits compressed nodes, so a coarse
    group costs at most about 4k nodes a task, however many rows it has.
    """
    k = factor(epsilon)
    extra = [c for c in scopes.values() if c]
    columns = [*base, *extra]
    number = F.col(value).cast("double")
    rows = values.select(*[F.coalesce(F.col(c).cast("string"), F.lit(_NULL)).alias(c) for c in columns], number.alias("value")).where(number.isNotNull() & ~F.isnan(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = _Folder(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            node = quantize(batch.column(len(columns)).to_numpy(zero_copy_only=False)) + (1 << BITS)
            coded = {c: batch.column(i).dictionary_encode() for i, c in enumerate(columns)}
            code = {c: (a.indices.to_numpy(zero_copy_only=False).astype(np.int64), a.dictionary.to_pylist()) for c, a in coded.items()}
            for scope, own in scopes.items():
                used = [*base, *([own] if own else [])]
                joint = np.zeros(len(node), np.int64)
                for c in used:
                    joint = joint * len(code[c][1]) + code[c][0]
                _, spot, back = np.unique(joint, return_index=True, return_inverse=True)
                ids = [folder.names.setdefault(_CUT.join([scope, *(code[c][1][code[c][0][i]] for c in used)]), len(folder.names)) for i in spot]
                folder.add(np.array(ids, np.int64)[back], node)
        yield from folder.batches()

    return rows.mapInArrow(run, "key string, node long, count long")


def _by_runs(batches: Iterator[pa.RecordBatch], k: int, limit: int | None = None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, group numbers, nodes, counts) of whole runs of equal keys, in row order.

    Rows may be sorted by something before the key: a key then comes in several runs.
    Only the run that is still open is held between batches, so all held rows have one
    key; a run of more than ``limit`` (else ``MAX_RUN``) nodes is compressed as it is read.
    """
    limit = MAX_RUN if limit is None else limit
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array(batch.column(0).to_pylist(), object)
        held.append((key, batch.column(1).to_numpy(), batch.column(2).to_numpy()))
        if held[0][0][0] != key[-1] or (key != key[-1]).any():
            key, node, count = (np.concatenate(p) for p in zip(*held))
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield _numbered(key[:whole], node[:whole], count[:whole])
            held = [(key[whole:], node[whole:], count[whole:])]
        if (size := sum(len(h[1]) for h in held)) > limit:
            _, x, c = compress(np.zeros(size, np.int64), *(np.concatenate(p) for p in zip(*(h[1:] for h in held))), k)
            held = [(np.full(len(x), key[-1], object), x, c)]
    if held:
        yield _numbered(*(np.concatenate(p) for p in zip(*held)))


def _numbered(key: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    start = np.concatenate([[True], key[1:] != key[:-1]])
    return key[start].tolist(), np.cumsum(start) - 1, node, count


def scoped_percentiles(partials: DataFrame, names: list[str], quantiles: tuple[float, ...] = QUANTILES, salts: int = 16, epsilon: float = EPSILON) -> DataFrame:
    """Rows (scope, names..., q, value, n, rank_low, rank_high) of partial digests.

    ``names`` label the parts of a key after its scope; scopes without their own column
    get 'all' there. Partials of a group are added and compressed per salt first, so that
    the last step reads at most ``salts`` compressed digests of one group.
    """
    k = factor(epsilon)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, g, x, c in _by_runs(batches, k):
            g, x, c = compress(g, x, c, k)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(pa.array(g)), pa.array(x), pa.array(c.astype(np.int64))], names=["key", "node", "count"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, g, x, c in _by_runs(batches, k):
            at = np.searchsorted(g, np.arange(len(keys) + 1))
            rows = [(key, *row) for i, key in enumerate(keys) for row in ask(x[at[i] : at[i + 1]], c[at[i] : at[i + 1]], quantiles)]
            types = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), types)], names=["key", "q", "value", "n", "rank_low", "rank_high"])

    salt = F.pmod(F.xxhash64("node"), F.lit(salts))
    placed = partials.withColumn("salt", salt).repartition("key", "salt").sortWithinPartitions("salt", "key").select("key", "node", "count")
    merged = placed.mapInArrow(squeeze, "key string, node long, count long")
    rows = merged.repartition("key").sortWithinPartitions("key").mapInArrow(answer, "key string, q double, value double, n long, rank_low long, rank_high long")
    part = F.split("key", _CUT)
    pick = [F.coalesce(F.get(part, F.lit(i + 1)), F.lit("all")).alias(n) for i, n in enumerate(names)]
    return rows.select(F.get(part, F.lit(0)).alias("scope"), *[F.nullif(p, F.lit(_NULL)).alias(n) for p, n in zip(pick, names)], "q", "value", "n", "rank_low", "rank_high")

"""Near-duplicate records by a token-group matrix.

Similar documents are brought together first: the tokens of a record are ordered from
rare to common, by counts of the whole collection, and two sets of the wanted similarity
share at least one of their first few tokens. A record goes to the partition of each of
these tokens, with its rectangle, its size and a bit set of its tokens. A partition, in
the order of the tops of its rectangles, is cut into groups of neighbours, and the matrix
keeps the token union of every group as a bit set. A record queries the groups whose tops
can overlap it: the bits it has and a union lacks bound its overlap with every member,
and only groups whose bound still reaches the wanted similarity are opened. Members are
tested by the token's position, the rectangle and their own bits; the pairs left are
verified with the whole token sets.

The order by rarity keeps partitions small where the data grow: words of a third of all
records are no one's rare tokens unless the record has no others. A partition of more
than ``HOT`` records is cut by rectangle cells, and a cell of more than ``HOT`` by id
(:mod:`placement`). Counts are kept in ``COUNTERS`` hashed counters, so what the driver
holds and sends to the tasks has a fixed size; the order need only be the same for all.

Nothing is skipped: there is no cap on groups, members or partners.

Defined results: null and blank texts and texts without letters or digits are in no
pair; records with a null or unsound rectangle are in no pair; equal records form pairs
like others in :func:`similar_pairs`; in :func:`classes_of` they are one representative
first and share its class; empty tables give empty results. Ids must be unique whole
numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphtrail.context import cut_lineage

from . import placement

SIMILARITY = 0.7
MIN_OVERLAP = 0.5
#: Members of a group of the matrix, and 64-bit words of a bit set of tokens.
GROUP, WORDS = 8, 4
#: Records of one token partition before it is cut by cells.
HOT = 20_000
#: Hashed token counters: 512 KiB in the driver and in each task.
COUNTERS = 1 << 16
#: Row by group or row by member tests that a task makes at a time.
_STEP = 2_000_000

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def token_set(text: str | None) -> list[int]:
    """Sorted 63-bit hashes of the lower-case runs of letters and digits."""
    return sorted({xxhash.xxh64_intdigest(w) >> 1 for w in _WORD.findall((text or "").lower())})


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def _need(similarity: float, size: np.ndarray) -> np.ndarray:
    """The least overlap of a set of ``size`` with any similar one."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of the ranges first .. first + count, one after the other."""
    owner = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return owner, np.arange(len(owner)) - before[owner] + first[owner]


def _lacking(bits: list[np.ndarray], q: np.ndarray, other: list[np.ndarray], g: np.ndarray) -> np.ndarray:
    """How many bits of row q the bit set g of ``other`` lacks."""
    out = np.zeros(len(q), np.int64)
    for b, o in zip(bits, other):
        out += np.bitwise_count(b[q] & ~o[g])
    return out


class TokenGroupMatrix:
    """Groups of the inhabitants of many partitions, with the token union of each.

    ``rows`` has the columns of :func:`_place` as arrays, sorted by partition, side and
    top; ``start`` has the first row of every partition.
    """

    def __init__(self, rows: dict[str, np.ndarray], start: np.ndarray, similarity: float, group: int = GROUP) -> None:
        self.rows, self.similarity, self.start = rows, similarity, start
        self.end = np.append(start[1:], len(rows["id"]))
        living = np.add.reduceat((rows["side"] == 0).astype(np.int64), start)
        self.visited = self.end - start > living
        groups = -(-living // group)
        owner, number = _expand(np.zeros(len(groups), np.int64), groups)
        self.low = start[owner] + number * group
        self.size = np.minimum(group, living[owner] - number * group)
        self.first = np.cumsum(groups) - groups
        self.groups, self.group = groups, group
        _, member = _expand(self.low, self.size)
        at = np.cumsum(self.size) - self.size
        self.bits = [rows[f"b{i}"] for i in range(WORDS)]
        self.union = [np.bitwise_or.reduceat(b[member], at) if len(at) else b[:0] for b in self.bits]
        self.smallest = np.minimum.reduceat(rows["n"][member], at) if len(at) else rows["n"][:0]
        self.top, self.bottom = rows["y0"][self.low], rows["y0"][self.low + self.size - 1]

    def _reach(self, asks: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first group, number of groups) in which a row's partners can be.

        Partners have tops within the row's height: theirs is at most twice as high, and
        tops of partners are at most half the greater height apart. Where nobody visits,
        inhabitants query their own and the later groups, which finds each pair once.
        """
        rows, p = self.rows, part[asks]
        visitor = rows["side"][asks] > 0
        low = np.where(visitor, 0, (asks - self.start[p]) // self.group)
        high = self.groups[p].copy()
        y, tall = rows["y0"][asks], (rows["y1"][asks] - rows["y0"][asks]) * (1 + 1e-9)
        for k in np.flatnonzero(self.groups > 4):
            a, b = np.searchsorted(p, [k, k + 1])
            g = slice(self.first[k], self.first[k] + self.groups[k])
            low[a:b] = np.maximum(low[a:b], np.searchsorted(self.bottom[g], y[a:b] - tall[a:b], "left"))
            high[a:b] = np.searchsorted(self.top[g], y[a:b] + tall[a:b], "right")
        return self.first[p] + low, np.maximum(high - low, 0)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids (a < b) of the pairs that may be similar and overlap enough."""
        rows, s = self.rows, self.similarity
        part = np.repeat(np.arange(len(self.start)), self.end - self.start)
        asks = np.flatnonzero((rows["side"] > 0) | ~self.visited[part])
        first, count = self._reach(asks, part)
        for low, high in _steps(count):
            q, g = _expand(first[low:high], count[low:high])
            q = asks[low:high][q]
            n = rows["n"][q]
            need = np.maximum(_need(s, n), _need(s / (1 + s), n + self.smallest[g]))
            keep = n - _lacking(self.bits, q, self.union, g) >= need
            q, g = q[keep], g[keep]
            for a, b in _steps(self.size[g]):
                owner, m = _expand(self.low[g[a:b]], self.size[g[a:b]])
                yield self._members(q[a:b][owner], m)

    def _members(self, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, s = self.rows, self.similarity
        ids, side = r["id"], r["side"]
        # Inside a cell both sides visit, across cells one does: each pair once.
        keep = np.where(side[q] == 0, m > q, np.where(side[q] == 2, ids[m] > ids[q], ids[m] != ids[q]))
        q, m = q[keep], m[keep]
        n, k = r["n"][q], r["n"][m]
        need = _need(s / (1 + s), n + k)
        # At the first token they share, no more are to come than either has left.
        left = np.minimum(n - r["pos"][q], k - r["pos"][m])
        keep = (left >= need) & (np.minimum(n, k) >= s * np.maximum(n, k) - 1e-9)
        q, m, n, k, need = (x[keep] for x in (q, m, n, k, need))
        w = np.minimum(r["x1"][q], r["x1"][m]) - np.maximum(r["x0"][q], r["x0"][m])
        h = np.minimum(r["y1"][q], r["y1"][m]) - np.maximum(r["y0"][q], r["y0"][m])
        both = np.clip(w, 0, None) * np.clip(h, 0, None)
        area = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
        keep = both >= MIN_OVERLAP * (area[q] + area[m] - both)
        q, m, n, k, need = (x[keep] for x in (q, m, n, k, need))
        keep = np.minimum(n - _lacking(self.bits, q, self.bits, m), k - _lacking(self.bits, m, self.bits, q)) >= need
        q, m = q[keep], m[keep]
        return np.minimum(ids[q], ids[m]), np.maximum(ids[q], ids[m])


def _steps(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of owners whose counts add up to about ``_STEP``."""
    reach, low = np.cumsum(count), 0
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(reach, (reach[low - 1] if low else 0) + _STEP, "right")))
        yield low, high
        low = high


_PLACED = {"id": "long", "n": "int", "pos": "int", "x0": "double", "y0": "double", "x1": "double", "y1": "double", **{f"b{i}": "long" for i in range(WORDS)}}


def _match(similarity: float):
    """Candidates of whole partitions; of a visited one in pieces, with all inhabitants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            changed = (rows["cell"][1:] != rows["cell"][:-1]) | (rows["part"][1:] != rows["part"][:-1])
            start = np.concatenate([[0], np.flatnonzero(changed) + 1])
            for a, b in TokenGroupMatrix(rows, start, similarity).candidates():
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            for c in (f"b{i}" for i in range(WORDS)):
                new[c] = new[c].view(np.uint64)
            for c in ("n", "pos"):
                new[c] = new[c].astype(np.int64)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in held}
            last = (held["cell"] == held["cell"][-1]) & (held["part"] == held["part"][-1])
            open_at = int(np.argmax(last))
            if open_at:
                yield from pairs({c: v[:open_at] for c, v in held.items()})
                held = {c: v[open_at:] for c, v in held.items()}
            elif len(last) > 4 * HOT and held["side"][-1] > 0:
                yield from pairs(held)
                living = held["side"] == 0
                held = {c: v[living] for c, v in held.items()}
        # Inhabitants that are left without visitors here have met all of theirs.
        if held is not None and len(held["id"]):
            yield from pairs(held)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        if len(known) > 1_000_000:
            known.clear()
        sets = []
        for t in batch.column(1).to_pylist():
            words = set(_WORD.findall(t.lower()))
            for w in words.difference(known):
                known[w] = xxhash.xxh64_intdigest(w) >> 1
            sets.append(sorted({known[w] for w in words}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64())), *batch.columns[2:]], names=["id", "toks", *batch.schema.names[2:]])


def _token_counts(rows: DataFrame) -> np.ndarray:
    """How many records have a token of each hashed counter: ``COUNTERS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() % COUNTERS, minlength=COUNTERS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["counter", "n"])

    counted = rows.select("toks").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[counted.column("counter").to_numpy()] = counted.column("n").to_numpy()
    return out


def _place(counts, similarity: float, above: int = -1):  # noqa: ANN001
    """A row for each of the first tokens of a record, in the order of all tokens.

    Only for tokens whose counter is over ``above``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            tok = lists.flatten().to_numpy()
            start = np.cumsum(n) - n
            if not len(tok):
                continue
            row = np.repeat(np.arange(len(n)), n)
            mixed = (tok.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (tok.astype(np.uint64) >> np.uint64(31))
            bit = ((mixed >> np.uint64(20)) % np.uint64(64 * WORDS)).astype(np.int64)
            one = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
            bits = [np.bitwise_or.reduceat(np.where(bit >> 6 == i, one, np.uint64(0)), start).view(np.int64) for i in range(WORDS)]
            seen = counts.value[tok % COUNTERS]
            order = np.lexsort((tok, seen, row))
            place = np.arange(len(tok)) - start[row]
            early = (place < (n - _need(similarity, n) + 1)[row]) & (seen[order] > above)
            tok, row, place = tok[order][early], row[early], place[early]
            values = {"tok": tok, "n": n[row].astype(np.int32), "pos": place.astype(np.int32), **{f"b{i}": b[row] for i, b in enumerate(bits)}}
            take = pa.array(row)
            values |= {c: batch.column(batch.schema.get_field_index(c)).take(take) for c in ("id", "x0", "y0", "x1", "y1")}
            names = ["tok", *_PLACED]
            yield pa.RecordBatch.from_arrays([values[c] if isinstance(values[c], pa.Array) else pa.array(values[c]) for c in names], names=names)

    return run


def _partitions(rows: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Rows (cell, part, side, ...) of the token partitions; hot ones cut by rectangle."""
    counts = rows.sparkSession.sparkContext.broadcast(_token_counts(rows))
    schema = "tok long, " + ", ".join(f"{c} {t}" for c, t in _PLACED.items())
    placed = rows.mapInArrow(_place(counts, similarity), schema)
    # A counter is at least the size of its tokens' partitions: only the others are counted.
    crowded = placement.crowded(rows.mapInArrow(_place(counts, similarity, hot), schema), "tok", hot) if counts.value.max() > hot else None
    if crowded is None:
        return placed.withColumnRenamed("tok", "cell").withColumn("part", F.lit(0)).withColumn("side", F.lit(0))
    flagged = placed.join(crowded.select("tok", F.lit(True).alias("hot")), "tok", "left")
    calm = flagged.where("hot is null").select(F.col("tok").alias("cell"), F.lit(0).alias("part"), F.lit(0).alias("side"), *_PLACED)
    # Written once: it is counted, and read for inhabitants and visitors.
    busy = cut_lineage(flagged.where("hot").drop("hot"))
    living = placement.home(busy, ["tok"]).withColumn("own", F.lit(False))
    visiting = placement.visits(placement.home(busy, ["tok"]).withColumnRenamed("cell", "mine"), ["tok"], upward=True).withColumn("own", F.col("cell") == F.col("mine"))
    met = placement.spread(living.drop("tok"), visiting.drop("tok", "mine"), "id", hot)
    return calm.unionByName(met.withColumn("side", F.when(F.col("own"), 2).otherwise(F.col("side"))).drop("own"))


def token_rows(records: DataFrame, row_id: str, text: str, rect: str) -> DataFrame:
    """(id, toks, edges) of the records that can be in a pair."""
    rows = records.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("s"), *placement.edges(rect)).where(placement.solid() & F.col("s").isNotNull())
    return rows.mapInArrow(_tokens, "id long, toks array<long>, x0 double, y0 double, x1 double, y1 double").where(F.size("toks") > 0)


def similar_rows(rows: DataFrame, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Pairs (a < b) of written :func:`token_rows` that overlap and are similar enough."""
    parts = _partitions(rows, similarity, hot)
    placed = parts.repartition("cell", "part").sortWithinPartitions("cell", "part", "side", "y0").select("cell", "part", "side", *_PLACED)
    maybe = placed.mapInArrow(_match(similarity), "a long, b long").distinct()
    left = rows.select(F.col("id").alias("a"), F.col("toks").alias("left"))
    right = rows.select(F.col("id").alias("b"), F.col("toks").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    share = both / (F.size("left") + F.size("right") - both)
    return maybe.join(left, "a").join(right, "b").where(share >= similarity).select("a", "b")


def similar_pairs(records: DataFrame, *, row_id: str, text: str, rect: str, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Pairs (a < b) of records that overlap enough and whose words are similar enough."""
    return similar_rows(cut_lineage(token_rows(records, row_id, text, rect)), similarity, hot)


def classes_of(records: DataFrame, *, row_id: str, text: str, rect: str, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) of every record: the smallest id it is linked with, directly or not.

    Records of equal words and rectangle are one representative before any pairing, so a
    group of copies of any size costs one record.
    """
    rows = token_rows(records, row_id, text, rect)
    same = [F.xxhash64("toks").alias("k0"), F.xxhash64(F.lit(1), "toks").alias("k1"), "x0", "y0", "x1", "y1"]
    keyed = cut_lineage(rows.select("id", "toks", *same))
    key = ["k0", "k1", "x0", "y0", "x1", "y1"]
    lead = keyed.groupBy(*key).agg(F.min(F.struct("id", "toks")).alias("lead"), F.count(F.lit(1)).alias("copies"))
    lead = cut_lineage(lead.select("lead.id", "lead.toks", "copies", *key))
    links = classes(similar_rows(lead.select("id", "toks", "x0", "y0", "x1", "y1"), similarity))
    copies = keyed.join(lead.where("copies > 1").select(F.col("id").alias("lead"), *key), key).select("id", "lead")
    own = records.select(F.col(row_id).cast("long").alias("id")).join(copies, "id", "left").withColumn("lead", F.coalesce("lead", "id"))
    return own.join(links.withColumnRenamed("id", "lead"), "lead", "left").select("id", F.coalesce("class_id", "lead").alias("class_id"))


def classes(pairs: DataFrame) -> DataFrame:
    """(id, class_id) of every record in some pair; the class is its smallest id.

    Connected components by alternating large-star and small-star steps; each step is
    one aggregation, and lineage is cut in the shared checkpoint folder.
    """
    links = cut_lineage(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut_lineage(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        if not after.exceptAll(links).limit(1).count() and not links.exceptAll(after).limit(1).count():
            break
        links = after
    members = links.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
    return members.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())

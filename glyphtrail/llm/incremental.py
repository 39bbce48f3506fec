"""Check new batches of blocks against everything accepted so far.

Segment index for edit distance: a stored text of length n is cut into n // 4 + 1
segments, kept by (length, segment number, segment). If two texts are within an edit
distance of a fifth of the longer one, at least one segment of the stored text occurs
unchanged in the new text, shifted by no more than the distance left over. So a new text
looks up only the substrings at those places, and the few texts found are verified by
rectangle and by bounded edit distance. Accepted rows append their segments.

:class:`HistoryIndex` keeps the index in shared storage: every accepted row once, with
the hashes of its segments in order, in buckets of rectangle cells (:mod:`placement`).
Segments are cut and hashed once, when a row is accepted. A batch reads the buckets it
visits, keeps the stored rows of the cells it visits by a semi-join, and only those are
moved. Rows that match the history are decided there. The rest are taken in order of
arrival within connected bands of their capture, since whether a row is accepted depends
on the ones before it. The accepted rows of the batch are appended; nothing is rewritten.

Defined results: a row with a null or blank text, a null or unsound rectangle, a null
session or a null capture is accepted and matches nothing; repeated rows match their
first occurrence; an empty history leaves only matches among the new rows; an empty
batch gives no rows. The id must rise with arrival and be unique.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphtrail.context import cut_lineage, ensure_checkpoint_dir

from . import placement

#: An edit distance of at most 1 / SHARE of the longer text.
SHARE = 5
MIN_OVERLAP = 0.5
#: Visited cells that may be broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, end) of the segments of a text of length ``n``, as even as possible."""
    parts = n // (SHARE - 1) + 1
    size, more = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        end = at + size + (i >= parts - more)
        if end > at:
            out.append((at, end))
        at = end
    return out


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, or ``most`` + 1 if it is larger (bit-parallel)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for j, c in enumerate(b):
        match = masks.get(c, 0)
        d = ((((match & plus) + plus) ^ plus) | match) | minus
        hp, hm = minus | ~(d | plus), plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return most + 1
        hp = (hp << 1) | 1
        plus, minus = ((hm << 1) | ~(d | hp)) & full, hp & d & full
    return score


def segment_hash(segment: str) -> int:
    return xxhash.xxh64_intdigest(segment.encode("utf-8", "surrogatepass")) >> 1


@lru_cache(maxsize=4096)
def _places(n: int) -> list[tuple[int, int]]:
    return cuts(n)


def segments(text: str) -> list[int]:
    """The hashes of the segments of a text, in order."""
    n = len(text)
    return [segment_hash(text[a:b]) for a, b in (_places(n) if n < 1000 else cuts(n))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [segments(s) for s in batch.column("s").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.list_(pa.int64()))], names=[*batch.schema.names, "segs"])


class SegmentIndex:
    """Texts with rectangles, found again by segments."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, tuple]] = []
        self.by: dict[tuple[int, int, int], list[int]] = {}
        self.lengths: set[int] = set()

    def add(self, text: str, rect: tuple, hashes: list[int] | None = None) -> None:
        n = len(text)
        self.lengths.add(n)
        for i, h in enumerate(segments(text) if hashes is None else hashes):
            self.by.setdefault((n, i, h), []).append(len(self.rows))
        self.rows.append((text, rect))

    def near(self, text: str, rect: tuple) -> bool:
        """Whether some stored row is within the distance and overlaps enough."""
        size, known = len(text), {}
        for n in self.lengths:
            most = max(n, size) // SHARE
            shift = size - n
            if abs(shift) > most:
                continue
            seen: set[int] = set()
            low, high = (most - shift) // 2, (most + shift) // 2
            for i, (a, b) in enumerate(cuts(n)):
                for at in range(max(0, a - low), min(size - (b - a), a + high) + 1):
                    spot = (at, b - a)
                    h = known.get(spot)
                    if h is None:
                        h = known[spot] = segment_hash(text[at : at + b - a])
                    for r in self.by.get((n, i, h), ()):
                        if r in seen:
                            continue
                        seen.add(r)
                        other, place = self.rows[r]
                        if placement.overlap(rect, place) >= MIN_OVERLAP and edit_distance(other, text, most) <= most:
                            return True
        return False


def _rows(df: DataFrame, row_id: str, key: list[str], text: str, rect: str) -> DataFrame:
    visible = F.col("s").isNotNull() & F.col("s").rlike(r"(?U)[^\s]")
    named = df.select(F.col(row_id).cast("long").alias("id"), F.xxhash64(*key, F.lit(7)).alias("scope"), F.col(text).alias("s"), *placement.edges(rect), *[F.col(k).isNotNull().alias(f"_has{i}") for i, k in enumerate(key)])
    for i in range(len(key)):
        named = named.where(f"_has{i}").drop(f"_has{i}")
    return named.where(visible & placement.solid())


_FIELDS = ("id", "scope", "s", "x0", "y0", "x1", "y1")
_STORED = "cell long, id long, scope long, s string, x0 double, y0 double, x1 double, y1 double, segs array<long>"


def _match_history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[int] = []
    indexed, indexes = None, {}
    for _, living, visiting in placement.runs(batches, ("cell", "part"), (*_FIELDS, "segs")):
        if not living:
            continue
        if living is not indexed:
            indexed, indexes = living, {}
            for row in living:
                indexes.setdefault(row[1], SegmentIndex()).add(row[2], row[3:7], row[7])
        for row in visiting:
            index = indexes.get(row[1])
            if index and index.near(row[2], row[3:7]):
                found.append(row[0])
        if len(found) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])
            found = []
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])


def _match_arrivals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, index = None, SegmentIndex()
    for batch in batches:
        found = []
        for band, *row in zip(batch.column("band").to_pylist(), *(batch.column(c).to_pylist() for c in _FIELDS)):
            here = (row[1], band)
            if here != at:
                at, index = here, SegmentIndex()
            place = tuple(row[3:])
            if index.near(row[2], place):
                found.append(row[0])
            else:
                index.add(row[2], place)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])


def match_arrivals(new: DataFrame) -> DataFrame:
    """Ids of rows that match an earlier row of ``new`` that was itself accepted.

    Rows whose vertical extents do not touch cannot match, so each capture is cut into
    bands of touching extents first; bands are independent of each other.
    """
    order = Window.partitionBy("scope").orderBy("y0", "id")
    reach = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("y0") >= reach), 1).otherwise(0)
    banded = new.withColumn("start", starts).withColumn("band", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = banded.repartition("scope", "band").sortWithinPartitions("scope", "band", "id")
    return placed.select("band", *_FIELDS).mapInArrow(_match_arrivals, "id long")


def repeated_rows(new: DataFrame, history: DataFrame, *, key: list[str], new_id: str, history_id: str, text: str, rect: str, batch: str | None = None) -> DataFrame:
    """Ids (as ``new_id``) of new rows that repeat a row accepted before them.

    The history is put into a new :class:`HistoryIndex` in the checkpoint folder, then
    the batches named by the column ``batch`` are taken in turn, by their smallest id; a
    batch must arrive as a whole before the next. Without it all new rows are one batch.
    """
    spark = new.sparkSession
    ensure_checkpoint_dir(spark)
    index = HistoryIndex(f"{spark.sparkContext.getCheckpointDir()}/segments-{uuid.uuid4().hex}")
    index.append(_rows(history, history_id, key, text, rect))
    if batch is None:
        return index.check(new, key=key, new_id=new_id, text=text, rect=rect)
    turns = new.groupBy(batch).agg(F.min(new_id).alias("turn")).orderBy("turn").collect()  # one row a batch
    found = [index.check(new.where(F.col(batch).eqNullSafe(F.lit(r[0]))), key=key, new_id=new_id, text=text, rect=rect) for r in turns]
    out = found[0] if found else index.check(new.limit(0), key=key, new_id=new_id, text=text, rect=rect)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class HistoryIndex:
    """The segment index of all accepted rows in a folder of shared storage.

    A row is stored with the cell it lives in and the hashes of its segments, in
    ``buckets`` partitions by scope, sorted by cell. Checking a batch reads the
    partitions it visits. Each batch appends its accepted rows and never rewrites what
    is there. Give few buckets to a small history, more to a large one: a bucket is what
    a batch can leave unread.
    """

    def __init__(self, folder: str, buckets: int = 16) -> None:
        self.folder, self.buckets = folder, buckets

    def _bucket(self, scope: str) -> Column:
        return F.pmod(F.xxhash64(scope), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame) -> None:
        """Store accepted rows, as from ``_rows``; crowded buckets are written by several tasks."""
        placed = placement.home(rows, ["scope"]).withColumn("bucket", self._bucket("scope")).hint("rebalance", "bucket")
        ordered = placed.sortWithinPartitions("bucket", "cell").select("bucket", "cell", *_FIELDS)
        ordered.mapInArrow(_cut, f"bucket int, {_STORED}").write.mode("append").partitionBy("bucket").parquet(self.folder)

    def _stored(self, spark: SparkSession) -> DataFrame | None:
        """What is stored; None only if there is no folder.

        The schema is given, so that an empty folder has no rows and unreadable files fail.
        """
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema(f"{_STORED}, bucket int").parquet(self.folder)

    def visited(self, visiting: DataFrame) -> DataFrame | None:
        """The stored rows of the cells that ``visiting`` looks into; None for no folder."""
        stored = self._stored(visiting.sparkSession)
        if stored is None:
            return None
        buckets = [r[0] for r in visiting.select(self._bucket("scope")).distinct().collect()]  # at most ``buckets``
        cells = cut_lineage(visiting.select("cell").distinct())
        if cells.count() <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        return stored.where(F.col("bucket").isin(buckets)).drop("bucket").join(cells, "cell", "left_semi")

    def check(self, batch: DataFrame, *, key: list[str], new_id: str, text: str, rect: str) -> DataFrame:
        """Ids of the rows of ``batch`` that repeat something; the others are appended."""
        fresh = cut_lineage(_rows(batch, new_id, key, text, rect))
        visiting = placement.visits(fresh, ["scope"])
        living = self.visited(visiting)
        if living is None:
            found = fresh.select("id").limit(0)
        else:
            # Written once: it is counted for hot cells and then read.
            living = cut_lineage(living)
            placed = placement.meet(living, visiting.withColumn("segs", F.lit(None).cast("array<long>")), "id")
            found = cut_lineage(placed.select("cell", "part", "side", *_FIELDS, "segs").mapInArrow(_match_history, "id long").distinct())
        # Written before the append: appending changes the folder that ``found`` reads.
        repeats = cut_lineage(found.unionByName(match_arrivals(fresh.join(found, "id", "left_anti"))))
        self.append(fresh.join(repeats, "id", "left_anti"))
        return repeats.select(F.col("id").alias(new_id))

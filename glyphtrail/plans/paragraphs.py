"""Group the blocks of a capture into paragraphs, and explain every decision.

A sequential fold in reading order: a block joins the open paragraph unless some test
speaks against it. All failing tests are reported, not only the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphtrail.functions.text import COMMAS, SENTENCE_ENDS

from . import scalar as S

MIN_DENSITY, MIN_ASPECT, MAX_ASPECT, TALL_LETTERS = 0.00005, 0.125, 8.0, 2.5
MAX_GAP_HEIGHTS, AFTER_SENTENCE, HEIGHT_JUMP, MIN_FENCE = 2.0, 0.6, 3.0, 8


@dataclass(frozen=True)
class Knobs:
    gap: float = 10.0
    times: float = 0.75
    max_blocks: int = 3
    max_length: int = 200

    def __post_init__(self) -> None:
        if self.gap < 0 or self.times <= 0 or self.max_blocks < 1 or self.max_length < 1:
            raise ValueError(f"grouping levers out of range: {self}")


@dataclass
class Line:
    id: int
    rect: S.Rect
    text: str
    lines: list[tuple[str, S.Rect]] = field(default_factory=list)

    @property
    def height(self) -> float:
        return self.rect[3] - self.rect[1]

    @property
    def letter(self) -> float:
        return self.height / max(1, len(self.lines))

    @property
    def dense(self) -> bool:
        return len(self.text) / S.area(self.rect) >= MIN_DENSITY


def split_sentences(block: Line) -> list[Line] | None:
    """Pieces of a block with a sentence end before its last line, else None."""
    if len(block.lines) < 2 or not any(t[-1:] in SENTENCE_ENDS for t, _ in block.lines[:-1]):
        return None
    out, held = [], []
    for i, line in enumerate(block.lines):
        held.append(line)
        if line[0][-1:] in SENTENCE_ENDS or i == len(block.lines) - 1:
            rects = [r for _, r in held]
            box = (min(r[0] for r in rects), min(r[1] for r in rects), max(r[2] for r in rects), max(r[3] for r in rects))
            out.append(Line(block.id, box, " ".join(t for t, _ in held), held))
            held = []
    return out


def _reasons(open_: list[Line], b: Line, gap: float, threshold: float, slack: float, fence: float | None, knobs: Knobs) -> list[str]:
    left, right = min(x.rect[0] for x in open_), max(x.rect[2] for x in open_)
    only = open_[0] if len(open_) == 1 else None
    jump = back = False
    if only:
        jump = (b.height > fence or only.height > fence) if fence is not None else (only.height > 0 and b.height >= HEIGHT_JUMP * only.height and len(b.lines) > len(only.lines))
        back = b.height > 0 and only.height >= HEIGHT_JUMP * b.height

    def beside(x: Line) -> bool:
        shared, shorter = min(x.rect[3], b.rect[3]) - max(x.rect[1], b.rect[1]), min(x.height, b.height)
        apart = 0.5 * x.letter
        return shorter > 0 and shared > 0.5 * shorter and (b.rect[0] > x.rect[2] + apart or x.rect[0] > b.rect[2] + apart)

    tests = {
        "gap": gap >= threshold, "no_x_overlap": not (b.rect[0] < right + slack and b.rect[2] > left - slack), "height_ratio": jump, "reverse_height_ratio": back,
        "inline_peer": any(map(beside, open_)), "block_count": len(open_) >= knobs.max_blocks, "length": sum(len(x.text) for x in open_) + len(b.text) > knobs.max_length,
    }
    return [name for name, bad in tests.items() if bad]


def group(blocks: list[Line], knobs: Knobs = Knobs()) -> tuple[list[list[Line]], list[tuple]]:
    """(paragraphs by top, decisions as (id, accepted, reasons, length, gap, threshold))."""
    ready, rest = [], []
    for b in blocks:
        parts = split_sentences(b)
        ready += [[p] for p in parts] if parts else []
        rest += [] if parts else [b]
    order = sorted(rest, key=lambda b: (b.rect[1], b.rect[0]))
    solid = [b for b in order if S.area(b.rect) > 0 and b.dense]
    letters = sorted(b.letter for b in solid)
    usual = S.median(letters) if letters else 0.0
    gaps = [g for a, b in zip(solid, solid[1:]) if (g := b.rect[1] - a.rect[3]) > 0]
    fence = S.upper_fence([b.height for b in solid], MIN_FENCE)
    valley = S.otsu(gaps) if len(gaps) >= 3 else None
    done, open_, bottom, told = [], [], -1e9, []
    for b in order:
        size = S.area(b.rect)
        if size <= 0:
            told.append((b.id, False, ["degenerate_box"], 0, None, None))
            continue
        aspect = (b.rect[2] - b.rect[0]) / b.height
        if not b.dense and (not MIN_ASPECT <= aspect <= MAX_ASPECT or (usual > 0 and b.letter > TALL_LETTERS * usual)):
            told.append((b.id, False, ["noise_guard"], 0, None, None))
            continue
        gap, bad = b.rect[1] - bottom, []
        if open_:
            mean = sum(x.height for x in [*open_, b]) / (len(open_) + 1)
            ceiling = MAX_GAP_HEIGHTS * mean
            threshold = min(valley, ceiling) if valley is not None else min(max(knobs.gap, mean * knobs.times), ceiling)
            last = open_[-1].text[-1:]
            threshold *= AFTER_SENTENCE if last and last in SENTENCE_ENDS else 1.0
            wide = max(x.rect[2] for x in open_) - min(x.rect[0] for x in open_)
            slack = max(knobs.gap, 2.5 * open_[0].letter, 0.15 * wide)
            bad = _reasons(open_, b, gap, threshold, slack, fence, knobs)
            told.append((b.id, not bad, bad, len(open_), gap, threshold))
        if bad:
            done.append(open_)
            open_, bottom = [b], b.rect[3]
        else:
            open_.append(b)
            bottom = max(bottom, b.rect[3])
    done += [open_] if open_ else []
    return sorted([*ready, *done], key=lambda p: p[0].rect[1]), told


def by_lines(blocks: list[Line]) -> list[list[Line]]:
    """One group per block."""
    return [[b] for b in blocks]


def captures_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each capture of a stream sorted by ``keys``; one capture is held at a time."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != at:
                if rows:
                    yield at, rows
                at, rows = key, []
            rows.append(row)
    if rows:
        yield at, rows


def _sorted(blocks: DataFrame) -> DataFrame:
    columns = ["session_id", "cap", "seq", "id", "text", *"ltrb"]
    return blocks.select(*columns).repartition("session_id", "cap").sortWithinPartitions("session_id", "cap", "seq", "id")


def paragraphs(blocks: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(session_id, cap, id, paragraph, position): the paragraph of every grouped block.

    Captures are independent, so they spread over all tasks; a task streams through its
    captures and holds one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (session, cap), rows in captures_of(batches, ("session_id", "cap")):
            found, _ = group([Line(r["id"], (r["l"], r["t"], r["r"], r["b"]), r["text"]) for r in rows], knobs)
            out += [(session, cap, b.id, p, i) for p, members in enumerate(found) for i, b in enumerate(members)]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types)], names=["session_id", "cap", "id", "paragraph", "position"])

    return _sorted(blocks).mapInArrow(run, "session_id string, cap int, id long, paragraph int, position int")


def decisions(blocks: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """One row for every drop and boundary decision, with all failing reasons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (session, cap), rows in captures_of(batches, ("session_id", "cap")):
            _, told = group([Line(r["id"], (r["l"], r["t"], r["r"], r["b"]), r["text"]) for r in rows], knobs)
            out += [(session, cap, *t) for t in told]
        types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.float64()]
        names = ["session_id", "cap", "id", "accepted", "reasons", "length", "gap", "threshold"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names=names)

    return _sorted(blocks).mapInArrow(run, "session_id string, cap int, id long, accepted boolean, reasons array<string>, length int, gap double, threshold double")


_LINES = [("session_id", pa.string()), ("cap", pa.int32()), ("id", pa.int64()), ("piece", pa.int32()), ("lines", pa.int32()), ("text", pa.string()), *[(e, pa.float64()) for e in "ltrb"]]


def line_units(blocks: DataFrame, knobs: Knobs | None = Knobs()) -> DataFrame:
    """Units of blocks that come with their lines (M6, U5, ST13, ST14).

    ``blocks`` has session_id, cap, id, text, l, t, r, b and ``lines``, an array of
    structs text, l, t, r, b. A block with a sentence end before its last line is cut
    there; the pieces and the paragraphs of the others come in one order by top. Without
    ``knobs`` every block is a unit of its own. Rows (session_id, cap, id of the first
    block, piece, lines, text, l, t, r, b); ``piece`` is the unit's place in its capture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (session, cap), rows in captures_of(batches, ("session_id", "cap")):
            made = [Line(r["id"], (r["l"], r["t"], r["r"], r["b"]), r["text"], [(x["text"], (x["l"], x["t"], x["r"], x["b"])) for x in r["lines"] or ()]) for r in rows]
            for piece, unit in enumerate(by_lines(made) if knobs is None else group(made, knobs)[0]):
                box = [f(x.rect[i] for x in unit) for i, f in enumerate((min, min, max, max))]
                out.append((session, cap, unit[0].id, piece, sum(len(x.lines) for x in unit), " ".join(x.text for x in unit), *box))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * len(_LINES), _LINES)], names=[n for n, _ in _LINES])

    columns = ["session_id", "cap", "id", "text", *"ltrb", "lines"]
    placed = blocks.select(*columns).repartition("session_id", "cap").sortWithinPartitions("session_id", "cap", "id")
    return placed.mapInArrow(run, "session_id string, cap int, id long, piece int, lines int, text string, l double, t double, r double, b double")

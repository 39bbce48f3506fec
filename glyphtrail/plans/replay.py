"""Run whole streams through the capture step and log every decision.

A session is sequential by contract, so its captures run in one task, streamed in order
with bounded state; scale comes from sessions times families of configurations ("arms"),
which are extra keys. Arms of a family may differ in the levers of a step only; as long
as none of these made a difference they are one state, stepped once (:class:`Family`).
Nothing but the current capture and the live tracks is held.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scalar as S
from .tracker import Block, Config, Session

#: Named configurations of the comparison; each differs from the default in one lever.
ARMS: dict[str, Config] = {
    "default": Config(),
    "damp": Config(step="damp"),
    "snap": Config(step="snap"),
    "legacy": Config(position="legacy", step="damp"),
    "no_adopt": Config(adopt=False),
    "floor_390": Config(floor_px=390.0),
    "reanchor_2": Config(reanchor_blocks=2),
    "band_observe": Config(band_mode="observe"),
    "band_admit": Config(band_mode="admit"),
    "retain_2": Config(missed_frames=2),
    "band_retain": Config(band_mode="admit", missed_frames=2),
}

def parse_levers(arguments: list[str]) -> Config:
    """A configuration from ``--floor=<px>``, ``--reanchor=<count>`` and ``--adopt``.

    Adoption is off unless it is asked for. Other arguments are left to others; a
    malformed one raises ValueError with its text. The last of equal ones counts.
    """
    floor, reanchor, adopt = None, None, False
    for argument in arguments:
        name, given, value = argument.partition("=")
        try:
            if name == "--floor":
                floor = float(value)
                if not 0 < floor < math.inf:
                    raise ValueError
            elif name == "--reanchor":
                reanchor = int(value)
                if reanchor < 1:
                    raise ValueError
            elif name == "--adopt":
                if given:
                    raise ValueError
                adopt = True
        except ValueError:
            raise ValueError(f"malformed argument: {argument}") from None
    return Config(floor_px=floor, reanchor_blocks=reanchor, adopt=adopt)


def bucket_policy(name: str) -> Policy | None:
    """A cell policy by name: ``fixed``, ``median``, or ``viewport:<width>x<height>``."""
    if name == "fixed":
        return None
    if name == "median":
        return median_cells
    kind, _, size = name.partition(":")
    width, _, height = size.partition("x")
    try:
        if kind == "viewport" and 0 < float(width) < math.inf and 0 < float(height) < math.inf:
            return viewport_cells(float(width), float(height))
    except ValueError:
        pass
    raise ValueError(f"unknown cell policy: {name}")


_COLUMNS = ("id", "kind", "hz", "cid", "inner_top", *"ltrb", "text", "pconf", "tconf", "srcq", "obs", "provisional")

_LOG = [
    ("session_id", pa.string()), ("arm", pa.string()), ("cap", pa.int32()), ("event", pa.string()), ("how", pa.string()), ("fresh_id", pa.int64()), ("track", pa.int64()),
    ("dx", pa.float64()), ("dy", pa.float64()), ("top_lag", pa.float64()), ("obs_before", pa.int32()), ("pconf", pa.float64()), ("tconf", pa.float64()), ("response", pa.string()), ("remaining", pa.int32()),
    ("merged", pa.int32()), ("admitted", pa.int32()), ("retained", pa.int32()), ("dropped", pa.int32()), ("contradictions", pa.int32()), ("invalidated", pa.int32()), ("settled", pa.int32()),
    ("shift_x", pa.float64()), ("shift_y", pa.float64()), ("shift_members", pa.int32()), ("shift_source", pa.string()), ("scale", pa.float64()), ("residual", pa.float64()), ("digest", pa.string()),
]
_NAMES = [n for n, _ in _LOG]
_TYPES = {"string": "string", "int32": "int", "int64": "long", "double": "double"}
SCHEMA = ", ".join(f"{n} {_TYPES[str(t)]}" for n, t in _LOG)


def block_of(row: dict) -> Block:
    rect = (row["l"], row["t"], row["r"], row["b"])
    return Block(row["id"], rect, row["text"], row["pconf"], row["tconf"], row["kind"], row["hz"], row["cid"], row["inner_top"], row["srcq"])


def canonical(block: Block) -> list:
    """A track as plain values in fixed order, maps sorted by key (M4)."""
    votes = {k: [v[0], round(v[1], 9), round(v[2], 9)] for k, v in sorted(block.votes.items())}
    return [*(round(x, 6) for x in block.rect), block.text, block.obs, round(block.pconf, 9), round(block.tconf, 9), block.kind, block.hz, block.provisional, block.remaining, sorted(block.classes.items()), sorted(block.lanes.items()), votes]


def digest(result: dict) -> str:
    """Hash of the canonical state after a capture."""
    tracks = sorted(map(canonical, [*result["stable"], *result["retained"]]), key=repr)
    body = [tracks, result["merged"], result["admitted"], result["dropped"], len(result["grouping"]), len(result["splitting"]), sorted(result["invalidated"])]
    return hashlib.sha256(json.dumps(body, ensure_ascii=False).encode()).hexdigest()


def log_rows(session: str, arm: str, cap: int, result: dict) -> Iterator[dict]:
    key = {"session_id": session, "arm": arm, "cap": cap}
    for how, fresh, old, out, response in result["log"]:
        row = {**key, "event": "merge", "how": how, "fresh_id": fresh.id, "track": out.track, "pconf": out.pconf, "tconf": out.tconf, "response": response, "remaining": out.remaining, "obs_before": old.obs if old else None}
        if old is not None:
            (x0, y0), (x1, y1) = S.center(old.rect), S.center(out.rect)
            row |= {"dx": x1 - x0, "dy": y1 - y0, "top_lag": abs(out.rect[1] - fresh.rect[1])}
        yield row
    yield {**capture_row(session, cap, result), "arm": arm}


def capture_row(session: str, cap: int, result: dict, digested: bool = True) -> dict:
    """The capture row of a step, the same for all arms that share it."""
    shift, fit = result["shift"] or {}, result["fit"] or {}
    return {
        "session_id": session, "cap": cap, "event": "capture", "merged": result["merged"], "admitted": result["admitted"], "retained": len(result["retained"]), "dropped": result["dropped"],
        "contradictions": len(result["grouping"]) + len(result["splitting"]), "invalidated": len(result["invalidated"]), "settled": len(result["settled"]), "shift_x": shift.get("tx"), "shift_y": shift.get("ty"),
        "shift_members": shift.get("members"), "shift_source": shift.get("source"), "scale": fit.get("scale"), "residual": fit.get("residual"), "digest": digest(result) if digested else None,
    }


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _LOG], names=_NAMES)


def with_empty(blocks: DataFrame, captures: DataFrame) -> DataFrame:
    """Adds a marker row (null id) for captures without any block: they still count."""
    missing = captures.select("session_id", "cap").distinct().join(blocks.select("session_id", "cap").distinct(), ["session_id", "cap"], "left_anti")
    return blocks.select("session_id", "cap", "seq", *_COLUMNS).unionByName(missing, allowMissingColumns=True)


Policy = Callable[[Session], tuple[float, float] | None]


def median_cells(session: Session) -> tuple[float, float] | None:
    """Square cells of twice the upper-middle height of the tracks, within limits."""
    heights = sorted(t.rect[3] - t.rect[1] for t in session.tracks)
    if len(heights) < 4:
        return None
    size = min(max(2 * heights[len(heights) // 2], 80.0), 220.0)
    return size, size


def viewport_cells(width: float, height: float) -> Policy:
    """Cells by the size of the viewport, the same for every capture (J2d)."""
    cells = min(max(0.18 * width, 80.0), 220.0), min(max(0.15 * height, 80.0), 220.0)
    return lambda session: cells


def drift_rows(session: Session, key: dict) -> list[dict]:
    """Regions whose median drift moved on since it was last told."""
    return [{**key, "event": "drift", "how": space, "dx": dx, "dy": dy} for space, dx, dy in session.drift.propagate()]


#: What arms of one family may differ in: levers that decide within a step and keep nothing.
_LEVERS = {"band_mode": "off", "step": "coherent", "adopt": True, "floor_px": None, "reanchor_blocks": None}


def families(arms: dict[str, Config]) -> list[list[str]]:
    """Arms by all that the levers leave of their configurations."""
    out: dict[Config, list[str]] = {}
    for name, config in arms.items():
        out.setdefault(replace(config, **_LEVERS), []).append(name)
    return list(out.values())


class Family:
    """Arms of one session, stepped together while their states are equal.

    A group is a state and its arms, the calmest first. That one leads: the others share
    its step if the plan of the capture is the same and neither a snap nor a band match,
    where only they have these, would have come of it. Those that do not are forked from
    the state before the step and take it on their own, from then on for good.
    """

    def __init__(self, arms: dict[str, Config], policy: Policy | None = None, fits: bool = True) -> None:
        self.arms, self.policy = arms, policy
        names = sorted(arms, key=lambda a: (arms[a].band_mode == "admit", arms[a].step == "snap", arms[a].band_mode != "off"))
        self.groups: list[tuple[Session, list[str]]] = [(Session(arms[names[0]]), names)]
        self.groups[0][0].fits = fits

    def step(self, capture: list[Block]) -> Iterator[tuple[list[str], Session, dict]]:
        """(arms, their state, decisions) of every group."""
        groups, self.groups = self.groups, []
        for b in capture:
            b.alike  # shared by the copies, so a text is compared once
        for session, names in groups:
            cells = self.policy(session) if self.policy else None
            if cells:
                session.config = replace(session.config, cell_width=cells[0], cell_height=cells[1])
            for own, arms in self._split(session, names, [b.twin() for b in capture] if len(groups) > 1 else capture):
                self.groups.append((own[0], arms))
                yield arms, *own

    def _split(self, session: Session, names: list[str], capture: list[Block]) -> Iterator[tuple[tuple[Session, dict], list[str]]]:
        config = session.config
        configs = [replace(self.arms[a], cell_width=config.cell_width, cell_height=config.cell_height) for a in names] if self.policy else [self.arms[a] for a in names]
        if len(names) == 1:
            yield (session, session.step(capture)), names
            return
        seen = session.look(capture)
        plans = session.planned(seen, configs)
        rest = list(zip(names, configs, plans))
        before = session.fork(config)
        while rest:
            lead, mine, plan = rest[0]
            with_it = [x for x in rest if x[2] == plan]
            able = mine.band_mode != "admit" and (plan is not None or mine.step != "snap")
            own = session if len(rest) == len(names) else before.fork(mine)
            own.config = mine
            own.watch_bands = able and any(x[1].band_mode == "admit" for x in with_it)
            result = own.decide({**seen, "fresh": [b.twin() for b in seen["fresh"]]}, [plan])
            same = [x for x in with_it if x[0] == lead or (able and not (x[1].step == "snap" and own.snaps) and not (x[1].band_mode == "admit" and own.bands))]
            yield (own, result), [x[0] for x in same]
            rest = [x for x in rest if x not in same]


_CONSTANT = ("session_id", "arm", "cap", "event")


def merge_columns(result: dict, wanted: tuple[str, ...]) -> dict[str, list]:
    """The wanted columns of a step's merge rows, but for the constant ones."""
    log = result["log"]
    of: dict[str, Callable] = {
        "how": lambda how, fresh, old, out, response: how,
        "fresh_id": lambda how, fresh, old, out, response: fresh.id,
        "track": lambda how, fresh, old, out, response: out.track,
        "pconf": lambda how, fresh, old, out, response: out.pconf,
        "tconf": lambda how, fresh, old, out, response: out.tconf,
        "response": lambda how, fresh, old, out, response: response,
        "remaining": lambda how, fresh, old, out, response: out.remaining,
        "obs_before": lambda how, fresh, old, out, response: None if old is None else old.obs,
        "dx": lambda how, fresh, old, out, response: None if old is None else out.center[0] - old.center[0],
        "dy": lambda how, fresh, old, out, response: None if old is None else out.center[1] - old.center[1],
        "top_lag": lambda how, fresh, old, out, response: None if old is None else abs(out.rect[1] - fresh.rect[1]),
    }
    return {n: [of[n](*x) for x in log] if n in of else [None] * len(log) for n in wanted if n not in _CONSTANT}


def replay(blocks: DataFrame, arms: dict[str, Config] | None = None, captures: DataFrame | None = None, policy: Policy | None = None, events: tuple[str, ...] = ("merge", "capture", "drift"), columns: tuple[str, ...] = tuple(_NAMES)) -> DataFrame:
    """The decision log of every session under every arm: merge, capture and drift rows.

    ``policy`` sets the grid cells before each capture (ST16); keys are derived from the
    cells, so a change needs no re-keying. Of the log, only rows of ``events`` and the
    named ``columns`` are made.
    """
    chosen = arms or {"default": Config()}
    parts = families(chosen)
    wanted = tuple(n for n in _NAMES if n in columns)
    types = dict(_LOG)
    rows = with_empty(blocks, captures) if captures is not None else blocks.select("session_id", "cap", "seq", *_COLUMNS)
    order = ("session_id", "family", "cap", "seq", "id")
    fields = ("text", "pconf", "tconf", "kind", "hz", "cid", "inner_top", "srcq")
    keyed = rows.select("session_id", F.explode(F.array(*map(F.lit, range(len(parts))))).alias("family"), "cap", "seq", "id", *"ltrb", *fields)
    placed = keyed.repartition("session_id", "family").sortWithinPartitions(*order)

    def made(held: dict[tuple, dict[str, list]]) -> Iterator[pa.RecordBatch]:
        for names, of in held.items():
            arrays = {n: pa.array(of[n], types[n]) for n in wanted if n != "arm"}
            size = len(next(iter(of.values())))
            for name in names:
                yield pa.RecordBatch.from_arrays([arrays[n] if n != "arm" else pa.array([name] * size, types[n]) for n in wanted], names=list(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, family, held, count = None, None, {}, 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (name, part, cap), members in groupby(rows, key=lambda r: r[:3]):
            if (name, part) != at:
                at, family = (name, part), Family({a: chosen[a] for a in parts[part]}, policy, "scale" in wanted or "residual" in wanted)
            capture = [Block(r[4], r[5:9], *r[9:]) for r in members if r[4] is not None]
            for names, session, result in family.step(capture):
                of = held.setdefault(tuple(names), {n: [] for n in ("session_id", *wanted)})
                if "merge" in events:
                    size = len(result["log"])
                    for n, values in merge_columns(result, wanted).items():
                        of[n] += values
                    for n, value in zip(_CONSTANT, (name, None, cap, "merge")):
                        if n in of:
                            of[n] += [value] * size
                    count += size * len(names)
                told = [capture_row(name, cap, result, "digest" in wanted)] if "capture" in events else []
                told += drift_rows(session, {"session_id": name, "cap": cap}) if "drift" in events else []
                for row in told:
                    for n, values in of.items():
                        values.append(row.get(n))
                count += len(told) * len(names)
            if count >= 5000:
                yield from made(held)
                held, count = {}, 0
        yield from made(held)

    return placed.mapInArrow(run, ", ".join(f"{n} {_TYPES[str(types[n])]}" for n in wanted))


def largest_firing_floor(blocks: DataFrame, low: int = 1, high: int = 4096, at_once: int = 8) -> int | None:
    """The largest whole floor from ``low`` to ``high`` under which some step follows it.

    None if none does at ``low``. Each round replays ``at_once`` floors as arms of one
    job and keeps the span between the last that fires and the first that does not.
    """

    def firing(floors: list[int]) -> set[int]:
        log = replay(blocks, {str(f): Config(floor_px=float(f)) for f in floors})
        rows = log.where("event = 'capture' and shift_source = 'floor'").select("arm").distinct().collect()  # at most at_once rows
        return {int(r[0]) for r in rows}

    ends = firing([low, high])
    if high in ends:
        return high
    if low not in ends:
        return None
    while high - low > 1:
        step = max(1, (high - low) // (at_once + 1))
        floors = list(range(low + step, high, step))[:at_once]
        fires = firing(floors)
        after = [f for f in floors if f not in fires]
        high = min([high, *after])
        low = max([low, *(f for f in fires if f < high)])
    return low

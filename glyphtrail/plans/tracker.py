"""The capture step: one session's state, one capture in, decisions out.

State is bounded by what one capture and the retained tracks hold: at most five text
votes a track, twenty drifts a region, and tracks not seen for ``missed_frames``
captures are let go. The same object serves batch replay and the streaming processor;
:meth:`Session.dump` and :meth:`Session.load` move it in and out of a state store.

A capture's rows are taken in (seq, id) order. Order is part of the result: a dropped
row leaves no key behind, and every merge sees the drift of the merges before it.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, insort
from collections import deque
from dataclasses import asdict, dataclass, field
from functools import cached_property

from glyphtrail.functions import text as T

from . import scalar as S

RING, MIN_DRIFTS, WELL_OBSERVED, MAX_VOTES = 20, 3, 3, 5
CELL = 200.0


@dataclass(frozen=True)
class Config:
    """Every lever of the engine with its default; bad values raise ValueError."""

    band_mode: str = "off"  # off, observe, admit
    band_lev: float = 0.50
    band_jac: float = 0.60
    band_captures: int = 3
    band_observations: int | None = None
    position: str = "agreement"  # or legacy
    step: str = "coherent"  # damp, snap, coherent
    snap_times: float = 1.5
    min_blocks: int = 3
    min_share: float = 0.5
    tolerance: float = 0.5
    adopt: bool = True
    floor_px: float | None = None
    reanchor_blocks: int | None = None
    missed_frames: int = 0
    fit_pairs: int = 3
    cell_width: float = CELL
    cell_height: float = CELL
    scale: float = 1.0

    def __post_init__(self) -> None:
        checks = {
            "band_mode": self.band_mode in ("off", "observe", "admit"), "band_lev": 0 <= self.band_lev < 0.70, "band_jac": 0 <= self.band_jac < 0.80,
            "band_captures": self.band_captures >= 1, "band_observations": (self.band_observations or 0) >= 0, "position": self.position in ("agreement", "legacy"),
            "step": self.step in ("damp", "snap", "coherent"), "snap_times": self.snap_times > 0, "min_blocks": self.min_blocks >= 1, "min_share": 0 <= self.min_share <= 1,
            "tolerance": self.tolerance >= 0, "floor_px": self.floor_px is None or self.floor_px > 0, "reanchor_blocks": self.reanchor_blocks is None or self.reanchor_blocks >= 1,
            "missed_frames": self.missed_frames >= 0, "fit_pairs": self.fit_pairs >= 3, "cell_width": 0 < self.cell_width < math.inf, "cell_height": 0 < self.cell_height < math.inf, "scale": 0 < self.scale < math.inf,
        }
        for name, good in checks.items():
            if not good:
                raise ValueError(f"{name} is out of range: {getattr(self, name)!r}")

    @property
    def band_floor(self) -> int:
        return self.band_captures + 1 if self.band_observations is None else self.band_observations


@dataclass
class Block:
    """An observation and, once tracked, its state.

    What follows from text and place is worked out once; a change of either makes a new
    block (:meth:`twin`).
    """

    id: int
    rect: S.Rect
    text: str
    pconf: float
    tconf: float
    kind: str = "page"
    hz: int = -1
    cid: str | None = None
    inner_top: float = 0.0
    srcq: int = 0
    obs: int = 1
    provisional: bool = False
    remaining: int = 0
    reclassify: bool = False
    misses: int = 0
    track: int = -1
    classes: dict[int, int] = field(default_factory=dict)
    lanes: dict[int, int] = field(default_factory=dict)
    votes: dict[str, list] = field(default_factory=dict)

    @cached_property
    def sig(self) -> str:
        return S.significant(self.text)

    @cached_property
    def traits(self) -> S.Traits:
        return S.traits(self.sig)

    @cached_property
    def alike(self) -> dict[str, float | None]:
        """Of significant texts met so far: the ratio if they match, else None."""
        return {}

    @cached_property
    def plain(self) -> str:
        return S.normalize(self.text)

    @cached_property
    def center(self) -> tuple[float, float]:
        return S.center(self.rect)

    @cached_property
    def area(self) -> float:
        return S.area(self.rect)

    @cached_property
    def view(self) -> bool:
        return self.kind == "viewport"

    @cached_property
    def weight(self) -> int:
        inner, lane = self.kind == "inner", self.hz >= 0
        return 40 if self.view else 30 if inner and lane else 20 if inner or lane else 10

    @cached_property
    def quality(self) -> float:
        return 0.4 * self.pconf + 0.6 * self.tconf

    @cached_property
    def overlap_threshold(self) -> float:
        cjk = S.cjk_fraction(self.text)
        return 0.35 if cjk >= 0.6 else 0.65 if cjk < 0.3 and len(self.text) <= 8 else 0.50

    @cached_property
    def space(self) -> str:
        """The key of its drift in the usual :class:`Spaces`."""
        return Spaces().key(self)

    def twin(self, **changes) -> Block:  # noqa: ANN003
        """A copy; with changes, nothing worked out from the old values is kept."""
        out = object.__new__(Block)
        own = self.__dict__
        if not changes:
            out.__dict__.update(own)
            return out
        new = out.__dict__
        new.update(own)
        new.update(changes)
        for k in _OF_PLACE if new["text"] == own["text"] and new["kind"] == own["kind"] and new["hz"] == own["hz"] else _WORKED_OUT:
            new.pop(k, None)
        return out


_OF_PLACE = ("alike", "center", "area", "quality", "space", "_own")
_WORKED_OUT = (*_OF_PLACE, "sig", "traits", "plain", "view", "weight", "overlap_threshold")


class Spaces:
    """Which blocks share one drift, and which are left out of it; replace to define others.

    ``size`` is the height of a region, the same that keys are made of.
    """

    size = 500.0

    def key(self, b: Block) -> str:
        if b.weight >= 30 or (b.kind == "inner" and b.cid is None):
            return "unknown:0"
        where = f"ic:{b.cid}" if b.kind == "inner" else "normal"
        return f"{where}:{math.floor(b.rect[1] / self.size)}"

    def drifts(self, b: Block) -> bool:
        return not (b.weight >= 30 or (b.weight == 20 and (b.hz >= 0 or b.cid is None)))


def same_lane(a: Block, b: Block) -> bool:
    return a.hz < 0 or b.hz < 0 or a.hz == b.hz


class Grid:
    """Blocks by cell; readers get a fixed order: columns, rows, then insertion."""

    def __init__(self, config: Config, blocks: list[Block] = ()) -> None:
        self.w, self.h = config.cell_width, config.cell_height
        self.clear()
        for b in blocks:
            self.add(b)

    def _own(self, b: Block) -> list[tuple]:
        known = b.__dict__.get("_own")
        if known is not None and known[0] == self.w and known[1] == self.h:
            return known[2]
        x, y = b.center
        own = [("vr" if b.view else "abs", S.half_up(x / self.w), S.half_up(y / self.h))]
        if b.kind == "inner":
            own.append(("ic", own[0][1], S.half_up((y - b.inner_top) / self.h)))
        b.__dict__["_own"] = (self.w, self.h, own)
        return own

    def add(self, b: Block) -> None:
        self.held[id(b)] = b
        self.found.clear()
        for cell in self._own(b):
            self.cells.setdefault(cell, {})[id(b)] = b

    def remove(self, b: Block) -> None:
        self.held.pop(id(b), None)
        self.found.clear()
        for cell in self._own(b):
            self.cells.get(cell, {}).pop(id(b), None)

    def clear(self) -> None:
        self.cells: dict[tuple, dict[int, Block]] = {}
        self.held: dict[int, Block] = {}
        self.found: dict[tuple, list[Block]] = {}  # what was gathered since the last change

    def rebuild(self, blocks: list[Block], width: float | None = None, height: float | None = None) -> None:
        """Start again with other blocks and, if given, another cell size."""
        self.w, self.h = width or self.w, height or self.h
        self.clear()
        for b in blocks:
            self.add(b)

    @property
    def all(self) -> list[Block]:
        return list(self.held.values())

    def _gather(self, cells) -> list[Block]:  # noqa: ANN001
        found: dict[int, Block] = {}
        for cell in cells:
            for key, b in self.cells.get(cell, {}).items():
                found.setdefault(key, b)
        return list(found.values())

    def near(self, b: Block) -> list[Block]:
        own = self._own(b)
        key = own[0] if len(own) == 1 else tuple(own)
        out = self.found.get(key)
        if out is None:
            steps = (-1, 0, 1)
            if len(own) == 1:  # one layer has each block once
                (layer, x, y), out, cells = own[0], [], self.cells
                for i in steps:
                    for j in steps:
                        cell = cells.get((layer, x + i, y + j))
                        if cell:
                            out += cell.values()
            else:
                out = self._gather((layer, x + i, y + j) for layer, x, y in own for i in steps for j in steps)
            self.found[key] = out
        return out

    def region(self, r: S.Rect) -> list[Block]:
        x0, x1 = math.floor(r[0] / self.w) - 1, math.ceil(r[2] / self.w) + 2
        y0, y1 = math.floor(r[1] / self.h) - 1, math.ceil(r[3] / self.h) + 2
        key = (x0, x1, y0, y1)
        out = self.found.get(key)
        if out is None:
            out, cells = [], self.cells
            if len(cells) <= (x1 - x0) * (y1 - y0):  # sorted cells are in the order of columns and rows
                order = self.found.get("order")
                if order is None:
                    order = self.found["order"] = sorted((c for c in cells if c[0] == "abs"))
                for cell in order:
                    if x0 <= cell[1] < x1 and y0 <= cell[2] < y1:
                        out += cells[cell].values()
            else:
                for x in range(x0, x1):
                    for y in range(y0, y1):
                        cell = cells.get(("abs", x, y))
                        if cell:
                            out += cell.values()
            self.found[key] = out
        return out


class Drift:
    """Rings of the last displacements and heights of each region."""

    def __init__(self, spaces: Spaces | None = None) -> None:
        self.spaces = spaces or Spaces()
        self.rings: dict[str, deque] = {}
        self.propagated: dict[str, tuple[float, float]] = {}
        self.emitted: dict[str, int] = {}
        self.total = 0
        self.usual = type(self.spaces) is Spaces and self.spaces.size == Spaces.size == 500.0
        self.sorted: dict[str, tuple] = {}  # both follow from the rings
        self.middle: dict[str, tuple] = {}

    def add(self, b: Block, dx: float, dy: float) -> None:
        if self.spaces.drifts(b) and math.isfinite(dx) and math.isfinite(dy):
            key = self.key(b)
            ring, new = self.rings.get(key), (dx, dy, S.height_of(b.rect))
            if ring is None:
                ring = self.rings[key] = deque(maxlen=RING)
            held = self._ordered(key, ring)
            if len(ring) == RING:
                for values, old in zip(held, ring[0]):
                    del values[bisect_left(values, old)]
            for values, x in zip(held, new):
                insort(values, x)
            ring.append(new)
            self.sorted[key] = (ring, held)
            self.middle.pop(key, None)
            self.total += 1

    def key(self, b: Block) -> str:
        return b.space if self.usual else self.spaces.key(b)

    def _ordered(self, key: str, ring: deque) -> tuple[list[float], ...]:
        """Displacements and heights of a ring, each in order."""
        known = self.sorted.get(key)
        if known is None or known[0] is not ring or len(known[1][0]) != len(ring):
            self.middle.pop(key, None)
            known = self.sorted[key] = (ring, tuple(sorted(x[i] for x in ring) for i in range(3)))
        return known[1]

    def _middle(self, key: str) -> tuple[tuple[float, float], float]:
        """Median displacement, and median height, of a region."""
        known = self.middle.get(key)
        if known is None:
            ring = self.rings.get(key)
            if not ring:
                return (0.0, 0.0), 16.0
            held, n = self._ordered(key, ring), len(ring)
            xs, ys, hs = ((v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2) for v in held)
            known = self.middle[key] = ((0.0, 0.0) if n < MIN_DRIFTS else (min(max(xs, -hs), hs), min(max(ys, -hs), hs)), hs)
        return known

    def height(self, key: str) -> float:
        return self._middle(key)[1]

    def median(self, key: str) -> tuple[float, float]:
        return self._middle(key)[0]

    def margin(self, key: str) -> float:
        (dx, dy), tall = self._middle(key)
        return min(max(abs(dx) + abs(dy), 0.0), tall)

    def copy(self) -> Drift:
        out = Drift(self.spaces)
        out.rings = {k: deque(v, maxlen=RING) for k, v in self.rings.items()}
        out.propagated, out.emitted, out.total = dict(self.propagated), dict(self.emitted), self.total
        return out

    def propagate(self) -> list[tuple[str, float, float]]:
        """Regions whose median moved on by more than the threshold since last told."""
        out = []
        for key in self.rings:
            new, old = self.median(key), self.propagated.get(key, (0.0, 0.0))
            dx, dy = new[0] - old[0], new[1] - old[1]
            if math.hypot(dx, dy) > max(2.0, 0.1 * self.height(key)):
                self.propagated[key] = new
                self.emitted[key] = self.emitted.get(key, 0) + 1
                out.append((key, dx, dy))
        return out

    def clear_key(self, key: str) -> None:
        self.rings.pop(key, None)
        self.middle.pop(key, None)

    def clear_region(self, top: float, bottom: float) -> None:
        low, high = math.floor(top / self.spaces.size), math.floor(bottom / self.spaces.size)
        for key in [k for k in self.rings if low <= int(k.rpartition(":")[2]) <= high]:
            self.clear_key(key)

    def reset_propagation(self) -> None:
        self.propagated.clear()


def block_key(b: Block, config: Config, dx: int = 0, dy: int = 0) -> str:
    plain = b.plain
    if b.view:
        cjk = S.cjk_only(b.text)
        return "vr:" + (cjk[:20] if len(cjk) >= 3 else plain[:30])
    x = S.half_up(b.rect[0] / config.cell_width) + dx
    y = S.half_up((b.rect[1] - (b.inner_top if b.kind == "inner" else 0.0)) / config.cell_height) + dy
    lane = f"hz{b.hz}:" if b.hz >= 0 else ""
    return f"{'ic:' if b.kind == 'inner' else ''}{lane}{x}:{y}:s{S.half_up(config.scale * 10)}:{plain}"


def key_parts(b: Block, config: Config) -> tuple[tuple, int, int]:
    """What :func:`block_key` is made of: all but the cell, and the cell."""
    if b.view:
        return (block_key(b, config),), 0, 0
    inner = b.kind == "inner"
    x = S.half_up(b.rect[0] / config.cell_width)
    y = S.half_up((b.rect[1] - (b.inner_top if inner else 0.0)) / config.cell_height)
    return (inner, b.hz if b.hz >= 0 else -1, b.plain), x, y


def overlaps(new: Block, old: Block, margin: float) -> bool:
    if new.view != old.view or not (new.hz < 0 or old.hz < 0 or new.hz == old.hz):
        return False
    a, b = new.rect, old.rect
    if new.kind == old.kind == "inner":
        a, b = S.shift(a, 0, -new.inner_top), S.shift(b, 0, -old.inner_top)
    w, h = min(a[2] + margin, b[2]) - max(a[0] - margin, b[0]), min(a[3] + margin, b[3]) - max(a[1] - margin, b[1])
    if not (w > 0 and h > 0):
        return False
    small = min(S.area(a), S.area(b))
    return small > 0 and w * h / small >= new.overlap_threshold


def resolve(new: Block, old: Block, margin: float, fence: float | None = None) -> str:
    if new.weight != old.weight:
        return "evict" if new.weight > old.weight else "drop"
    mine, theirs = new.area, old.area
    if mine > 0 and new.quality >= old.quality and theirs > (fence if fence is not None else 3 * mine):
        return "evict"
    need = 0.0 if S.overlap_ratio(new.rect, old.rect, margin) >= 0.70 else 0.1
    return "evict" if new.quality >= old.quality + need else "keep"


class Session:
    """State of one stream of captures.

    Hooks, all optional: ``spatial`` (fresh, track) confirms a relaxed match in place of
    the overlap test; ``merger`` (track, fresh, merged) may replace what a merge made;
    ``check`` of :meth:`step` (fresh, track) flags a text as invalid in its context;
    ``spaces`` says which blocks share a drift; ``logger`` (message) is told of dropped
    and evicted blocks and, at the ``clock``'s time, of every step. A logger that fails
    stops nothing.
    """

    def __init__(self, config: Config = Config(), spatial=None, merger=None, spaces: Spaces | None = None, logger=None, clock=None) -> None:  # noqa: ANN001
        self.config, self.spatial, self.merger, self.logger, self.clock = config, spatial, merger, logger, clock
        self.tracks: list[Block] = []
        self.drift = Drift(spaces)
        self.stats = dict.fromkeys(("primary", "no_primary", "considered", "floor", "spatial", "text", "identified", "admitted"), 0)
        self.next_track = 0
        #: Whether the last step met a merge that snapping, or a row that the band, would take otherwise.
        self.snaps = self.bands = self.watch_bands = False
        self.fits = True  # whether to fit scale and shift of a step

    def _space(self, b: Block) -> str:
        return self.drift.key(b)

    def fork(self, config: Config, drift: Drift | None = None) -> Session:
        """The same state under another configuration; blocks are shared, as none is changed."""
        out = Session(config, self.spatial, self.merger, None, self.logger, self.clock)
        out.tracks, out.drift, out.stats, out.next_track = list(self.tracks), drift or self.drift.copy(), dict(self.stats), self.next_track
        out.fits = self.fits
        return out

    def _tell(self, message: str) -> None:
        if self.logger is not None:
            try:
                self.logger(message)
            except Exception:  # noqa: BLE001
                self.logger = None

    # -- dedup ---------------------------------------------------------------------

    def dedup(self, fresh: list[Block]) -> tuple[list[Block], Grid]:
        """One greedy pass: same key, neighbouring key, then overlap with kept rows."""
        kept, seen, grid, key_of, spot = [], {}, Grid(self.config), {}, {}
        for b in fresh:
            if not b.plain:
                continue
            key, x, y = key_parts(b, self.config)
            if any(abs(x - i) <= 1 and abs(y - j) <= 1 for i, j in seen.get(key, ())):
                continue
            margin = self.drift.margin(self._space(b))
            rival = None
            if b.kind == "inner" or len(kept) > 64 or any(x.rect[0] < b.rect[2] + margin and x.rect[2] > b.rect[0] - margin and x.rect[1] < b.rect[3] + margin and x.rect[3] > b.rect[1] - margin for x in kept):
                rival = next((x for x in grid.near(b) if overlaps(b, x, margin)), None)
            verdict = "keep" if rival is None else resolve(b, rival, margin)
            if verdict == "drop":
                self._tell(f"dropped {b.id}: covered by {rival.id}")
                continue
            if verdict == "evict":
                self._tell(f"evicted {rival.id}: replaced by {b.id}")
                spot[id(b)] = spot.pop(id(rival))
                kept[spot[id(b)]] = b
                grid.remove(rival)
                gone, cell = key_of.pop(id(rival))
                seen[gone].discard(cell)
            else:
                spot[id(b)] = len(kept)
                kept.append(b)
            grid.add(b)
            seen.setdefault(key, set()).add((x, y))
            key_of[id(b)] = key, (x, y)
        return kept, grid

    # -- matching ---------------------------------------------------------------------

    def _primary(self, b: Block, grid: Grid, drift: tuple[float, float]) -> Block | None:
        """The best track whose text matches."""
        if not b.sig:
            return None
        best, rank, view, alike = None, None, b.view, b.alike
        for t in grid.near(b):
            sig = t.sig
            lev = alike.get(sig, -1.0)
            if lev is None:
                continue
            if lev < 0:
                lev = alike[sig] = S.match(b.traits, t.traits, T.LEVENSHTEIN_MATCH, T.JACCARD_MATCH)
                if lev is None:
                    continue
            if t.view != view:
                continue
            (x, y), (tx, ty) = b.center, t.center
            order = (-lev, math.hypot(x - drift[0] - tx, y - drift[1] - ty), t.rect[1], t.rect[0], t.rect[2], t.rect[3])
            if rank is None or order < rank:
                best, rank = t, order
        return best

    def _banded(self, b: Block, grid: Grid, mode: str) -> Block | None:
        """The first track that the band identifies; all are counted, up to the first one to be admitted."""
        found, stats = None, self.stats
        for t in grid.near(b):
            if t.view != b.view or (b.alike.get(t.sig) is not None and b.sig and t.sig):
                continue
            stage = self._band_stage(b, t)
            stats["considered"] += 1
            stats[stage] += 1
            if stage == "identified" and mode == "admit":
                found = t
                break
        return found

    def _would_band(self, b: Block, grid: Grid) -> bool:
        return any(t.view == b.view and (b.alike.get(t.sig) is None or not b.sig or not t.sig) and self._band_stage(b, t) == "identified" for t in grid.near(b))

    def find(self, b: Block, grid: Grid, snapshot: dict, *, dry: bool = False, known: tuple | None = None) -> tuple[Block | None, str]:
        """(track, how): 'primary', 'band', 'nested' or 'new'. ``known`` has the best text match if it was looked for."""
        best = known[0] if known else self._primary(b, grid, snapshot.get(self._space(b), (0.0, 0.0)))
        if dry:
            return (best, "primary") if best is not None else (None, "new")
        mode = self.config.band_mode
        band = self._banded(b, grid, mode) if mode != "off" else None
        self.stats["primary" if best else "no_primary"] += 1
        if best is not None:
            return best, "primary"
        if band is not None:
            self.stats["admitted"] += 1
            return band, "band"
        if self.watch_bands and not self.bands:
            self.bands = self._would_band(b, grid)
        host = self._host(b, grid)
        return (host, "nested") if host else (None, "new")

    def _band_stage(self, b: Block, t: Block) -> str:
        if t.obs < self.config.band_floor:
            return "floor"
        near = self.spatial(b, t) if self.spatial else S.overlap_ratio(b.rect, t.rect, self.drift.margin(self._space(t))) >= 0.80
        if not near:
            return "spatial"
        lev = jac = 0.0
        if b.sig and t.sig:
            lev, jac = S.levenshtein_ratio(b.sig, t.sig), S.jaccard(b.sig, t.sig)
        return "identified" if lev >= self.config.band_lev or jac >= self.config.band_jac else "text"

    def _host(self, b: Block, grid: Grid) -> Block | None:
        mine, found, r, view, lane = b.area, None, b.rect, b.view, b.hz
        for near in (grid.region(r), grid.near(b)):  # one met twice is taken once, as its size is not less than its own
            for t in near:
                if t.area <= mine or t.view != view or t.provisional or t.obs < 1:
                    continue
                q, size = t.rect, t.area
                w, h = min(r[2], q[2]) - max(r[0], q[0]), min(r[3], q[3]) - max(r[1], q[1])
                if not (w > 0 and h > 0) or not same_lane(b, t) or not size > mine > 0:
                    continue
                if w * h / mine >= 0.8 and (found is None or size < found.area) and S.best_window(b.sig, t.sig) >= T.LEVENSHTEIN_MATCH:
                    found = t
        return found

    # -- contradictions ------------------------------------------------------------------

    def grouping(self, fresh: list[Block], batch: Grid) -> list[tuple[Block, list[Block]]]:
        out = []
        for t in self.tracks if len(fresh) >= 2 else ():
            if t.obs < WELL_OBSERVED or t.view:
                continue
            size, tall = t.area, t.rect[3] - t.rect[1]
            if not (tall > 0 and t.rect[2] > t.rect[0]):
                continue
            parts = [b for b in batch.region(t.rect) if b.rect[3] - b.rect[1] < 0.7 * tall and S.common(t.rect, b.rect) > 0 and S.common(t.rect, b.rect) / size >= 0.3]
            if len(parts) < 2:
                continue
            parts.sort(key=lambda b: b.rect[1])
            if S.levenshtein_ratio(t.sig, S.significant(" ".join(b.text for b in parts))) >= 0.60:
                out.append((t, parts))
        return out

    def splitting(self, fresh: list[Block], grid: Grid) -> list[tuple[Block, list[Block]]]:
        out, used = [], set()
        for b in fresh:
            tall = b.rect[3] - b.rect[1]
            if b.view or not (tall > 0 and b.rect[2] > b.rect[0]):
                continue
            parts = [t for t in grid.region(b.rect) if t.obs >= WELL_OBSERVED and id(t) not in used and t.rect[3] - t.rect[1] < 0.7 * tall and t.area > 0 and S.common(b.rect, t.rect) / t.area >= 0.80]
            if len(parts) < 2:
                continue
            parts.sort(key=lambda t: t.rect[1])
            if S.levenshtein_ratio(b.sig, S.significant(" ".join(t.text for t in parts))) >= 0.60:
                used.update(map(id, parts))
                out.append((b, parts))
        return out

    # -- coherent shift --------------------------------------------------------------------

    def plan(self, found: list[tuple[Block, Block | None]]) -> dict | None:
        """Translation that a quorum of moved blocks agrees on, with its members."""
        return self.agreed(*self.moves(found), self.config)

    def moves(self, found: list[tuple[Block, Block | None]]) -> tuple[list[tuple], list[tuple]]:
        """Pairs that moved far, in the order of their displacement, and those near."""
        moved, agreeing = [], []
        for arrival, (b, t) in enumerate(found):
            if t is None or t.provisional or b.view or b.hz >= 0 or t.hz >= 0:
                continue
            drift = self.drift.median(self._space(b))
            dx, dy = b.rect[0] - drift[0] - t.rect[0], b.rect[1] - drift[1] - t.rect[1]
            h = S.height_of(t.rect)
            if math.hypot(dx, dy) > 3 * h:
                moved.append((dy, dx, t.rect[1], t.rect[0], h, arrival, t, drift))
            else:
                agreeing.append((dx, dy, h, t, drift))
        moved.sort(key=lambda m: m[:6])
        return moved, agreeing

    @staticmethod
    def agreed(moved: list[tuple], agreeing: list[tuple], c: Config) -> dict | None:
        """The plan of one configuration for these pairs."""
        if not moved:
            return None

        def window(rows: list[tuple], least: int) -> list[tuple] | None:
            """The first of the largest runs, by displacement, whose members agree.

            Both ends of a run are within the tolerance of its middle, so a run spans at
            most twice that; no longer one is tried from a start.
            """
            spread, end, reach = 2 * c.tolerance * max((r[4] for r in rows), default=0.0) * (1 + 1e-9), 0, []
            for at, row in enumerate(rows):
                while end < len(rows) and rows[end][0] - row[0] <= spread:
                    end += 1
                reach.append(end - at)
            starts: dict[int, list[int]] = {}
            for at, most in enumerate(reach):
                starts.setdefault(most, []).append(at)
            able: list[int] = []
            for size in range(max(reach, default=0), least - 1, -1):
                able = sorted(able + starts.get(size, []))
                for at in able:
                    part = rows[at : at + size]
                    mx, my, mh = (S.median([p[i] for p in part]) for i in (1, 0, 4))
                    if all(math.hypot(p[1] - mx, p[0] - my) <= c.tolerance * min(p[4], mh) for p in part):
                        return part
            return None

        group, source = (window(moved, c.min_blocks) if len(moved) >= c.min_blocks else None), "quorum"
        if group is not None and len(group) / len(moved) < c.min_share:
            group = None
        if group is None and c.floor_px is not None:
            far = [m for m in moved if math.hypot(m[1], m[0]) >= c.floor_px]
            mixed = any(max(m[i] for m in far) > 1 and min(m[i] for m in far) < -1 for i in (0, 1)) if far else True
            group, source = (None if mixed else window(far, 1)), "floor"
        if group is None and c.reanchor_blocks is not None:
            group, source = window(moved, c.reanchor_blocks), "reanchor"
        if not group:
            return None
        tx, ty = S.median([m[1] for m in group]), S.median([m[0] for m in group])
        members = {id(m[6]): m[7] for m in group}
        tall = S.median([S.height_of(m[6].rect) for m in group])
        adopted = set()
        for dx, dy, h, t, drift in agreeing if c.adopt else ():
            if math.hypot(dx - tx, dy - ty) <= c.tolerance * min(h, tall):
                members[id(t)] = drift
                adopted.add(id(t))
        return {"tx": tx, "ty": ty, "members": members, "adopted": adopted, "source": source}

    # -- merging ----------------------------------------------------------------------------

    def _vote(self, b: Block, t: Block) -> dict:
        classes = {**t.classes, b.weight: t.classes.get(b.weight, 0) + 1}
        lead = b.weight
        if len(classes) > 1:
            top = max(classes.values())
            lead = next(k for k, v in classes.items() if v == top)
        lanes = {**t.lanes, b.hz: t.lanes.get(b.hz, 0) + 1}
        votes = {k: list(v) for k, v in t.votes.items()}
        if not votes and t.sig:
            votes[t.sig] = [t.text, t.tconf, t.tconf]
        old = votes.get(b.sig)
        votes[b.sig] = [b.text if old is None or b.tconf > old[2] else old[0], (old[1] if old else 0.0) + b.tconf, max(b.tconf, old[2] if old else 0.0)]
        if len(votes) > MAX_VOTES:
            order = list(votes)
            del votes[min(order, key=lambda k: (votes[k][1], -order.index(k)))]
        text, high, sure = next(iter(votes.values()))
        for v in votes.values():
            if v[1] > high:
                text, high, sure = v
        if text != t.text:
            tconf = sure
        elif t.text == b.text:
            total = t.tconf + b.tconf
            w = b.tconf / total if total > 0 else 0.5
            tconf = min(max(t.tconf * (1 - w) + b.tconf * w, 0.0), 1.0)
        else:
            tconf = t.tconf
        return {"classes": classes, "reclassify": lead != t.weight, "lanes": lanes, "votes": votes, "text": text, "tconf": tconf, "srcq": max(t.srcq, b.srcq)}

    def merge(self, b: Block, t: Block, how: str = "primary", plan: dict | None = None, track_drift: bool = True) -> tuple[Block, str | None]:
        """(merged track, step response applied) of one pair."""
        c = self.config
        if how == "nested":
            return t.twin(obs=t.obs + 1, provisional=False, remaining=0, srcq=max(t.srcq, b.srcq), misses=0), None
        if t.provisional:
            return t.twin(provisional=t.remaining > 1, remaining=t.remaining - 1, misses=0), None
        if track_drift:
            self.drift.add(b, b.rect[0] - t.rect[0], b.rect[1] - t.rect[1])
        member = plan is not None and id(t) in plan["members"]
        dx, dy = plan["members"][id(t)] if member else self.drift.median(self._space(b))
        fresh, base, response = S.shift(b.rect, -dx, -dy), t.rect, None
        scale = 3 * S.height_of(t.rect)
        anchor = t.pconf * (1 if c.position == "legacy" else max(1, t.obs))
        w = b.pconf / (anchor + b.pconf) if anchor + b.pconf > 0 else 0.5
        follows = how != "band" and c.position != "legacy" and not b.view and b.hz < 0 and t.hz < 0
        off = math.hypot(fresh[0] - base[0], fresh[1] - base[1])
        self.snaps = self.snaps or (follows and off > c.snap_times * scale)
        if follows and c.step == "snap" and off > c.snap_times * scale:
            w, off, response = 1.0, 0.0, "snap"
        elif follows and c.step == "coherent" and member:
            base, response = S.shift(base, plan["tx"], plan["ty"]), "coherent"
            off = math.hypot(fresh[0] - base[0], fresh[1] - base[1])
        v = 1 - w
        rect = (base[0] * v + fresh[0] * w, base[1] * v + fresh[1] * w, base[2] * v + fresh[2] * w, base[3] * v + fresh[3] * w)
        n = max(1, t.obs)
        pconf = min(t.pconf + b.pconf, 1.0) if c.position == "legacy" else (t.pconf * n + min(max(1 - off / scale, 0.0), 1.0)) / (n + 1)
        band = how == "band"
        return t.twin(rect=rect, pconf=pconf, obs=t.obs + 1, provisional=band, remaining=c.band_captures if band else 0, misses=0, **self._vote(b, t)), response

    # -- the step -----------------------------------------------------------------------------

    def step(self, capture: list[Block], check=None) -> dict:  # noqa: ANN001
        """Take one capture (also an empty one) and return its decisions."""
        return self.decide(self.look(capture), check=check)

    def look(self, capture: list[Block]) -> dict:
        """What a capture says before any decision; the state stays as it is."""
        for i, b in enumerate(capture):
            if not (0 <= b.pconf <= 1 and 0 <= b.tconf <= 1):
                raise ValueError(f"confidence of block {i} is not in [0, 1]")
        fresh, batch = self.dedup(capture)
        grid = Grid(self.config, self.tracks)
        snapshot = {self._space(b): self.drift.median(self._space(b)) for b in fresh}
        grouped, split = self.grouping(fresh, batch), self.splitting(fresh, grid)
        found = [self._primary(b, grid, snapshot[self._space(b)]) for b in fresh]
        return {"fresh": fresh, "grid": grid, "snapshot": snapshot, "grouping": grouped, "splitting": split, "found": found}

    def planned(self, seen: dict, configs: list[Config]) -> list[dict | None]:
        """The plan of the capture for each of these configurations."""
        moved, agreeing = self.moves(list(zip(seen["fresh"], seen["found"])))
        return [self.agreed(moved, agreeing, c) if c.step == "coherent" and c.position != "legacy" else None for c in configs]

    def decide(self, seen: dict, plans: list[dict | None] | None = None, check=None) -> dict:  # noqa: ANN001
        """The decisions on a capture that :meth:`look` saw in this state."""
        fresh, grid, snapshot, grouped, split = (seen[k] for k in ("fresh", "grid", "snapshot", "grouping", "splitting"))
        plan = (plans or self.planned(seen, [self.config]))[0]
        self.snaps = self.bands = False
        contradicted = {id(t) for t, _ in grouped}
        stable: list[Block] = []
        log, nested, pairs, matched = [], [], [], {}
        invalid, settled, members, adopted, merged, admitted = [], [], 0, 0, 0, 0

        def admit(b: Block) -> None:
            nonlocal admitted
            b.track, self.next_track, admitted = self.next_track, self.next_track + 1, admitted + 1
            b.__dict__.pop("alike", None)
            stable.append(b)
            log.append(("admit", b, None, b, None))

        def take(b: Block, t: Block, how: str) -> str | None:
            nonlocal merged
            frozen = t.provisional and how != "nested"
            out, response = self.merge(b, t, how, plan)
            out = self.merger(t, b, out) if self.merger else out
            if id(t) in matched:  # two fresh rows may continue one track: each is its own
                out.track, self.next_track = self.next_track, self.next_track + 1
            matched[id(t)] = t
            merged += 1
            stable.append(out)
            log.append(("freeze" if frozen else how, b, t, out, response))
            if not frozen and how != "nested":
                if out.text != t.text:
                    invalid.append(t.text)
                elif check is not None and check(b, t):
                    invalid.append(t.text)
            if not frozen and out.obs >= WELL_OBSERVED:
                settled.append(out.text)
            return response

        for b, best in zip(fresh, seen["found"]):
            t, how = self.find(b, grid, snapshot, known=(best,))
            if t is None:
                admit(b)
            elif how == "nested":
                nested.append((b, t))
            else:
                if how != "band" and not t.provisional and not b.view and b.hz < 0 and t.hz < 0:
                    pairs.append((*t.center, *b.center))
                if take(b, t, how) == "coherent":
                    members += 1
                    adopted += id(t) in plan["adopted"]
        for b, t in nested:
            if id(t) in contradicted:
                admit(b)
            elif id(t) not in matched:
                take(b, t, "nested")
        retained, dropped = self._retain(stable, matched, grid)
        when = f" at {self.clock()}" if self.clock else ""
        self._tell(f"step{when}: {merged} merged, {admitted} admitted, {len(retained)} retained, {dropped} dropped")
        self.tracks = [*stable, *retained]
        return {
            "stable": stable, "retained": retained, "dropped": dropped, "merged": merged, "admitted": admitted, "log": log, "grouping": grouped, "splitting": split,
            "invalidated": invalid, "settled": settled, "fit": fit(pairs, self.config.fit_pairs) if self.fits else None,
            "shift": {"tx": plan["tx"], "ty": plan["ty"], "members": members, "adopted": adopted, "source": plan["source"]} if plan and members else None,
        }

    def _retain(self, stable: list[Block], matched: dict, grid: Grid) -> tuple[list[Block], int]:
        rest = [t for t in self.tracks if id(t) not in matched]
        if not self.config.missed_frames:
            return [], len(rest)
        covered = set()
        for b in stable if rest else ():
            r = b.rect
            for t in (*grid.region(r), *grid.near(b)):
                q = t.rect
                w, h = min(r[2], q[2]) - max(r[0], q[0]), min(r[3], q[3]) - max(r[1], q[1])
                if w > 0 and h > 0 and id(t) not in matched and b.view == t.view and same_lane(b, t) and t.area > 0:
                    if w * h / t.area >= max(t.overlap_threshold, 0.5):
                        covered.add(id(t))
        kept = []
        for t in rest:
            if id(t) not in covered and t.misses + 1 <= self.config.missed_frames:
                kept.append(t.twin(misses=t.misses + 1))
        return kept, len(rest) - len(kept)

    def uncorrected(self, key: str) -> list[Block]:
        return [t for t in self.tracks if self._space(t) == key and t.obs < WELL_OBSERVED]

    # -- state ----------------------------------------------------------------------------------

    def dump(self) -> str:
        tracks = [{**asdict(t), "classes": list(t.classes.items()), "lanes": list(t.lanes.items())} for t in self.tracks]
        drift = {"rings": {k: list(v) for k, v in self.drift.rings.items()}, "propagated": self.drift.propagated, "emitted": self.drift.emitted, "total": self.drift.total}
        return json.dumps({"tracks": tracks, "drift": drift, "stats": self.stats, "next": self.next_track})

    @staticmethod
    def load(state: str, config: Config = Config()) -> Session:
        raw, out = json.loads(state), Session(config)
        for t in raw["tracks"]:
            out.tracks.append(Block(**{**t, "rect": tuple(t["rect"]), "classes": dict(map(tuple, t["classes"])), "lanes": dict(map(tuple, t["lanes"]))}))
        d = raw["drift"]
        out.drift.rings = {k: deque(map(tuple, v), maxlen=RING) for k, v in d["rings"].items()}
        out.drift.propagated = {k: tuple(v) for k, v in d["propagated"].items()}
        out.drift.emitted, out.drift.total, out.stats, out.next_track = d["emitted"], d["total"], raw["stats"], raw["next"]
        return out


def fit(pairs: list[tuple], least: int = 3) -> dict | None:
    """Scale and shift by least squares, trimmed once at three median residuals."""
    first = _fit(pairs, least)
    if first is None:
        return None
    off = [_off(first, p) for p in pairs]
    near = [p for p, o in zip(pairs, off) if o <= 3 * S.median(off)]
    again = _fit(near, least) if least <= len(near) < len(pairs) else None
    out, used = (again, near) if again else (first, pairs)
    axis = 0 if max(p[0] for p in used) - min(p[0] for p in used) >= max(p[1] for p in used) - min(p[1] for p in used) else 1
    v = sorted(p[axis] for p in used)
    gap = max((b - a for a, b in zip(v, v[1:])), default=0.0) / (v[-1] - v[0]) if v[-1] > v[0] else 0.0
    residual = math.sqrt(sum(_off(out, p) ** 2 for p in used) / len(used))
    return {**out, "pairs": len(used), "rejected": len(pairs) - len(used), "residual": residual, "largest_gap": gap}


def _off(f: dict, p: tuple) -> float:
    return math.hypot(f["scale"] * p[0] + f["tx"] - p[2], f["scale"] * p[1] + f["ty"] - p[3])


def _fit(pairs: list[tuple], least: int) -> dict | None:
    n = len(pairs)
    if n < least:
        return None
    m = [sum(p[i] for p in pairs) / n for i in range(4)]
    sxx = sum((p[0] - m[0]) ** 2 + (p[1] - m[1]) ** 2 for p in pairs)
    sxy = sum((p[0] - m[0]) * (p[2] - m[2]) + (p[1] - m[1]) * (p[3] - m[3]) for p in pairs)
    scale = sxy / sxx if sxx > 0 else 0.0
    if not (scale > 0 and math.isfinite(scale)):
        return None
    return {"scale": scale, "tx": m[2] - scale * m[0], "ty": m[3] - scale * m[1]}

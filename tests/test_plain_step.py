"""The capture step against a second, plain implementation on whole recorded sessions.

Written from the contract alone, without cells, indexes or shared helpers: every block is
compared with every track, every window is tried, medians sort their whole list.
"""

import math

import pandas as pd
import pytest

from glyphtrail import queries as tracker

IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF))


def is_cjk(c):
    return any(a <= ord(c) <= b for a, b in IDEOGRAPHS)


def sig(s):
    return "".join(c for c in s if is_cjk(c) or (c.isascii() and c.isalnum()))


def norm(s):
    return " ".join(s.replace("﻿", " ").split())


def half_up(x):
    return math.floor(x + 0.5)


def med(v):
    v = sorted(v)
    h = len(v) // 2
    return v[h] if len(v) % 2 else (v[h - 1] + v[h]) / 2


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def ratio(a, b):
    return 1.0 if not a and not b else 0.0 if not a or not b else 1 - distance(a, b) / max(len(a), len(b))


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def area(r):
    return (r[2] - r[0]) * (r[3] - r[1])


def shared(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def moved(r, dx, dy):
    return (r[0] + dx, r[1] + dy, r[2] + dx, r[3] + dy)


def tall(r):
    return r[3] - r[1] if math.isfinite(r[3] - r[1]) and r[3] - r[1] > 0 else 16.0


def weight(b):
    return 10 + 10 * (b["kind"] == "inner") + 10 * (b["hz"] >= 0)


def space(b):
    if weight(b) >= 30 or (b["kind"] == "inner" and b["cid"] is None):
        return "unknown"
    return (b["cid"] if b["kind"] == "inner" else "", math.floor(b["rect"][1] / 500))


def spots(b):
    x, y = (b["rect"][0] + b["rect"][2]) / 2, (b["rect"][1] + b["rect"][3]) / 2
    own = [("abs", half_up(x / 200), half_up(y / 200))]
    return own + ([("ic", own[0][1], half_up((y - b["top"]) / 200))] if b["kind"] == "inner" else [])


def neighbours(b, others):
    """In the order of layers, columns, rows and arrival."""
    out = []
    for layer, x, y in spots(b):
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                out += [o for o in others if (layer, x + i, y + j) in spots(o) and not any(o is p for p in out)]
    return out


def covered_page(r, others):
    xs = range(math.floor(r[0] / 200) - 1, math.ceil(r[2] / 200) + 2)
    ys = range(math.floor(r[1] / 200) - 1, math.ceil(r[3] / 200) + 2)
    return [o for o in others if spots(o)[0][1] in xs and spots(o)[0][2] in ys]


def lanes(a, b):
    return a["hz"] < 0 or b["hz"] < 0 or a["hz"] == b["hz"]


def limit(b):
    cjk = sum(map(is_cjk, b["text"])) / max(1, len(b["text"]))
    return 0.35 if cjk >= 0.6 else 0.65 if cjk < 0.3 and len(b["text"]) <= 8 else 0.5


class Plain:
    def __init__(self):
        self.tracks, self.rings = [], {}

    def height(self, key):
        return med([x[2] for x in self.rings[key]]) if self.rings.get(key) else 16.0

    def drift(self, key):
        ring = self.rings.get(key, [])
        if len(ring) < 3:
            return 0.0, 0.0
        h = self.height(key)
        return tuple(min(max(med([x[i] for x in ring]), -h), h) for i in (0, 1))

    def dedup(self, capture):
        kept, arrived = [], []
        for b in capture:
            if not norm(b["text"]):
                continue

            def place(o):
                top = o["rect"][1] - (o["top"] if o["kind"] == "inner" else 0)
                return half_up(o["rect"][0] / 200), half_up(top / 200)

            twins = [o for o in kept if norm(o["text"]) == norm(b["text"]) and (o["kind"] == "inner") == (b["kind"] == "inner") and max(o["hz"], -1) == max(b["hz"], -1)]
            if any(abs(place(o)[0] - place(b)[0]) <= 1 and abs(place(o)[1] - place(b)[1]) <= 1 for o in twins):
                continue
            dx, dy = self.drift(space(b))
            m = min(abs(dx) + abs(dy), self.height(space(b)))
            rival = None
            for o in neighbours(b, arrived):
                p, q = b["rect"], o["rect"]
                if b["kind"] == o["kind"] == "inner":
                    p, q = moved(p, 0, -b["top"]), moved(q, 0, -o["top"])
                small = min(area(p), area(q))
                if lanes(b, o) and small > 0 and shared((p[0] - m, p[1] - m, p[2] + m, p[3] + m), q) / small >= limit(b):
                    rival = o
                    break
            if rival is not None:
                mine, theirs = 0.4 * b["pconf"] + 0.6 * b["tconf"], 0.4 * rival["pconf"] + 0.6 * rival["tconf"]
                grown = (b["rect"][0] - m, b["rect"][1] - m, b["rect"][2] + m, b["rect"][3] + m)
                small = min(area(b["rect"]), area(rival["rect"]))
                much = min(max(shared(grown, rival["rect"]) / small, 0), 1) if small > 0 else 0
                if weight(b) != weight(rival):
                    wins = weight(b) > weight(rival)
                    if not wins:
                        continue
                else:
                    wins = (area(b["rect"]) > 0 and mine >= theirs and area(rival["rect"]) > 3 * area(b["rect"])) or mine >= theirs + (0 if much >= 0.7 else 0.1)
                if wins:
                    kept = [b if o is rival else o for o in kept]
                    arrived = [o for o in arrived if o is not rival] + [b]
                    continue
            kept.append(b)
            arrived.append(b)
        return kept, arrived

    def primary(self, b, snapshot):
        best = None
        x, y = (b["rect"][0] + b["rect"][2]) / 2, (b["rect"][1] + b["rect"][3]) / 2
        for t in neighbours(b, self.tracks):
            f, c = sig(b["text"]), sig(t["text"])
            if f and c and ((lev := ratio(f, c)) >= 0.7 or jaccard(f, c) >= 0.8):
                r, (dx, dy) = t["rect"], snapshot[space(b)]
                order = (-lev, math.hypot(x - dx - (r[0] + r[2]) / 2, y - dy - (r[1] + r[3]) / 2), r[1], r[0], r[2], r[3])
                if best is None or order < best[0]:
                    best = order, t
        return best[1] if best else None

    def host(self, b):
        f, found = sig(b["text"]), None
        near = covered_page(b["rect"], self.tracks)
        for t in near + [t for t in neighbours(b, self.tracks) if not any(t is p for p in near)]:
            w = sig(t["text"])
            if not lanes(b, t) or not area(t["rect"]) > area(b["rect"]) > 0 or shared(b["rect"], t["rect"]) / area(b["rect"]) < 0.8 or not 4 <= len(f) <= len(w):
                continue
            if max(1 - distance(f, w[i : i + len(f)]) / len(f) for i in range(len(w) - len(f) + 1)) >= 0.7 and (found is None or area(t["rect"]) < area(found["rect"])):
                found = t
        return found

    def contradicted(self, fresh, arrived):
        out = []
        for t in self.tracks if len(fresh) >= 2 else ():
            h = t["rect"][3] - t["rect"][1]
            if t["obs"] < 3 or h <= 0 or t["rect"][2] <= t["rect"][0]:
                continue
            parts = [b for b in covered_page(t["rect"], arrived) if b["rect"][3] - b["rect"][1] < 0.7 * h and shared(t["rect"], b["rect"]) > 0 and shared(t["rect"], b["rect"]) / area(t["rect"]) >= 0.3]
            parts.sort(key=lambda b: b["rect"][1])
            if len(parts) >= 2 and ratio(sig(t["text"]), sig(" ".join(b["text"] for b in parts))) >= 0.6:
                out.append(t)
        return out

    def shift(self, found):
        far, close = [], []
        for k, (b, t) in enumerate(found):
            if t is None or b["hz"] >= 0 or t["hz"] >= 0:
                continue
            d = self.drift(space(b))
            dx, dy = b["rect"][0] - d[0] - t["rect"][0], b["rect"][1] - d[1] - t["rect"][1]
            h = tall(t["rect"])
            if math.hypot(dx, dy) > 3 * h:
                far.append((dy, dx, t["rect"][1], t["rect"][0], h, k, t, d))
            else:
                close.append((dx, dy, h, t, d))
        far.sort(key=lambda m: m[:6])
        group = None
        for size in range(len(far), 2, -1):
            for at in range(len(far) - size + 1):
                part = far[at : at + size]
                x, y, h = med([p[1] for p in part]), med([p[0] for p in part]), med([p[4] for p in part])
                if group is None and all(math.hypot(p[1] - x, p[0] - y) <= 0.5 * min(p[4], h) for p in part):
                    group = part
        if group is None or len(group) / len(far) < 0.5:
            return None
        x, y, h = med([m[1] for m in group]), med([m[0] for m in group]), med([tall(m[6]["rect"]) for m in group])
        members = [(m[6], m[7]) for m in group] + [(t, d) for dx, dy, own, t, d in close if math.hypot(dx - x, dy - y) <= 0.5 * min(own, h)]
        return x, y, members

    def merge(self, b, t, plan):
        self.note(b, t)
        member = next((d for m, d in plan[2] if m is t), None) if plan else None
        dx, dy = member if member is not None else self.drift(space(b))
        new, base = moved(b["rect"], -dx, -dy), t["rect"]
        n = max(1, t["obs"])
        anchor = t["pconf"] * n
        w = b["pconf"] / (anchor + b["pconf"]) if anchor + b["pconf"] > 0 else 0.5
        step = member is not None and b["hz"] < 0 and t["hz"] < 0
        if step:
            base = moved(base, plan[0], plan[1])
        off, scale = math.hypot(new[0] - base[0], new[1] - base[1]), 3 * tall(t["rect"])
        out = {**t, "rect": tuple(a * (1 - w) + f * w for a, f in zip(base, new)), "obs": t["obs"] + 1, "pconf": (t["pconf"] * n + min(max(1 - off / scale, 0), 1)) / (n + 1)}
        votes = [list(v) for v in t["votes"]] or ([[sig(t["text"]), t["text"], t["tconf"], t["tconf"]]] if sig(t["text"]) else [])
        mine = next((v for v in votes if v[0] == sig(b["text"])), None)
        if mine is None:
            votes.append([sig(b["text"]), b["text"], b["tconf"], b["tconf"]])
        else:
            mine[1:] = [b["text"] if b["tconf"] > mine[3] else mine[1], mine[2] + b["tconf"], max(mine[3], b["tconf"])]
        if len(votes) > 5:
            votes.remove(min(reversed(votes), key=lambda v: v[2]))
        best = max(votes, key=lambda v: v[2])
        if best[1] != t["text"]:
            out["tconf"] = best[3]
        elif t["text"] == b["text"]:
            total = t["tconf"] + b["tconf"]
            w = b["tconf"] / total if total > 0 else 0.5
            out["tconf"] = min(max(t["tconf"] * (1 - w) + b["tconf"] * w, 0), 1)
        return {**out, "text": best[1], "votes": votes}, "coherent" if step else None

    def note(self, b, t):
        left_out = weight(b) >= 30 or (weight(b) == 20 and (b["hz"] >= 0 or b["cid"] is None))
        if not left_out:
            ring = self.rings.setdefault(space(b), [])
            ring.append((b["rect"][0] - t["rect"][0], b["rect"][1] - t["rect"][1], tall(b["rect"])))
            del ring[:-20]

    def step(self, capture):
        fresh, arrived = self.dedup(capture)
        snapshot = {space(b): self.drift(space(b)) for b in fresh}
        contra = self.contradicted(fresh, arrived)
        plan = self.shift([(b, self.primary(b, snapshot)) for b in fresh])
        stable, nested, used, log = [], [], [], []
        for b in fresh:
            t = self.primary(b, snapshot)
            if t is not None:
                out, response = self.merge(b, t, plan)
                used.append(t)
                stable.append(out)
                log.append(("primary", b["id"], t["obs"], out, response))
            elif (t := self.host(b)) is not None:
                nested.append((b, t))
            else:
                stable.append(b)
                log.append(("admit", b["id"], None, b, None))
        for b, t in nested:
            if any(t is c for c in contra):
                stable.append(b)
                log.append(("admit", b["id"], None, b, None))
            elif not any(t is u for u in used):
                used.append(t)
                stable.append({**t, "obs": t["obs"] + 1})
                log.append(("nested", b["id"], t["obs"], stable[-1], None))
        self.tracks = stable
        return log


def test_every_decision_of_the_recorded_sessions(spark, data):
    rows = tracker._obs(spark, data).toPandas().sort_values(["session_id", "cap", "seq", "id"])
    got = tracker.QUERIES["q_track_session"](spark, data).toPandas()
    got = {(r.session_id, r.cap, r.fresh_id): r for r in got.itertuples()}
    caps = spark.read.parquet(f"{data}/captures.parquet").toPandas()[["session_id", "cap"]].drop_duplicates()
    every = pd.concat([caps, rows[["session_id", "cap"]]]).drop_duplicates()
    seen = 0
    for session, own in every.groupby("session_id"):
        plain = Plain()
        mine = rows[rows.session_id == session]
        for cap in sorted(own.cap):
            capture = [
                {"id": r.id, "rect": (r.l, r.t, r.r, r.b), "text": r.text, "pconf": r.pconf, "tconf": r.tconf, "kind": r.kind, "hz": r.hz, "cid": r.cid, "top": r.inner_top, "obs": 1, "votes": []}
                for r in mine[mine.cap == cap].itertuples()
            ]
            for how, fresh, before, out, response in plain.step(capture):
                r = got.pop((session, cap, fresh))
                assert (r.how, r.response) == (how, response), (session, cap, fresh)
                assert (pd.isna(r.obs_before) and before is None) or r.obs_before == before
                assert r.pconf == pytest.approx(out["pconf"], abs=2e-6) and r.tconf == pytest.approx(out["tconf"], abs=2e-6), (session, cap, fresh)
                seen += 1
    assert not got and seen > 500

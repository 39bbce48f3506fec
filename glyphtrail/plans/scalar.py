"""Scalar twins of the column functions, for the order-dependent kernels."""

from __future__ import annotations

import math
import re
import statistics
from dataclasses import dataclass
from functools import lru_cache

from glyphtrail.functions import text as T
from glyphtrail.functions.coordinates import REGION

_IDEOGRAPHS = "一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df"
_NOT_SIGNIFICANT = re.compile(f"[^0-9A-Za-z{_IDEOGRAPHS}]")
_IDEOGRAPH = re.compile(f"[{_IDEOGRAPHS}]")
_SPACES = re.compile(r"[\s﻿]+")

Rect = tuple[float, float, float, float]


@lru_cache(maxsize=65536)
def significant(text: str) -> str:
    return _NOT_SIGNIFICANT.sub("", text)


def normalize(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


def cjk_only(text: str) -> str:
    return "".join(_IDEOGRAPH.findall(text))


def cjk_fraction(text: str) -> float:
    return len(cjk_only(text)) / len(text) if text else 0.0


def distance(a: str, b: str) -> int:
    """Edit distance, bit-parallel over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        match = masks.get(c, 0)
        d = ((((match & plus) + plus) ^ plus) | match) | minus
        up, down = minus | ~(d | plus), plus & d
        score += bool(up & top) - bool(down & top)
        up = (up << 1) | 1
        plus, minus = ((down << 1) | ~(d | up)) & full, up & d & full
    return score


@lru_cache(maxsize=65536)
def levenshtein_ratio(a: str, b: str) -> float:
    """Of two significant texts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1.0 - distance(a, b) / max(len(a), len(b))


@dataclass(slots=True)
class Traits:
    """Of a significant text: its letters, and both, with and without repeats, folded into 256 bits."""

    text: str
    letters: frozenset[str]
    bits: int
    bag: int


@lru_cache(maxsize=65536)
def traits(text: str) -> Traits:
    bits = bag = 0
    times: dict[str, int] = {}
    for c in text:
        n = times[c] = times.get(c, 0) + 1
        bits |= 1 << (ord(c) & 255)
        bag |= 1 << (ord(c) + 37 * n & 255)
    return Traits(text, frozenset(times), bits, bag)


def match(a: Traits, b: Traits, lev: float, jac: float) -> float | None:
    """The edit ratio of two significant texts if it or the Jaccard index is large enough.

    A letter (or its n-th repeat) of one whose bit the other lacks is not in the other:
    it takes an edit, and is in the union only. Most pairs are told apart by that.
    """
    x, y = a.text, b.text
    if x == y:
        return 1.0 if x else None
    if not x or not y:
        return None
    n, m = len(a.letters), len(b.letters)
    apart = (a.bits & ~b.bits).bit_count()
    near = (n - apart) / (m + apart) >= jac
    if near:
        both = len(a.letters & b.letters)
        near = both / (n + m - both) >= jac
    if not near and 1.0 - max((a.bag & ~b.bag).bit_count(), (b.bag & ~a.bag).bit_count(), abs(len(x) - len(y))) / max(len(x), len(y)) < lev:
        return None
    ratio = levenshtein_ratio(x, y)
    return ratio if near or ratio >= lev else None


def jaccard(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@lru_cache(maxsize=65536)
def best_window(fragment: str, whole: str, minimum: int = T.WINDOW_MINIMUM) -> float:
    n = len(fragment)
    if n < minimum or not n or n > len(whole):
        return 0.0
    return max(1.0 - distance(fragment, whole[i : i + n]) / n for i in range(len(whole) - n + 1))


def area(r: Rect) -> float:
    return (r[2] - r[0]) * (r[3] - r[1])


def common(a: Rect, b: Rect) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return w * h if w > 0 and h > 0 else 0.0


def center(r: Rect) -> tuple[float, float]:
    return r[0] + (r[2] - r[0]) / 2, r[1] + (r[3] - r[1]) / 2


def shift(r: Rect, dx: float, dy: float) -> Rect:
    return r[0] + dx, r[1] + dy, r[2] + dx, r[3] + dy


def height_of(r: Rect) -> float:
    h = r[3] - r[1]
    return h if math.isfinite(h) and h > 0 else 16.0


def overlap_ratio(a: Rect, b: Rect, margin: float = 0.0) -> float:
    small = min(area(a), area(b))
    if a[0] >= a[2] or a[1] >= a[3] or b[0] >= b[2] or b[1] >= b[3] or small <= 0:
        return 0.0
    grown = (a[0] - margin, a[1] - margin, a[2] + margin, a[3] + margin)
    return min(max(common(grown, b) / small, 0.0), 1.0)


def half_up(x: float) -> int:
    """Rounding half away from zero."""
    return int(x + 0.5) if x >= 0 else -int(0.5 - x)


def median(values: list[float]) -> float:
    return statistics.median(values)


def hinges(values: list[float]) -> tuple[float, float]:
    s, half = sorted(values), len(values) // 2
    return median(s[:half]), median(s[len(s) - half :])


def upper_fence(values: list[float], minimum: int = 4) -> float | None:
    if len(values) < max(2, minimum):
        return None
    low, high = hinges(values)
    spread = high - low or (max(values) - min(values)) / 4
    return high + (2.2 if len(values) < 15 else 1.5) * spread if spread > 0 else None


def otsu(values: list[float]) -> float | None:
    """The value that splits small from large ones best; rules of thumb for few."""
    n, s = len(values), sorted(values)
    if n < 2:
        return None
    if s[0] == s[-1]:
        return s[0] + 1
    middle = median(s)
    if n < 10:
        return (middle + s[-1]) / 2 if n >= 5 and s[-1] > 3 * middle else 1.8 * middle
    total, mean = sum(s), sum(s) / n
    variance = sum((x - mean) ** 2 for x in s) / n
    best, cut, left = -1.0, None, 0.0
    for i in range(1, n):
        left += s[i - 1]
        if s[i] != s[i - 1]:
            gap = left / i - (total - left) / (n - i)
            between = i / n * (n - i) / n * gap * gap
            if between > best:
                best, cut = between, (s[i - 1] + s[i]) / 2
    return None if variance < 1e-6 or best < 0.2 * variance else cut


def region(top: float) -> int:
    return math.floor(top / REGION)

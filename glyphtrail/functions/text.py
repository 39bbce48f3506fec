"""Text normalisation and similarity as Catalyst expressions.

Lengths and offsets count code points. Nulls give null. All functions stay inside
whole-stage codegen, except :func:`containment_ratio`, which needs a longest common
subsequence and runs as an Arrow-batched UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# The ideograph ranges, sentence ends and commas of the reference.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}"
SENTENCE_ENDS = ("。", "！", "？", "…")
COMMAS = ("，", "、")

LEVENSHTEIN_MATCH, JACCARD_MATCH = 0.70, 0.80
WINDOW_MINIMUM = 4
LCS_LIMIT = 5000


def normalize_whitespace(s: Column) -> Column:
    """Runs of Unicode white space become one space; none at either end."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[\s\x{FEFF}]+", " "), "^ | $", "")


def is_blank(s: Column) -> Column:
    return F.length(normalize_whitespace(s)) == 0


def short_head(s: Column, n: int) -> Column:
    return F.substring(s, 1, n)


def cjk_only(s: Column) -> Column:
    return F.regexp_replace(s, f"[^{IDEOGRAPHS}]", "")


def cjk_fraction(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0.0).otherwise(F.length(cjk_only(s)) / F.greatest(F.length(s), F.lit(1)))


def significant(s: Column) -> Column:
    """Only ideographs, ASCII digits and ASCII letters; case is kept."""
    return F.regexp_replace(s, f"[^0-9A-Za-z{IDEOGRAPHS}]", "")


def char_set(sig: Column) -> Column:
    """Distinct characters of a text that is already significant; empty for empty."""
    return F.when(F.length(sig) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(sig, "")))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, of two significant texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of characters two character sets have in common."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def text_similar(lev: Column, jac: Column, a: Column, b: Column) -> Column:
    """The match test on ready scores; an empty significant text never matches."""
    return (F.length(a) > 0) & (F.length(b) > 0) & ((lev >= LEVENSHTEIN_MATCH) | (jac >= JACCARD_MATCH))


def best_window(fragment: Column, whole: Column, minimum: int = WINDOW_MINIMUM) -> Column:
    """Highest similarity of ``fragment`` to a window of ``whole`` of its length."""
    n, m = F.length(fragment), F.length(whole)
    fits = (n >= minimum) & (n > 0) & (n <= m)
    spots = F.sequence(F.lit(1), F.when(fits, m - n + 1).otherwise(1))
    scores = F.transform(spots, lambda i: 1.0 - F.levenshtein(fragment, F.substring(whole, i, n)) / F.greatest(n, F.lit(1)))
    return F.when(fits, F.array_max(scores)).otherwise(0.0)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def containment_ratio(inner: pd.Series, outer: pd.Series) -> pd.Series:
    """Common subsequence of both texts over the whole length of the inner one."""

    def ratio(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        return lcs_length(a[:LCS_LIMIT], b[:LCS_LIMIT]) / len(a) if a and b else 0.0

    return pd.Series([ratio(a, b) for a, b in zip(inner, outer)], dtype="float64")


def ends_sentence(s: Column) -> Column:
    return F.right(s, F.lit(1)).isin(*SENTENCE_ENDS)


def ends_comma(s: Column) -> Column:
    return F.right(s, F.lit(1)).isin(*COMMAS)


def density(s: Column, area: Column) -> Column:
    """Characters for each square pixel; null without an area."""
    return F.length(s) / F.nullif(area, F.lit(0.0))


def text_hash(s: Column) -> Column:
    """A stable hash as base-36 text; only equality is meaningful."""
    return F.lower(F.conv(F.hex(F.xxhash64(s)), 16, 36))


@F.pandas_udf(StringType())
def fnv1a64_hex(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes as 16 hex digits.

    Byte by byte over all texts of a batch at once: a step reads the next byte of every
    text that has one.
    """
    raw = [b"" if t is None else t.encode() for t in s]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data, start = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    left = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
    for i, n in enumerate(left):
        rows = order[:n]
        h[rows] = (h[rows] ^ data[start[rows] + i]) * np.uint64(0x100000001B3)
    return pd.Series([None if t is None else f"{x:016x}" for t, x in zip(s, h.tolist())], index=s.index, dtype=object)

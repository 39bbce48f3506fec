"""Find documents that contain passages of held-out evaluation items.

Texts are read as symbols: words, or single letters for items in scripts without word
gaps; letter case, width, punctuation, spacing and invisible characters do not count.
Every window of ``window`` symbols is embedded by the CGK random walk, which repeats a
symbol or moves on by a bit drawn from the symbol and the step, so that a small edit
distance of two windows becomes a small Hamming distance of their walks. Each of several
tables samples some steps of the walk; windows whose samples agree are candidates, and
the edit distance of the two windows decides. Equal windows agree in every table, so at
``max_edits`` 0 the recall is exactly 1; above it, the number of tables for a target
recall follows from the measured share of sampled steps on which two windows at that
distance still agree, over substitutions, insertions and deletions alike. Both windows
have the same length, so a symbol put in or left out counts twice: once where it is and
once at the end, where another symbol enters or leaves.

Before the walk, windows are passed over that have more than ``max_edits`` symbols that no
item has, or no run of symbols of an item as long as one that so few edits must leave
whole; this loses nothing. Item windows are looked up in every task while they stay
under ``MAX_LOCAL`` rows; a larger set is joined by bucket instead, where a bit for every
hashed symbol of the items, ``ALPHABET`` bits in all, stands in for the exact alphabet.
Both ways give the same rows and keep the types of the ids.

Defined results: null and blank texts and items give no pair; items or documents shorter
than the window give none; repeated documents are each reported; an empty table gives an
empty result. Texts of any length are read whole, in pieces that overlap by a window.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType

#: Item windows, times tables, kept in the driver and sent to every task: 16 bytes each.
MAX_LOCAL = 2_000_000
#: Bits of the alphabet of a larger set: 512 KiB in the driver and in each task.
ALPHABET = 1 << 22
#: Symbols of one text that are walked at a time.
PIECE = 1_000_000
#: Walk steps for each symbol of a window.
STRETCH = 3

_INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}͏︀-️&&[^\s]]", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def normalise(text: str) -> str:
    if text.isascii() and "".join(text.split()).isprintable():
        return text.lower()
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return unicodedata.normalize("NFKC", text.casefold())


@dataclass(frozen=True)
class Plan:
    """How one kind of items is read: the symbol, the window and the sampling."""

    letters: bool
    window: int
    max_edits: int = 0
    samples: int = 3
    recall: float = 0.95
    seed: int = 20

    @property
    def run(self) -> int:
        """Symbols in a row that ``max_edits`` edits leave whole in some place, at most 8."""
        return min(self.window // (self.max_edits + 1), 8 if self.letters else 4)

    @property
    def steps(self) -> int:
        return STRETCH * self.window

    @property
    def tables(self) -> int:
        """Repetitions for the target recall; one is sure to hit equal windows."""
        if not self.max_edits:
            return 1
        agreements = _agreement(self.window, self.steps, self.samples, self.max_edits)
        count = _tables(agreements, self.recall)
        if count is None:
            raise ValueError(f"windows of {self.window} with {self.max_edits} edits do not reach a recall of {self.recall} with {self.samples} sampled steps: sample fewer")
        return count

    def sampled(self) -> np.ndarray:
        """(tables, steps) flags of the steps each table samples."""
        rng = np.random.default_rng(self.seed)
        flags = np.zeros((self.tables, self.steps), bool)
        for row in flags:
            row[rng.choice(self.steps, self.samples, replace=False)] = True
        return flags


def _tables(agreements: tuple[float, ...], recall: float, most: int = 1 << 14) -> int | None:
    """The fewest tables by which a window pair is hit in at least one of them on average."""
    hit = np.array(agreements)
    low, high = 1, 1
    while 1 - ((1 - hit) ** high).mean() < recall:
        low, high = high, 2 * high
        if high > most:
            return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if 1 - ((1 - hit) ** mid).mean() >= recall else (mid + 1, high)
    return high


@lru_cache(maxsize=None)
def _agreement(window: int, steps: int, samples: int, edits: int, trials: int = 400) -> tuple[float, ...]:
    """For random pairs at ``edits`` edits, the chance that one sample of steps agrees.

    Measured with a fixed seed over mixed edits: substitutions count one, a symbol put
    in or left out two, since the windows keep their length.
    """
    rng = np.random.default_rng(7)
    plan = Plan(False, window, 0)
    symbol = lambda: int(rng.integers(1, 1 << 60))
    hits = []
    for _ in range(trials):
        a = [symbol() for _ in range(window)]
        b, left = list(a), edits
        while left:
            at = int(rng.integers(window))
            kind = int(rng.integers(3)) if left > 1 else 0
            if kind == 0:
                b[at] = symbol()
            elif kind == 1:
                b.insert(at, symbol())
                b.pop()
            else:
                b.pop(at)
                b.append(symbol())
            left -= 1 if kind == 0 else 2
        both = np.array([*a, *b], np.uint64)
        same = int((_walk(both, np.array([0]), plan) == _walk(both, np.array([window]), plan)).sum())
        hits.append(math.comb(same, samples) / math.comb(steps, samples))
    return tuple(hits)


def _walk(codes: np.ndarray, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """(steps, windows) symbols that the random walk of each window passes."""
    padded = np.append(codes, np.uint64(0))
    bits = np.stack([_mix(padded + np.uint64(64 * i + 1)) for i in range(-(-plan.steps // 64))])
    at, seen = np.zeros(len(starts), np.int64), np.zeros((plan.steps, len(starts)), np.uint64)
    for step in range(plan.steps):
        spot = np.where(at < plan.window, starts + at, len(codes))
        seen[step] = padded[spot]
        at += ((bits[step >> 6][spot] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
    return seen


def symbols(text: str | None, letters: bool) -> list[str]:
    if not text or text.isspace():
        return []
    plain = normalise(text)
    words = _WORD.findall(plain)
    return list("".join(words)) if letters else words


def _code(symbol: str) -> int:
    return xxhash.xxh64_intdigest(symbol)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def embed(codes: np.ndarray, starts: np.ndarray, plan: Plan) -> np.ndarray:
    """(tables, windows) bucket numbers of the windows of ``codes`` at ``starts``."""
    flags = plan.sampled()
    padded = np.append(codes, np.uint64(0))
    bits = np.stack([_mix(padded + np.uint64(64 * i + 1)) for i in range(-(-plan.steps // 64))])
    at = np.zeros(len(starts), np.int64)
    keys = np.zeros((plan.tables, len(starts)), np.uint64)
    for step in range(plan.steps):
        spot = np.where(at < plan.window, starts + at, len(codes))
        for table in np.flatnonzero(flags[:, step]):
            keys[table] = (keys[table] ^ padded[spot]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step + 1)
        at += ((bits[step >> 6][spot] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)
    return _mix(keys)


def windows(codes: np.ndarray, known: np.ndarray, plan: Plan) -> np.ndarray:
    """Starts of the windows that have at most ``max_edits`` unknown symbols."""
    if len(codes) < plan.window:
        return np.zeros(0, np.int64)
    misses = np.concatenate([[0], np.cumsum(~known)])
    return np.flatnonzero(misses[plan.window :] - misses[: -plan.window] <= plan.max_edits)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` symbols that start at each place."""
    n = max(0, len(codes) - size + 1)
    out = codes[:n].copy()
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n]
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two windows of symbols, or ``most`` + 1 if it is larger."""
    if np.array_equal(a, b):
        return 0
    if most == 0 or abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a.tolist(), 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b.tolist(), 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def close_pairs(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether the windows in equal rows of ``a`` and ``b`` are within ``most`` edits.

    The usual table of edit distances, for all pairs at once and only ``most`` diagonals
    to each side, beyond which no path is cheap enough.
    """
    n = a.shape[1]
    row = {j: np.full(len(a), j, np.int16) for j in range(min(most, n) + 1)}
    for i in range(1, n + 1):
        new: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            options = []
            if j in row:
                options.append(row[j] + 1)
            if j - 1 in row:
                options.append(row[j - 1] + (a[:, i - 1] != b[:, j - 1]))
            if j - 1 in new:
                options.append(new[j - 1] + 1)
            best = options[0]
            for more in options[1:]:
                best = np.minimum(best, more)
            new[j] = best
        row = new
    return row[n] <= most


def kept_symbols(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many symbols of each row of ``a`` the same row of ``b`` has within ``most`` places.

    At least as many as the windows can have in common, since no edits shift one further.
    """
    same = a == b
    for d in range(1, min(most, a.shape[1] - 1) + 1):
        same[:, d:] |= a[:, d:] == b[:, :-d]
        same[:, :-d] |= a[:, :-d] == b[:, d:]
    return same.sum(axis=1)


#: Windows that are looked up, and pairs of windows that are compared, at a time.
_STEP = 50_000


class ItemIndex:
    """The windows of all items of one plan, by bucket."""

    def __init__(self, items: list[tuple[int, str | None]], plan: Plan) -> None:
        self.plan = plan
        ids, codes, starts, base = [], [], [], 0
        for item, text in items:
            own = np.fromiter(map(_code, symbols(text, plan.letters)), np.uint64)
            spots = np.arange(max(0, len(own) - plan.window + 1))
            ids += [item] * len(spots)
            starts.append(spots + base)
            codes.append(own)
            base += len(own)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.starts = np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)
        self.items = np.array(ids, np.int64)
        self.alphabet = np.unique(self.codes)
        self.grams = np.unique(np.concatenate([_grams(own, plan.run) for own in codes])) if codes else self.codes
        keys = embed(self.codes, self.starts, plan)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, axis=1)

    def found(self, codes: np.ndarray) -> set[int]:
        """Items that have a window within ``max_edits`` of one of ``codes``."""
        plan, out = self.plan, set()
        for at in range(0, max(1, len(codes) - plan.window + 1), PIECE):
            part = codes[at : at + PIECE + plan.window - 1]
            if not len(self.alphabet) or len(part) < plan.window:
                continue
            spot = np.minimum(np.searchsorted(self.alphabet, part), len(self.alphabet) - 1)
            starts = windows(part, self.alphabet[spot] == part, plan)
            if not len(starts) or not len(self.grams):
                continue
            grams = _grams(part, plan.run)
            hits = np.concatenate([[0], np.cumsum(self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] == grams)])
            starts = starts[hits[starts + plan.window - plan.run + 1] > hits[starts]]
            if not len(starts):
                continue
            for low in range(0, len(starts), _STEP):
                self._verify(part, starts[low : low + _STEP], out)
        return out

    def _verify(self, part: np.ndarray, starts: np.ndarray, out: set[int]) -> None:
        """Adds the items of the windows that meet in some table and are close enough."""
        plan, met = self.plan, []
        for table, keys in enumerate(embed(part, starts, plan)):
            low = np.searchsorted(self.keys[table], keys, "left")
            count = np.searchsorted(self.keys[table], keys, "right") - low
            w = np.repeat(np.arange(len(keys)), count)
            spots = np.arange(len(w)) - np.repeat(np.cumsum(count) - count, count) + low[w]
            met.append(w * len(self.items) + self.order[table, spots])
        pairs = np.unique(np.concatenate(met))
        reach = np.arange(plan.window)
        for at in range(0, len(pairs), _STEP):
            w, k = np.divmod(pairs[at : at + _STEP], len(self.items))
            if out:
                fresh = ~np.isin(self.items[k], list(out))
                w, k = w[fresh], k[fresh]
            a, b = self.codes[self.starts[k][:, None] + reach], part[starts[w][:, None] + reach]
            maybe = kept_symbols(a, b, plan.max_edits) >= plan.window - plan.max_edits
            near = close_pairs(a[maybe], b[maybe], plan.max_edits)
            out.update(np.unique(self.items[k[maybe][near]]).tolist())


class _Coder:
    """Codes of symbols, remembered for the common ones."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, found: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for s in set(found).difference(known):
            known[s] = _code(s)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, lang: str, letter_langs: tuple[str, ...] = ("zh", "ja"), words: int = 12, letters: int = 24, max_edits: int = 0, samples: int | None = None, recall: float = 0.95) -> DataFrame:
    """Rows (doc id, item id) of documents that contain a part of an item.

    Items whose language is in ``letter_langs`` are read by letters, all others, also
    those without a language, by words.
    """
    by_letter = F.coalesce(F.lower(lang).isin(*letter_langs), F.lit(False))
    listed = items.select(F.col(item_id).alias("item"), F.col("text").alias("s"), by_letter.alias("letters")).where(F.col("s").isNotNull())
    size = listed.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0]
    # Equal windows agree however many steps are sampled; others on few.
    samples = samples or (3 if max_edits else 8)
    plans = [Plan(False, words, max_edits, samples, recall), Plan(True, letters, max_edits, samples, recall)]
    if size * max(p.tables for p in plans) > MAX_LOCAL * 2:
        return _joined(docs, listed, plans, doc_id, text, item_id)
    rows = listed.collect()  # size checked above
    names = [r.item for r in rows]
    indexes = [ItemIndex([(i, r.s) for i, r in enumerate(rows) if r.letters == p.letters], p) for p in plans]
    shared = docs.sparkSession.sparkContext.broadcast((indexes, names))
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder()
        for batch in batches:
            at, hits = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                read = _WORD.findall(normalise(t)) if t else []
                for index in shared.value[0]:
                    if len(index.starts):
                        found = index.found(coder(list("".join(read)) if index.plan.letters else read))
                        at += [i] * len(found)
                        hits += sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array([shared.value[1][h] for h in hits], item_type)], names=[doc_id, item_id])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, `{item_id}` {item_kind}")


def _bit(codes: np.ndarray) -> np.ndarray:
    return (_mix(codes) % np.uint64(ALPHABET)).astype(np.int64)


def _alphabet(plans: list[Plan]):  # noqa: ANN202
    """The alphabet bits of a task's items, by kind of symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, coder = [np.zeros(ALPHABET, bool) for _ in plans], _Coder()
        for batch in batches:
            for s, letters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[letters][_bit(coder(symbols(s, letters)))] = True
        for letters, bits in enumerate(seen):
            spots = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array([bool(letters)] * len(spots), pa.bool_()), pa.array(spots.astype(np.int32))], names=["letters", "bit"])

    return run


def _windows(plans: list[Plan], known=None):  # noqa: ANN001, ANN202
    """(id, letters, key, codes) of the windows of texts (id, s[, letters]).

    ``known``: only windows with at most ``max_edits`` symbols outside the alphabet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder()
        for batch in batches:
            flags = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for row, t in enumerate(batch.column(1).to_pylist()):
                for plan in plans:
                    if flags and flags[row] != plan.letters:
                        continue
                    codes = coder(symbols(t, plan.letters))
                    inside = known.value[plan.letters][_bit(codes)] if known else np.ones(len(codes), bool)
                    starts = windows(codes, inside, plan)
                    for a in range(0, len(starts), 20_000):
                        part = starts[a : a + 20_000]
                        keys = embed(codes, part, plan).view(np.int64)
                        body = pa.array(codes[part[:, None] + np.arange(plan.window)].view(np.int64).tolist(), pa.list_(pa.int64()))
                        for table in keys:
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(part), pa.int32())), pa.array([plan.letters] * len(part), pa.bool_()), pa.array(table), body], names=["id", "letters", "key", "codes"])

    return run


def _joined(docs: DataFrame, items: DataFrame, plans: list[Plan], doc_id: str, text: str, item_id: str) -> DataFrame:
    """The same result for item sets of any size: windows of both sides meet by bucket."""
    alphabet = [np.zeros(ALPHABET, bool) for _ in plans]
    bits = items.select("s", "letters").mapInArrow(_alphabet(plans), "letters boolean, bit int").distinct().toArrow()  # at most 2 * ALPHABET rows
    letters, spots = bits.column("letters").to_numpy(), bits.column("bit").to_numpy()
    for kind in (False, True):
        alphabet[kind][spots[letters == kind]] = True
    known = docs.sparkSession.sparkContext.broadcast(alphabet)
    shape = lambda df, name: f"id {df.schema[name].dataType.simpleString()}, letters boolean, key long, codes array<long>"
    left = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("s")).where(F.col("s").isNotNull()).mapInArrow(_windows(plans, known), shape(docs, doc_id))
    right = items.select(F.col("item").alias("id"), "s", "letters").mapInArrow(_windows(plans), shape(items, "item")).distinct()
    met = left.join(right.withColumnRenamed("id", "item").withColumnRenamed("codes", "theirs").hint("merge"), ["letters", "key"])
    most = plans[0].max_edits
    if most == 0:
        met = met.where(F.col("codes") == F.col("theirs"))
    else:
        @F.pandas_udf(BooleanType())
        def close(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([edit_distance(np.asarray(x), np.asarray(y), most) <= most for x, y in zip(a, b)], dtype=bool)

        met = met.where(close("codes", "theirs"))
    return met.select(F.col("id").alias(doc_id), F.col("item").alias(item_id)).distinct()

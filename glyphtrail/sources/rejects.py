"""Load recorder lines and keep every line that fails, with its reason.

Structural indexing: the lines of an Arrow batch are laid end to end in one byte
array. Quote positions, the running quote parity since the start of the record and
the nesting depth outside strings are computed for the whole array at once; from
them follow delimiters, record ends and structural faults. Only records that are
structurally sound are decoded, and their values checked for count and type.

Defined results: null, empty and blank lines and csv header lines give no row. A
file that is neither ``.csv`` nor ``.jsonl`` gives rejects with ``unknown_format``.
Every other input row gives exactly one row, loaded (``reason`` null) or rejected. A
csv line equal to the header counts as one at any line number. Numbers of any size are
loaded: ``cap_text`` has the exact whole number, ``cap`` is null beyond 64 bits; a JSON
edge beyond the range of a double comes out infinite.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV_HEADER = "cap,left,top,right,bottom,otext,pconf,tconf"
CSV_WIDTH = 8
QUOTE, COMMA, BACKSLASH = 34, 44, 92

SCHEMA = (
    "raw_id long, file_name string, line_no int, form string, reason string, t string, cap long, cap_text string, "
    "blocks array<struct<rect:array<double>,otext:string,pconf:double,tconf:double>>"
)
_BLOCK = pa.struct([("rect", pa.list_(pa.float64())), ("otext", pa.string()), ("pconf", pa.float64()), ("tconf", pa.float64())])
_ARROW = pa.schema([("raw_id", pa.int64()), ("file_name", pa.string()), ("line_no", pa.int32()), ("form", pa.string()), ("reason", pa.string()), ("t", pa.string()), ("cap", pa.int64()), ("cap_text", pa.string()), ("blocks", pa.list_(_BLOCK))])

_NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")


def _layout(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all lines, and where each line starts and ends."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(lines), np.uint8), ends - sizes, ends


def _since_start(running: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """An inclusive running sum, restarted at each record."""
    return running[1:] - running[starts][owner]


def index_csv(lines: list[bytes]) -> tuple[list[str | None], list[np.ndarray]]:
    """A structural fault or None, and the positions of the delimiters, per record."""
    data, starts, ends = _layout(lines)
    n = len(lines)
    owner = np.repeat(np.arange(n), ends - starts)
    quote = data == QUOTE
    running = np.concatenate([[0], np.cumsum(quote)])
    after = _since_start(running, starts, owner) & 1  # parity with this byte counted
    before = after ^ quote
    delim = (data == COMMA) & (after == 0)
    at_start = np.zeros(len(data), bool)
    at_start[starts[ends > starts]] = True
    at_end = np.zeros(len(data), bool)
    at_end[ends[ends > starts] - 1] = True
    previous_delim = np.concatenate([[False], delim[:-1]]) & ~at_start
    previous_quote = np.concatenate([[False], quote[:-1]]) & ~at_start
    next_ok = at_end | np.concatenate([(delim | quote)[1:], [True]])
    opening, closing = quote & (before == 0), quote & (before == 1)
    stray = opening & ~(at_start | previous_delim | previous_quote)
    tail = closing & ~next_ok
    faults: list[str | None] = [None] * n
    for i in np.flatnonzero(np.bincount(owner[stray | tail], minlength=n)):
        faults[i] = "quote_misplaced"
    for i in np.flatnonzero(np.bincount(owner[quote], minlength=n) & 1):
        faults[i] = faults[i] or "quote_unclosed"
    spots = np.flatnonzero(delim)
    counts = np.bincount(owner[spots], minlength=n)
    per_line = np.split(spots, np.cumsum(counts)[:-1]) if n else []
    return faults, [p - s for p, s in zip(per_line, starts)]


def index_json(lines: list[bytes]) -> list[str | None]:
    """The structural fault of each JSON record, or None."""
    data, starts, ends = _layout(lines)
    n = len(lines)
    owner = np.repeat(np.arange(n), ends - starts)
    slash = data == BACKSLASH
    # A quote is escaped by an odd run of backslashes right before it.
    position = np.arange(len(data))
    last_other = np.maximum.accumulate(np.where(slash, -1, position)) if len(data) else position
    run = position - last_other
    escaped = np.concatenate([[False], (run[:-1] & 1).astype(bool)]) if len(data) else slash
    first = np.zeros(len(data), bool)
    first[starts[ends > starts]] = True
    quote = (data == QUOTE) & ~(escaped & ~first)
    running = np.concatenate([[0], np.cumsum(quote)])
    inside = (_since_start(running, starts, owner) & 1).astype(bool)
    opens = ~inside & ((data == 123) | (data == 91))
    closes = ~inside & ((data == 125) | (data == 93))
    depth = _since_start(np.concatenate([[0], np.cumsum(opens.astype(np.int64) - closes)]), starts, owner)
    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    faults: list[str | None] = [None] * n

    def mark(where: np.ndarray, reason: str) -> None:
        for i in np.flatnonzero(where):
            faults[i] = faults[i] or reason

    solid = np.flatnonzero(~blank)
    lead = np.full(n, -1, np.int64)
    lead[owner[solid[::-1]]] = data[solid[::-1]]
    mark(np.bincount(owner[quote], minlength=n) & 1, "unterminated_string")
    mark((lead != 123) & (lead >= 0), "not_an_object")
    # Once the depth has come back to zero, only blanks may follow.
    done = closes & (depth <= 0)
    ended = np.concatenate([[0], np.cumsum(done)])
    beyond = (_since_start(ended, starts, owner) - done > 0) & ~blank
    mark(np.bincount(owner[beyond], minlength=n) > 0, "extra_data")
    filled = ends > starts
    final = np.zeros(n, np.int64)
    final[filled] = depth[ends[filled] - 1]
    mark(final != 0, "unbalanced")
    return faults


def _csv_values(line: str, raw: bytes, spots: np.ndarray) -> list[str]:
    edges = [-1, *spots.tolist(), len(raw)]
    out = []
    for a, b in zip(edges, edges[1:]):
        value = raw[a + 1 : b].decode("utf-8", "replace")
        out.append(value[1:-1].replace('""', '"') if value[:1] == '"' else value)
    return out


Number = int | float | Decimal


def exact_int(text: str) -> Number:
    return int(text) if len(text) < 4000 else Decimal(text)


def exact_float(text: str) -> Number:
    """A double, or the exact value where a double has none."""
    value = float(text)
    if math.isfinite(value):
        return value
    try:
        return Decimal(text)
    except ArithmeticError:  # an exponent of twenty digits
        return value


def as_double(value: Number) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.inf if value > 0 else -math.inf


def _csv_number(text: str) -> Number | None:
    if not _NUMBER.fullmatch(text):
        return None
    return exact_int(text) if text.isdecimal() else exact_float(text)


def _whole(value: object) -> Number | None:
    """A whole number of at least 0; True and False are no numbers."""
    if isinstance(value, bool) or not isinstance(value, Number) or not value >= 0:
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) else None
    return value if value == value.to_integral_value() else None


def _cap(value: Number | None) -> tuple[int | None, str | None]:
    """(number, text) of a whole number; the number is None beyond 64 bits."""
    if value is None:
        return None, None
    return (int(value) if value < 1 << 63 else None), str(value)


def _number(value: object) -> bool:
    return isinstance(value, Number) and not isinstance(value, bool)


def check_csv(values: list[str]) -> tuple[str | None, Number | None, list[dict]]:
    if len(values) != CSV_WIDTH:
        return "column_count", None, []
    cap = _csv_number(values[0])
    cap = None if cap is None else _whole(cap)
    if cap is None:
        return "cap_invalid", None, []
    rect = [_csv_number(x) for x in values[1:5]]
    rect = [math.inf if x is None else as_double(x) for x in rect]
    if not all(map(math.isfinite, rect)):
        return "rect_invalid", cap, []
    pconf = _csv_number(values[6])
    if pconf is None or not 0 <= pconf <= 1:
        return "pconf_invalid", cap, []
    tconf = _csv_number(values[7])
    return None, cap, [{"rect": rect, "otext": values[5], "pconf": float(pconf), "tconf": None if tconf is None else as_double(tconf)}]


class _NotJson(ValueError):
    pass


def _no_constant(name: str) -> None:
    raise _NotJson(name)


def _exact(line: str, **hooks) -> object:  # noqa: ANN003
    return json.loads(line, parse_int=exact_int, parse_float=exact_float, **hooks)


def read_json(line: str, **hooks) -> object:  # noqa: ANN003
    """The value of a JSON text; whole numbers too long for the plain parser are kept."""
    try:
        return json.loads(line, **hooks)
    except _NotJson:
        raise
    except ValueError:
        return _exact(line, **hooks)


def check_json(line: str) -> tuple[str | None, str | None, Number | None, list[dict]]:
    try:
        record = read_json(line, parse_constant=_no_constant)
    except _NotJson:
        return "not_json_constant", None, None, []
    except RecursionError:
        return "nested_too_deep", None, None, []
    except ValueError:
        return "invalid_json", None, None, []
    if not isinstance(record, dict):
        return "not_an_object", None, None, []
    kind = record.get("t")
    if not isinstance(kind, str):
        return "t_invalid", None, None, []
    cap = record.get("cap")
    if cap == math.inf:  # more than a double holds
        cap = _exact(line)["cap"]
    cap = _whole(cap)
    if cap is None:
        return "cap_invalid", kind, None, []
    entries = record.get("blocks")
    if entries is not None and not isinstance(entries, list):
        return "blocks_invalid", kind, cap, []
    blocks = []
    for entry in entries or ():
        rect = entry.get("rect") if isinstance(entry, dict) else None
        if not isinstance(rect, list) or len(rect) != 4 or not all(map(_number, rect)):
            return "rect_invalid", kind, cap, []
        pconf = entry.get("pconf")
        if not _number(pconf) or not 0 <= pconf <= 1:
            return "pconf_invalid", kind, cap, []
        text, tconf = entry.get("otext"), entry.get("tconf")
        blocks.append({"rect": [as_double(x) for x in rect], "otext": text if isinstance(text, str) else None, "pconf": float(pconf), "tconf": as_double(tconf) if _number(tconf) else None})
    return None, kind, cap, blocks


def _encode(line: str) -> bytes:
    return line.encode("utf-8", "surrogatepass")


def load_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, numbers, lines = (batch.column(k).to_pylist() for k in range(4))
        out = []
        csv = [i for i, f in enumerate(names) if (f or "").lower().endswith(".csv")]
        raws = [_encode(lines[i]) for i in csv]
        faults, spots = index_csv(raws)
        for i, raw, fault, spot in zip(csv, raws, faults, spots):
            reason, cap, blocks = (fault, None, []) if fault else check_csv(_csv_values(lines[i], raw, spot))
            out.append((ids[i], names[i], numbers[i], "csv", reason, None, *_cap(cap), blocks))
        rest = [i for i, f in enumerate(names) if (f or "").lower().endswith(".jsonl")]
        for i, fault in zip(rest, index_json([_encode(lines[i]) for i in rest])):
            reason, kind, cap, blocks = (fault, None, None, []) if fault else check_json(lines[i])
            out.append((ids[i], names[i], numbers[i], "jsonl", reason, kind, *_cap(cap), blocks))
        known = {*csv, *rest}
        out += [(ids[i], names[i], numbers[i], None, "unknown_format", None, None, None, []) for i in range(len(ids)) if i not in known]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def load_lines(lines: DataFrame) -> DataFrame:
    """Rows (raw_id, file_name, line_no, form, reason, t, cap, cap_text, blocks) of recorder lines.

    ``lines`` needs raw_id, file_name, line_no and line; other columns are ignored.
    A narrow operator: no shuffle, one pass, state of one batch.
    """
    header = F.lower("file_name").endswith(".csv") & (F.trim("line") == CSV_HEADER)
    solid = F.col("line").rlike(r"(?U)[^\s\x{FEFF}]")
    kept = lines.select("raw_id", "file_name", "line_no", "line").where(solid & ~F.coalesce(header, F.lit(False)))
    return kept.mapInArrow(load_batches, SCHEMA)


def rejected(lines: DataFrame) -> DataFrame:
    """The lines that cannot be loaded, each with the first reason found."""
    return load_lines(lines).where(F.col("reason").isNotNull()).select("raw_id", "file_name", "line_no", "form", "reason")


def loaded_blocks(lines: DataFrame) -> DataFrame:
    """One row per block of the valid records; records without blocks give none."""
    rows = load_lines(lines).where(F.col("reason").isNull())
    return rows.select("raw_id", "form", "t", "cap", "cap_text", F.posexplode("blocks").alias("position", "b")).select("raw_id", "form", "t", "cap", "cap_text", "position", "b.rect", "b.otext", "b.pconf", "b.tconf")

"""Read files whose schemas drift into one table and report every change.

Each task reads its lines once and folds them into the header schema of their files: one
row per (file, record kind, field, value kind) with a profile of the values, which has a
fixed greatest size. A header goes to the comparison with the file before it and to the
one with the file after it, so each pair of neighbouring files meets in one group: one
shuffle of headers, no joins, and no group larger than two headers. There the parts of a
header are added up, promoted through a type lattice and compared.

A field that vanished and one that appeared in the same file and record kind are one
rename if their types agree and their value profiles or names are close; several such
fields are paired by the best closeness first. A profile has the number of values, their
lowest and highest magnitude, and the set of ``BUCKETS`` hash buckets that the shapes of
its values fall into. A field whose values are all null has no type: it is never retyped,
and paired by its name alone.

To cast, the renames of a recorder are followed file by file (rows of changes, not of
data), each line gets the names of its file by a join, and is read into columns of the
union schema with their promoted types.

Defined results: null, blank or malformed lines and records of no known kind are
skipped here (the reject loader reports them); rows without a recorder or file number
are in no difference; files of the same recorder and number are read as one, under the
smallest file_id; a file without a predecessor (file_no - 1) gives no differences; an
empty table gives empty results.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphtrail.context import cut_lineage

from .rejects import Number, as_double, read_json

RECORDS = ("meta", "obs", "merge", "freeze")
#: Names under which a discriminator is looked for first; any other name works too.
DISCRIMINATORS = ("t", "type", "rec", "kind")
CONTAINER = "blocks"
RENAME_CLOSENESS = 0.45
#: Hash buckets of value shapes: a profile has at most so many entries.
BUCKETS = 1 << 14
#: Header rows that a task holds before it sends them on.
MAX_HELD = 100_000

#: Finer than the kinds: what a column is cast to. "long" and "numbers" are the narrow
#: forms of a number and of an array.
_KIND_OF_FORM = {"long": "number", "double": "number", "numbers": "array"}


def form_of(value: object) -> str | None:
    """long, double, string, boolean, numbers, array, object, or None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        return "long" if isinstance(value, int) and -(1 << 63) <= value < 1 << 63 else "double"
    if isinstance(value, list):
        return "numbers" if all(isinstance(x, Number) and not isinstance(x, bool) for x in value) else "array"
    return {str: "string", dict: "object"}[type(value)]


def kind_of(value: object) -> str | None:
    """number, string, boolean, array, object, or None for null."""
    form = form_of(value)
    return _KIND_OF_FORM.get(form, form)


def promote(kinds: list[str | None]) -> str | None:
    """Least upper bound in the lattice null < long < double, numbers < array, all < string."""
    seen = {k for k in kinds if k}
    for narrow, wide in (("long", "double"), ("numbers", "array")):
        if seen == {narrow, wide}:
            return wide
    return next(iter(seen)) if len(seen) == 1 else "string" if seen else None


def discriminator(record: dict) -> str | None:
    named = [k for k, v in record.items() if isinstance(v, str) and v in RECORDS]
    return next((k for k in DISCRIMINATORS if k in named), named[0] if named else None)


def _measure(value: object) -> tuple[float, str]:
    """A magnitude and a coarse shape of one value, for comparing profiles."""
    if isinstance(value, bool):
        return float(value), "boolean"
    if isinstance(value, Number):
        size = min(math.log1p(abs(as_double(value))), 1e3)
        return math.copysign(size, as_double(value)), "whole" if isinstance(value, int) else "real"
    if isinstance(value, str):
        form = "number" if value[:1].isdigit() or value[:1] == "-" else value if value.isalpha() else "phrase"
        return math.log1p(len(value)), form
    if isinstance(value, list):
        return float(len(value)), f"list{len(value)}:{kind_of(value[0]) if value else ''}"
    return float(len(value)), "keys:" + ",".join(sorted(value))


@lru_cache(maxsize=100_000)
def _bucket(shape: str) -> int:
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS


def parse(line: str | None) -> dict | None:
    try:
        record = read_json(line) if line else None
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def _cells(record: dict) -> Iterator[tuple[int, str, object]]:
    """(position in the container or -1, field, value)."""
    for name, value in record.items():
        if name != CONTAINER:
            yield -1, name, value
        elif isinstance(value, list):
            for k, entry in enumerate(value):
                for inner, x in entry.items() if isinstance(entry, dict) else ():
                    yield k, f"{CONTAINER}.{inner}", x


_HEADER = "recorder string, file_no int, file_id long, rec string, field_name string, form string, n long, low double, high double, shapes array<int>"
_HEADER_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
_HEADER_NAMES = [x.split()[0] for x in _HEADER.split(", ")]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial headers; a row without a field tells that the file is there."""
    folded: dict[tuple, list] = {}
    for batch in batches:
        for recorder, file_no, file_id, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
            file = (recorder, file_no, file_id)
            if (*file, RECORDS[0], None, None) not in folded:
                for rec in RECORDS:
                    folded[(*file, rec, None, None)] = [0, None, None, ()]
            record = parse(line)
            key = discriminator(record) if record else None
            if key is None:
                continue
            rec = record[key]
            for _, name, value in _cells(record):
                form = form_of(value)
                slot = folded.get((*file, rec, name, form))
                if slot is None:
                    slot = folded[(*file, rec, name, form)] = [0, math.inf, -math.inf, set()] if form else [0, None, None, ()]
                slot[0] += 1
                if form:
                    size, shape = _measure(value)
                    slot[1], slot[2] = min(slot[1], size), max(slot[2], size)
                    slot[3].add(_bucket(shape))
        if len(folded) > MAX_HELD:
            yield _batch([(*k, *v[:3], list(v[3])) for k, v in folded.items()], _HEADER_TYPES, _HEADER_NAMES)
            folded = {}
    yield _batch([(*k, *v[:3], list(v[3])) for k, v in folded.items()], _HEADER_TYPES, _HEADER_NAMES)


def headers(lines: DataFrame) -> DataFrame:
    """Partial header rows of every file; rows of equal keys are still to be added up."""
    return lines.select("recorder", "file_no", "file_id", "line").where("recorder is not null and file_no is not null").mapInArrow(_fold, _HEADER)


def file_schemas(lines: DataFrame) -> DataFrame:
    """One row per (file, record kind, field): promoted form and number of values."""
    return _forms(headers(lines), ["recorder", "file_no", "rec", "field_name"]).withColumnRenamed("form", "kind")


def _forms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Forms promoted by ``keys``; at most seven forms meet in a group."""
    seen = F.array_sort(F.collect_set("form"))
    pair = lambda a, b: seen == F.array(F.lit(a), F.lit(b))
    form = F.when(F.size(seen) == 1, F.get(seen, F.lit(0))).when(pair("double", "long"), "double").when(pair("array", "numbers"), "array").when(F.size(seen) > 1, "string")
    return rows.where("field_name is not null").groupBy(*keys).agg(form.alias("form"), F.sum("n").alias("n"))


def _words(name: str) -> str:
    spaced = "".join("_" + c if c.isupper() and not p.isupper() else c for p, c in zip(" " + name, name))
    return "".join(x for x in spaced.lower().strip("_") if x.isalnum())


@lru_cache(maxsize=100_000)
def name_closeness(old: str, new: str) -> float:
    a, b = _words(old.rpartition(".")[2]), _words(new.rpartition(".")[2])
    same = a in b or b in a or sorted(a) == sorted(b)
    return max(SequenceMatcher(None, a, b).ratio(), 0.8 * same)


class Profile:
    """What a file holds of one field, added up from parts."""

    __slots__ = ("forms", "low", "high", "shapes")

    def __init__(self) -> None:
        self.forms, self.low, self.high, self.shapes = set(), math.inf, -math.inf, set()

    def add(self, form: str | None, low: float, high: float, shapes: list[int]) -> None:
        if form:
            self.forms.add(form)
            self.low, self.high = min(self.low, low), max(self.high, high)
            self.shapes.update(shapes)

    @property
    def kind(self) -> str | None:
        form = promote(list(self.forms))
        return _KIND_OF_FORM.get(form, form)


def closeness(old_name: str, old: Profile, new_name: str, new: Profile) -> float:
    """0 to 1: how much two fields look like the same field; 0 if their kinds differ."""
    name = name_closeness(old_name, new_name)
    if old.kind is None or new.kind is None:
        return name if name >= 0.7 else 0.0
    if old.kind != new.kind:
        return 0.0
    shape = len(old.shapes & new.shapes) / max(1, min(len(old.shapes), len(new.shapes)))
    inner = min(old.high, new.high) - max(old.low, new.low)
    width = min(old.high - old.low, new.high - new.low)
    spread = max(0.0, min(1.0, (inner + 0.05) / (width + 0.05))) if inner > -0.5 else 0.0
    values = (shape + spread) / 2
    return max(0.5 * name + 0.5 * values, values * 0.9 if values > 0.75 else 0.0)


def compare(old: dict[str, Profile], new: dict[str, Profile]) -> Iterator[tuple[str, str, str | None]]:
    """(field, change, new name) of two headers of one kind of record, in a fixed order."""
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    scored = sorted((-closeness(a, old[a], b, new[b]), a, b) for a in gone for b in come if ("." in a) == ("." in b))
    renamed: dict[str, str] = {}
    taken: set[str] = set()
    for score, a, b in scored:
        if -score >= RENAME_CLOSENESS and a not in renamed and b not in taken:
            renamed[a] = b
            taken.add(b)
    for name in sorted(old.keys() & new.keys()):
        before, after = old[name].kind, new[name].kind
        if before and after and before != after:
            yield name, "retyped", None
    for name in gone:
        yield (name, "renamed", renamed[name]) if name in renamed else (name, "removed", None)
    for name in come:
        if name not in taken:
            yield name, "added", None


_CHANGE = "file_id long, recorder string, file_no int, rec string, field_name string, change_kind string, new_name string"
_CHANGE_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
_CHANGE_NAMES = [x.split()[0] for x in _CHANGE.split(", ")]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: tuple | None = None
    sides: tuple[dict[str, Profile], dict[str, Profile]] = ({}, {})
    files: list[int | None] = [None, None]
    out: list[tuple] = []

    def close() -> None:
        if at and files[0] is not None and files[1] is not None:
            out.extend((files[1], *at, *change) for change in compare(*sides))

    for batch in batches:
        for recorder, file_no, rec, side, file_id, name, form, low, high, shapes in zip(*(c.to_pylist() for c in batch.columns)):
            if (recorder, file_no, rec) != at:
                close()
                at, sides, files = (recorder, file_no, rec), ({}, {}), [None, None]
            files[side] = file_id if files[side] is None else min(files[side], file_id)
            if name is not None:
                sides[side].setdefault(name, Profile()).add(form, low, high, shapes)
        if len(out) > 10_000:
            yield _batch(out, _CHANGE_TYPES, _CHANGE_NAMES)
            out.clear()
    close()
    yield _batch(out, _CHANGE_TYPES, _CHANGE_NAMES)


def schema_changes(lines: DataFrame) -> DataFrame:
    """Differences between each file and its predecessor, one row each.

    Columns: file_id (the later file), recorder, file_no, rec, field_name (of a rename
    the earlier name), change_kind, new_name (of a rename only).
    """
    return _changes(headers(lines))


def _changes(parts: DataFrame) -> DataFrame:
    meets = F.array(F.struct(F.col("file_no").alias("later"), F.lit(1).alias("side")), F.struct((F.col("file_no") + 1).alias("later"), F.lit(0).alias("side")))
    both = parts.where(F.col("file_no") < (1 << 31) - 1).withColumn("m", F.explode(meets))
    rows = both.select("recorder", "m.later", "rec", "m.side", F.coalesce("file_id", F.lit(-1)).alias("file_id"), "field_name", "form", "low", "high", "shapes")
    placed = rows.repartition("recorder", "later", "rec").sortWithinPartitions("recorder", "later", "rec")
    return placed.mapInArrow(_compare, _CHANGE)


def change_log(lines: DataFrame) -> DataFrame:
    """All differences in the order of their files, sorted by range over all tasks."""
    return schema_changes(lines).orderBy("recorder", "file_no", "rec", "field_name", "change_kind")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The current names of every file of a recorder: {record kind: {name: first name}}."""
    at, first, text, out = None, {}, None, []
    for batch in batches:
        for recorder, file_no, side, rec, name, new in zip(*(c.to_pylist() for c in batch.columns)):
            if recorder != at:
                at, first, text = recorder, {}, None
            if side == 0:
                names = first.setdefault(rec, {})
                names[new] = names.pop(name, name)
                text = None
            elif first:
                text = text or json.dumps(first, ensure_ascii=True, sort_keys=True)
                out.append((recorder, file_no, text))
        if len(out) > 10_000:
            yield _batch(out, [pa.string(), pa.int32(), pa.string()], ["recorder", "file_no", "names"])
            out = []
    yield _batch(out, [pa.string(), pa.int32(), pa.string()], ["recorder", "file_no", "names"])


def file_names(parts: DataFrame) -> DataFrame:
    """(recorder, file_no, names) of the files that come after some rename.

    A recorder's renames are followed in the order of its files, in one task: rows of
    files and of renames only, with one set of names held.
    """
    files = parts.where("field_name is null").select("recorder", "file_no").distinct()
    renames = _changes(parts).where("change_kind = 'renamed'")
    rows = renames.select("recorder", "file_no", F.lit(0).alias("side"), "rec", "field_name", "new_name").unionByName(files.withColumn("side", F.lit(1)), allowMissingColumns=True)
    placed = rows.repartition("recorder").sortWithinPartitions("recorder", "file_no", "side", "rec", "field_name")
    return placed.mapInArrow(_follow, "recorder string, file_no int, names string")


_NAME_MAP = "map<string,map<string,string>>"


def _plan(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with the names of their file, forms by record kind and first name)."""
    parts = cut_lineage(headers(lines))
    names = cut_lineage(file_names(parts))
    named = parts.where("field_name is not null").join(names, ["recorder", "file_no"], "left")
    first = F.coalesce(F.from_json("names", _NAME_MAP)[F.col("rec")][F.col("field_name")], F.col("field_name"))
    forms = _forms(named.select("rec", first.alias("field_name"), "form", "n"), ["rec", "field_name"])
    return lines.select("line_id", "file_id", "recorder", "file_no", "line").join(names, ["recorder", "file_no"], "left"), forms


@lru_cache(maxsize=256)
def _names(text: str | None) -> dict[str, dict[str, str]]:
    return json.loads(text) if text else {}


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        out = []
        for line_id, file_id, line, names in zip(*(c.to_pylist() for c in batch.columns)):
            record = parse(line)
            key = discriminator(record) if record else None
            if key is None:
                continue
            first = _names(names).get(record[key], {})
            out += [(line_id, file_id, record[key], entry, first.get(name, name), _text(value)) for entry, name, value in _cells(record)]
        yield _batch(out, types, ["line_id", "file_id", "rec", "entry", "field_name", "value"])


def unified_cells(lines: DataFrame) -> DataFrame:
    """Every value of every file under its first name, as text, with its promoted kind.

    Rows (line_id, file_id, rec, entry, field_name, kind, value): ``entry`` is the
    position in the container, -1 outside it; ``kind`` is the promoted kind of the field
    over all files; ``value`` is null where it is null.
    """
    rows, forms = _plan(lines)
    cells = rows.select("line_id", "file_id", "line", "names").mapInArrow(_flatten, "line_id long, file_id long, rec string, entry int, field_name string, value string")
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in _KIND_OF_FORM.items() for x in pair])[F.col("form")], F.col("form"))
    return cells.join(forms.select("rec", "field_name", kind.alias("kind")), ["rec", "field_name"], "left").select("line_id", "file_id", "rec", "entry", "field_name", "kind", "value")


_SPARK = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "numbers": T.ArrayType(T.DoubleType()), "array": T.ArrayType(T.StringType())}
_ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "numbers": pa.list_(pa.float64()), "array": pa.list_(pa.string())}
_CAST = {"double": as_double, "numbers": lambda v: [as_double(x) for x in v], "array": lambda v: [_text(x) for x in v], "long": int, "boolean": bool}


def _cast(value: object, form: str | None) -> object:
    if value is None:
        return None
    cast = _CAST.get(form)
    return cast(value) if cast else _text(value)


def unified_records(lines: DataFrame) -> DataFrame:
    """One row per record, cast to the union schema of all files.

    Columns: line_id, file_id, t (the discriminator, whatever a file calls it), and a
    struct ``fields`` with a column for every first name, of its promoted type: long,
    double, boolean, array of double, array of text or text. The container is an array
    of structs with the union of its entries' fields.

    The union schema, a few rows for each field name, is read by the driver before the
    plan is made.
    """
    rows, forms = _plan(lines)
    outer: dict[str, list] = {}
    for _, name, form, _ in forms.collect():  # one row per field name of the union schema
        outer.setdefault(name, []).append(form)
    every = {name: promote(found) for name, found in sorted(outer.items())}
    plain = {n: f for n, f in every.items() if not n.startswith(f"{CONTAINER}.")}
    entries = {n: f for n, f in every.items() if n.startswith(f"{CONTAINER}.")}
    short = {n: n.partition(".")[2] for n in entries}
    entry_type = pa.struct([(short[n], _ARROW.get(f, pa.string())) for n, f in entries.items()])
    arrow = [(n, _ARROW.get(f, pa.string())) for n, f in plain.items()] + ([(CONTAINER, pa.list_(entry_type))] if entries else [])
    kinds = [T.StructField(n, _SPARK.get(f, T.StringType())) for n, f in plain.items()]
    if entries:
        kinds.append(T.StructField(CONTAINER, T.ArrayType(T.StructType([T.StructField(short[n], _SPARK.get(f, T.StringType())) for n, f in entries.items()]))))
    schema = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("file_id", T.LongType()), T.StructField("t", T.StringType()), T.StructField("fields", T.StructType(kinds))])
    types = [pa.int64(), pa.int64(), pa.string(), pa.struct(arrow)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line_id, file_id, line, names in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse(line)
                key = discriminator(record) if record else None
                if key is None:
                    continue
                first, fields, held = _names(names).get(record[key], {}), {}, {}
                for entry, name, value in _cells(record):
                    name = first.get(name, name)
                    if entry < 0:
                        if name in plain:
                            fields[name] = _cast(value, plain[name])
                    elif name in entries:
                        held.setdefault(entry, {})[short[name]] = _cast(value, entries[name])
                if isinstance(record.get(CONTAINER), list):
                    fields[CONTAINER] = [held.get(k, {}) for k in range(len(record[CONTAINER]))]
                out.append((line_id, file_id, record[key], fields))
            yield _batch(out, types, ["line_id", "file_id", "t", "fields"])

    return rows.select("line_id", "file_id", "line", "names").mapInArrow(run, schema)

"""The capture step as a stateful streaming operator.

One key per session; the state is the session's dump and the rows of captures not yet
complete. A capture is stepped when a later one of its session arrives, or when a row
with ``last`` true closes it, so a capture split over micro-batches is stepped once.
Nothing expires on a clock: a session without input keeps its state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphtrail.plans.replay import _COLUMNS, _LOG, _NAMES, SCHEMA, block_of, log_rows
from glyphtrail.plans.tracker import Config, Session

INPUT = ("session_id", "cap", "seq", *_COLUMNS, "last")
_STATE = "state string, pending string"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state, config: Config) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    session, held = (Session(config), []) if not state.exists else (Session.load(state.get[0], config), json.loads(state.get[1]))
    for frame in frames:
        held += json.loads(frame.to_json(orient="records"))
    newest = max((r["cap"] for r in held), default=None)
    closed = {r["cap"] for r in held if r["last"]} | {r["cap"] for r in held if r["cap"] < newest}
    out = []
    for cap in sorted(closed):
        rows = sorted((r for r in held if r["cap"] == cap and r["id"] is not None), key=lambda r: (r["seq"], r["id"]))
        result = session.step([block_of({**r, "id": int(r["id"]), "hz": int(r["hz"]), "srcq": int(r["srcq"])}) for r in rows])
        out += log_rows(key[0], "stream", cap, result)
    state.update((session.dump(), json.dumps([r for r in held if r["cap"] not in closed])))
    frame = pd.DataFrame(out, columns=_NAMES)
    for name, kind in _LOG:
        # Plain object columns for text: chunked string arrays are not accepted here.
        frame[name] = frame[name].astype({"string": object, "int32": "Int32", "int64": "Int64"}.get(str(kind), "float64"))
    yield frame


def track(blocks: DataFrame, config: Config = Config()) -> DataFrame:
    """Decision log of a stream (or table) of block rows with the columns of ``INPUT``.

    A row with a null id marks a capture without blocks. Late captures, those before the
    newest one already stepped, are stepped on arrival in their own order.
    """

    def run(key, frames, state):  # noqa: ANN001, ANN202
        return _advance(key, frames, state, config)

    rows = blocks.select(*INPUT)
    return rows.groupBy("session_id").applyInPandasWithState(run, SCHEMA, _STATE, "append", "NoTimeout")


def with_last(blocks: DataFrame) -> DataFrame:
    """Adds ``last`` false; close a capture by a marker row or the next capture."""
    return blocks.withColumn("last", F.lit(False))

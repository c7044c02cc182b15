"""Rows of one key in the order of their time, without holding all rows of the key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa

#: Span of rows without a time; they come last.
NO_TIME = 1 << 62


def spans(times: pd.Series, seconds: int = 60) -> pd.Series:
    """The span of time, a minute by default, of each instant (seconds or timestamps)."""
    if pd.api.types.is_datetime64_any_dtype(times):
        times = (times.astype("datetime64[us]").astype("int64") / 1e6).where(times.notna())
    return (times // seconds).astype("float64").fillna(NO_TIME).astype("int64")


def ordered(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The rows sorted by the columns, nulls last. Most keys have few rows, for which ``sort_values`` by several columns mostly builds categories."""
    columns = [rows[c].to_numpy() for c in by]
    if any(c.dtype == object for c in columns):
        return rows.sort_values(by).reset_index(drop=True)
    order = np.lexsort(columns[::-1])
    if (order[1:] > order[:-1]).all():
        return rows.reset_index(drop=True)
    return rows.take(order).reset_index(drop=True)


def micros(times: pd.Series) -> list[int]:
    """Instants as microseconds, in one step for the column."""
    return (times.astype("datetime64[ns]").astype("int64") // 1000).tolist()


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Aside:
    """What a key's chunks hold is put aside in the state store by spans of time, and taken back span by span.

    A key with one chunk is sorted at once and touches no state. Otherwise a task holds one chunk, or the rows of one
    span. What is put aside is removed as it is read, so nothing of it outlives the batch.
    """

    def __init__(self, handle):
        self.held = handle.getMapState("aside", "span long, chunk long", "data binary")

    def in_order(self, rows: Iterator[pd.DataFrame], time: str, by: list[str], span: Callable[[pd.Series], pd.Series] = spans) -> Iterator[pd.DataFrame]:
        """The rows as frames that follow each other in the order of ``by``, whose first column is ``time``."""
        rows = iter(rows)
        first, second = next(rows, None), next(rows, None)
        if second is None:
            if first is not None:
                yield ordered(first, by)
            return
        for n, chunk in enumerate(chain((first, second), rows)):
            for at, part in chunk.groupby(span(chunk[time])):
                self.held.updateValue((int(at), n), (_packed(part),))
        places = sorted((int(s), int(n)) for s, n in self.held.keys())
        for _, of_span in groupby(places, key=lambda place: place[0]):
            parts = []
            for place in of_span:
                parts.append(_unpacked(self.held.getValue(place)[0]))
                self.held.removeKey(place)
            yield ordered(pd.concat(parts), by)

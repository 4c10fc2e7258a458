"""Repeats suppressed for a time to live: a row passes if none of its key passed less than that before.

A row that is held back does not prolong the time. That depends on all rows of a key before, so keys are taken
in order of time: in batches by a sort, in streams by state that waits for the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

MICROS = 1_000_000


def _passing(times: np.ndarray, last: int | None, ttl: int) -> tuple[list[int], int | None]:
    """Places of the sorted ``times`` that pass after ``last``, and the last that passed. One search per row that passes."""
    out, at = [], 0 if last is None else int(np.searchsorted(times, last + ttl))
    while at < len(times):
        out.append(at)
        last = int(times[at])
        at = int(np.searchsorted(times, last + ttl))
    return out, last


def _folded(keys: list[str], ttl: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            codes = pdf["_key"].to_numpy()
            times = pdf["_t"].to_numpy()
            edges = np.flatnonzero(codes[1:] != codes[:-1]) + 1
            kept = []
            for low, high in zip([0, *edges], [*edges, len(pdf)]):
                if codes[low] != key:
                    key, last = codes[low], None
                places, last = _passing(times[low:high], last, ttl)
                kept += [low + p for p in places]
            yield pdf.iloc[kept].drop(columns=["_key", "_t"])
    return run


def _key(keys: list[str]):
    """The key as text: nulls are values of their own."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def suppressed(rows: DataFrame, keys: list[str], ttl_seconds: float) -> DataFrame:
    """The rows of ``rows`` (keys, ts) that pass, all columns. Of rows of one key and time the first in order of the other
    columns passes; rows without a time are left out. Keys go to tasks whole, in order of time, and a task holds a batch."""
    others = sorted(c for c in rows.columns if c not in (*keys, "ts"))
    timed = rows.where("ts IS NOT NULL").withColumn("_key", _key(keys)).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    return (timed.repartition("_key").sortWithinPartitions("_key", "_t", *others)
            .mapInPandas(_folded(keys, round(ttl_seconds * MICROS)), rows.schema))


class _Suppressor(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, by a timer for each, then lets them pass in order of time;
    one more timer forgets the last that passed when nothing can be its repeat any more."""

    def __init__(self, schema: StructType, order: list[str], ttl: int):
        self.schema, self.order, self.ttl = schema, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([*self.schema.fields, StructField("_t", LongType())]))
        self.last = handle.getValueState("last", StructType([StructField("t", LongType())]))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for row in rows:
            self.waiting.appendValue(tuple(row[f] for f in [*self.schema.names, "_t"]))
            self.handle.registerTimer(-(-row["_t"] // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        names = [*self.schema.names, "_t"]
        held = [Row(**dict(zip(names, tuple(r)))) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in held if r["_t"] <= reached), key=lambda r: (r["_t"], *((r[c] is not None, r[c] or 0) for c in self.order)))
        last = self.last.get()[0] if self.last.exists() else None
        places, last = _passing(np.array([r["_t"] for r in due], np.int64), last, self.ttl)
        rest = [tuple(r[n] for n in names) for r in held if r["_t"] > reached]
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if last is not None and last + self.ttl <= reached and not rest:
            self.last.clear()
        elif last is not None and places:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.ttl) // 1000))
        return iter([Row(**{n: due[p][n] for n in self.schema.names}) for p in places])

    def close(self) -> None:
        pass


def suppressed_stream(rows: DataFrame, keys: list[str], ttl_seconds: float, delay: str = "1 minute") -> DataFrame:
    """``suppressed`` of a stream: rows come out once the watermark (``delay`` behind the latest time) has passed them, so
    rows out of order by less than that make no difference. The state of a key is its waiting rows and one time, and goes
    after the time to live. Needs the RocksDB state store."""
    others = sorted(c for c in rows.columns if c not in (*keys, "ts"))
    timed = (rows.where("ts IS NOT NULL").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))).withWatermark("ts", delay)
             .withColumn("_key", _key(keys)))
    return timed.groupBy("_key").transformWithState(
        _Suppressor(rows.schema, others, round(ttl_seconds * MICROS)), rows.schema, "append", "eventtime")

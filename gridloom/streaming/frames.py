"""Streams of frames: each tile of a grid keeps its last frame as state and meets the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gridloom.grid import Grid, GridMeta
from gridloom.operators import tracking

SIDE = 256
#: Marks a cell that has not come yet.
OPEN = -(2**31)
PAIRS = "grid_id string, before_ts timestamp, now_ts timestamp, row int, col int, was int, value int"


class _Pairs(StatefulProcessor):
    """Open frames of a tile by time, and the last closed one. A frame closes when the watermark has passed its time."""

    def __init__(self, meta: GridMeta, side: int):
        self.meta, self.side = meta, side

    def init(self, handle):
        self.handle = handle
        self.open = handle.getMapState("open", "ms long", "cells array<int>")
        self.last = handle.getValueState("last", "ms long, cells array<int>")

    def _shape(self, key) -> tuple[int, int, int, int]:
        r, c = int(key[1]) * self.side, int(key[2]) * self.side
        return r, c, min(self.side, self.meta.nrows - r), min(self.side, self.meta.ncols - c)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        r0, c0, n, m = self._shape(key)
        closed = self.last.get()[0] if self.last.exists() else None
        pdf = pd.concat(list(rows))
        for ms, part in pdf.groupby("ms", sort=True):
            if closed is not None and ms <= closed:
                continue  # late: the frame has met its successor
            if self.open.containsKey((int(ms),)):
                cells = np.array(self.open.getValue((int(ms),))[0], np.int64)
            else:
                cells = np.full(n * m, OPEN)
                self.handle.registerTimer(int(ms))
            part = part.drop_duplicates(["row", "col"])
            at = (part["row"].to_numpy() - r0) * m + part["col"].to_numpy() - c0
            new = cells[at] == OPEN  # what came first stays
            cells[at[new]] = part["value"].to_numpy()[new]
            self.open.updateValue((int(ms),), (cells.tolist(),))
        yield pd.DataFrame({"grid_id": [], "before_ts": [], "now_ts": [], "row": [], "col": [], "was": [], "value": []}).astype({"grid_id": str, "before_ts": "datetime64[ms]", "now_ts": "datetime64[ms]", "row": "int32", "col": "int32", "was": "int32", "value": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = int(expiredTimerInfo.getExpiryTimeInMs())
        if not self.open.containsKey((ms,)):
            return
        r0, c0, n, m = self._shape(key)
        due = sorted(int(k[0]) for k in self.open.keys() if int(k[0]) <= ms)  # timers may come in any order
        for t in due:
            cells = [self.meta.missing if x == OPEN else x for x in self.open.getValue((t,))[0]]
            self.open.removeKey((t,))
            if self.last.exists():
                before, was = self.last.get()
                r, c = np.indices((n, m), np.int32).reshape(2, -1)
                yield pd.DataFrame({"grid_id": key[0], "before_ts": pd.Timestamp(int(before), unit="ms"), "now_ts": pd.Timestamp(t, unit="ms"), "row": r + np.int32(r0), "col": c + np.int32(c0), "was": np.array(was, np.int32), "value": np.array(cells, np.int32)})
            self.last.update((t, cells))

    def close(self):
        pass


def frame_pairs(frames: DataFrame, meta: GridMeta, late: str = "0 seconds", side: int | None = None) -> DataFrame:
    """grid_id, before_ts, now_ts, row, col, was, value: each frame of a stream (grid_id, frame_ts, row, col, value) cell by cell with the one before it.

    Frames are taken in the order of their time, whatever the order of arrival, when the watermark (the newest time less late) has passed them: so
    the newest frame waits for the next. A frame that arrives again changes nothing, cells that come after their frame has closed are dropped, and
    cells that never come are missing. A tile of a grid is a key, so no task holds a whole frame. Needs the RocksDB state store.
    """
    side = side or SIDE
    rows = frames.where("grid_id is not null and row is not null and col is not null and value is not null").withWatermark("frame_ts", late)
    rows = rows.select("grid_id", F.floor(F.col("row") / side).alias("tr"), F.floor(F.col("col") / side).alias("tc"), "frame_ts", F.unix_millis("frame_ts").alias("ms"), "row", "col", "value")
    return rows.groupBy("grid_id", "tr", "tc").transformWithStateInPandas(_Pairs(meta, side), PAIRS, "Append", "EventTime")


def frame_differences(pairs: DataFrame) -> DataFrame:
    """grid_id, now_ts, row, col, value: the change since the frame before; missing counts as a number, as in cells.difference()."""
    return pairs.select("grid_id", "now_ts", "row", "col", (F.col("value") - F.col("was")).alias("value"))


def on_pairs(meta: GridMeta, path: str, f: Callable[[Grid, Grid], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: f(before, now) of every pair of frames that a batch closes, as Parquet under path by grid and time.

    All tiles of a frame close in one batch, as the watermark is the stream's. A batch that runs again writes the same files over.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for r in batch.select("grid_id", "before_ts", "now_ts").distinct().orderBy("grid_id", "now_ts").collect():  # a row a frame
            own = batch.where((F.col("grid_id") == r.grid_id) & (F.col("now_ts") == r.now_ts))
            before, now = (Grid(own.select("row", "col", F.col(c).alias("value")), meta) for c in ("was", "value"))
            out = f(before, now).withColumns({"grid_id": F.lit(r.grid_id), "now_ts": F.lit(r.now_ts)})
            out.write.mode("overwrite").parquet(f"{path}/{r.grid_id}-{r.now_ts:%Y%m%dT%H%M%S%f}")
        batch.unpersist()

    return run


def track_frames(meta: GridMeta, path: str, low: int, high: int, least: int) -> Callable[[DataFrame, int], None]:
    """Object tracking of every pair of frames, as on_pairs() does it."""
    return on_pairs(meta, path, lambda before, now: tracking.track(before, now, low, high, least))

"""Frames as a stream against pairs of frames as a batch."""

import datetime as dt

import numpy as np
import pytest

from gridloom.grid import Grid, GridMeta
from gridloom.operators import cells, tracking
from gridloom.streaming import frames

META = GridMeta(12, 15, -1)
SCHEMA = "grid_id string, frame_ts timestamp, row int, col int, value int"
BEGIN = dt.datetime(2024, 1, 1)


def movie(n=10):
    i, j = np.indices((META.nrows, META.ncols))
    out = []
    for k in range(n):
        a = np.zeros((META.nrows, META.ncols), int)
        for y, x, h in ((2 + 0.6 * k, 3 + 0.4 * k, 9), (9 - 0.5 * k, 12 - 0.7 * k, 7)):
            a = np.maximum(a, np.round(h * np.exp(-((i - y) ** 2 + (j - x) ** 2) / 3)).astype(int))
        a[0, k % META.ncols] = -1
        out.append(a)
    return out


def rows(grid_id, k, a):
    return [(grid_id, BEGIN + dt.timedelta(minutes=5 * k), int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(a)]


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def batch_pairs(spark, images, f):
    out = set()
    for k in range(1, len(images)):
        a, b = (Grid(spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(x)], "row int, col int, value int"), META) for x in images[k - 1 : k + 1])
        out |= {(k, *r) for r in f(a, b).collect()}
    return out


def test_stream_equals_batch_and_restarts(spark, rocksdb, tmp_path):
    images, at = movie(), str(tmp_path)
    minute = lambda t: round((t - BEGIN).total_seconds() / 300)

    def add(name, data):
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(f"{at}/in/{name}")

    def go():
        pairs = frames.frame_pairs(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{at}/in"), META, "6 minutes", side=8)
        diff = frames.frame_differences(pairs)
        q = diff.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    # out of order by one frame, a frame twice with other values, and one that is cut in two
    order = [0, 2, 1, 3, 4]
    for n, k in enumerate(order):
        add(f"{n}", rows("g", k, images[k]) + (rows("h", k, images[-1 - k]) if k < 4 else []))
    add("again", rows("g", 4, images[4] + 50))
    go()
    half = rows("g", 5, images[5])
    add("half1", half[:70])
    add("half2", half[70:])
    for k in range(6, 10):
        add(f"{k}", rows("g", k, images[k]))
    add("late", rows("g", 3, images[3] + 20))
    add("end", rows("end", 20, images[0]))
    go()  # goes on from the checkpoint
    got = spark.read.parquet(f"{at}/out").collect()
    mine = {(minute(r.now_ts), r.row, r.col, r.value) for r in got if r.grid_id == "g"}
    want = batch_pairs(spark, images, lambda a, b: cells.difference(b, a).df.select("row", "col", "value"))
    assert len([r for r in got if r.grid_id == "g"]) == len(mine) == 9 * META.nrows * META.ncols
    assert mine == want
    assert {minute(r.now_ts) for r in got if r.grid_id == "h"} == {1, 2, 3}


def test_tracking_of_frames(spark, rocksdb, tmp_path):
    images, at = movie(4), str(tmp_path)
    for k, a in enumerate(images):
        spark.createDataFrame(rows("g", k, a), SCHEMA).coalesce(1).write.parquet(f"{at}/in/{k}")
    spark.createDataFrame(rows("end", 9, images[0]), SCHEMA).coalesce(1).write.parquet(f"{at}/in/end")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{at}/in")
    q = frames.frame_pairs(stream, META).writeStream.foreachBatch(frames.track_frames(META, f"{at}/out", 2, 5, 3)).option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(round((r.now_ts - BEGIN).total_seconds() / 300), r.row, r.col, r.u, r.v) for r in spark.read.option("recursiveFileLookup", True).parquet(f"{at}/out").collect()}
    assert got == batch_pairs(spark, images, lambda a, b: tracking.track(a, b, 2, 5, 3).select("row", "col", "u", "v"))
    assert any(x[3] or x[4] for x in got)

"""Tiled and iterative operators against plain versions, and files and streams there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta
from gridloom.operators import distance, geometry, graph, motion, segment, spectral, tracking
from gridloom.sources import files
from gridloom.streaming import running


def grid(spark, a, missing=-9999):
    a = np.asarray(a)
    rows = [(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(a)]
    return Grid(spark.createDataFrame(rows, "row int, col int, value int"), GridMeta(*a.shape, missing, 50.0, -100.0, 0.5, 0.5))


def array(df, shape, value="value"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r.row, r.col] = r[value]
    return out


def flood(on):
    root, n = np.full(on.shape, -1), on.shape[1]
    for start in zip(*np.nonzero(on), strict=True):
        todo = [start] if root[start] < 0 else []
        while todo:
            i, j = todo.pop()
            if 0 <= i < on.shape[0] and 0 <= j < n and on[i, j] and root[i, j] < 0:
                root[i, j] = start[0] * n + start[1]
                todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return root


@pytest.mark.parametrize("tile", [512, 5])
def test_components(spark, tile):
    r = np.random.default_rng(tile)
    a = (r.random((23, 31)) < 0.45).astype(int)
    a[3, :] = a[:, 7] = 1  # a component over many tiles
    a[10:18, 10:18] = 0
    a[11:17, 12] = a[16, 12:17] = a[11:17, 16] = a[12, 14:17] = 1  # a coil
    g = grid(spark, a)
    got = array(segment.components(g.df.where("value > 0"), 31, tile), a.shape, "root")
    assert (got[a > 0] == flood(a > 0)[a > 0]).all()
    assert segment.components(g.df.where("value > 5"), 31, tile).count() == 0


def test_connected(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50, 90)] + [(7, 3), (3, 7), (1, 1)], "a long, b long")
    got = {r.node: r.component for r in graph.connected(e).collect()}
    assert got == {i: 50 for i in range(50, 91)} | {3: 3, 7: 3}


def test_distance(spark):
    r = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.0):
        a = (r.random((17, 12)) < share).astype(int)
        seeds = np.argwhere(a)
        want = np.array([[min(((i - y) ** 2 + (j - x) ** 2 for y, x in seeds), default=17**2 + 12**2) for j in range(12)] for i in range(17)])
        assert (array(distance.edt(grid(spark, a), 0).df, a.shape) == want).all()


def test_thinning_in_tiles(spark):
    r = np.random.default_rng(5)
    a = np.zeros((40, 44), int)
    for _ in range(5):
        i, j = r.integers(0, 30, 2)
        a[i : i + r.integers(4, 14), j : j + r.integers(4, 14)] = 1
    i, j = np.ogrid[:40, :44]
    want = distance._peel(a.astype(np.int8), (i >= 1) & (i <= 38) & (j >= 1) & (j <= 42), 1000)
    assert 0 < want.sum() < a.sum()
    for tile, rounds in ((256, 16), (16, 2)):
        assert (array(distance.skeleton(grid(spark, a), 0, tile, rounds).df, a.shape) == want).all()


def test_phase_correlation(spark):
    """Frames cut from one scene, as far apart as the shift; a border of now doesn't count."""
    scene = np.random.default_rng(1).integers(0, 100, (80, 84))
    for u, v in ((2, -3), (0, 0), (5, 9), (-2, -3)):
        a, b = scene[20:52, 20:52], scene[20 - u : 52 - u, 20 - v : 52 - v]
        got = spectral.phase_correlation(grid(spark, a), grid(spark, b), 3, 3).first()
        mid = b.copy()
        i, j = np.indices(b.shape)
        mid[(i < 3) | (j < 3) | (i > 29) | (j > 29)] = 0
        x = np.fft.fft2(a) * np.conj(np.fft.fft2(mid))
        r, c = np.unravel_index(np.argmax(np.round(np.abs(np.fft.ifft2(x / np.abs(x))) ** 2, 9)), x.shape)
        assert tuple(got) == (u, v) == (-r + 32 * (r > 16), -c + 32 * (c > 16))
    flat = grid(spark, np.full((8, 8), 5))  # its spectrum has zeros
    assert tuple(spectral.phase_correlation(flat, flat, 1, 1).first()) == (0, 0)


def correlate(a, b, est, most, miss):
    out = np.zeros((*a.shape, 2), int)
    for i, j in np.ndindex(a.shape):
        best = None
        for k, (u, v) in enumerate((u, v) for u in range(-most, most + 1) for v in range(-most, most + 1)):
            d = q = n = 0
            for y in range(i - est, i + est + 1):
                for x in range(j - est, j + est + 1):
                    if 0 <= y < a.shape[0] and 0 <= x < a.shape[1] and 0 <= y - u < a.shape[0] and 0 <= x - v < a.shape[1] and b[y, x] != miss and a[y - u, x - v] != miss:
                        d, q, n = d + (b[y, x] - a[y - u, x - v]) ** 2, q + b[y, x] ** 2, n + 1
            if q > 0 and d < 0.75 * q and 2 * n >= (2 * est + 1) ** 2 and (best is None or (d / q, k) < best[:2]):
                best = (d / q, k, u, v)
        if best:
            out[i, j] = best[2:]
    return out


def test_pyramid_is_its_definition(spark):
    """At the coarsest level the window is one cell, so a smooth blob's centre may match its other side: that is the method, not an error."""
    miss, i, j = -1, *np.indices((12, 12))
    a, b = (np.floor(100 * np.exp(-((i - y) ** 2 + (j - x) ** 2) / 8.0)).astype(int) for y, x in ((5, 5), (7, 6)))

    def small(x, f):
        if f == 1:
            return x
        h, out = (f + 1 - f % 2) // 2, np.full(x.shape, miss)
        for r, c in np.ndindex(x.shape):
            if h <= r < x.shape[0] - h and h <= c < x.shape[1] - h:
                w = x[r - h : r + h + 1, c - h : c + h + 1]
                if (w != miss).any():
                    out[r, c] = np.floor(w[w != miss].mean() + 0.5)
        return out[::f, ::f]

    total = np.zeros((12, 12, 2), int)
    for level in (1, 0):
        f, moved = 1 << level, np.full(a.shape, miss)
        for r, c in np.ndindex(a.shape):
            y, x = r - total[r, c, 0], c - total[r, c, 1]
            if 0 <= y < 12 and 0 <= x < 12:
                moved[r, c] = a[y, x]
        total = total + f * correlate(small(moved, f), small(b, f), 1 - level, 1, miss).repeat(f, 0).repeat(f, 1)
    got = tracking.pyramid(grid(spark, a, miss), grid(spark, b, miss), 2)
    assert (array(got, a.shape, "u") == total[..., 0]).all() and (array(got, a.shape, "v") == total[..., 1]).all()


def test_bounding_grid_and_scatter(spark):
    p = spark.createDataFrame([(35.21, -90.04, 10), (36.4, -82.5, 30), (35.9, -86.7, -9999)], "lat double, lon double, value int")
    m = geometry.bounding_grid(p, 0.1, 0.1)
    assert (m.nrows, m.ncols, round(m.nw_lat, 6), round(m.nw_lon, 6)) == (14, 77, 36.5, -90.1)
    g = geometry.scatter(p, m, geometry.cressman(0.25), 0.25)
    got = {(r.row, r.col): r.value for r in g.valid.collect()}
    own = [((m.nw_lat - la) / 0.1, (lo - m.nw_lon) / 0.1, v) for la, lo, v in ((35.21, -90.04, 10), (36.4, -82.5, 30))]
    for y, x, v in own:
        assert got[int(y), int(x)] == v
    assert set(got.values()) == {10, 30}


def test_spline_raster(spark):
    g = grid(spark, np.zeros((100, 100), int))
    c = spark.createDataFrame([(0, 40.0, -90.0), (1, 30.0, -80.0), (2, 35.0, -70.0), (3, 20.0, -60.0)], "seq int, lat double, lon double")
    on = geometry.spline_raster(g, c).df.where("value = 1").collect()
    assert len({r.col for r in on}) == len(on) == 60 and all(0 <= r.row < 100 for r in on)


def test_files_there_and_back(spark, tmp_path):
    a = np.arange(12).reshape(3, 4) * 7
    a[1, 2] = -9999
    g = grid(spark, a)
    files.write_esri(g, f"{tmp_path}/grid")
    back = files.read_esri(spark, f"{tmp_path}/grid")
    assert (array(back.df, a.shape) == a).all() and (back.meta.nrows, back.meta.ncols, back.meta.nw_lat, back.meta.lat_res) == (3, 4, 50.0, 0.5)
    (tmp_path / "zips.csv").write_text("73069,35.2,-97.4,Norman,OK,Cleveland\n00000,,,,,\n")
    assert [r.zip for r in files.read_zips(spark, f"{tmp_path}/zips.csv").collect()] == ["73069"]
    (tmp_path / "income.csv").write_text("Country,a,b,Group\nX,1,2,Low income\nY,1,2,Aggregates\nZ,1,2,High income: OECD\n")
    assert [(r.name, r.code) for r in files.read_categories(spark, f"{tmp_path}/income.csv").orderBy("name").collect()] == [("X", 1), ("Z", 5)]
    marks = files.kml_placemarks(spark.createDataFrame([("Norman", 35.2, -97.4)], "name string, lat double, lon double"))
    assert "<name>Norman</name>" in marks and "-97.4,35.2" in marks
    (tmp_path / "c.kml").write_text("<kml><Placemark><name>P</name><LinearRing><coordinates>-1,2,0 3,4 5,6</coordinates></LinearRing></Placemark></kml>")
    assert [(r.name, r.seq, r.lat, r.lon) for r in files.read_kml(spark, f"{tmp_path}/c.kml").orderBy("seq").collect()] == [("P", 0, 2.0, -1.0), ("P", 1, 4.0, 3.0), ("P", 2, 6.0, 5.0)]
    (tmp_path / "t.txt").write_text("STATION DATE TIME TEMP LAT LON\nA 2010 0000 290.15 35.5 -90.5\nB 2010 0000 x 35 -90\n")
    assert [(r.station, r.value, r.lat) for r in files.read_points(spark, f"{tmp_path}/t.txt", 10.0, -1).collect()] == [("A", 2902, 35.5)]


def test_streams(spark, tmp_path):
    rows = [("k", t, float(t * t % 17)) for t in range(30)]
    df = spark.createDataFrame(rows, "key string, t long, z double").repartition(1)
    df.write.parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, motion.kalman(df).collect()))
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = running.kalman_stream(stream).writeStream.format("memory").queryName("kalman_rows").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kalman_rows").collect())) == want
    timed = stream.withColumn("ts", F.timestamp_seconds("t"))
    q = running.running_stats(timed, "key", "z", "ts", "10 seconds").writeStream.format("memory").queryName("stats_rows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.n, round(r.mean, 6)) for r in spark.table("stats_rows").collect()) == sorted((10, round(float(np.mean([z for _, t, z in rows if t // 10 == k])), 6)) for k in range(3))

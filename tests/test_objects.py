"""Objects, motion, models, spectra, files and compositions, against numpy and known answers on small grids."""

import zlib

import numpy as np
import pytest

from gridloom.grid import Grid, GridMeta
from gridloom.operators import frequency, models, objects, texture, tracking
from gridloom.plans import compositions
from gridloom.sources import pictures, rasters
from tests.test_grids import grid


def array(g):
    a = np.zeros((g.meta.nrows, g.meta.ncols), int)
    for r in g.df.collect():
        a[r.row, r.col] = r.value
    return a


def blobs(shape, *centres):
    i, j = np.indices(shape)
    return np.floor(sum(100 * np.exp(-((i - r) ** 2 + (j - c) ** 2) / 8) for r, c in centres) + 0.5).astype(int)


def test_two_peaks_are_two_objects(spark):
    g = grid(spark, blobs((24, 40), (10, 9), (11, 29)))
    found = objects.peak_objects(g, 20, 10, 100, 5, 4).where("label > 0").collect()
    assert {r.label for r in found} == {1, 2}
    assert all((r.col < 20) == (r.label == 1) for r in found)


def test_levels_and_scales(spark):
    a = np.repeat(np.array([[-15, 10, 20, 30]]), 4, 0).repeat(3, 1)
    g = grid(spark, a)
    assert (array(objects.kmeans_levels(g, 0, 30, 3)) == np.maximum(a // 10, 0)).all()
    scales = objects.multiscale(g, 0, 30, 3)
    assert [s.where("label > 0").count() for s in scales] == [24, 12, 0]


def test_texture_of_a_flat_grid(spark):
    got = {(r.row, r.col, r.direction): (r.uniformity, r.max_prob) for r in objects.local_texture(grid(spark, np.full((7, 7), 5)), 3, 3, 0, 10, 2).collect()}
    assert len(got) == 7 * 7 * 4 and got[3, 3, "EAST"] == (100, 100) and got[0, 0, "EAST"][0] < 100


def test_snake_closes_in_on_an_edge(spark):
    i, j = np.indices((40, 40))
    ring = np.exp(-((np.hypot(i - 20, j - 20) - 8) ** 2) / 8) * 100
    start = [(round(20 + 12 * np.cos(t)), round(20 + 12 * np.sin(t))) for t in np.arange(0, 2 * np.pi, np.pi / 8)]
    out = np.array(objects.snake_array(ring, start, 40))
    assert abs(np.hypot(*(out - 20).T).mean() - 8) < abs(np.hypot(*(np.array(start) - 20).T).mean() - 8)


@pytest.mark.parametrize("fixed", [True, False])
def test_spectra(spark, fixed):
    a = np.random.default_rng(3).integers(0, 90, (8, 8))
    g = grid(spark, a)
    if fixed:
        f = np.minimum(np.arange(8), 8 - np.arange(8))
        r = np.hypot(f[:, None], f[None]) / (np.hypot(8, 8) / 4)
        want = np.fft.ifft2(np.where((r < 0.2) | (r > 0.9), 0, np.fft.fft2(a))).real
        assert np.abs(array(frequency.bandpass(g, 0.2, 0.9, "fixed")) - want).max() <= 0.5 + 1e-9
    assert (array(frequency.fft_convolve(g, [[1, 0], [0, 2]])) == a + 2 * np.roll(a, (-1, -1), (0, 1))).all()


def test_motion_of_a_blob(spark):
    a, b = grid(spark, blobs((32, 32), (12, 12))), grid(spark, blobs((32, 32), (14, 13)))
    at = {(r.row, r.col): (r.u, r.v) for r in tracking.track(a, b, 20, 60, 3).collect()}
    assert at[14, 13] == (20, 10) and at[0, 0] == (0, 0)
    labels = compositions.segment.hysteresis(b, 20, 60)
    at = {(r.row, r.col): (r.u, r.v) for r in tracking.hybrid(a, b, labels, 3, 3).collect()}
    assert at[14, 13] == (2, 1)


def test_pyramid_of_a_moved_frame(spark):
    a = np.random.default_rng(4).permutation(144).reshape(12, 12) * 7 + 100
    flow = {(r.row, r.col): (r.u, r.v) for r in tracking.pyramid(grid(spark, a), grid(spark, np.roll(a, (1, 0), (0, 1))), 1).collect()}
    assert len(flow) == 144 and all(flow[i, j] == (1, 0) for i in range(2, 12) for j in range(12))
    flow = tracking.pyramid(grid(spark, a), grid(spark, a), 4).collect()
    assert len(flow) == 144


def test_kendall_with_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, 60).tolist(), rng.integers(0, 13, 60).tolist()
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(60) for j in range(i))
    free = [sum(v[i] != v[j] for i in range(60) for j in range(i)) for v in (x, y)]
    rows = spark.createDataFrame([*zip(x, y, strict=True), (None, 1), (1, None)], "a int, b int")
    assert abs(models.kendall(rows, "a", "b").first()[0] - s / np.sqrt(free[0] * free[1])) < 1e-9
    assert models.kendall(rows.limit(0), "a", "b").first()[0] is None


def test_pursuit_finds_a_kernel(spark):
    g = models.simulate(grid(spark, np.zeros((20, 20))), [(8, 11, 3.0, 3.0)], [200.0])
    (centre, amplitude), *_ = models.projection_pursuit(g, 10.0, 1)
    assert centre[:2] == (8, 11) and amplitude > 150


def test_quantizer_parts_two_levels(spark):
    g = grid(spark, np.array([[10, 10, 90, 90]]))
    centres = texture.vector_quantizer([g], 2)
    assert sorted(c[0] for c in centres) == [10, 90] and len({r.value for r in texture.quantize([g], centres).df.collect()}) == 2
    assert (array(texture.log_edges(grid(spark, np.zeros((15, 15))), 2, 1)) == 0).all()
    flat = array(texture.oriented(grid(spark, np.full((15, 15), 7)), 3, 2, 1))
    assert flat[7, 7] == 7 and flat[0, 0] == -9999


def test_prefix_lookup(spark):
    names = spark.createDataFrame([("alpha",), ("betas",), ("zz",)], "name string")
    table = spark.createDataFrame([("alpha", 1), ("beta", 2), ("becks", 3)], "name string, code int")
    assert {r.name: r.code for r in compositions.prefix_lookup(names, table).collect()} == {"alpha": 1, "betas": 3, "zz": None}


def test_picture(spark):
    body = pictures.picture(grid(spark, np.array([[0, 50], [100, -9999]])), pictures.gray())
    at = body.index(b"IDAT")
    lines = zlib.decompress(body[at + 4 : body.index(b"IEND") - 8])
    assert lines[0] == 0 and lines[1] == 1 and lines[4] > 200 and lines[5] == 0


def test_frames_and_lambert(spark, tmp_path):
    (tmp_path / "ir_20240103-120500_2x3_50.5_-10.25_sub_type_0.5_0.25.llg").write_bytes(bytes([0, 255, 128, 1, 2, 3]))
    rows = {(r.row, r.col): r for r in rasters.read_frames(spark, f"file://{tmp_path}").collect()}
    assert rows[0, 1].value == 1 and rows[0, 2].value == 128 and rows[1, 2].value == -3 and rows[0, 0].nw_lon == -10.25
    head = "ELLIPSOID WGS-84 PROJECTION LAMBERT2SP LAT1 30 LAT2 45 LAT 38 LON -95 DX 10000 DY 10000 NROWS 4 NCOLS 5\n"
    (tmp_path / "a.txt").write_text(head + "\n".join(" ".join(["2.0"] * 5) for _ in range(4)))
    g = rasters.read_lambert(spark, f"file://{tmp_path}/a.txt", 10)
    values = {r.value for r in g.df.collect()}
    assert (g.meta.nrows, g.meta.ncols) == (4, 5) and 20 in values and values <= {20, -999} and 36 < g.meta.nw_lat < 40


def test_tree_and_net_at_their_bounds(spark):
    d = spark.createDataFrame([(0.0, 10.0), (0.0, 20.0), (40.0, 60.0), (0.0, 60.0), (200.0, 90.0), (0.0, 90.0)], "p double, l double")
    got = [r[0] for r in d.select(models.decision_tree(d.p, d.l)).collect()]
    assert got == [0, 1, 1, 2, 2, 4]
    assert all(0 <= r[0] <= 100 for r in d.select(models.neural_net(d.p, d.l)).collect())


def test_sprawl_reports_growth(spark):
    a, b = blobs((30, 30), (8, 8), (22, 20)), blobs((30, 30), (8, 8), (22, 20), (20, 22), (24, 22))
    a, b = (np.minimum(x, 100) ** 2 // 10 for x in (a, b))
    rows = compositions.sprawl(Grid(grid(spark, a).df, GridMeta(30, 30)), grid(spark, b), 0, 20, 60).collect()
    assert max(r.growth for r in rows) > 20


def test_kmeans_does_not_follow_partitions(spark, monkeypatch):
    """Copies are weights, and what a task holds follows distinct rows, however few files or partitions they come in."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 0), (0, 9))])
    rows = spark.createDataFrame(p[np.arange(1200) % 120].tolist() + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    one, many = (models.kmeans(rows.repartition(n), ["x", "y"], seed=3) for n in (1, 7))
    centres = [p[i : i + 40].mean(0) for i in (0, 80, 40)]
    assert np.allclose(sorted(one[0]), sorted(map(list, centres))) and np.allclose(one[0], many[0]) and one[1] == pytest.approx(many[1])
    z = (p - p.mean(0)) / p[np.arange(1200) % 120].std(0, ddof=1)
    assert one[1] == pytest.approx(10 * sum(((z[i : i + 40] - z[i : i + 40].mean(0)) ** 2).sum() for i in (0, 40, 80)))
    monkeypatch.setattr(models, "FIT_ROWS", 30)
    held = models._weighted(rows.coalesce(1), ["x", "y"])[0].rdd.glom().map(len).collect()
    assert sum(held) == 120 and max(held) < 60

"""Operators by tiles, boxes and buckets against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import distance, field, motion, objects, ranks, segment, stats, stencil, texture, tiles
from tests.test_tiles import array, correlate, flood, grid

MISS = -9999


def holes(seed, shape=(19, 23), low=-40, high=200):
    r = np.random.default_rng(seed)
    a = r.integers(low, high, shape)
    a[r.random(shape) < 0.15] = MISS
    a[2:8, 3:9] = MISS
    return a


def plain(a, k, f):
    """f(values, weights) of the valid cells under the kernel, None on the border and where there are none."""
    k = np.asarray(k)
    h, w = k.shape[0] // 2, k.shape[1] // 2
    out = np.full(a.shape, None, object)
    for i in range(h, a.shape[0] - h):
        for j in range(w, a.shape[1] - w):
            x = a[i - h : i + h + 1, j - w : j + w + 1]
            ok = (x != MISS) & (k != 0)
            out[i, j] = f(x[ok], k[ok])
    return out


@pytest.mark.parametrize("side", [256, 5])
def test_kernels(spark, monkeypatch, side):
    monkeypatch.setattr(tiles, "SIDE", side)
    a = holes(side)
    g = grid(spark, a)
    for k in (stencil.boxcar(3), stencil.gauss(5), [[0.0, 1.0, 2.0, 1.0, 0.0]], [[-1.0], [3.0], [0.5]]):
        want = plain(a, k, lambda x, w: int(np.floor((x * w).sum() / w.sum() + 0.5)) if len(x) and w.sum() > 0 else MISS)
        assert (array(stencil.smooth(g, k).df, a.shape) == np.where(want == None, MISS, want)).all()  # noqa: E711
        want = plain(a, k, lambda x, w: int(np.floor((x * w).sum() + 0.5)))
        assert (array(stencil.convolve(g, k).df, a.shape) == np.where(want == None, MISS, want)).all()  # noqa: E711
    for h in (1, 2):
        want = plain(a, np.ones((2 * h + 1,) * 2), lambda x, w: sorted(x)[len(x) // 2] if len(x) else MISS)
        assert (array(stencil.median(g, h).df, a.shape) == np.where(want == None, MISS, want)).all()  # noqa: E711
    masks = [np.array(m, float) for m in texture.ellipse_masks(5, 3, 1)]
    each = [plain(a, m, lambda x, w: int(np.floor(x.mean() + 0.5)) if len(x) else MISS) for m in masks]
    want = [[max([m[i, j] for m in each if m[i, j] not in (None, MISS)], default=MISS) for j in range(a.shape[1])] for i in range(a.shape[0])]
    assert (array(texture.oriented(g, 5, 3, 1).df, a.shape) == want).all()
    with pytest.raises(ValueError, match="odd"):
        stencil.smooth(g, stencil.boxcar(4))


@pytest.mark.parametrize("side", [256, 4])
def test_correlation_by_tiles(spark, monkeypatch, side):
    monkeypatch.setattr(tiles, "SIDE", side)
    a = holes(7, (11, 13), 0, 60)
    b = np.roll(a, (1, -2), (0, 1))
    b[4, 4] = MISS
    got = motion.cross_correlation(grid(spark, a), grid(spark, b), 1, 2, 2)
    want = correlate(a, b, 1, 2, MISS)
    assert (np.dstack((array(got, a.shape, "u"), array(got, a.shape, "v"))) == want).all() and want.any()


@pytest.mark.parametrize("side", [256, 6])
def test_texture_by_tiles(spark, monkeypatch, side):
    monkeypatch.setattr(tiles, "SIDE", side)
    a = holes(9, (9, 14), 0, 60)
    got = {(r.row, r.col, r.direction): (r.uniformity, r.max_prob) for r in objects.local_texture(grid(spark, a), 3, 5, 10, 15, 3).collect()}
    b = np.where((a == MISS) | (a < 10), 3, np.minimum((a - 10) // 15, 2))
    at = lambda i, j: b[i, j] if 0 <= i < a.shape[0] and 0 <= j < a.shape[1] else 3
    for i, j in np.ndindex(a.shape):
        for name, (u, v) in stats.DIRECTIONS.items():
            pairs = [(at(i + y, j + x), at(i + y + u, j + x + v)) for y in (-1, 0, 1) for x in (-2, -1, 0, 1, 2)]
            n = np.array([pairs.count(p) for p in set(pairs)])
            assert got[i, j, name] == (int(100 * round((n * n).sum() / 225, 9) + 0.5), int(100 * round(n.max() / 15, 9) + 0.5))
    assert len(got) == a.size * 4


def test_envelopes_of_many_columns():
    r = np.random.default_rng(4)
    for share in (0.0, 0.05, 0.5, 1.0):
        g = np.where(r.random((40, 30)) < share, r.integers(0, 30, (40, 30)) ** 2, np.inf)
        k = np.arange(40)
        want = np.min(g[None] + ((k[:, None] - k) ** 2)[:, :, None], 1)
        assert (distance._envelope(g) == want).all()


def test_strips_of_columns(spark, monkeypatch):
    monkeypatch.setattr(distance, "WIDTH", 5)
    a = (np.random.default_rng(8).random((14, 17)) < 0.06).astype(int)
    seeds = np.argwhere(a)
    want = [[min((i - y) ** 2 + (j - x) ** 2 for y, x in seeds) for j in range(17)] for i in range(14)]
    assert (array(distance.edt(grid(spark, a), 0).df, a.shape) == want).all()


def test_ranks(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 10007).alias("x"), F.lit("a").alias("other")).repartition(9)
    got = ranks.ranked(df, "x", "n").collect()
    order = sorted(r.x for r in got)
    assert {r.x: r.n for r in got} == {x: i for i, x in enumerate(order, 1)} and len(got) == 5000
    assert ranks.ranked(df.limit(0), "x", "n").count() == 0


def test_labels_in_raster_order(spark):
    a = (np.random.default_rng(6).random((30, 30)) < 0.35).astype(int)
    root = flood(a > 0)
    number = {x: i for i, x in enumerate(sorted(set(root[a > 0])), 1)}
    got = segment.label(grid(spark, a), 0)
    want = np.vectorize(lambda x: number.get(x, 0))(root)
    assert (array(got, a.shape, "label") == want).all()
    sizes = np.bincount(want.ravel())
    kept = {x: i for i, x in enumerate([k for k in range(1, len(sizes)) if sizes[k] >= 4], 1)}
    assert (array(stats.prune(got, 4), a.shape, "label") == np.vectorize(lambda x: kept.get(x, 0))(want)).all()


def test_far_objects_by_boxes(spark):
    r = np.random.default_rng(11)
    n, meta = 900, grid(spark, np.zeros((1, 1))).meta
    x, y = r.random(n) * 300, r.random(n) * 260
    x[:300], y[:300] = 40 + r.normal(0, 6, 300), 200 + r.normal(0, 6, 300)  # a crowd, and wide empty places
    size, u, v = r.integers(1, 60, n), r.integers(-9, 10, n), np.where(x > 150, 7, -7)
    rows = list(zip(range(1, n + 1), x.tolist(), y.tolist(), size.tolist(), u.tolist(), v.tolist(), strict=True))
    df = spark.createDataFrame(rows, "label int, cx double, cy double, size long, u int, v int")
    got = field.inverse_distance(df, type(meta)(300, 260)).toPandas().sort_values(["row", "col"])
    assert len(got) == 300 * 260
    i, j = np.indices((300, 260)).reshape(2, -1)
    w = size / (((i[:, None] - x) ** 2 + (j[:, None] - y) ** 2) ** 2 + 0.0001)
    for name, q in (("u", u), ("v", v)):
        want = np.floor((w @ q) / w.sum(1) + 0.5)
        off = np.abs(got[name].to_numpy() - want)
        assert off.max() <= 1 and (off > 0).mean() < 0.02


def test_contiguous_kmeans(spark):
    a = np.random.default_rng(12).integers(0, 100, (14, 16))
    a[2:6, 2:7] += 150
    a[9:13, 8:14] += 190
    g, t, seed, most, size = grid(spark, a), 60, 170, 60.0, 4.0
    label = array(segment.label(g, seed), a.shape, "label")
    for _ in range(9):
        means = {}
        for k in set(label.ravel()) - {0}:
            i, j = np.nonzero(label == k)
            v = a[i, j].astype(float)
            means[k] = (i * v).sum() / v.sum(), (j * v).sum() / v.sum(), v.mean()
        new = np.zeros_like(label)
        for i, j in np.argwhere(a > t):
            best = None
            for k, (x, y, m) in sorted(means.items()):
                like = sum(label[p, q] == k for p in range(max(0, i - 1), min(14, i + 2)) for q in range(max(0, j - 1), min(16, j + 2)) if (p, q) != (i, j))
                d = 0.1 * (1 - like / 8) + 0.8 * abs(a[i, j] - m) / most + 0.1 * ((i - x) ** 2 + (j - y) ** 2) / size**2
                if d < 1 and (best is None or d < best[0]):
                    best = d, k
            new[i, j] = best[1] if best else 0
        if (new == label).all():
            break
        label = new
    got = segment.kmeans_contiguity(g, t, seed, most, size)
    assert (array(got, a.shape, "label") == label).all() and len(set(label.ravel())) > 2


def test_contours_meet_their_cells_in_squares(spark, monkeypatch):
    monkeypatch.setattr(objects, "SQUARE", 7)
    i, j = np.indices((40, 44))
    a = np.round(100 * np.exp(-((np.hypot(i - 20, j - 22) - 9) ** 2) / 4)).astype(int)
    ring = lambda r: [(round(20 + r * np.cos(2 * np.pi * k / 16)), round(22 + r * np.sin(2 * np.pi * k / 16))) for k in range(16)]
    nodes = {1: ring(13), 2: ring(6)}
    df = spark.createDataFrame([(c, k, *p) for c, at in nodes.items() for k, p in enumerate(at)], "contour int, seq int, row int, col int")
    out = objects.snakes(grid(spark, a), df, 6)
    got = {c: [(r.row, r.col) for r in sorted(out.where(F.col("contour") == c).collect(), key=lambda r: r.seq)] for c in nodes}
    for c, at in nodes.items():
        (r0, c0), (r1, c1) = np.min(at, 0) - 6, np.max(at, 0) + 7
        r0, c0 = max(0, r0), max(0, c0)
        want = objects.snake_array(a[r0:r1, c0:c1].astype(float), [(r - r0, x - c0) for r, x in at], 6)
        assert got[c] == [(r + r0, x + c0) for r, x in want]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

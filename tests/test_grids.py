"""Grid queries against their SQL, and operators against numpy on small grids."""

import os

import numpy as np
import pytest

from gridloom.grid import Grid, GridMeta
from gridloom.operators import distance, geometry, segment, stencil
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["grid_crop", "otsu", "dilate", "median", "edt", "nearest_point"])
def test_query(spark, name):
    assert compare(spark, SF, name).startswith("ok")


def grid(spark, a):
    return Grid(spark.createDataFrame([(i, j, int(a[i, j])) for i, j in np.ndindex(a.shape)], "row int, col int, value int"), GridMeta(*a.shape))


def test_components_in_raster_order(spark):
    a = np.array([[9, 0, 9], [0, 0, 0], [9, 9, 0], [0, 0, 9]])
    got = {(r.row, r.col): r.label for r in segment.label(grid(spark, a), 5).collect()}
    assert got[0, 0] == 1 and got[0, 2] == 2 and {got[2, 0], got[2, 1], got[3, 2]} == {3} and got[1, 1] == 0


def test_opening_and_closing_bound_the_grid(spark):
    a = np.random.default_rng(1).integers(0, 50, (9, 9))
    g = grid(spark, a)
    low, high = ({(r.row, r.col): r.value for r in f(g, 1).df.collect()} for f in (stencil.erode, stencil.dilate))
    assert all(low[p] <= a[p] <= high[p] for p in np.ndindex(a.shape) if low[p] != -9999)
    assert all(r.value == 0 for r in distance.edt(g, -1).df.collect())


def test_optimal_assignment():
    cost = np.array([[1, 2, 9], [1, 4, 9], [9, 9, 3]])
    assert segment.hungarian(cost, "optimal").tolist() == [1, 0, 2]


def test_nearest_positions_are_searched_once(spark):
    """Copies of positions and dense cells make no product: pairs follow the distinct positions."""
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.uniform(0, 9, (150, 2)), rng.uniform(5, 5.01, (250, 2)), [[40.0, 80.0]]])
    q = np.concatenate([rng.uniform(0, 9, (60, 2)), rng.uniform(5, 5.01, (400, 2))])
    at, to = p[np.arange(3000) % len(p)], q[np.arange(4000) % len(q)]
    points = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(at)], "id long, lat double, lon double")
    places = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(to)], "place long, plat double, plon double")
    d = ((p[:, None] - q[None]) ** 2).sum(2)
    want = {i: int(d[i % len(p)].argmin()) if d[i % len(p)].min() < 0.25 else None for i in range(3000)}
    assert {r.id: r.place for r in geometry.nearest(points, places).collect()} == want
    sites = spark.createDataFrame(q.tolist(), "plat double, plon double")
    size = geometry._crowd_free(sites, 0.5)
    assert geometry._meet(spark.createDataFrame(p.tolist(), "lat double, lon double"), sites, size).count() <= 9 * geometry.CROWD * len(p) < len(at) * len(to) / 40


@pytest.mark.parametrize("n", [0, 1, 2, 300, 700])
def test_mean_neighbour_distance(spark, n):
    rng = np.random.default_rng(n)
    p = np.concatenate([rng.uniform(0, 9, (200, 2)), rng.uniform(5, 5.001, (298, 2)), [[500.0, -80.0], [39.0, 80.0]]])[-n:] if n else np.zeros((0, 2))
    p = p[np.arange(n) % max(1, len(p))]
    got = geometry.mean_neighbour_distance(spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(p)], "id long, lat double, lon double")).first()
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + np.diag(np.full(n, np.inf))
    assert (got.mean, got.n) == ((pytest.approx(d.min(1).mean()), n) if n > 1 else (None, 0))

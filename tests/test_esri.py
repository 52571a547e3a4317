"""ESRI grids by ranges, many grids, scalings, and tables of numbers."""

import gzip
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.grid import Grid, GridMeta
from gridloom.plans.tables import g1g
from gridloom.sources import esri, files
from tests.test_tiles import array, grid

HEADER = "ncols {c}\nnrows {r}\nxllcorner -100.0\nyllcorner 30.0\ncellsize 0.5\nNODATA_value -9999\n"


def text(a, wrap=None, sep=" "):
    v = [str(x) for x in a.ravel()]
    wrap = wrap or a.shape[1]
    return HEADER.format(r=a.shape[0], c=a.shape[1]) + "\n".join(sep.join(v[i : i + wrap]) for i in range(0, len(v), wrap)) + "\n"


@pytest.mark.parametrize("wrap,sep", [(None, " "), (3, "  "), (17, " \t")])
def test_ranges_of_bytes_cut_nothing(tmp_path, wrap, sep):
    a = np.random.default_rng(1).integers(-9999, 30000, (23, 19))
    p = tmp_path / "g.asc"
    p.write_text(text(a, wrap, sep))
    size, want = p.stat().st_size, p.read_bytes().split()
    for step in (1, 7, 64, 1000, size):
        cuts = [*range(0, size, step), size]
        got = [b" ".join(esri.tokens(str(p), x, y)).split() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        assert sum(got, []) == want and [esri.count(str(p), x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)] == [len(x) for x in got]


def test_tokens_over_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(esri, "PIECE", 5)
    p = tmp_path / "g.asc"
    p.write_text(" 123456789 1 22 333333333333   4\n5")
    for step in (1, 2, 3, 11, 40):
        got = [b" ".join(esri.tokens(str(p), x, x + step)).split() for x in range(0, 34, step)]
        assert sum(got, []) == p.read_bytes().split()
        assert [esri.count(str(p), x, x + step) for x in range(0, 34, step)] == [len(x) for x in got]


@pytest.mark.parametrize("name", ["g.asc", "g.asc.gz"])
def test_source(spark, tmp_path, name):
    a = np.random.default_rng(2).integers(0, 500, (40, 31))
    a[3, 4:9] = -9999
    body = text(a, 29).encode() + b" 7 7 7"  # what follows the last cell says nothing
    (tmp_path / name).write_bytes(gzip.compress(body) if name.endswith("gz") else body)
    esri.register(spark)
    df = spark.read.format("esri").option("splitBytes", 600).load(str(tmp_path / name))
    assert df.rdd.getNumPartitions() == (1 if name.endswith("gz") else -(-len(body) // 600))
    got = {(r.row, r.col): r.value for r in df.collect()}
    assert len(got) == a.size and all(got[i] == (None if v == -9999 else v) for i, v in np.ndenumerate(a))
    g = files.read_esri(spark, str(tmp_path), lambda v: v / 2)
    assert (array(g.df, a.shape) == np.where(a == -9999, -9999, np.floor(a / 2 + 0.5))).all()
    assert g.meta == GridMeta(40, 31, -9999, 50.0, -100.0, 0.5, 0.5)


def test_no_data_is_a_text_and_short_files_fail(spark, tmp_path):
    (tmp_path / "g.asc").write_text(HEADER.format(r=1, c=3) + "1 -9999 -9999.0\n")
    assert [r.value for r in files.read_esri(spark, str(tmp_path / "g.asc")).df.orderBy("col").collect()] == [1, -9999, -9999]
    esri.register(spark)
    assert [r.value for r in spark.read.format("esri").load(str(tmp_path / "g.asc")).orderBy("col").collect()] == [1.0, None, -9999.0]
    (tmp_path / "short.asc.gz").write_bytes(gzip.compress((HEADER.format(r=2, c=3) + "1 2 3 4\n").encode()))
    with pytest.raises(Exception, match="4 of 6 values"):
        files.read_esri(spark, str(tmp_path / "short.asc.gz")).df.count()


def test_many_grids(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"g{k}.{'asc' if k < 3 else 'txt'}").write_text(text(np.full((2, k), k * 10)))
    cells, metas = files.read_esri_all(spark, str(tmp_path), "*.asc")
    got = {(r.grid.rsplit("/", 1)[1], r.n, r.v) for r in cells.groupBy("grid").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()}
    assert got == {("g1.asc", 2, 10), ("g2.asc", 4, 20)} and sorted(m.ncols for m in metas.values()) == [1, 2]


def test_writer_joins_ranges_of_rows(spark, tmp_path):
    a = np.arange(600).reshape(50, 12)
    a[7, 7] = -9999
    g = grid(spark, a)
    files.write_esri(Grid(g.df.repartition(6), g.meta), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["grid.asc.gz"]
    assert gzip.open(tmp_path / "out/grid.asc.gz").read().decode().split("\n")[6:-1] == [" ".join(map(str, line)) for line in a.tolist()]
    assert (array(files.read_esri(spark, str(tmp_path / "out")).df, a.shape) == a).all()
    with pytest.raises(Exception, match="out"):
        files.write_esri(g, str(tmp_path / "out"))


def test_a_grid_of_many_cells_is_read_in_many_tasks(spark, tmp_path):
    n = 2000
    line = " ".join(str(i % 97) for i in range(n)) + "\n"
    p = tmp_path / "big.asc"
    p.write_text(HEADER.format(r=n, c=n) + line * n)
    esri.register(spark)
    began = time.time()
    df = spark.read.format("esri").option("splitBytes", 2 << 20).load(str(p))
    assert df.rdd.getNumPartitions() == -(-p.stat().st_size // (2 << 20)) > 4
    row = df.agg(F.count("*"), F.sum("value"), F.sum(F.col("row").cast("long") * F.col("value"))).first()
    one = sum(i % 97 for i in range(n))
    assert tuple(row) == (n * n, one * n, one * n * (n - 1) / 2) and time.time() - began < 120


def test_sources_of_their_own_scale(spark, tmp_path):
    (tmp_path / "g.asc").write_text(HEADER.format(r=1, c=5) + "0 1 63 12600 -9999\n")
    at = lambda g: [r.value for r in g.df.orderBy("col").collect()]
    assert at(files.population(spark, str(tmp_path))) == [0, 0, 0, 13, -9999]
    assert at(files.population(spark, str(tmp_path), log=True)) == [0, 0, 180, 410, -9999]
    assert at(files.night_lights(spark, str(tmp_path))) == [0, 2, 100, 20000, -9999]


def test_tables_of_numbers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("Pop light\n1.5 20\n\n 3 4 5\n")
    assert [tuple(r) for r in files.read_numbers(spark, str(tmp_path / "t.txt"), ["pop", "light"], header=True).orderBy("pop").collect()] == [(1.5, 20.0), (3.0, 4.0)]
    df = spark.createDataFrame([(k, k + 1, (k * 7) % 5) for k in range(40)], "lo int, hi int, n int").repartition(5)
    files.write_numbers(df, str(tmp_path / "hist"), ["lo"])
    lines = [x for p in sorted((tmp_path / "hist").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [f"{k} {k + 1} {(k * 7) % 5}" for k in range(40)]


def test_assignment_matrix(spark, tmp_path):
    cost = spark.createDataFrame([(1, 2, 193.7), (2, 1, 8.0), (2, 3, 40.0)], "i int, j int, cost double")
    files.write_assignment(cost, spark.createDataFrame([(1, 2), (2, 1)], "i int, j int"), str(tmp_path / "m"), 3)
    lines = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [r"10000  & 193*  & 10000 \\", r"8*  & 10000  & 40 \\"]


def test_grid_of_a_table_there_and_back(spark, tmp_path):
    g = g1g(spark, "/root/testdata/sf0.001")
    files.write_esri(g, str(tmp_path / "g1g"))
    back = files.read_esri(spark, str(tmp_path / "g1g"))
    assert back.df.exceptAll(g.df).isEmpty() and back.df.count() == 48 * 64

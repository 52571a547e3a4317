"""ESRI ASCII grids as a Spark data source: ``spark.read.format("esri")`` after ``register(spark)``.

A plain file is cut into byte ranges that are read in parallel; a gzip one is one stream, parsed piece by piece. Before that the numbers of each
range are counted, so that every task knows the cell it begins with; lines may wrap anywhere. A folder, with pathGlobFilter, is
many grids. Writing goes by ranges of rows in parallel; the parts are joined to one file when all of them are there.

Paths are local ones (shared, on a cluster) or URIs that pyarrow's file systems open.
"""

from __future__ import annotations

import fnmatch
import gzip
import posixpath
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.grid import GridMeta

#: Bytes of a plain file that a task reads, and bytes that are parsed at once.
SPLIT = 32 << 20
PIECE = 1 << 20
HEAD = 12  # tokens: six names with their values, by position
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def place(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def grids_at(path: str, pattern: str | None = None) -> list[str]:
    """The file at path, or the files of a folder whose names match pattern, in order; names that begin with _ or . are none."""
    fs, at = place(path)
    found = fs.get_file_info(at)
    if found.type == pafs.FileType.File:
        return [path]
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File)
    return [posixpath.join(path, x) for x in names if x[0] not in "._" and (not pattern or fnmatch.fnmatch(x, pattern))]


def _bytes(path: str, lo: int = 0) -> Iterator[bytes]:
    """The file from byte lo on, in pieces; gzip by its suffix, from the start only."""
    fs, at = place(path)
    with fs.open_input_file(at) as raw:
        if path.endswith(".gz"):
            with gzip.GzipFile(fileobj=raw) as f:
                while piece := f.read(PIECE):
                    yield piece
        else:
            raw.seek(lo)
            while piece := raw.read(PIECE):
                yield piece


def header(path: str) -> tuple[GridMeta, str]:
    """Shape and place of a grid, and the text that marks missing values; the six lines are read by position."""
    text = b""
    for piece in _bytes(path):
        text += piece
        if len(text.split(None, HEAD)) > HEAD:
            break
    t = text.split(None, HEAD)
    if len(t) < HEAD:
        raise ValueError(f"{path} has no header of six lines")
    nc, nr, x, y, res, nodata = (t[i].decode() for i in range(1, HEAD, 2))
    return GridMeta(int(nr), int(nc), int(float(nodata)), float(y) + float(res) * int(nr), float(x), float(res), float(res)), nodata


def tokens(path: str, lo: int, hi: int) -> Iterator[bytes]:
    """Pieces of the tokens that begin in [lo, hi), none of them cut."""
    left, at, carry = hi - lo, lo, b""
    if lo:
        at, left = lo - 1, left + 1  # the byte before says whether a token begins at lo
    first = lo > 0
    for piece in _bytes(path, at):
        if first:
            first = False
            skip = 0
            while skip < len(piece) and not SPACE[piece[skip]]:
                skip += 1
            if skip == len(piece):
                first = True  # a token longer than a piece began before lo
            piece, left = piece[skip:], left - skip
        if left <= 0:
            if not carry:
                return
            end = next((i for i, c in enumerate(piece) if SPACE[c]), len(piece))
            carry += piece[:end]
            if end < len(piece):
                break
            continue
        own = carry + piece[:left]
        rest = piece[left:]
        left -= len(piece)
        cut = len(own)
        while cut and not SPACE[own[cut - 1]]:
            cut -= 1
        if cut:
            yield own[:cut]
        carry = own[cut:]
        if left <= 0 and carry and rest:
            end = next((i for i, c in enumerate(rest) if SPACE[c]), None)
            carry += rest if end is None else rest[:end]
            if end is not None:
                break
    if carry:
        yield carry


def count(path: str, lo: int, hi: int) -> int:
    """Tokens that begin in [lo, hi)."""
    n, before, left = 0, True, hi - lo
    if lo:
        lo, left, n = lo - 1, left + 1, None
    for piece in _bytes(path, lo):
        gap = SPACE[np.frombuffer(piece[:left], np.uint8)]
        begins = ~gap & np.concatenate(([before], gap[:-1]))
        if n is None:
            begins[0], n = False, 0
        n += int(begins.sum())
        before = bool(gap[-1])
        left -= len(piece)
        if left <= 0:
            break
    return n or 0


@dataclass
class _Range(InputPartition):
    path: str
    lo: int
    hi: int
    skip: int  # tokens of this file before lo


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("give the path of a grid or of a folder of grids")
        self.pattern = options.get("pathglobfilter", options.get("pathGlobFilter"))
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))

    def partitions(self):
        out = []
        for path in grids_at(self.path, self.pattern):
            meta, _ = header(path)
            fs, at = place(path)
            size = 1 << 62 if path.endswith(".gz") else fs.get_file_info(at).size
            cuts = [0, 1 << 62] if path.endswith(".gz") else [*range(0, max(1, size), self.split), size]
            seen = 0
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                out.append(_Range(path, lo, hi, seen))
                if len(cuts) > 2:  # one range needs no count: its reader finds out
                    seen += count(path, lo, hi)
            if len(cuts) > 2 and seen - HEAD < meta.nrows * meta.ncols:
                raise ValueError(f"{path} has {seen - HEAD} of {meta.nrows * meta.ncols} values")
        return out

    def read(self, part: _Range):
        meta, nodata = header(part.path)
        total, at = meta.nrows * meta.ncols, part.skip - HEAD
        drop = HEAD if part.lo == 0 else 0
        for text in tokens(part.path, part.lo, part.hi):
            if drop:
                parts = text.split(None, drop)
                if len(parts) < drop:
                    drop -= len(parts)
                    at += len(parts)
                    continue
                text, at, drop = parts[drop] if len(parts) > drop else b"", at + drop, 0
            if at >= total:
                break
            words = text.split()
            if not words:
                continue
            v = np.array(words[: total - at], np.bytes_).astype(float)
            missing = np.array([w == nodata.encode() for w in words[: len(v)]]) if (v == float(nodata)).any() else np.zeros(len(v), bool)
            i = np.arange(at, at + len(v))
            at += len(v)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(v)), pa.array((i // meta.ncols).astype(np.int32)), pa.array((i % meta.ncols).astype(np.int32)), pa.array(v, mask=missing)], ["grid", "row", "col", "value"])
        if part.path.endswith(".gz") and at < total:
            raise ValueError(f"{part.path} has {max(at, 0)} of {total} values")


@dataclass
class _Part(WriterCommitMessage):
    path: str
    first: int


class _Writer(DataSourceArrowWriter):
    """Rows (row, col, value) that come sorted, partitions in order; null values are missing."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.meta = GridMeta(*(int(options[k]) for k in ("nrows", "ncols", "missing")), *(float(options[k]) for k in ("nw_lat", "nw_lon", "lat_res")), float(options["lat_res"]))
        self.file = posixpath.join(self.path, "grid.asc.gz")
        fs, at = place(self.path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            if not overwrite:
                raise FileExistsError(self.path)
            fs.delete_dir(at)

    def write(self, batches):
        fs, at = place(self.path)
        context = TaskContext.get()
        fs.create_dir(f"{at}/_parts", recursive=True)
        name = f"{at}/_parts/{context.partitionId()}-{context.taskAttemptId()}"
        first, rest_row, rest = None, None, []
        with fs.open_output_stream(name) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as f:
            for batch in batches:
                row, value = batch.column(0).to_numpy(), batch.column(2).fill_null(self.meta.missing).to_pylist()
                if not len(row):
                    continue
                first = int(row[0]) if first is None else first
                cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if row[a] != rest_row:
                        if rest:
                            f.write((" ".join(map(str, rest)) + "\n").encode())
                        rest_row, rest = row[a], []
                    rest += value[a:b]
            if rest:
                f.write((" ".join(map(str, rest)) + "\n").encode())
        return _Part(name, -1 if first is None else first)

    def commit(self, messages):
        fs, at = place(self.path)
        m = self.meta
        head = [("ncols", m.ncols), ("nrows", m.nrows), ("xllcorner", m.nw_lon), ("yllcorner", m.nw_lat - m.lat_res * m.nrows), ("cellsize", m.lat_res), ("NODATA_value", m.missing)]
        with fs.open_output_stream(f"{at}/_grid") as out:  # gzip members one after another are one gzip file
            out.write(gzip.compress("".join(f"{k} {v}\n" for k, v in head).encode(), mtime=0))
            for part in sorted((x for x in messages if x and x.first >= 0), key=lambda x: x.first):
                with fs.open_input_stream(part.path) as raw:
                    shutil.copyfileobj(raw, out, PIECE)
        fs.move(f"{at}/_grid", f"{at}/grid.asc.gz")
        fs.delete_dir(f"{at}/_parts")

    def abort(self, messages):
        fs, at = place(self.path)
        if fs.get_file_info(f"{at}/_parts").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{at}/_parts")


class EsriSource(DataSource):
    """grid (its path), row, col and value (null where missing) of ESRI ASCII grids."""

    @classmethod
    def name(cls):
        return "esri"

    def schema(self):
        return "grid string, row int, col int, value double"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        if [f.name for f in schema.fields] != ["row", "col", "value"]:
            raise ValueError("a grid is written from row, col and value")
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EsriSource)

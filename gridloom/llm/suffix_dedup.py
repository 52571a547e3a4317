"""Removal of every byte that lies in a 200-byte string which occurs twice, by sorting hashes of suffixes' first bytes.

Suffixes matter here by their first W bytes only. Hashes of these are sorted one bucket at a time (so there is no order of suffixes),
and a difference cover decides beforehand which suffixes can tie at all:

1. D is a difference cover modulo V: any two positions i, j have a d < V with both i + d and j + d in the cover. The
   cover sample of all texts is ranked by its next W - V + 1 bytes, bucket by bucket. If the W bytes at i and j are equal, so are those
   ranks at i + d and j + d; a start without a repeated sample in its next V positions therefore ties with none.
2. The remaining suffixes are ranked by their W bytes in PASSES ranges of the key, one after the other, each dealt to
   buckets that are sorted one at a time. Ties mark starts of repeated strings.

Ranks are 62-bit fingerprints. A block of texts sends each rank once, with a bit for "more than once here", so a rank that
very many positions share costs one entry a block. Answers are a bit for each entry sent. Texts over SEGMENT bytes are cut into
segments that overlap by W - 1 bytes; each start belongs to one.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._bytes import between, blob, column, prefix_hash, windows
from gridloom.llm._exchange import block_ids, cuts, n_buckets
from gridloom.llm._work import Workspace, text_bytes

W = 200
SEGMENT = 1 << 20
PASSES = 4


def difference_cover(q: int) -> list[int]:
    """A perfect difference set modulo v = q*q + q + 1 for a prime q: the zeros of a linear recurrence of order 3 modulo q."""
    v = q * q + q + 1
    for a, b, c in itertools.product(range(q), range(q), range(1, q)):
        s = [0, 0, 1]
        while len(s) < v:
            s.append((a * s[-1] + b * s[-2] + c * s[-3]) % q)
        zeros = [i for i, x in enumerate(s) if x == 0]
        if len(zeros) == q + 1 and len({(x - y) % v for x in zeros for y in zeros}) == v:
            return zeros
    raise ValueError(f"no difference set for {q}")


@functools.cache
def cover_for(w: int) -> tuple[int, list[int]]:
    """The largest cover that leaves at least a third of the window to rank."""
    q = max((q for q in (2, 3, 5, 7, 11) if 3 * (q * q + q + 1) <= 2 * w), default=0)
    return (q * q + q + 1, difference_cover(q)) if q else (1, [0])


def _store(w: int):
    """Blocks of texts: row numbers, ids, start, own length and full length of each segment, and the bytes of all."""

    def run(batches):
        ids, rows = block_ids(), 0
        for batch in batches:
            data, offsets = column(batch.column(1))
            doc = batch.column(0)
            pack, size = [], 0
            for i in range(len(doc)):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                for s in range(lo, max(hi, lo + 1), SEGMENT):
                    e = min(hi, s + SEGMENT)
                    piece = data[s : min(hi, e + w - 1)]
                    pack.append((i, s - lo, e - s, hi - lo, piece))
                    size += len(piece)
                    if size >= 2 * SEGMENT:
                        yield _packed(next(ids), pack, doc, rows)
                        pack, size = [], 0
            if pack:
                yield _packed(next(ids), pack, doc, rows)
            rows += len(doc)

    return run


BLOCK = "block long, doc_id array<long>, row array<long>, start array<long>, own array<long>, whole array<long>, data array<binary>"


def _packed(block: int, pack: list, doc: pa.Array, rows: int) -> pa.RecordBatch:
    part = block >> 31 << 31
    cols = [[doc[i].as_py() for i, *_ in pack], [part + rows + i for i, *_ in pack], *([x[k] for x in pack] for k in (1, 2, 3))]
    return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x], pa.list_(pa.int64())) for x in cols), pa.array([[blob(x[4]) for x in pack]], pa.list_(pa.binary()))], ["block", "doc_id", "row", "start", "own", "whole", "data"])


def _rows(batches):
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(keys, return_counts=True)
    return keys, n > 1


def _send(block: int, keys: np.ndarray, n: int) -> pa.RecordBatch:
    keys, many = _unique(keys)
    rows = list(cuts(keys, n))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([blob(keys[i:j]) for _, i, j in rows], pa.binary()), pa.array([blob(np.packbits(many[i:j])) for _, i, j in rows], pa.binary())], ["bucket", "block", "keys", "many"])


SENT = "bucket long, block long, keys binary, many binary"


def _ties(table: pa.Table) -> pa.Table:
    """Sort one bucket; a bit for each entry of each block that tells whether its rank occurs more than once."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(keys))
    tied = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for x, many in zip(keys, table.column("many").to_pylist(), strict=True):
        bits = np.unpackbits(np.frombuffer(many, np.uint8), count=len(x)).astype(bool)
        if len(tied):
            bits |= tied[np.minimum(np.searchsorted(tied, x), len(tied) - 1)] == x
        out.append(blob(np.packbits(bits)) if bits.any() else None)
    got = pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "bits": pa.array(out, pa.binary())})
    return got.filter(pc.is_valid(got.column("bits")))


def _tied_keys(keys: np.ndarray, answers: list, n: int) -> np.ndarray:
    """Which of the sorted unique keys the buckets call tied."""
    out, by = np.zeros(len(keys), bool), {a["bucket"]: a["bits"] for a in answers}
    for b, i, j in cuts(keys, n):
        if (bits := by.get(b)) is not None:
            out[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i)
    return out


def _split(flags: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum([len(x) for x in parts])[:-1])


def _sample(r: dict, v: int, cover: list[int], m: int):
    """Ranks of the block's cover sample, with the segment and position of each."""
    at, keys = [], []
    residues = np.zeros(v, bool)
    residues[cover] = True
    for k, raw in enumerate(r["data"]):
        data = np.frombuffer(raw, np.uint8)
        last = min(r["own"][k], len(data) - m + 1)
        p = np.flatnonzero(residues[(r["start"][k] + np.arange(max(0, last))) % v])
        at.append(p)
        keys.append(between(prefix_hash(data), p, p + m) if len(p) else np.zeros(0, np.uint64))
    return at, keys


def _starts(r: dict, w: int):
    """Ranks of the starts that are left, piece by piece."""
    for k, raw in enumerate(r["data"]):
        data = np.frombuffer(raw, np.uint8)
        yield k, windows(prefix_hash(data), w)


def _pass_of(keys: np.ndarray, passes: int) -> np.ndarray:
    """The bits above the lowest 7, modulo passes; numpy divides by one number faster than it takes remainders."""
    x, p = keys >> np.uint64(7), np.uint64(passes)
    return (x - x // p * p).astype(np.uint8 if passes < 256 else np.int64)


def find(docs: DataFrame, w: int = W, passes: int = PASSES) -> tuple[Workspace, DataFrame, DataFrame, int]:
    """(workspace, blocks of texts, runs of removed bytes, bytes); runs: block, segment and array of start, end in the text."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffixes")
    v, cover = cover_for(w)
    m = w - v + 1
    blocks = ws.table("blocks", docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_store(w), BLOCK), wide=True)
    size = text_bytes(docs)
    n = n_buckets(spark, 8 * size * len(cover) / v)

    def send_sample(batches, n=n):
        for r in _rows(batches):
            yield _send(r["block"], np.concatenate(_sample(r, v, cover, m)[1]), n)

    ranks = ws.table("ranks", blocks.mapInArrow(send_sample, SENT).groupBy("bucket").applyInArrow(_ties, "bucket long, block long, bits binary"))
    answers = ranks.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))

    def candidates(batches, n=n):
        """The pieces of text around starts that can tie; start and whole tell where a piece stands, own how many starts it has."""
        for r in _rows(batches):
            if not r["answers"] and all(a + b >= c for a, b, c in zip(r["start"], r["own"], r["whole"], strict=True)):
                continue
            at, keys = _sample(r, v, cover, m)
            every, code = np.unique(np.concatenate(keys), return_inverse=True)
            tied = _tied_keys(every, r["answers"] or [], n)[code]
            pieces = []
            for k, (p, own) in enumerate(zip(at, _split(tied, keys), strict=True)):
                data, last = r["data"][k], min(r["own"][k], len(r["data"][k]) - w + 1)
                if last < 1:
                    continue
                hit = p[own]
                mark = np.zeros(len(data) + 2, np.int32)
                np.add.at(mark, np.maximum(0, hit - v + 1), 1)
                np.add.at(mark, hit + 1, -1)
                ok = np.cumsum(mark)[:last] > 0
                if r["start"][k] + r["own"][k] < r["whole"][k]:
                    ok[max(0, r["own"][k] - v) :] = True  # their samples stand in the next segment
                edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
                pieces += [(k, a, b - a, data[a : b + w - 1]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), *(pa.array([[x[c] for x in pieces]], pa.list_(pa.int64())) for c in (0, 1, 2)), pa.array([[x[3] for x in pieces]], pa.list_(pa.binary()))], ["block", "segment", "start", "own", "data"])

    left = ws.table("left", blocks.join(answers, "block", "left").mapInArrow(candidates, "block long, segment array<long>, start array<long>, own array<long>, data array<binary>"), wide=True)
    ws.drop("ranks")
    starts = int(left.agg(F.sum(F.expr("aggregate(own, 0L, (a, x) -> a + x)"))).first()[0] or 0)
    n2 = n_buckets(spark, 8 * starts / passes)
    bits = None
    for k in range(passes):

        def send(batches, k=k):
            for r in _rows(batches):
                got = [x[_pass_of(x, passes) == k] for _, x in _starts(r, w)]
                yield _send(r["block"], np.concatenate(got), n2)

        one = ws.table(f"pass{k}", left.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(_ties, "bucket long, block long, bits binary"))
        one = one.withColumn("pass", F.lit(k))
        bits = one if bits is None else bits.unionAll(one)
        ws.drop()

    def runs(batches):
        for r in _rows(batches):
            each = list(_starts(r, w))
            every = np.concatenate([x for _, x in each])
            flags = np.zeros(len(every), bool)
            own_pass = _pass_of(every, passes)
            for k in range(passes):
                at = np.flatnonzero(own_pass == k)
                keys, code = np.unique(every[at], return_inverse=True)
                flags[at] = _tied_keys(keys, [a for a in r["answers"] if a["pass"] == k], n2)[code]
            flags, found = _split(flags, [x for _, x in each]), {}
            for (i, _), own in zip(each, flags, strict=True):
                p = r["start"][i] + np.flatnonzero(own)
                if len(p):
                    gap = np.flatnonzero(np.diff(p) > w)
                    found.setdefault(r["segment"][i], []).extend(zip(p[np.concatenate(([0], gap + 1))].tolist(), (p[np.concatenate((gap, [len(p) - 1]))] + w).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(found), pa.int64()), pa.array(list(found), pa.int64()), pa.array([_join(x) for x in found.values()], pa.list_(pa.int64()))], ["block", "segment", "runs"])

    answers = bits.groupBy("block").agg(F.collect_list(F.struct("pass", "bucket", "bits")).alias("answers"))
    got = ws.table("runs", left.join(answers, "block").mapInArrow(runs, "block long, segment long, runs array<long>"))
    ws.drop("left", *(f"pass{k}" for k in range(passes)))
    return ws, blocks, got, size


def _join(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _cut(raw: bytes, runs: list[int]) -> bytes:
    at = [0, *runs, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))


def remove_repeats(docs: DataFrame, w: int = W, passes: int = PASSES) -> DataFrame:
    """doc_id, row (one number for each input row), n_bytes, runs (removed: start, end, ...) and kept bytes of every row of docs.

    A byte goes if it lies in a string of w bytes that also starts anywhere else; both copies go. Strings don't cross
    documents. A null text is empty; null and repeated ids stay as they are.
    """
    ws, blocks, runs, _ = find(docs, w, passes)
    per = runs.groupBy("block").agg(F.collect_list(F.struct("segment", "runs")).alias("found"))

    def finish(batches):
        for r in _rows(batches):
            found = {x["segment"]: x["runs"] for x in r["found"] or ()}
            out = []
            for k, raw in enumerate(r["data"]):
                own, whole = r["own"][k], r["whole"][k]
                spans = found.get(k, [])
                out.append((r["doc_id"][k], r["row"][k], whole, r["start"][k], spans, _cut(raw, spans) if own == whole else raw[:own]))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], ["doc_id", "row", "n_bytes", "start", "runs", "kept"])

    def assemble(table: pa.Table) -> pa.Table:
        """A text of several segments, put together again."""
        rows = sorted(table.to_pylist(), key=lambda x: x["start"])
        spans = _join([(x["start"] + a, x["start"] + b) for x in rows for a, b in zip(x["runs"][::2], x["runs"][1::2], strict=True)])
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "row": [rows[0]["row"]], "n_bytes": [rows[0]["n_bytes"]], "runs": pa.array([spans], pa.list_(pa.int64())), "kept": [_cut(b"".join(x["kept"] for x in rows), spans)]})

    one = ws.table("segments", blocks.join(per, "block", "left").mapInArrow(finish, "doc_id long, row long, n_bytes long, start long, runs array<long>, kept binary"), wide=True)
    ws.drop("blocks", "runs")
    parts = one.where(F.col("n_bytes") > SEGMENT).groupBy("row").applyInArrow(assemble, "doc_id long, row long, n_bytes long, runs array<long>, kept binary")
    return one.where(F.col("n_bytes") <= SEGMENT).drop("start").unionAll(parts)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("runs") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

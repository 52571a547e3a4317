"""Benchmark decontamination: a broadcast hash set of test n-grams, windows of the training text, verified hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._bytes import ALNUM, LOWER, column, groups, rolling, words
from gridloom.llm._work import Workspace

N = 10
#: Windows in one broadcast set: 8 bytes a hash and about 100 of words each, so some 100 MB at most.
MAX_WINDOWS = 1_000_000
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]


def _texts(lower: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[bytes]:
    raw = lower.tobytes()
    return [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]


class Windows:
    """The n-grams of some items, by length: sorted hashes, and for each the words and the items that hold them."""

    def __init__(self, n: int, rows: list[tuple[str, str]]):
        self.by: dict[int, tuple] = {}
        found: dict[int, dict] = {}
        for item, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            s, e, h, _ = words(data, np.array([0, len(data)]), ALNUM)
            if len(h):
                k, w = min(n, len(h)), _texts(LOWER[data], s, e)
                for i, x in enumerate(rolling(h, k).tolist()):
                    found.setdefault(k, {}).setdefault(x, {}).setdefault(b" ".join(w[i : i + k]), set()).add(item)
        for k, at in found.items():
            keys = np.array(sorted(at), np.uint64)
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            self.by[k] = keys, bits, at

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """n_words, hit word runs (start, end, ...) and item ids of each document."""
        lower = LOWER[data]
        s, e, h, first = words(data, offsets, ALNUM)
        hits: dict[int, tuple[list, set]] = {}
        for k, (keys, bits, at) in self.by.items():
            r = rolling(h, k)
            i = np.flatnonzero(bits[r >> np.uint64(44)])
            i = i[np.isin(r[i], keys)]
            doc = np.searchsorted(first, i, "right") - 1
            inside = i + k <= first[doc + 1]
            for p, d in zip(i[inside].tolist(), doc[inside].tolist(), strict=True):
                own = b" ".join(lower[a:b].tobytes() for a, b in zip(s[p : p + k].tolist(), e[p : p + k].tolist(), strict=True))
                if items := at[int(r[p])].get(own):  # verified word by word
                    spans, seen = hits.setdefault(d, ([], set()))
                    spans.append((p - int(first[d]), p - int(first[d]) + k))
                    seen.update(items)
        for d, n in enumerate(np.diff(first).tolist()):
            spans, seen = hits.get(d, ([], set()))
            yield n, _merged(spans), seen


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


#: Words of a long item that stand in one piece of it.
PIECE = 20_000


def _pieces(n: int, most: int):
    """Items in pieces of so many words, which overlap by n - 1 words, so that each window stands in one of them at least."""

    def run(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for item, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                s, e, _, _ = words(data, np.array([0, len(data)]), ALNUM)
                for a in range(0, max(1, len(s) - n + 1), most):
                    b = min(len(s), a + most + n - 1)
                    if b > a:
                        out.append((item, data[s[a] : e[b - 1]].tobytes().decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["item_id", "text"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Documents with n_words, spans (runs of hit words: start, end, start, end, ...) and items (sorted ids).

    A window is n consecutive words of an item, or all words of a shorter one. An item without words has none,
    and a null text no words. Items without an id go by the empty one. The set is broadcast up to max_windows windows; a larger benchmark goes by in slices of
    that size, each a pass over the documents. Other columns stay, whatever their names but these three.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    bench = bench.mapInArrow(_pieces(n, PIECE), "item_id string, text string").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # no more windows than bytes
    slices = max(1, -(-total // max_windows))
    docs = docs.drop("n_words", "spans", "items")
    cols = docs.columns
    cur, ws = docs.withColumn("spans", F.array().cast("array<int>")).withColumn("items", F.array().cast("array<string>")), None
    schema = T.StructType([*docs.schema.fields, *FOUND])
    for k in range(slices):
        rows = [(r.item_id, r.text) for r in (bench if slices == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)).toLocalIterator()]
        shared = spark.sparkContext.broadcast(Windows(n, rows))

        def scan(batches, shared=shared):
            index = shared.value
            for whole in batches:
                data, offsets = column(whole.column(whole.schema.get_field_index("text")))
                for a, b in groups(offsets, 1 << 20):
                    batch = whole.slice(a, b - a)
                    had = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("spans", "items")), strict=True)
                    got = [(m, _merged([*_pairs(spans), *_pairs(old)]), sorted({*items, *seen})) for (m, spans, items), (old, seen) in zip(index.scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), had, strict=True)]
                    made = [pa.array(list(x), kind) for x, kind in zip(zip(*got, strict=True), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in cols), *made], [*cols, "n_words", "spans", "items"])

        cur = cur.mapInArrow(scan, schema)
        if k + 1 < slices:
            ws = ws or Workspace(spark, "decontaminate")
            cur = ws.table(f"slice{k}", cur)
    return cur


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, mode: str = "documents") -> DataFrame:
    """Remove documents that hold a benchmark n-gram, or (mode "spans") only the words of its occurrences.

    Removing a span takes the bytes from its first to its last word; a null text stays null. Columns stay as they are, whatever their names.
    """
    # the row travels as one column, so that its names clash with none of find()'s
    found = find(docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), benchmark, n)
    if mode == "documents":
        return found.where(F.size("spans") == 0).select("row.*")

    def cut(batches):
        for batch in batches:
            texts, out = batch.column(0).to_pylist(), []
            for text, spans in zip(texts, batch.column(2).to_pylist(), strict=True):
                if text and spans:
                    raw = text.encode()
                    data = np.frombuffer(raw, np.uint8)
                    s, e, _, _ = words(data, np.array([0, len(data)]), ALNUM)
                    keep, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        keep.append(raw[at : s[a]])
                        at = int(e[b - 1])
                    text = (b"".join(keep) + raw[at:]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], ["text", "row"])

    done = found.select("text", "row", "spans").mapInArrow(cut, T.StructType([found.schema["text"], found.schema["row"]]))
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words hit, items and a digest of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = "aggregate(sequence(0, cast(size(spans) / 2 as int) - 1), 0L, (n, i) -> n + spans[2 * i + 1] - spans[2 * i])"
    return found.select(
        "doc_id", "n_words", F.expr(f"if(size(spans) = 0, 0L, {hit})").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )

"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._bytes import LOWER, column, groups, mix
from gridloom.llm._work import release

BITS = 15
DIM = 16
GRAMS = (2, 3, 4)
#: The model is fitted on at most so many labelled rows, drawn by hash of text. Whole texts count; the driver gets their distinct grams only.
SAMPLE_ROWS = 4000
#: Share of well-predicted calibration rows that the threshold may reject, and the highest threshold.
REJECT_SHARE, REJECT_BELOW = 0.002, 0.5

_LETTER = LOWER.copy()
_LETTER[:97] = 32
_LETTER[65:91] = LOWER[65:91]
_LETTER[123:128] = 32


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each length of gram: hashed ids of the byte grams of letters and word ends, where each text's ids begin, and where each gram does.

    Grams keep to one text; whatever isn't a letter counts as a space, and grams of spaces alone are none.
    """
    x = _LETTER[data].astype(np.uint64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for n in GRAMS:
        m = max(0, len(x) - n + 1)
        h, blank = np.zeros(m, np.uint64), np.ones(m, bool)
        for j in range(n):
            h = h * np.uint64(257) + x[j : j + m]
            blank &= x[j : j + m] == 32
        at = np.flatnonzero(~blank & (np.arange(m) + n <= ends[:m]))
        yield (mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(at, offsets), at


SLICE = 1 << 18


def slices(data: np.ndarray, offsets: np.ndarray, a: int, b: int):
    """subwords() of the texts a..b in slices of bounded size, each gram once: (ids, where each text's ids begin)."""
    lo, hi, longest = int(offsets[a]), int(offsets[b]), GRAMS[-1] - 1
    for s in range(lo, max(hi, lo + 1), SLICE):
        e = min(hi, s + SLICE + longest)
        for n, (ids, at, place) in zip(GRAMS, subwords(data[s:e], np.clip(offsets[a : b + 1] - s, 0, e - s)), strict=True):
            if e < hi or s + SLICE < e:  # grams that begin in the overlap belong to the next slice
                own = place < SLICE
                at = np.searchsorted(np.flatnonzero(own), at) if not own.all() else at
                ids = ids[own]
            yield ids, at


def sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the grams of a text, and how often each occurs, in 16 bits (of a very long text in proportion)."""
    data = np.frombuffer(text.encode(), np.uint8)
    total = np.zeros(1 << BITS, np.int64)
    for ids, _ in slices(data, np.array([0, len(data)]), 0, 1):
        total += np.bincount(ids, minlength=len(total))
    ids = np.flatnonzero(total)
    return ids.astype(np.uint16), np.ceil(total[ids] / max(1.0, total.max(initial=0) / 65535)).astype(np.uint16)


class Model:
    """class names, per-bucket class scores (embedding times softmax weights), bias, temperature and threshold; rows: a text or its sparse(), and lang."""

    def __init__(self, rows: list[tuple], epochs: int = 12, rate: float = 4.0, seed: int = 1):
        self.names = sorted({lang for _, lang in rows})
        k = len(self.names)
        self.scores, self.bias = np.zeros((1 << BITS, max(1, k)), np.float32), np.zeros(max(1, k), np.float32)
        self.temperature, self.threshold = 1.0, 0.0
        if k < 2:
            return
        y = np.array([self.names.index(lang) for _, lang in rows])
        x = [sparse(text) if isinstance(text, str) else text for text, _ in rows]
        share = lambda i: (x[i][1] / max(1, x[i][1].sum(dtype=np.int64))).astype(np.float32)
        held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)
        fit = np.flatnonzero(~held)
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
        w, b = rng.normal(0, 0.1, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for part in np.array_split(rng.permutation(fit), -(-len(fit) // 32)):
                ids, val = np.concatenate([x[i][0] for i in part]), np.concatenate([share(i) for i in part])
                at = np.cumsum([0, *(len(x[i][0]) for i in part)])[:-1]
                h = np.add.reduceat(e[ids] * val[:, None], at, axis=0) if len(ids) else np.zeros((len(part), DIM), np.float32)
                g = _softmax(h @ w + b)
                g[np.arange(len(part)), y[part]] -= 1
                g /= len(part)
                gh = g @ w.T
                w -= step * h.T @ g
                b -= step * g.sum(0)
                own = np.repeat(np.arange(len(part)), np.diff([*at, len(ids)]))
                # rows of a batch share buckets; the embedding step is larger, as each gram is a small part of its text
                np.add.at(e, ids, -step * 8 * val[:, None] * gh[own])
        known = np.zeros(1 << BITS, bool)
        for i in fit:
            known[x[i][0]] = True
        self.scores, self.bias = np.where(known[:, None], e @ w, 0).astype(np.float32), b
        cal = np.flatnonzero(held) if held.any() else fit
        logits = np.array([(self.scores[x[i][0]] * share(i)[:, None]).sum(0) + b for i in cal])
        grid = np.geomspace(0.05, 20, 60)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(cal)), y[cal]] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / self.temperature)
        right = p.max(1)[p.argmax(1) == y[cal]]
        self.threshold = float(min(REJECT_BELOW, np.quantile(right, REJECT_SHARE))) if len(right) else 0.0

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of each text; whole texts, in slices of bounded size."""
        n, k = len(offsets) - 1, self.scores.shape[1]
        total, count = np.zeros((n, k)), np.zeros(n)
        for a, b in groups(offsets, SLICE):
            for ids, at in slices(data, offsets, a, b):
                add = np.zeros((len(ids) + 1, k))
                np.cumsum(self.scores[ids], axis=0, out=add[1:])
                total[a:b] += add[at[1:]] - add[at[:-1]]
                count[a:b] += np.diff(at)
        return _softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """At most so many rows, by hash of the columns given: a share of the rows is drawn, so no task sends more than its part."""
    share = min(1.0, 0.9 * most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(*by), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))).limit(most)


def features_of(rows: DataFrame, one, *others: str) -> list:
    """Rows of a bounded sample as (hash of text, one's ids and counts (16 bits) of the whole text, others), worked out where the texts are."""
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("weights", T.BinaryType()), *(rows.schema[c] for c in others)])

    def run(batches):
        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                ids, weights = one(text.as_py())
                key = hashlib.blake2b(text.as_py().encode(), digest_size=16).hexdigest()
                made = [pa.array([key]), pa.array([ids.astype(np.uint16).tobytes()]), pa.array([weights.astype(np.uint16).tobytes()])]
                yield pa.RecordBatch.from_arrays([*made, *(batch.column(1 + j).slice(i, 1) for j in range(len(others)))], ["key", "ids", "weights", *others])

    got = rows.select(F.col("text").cast("string").alias("text"), *others).mapInArrow(run, schema).toLocalIterator()
    return [(r.key, (np.frombuffer(r.ids, np.uint16), np.frombuffer(r.weights, np.uint16)), *(r[c] for c in others)) for r in got]


def fit(labelled: DataFrame) -> Model:
    """From rows (text, lang), told apart by doc_id if there is one: a bounded sample, the same whatever their order."""
    rows = labelled.where("text is not null and lang is not null")
    rows = sample(rows, SAMPLE_ROWS, "text", "lang", *(["doc_id"] if "doc_id" in labelled.columns else []))
    model = Model([(x, lang) for _, x, lang in sorted(features_of(rows, sparse, "lang"), key=lambda r: hash_key(r[0], r[2]))])
    release(labelled.sparkSession)
    return model


def hash_key(*values) -> bytes:
    """An order of rows that has nothing to do with their content or place."""
    return hashlib.blake2b("\0".join(map(str, values)).encode(), digest_size=16).digest()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (calibrated probability) and accepted.

    A null text, one without letters, and every text if nothing was learned: und, 0 and not accepted. Columns with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])

    def run(batches):
        m = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            p = m.predict(*column(col))
            best = p.argmax(1) if len(p) else []
            lang, score, ok = [], [], []
            for i, text in enumerate(col):
                if m.names and any(c.isalpha() for c in text.as_py() or ""):
                    lang.append(m.names[best[i]])
                    score.append(float(min(1.0, p[i, best[i]])))
                    ok.append(score[-1] >= m.threshold)
                else:
                    lang.append("und")
                    score.append(0.0)
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def held_out(of: int, is_: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == is_, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 modulo 3 isn't 1; a null doc_id counts as held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(3, 1)))
    return predict(docs.select("doc_id", "text", held_out(3, 1).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")

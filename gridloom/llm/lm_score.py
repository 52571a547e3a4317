"""Language-model scoring by logistic mixing of hashed-context bit predictors.

The model codes a text's bytes (A-Z as a-z), then an end mark, bit by bit. For each of five contexts (1 to 4 bytes, and the word so
far), a table of hashed slots counts zeros and ones; their logits are mixed by two sets of weights, one gated by how much the longest known
context has seen, one by the bit's place, and an adaptive probability map refines the sum.

Training counts first: tables of all tasks are summed. Weights and map are then learned online against the whole counts, where each occurrence is
predicted as if it had not been counted itself. Both go by blocks of about BLOCK bytes: a hash of the row picks its block and its place there, so a block is the
same however rows were dealt to tasks; one task goes once through a block and weights are averaged by bits seen, in the order of blocks. For scoring the model is frozen. So a
score is a function of the text and the set of training rows, not of partitions, the order of rows or lost tasks. The model has a fixed size.
Within a slice equal four-byte strings after equal word beginnings are evaluated once; counting leaves the distinct ones of each block, with how often they occur, for the
weights to learn from, so texts are read once for both.

Rows alike in all columns fall into one block, which is read as a stream. Each block of texts asks for the count of a token once, so a token
of every document costs one entry a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._bytes import LOWER, MIX, NONSPACE, blob, column, groups, mix, words
from gridloom.llm._exchange import block_ids, cuts, n_buckets
from gridloom.llm._work import Workspace, text_bytes

SLOT_BITS = (16, 19, 21, 22, 22)
K = len(SLOT_BITS)
#: Tables of so many tasks are summed in one, in as many rounds as it takes.
FAN = 32
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in SLOT_BITS])))
CHUNK = 1 << 16
#: Steps of how much a slot has seen, and these again for slots that saw but one value.
SURE = 6
GATES = 2 * SURE * K + 1
APM = 33
#: Grams are made of so many bytes at once, and evaluated for slices of more.
SLICE = 1 << 21
FIRST, TRAIN_SLICE = 1 << 21, 1 << 25
#: Bytes of training text in a block, and of texts that ask for counts together.
BLOCK, ASK = 1 << 26, 1 << 24
END = 255
RATE, FADE = 0.7, 0.1
STEP = 1 << 13
#: Grams are sent on to learn weights from so many in a row, a multiple of STEP.
ROW = 1 << 17
#: Weights are learned against counts in 256 levels: as they are below EXACT, then in steps of 5 %.
EXACT = 1 << 7
#: Logits are whole numbers of this part, and share an int32 with the slot's gate.
UNIT = 1 << 16
_LOG = np.round(np.log(np.arange(65536) + 0.4) * UNIT).astype(np.int32)
_LOGIT = np.log(np.arange(65536) + 0.4).astype(np.float32)
_SEEN = np.arange(2 * 65536, dtype=np.float64)
#: For each context the gate of a slot that has seen so much: 0 for nothing, then steps.
_GATE = [np.where(_SEEN > 0, 2 * SURE * k + 1 + np.minimum(SURE - 1, np.log2(np.maximum(1, _SEEN)) * 0.75).astype(int), 0).astype(np.int32) for k in range(K)]
_VALUE = np.concatenate((np.arange(EXACT), np.round(EXACT * (65536 / EXACT) ** ((np.arange(256 - EXACT) + 0.5) / (256 - EXACT))))).astype(np.int64)
_LEVEL = np.concatenate((np.arange(EXACT), EXACT + np.log(np.arange(EXACT, 65536) / EXACT) / np.log(65536 / EXACT) * (256 - EXACT))).astype(np.uint8)


def _without_one() -> tuple[np.ndarray, list[np.ndarray]]:
    """By bit, ones' level and zeros' level: the logit of a slot with one bit less, and for each context its gate. Beyond EXACT one is less than a step, and stays."""
    level = np.arange(1 << 16)
    zeros, ones = np.tile(_VALUE[level & 255], (2, 1)), np.tile(_VALUE[level >> 8], (2, 1))
    zeros[0] -= (zeros[0] > 0) & (zeros[0] < EXACT)
    ones[1] -= (ones[1] > 0) & (ones[1] < EXACT)
    gates = [(g[zeros + ones] + SURE * ((zeros == 0) ^ (ones == 0))).astype(np.uint8).ravel() for g in _GATE]
    return (_LOGIT[ones] - _LOGIT[zeros]).ravel(), gates


_LOGIT_WITHOUT, _GATE_WITHOUT = _without_one()


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark: itself, the four bytes before it in its text, and 24 bits for its word so far; and where each text begins."""
    n = len(offsets) - 1
    x = np.full(len(data) + n, END, np.uint8)
    at = offsets + np.arange(n + 1)
    keep = np.ones(len(x), bool)
    keep[at[1:] - 1] = False
    x[keep] = LOWER[data]
    here, first, long = np.arange(len(x), dtype=np.int32 if len(x) < 2**31 else np.int64), at[:-1], np.diff(at)
    padded = np.concatenate((np.zeros(K - 1, np.uint8), x))
    before = np.ndarray(len(x), ">u4", padded, strides=(1,)).astype(np.uint32)
    for j in range(K - 1):
        before[first[long > j] + j] &= np.uint32(256**j - 1)
    g = before.astype(np.uint64)
    g <<= np.uint64(8)
    g |= x
    begin = np.zeros_like(here)
    np.copyto(begin[1:], here[1:], where=~NONSPACE[x[:-1]])
    begin[first] = first
    begin = np.maximum.accumulate(begin)
    word = _beginnings(x, begin, here) >> np.uint32(8)
    word[begin == here] = 0
    g |= word.astype(np.uint64) << np.uint64(8 * K)
    return g, at


_POWERS: list[np.ndarray] = []
_TERM = (MIX >> np.uint64(24)).astype(np.uint32) | np.uint32(1)


def _beginnings(x: np.ndarray, begin: np.ndarray, here: np.ndarray) -> np.ndarray:
    """32 bits for each x[begin:here]. Contexts that they confuse do no harm, so they need not be as sound as _bytes.between()."""
    if not _POWERS or len(_POWERS[0]) <= len(x):
        _POWERS[:] = []
        for base in (0x9E3779B1, pow(0x9E3779B1, -1, 2**32)):
            p = np.full(max(len(x) + 1, 1 << 21), base, np.uint32)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p, dtype=np.uint32))
    h = np.zeros(len(x) + 1, np.uint32)
    np.cumsum(_TERM[x] * _POWERS[0][: len(x)], out=h[1:], dtype=np.uint32)
    h = (h[:-1] - h[begin]) * _POWERS[1][begin]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h ^= h >> np.uint32(shift)
        h *= np.uint32(factor)
    return h


class Model:
    """counts: zeros and ones of all slots; levels: the same in two bytes; state: each slot's logit and gate, which follow from counts; wa, wb: weights by gate and by bit; hits, ones: of the adaptive map."""

    def __init__(self, counts: np.ndarray | None = None, tuned: bool = True, levels: np.ndarray | None = None):
        n = int(STARTS[-1])
        self.counts = np.zeros((n, 2), np.uint32) if counts is None else counts
        self.levels = levels
        if not tuned:
            return
        self.wa, self.wb = np.full((GATES, K + 1), 0.3, np.float32), np.zeros((8, K + 1), np.float32)
        self.wa[:, K] = 0
        self.ga, self.gb = np.zeros(self.wa.shape), np.zeros(self.wb.shape)
        self.hits, self.ones = np.zeros((256, APM)), np.zeros((256, APM))

    def freeze(self) -> Model:
        """All slots get their logit and gate, the map becomes probabilities."""
        self.state = np.zeros(len(self.counts), np.int32)
        for k in range(K):
            self._derive(k, slice(STARTS[k], STARTS[k + 1]))
        self.counts, self.map = None, self._map()
        return self

    def _derive(self, k: int, at) -> None:
        zeros, ones = self._seen(at)
        self.state[at] = ((_LOG[ones] - _LOG[zeros]) << 8) | (_GATE[k][zeros + ones] + SURE * ((zeros == 0) ^ (ones == 0)))

    def _seen(self, at) -> tuple[np.ndarray, np.ndarray]:
        width = self.counts.itemsize
        both = self.counts.reshape(-1).view(f"u{2 * width}")[at]
        return tuple(np.minimum(n, 65535).astype(np.int32) for n in (both & (256**width - 1), both >> (8 * width)))

    def _map(self) -> np.ndarray:
        centre = 1 / (1 + np.exp(-(np.arange(APM) / 2 - 8)))
        return ((self.ones + 100 * centre) / (self.hits + 100)).astype(np.float32)

    def mix(self, slots):
        """Logits of the contexts, the gates, and the sum of weighted logits, by gate and by bit; all (8, m)."""
        x, gate = [], None
        for i in slots:
            state = self.state[i]
            own = state.astype(np.uint8)
            gate = own if gate is None else np.maximum(gate, own, out=gate)
            state >>= 8
            x.append(state.astype(np.float32))
            x[-1] *= np.float32(1 / UNIT)
        return x, gate, self._sum(x, gate)

    def _without(self, slots, bits):
        """mix() of bits as they would be, had they not been counted once."""
        if self.levels is None:
            self.levels = levels_of(self.counts)
        x, gate, bit = [], None, bits.astype(np.int64) << 16
        for k, i in enumerate(slots):
            at = self.levels[i].astype(np.int64)
            at += bit
            own = _GATE_WITHOUT[k][at]
            gate = own if gate is None else np.maximum(gate, own, out=gate)
            x.append(_LOGIT_WITHOUT[at])
        return x, gate, self._sum(x, gate)

    def _sum(self, x, gate):
        w = np.ascontiguousarray((self.wa[None] + self.wb[:, None]).reshape(-1, K + 1).T)
        at = gate + np.arange(0, 8 * GATES, GATES)[:, None]
        z = w[K][at]
        for k in range(K):
            part = w[k][at]
            part *= x[k]
            z += part
        return np.clip(z, -11, 11, out=z)

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte."""
        out, flat = np.empty(len(g)), self.map.reshape(-1)
        for a in range(0, len(g), STEP):
            bits, nodes, slots = _slots(g[a : a + STEP])
            _, _, z = self.mix(slots)
            p, (lo, f) = 1 / (1 + np.exp(-z)), _place(z)
            lo += nodes.astype(np.int64) * APM
            p = 0.6 * p + 0.4 * ((1 - f) * flat[lo] + f * flat[lo + 1])
            p = np.abs(p - (1 - bits).astype(np.float32))
            every = p[0].astype(np.float64)
            for one in p[1:]:
                every *= one
            out[a : a + STEP] = np.log10(every)
        return out

    def learn(self, g: np.ndarray, c: np.ndarray) -> int:
        """Count the distinct grams of a slice, c times each, then tune(); returns the bits seen."""
        self.count(g, c)
        return self.tune(g, c)

    def count(self, g: np.ndarray, c: np.ndarray) -> None:
        """Add a slice's counts, each context's grams once."""
        flat, self.levels = self.counts.reshape(-1), None
        for k in range(K):
            code, own = _distinct((_context(k, g) << np.uint64(8)) | (g & np.uint64(255)))
            times = np.bincount(code, c, len(own)).astype(np.uint32)
            for a in range(0, len(own), STEP):
                part = own[a : a + STEP]
                bits, nodes, low, half = _bits(part)
                at = _line(k, part >> np.uint64(8), half, nodes, low)
                np.add.at(flat, (2 * at + bits).ravel(), np.broadcast_to(times[a : a + STEP], bits.shape).ravel())

    def tune(self, g: np.ndarray, c: np.ndarray) -> int:
        """One online pass of weights and map, in steps, over counted grams; returns the bits seen."""
        return self.steps(*shuffled(g, c))

    def steps(self, g: np.ndarray, c: np.ndarray) -> int:
        for a in range(0, len(g), STEP):
            self._step(*_slots(g[a : a + STEP]), c[a : a + STEP].astype(np.float32))
        return 8 * int(c.sum())

    def _step(self, bits, nodes, slots, w) -> None:
        x, gate, z = self._without(slots, bits)
        x.append(np.ones_like(z))
        one = bits.astype(np.float32)
        p = 1 / (1 + np.exp(-z))
        err = one - p
        bend = np.maximum(p * (1 - p), 0.25 * np.abs(err))
        err *= w
        bend *= w
        # sums by bit and gate, of which those by gate and those by bit are made
        order = np.argsort(gate, 1, kind="stable")
        order += np.arange(0, gate.size, gate.shape[1])[:, None]
        order = order.ravel()
        key = gate.ravel()[order]
        runs = np.union1d(np.flatnonzero(key[1:] != key[:-1]) + 1, np.arange(0, gate.size, gate.shape[1]))
        here, e0, h0 = key[runs] + GATES * (runs // gate.shape[1]), err.ravel()[order], bend.ravel()[order]
        for k in range(K + 1):
            own, by_e, by_h = x[k].ravel()[order], np.zeros((8, GATES)), np.zeros((8, GATES))
            part = e0 * own
            by_e.reshape(-1)[here] = np.add.reduceat(part, runs, dtype=np.float64)
            np.multiply(h0, own, out=part)
            part *= own
            by_h.reshape(-1)[here] = np.add.reduceat(part, runs, dtype=np.float64)
            (e, h), (by_e, by_h) = (by_e.sum(1), by_h.sum(1)), (by_e.sum(0), by_h.sum(0))
            self.ga[:, k] += by_h
            self.wa[:, k] += RATE * by_e / (K * by_h + FADE * self.ga[:, k] + 100)
            self.gb[:, k] += h
            self.wb[:, k] += RATE * e / (4 * K * h + FADE * self.gb[:, k] + 100)
        np.clip(self.wa, -1, 2, out=self.wa)
        np.clip(self.wb, -1, 1, out=self.wb)
        # the map learns at the nearest of its points
        near = np.clip((z + 8.25) * 2, 0, APM - 1).astype(np.int64)
        both = np.bincount(((nodes.astype(np.int64) * APM + near) * 2 + bits).ravel(), np.broadcast_to(w, bits.shape).ravel(), 512 * APM).reshape(256, APM, 2)
        self.hits += both.sum(2)
        self.ones += both[:, :, 1]


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The levels of a slot's zeros and, times 256, ones."""
    out = np.empty(counts.shape, np.uint8)
    for a in range(0, len(counts), 1 << 20):
        out[a : a + (1 << 20)] = _LEVEL[np.minimum(counts[a : a + (1 << 20)], 65535)]
    return out.reshape(-1).view("<u2")


def shuffled(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slice's grams in random order, as they come sorted."""
    order = np.random.default_rng(len(g)).permutation(len(g))
    return g[order], c[order]


def _place(z):
    at = np.clip((z + 8) * 2, 0, APM - 1.001)
    lo = at.astype(np.int64)
    return lo, (at - lo).astype(np.float32)


def _context(k: int, g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(8)) & np.uint64((1 << 8 * (k + 1)) - 1) if k < K - 1 else g >> np.uint64(8 * K)


def _bits(g: np.ndarray):
    """For packed grams: the last byte's bits, the nodes they stand at, their places in a context's two lines, and which second line; all but the last (8, m)."""
    cur, shift = g.astype(np.uint8), np.arange(8, dtype=np.uint8)[:, None]
    bits = (cur >> (7 - shift)) & np.uint8(1)
    nodes = (cur >> 1 >> (7 - shift)) | (np.uint8(1) << shift)
    low = nodes.astype(np.int64)
    low[4:] = (low[4:] & ((1 << (shift[4:].astype(np.int64) - 4)) - 1)) | (1 << (shift[4:].astype(np.int64) - 4))
    return bits, nodes, low, (cur >> 4).astype(np.uint64) + np.uint64(1)


def _line(k: int, ctx: np.ndarray, half: np.ndarray, nodes: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A context's slots: its nodes lie in two lines of 16, one for each half of the byte; the shortest context has them all."""
    if k == 0:
        return (ctx.astype(np.int64)[None] << 8) | nodes
    line, own = np.uint64(64 - SLOT_BITS[k] + 4), ctx * np.uint64(32)
    first, second = ((mix(x * np.uint64(K + 2) + np.uint64(k)) >> line << np.uint64(4)).astype(np.int64) + int(STARTS[k]) for x in (own, own + half))
    at = np.empty(nodes.shape, np.int64)
    np.add(first, low[:4], out=at[:4])
    np.add(second, low[4:], out=at[4:])
    return at


def _slots(g: np.ndarray):
    """For packed grams: the last byte's bits, the nodes they stand at, and each context's slots; all (8, m)."""
    bits, nodes, low, half = _bits(g)
    return bits, nodes, [_line(k, _context(k, g), half, nodes, low) for k in range(K)]


def _distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, values = pd.factorize(g)
    return code, np.asarray(values, np.uint64)


def _starts(g: np.ndarray) -> np.ndarray:
    """Where each of some sorted grams begins."""
    return np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))


def _together(seen: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of several pieces, sorted, and how often each occurs."""
    g = np.concatenate([x for x, _ in seen])
    order = np.argsort(g)
    g = g[order]
    at = _starts(g)
    return g[at], np.add.reduceat(np.concatenate([c for _, c in seen])[order], at)


def _slices(batches):
    """Distinct grams of each slice and how often each occurs. Slices grow, so that the first ones need not wait for long, and end with the text that fills them, whatever the batches."""
    size, have, seen = FIRST, 0, []
    for batch in batches:
        data, offsets = column(batch.column(0))
        a = 0
        while a < len(offsets) - 1:
            b = min(len(offsets) - 1, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size - have))))
            for i, j in groups(offsets[a : b + 1], SLICE):
                for piece in _pieces(data[offsets[a + i] : offsets[a + j]], offsets[a + i : a + j + 1] - offsets[a + i]):
                    g = np.sort(piece)  # takes a third of the time of hashing, where no codes are asked for
                    at = _starts(g)
                    seen.append((g[at], np.diff(at, append=len(g))))
                    if len(seen) == 8:
                        seen = [_together(seen)]
            a, have = b, have + int(offsets[b] - offsets[a])
            if have >= size:
                yield _together(seen)
                size, have, seen = min(TRAIN_SLICE, 2 * size), 0, []
    if seen:
        yield _together(seen)


def _learned(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["chunk", "slots", "counts"])


def _counted(batches):
    """Rows (chunk, slots, counts) of what the texts of one block hold; before them its grams, for the weights to learn from in order of chunks -1, -2 and on."""
    model, n = None, 0
    for g, c in _slices(batches):
        model = model or Model(tuned=False)
        model.count(g, c)
        g, c = shuffled(g, c)
        for a in range(0, len(g), ROW):
            n -= 1
            yield _learned([(n, blob(g[a : a + ROW]), _narrow(c[a : a + ROW]))])
    for i in range(0, len(model.counts) if model else 0, CHUNK):
        part = model.counts[i : i + CHUNK]
        at = np.flatnonzero(part.any(1))
        if len(at):
            yield _learned([(i // CHUNK, blob(at.astype(np.uint16)), blob(part[at]))])


def _tuned(shared):
    """A row (-1, nothing, sums) of a block's grams: weights times bits, bits, and the map's sums."""

    def run(batches):
        model, bits = Model(levels=shared.value), 0
        for batch in batches:
            for g, c in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                bits += model.steps(np.frombuffer(g.as_buffer(), np.uint64), _wide(c.as_buffer()))
        if bits:
            yield _learned([(-1, b"", blob(np.concatenate([(model.wa * bits).ravel(), (model.wb * bits).ravel(), [bits], model.hits.ravel(), model.ones.ravel()]).astype(np.float64)))])

    return run


def _pieces(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE):
    """Packed grams; those of one very long text in parts of bounded size."""
    if len(data) <= 4 * limit or len(offsets) > 2:
        yield grams(data, offsets)[0]
        return
    for s in range(0, len(data), limit):
        lead, e = min(s, 4096), min(len(data), s + limit)
        part, _ = grams(data[s - lead : e], np.array([0, e - s + lead]))
        yield part[lead : len(part) if e == len(data) else -1]


def _sum_learned(batches):
    """Sums by (part, chunk) of the sums by block; those of weights in the order of blocks, as they are rounded."""
    total: dict[tuple[int, int], np.ndarray] = {}
    weights: dict[int, list] = {}
    for batch in batches:
        for part, before, c, at, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
            if c < 0:
                weights.setdefault(part, []).append((before, np.frombuffer(x, np.float64)))
            else:
                if (part, c) not in total:
                    total[part, c] = np.zeros((CHUNK, 2), np.int64)
                total[part, c][np.frombuffer(at, np.uint16)] += np.frombuffer(x, np.uint32).reshape(-1, 2)
    for part, rows in weights.items():
        total[part, -1] = sum(x for _, x in sorted(rows, key=lambda r: r[0]))
    for (part, c), x in total.items():
        at = b""
        if c >= 0:
            # counts beyond what 32 bits hold keep their proportion
            x = np.ceil(x / np.maximum(1, x.max(1, keepdims=True) / (2**32 - 1))).astype(np.uint32)
            own = np.flatnonzero(x.any(1))
            at, x = blob(own.astype(np.uint16)), x[own]
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([c]), pa.array([at]), pa.array([blob(x)])], ["part", "chunk", "slots", "counts"])


LEARNED = "part long, chunk long, slots binary, counts binary"


def train(texts: DataFrame) -> Model:
    """A model from the column text of all rows; all columns tell a row's block. What comes to the driver has the model's size, whatever the input.

    Tables of FAN blocks meet in one task a chunk, and so on, so that what a task reads stays bounded.
    """
    spark = texts.sparkSession
    ws = Workspace(spark, "lm-train")
    parts = max(1, -(-text_bytes(texts) // BLOCK))
    counts = np.zeros((int(STARTS[-1]), 2), np.uint16)
    blocks = texts.select("text", F.xxhash64(*texts.columns).alias("place"))
    blocks = blocks.repartitionById(parts, F.pmod("place", F.lit(parts)).cast("int")).sortWithinPartitions("place", "text").select("text")
    seen = ws.table("seen", _numbered(blocks.mapInArrow(_counted, "chunk long, slots binary, counts binary")), wide=True)
    ws.drop()
    for r in _summed(ws, "counts", seen.where("chunk >= 0")):
        x = np.frombuffer(r.counts, np.uint32).reshape(-1, 2).astype(np.int64)
        counts[r.chunk * CHUNK + np.frombuffer(r.slots, np.uint16).astype(np.int64)] = np.minimum(65535, np.ceil(x / np.maximum(1, x.max(1, keepdims=True) / 65535)))
    model, shared = Model(counts), spark.sparkContext.broadcast(levels_of(counts))
    grams = seen.where("chunk < 0").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.desc("chunk")).select("slots", "counts")
    learned = ws.table("weights", _numbered(grams.mapInArrow(_tuned(shared), "chunk long, slots binary, counts binary")))
    ws.drop("seen")
    for r in _summed(ws, "sums", learned):
        x = np.frombuffer(r.counts, np.float64)
        a, b = model.wa.size, model.wa.size + model.wb.size
        model.wa = (x[:a] / x[b]).reshape(model.wa.shape).astype(np.float32)
        model.wb = (x[a:b] / x[b]).reshape(model.wb.shape).astype(np.float32)
        model.hits, model.ones = x[b + 1 : b + 1 + 256 * APM].reshape(256, APM), x[b + 1 + 256 * APM :].reshape(256, APM)
    shared.unpersist()
    ws.drop("weights")
    return model.freeze()


def _numbered(learned: DataFrame) -> DataFrame:
    return learned.select(F.spark_partition_id().cast("long").alias("part"), "chunk", "slots", "counts")


def _summed(ws: Workspace, name: str, learned: DataFrame):
    """Rows (chunk, slots, counts) summed over all tasks, FAN of them at a time."""
    shuffled = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    level = 0
    parts = int(learned.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1 or not level:
        parts, level = -(-parts // FAN), level + 1
        some = learned.select(F.floor(F.col("part") / FAN).alias("part"), F.col("part").alias("before"), "chunk", "slots", "counts").repartition(shuffled, "part", "chunk")
        learned = ws.table(f"{name}{level}", some.mapInArrow(_sum_learned, LEARNED))
        if level > 1:
            ws.drop(f"{name}{level - 1}")
    yield from learned.select("chunk", "slots", "counts").toLocalIterator()
    ws.drop(f"{name}{level}")


def log10_probability(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) > 2 or len(data) <= 4 * SLICE:
        parts, made, n = [], [np.zeros(0, np.uint64)], 0
        for i, j in groups(offsets, SLICE):
            g, at = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            code, values = _distinct(g)
            parts.append(((code + n).astype(np.uint32), at[:-1]))
            made.append(values)
            n += len(values)
        code, values = _distinct(np.concatenate(made))
        each = model.log10(values)
        return np.concatenate([np.zeros(0), *(np.add.reduceat(each[code[own]], at) for own, at in parts)])
    total = 0.0
    for part in _pieces(data, offsets):
        code, values = _distinct(part)
        total += float((model.log10(values) * np.bincount(code, minlength=len(values))).sum())
    return np.array([total])


SENT = "bucket long, block long, keys binary, counts binary, info binary, score binary"


def _row(bucket: int, block: int, *cols: bytes) -> dict:
    return dict(zip(("bucket", "block", "keys", "counts", "info", "score"), (bucket, block, *cols, *[b""] * (4 - len(cols))), strict=True))


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(c, pa.int64() if c[0] == "b" else pa.binary()) for c in ("bucket", "block", "keys", "counts", "info", "score")]))


def _requests(shared, n: int):
    """Of each block of texts a row (bucket -1) with scores and the tokens of each text, and its distinct tokens by bucket: hash, and times in training texts.

    A text's tokens are places among the block's, with times; info: id, null id, held out, bytes, tokens and distinct tokens.
    """

    def run(batches):
        ids, model = block_ids(), shared.value
        for batch in batches:
            data, offsets = column(batch.column(1))
            doc, held = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in groups(offsets, ASK):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                score = log10_probability(model, own, at)
                _, _, h, first = words(own, at, NONSPACE)
                code, keys = _distinct(h)
                order = np.argsort(keys)
                keys, place = keys[order], np.empty(len(keys), np.int64)
                place[order] = np.arange(len(keys))
                pair, times = np.unique(np.repeat(np.arange(b - a), np.diff(first)) * len(keys) + place[code], return_counts=True)
                text, token = np.divmod(pair, max(1, len(keys)))
                learned = np.bincount(token, times * ~held[a:b][text], len(keys)).astype(np.uint64)
                some, block = doc.slice(a, b - a), next(ids)
                info = (some.fill_null(0).to_numpy(zero_copy_only=False), some.is_null().to_numpy(zero_copy_only=False), held[a:b], np.diff(at), np.diff(first), np.bincount(text, minlength=b - a))
                rows = [_row(-1, block, _narrow(token), _narrow(times), blob(np.column_stack(info).astype(np.int64)), blob(score))]
                rows += [_row(k, block, blob(keys[i:j]), _narrow(learned[i:j])) for k, i, j in cuts(keys, n)]
                yield from _table(rows).to_batches()

    return run


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them all, and that number first."""
    size = next(k for k in (1, 2, 4, 8) if int(x.max(initial=0)) < 256**k)
    return bytes([size]) + blob(x.astype(f"u{size}"))


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)


def _count(table: pa.Table) -> pa.Table:
    """Training counts of a bucket's tokens, for each block those that it asks for in their order; and how many have any (block -1)."""
    bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    values, code = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.zeros(len(values), np.int64)
    np.add.at(c, code, np.concatenate([_wide(x) for x in table.column("counts").to_pylist()]))
    ends = np.cumsum([len(k) for k in keys])
    rows = [_row(bucket, block, b"", _narrow(c[code[e - len(k) : e]])) for block, k, e in zip(blocks, keys, ends.tolist(), strict=True)]
    return _table([*rows, _row(bucket, -1, b"", _narrow(np.array([(c > 0).sum()])))])


def _gather(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    head, c = rows[0], np.concatenate([np.zeros(0, np.int64), *(_wide(r["counts"]) for r in rows[1:])])
    info, token, times = np.frombuffer(head["info"], np.int64).reshape(-1, 6), _wide(head["keys"]), _wide(head["counts"])
    text = np.repeat(np.arange(len(info)), info[:, 5])
    logs, known = (np.bincount(text, times * x[token], len(info)).astype(float) for x in (np.log10(c + 1), c > 0))
    return pa.table({"doc_id": pa.array(info[:, 0], mask=info[:, 1] == 1), "held_out": info[:, 2] == 1, "words": info[:, 4], "known": known.astype(np.int64), "logs": logs, "score": np.frombuffer(head["score"], np.float64), "n_bytes": info[:, 3]})


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits and bits_per_byte (the end mark is a byte) of every row of docs (doc_id, text).

    held_out: a condition on doc_id and text; the other rows teach the model. A null text is empty: one token, the end. If nothing
    teaches, N and V are 0 and each base probability is 1.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    shared = spark.sparkContext.broadcast(train(docs.where("not held").select("doc_id", "text")))
    n = n_buckets(spark, text_bytes(docs))
    sent = ws.table("sent", docs.mapInArrow(_requests(shared, n), SENT))
    got = ws.table("counts", sent.where("bucket >= 0").select("bucket", "block", "keys", "counts").groupBy("bucket").applyInArrow(_count, SENT))
    v = sum(int(_wide(r[0])[0]) for r in got.where("block = -1").select("counts").toLocalIterator())
    rows = sent.where("bucket = -1").unionByName(got.where("block <> -1")).groupBy("block").applyInArrow(_gather, "doc_id long, held_out boolean, words long, known long, logs double, score double, n_bytes long")
    rows = ws.table("rows", rows)
    ws.drop("sent", "counts")
    ends, tokens = (int(x or 0) for x in rows.where("not held_out").agg(F.count("*"), F.sum("words")).first())
    total, v = tokens + ends, v + (ends > 0)
    return rows.select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"), (F.col("known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(float(np.log10(ends + 1))) - (F.col("words") + 1) * F.lit(float(np.log10(total + v + 1)))).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10)))).alias("bits"), (-F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of whole documents, learned from those whose crc32 of the id modulo 7 isn't 2; a missing id is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)

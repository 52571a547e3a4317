"""Vectorised work on UTF-8 bytes: words, shingles and window fingerprints as 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
#: Fingerprints are two polynomials modulo the prime 2**31 - 1, as modulo 2**64 some texts (Thue-Morse words) would be equal by construction.
_M = U64(2**31 - 1)
_BASES = (1313131, 987654321)
_rng = np.random.default_rng(20240229)
#: A number below that prime for each byte and polynomial, and none is 0.
TERMS = _rng.integers(1, 2**31 - 1, (2, 256), dtype=np.uint64)
#: A random odd number for each byte, so that no text hashes to nothing.
MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word characters by contract: letters a-z, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Words are what stands between white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, *range(9, 14)]] = False
_pows: list[list[np.ndarray]] = [[np.ones(1, U64), np.ones(1, U64)] for _ in _BASES]


def _mod(x: np.ndarray) -> np.ndarray:
    """x, below 2**62, modulo the prime, in its own place."""
    for _ in range(2):
        y = x >> U64(31)
        x &= _M
        x += y
    return np.minimum(x, x - _M, out=x)  # what is below the prime wraps round to more; a masked subtraction takes twice as long


def powers(n: int) -> list[list[np.ndarray]]:
    """For each polynomial, the powers of its base and of the base's inverse, n of them at least."""
    if len(_pows[0][0]) < n:
        for own, base in zip(_pows, _BASES, strict=True):
            for k, b in enumerate((base, pow(base, -1, int(_M)))):
                x = own[k]
                while len(x) < max(n, 1 << 16):
                    x = np.concatenate((x, _mod(x * U64(pow(b, len(x), int(_M))))))
                own[k] = x
    return _pows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """For each polynomial H with H[e] - H[s] = the sum of its terms for data[s:e]."""
    h = np.zeros((2, len(data) + 1), U64)
    for own, terms, (pw, _) in zip(h, TERMS, powers(len(data) + 1), strict=True):
        np.cumsum(_mod(terms[data] * pw[: len(data)]), out=own[1:])  # below 2**31 each, so the sum of 2**31 of them stays below 2**62
    return h


def between(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Fingerprints of data[s:e], equal for equal bytes wherever they stand."""
    x, y = (_mod(_mod(own[e] - own[s]) * inv[s]) for own, (_, inv) in zip(h, powers(h.shape[1]), strict=True))
    y <<= U64(32)
    y |= x
    return mix(y)


def windows(h: np.ndarray, w: int) -> np.ndarray:
    """between() of every run of w bytes."""
    n = max(0, h.shape[1] - w)
    x, y = (_mod(_mod(own[w:] - own[:n]) * inv[:n]) for own, (_, inv) in zip(h, powers(h.shape[1]), strict=True))
    y <<= U64(32)
    y |= x
    return mix(y)


def column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    kind = pa.large_binary()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.cast(kind)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs a..b of whole documents with at most limit bytes together; a longer document is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def _words(data: np.ndarray, docs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[docs] = True
    before = np.concatenate(([False], w[:-1])) & ~edge[:-1]
    after = np.concatenate((w[1:], [False])) & ~edge[1:]
    s, e = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return s, e, between(prefix_hash(LOWER[data]), s, e)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, limit: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Start, end and hash of the words of some documents, and the number of words before each document.

    A-Z count as a-z. A text longer than limit is cut where no word is, so memory doesn't follow its length.
    """
    parts = []
    for a, b in groups(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        while lo < hi:
            cut = hi
            if hi - lo > 2 * limit:
                cut, step = lo + limit, limit
                while cut < hi and len(gap := np.flatnonzero(~inside[data[cut : cut + step]])) == 0:
                    cut += step
                cut = min(hi, cut + int(gap[0]) if len(gap) else hi)
            d = offsets[a : b + 1] - lo
            s, e, h = _words(data[lo:cut], d[(d >= 0) & (d <= cut - lo)], inside)
            parts.append((s + lo, e + lo, h))
            lo = cut
    s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
    return s, e, h, np.searchsorted(s, offsets)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive numbers, in order."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(_P)
        out += h[j : j + n]
    return mix(out)


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()

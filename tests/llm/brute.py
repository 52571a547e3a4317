"""Plain Python versions of the contracts, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return (text or "").translate(AZ)


def leaks(docs, items):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        if w:
            k = min(10, len(w))
            for i in range(len(w) - k + 1):
                wins[tuple(w[i : i + k])].add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for d, text in docs:
        w = ALNUM.findall(low(text))
        hit, seen = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if got := wins.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    seen |= got
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    return out


def near(docs, k, t):
    sets = {}
    for d, text in docs:
        w = SPACE.findall(low(text))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids, by = sorted(sets), defaultdict(list)
    for d in ids:
        for x in sets[d]:
            by[x].append(d)
    for a in ids:
        both = Counter(b for x in sets[a] for b in by[x] if b > a)
        for b, n in both.items():
            if 100 * n >= t * (len(sets[a]) + len(sets[b]) - n) and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return [(d, len(sets[d]), top(d)) for d in ids]


def repeats(docs, w=200):
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t in docs]
    for _, b in raw:
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\x01" * w
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out

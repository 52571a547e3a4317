import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from gridloom.llm import source_audit as op
from tests.llm import brute

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def divergences(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(brute.low(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t in df if df[t] >= least]
        names = {d[1] for d in own}
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in names}
        whole = sum(count.values(), Counter())

        def p(c, t):
            return 1 + 1000000000 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for s in names:
            pair = [(o, sum((p(count[s], t) - p(count[o], t)) ** 2 // p(count[o], t) for t in kept)) for o in names - {s}]
            term = [(t, (p(count[s], t) - p(whole, t)) ** 2 // p(whole, t)) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, *x, i) for i, x in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


def rows(seed, n=150):
    r = random.Random(seed)
    words = ["".join(r.choices("abcDEé漢", k=r.randint(1, 12))) for _ in range(120)] + ["w" * k for k in range(28, 70, 3)]
    out = [(i, r.choice([" ", "\n", "1", "_"]).join(r.choices(words, weights=range(len(words), 0, -1), k=r.randint(0, 40))), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "ç", None])) for i in range(n)]
    out += [(900, None, "en", "no words"), (901, "", "xx", "p"), (902, "... 123", "xx", "q"), (903, "x y z", "yy", "alone"), (None, "x x", "en", "a"), (1, out[1][1], "en", "a"), (1, out[1][1], "en", "a")]
    return out


@pytest.mark.parametrize("piece", [op.PIECE, 300])
def test_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(op, "PIECE", piece)
    monkeypatch.setattr(op, "BLOCK", 20 * piece)
    data = rows(piece) + [(904, " ".join(["long"] * 900 + ["tail", "é" * 700]), "en", "b")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({"value": op.F.lit("clash"), "rank": op.F.lit(0), "bucket": op.F.lit(1)})
    got = op.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergences(data)
    assert sorted(map(tuple, op.audit(df, 2, 5).collect())) == divergences(data, 2, 5)


def test_no_rows(spark):
    assert op.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_that_share_a_hash_are_told_apart_by_their_bytes(monkeypatch):
    plain = op.slice_hashes
    monkeypatch.setattr(op, "slice_hashes", lambda *a: plain(*a) & np.uint64(3))
    words = [b"abc", b"abd", b"x" * 40, b"x" * 39 + b"y", b"abc", b"abcdefgh", b"abcdefgi", b"", b"abd"]
    size = np.array([len(w) for w in words])
    lead, own, _ = op.distinct(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    assert len(lead) == 7 and [words[lead[i]] for i in own] == words


def test_collisions_change_no_count(monkeypatch):
    data = rows(5, 60)
    plain = op.slice_hashes
    monkeypatch.setattr(op, "slice_hashes", lambda *a: plain(*a) % np.uint64(5))
    text = "\n".join(x[1] for x in data if x[1]).encode()
    arr = op.LOWER[np.frombuffer(text, np.uint8)]
    g, n, df, size, terms = op._counted(arr, np.array([0, len(arr)]), np.array([0]))
    ends = np.cumsum(size)
    got = {terms[a - m : a].tobytes().decode(): c for a, m, c in zip(ends.tolist(), size.tolist(), n.tolist(), strict=True)}
    assert got == Counter(TERM.findall(brute.low(text.decode())))


def test_hash_is_xxh64():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 5000, dtype=np.uint8)
    size = np.concatenate((np.arange(0, 70), r.integers(0, 64, 300)))
    start = r.integers(0, 4900, len(size))
    got = op.slice_hashes(data, op.lanes_of(data), start, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes()) for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def test_shares_are_exact_beyond_64_bits():
    total = 8 * 10**15 + 7
    got = op.share(np.array([0, 1, 10**15 + 3, total]), total)
    assert got.tolist() == [1 + 10**9 * c // total for c in (0, 1, 10**15 + 3, total)]


def test_rows_between_steps_do_not_follow_buckets(spark, monkeypatch):
    """A task sums pairs and keeps the best terms of all its matrices, and may send them in parts."""
    data, made, table = rows(7), {}, op.Workspace.table

    def count(ws, name, df, *more):
        out = table(ws, name, df, *more)
        made[name] = out.count()
        return out

    monkeypatch.setattr(op.Workspace, "table", count)
    df = spark.createDataFrame(data, SCHEMA)
    sent = []
    for n in (2, 40):
        monkeypatch.setattr(op, "n_buckets", lambda *_, n=n: n)
        assert sorted(map(tuple, op.audit(df, top=5).collect())) == divergences(data, top=5)
        sent.append(made["parts"])
    assert sent[0] == sent[1] and made["cells"] > 40
    monkeypatch.setattr(op, "HELD", 10)
    assert sorted(map(tuple, op.audit(df, top=5).collect())) == divergences(data, top=5)

import random

import numpy as np
import pytest

from gridloom.llm import minhash as op
from tests.llm import brute
from tests.llm.test_near import texts


def chain(seed, n, step=1):
    """Texts of which each is linked with the few before it only, and one long family of near copies."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=5)) for _ in range(4000)]
    words, out = r.choices(vocab, k=60), []
    for i in range(n):
        words = list(words)
        for _ in range(step):
            words[r.randrange(60)] = r.choice(vocab)
        out.append((5000 + i, " ".join(words)))
    core = r.choices(vocab, k=80)
    for i in range(n):
        w = list(core)
        w[r.randrange(80)] = f"only{i}"
        out.append((7000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("k,t", [(2, 80), (5, 80)])
def test_against_brute_force(spark, k, t):
    rows = texts(k) + chain(k, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [(d, n, c, d == c) for d, n, c in brute.near(rows, k, t)]
    for kw in ({}, {"band_rows": 7, "family_bytes": 6000, "broadcast_rows": 0})[k > 2 :]:
        assert sorted(map(tuple, op.near_duplicates(df, k, t, **kw).collect())) == want


def test_nulls_repeats_clashes_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d"), (2, "A B C D"), (6, "x"), (7, " "), (7, "x")], "doc_id long, text string")
    got = op.near_duplicates(df.withColumns({"n": op.F.lit(1), "kept": op.F.lit("no"), "rep": op.F.lit(0)}))
    want = [(4, 1, 2, False), (4, 1, 2, False), (2, 1, 2, True), (None, 1, None, True), (None, 0, None, True), (6, 1, 6, True), (7, 0, 6, False), (7, 1, 6, False)]
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert op.near_duplicates(df.limit(0)).collect() == []
    kept = op.deduplicate(df.withColumn("kept", op.F.lit("no")))
    assert kept.columns == ["doc_id", "text", "kept"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "A B C D"), (6, "x"), (None, "a b c d"), (None, None)], key=str)


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.8):
        both = round(2000 * share / (1 + share))
        got = []
        for _ in range(20):
            x = r.integers(0, 2**63, 2000, dtype=np.uint64)
            y = np.concatenate((x[:both], r.integers(0, 2**63, 2000 - both, dtype=np.uint64)))
            x, y = x[:1000], np.concatenate((y[:both], y[both:1000]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            least = op.minima(np.concatenate((x, y)), np.array([0, 1000]))
            low = op.packed(least)
            differ = op.mismatches(low[:1], low[1:])[0]
            assert differ == sum((int(a) ^ int(b)) & (2**op.BITS - 1) != 0 for a, b in zip(*least, strict=True))
            got.append(op.similarity(differ) - true)
        assert abs(np.mean(got)) < 0.03


def test_bands_find_and_the_estimate_keeps_links_at_the_threshold():
    assert (1 - 0.8**op.ROWS) ** op.BANDS < 2e-7
    p = 0.85
    differ = np.random.default_rng(1).binomial(op.HASHES, 1 - p, 200_000)
    assert (differ > op.most_mismatches(80)).sum() == 0 and op.similarity(op.most_mismatches(80)) > 0.55


def test_spanning_connects_all_across_components_with_few_edges():
    r = np.random.default_rng(2)
    low = np.repeat(r.integers(0, 2**63, (2, op.WORDS), dtype=np.uint64), 200, axis=0)
    comp = np.where(np.arange(400) % 7 == 0, np.arange(400), 1000)
    e = op._spanning(comp, np.full(400, 50), low, 80, op.most_mismatches(80))
    assert len(e) == 398  # two groups of 200 places
    assert all((a < 200) == (b < 200) for a, b in e.tolist())

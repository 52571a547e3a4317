import random

import numpy as np
import pytest

from gridloom.llm import _bytes
from gridloom.llm.jaccard_join import deduplicate, near_duplicates, search
from tests.llm import brute


def texts(seed, n=160):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefg", k=r.randint(1, 6))) for _ in range(300)]
    base = [r.choices(vocab, k=r.randint(3, 120)) for _ in range(12)]
    line = " ".join(r.choices(vocab, k=25))
    out = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.7 else r.choices(vocab, k=r.randint(1, 60))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append((i * 3, r.choice([" ", "\n", "\t"]).join(w).title() + (" " + line if r.random() < 0.3 else "")))
    return out + [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one"), (1005, "A  b"), (1006, "é" * 40), (1007, "x " * 30000)]


@pytest.mark.parametrize("k,t", [(3, 90), (5, 80), (2, 60)])
def test_against_brute_force(spark, k, t):
    rows = texts(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.near(rows, k, t)
    for kw in ({}, {"broadcast_rows": 0, "family_bytes": 4000}):
        assert sorted(map(tuple, near_duplicates(df, k, t, **kw).collect())) == want


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, None), (4, "a b c d"), (4, "a b c d"), (2, "A B C D")], "doc_id long, text string")
    assert sorted(near_duplicates(df, 3, 90).collect(), key=str) == sorted([(4, 2, 2), (4, 2, 2), (2, 2, 2), (None, 2, None), (None, 0, None)], key=str)
    assert near_duplicates(df.limit(0), 3, 90).collect() == []


def test_one_id_on_several_texts_is_one_node(spark):
    a, b, c = "a b c d e", "p q r s t", "v w x y z"
    df = spark.createDataFrame([(5, a), (5, b), (1, a), (9, b), (9, None), (7, c), (8, "")], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df, 3, 90).collect())) == [(1, 3, 1), (5, 3, 1), (5, 3, 1), (7, 3, 7), (8, 0, 8), (9, 0, 1), (9, 3, 1)]
    kept = deduplicate(df.withColumn("n_shingles", df.doc_id), 3, 90)
    assert kept.columns == ["doc_id", "text", "n_shingles"] and sorted({r.doc_id for r in kept.collect()}) == [1, 7, 8]


def test_texts_that_polynomials_of_two_to_the_64th_confuse(spark):
    word = "a"
    while len(word) < 1024:  # a Thue-Morse word
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 100):
        data = np.frombuffer((word[:n] + other[:n]).encode(), np.uint8)
        x, y = _bytes.between(_bytes.prefix_hash(data), np.array([0, n]), np.array([n, 2 * n]))
        assert x != y
    got = near_duplicates(spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string"), 3, 90)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_search_skips_nothing():
    r = np.random.default_rng(1)
    core = r.integers(0, 2**62, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate((np.delete(core, r.integers(0, 100, r.integers(0, 6))), r.integers(0, 2**62, r.integers(0, 6), dtype=np.uint64)))) for _ in range(120)]
    want = {i: i for i in range(120)}
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 10 * both >= 9 * (len(sets[i]) + len(sets[j]) - both) and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = {k: a if v == b else v for k, v in want.items()}
    got = dict(search(np.arange(120), sets, 90).tolist())
    assert {i: got.get(i, i) for i in range(120)} == want

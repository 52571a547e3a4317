import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridloom.llm import prefix_trie as op
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(brute.SPACE.findall(k[-1][1])) if k else 0)
    sha = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(k)).encode()).hexdigest()
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(k, m)) for k, m in members.items()), key=str)


def conversations(seed, n=90):
    r = random.Random(seed)
    said = ["", None, "yes", "no  way", "a b c", "Ä x y", "\n"]
    out, last = [], []
    for c in range(n):
        if not last or r.random() < 0.6:
            last = [(r.choice(["user", "bot", None]), r.choice(said)) for _ in range(r.choice([0, 1, 2, 3, 5, 9]))]
        elif r.random() < 0.5:
            last = last[: r.randint(0, len(last))] + [("user", r.choice(said)) for _ in range(r.randint(0, 2))]
        turns = [None, *range(1, len(last))] if r.random() < 0.3 else list(range(len(last)))
        out += [(c, t, *x) for t, x in zip(turns, last, strict=False)]
    out = [x for x in out if x[0] != 40]  # a base that is absent
    out += [(c, t, "user", f"same {t}") for c in (200, 203, 207, 211, 230, 231) for t in range(25)]
    out += [(None, 1, "user", "nobody's"), (300, 1, "u", "twice"), (300, 1, "u", "twice"), (777, 0, "x", "word " * 30000)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("chunk,class_bytes", [(op.CHUNK, op.CLASS_BYTES), (2, 150), (3, 10**6)])
def test_against_brute_force(spark, chunk, class_bytes):
    rows = conversations(chunk)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"n": op.F.lit("clash"), "cls": op.F.lit(1), "depth": op.F.lit(2)})
    got = op.prefix_trie(df, chunk, class_bytes)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_empty_and_turnless(spark):
    assert op.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)  # its only turn is replaced by those of an absent conversation
    rows = [(c, 1, "user", "hello")]
    assert list(map(tuple, op.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect())) == brute_trie(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_many_ids_that_end_at_one_node(spark):
    df = spark.range(0, 3000).select(op.F.lit(b"x").alias("label"), op.F.col("id").alias("conv_id")).repartition(7)
    assert [tuple(r) for r in op.ends_of(df).collect()] == [(b"x", hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest())]

import glob
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from gridloom.llm import _bytes
from gridloom.llm import suffix_dedup as op
from tests.llm import brute


def rows(seed):
    r = random.Random(seed)
    passages = ["".join(r.choices("abcé \n", k=r.choice([30, 199, 200, 201, 260, 500]))) for _ in range(8)]
    out = []
    for i in range(60):
        parts = ["".join(r.choices("abcdefgh é", k=r.randint(0, 250)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), "".join(r.choices("xyz", k=r.choice([0, 1, 60])))]
        out.append((i, "".join(parts)))
    return out + [(90, None), (91, ""), (92, "a" * 199), (93, "b" * 201), (94, out[3][1]), (3, out[3][1]), (None, "q" * 500), (95, "ab" * 1500)]


@pytest.mark.parametrize("segment", [op.SEGMENT, 700])
def test_against_brute_force(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(op, "SEGMENT", segment)
    data = rows(segment)
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op.op6_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(brute.repeats(data), key=str)


def test_other_windows_and_empty(spark):
    data = rows(5)
    df = spark.createDataFrame(data, "doc_id long, text string")
    for w in (8, 30):
        got = op.remove_repeats(df, w, 2).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "cast(size(runs) / 2 as int)", "sha2(kept, 256)")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute.repeats(data, w), key=str)
    assert op.remove_repeats(df.limit(0)).count() == 0


def test_cover_has_every_difference():
    for w in (12, 30, 200, 400):
        v, d = op.cover_for(w)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_passage_over_the_cut_of_an_otherwise_unrepeated_text(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT", 2000)
    v, cover = op.cover_for(op.W)
    r = random.Random(1)
    cut = next(k for k in range(4000, 40000, 4000) if not {(k - d) % v for d in range(1, 8)} & set(cover))  # blocks end there
    text = "".join(r.choices("abcdefghijklmnop", k=cut + 9000))
    passage = text[cut - 7 : cut + 193]
    data = [(1, text), (2, "".join(r.choices("qrstuvw", k=500)) + passage + "".join(r.choices("qrstuvw", k=500)))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(2, "doc_id")
    got = op.remove_repeats(df).selectExpr("doc_id", "n_bytes", "n_bytes - octet_length(kept)", "cast(size(runs) / 2 as int)", "sha2(kept, 256)")
    want = brute.repeats(data)
    assert [x[2] for x in want] == [200, 200] and sorted(map(tuple, got.collect())) == want


def test_row_groups_of_blocks_are_bounded(spark):
    """A task reads a row group at once, so its memory must not follow the size of a file."""
    df = spark.range(12, numPartitions=1).selectExpr("id doc_id", "concat_ws('', transform(sequence(1, 64000), x -> sha2(concat(id, ' ', x), 256))) text")
    ws, *_, size = op.find(df)
    footers = [pq.ParquetFile(f).metadata for f in glob.glob(f"{ws.path.removeprefix('file://')}/blocks/*.parquet")]
    sizes = [m.row_group(i).total_byte_size for m in footers for i in range(m.num_row_groups)]
    assert size == 12 * 64000 * 64 and sum(sizes) > size and max(sizes) < 16 << 20


def test_remainders_at_their_edges():
    m, r = 2**31 - 1, random.Random(2)
    x = [0, 1, m - 1, m, m + 1, 2 * m - 1, 2 * m, 2 * m + 1, m * m, 2**62 - 1, *(r.randrange(2**62) for _ in range(999))]
    assert _bytes._mod(np.array(x, np.uint64)).tolist() == [v % m for v in x]
    for passes in (1, 2, 3, 4, 300):
        assert op._pass_of(np.array([*x, 2**64 - 1], np.uint64), passes).tolist() == [(v >> 7) % passes for v in [*x, 2**64 - 1]]

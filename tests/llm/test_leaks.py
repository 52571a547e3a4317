import random

from gridloom.llm import decontaminate as op
from tests.llm import brute


def data(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdé1", k=r.randint(1, 5))) for _ in range(60)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 3, 9, 10, 11, 30])))) for i in range(15)] + [(20, None), (21, ""), (22, "-.-")]
    docs = []
    for i in range(80):
        w = r.choices(vocab, k=r.randint(0, 50))
        if r.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = [x.upper() for x in (r.choice(items)[1] or "").split()]
        docs.append((i, r.choice([", ", "\x00", "_"]).join(w)))
    return docs + [(100, None), (101, ""), (102, (items[5][1] + " ") * 3000), (7, docs[7][1])], items


def test_against_brute_force(spark, tmp_path, monkeypatch):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.leaks(docs, items))
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, op.op2_decontaminate(spark, str(tmp_path)).collect())) == want
    monkeypatch.setattr(op, "PIECE", 4)
    sliced = op.find(d, b, max_windows=300).collect()
    assert sorted((r.doc_id, sum(r.spans[1::2]) - sum(r.spans[::2]), len(r["items"])) for r in sliced) == [(x[0], x[2], x[3]) for x in want]


def test_modes_and_clashing_columns(spark):
    docs, items = data()
    d = spark.createDataFrame([(*x, 1, 2, "s", 3) for x in docs], "doc_id long, text string, items int, n_words int, spans string, row int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert op.find(d.limit(0), b).count() == 0 and op.find(d, b.limit(0)).where("size(spans) > 0").count() == 0
    clean = op.decontaminate(d, b)
    assert clean.count() == sum(not x[5] for x in brute.leaks(docs, items)) and clean.columns == d.columns
    assert {tuple(r)[2:] for r in clean.collect()} == {(1, 2, "s", 3)}
    cut = op.decontaminate(d, b, mode="spans")
    assert cut.count() == len(docs) and cut.columns == d.columns
    before = {x[0]: x for x in brute.leaks(docs, items)}
    for r in cut.collect():
        assert len(brute.ALNUM.findall(brute.low(r.text))) == before[r.doc_id][1] - before[r.doc_id][2] and tuple(r)[2:] == (1, 2, "s", 3)


def test_items_without_an_id(spark):
    b = spark.createDataFrame([(None, "one two"), (5, "one two"), (None, None)], "item_id long, text string")
    got = op.find(spark.createDataFrame([(1, "say one two"), (None, None)], "doc_id long, text string"), b).collect()
    assert sorted((r.doc_id or 0, list(r["items"])) for r in got) == [(0, []), (1, ["", "5"])]

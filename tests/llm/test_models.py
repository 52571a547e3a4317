"""Language ID, mixing, LM scoring and nearest neighbours on small invented data."""

import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, language_id, lm_score, mix_sources
from gridloom.llm._bytes import column
from tests.llm import brute

SOUNDS = {"aa": "ka lo mi ta po ru na", "bb": "sch ung eit ber zu pf", "cc": "ção ão nho que é"}


def corpus(n=240, seed=1):
    r, out = random.Random(seed), []
    for i in range(n):
        lang = r.choice(list(SOUNDS))
        words = ["".join(r.choices(SOUNDS[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(2, 60))]
        out.append((i, r.choice([" ", "\n"]).join(words).capitalize(), lang))
    return out


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("models"))
    rows = corpus() + [(900, None, "aa"), (901, "", None), (902, "12 !!", "bb"), (903, "kalo mita", None), (903, "kalo mita", None), (None, "schungeit", "bb"), (905, "ka " * 200000, "aa")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_language_id(spark, docs_dir):
    at, rows = docs_dir
    got = language_id.op10_language_id(spark, at).collect()
    assert len(got) == len(rows)
    lang = {d: x for d, _, x in rows}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (900, 901, 902)} == dict.fromkeys((900, 901, 902), "und")
    own = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.95 * len(own)
    assert sum(r.accepted for r in own) >= 0.95 * len(own)


def test_language_id_without_teachers(spark):
    df = spark.createDataFrame([(1, "abc", 7)], "doc_id long, text string, score int")
    none = language_id.fit(df.selectExpr("text", "cast(null as string) lang"))
    assert language_id.predict(df, none).collect()[0].lang_pred == "und"
    one = language_id.fit(df.selectExpr("text", "'xx' lang"))
    assert language_id.predict(df, one).select("lang_pred", "score").first() == ("xx", 1.0)
    assert language_id.predict(df.limit(0), one).count() == 0


def test_very_long_texts_are_read_whole(monkeypatch):
    model = language_id.Model([(t, x) for _, t, x in corpus(60)])
    text = " ".join(t for _, t, _ in corpus(200))
    data = np.frombuffer(text.encode(), np.uint8)
    ids = [i for i, _, _ in language_id.subwords(data, np.array([0, len(data)]))]
    logits = sum(model.scores[i].astype(float).sum(0) for i in ids) / sum(map(len, ids)) + model.bias
    before = language_id.sparse(text)
    for size in (1000, 37, language_id.SLICE):
        monkeypatch.setattr(language_id, "SLICE", size)
        whole = model.predict(np.concatenate((data, data[:500])), np.array([0, len(data), len(data), len(data) + 500]))
        assert np.allclose(whole[0], language_id._softmax(logits[None] / model.temperature)[0], atol=1e-6)
        assert all((x == y).all() for x, y in zip(before, language_id.sparse(text), strict=True))


def test_unknown_languages_are_rejected(spark):
    model = language_id.Model([(t, x) for _, t, x in corpus(400)])
    model.threshold = max(model.threshold, 0.4)
    r = random.Random(8)
    odd = [(i, " ".join("".join(r.choices("qwxyj", k=5)) for _ in range(40)), "zz") for i in range(20)]
    known = [(100 + i, t, x) for i, t, x in corpus(40, 9)]
    got = language_id.predict(spark.createDataFrame(odd + known, "doc_id long, text string, lang string"), model).collect()
    assert sum(x.accepted for x in got if x.doc_id >= 100) >= 38
    assert np.mean([x.score for x in got if x.doc_id < 100]) < np.mean([x.score for x in got if x.doc_id >= 100])


def test_lm_score(spark, docs_dir):
    at, rows = docs_dir
    got = sorted(lm_score.op3_lm_score(spark, at).collect(), key=str)
    assert len(got) == len(rows)
    toks = {str(i): brute.SPACE.findall(brute.low(t)) + [None] for i, (_, t, _) in enumerate(rows)}
    held = [d is None or zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows]
    c = Counter(w for i in range(len(rows)) if not held[i] for w in toks[str(i)])
    n, v = sum(c.values()), len(c)
    want = [(d, held[i], len(toks[str(i)]), sum(c[w] > 0 for w in toks[str(i)]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks[str(i)])) for i, (d, *_) in enumerate(rows)]
    for w, g in zip(sorted(want, key=str), sorted(map(tuple, got), key=str), strict=True):
        assert w[:5] == tuple(g[:5]) and math.isclose(w[5], g[5], rel_tol=1e-9)
    assert all(g.score < 0 and math.isclose(g.bits, -g.score / math.log10(2)) for g in got)
    size = sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert sum(g.bits for g in got) / size < 3


def test_lm_probabilities_sum_to_one():
    model = lm_score.Model()
    data = np.frombuffer(b"banana bandana ban " * 50, np.uint8)
    for piece in lm_score._pieces(data, np.array([0, 400, len(data)])):
        code, g = lm_score._distinct(piece)
        model.learn(g, np.bincount(code))
    model.freeze()
    g, _ = lm_score.grams(np.frombuffer(b"bana", np.uint8), np.array([0, 4]))
    for x in g:
        every = (np.full(256, x) & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((10 ** model.log10(every)).sum(), 1, abs_tol=1e-4)


def test_lm_score_is_the_mixture_of_its_bits():
    """log10() against a plain mixer that goes bit by bit over the same tables."""
    model = lm_score.Model()
    data = np.frombuffer(b"the cat sat on the mat and the dog sat too " * 40, np.uint8)
    for piece in lm_score._pieces(data, np.array([0, 900, len(data)])):
        code, g = lm_score._distinct(piece)
        model.learn(g, np.bincount(code))
    model.freeze()
    text = b"the dog saw a cat"
    g, _ = lm_score.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert [int(x) & 255 for x in g] == [*text, lm_score.END]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    want = []
    for i, x in enumerate(g):
        before, cur, total = text[max(0, i - 4) : i][::-1], int(x) & 255, 0.0
        for bit in range(8):
            node = (1 << bit) | (cur >> (8 - bit))
            z, gate, logits = 0.0, 0, []
            for k in range(lm_score.K):
                ctx = sum(c << (8 * j) for j, c in enumerate(before[: k + 1])) if k < lm_score.K - 1 else int(x) >> (8 * lm_score.K)
                if k == 0:
                    at = (ctx << 8) | node
                else:
                    key = (ctx * 32 + (0 if bit < 4 else (cur >> 4) + 1)) * (lm_score.K + 2) + k
                    line = int(lm_score.mix(np.array([key & (2**64 - 1)], np.uint64))[0]) >> (64 - lm_score.SLOT_BITS[k] + 4)
                    at = int(lm_score.STARTS[k]) + line * 16 + (node if bit < 4 else (1 << (bit - 4)) | (node & ((1 << (bit - 4)) - 1)))
                logits.append((int(model.state[at]) >> 8) / lm_score.UNIT)
                gate = max(gate, int(model.state[at]) & 255)
            w = model.wa[gate] + model.wb[bit]
            z = max(-11, min(11, float(w[lm_score.K]) + sum(float(w[k]) * logits[k] for k in range(lm_score.K))))
            place = min(max((z + 8) * 2, 0), lm_score.APM - 1.001)
            lo, f = int(place), place - int(place)
            p = 0.6 * sigmoid(z) + 0.4 * ((1 - f) * float(model.map[node, lo]) + f * float(model.map[node, lo + 1]))
            total += math.log10(p if (cur >> (7 - bit)) & 1 else 1 - p)
        want.append(total)
    assert np.allclose(model.log10(g), want, atol=1e-4)


def test_lm_tables_meet_in_rounds(spark, monkeypatch):
    texts = spark.createDataFrame([(t,) for _, t, _ in corpus(120)], "text string").repartition(9)
    monkeypatch.setattr(lm_score, "FAN", 1000)
    once = lm_score.train(texts)
    monkeypatch.setattr(lm_score, "FAN", 2)
    rounds = lm_score.train(texts)
    assert (once.state == rounds.state).all() and np.allclose(once.map, rounds.map) and np.allclose(once.wa, rounds.wa, atol=1e-5)


def test_lm_score_follows_the_rows_alone(spark, monkeypatch):
    """The same scores however rows are dealt to tasks and ordered, with several blocks of training rows."""
    monkeypatch.setattr(lm_score, "BLOCK", 1 << 15)
    rows = [(i, t) for i, (_, t, _) in enumerate(corpus(150))]
    rows += [(1000 + i, "one word common to all") for i in range(200)] + [(2000, "x" * 50000), (2001, None), (2002, "")]
    held = F.col("doc_id") % 7 == 2
    got = []
    for parts, order in ((1, rows), (16, rows[::-1])):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        got.append({r.doc_id: r for r in lm_score.score(df, held).collect()})
    assert got[0].keys() == got[1].keys() == {i for i, _ in rows}
    for i, r in got[0].items():
        q = got[1][i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (q.held_out, q.n_tokens, q.n_known, q.train_tokens)
        assert math.isclose(r.score, q.score, rel_tol=1e-6) and math.isclose(r.base_score, q.base_score, rel_tol=1e-12)


def test_lm_weights_leave_out_what_they_predict():
    """What tuning sees of an occurrence is what the table would say without it."""
    model = lm_score.Model()
    data = np.frombuffer(b"the cat sat on the mat " * 3 + b"quiz", np.uint8)
    g, _ = lm_score.grams(data, np.array([0, len(data)]))
    code, g = lm_score._distinct(g)
    c = np.bincount(code)
    model.count(g, c)
    for i in range(0, len(g), 7):
        bits, _, slots = lm_score._slots(g[i : i + 1])
        x, gate, z = model._without(slots, bits)
        less = lm_score.Model(model.counts.copy())
        for at in slots:
            np.subtract.at(less.counts, (at.ravel(), bits.ravel()), 1)
        y, other, _ = less.freeze().mix(slots)
        assert (gate == other).all() and np.allclose(x, y, atol=1e-3)


def test_lm_weights_learn_from_what_counting_leaves():
    """Texts are read once: a block's rows hold its grams and how often each occurs, and weights learned from these rows are those learned from the texts."""
    texts = [t for _, t, _ in corpus(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    rows = [tuple(c[0] for c in b.columns) for b in lm_score._counted([batch])]
    left = [(g, c) for chunk, g, c in rows if chunk.as_py() < 0]
    assert [chunk.as_py() for chunk, *_ in rows][: len(left)] == [-1 - i for i in range(len(left))]
    g, c = (np.concatenate(x) for x in zip(*((np.frombuffer(g.as_py(), np.uint64), lm_score._wide(c.as_py())) for g, c in left), strict=True))
    data, offsets = column(batch.column(0))
    want = Counter(lm_score.grams(data, offsets)[0].tolist())
    assert len(g) == len(want) and dict(zip(g.tolist(), c.tolist(), strict=True)) == want
    model = lm_score.Model()
    model.count(g, c)
    shared = SimpleNamespace(value=lm_score.levels_of(model.counts))
    batches = [pa.RecordBatch.from_arrays([pa.array([g.as_py()]), pa.array([c.as_py()])], ["slots", "counts"]) for g, c in left]
    (out,) = lm_score._tuned(shared)(batches)
    model.steps(g, c)
    sums, bits = np.frombuffer(out.column(2)[0].as_py(), np.float64), 8 * sum(want.values())
    assert np.allclose(sums[: model.wa.size] / bits, model.wa.ravel()) and sums[model.wa.size + model.wb.size] == bits


def test_lm_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(df, F.lit(False)).count() == 0
    one = lm_score.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0)


def vectors(n=900, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 8)) + 3 * r.normal(size=(6, 8))[r.integers(0, 6, n)]
    return [(i, [float(v) for v in np.float32(x[i])]) for i in range(n)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2080, [float("inf")] * 8), (2100, []), (None, [1.0] * 8), (5, [float(v) for v in np.float32(x[5])])]


def exact(rows, k=20):
    rows = [(i, np.array(v)) for i, v in {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}]
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            out[q] = sorted(((-float(np.add.accumulate(x * y)[-1]), i) for i, y in rows if i != q))[:k]
    return out


@pytest.mark.parametrize("block", [ann.BLOCK_ROWS, 40])
def test_nearest(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = ann.search(df, F.col("vec_id") % 20 == 0, block_rows=block).collect(), exact(rows)
    assert {r.query_id for r in got} == set(want) and len(got) == 20 * len(want)
    hits = 0
    for q, near in want.items():
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        scores = {i: -s for s, i in near}
        assert all(math.isclose(r.score, scores[r.vec_id], rel_tol=1e-12) for r in own if r.vec_id in scores)
        hits += len({r.vec_id for r in own} & {i for _, i in near})
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_few_and_none(spark):
    rows = vectors()[:7]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    assert [(r.vec_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(i, k + 1) for k, (_, i) in enumerate(exact(rows)[0])]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_mixing_meets_targets(spark):
    r, rows, labels = random.Random(2), [], []
    for i in range(500):
        kind = r.choice(["good", "good", "plain", "toxic"])
        words = r.choices([f"w{j}" for j in range(60)], k=r.randint(20, 60))
        words[3:3] = {"good": [], "plain": ["|"] * 8, "toxic": ["vile", "foul"]}[kind]
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, int(kind != "plain"), int(kind == "toxic")))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(600, None), (601, ""), (None, "w1 w2")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (600, None, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = mix_sources.mix(docs, docs, lab).collect()
    assert len(got) == 503 and all(x.rate >= 0 and abs(sum(x.posterior) - 1) < 1e-6 for x in got)
    total = sum(x.n_tokens for x in got)
    for k, d in enumerate(mix_sources.DOMAINS):
        assert abs(sum(x.rate * x.n_tokens * x.posterior[k] for x in got) / total - mix_sources.TARGETS[d]) < (0.02 if mix_sources.TARGETS[d] else 0.1)
    kind = dict((i, k) for i, _, k in rows)
    assert np.mean([x.rate for x in got if kind.get(x.doc_id) == "toxic"]) < 0.3 < np.mean([x.rate for x in got if kind.get(x.doc_id) == "good"])
    share, drawn = mix_sources.achieved(mix_sources.mix(docs, docs, lab)), sum(x.rate * x.n_tokens for x in got)
    assert all(math.isclose(share[d], sum(x.rate * x.n_tokens * x.posterior[k] for x in got) / drawn) for k, d in enumerate(mix_sources.DOMAINS))
    assert mix_sources.mix(docs.limit(0), docs.limit(0), lab).count() == 0
    assert mix_sources.mix(docs, docs, lab.limit(0)).count() == 503


def plain_rates(p, n, ridge, rounds=60_000):
    """Projected gradient with momentum, as plain as can be."""
    n = n / n.sum()
    want = np.array([mix_sources.TARGETS[d] for d in mix_sources.DOMAINS])
    scale = np.where(want > 0, mix_sources.WEIGHT, 1) / (n @ p)
    r = at = np.ones(len(p))
    age = 1.0
    for _ in range(rounds):
        g = p @ (((at * n) @ p - want) * scale) + ridge * (at - 1)
        new = np.maximum(0, at - g / (mix_sources.WEIGHT + ridge))
        if (at - new) @ (new - r) > 0:
            age = 1.0
        if np.abs(new - r).max() < 1e-13:
            break
        later = (1 + math.sqrt(1 + 4 * age * age)) / 2
        at, r, age = new + (age - 1) / later * (new - r), new, later
    return r


@pytest.mark.parametrize("share,error", [(0.01, 0.0), (0.01, 0.02), (0.05, 0.005), (0.05, 0.02)])
def test_mixing_is_the_optimum(spark, share, error):
    r = np.random.default_rng(7)
    kind = r.choice(3, 2000, p=[0.6 - share, 0.4, share])
    p = np.eye(3)[kind]
    if error:
        e = np.minimum(0.3, r.exponential(error, len(p)))[:, None]
        other = 1 - p
        other *= r.random(p.shape)
        p = (1 - e) * p + e * other / other.sum(1, keepdims=True)
    rows = list(zip(r.integers(20, 400, len(p)).tolist(), p.tolist(), kind.tolist(), strict=True))
    scored = spark.createDataFrame(rows, "n_tokens long, posterior array<double>, kind int").coalesce(1).cache()
    for ridge in (mix_sources.RIDGE, 0.05):
        got = mix_sources.rates(scored, mix_sources.fit_rates(scored, ridge=ridge), ridge).collect()
        rate, n = np.array([x.rate for x in got]), np.array([x.n_tokens for x in got], float)
        want = plain_rates(p, n, ridge)
        assert np.abs(((rate - want) * n) @ p / n.sum()).max() < 1e-4
        if ridge == 0.05:  # what the pipeline drops
            assert np.abs(rate - want).max() < 1e-4 and (rate[kind == 2] <= 0.05).all() and (rate[kind != 2] <= 0.05).mean() <= 0.02


def test_mixing_on_given_documents(spark):
    """Totals of the given documents against a plain solver, on the posteriors that the classifier gives."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{at}/labels.parquet")
    got = mix_sources.mix(docs, docs, labels, keep_text=False).collect()
    rate, n, p = np.array([x.rate for x in got]), np.array([x.n_tokens for x in got], float), np.array([x.posterior for x in got])
    want = plain_rates(p, n, mix_sources.RIDGE)
    assert np.abs(((rate - want) * n) @ p / n.sum()).max() < 0.003 and (rate == 0).any()
    totals = (rate * n) @ p / n.sum()
    assert abs(totals[0] - 0.85) < 0.003 and abs(totals[1] - 0.15) < 0.003 and totals[2] < 0.5 * (n @ p)[2] / n.sum()


def test_lm_weights_learn_from_all_grams(monkeypatch):
    seen = []
    monkeypatch.setattr(lm_score.Model, "_step", lambda self, bits, nodes, slots, w: seen.append(w.sum()))
    g = np.arange(10 * lm_score.STEP, dtype=np.uint64)
    lm_score.Model().learn(g, np.ones(len(g), np.int64))
    assert sum(seen) == len(g)


def test_nearest_with_vectors_of_several_lengths(spark):
    rows = vectors()[:120]
    df = spark.createDataFrame([*rows, (3000, [1.0] * 4), (3020, [1.0] * 16)], "vec_id long, embedding array<float>")
    one = ann.Router(np.zeros((0, 1)))
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(df, F.col("vec_id") % 20 == 0, router=one).collect()}
    assert got == {(q, k + 1): i for q, near in exact(rows).items() for k, (_, i) in enumerate(near)}


def test_nearest_breaks_many_ties_by_id(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.float32(r.normal(size=8))]) for i in range(100)]
    same = [float(v) for v in np.float32(10 * np.array(rows[0][1]))]
    rows += [(i, same) for i in range(100, 400)]
    r.shuffle(rows)
    df = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in rows], "vec_id long, embedding array<float>")
    router = ann.fit(ann.usable(df).where("vec_id < 3"))  # one part
    got = ann.search(df, F.col("vec_id") % 20 == 0, router=router).collect()
    want = exact([(int(i), list(map(float, v))) for i, v in rows])
    assert {q: [x.vec_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] for q in want} == {q: [i for _, i in near] for q, near in want.items()}

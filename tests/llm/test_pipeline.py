"""corpus_pipeline.run() and its stages against plain Python, stage by stage on each stage's own input."""

import random

import pytest

import corpus_pipeline
from gridloom.llm import language_id, mix_sources
from tests.llm import brute
from tests.llm.test_texts import plain_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=6):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(400)]
    bench = [(i, " ".join(r.choices(vocab, k=14))) for i in range(4)]
    rows, labels = [], []
    for i in range(150):
        lines = [" ".join(r.choices(vocab, k=r.randint(8, 25))) for _ in range(r.randint(1, 4))]
        if i % 9 == 0:
            lines.append("all of these words stand at the end of many documents")
        if i % 25 == 3:
            lines.insert(1, bench[i % 4][1])
        if i % 10 == 4:
            lines = [x + " vile foul vile foul" for x in lines]
        elif i % 3 == 0:
            lines = [x + " click here buy now" for x in lines]
        if i % 12 == 5 and rows:
            lines = rows[-1][1].split("\n")
        labels.append((i, int(i % 3 != 0), int(i % 10 == 4)))
        rows.append((i, "\n".join(lines), "xx", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "xx", None, 0), (902, "12 !!", "xx", "s", 5), (None, "ab cd ef gh", "xx", "s", 9), (7, rows[7][1], "xx", "s", 1), (903, "abc de " * 40000, "xx", "s", 1)]
    return rows, bench, labels


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    rows, bench, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows, bench, labels


def test_stages_follow_one_another(spark, made):
    at, rows, bench, labels = made
    docs, before = spark.read.parquet(f"{at}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        out.write.parquet(f"{at}/out/{name}")
        before, docs = docs, spark.read.parquet(f"{at}/out/{name}")
        assert docs.columns[:5] == before.columns and (k == 4 or docs.columns == before.columns)
        had, got = [tuple(x) for x in before.collect()], key(docs.collect())
        if name == "language":
            model = language_id.fit(before)
            ok = {(x.doc_id, x.text) for x in language_id.predict(before, model).where("accepted").collect()}
            want = [x for x in had if x[:2] in ok]
            assert not {900, 901, 902} & {x[0] for x in want}
        elif name == "lines":
            kept = plain_lines([x[:2] for x in had])
            want = [(d, kept.get((d, t), t), *rest) for d, t, *rest in had]
        elif name == "near_duplicates":
            group = {d: c for d, _, c in brute.near([x[:2] for x in had if x[0] is not None], 5, 80)}
            want = [x for x in had if x[0] is None or group[x[0]] == x[0]]
        elif name == "benchmark":
            want = [x for x, hit in zip(had, brute.leaks([x[:2] for x in had], bench), strict=True) if not hit[5]]
        else:
            every = mix_sources.mix(before, before, spark.read.parquet(f"{at}/labels.parquet"), ridge=corpus_pipeline.LEAST_RATE)
            want = [x for x in every.collect() if x.rate > corpus_pipeline.LEAST_RATE]
            toxic = {d for d, _, t in labels if t}
            assert toxic & {x[0] for x in had} and not toxic & {x.doc_id for x in want}
        assert got == key(want), name
    assert key(corpus_pipeline.run(spark, at).collect()) == got


def test_clashing_columns_and_empty_tables(spark, made):
    at, rows, *_ = made
    more = "score double, accepted boolean, lang_pred string, items int, n_words int, spans int, nos int, row int, sig long, component_id long"
    docs = spark.createDataFrame([(*x, 0.5, None, "l", 1, 2, 3, 4, 5, 6, 7) for x in rows], f"{COLUMNS}, {more}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.columns[: len(docs.columns)] == docs.columns and {tuple(r)[5:15] for r in out.collect()} == {(0.5, None, "l", 1, 2, 3, 4, 5, 6, 7)}, name
        assert stage(spark, docs.limit(0), at).count() == 0, name

"""Token counts, WARC and line dedup against plain versions."""

import base64
import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import line_dedup, token_counts, warc
from gridloom.llm._work import Workspace

COUNTER = token_counts.Counter(token_counts.load())
TEXT = st.text(st.sampled_from("ab' s'll1 .\n\t é漢-"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70), TEXT), max_size=6))
def test_edits_keep_the_count(text, edits):
    tree = token_counts.Tree(COUNTER, text)
    for a, b, new in edits:
        a, b = min(a, b, len(text)), min(max(a, b), len(text))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text == text and tree.sums[1, 0] == len(text)
        assert tree.total == len(COUNTER.encoding.encode_ordinary(text))


def test_few_pieces_are_encoded_again():
    tree = token_counts.Tree(COUNTER, "The quick brown fox jumps over it. " * 2000)
    tree.edit(30000, 30005, "lazy")
    assert tree.encoded < 10 and tree.total == len(COUNTER.encoding.encode_ordinary(tree.text))


def test_counts(spark):
    rows = [(1, "Mail me: a.b@c.org or +1 (262) 555-3752."), (2, None), (3, ""), (None, "x"), (1, "x"), (5, "long " * 50000)]
    got = {(r.doc_id, r.n_pretokens): r for r in token_counts.count(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 6
    r = next(x for x in got.values() if x.n_edits)
    clean = "Mail me: [redacted] or [redacted]."
    assert (r.n_edits, r.n_tokens, r.n_tokens_edited) == (2, len(COUNTER.encoding.encode_ordinary(rows[0][1])), len(COUNTER.encoding.encode_ordinary(clean)))


def pages():
    r = random.Random(1)
    texts = ["<p>\r\n\r\n" + "x" * r.randint(0, 3000) + "é</p>" for _ in range(10)]
    return [(i, f"http://a/{i}", r.choice(texts)) for i in range(60)] + [(100, None, None), (101, "u\r\nWARC-Type: x", ""), (None, "v", texts[0]), (7, "w", texts[1])]


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20000)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = first.get(h or "")
        to = to if to is not None and to != p else None
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    uri, names = warc.archive(df)
    assert sorted(map(tuple, warc.read_pages(names, uri).collect()), key=str) == sorted(want, key=str)
    assert names.count() > 3
    for n in names.collect():  # every record is a member of its own, and the index tells where
        raw = open(f"{uri.removeprefix('file://')}/{n.name}", "rb").read()
        rows = warc.index_rows(uri, n.name)
        assert len(rows) == n.n_records and sum(x[1] for x in rows) == len(raw)
        for at, length, rid in rows:
            one = zlib.decompressobj(31)
            assert warc.parse(one.decompress(raw[at : at + length]))[0]["WARC-Record-ID"] == rid and one.eof and not one.unused_data
    ws = Workspace(spark, "t")
    assert warc.mark_revisits(df, ws, min_bytes=10**9).where("refers_to is not null").count() == 0
    assert warc.mark_revisits(df, Workspace(spark, "t"), broadcast_rows=0).where("refers_to is not null").count() == sum(x[3] == "revisit" for x in want)
    uri, names = warc.archive(df.limit(0))
    assert warc.read_pages(names, uri).count() == 0


def plain_lines(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    seen, out = [], {}
    for d, text in sorted(x for x in set(rows) if None not in x):
        kept = []
        for no, line in enumerate(text.split("\n")):
            words = set(line.translate(low).split())
            if words:
                hit = any(100 * len(words & w) >= 80 * len(words | w) for k, w in seen if k < (d, no))
                seen.append(((d, no), words))
                if hit:
                    continue
            kept.append(line)
        out[d, text] = "\n".join(kept)
    return out


def test_lines(spark, monkeypatch):
    r = random.Random(5)
    vocab = [f"{a}{b}" for a in "abcdef" for b in "xyzuvw"]
    base = [r.choices(vocab, k=r.randint(3, 25)) for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(0, 8)):
            w = list(r.choice(base)) if r.random() < 0.6 else r.choices(vocab, k=r.randint(1, 30))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            lines.append(r.choice([" ", "\t "]).join(w).title())
        rows.append((i, "\n".join(lines)))
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, rows[3][1]), (rows[3][0], rows[3][1]), (303, "one two three four " * 5000)]
    want = plain_lines(rows)
    df = spark.createDataFrame([(*x, "no") for x in rows], "doc_id long, text string, nos string").repartition(4)
    for salt_at in (line_dedup.SALT_AT, 4):
        monkeypatch.setattr(line_dedup, "SALT_AT", salt_at)
        monkeypatch.setattr(line_dedup, "CLASS_AT", salt_at)
        got = line_dedup.dedup_lines(df)
        assert got.columns == df.columns and got.count() == len(rows)
        before = sorted(((d, want.get((d, t), t)) for d, t in rows), key=str)
        assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == before
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_short_lines_take_part(spark):
    rows = [(1, "Yes.\n\none two three four\n漢字仮名\na b"), (2, "yes.\n \nfour three two one\n漢字仮名\na c\none two three four five"), (3, "\nb a\n\nnew")]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: " \na c", 3: "\n\nnew"}


def test_words_of_lines_sort_as_numbers_once_a_distinct_line(spark, monkeypatch):
    """Arrays of words hold no null by their type, for which Spark would sort objects, and lines that repeat are split into words once."""
    seen, prefixes = [], line_dedup.prefixes
    monkeypatch.setattr(line_dedup, "prefixes", lambda lines, levels: seen.append((lines.count(), prefixes(lines, levels))) or seen[-1][1])
    df = spark.createDataFrame([(i, f"one line of all\nline {i} alone") for i in range(30)], "doc_id long, text string")
    kept = {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()}
    assert kept[0].startswith("one line of all\n") and all(kept[i] == f"line {i} alone" for i in range(1, 30))
    ((n, sets),) = seen
    assert n == 31 and not sets.schema["toks"].dataType.containsNull and not sets.schema["family"].dataType.containsNull


def test_lines_meet_by_one_shuffle(spark):
    """A list is dealt once to those that look and once to those that are found; families and very long lines lose no match."""
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(900)]
    rows = [(i, " ".join(r.choices(vocab, k=r.randint(20, 70)))) for i in range(100)]
    base = r.choices(vocab, k=400)
    for i in range(100, 160):
        w, v = list(base), vocab[:12]
        for _ in range(r.randint(0, 60)):
            w[r.randrange(len(w))] = r.choice(vocab)
        v[r.randrange(12)] = r.choice(vocab)
        rows.append((i, " ".join(w) + "\n" + " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    lines = line_dedup.lines_of(df.selectExpr("doc_id", "0L as row", "text"))
    sets = line_dedup.prefixes(lines, line_dedup.rarity(lines)).selectExpr("doc_id as id", "n", "bits", "half", "0 as settled", "toks")
    plan = line_dedup.met(sets, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan and "Union" not in plan
    want = plain_lines(rows)
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == {d: want[d, t] for d, t in rows}
    assert sum(t != want[d, t] for d, t in rows) > 50


def test_near_copies_are_not_tried_in_pairs(spark, monkeypatch):
    """Candidates of a group of near copies follow its size, not its square."""
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(2000)]
    base, n = r.sample(vocab, 80), 240
    rows = []
    for i in r.sample(range(1000), n):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    tried, table = [], Workspace.table

    def count(self, name, df, wide=False):
        out = table(self, name, df, wide)
        if name.startswith("far") and name[3:].isdigit() or name.endswith("-pairs"):
            tried.append(out.count())
        return out

    monkeypatch.setattr(Workspace, "table", count)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = plain_lines(rows)
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(df).collect()} == {d: want[d, t] for d, t in rows}
    assert len(tried) == 2 + line_dedup.PASSES and sum(tried) < 16 * n


def test_every_text_is_counted_by_its_tree(monkeypatch):
    built = []

    class Tree(token_counts.Tree):
        def __init__(self, counter, text):
            built.append(text)
            super().__init__(counter, text)

    monkeypatch.setattr(token_counts, "Tree", Tree)
    text = "no personal data here"
    n = len(COUNTER.encoding.encode_ordinary(text))
    assert token_counts.row(COUNTER, 4, text, []) == (4, n, len(COUNTER.pattern.findall(text)), 0, n, 0)
    assert built == [text] and token_counts.row(COUNTER, 5, "", []) == (5, 0, 0, 0, 0, 0)

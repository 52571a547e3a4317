"""Source divergence audit: how far apart the sources of a language are, and by which terms each stands out.

1. Tasks tokenise bytes: a lookup table over the concatenated UTF-8 buffers finds where terms begin and end, XXH64 (computed
   for all slices of a piece at once) groups equal slices, and their bytes are compared before they count as one term.
   A block of documents is summed to one count for each (language, source, term) before anything is shuffled.
2. Terms are dealt to buckets by their hash, so that a frequent term or a large language is no task's burden. A bucket of a
   language becomes a CSR matrix of sources by kept terms, one row of a table.
3. With the sums of all buckets, each matrix gives its share of every pair's divergence (sums over CSR rows by reduceat; terms that
   both sources lack are settled by one product) and its best terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._bytes import LOWER, blob, column, groups
from gridloom.llm._exchange import bucket_of, n_buckets
from gridloom.llm._work import Workspace, text_bytes

#: Term characters: letters a-z and everything beyond ASCII.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True
#: Bytes of text that are tokenised at once, and that are summed before they are sent.
PIECE = 1 << 20
BLOCK = 8 << 20
#: Bytes of text whose matrices one task holds against each other, and sums and terms that it holds before it sends them.
SHARE = 64 << 20
HELD = 1 << 18
SCALE_STEPS = 3  # p is in parts of 1000 ** 3
SCHEMA = "lang string, bucket long, sources array<string>, source binary, n binary, df binary, size binary, terms binary"
CELLS = "lang string, bucket long, sources array<string>, totals array<long>, v long, indptr binary, indices binary, counts binary, size binary, terms binary"

_U = np.uint64
#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << _U(k)) | (x >> _U(64 - k))


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position of data on, as a number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.array(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))


def slice_hashes(data: np.ndarray, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each data[start:start + size]."""
    h = size.astype(_U) + P5
    for k in range(3):
        i = np.flatnonzero((size >= 8 * k + 8) & (size < 32))
        if not len(i):
            break
        h[i] = _turn(h[i] ^ (_turn(lanes[start[i] + 8 * k] * P2, 31) * P1), 27) * P1 + P4
    at = start + (size & ~7)
    i = np.flatnonzero(size & 4)
    h[i] = _turn(h[i] ^ ((lanes[at[i]] & _U(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[i] += 4
    for k in range(3):
        i = np.flatnonzero((size & 3) > k)
        h[i] = _turn(h[i] ^ ((lanes[at[i] + k] & _U(255)) * P5), 11) * P1
    h ^= h >> _U(33)
    h *= P2
    h ^= h >> _U(29)
    h *= P3
    h ^= h >> _U(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return h


def _equal(lanes: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a on are the m bytes from b on."""
    ok = n == m
    live, k = np.flatnonzero(ok & (a != b)), 0
    while len(live):
        x = lanes[a[live] + k] ^ lanes[b[live] + k]
        left = n[live] - k
        x <<= (8 * np.maximum(8 - left, 0)).astype(_U)  # bytes beyond the end don't count
        ok[live[x != 0]] = False
        k += 8
        live = live[(x == 0) & (left > 8)]
    return ok


def distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first place of each distinct slice, the number of every slice's class, and hashes of the classes."""
    lanes = lanes_of(data)
    h = slice_hashes(data, lanes, start, size)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    run = np.cumsum(new) - 1
    lead = order[new]
    own = np.empty(len(h), np.int64)
    own[order] = run
    other = np.flatnonzero(~_equal(lanes, start, start[lead[own]], size, size[lead[own]])) if len(h) else np.zeros(0, np.int64)
    if len(other):  # different bytes under one hash: they get classes of their own
        found: dict[tuple[int, bytes], int] = {}
        first = lead.tolist()
        for i in other.tolist():
            key = int(own[i]), data[start[i] : start[i] + size[i]].tobytes()
            if key not in found:
                found[key] = len(first)
                first.append(i)
            own[i] = found[key]
        lead = np.array(first)
    return lead, own, h[lead]


def slices(data: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every term of data; a term ends where a document does."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[docs] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1 - start


def _take(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices one after another."""
    total = np.cumsum(size)
    return data[np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)]


def _sums(group: np.ndarray, term: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, term and the sum of each of values, for every pair that occurs."""
    order = np.lexsort((term, group))
    g, t = group[order], term[order]
    at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])))) if len(g) else np.zeros(0, np.int64)
    return g[at], t[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values)


def _counted(data: np.ndarray, docs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one piece: group, occurrences, documents, size and bytes of each term of each group."""
    start, size = slices(data, docs)
    lead, own, _ = distinct(data, start, size)
    doc = np.searchsorted(docs, start, "right") - 1
    d, t, n = _sums(doc, own, np.ones(len(doc), np.int64))
    g, t, n, df = _sums(group[d], t, n, np.ones(len(d), np.int64))
    return g, n, df, size[lead[t]], _take(data, start[lead[t]], size[lead[t]])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(a, b, lo, hi): documents a..b and their bytes; a document beyond PIECE comes in parts that end where no term does."""
    for a, b in groups(offsets, PIECE):
        lo, hi = int(offsets[a]), int(offsets[b])
        while hi - lo > 2 * PIECE:
            cut = lo + PIECE
            while cut < hi and not len(gap := np.flatnonzero(~TERM[data[cut : cut + PIECE]])):
                cut += PIECE
            cut = min(hi, cut + int(gap[0]) if cut < hi else hi)
            yield a, b, lo, cut
            lo = cut
        yield a, b, lo, hi


class _Block:
    """Counts of the documents seen since the last send."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def merged(self) -> tuple[np.ndarray, ...]:
        g, n, df, size, terms = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        start = np.cumsum(size) - size
        lead, own, h = distinct(terms, start, size)
        g, t, n, df = _sums(g, own, n, df)
        return g, n, df, size[lead[t]], start[lead[t]], h[t], terms


def _block_rows(block: _Block, n_buckets: int) -> Iterator[tuple]:
    names = list(block.groups)
    langs = list(dict.fromkeys(x[0] for x in names))
    lang_of = np.array([langs.index(x[0]) for x in names])
    g, n, df, size, start, h, terms = block.merged()
    bucket = bucket_of(h, n_buckets).astype(np.int64)
    lang = lang_of[g]
    order = np.lexsort((g, bucket, lang))
    key = (lang * n_buckets + bucket)[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    done = set()
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True) if len(cut) else ():
        at = order[i:j]
        b, k = int(bucket[at[0]]), int(lang[at[0]])
        used, local = np.unique(g[at], return_inverse=True)
        if b == 0:  # the first bucket of a language names all its sources
            done.add(k)
            used = np.flatnonzero(lang_of == k)
            local = np.searchsorted(used, g[at])
        yield langs[k], b, [names[x][1] for x in used.tolist()], blob(local.astype(np.int32)), blob(n[at]), blob(df[at]), blob(size[at].astype(np.int32)), blob(_take(terms, start[at], size[at]))
    for k in set(range(len(langs))) - done:
        yield langs[k], 0, [x[1] for x in names if x[0] == langs[k]], b"", b"", b"", b"", b""


def _counts(n_buckets: int):
    """From (text, lang, source): a row for each language and bucket of each block."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("sources", pa.list_(pa.string())), *((c, pa.binary()) for c in ("source", "n", "df", "size", "terms"))])

    def send(block: _Block):
        if block.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_block_rows(block, n_buckets), strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        block = _Block()
        for batch in batches:
            data, offsets = column(batch.column(0))
            own = np.array([block.groups.setdefault(x, len(block.groups)) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
            seen: dict[bytes, None] = {}
            for a, b, lo, hi in _pieces(data, offsets):
                part = _counted(LOWER[data[lo:hi]], np.clip(offsets[a : b + 1] - lo, 0, hi - lo), own[a:b])
                if hi - lo < offsets[b] - offsets[a]:  # a part of one long document, which counts once
                    g, n, df, size, terms = part
                    ends = np.cumsum(size).tolist()
                    for i, (x, y) in enumerate(zip([0, *ends], ends)):  # noqa: B905
                        df[i] = (w := terms[x:y].tobytes()) not in seen
                        seen[w] = None
                    if hi == offsets[b]:
                        seen = {}
                block.parts.append(part)
                block.bytes += hi - lo
                if block.bytes >= BLOCK and not seen:
                    yield from send(block)
                    block = _Block()
                    own = np.array([block.groups.setdefault(x, len(block.groups)) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
        yield from send(block)

    return run


def _matrix(min_docs: int):
    """Of one language's bucket: a CSR matrix of sources by the terms that occur in enough documents, terms in order of their bytes."""

    def run(table: pa.Table) -> pa.Table:
        names = sorted({s for x in table.column("sources").to_pylist() for s in x})
        place = {s: i for i, s in enumerate(names)}
        source = np.concatenate([np.array([place[s] for s in x], np.int64)[np.frombuffer(i, np.int32)] for x, i in zip(table.column("sources").to_pylist(), table.column("source").to_pylist(), strict=True)])
        n, df, size, terms = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("n", np.int64), ("df", np.int64), ("size", np.int32), ("terms", np.uint8)))
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        lead, own, _ = distinct(terms, start, size)
        source, own, n, df = _sums(source, own, n, df)
        kept = np.flatnonzero(np.bincount(own, df, len(lead)) >= min_docs)
        words = [terms[a : a + m].tobytes() for a, m in zip(start[lead[kept]].tolist(), size[lead[kept]].tolist(), strict=True)]
        by_bytes = sorted(range(len(words)), key=words.__getitem__)
        rank = np.full(len(lead), -1)
        rank[kept[by_bytes]] = np.arange(len(kept))
        here = rank[own] >= 0
        source, column, n = source[here], rank[own[here]], n[here]
        order = np.lexsort((column, source))
        lengths = np.bincount(source, minlength=len(names))
        totals = np.zeros(len(names), np.int64)
        np.add.at(totals, source, n)
        words = [words[i] for i in by_bytes]
        row = {"lang": table.column("lang")[0].as_py(), "bucket": table.column("bucket")[0].as_py(), "sources": names, "totals": totals.tolist(), "v": len(words)}
        row |= {"indptr": blob(np.concatenate(([0], np.cumsum(lengths)))), "indices": blob(column[order].astype(np.int32)), "counts": blob(n[order])}
        row |= {"size": blob(np.array([len(w) for w in words], np.int32)), "terms": b"".join(words)}
        kinds = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("v", pa.int64()), *((c, pa.binary()) for c in ("indptr", "indices", "counts", "size", "terms"))])
        return pa.Table.from_pylist([row], schema=kinds)

    return run


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 * count / total), exactly: long division by thousands, so that nothing passes 63 bits while total is below 9 * 10**15."""
    r, q = np.asarray(count, np.int64), 0
    for _ in range(SCALE_STEPS):
        r = r * 1000
        d = r // total
        q = q * 1000 + d
        r = r - d * total
    return 1 + q


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _parts(top: int):
    """What the matrices of a task add to the divergence of pairs, and their best terms: summed, and cut to the best, before they leave it."""

    def run(batches):
        pairs: dict[tuple[str, str, str], int] = {}
        terms: dict[tuple[str, str], list[tuple[int, bytes, str]]] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                for source, part, item, value in _one(row, top):
                    if part == "pair":
                        key = row["lang"], source, item
                        pairs[key] = pairs.get(key, 0) + value
                    else:
                        terms.setdefault((row["lang"], source), []).append((-value, item.encode(), item))
                for key in [k for k in terms if k[0] == row["lang"]]:
                    if len(terms[key]) > top:
                        terms[key] = sorted(terms[key])[:top]
                if len(pairs) + top * len(terms) > HELD:
                    yield _sent(pairs, terms)
                    pairs, terms = {}, {}
        yield _sent(pairs, terms)

    return run


def _sent(pairs: dict, terms: dict) -> pa.RecordBatch:
    rows = [(lang, source, "pair", item, value) for (lang, source, item), value in pairs.items()]
    rows += [(lang, source, "term", item, -value) for (lang, source), best in terms.items() for value, _, item in best]
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], ["lang", "source", "part", "item", "value"])


def _one(row: dict, top: int) -> list[tuple[str, str, str, int]]:
    """source, part, item and value of one matrix."""
    names = [x["source"] for x in row["all"]]
    total = np.array([x["n"] for x in row["all"]], np.int64)
    T, V = row["v"], row["v_all"]
    indptr, indices, counts, size = (np.frombuffer(row[c], kind) for c, kind in (("indptr", np.int64), ("indices", np.int32), ("counts", np.int64), ("size", np.int32)))
    S, own = len(names), {s: i for i, s in enumerate(row["sources"])}
    out: list[tuple] = []
    if not V:
        out = [(a, "pair", b, 0) for a in names for b in names if a != b] if row["bucket"] == 0 else []
    elif T:
        length = np.zeros(S, np.int64)
        begin = np.zeros(S, np.int64)
        for i, s in enumerate(names):
            if s in own:
                begin[i], length[i] = indptr[own[s]], indptr[own[s] + 1] - indptr[own[s]]
        source = np.repeat(np.arange(S), length)  # sources stand in one order in both
        ends = np.cumsum(length)
        none = share(np.ones(S, np.int64), total + V)  # p of a term that a source lacks
        p = share(counts + 1, (total + V)[source])
        p_none = none[source]
        some = np.flatnonzero(length)
        for a in range(S):
            mine = slice(int(ends[a] - length[a]), int(ends[a]))
            dense = np.full(T, none[a])
            dense[indices[mine]] = p[mine]
            x = dense[indices]
            d = np.zeros(S, np.int64)
            if len(some):
                d[some] = np.add.reduceat(apart(x, p) - apart(x, p_none), (ends - length)[some])
            d += (T - int(length[a])) * apart(none[a], none)
            for k in range(0, int(length[a]), step := max(1, (1 << 20) // S)):
                d += apart(p[mine][k : k + step, None], none).sum(0)
            out += [(names[a], "pair", names[b], int(d[b])) for b in range(S) if b != a]
        both = np.zeros(T, np.int64)
        np.add.at(both, indices, counts)
        q = share(both + 1, int(total.sum()) + V)[indices]
        f = np.where(p > q, apart(p, q), -1)
        at, text = np.concatenate(([0], np.cumsum(size, dtype=np.int64))), row["terms"]
        for a in some.tolist():
            i = np.arange(ends[a] - length[a], ends[a])
            i = i[f[i] >= 0]
            i = i[np.lexsort((indices[i], -f[i]))[:top]]
            out += [(names[a], "term", text[at[t] : at[t + 1]].decode(), v) for t, v in zip(indices[i].tolist(), f[i].tolist(), strict=True)]
    return out


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: see the query's contract in op13_source_audit.

    docs needs text, lang and source; other columns, whatever their names, don't matter. Null text, lang and source count as ''. An
    empty table gives no rows, a language without kept terms pairs of value 0, and a language with one source no pairs. Repeated
    rows are documents of their own. Ties go by the bytes of the item. A very long text is read in pieces and counts as one document.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "audit")
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    size = text_bytes(docs)
    n = n_buckets(spark, size)
    sent = docs.mapInArrow(_counts(n), SCHEMA)
    cells = ws.table("cells", sent.groupBy("lang", "bucket").applyInArrow(_matrix(min_docs), CELLS))
    ws.drop()
    group = cells.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("n"))
    kept = cells.groupBy("lang").agg(F.sum("v").alias("v_all"))
    known = group.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all")).join(kept, "lang")
    # sums are one row a language, so they go to all tasks; these are as many as the text needs, whatever the number of buckets
    shares = cells.join(F.broadcast(known), "lang").coalesce(max(1, size // SHARE))
    parts = ws.table("parts", shares.mapInArrow(_parts(top), "lang string, source string, part string, item string, value long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of each language of documents, and the terms by which a source stands out from its language.

    Terms are runs of letters and of bytes beyond ASCII, A-Z in lower case; a language keeps those of 3 documents or more. part 'pair': item is another
    source, value the divergence from it; part 'term': item is a term more frequent than in the language, the first 200 by value.
    """
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))

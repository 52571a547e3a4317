"""Near-duplicate documents: an exact n-gram Jaccard join by T-occurrence search (DivideSkip).

1. Each document's set of k-word shingles becomes 64-bit numbers. Keys are dealt to buckets; a bucket tells each
   document how many of its shingles stand in another set too. A document with fewer than ceil(t * n) such shingles has no
   link and goes no further. Equal sets count once from here on.
2. A count sketch of fixed size orders shingles by rarity. Two linked sets share a shingle among the n - ceil(t * n) + 1 first
   ones; within the list of such a shingle, pairs whose sizes and 32 bin counts leave a link possible join a family.
3. Each family is searched whole: inverted lists, short ones merged, long ones probed by binary search. Families beyond
   FAMILY_BYTES are dealt as pairs of blocks, so that no task holds more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._bytes import MIX, NONSPACE, blob, column, groups, mix, rolling, words
from gridloom.llm._components import components
from gridloom.llm._exchange import TARGET, block_ids, bucket_of, cuts, n_buckets
from gridloom.llm._work import Workspace, text_bytes

SKETCH_BITS = 20
CHUNKS = 16
BINS = 32
#: Lists up to this length have all their pairs looked at, longer ones only as far as they aren't connected yet.
SHORT_LIST = 32
FAMILY_BYTES = 48 << 20
#: Rows of two longs; up to so many go by broadcast, more by a shuffle join.
BROADCAST_ROWS = 500_000


def need(n, t: int):
    """Least overlap that a set of n shingles has with any set it links to, at t percent."""
    return -(-(t * n) // 100)


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle numbers of each document."""
    _, _, h, first = words(data, offsets, NONSPACE)
    r = rolling(h, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        x = r[a : b - k + 1] if b - a >= k else rolling(h[a:b], b - a) if b > a else r[:0]
        out.append(np.unique(x))
    return out


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    y = mix(x + MIX[7])
    return tuple(int(v.view(np.int64)) for v in (np.add.reduce(x * MIX[9], dtype=np.uint64) ^ MIX[len(x) % 256], np.add.reduce(y, dtype=np.uint64) + np.uint64(len(x))))


def _requests(k: int, n: int):
    """Blocks of documents: a header row (bucket < 0) with ids, sizes and signatures, and a row of keys for each bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary()), ("rest", pa.binary())])

    def run(batches):
        ids = block_ids()
        for batch in batches:
            data, offsets = column(batch.column(1))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in groups(offsets, 1 << 20):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sig = np.array([signature(x) for x in sets], np.int64).reshape(-1, 2)
                _, first, own = np.unique(sig, axis=0, return_index=True, return_inverse=True)  # equal sets of a block count once
                block, size = next(ids), np.array([len(x) for x in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([-1 - block % n]), pa.array([block]), pa.array([blob(doc[a:b].astype(np.int64))]), pa.array([blob(np.column_stack((size, sig)))]), pa.array([blob(own.reshape(-1).astype(np.int64))])], schema=schema)
                if not len(first):
                    continue
                keys = np.concatenate([sets[i] for i in first])
                local = np.repeat(np.arange(len(first), dtype=np.uint16 if len(first) < 65536 else np.uint32), size[first])
                order = np.argsort(keys)
                keys, local = keys[order], local[order]
                rows = list(cuts(keys, n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([block] * len(rows)), pa.array([blob(keys[i:j]) for _, i, j in rows]), pa.array([blob(local[i:j]) for _, i, j in rows]), pa.array([len(first).to_bytes(8, "little")] * len(rows))], schema=schema)

    return run


def _shared_counts(table: pa.Table) -> pa.Table:
    """For each block of a bucket, how many keys of each of its sets stand in another set as well."""
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        return table.select(["bucket", "block", "keys", "docs", "rest"])
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    allk = np.sort(np.concatenate(keys))
    same = allk[1:] == allk[:-1]
    many = np.unique(allk[1:][same])
    out = []
    for x, docs, rest in zip(keys, table.column("docs").to_pylist(), table.column("rest").to_pylist(), strict=True):
        n = int.from_bytes(rest, "little")
        local = np.frombuffer(docs, np.uint16 if n < 65536 else np.uint32)
        i = np.searchsorted(many, x) if len(many) else None
        hit = many[np.minimum(i, len(many) - 1)] == x if len(many) else np.zeros(len(x), bool)
        out.append(blob(np.bincount(local[hit], minlength=n).astype(np.uint32)))
    return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "keys": pa.array(out, pa.binary()), "docs": pa.array([None] * len(out), pa.binary()), "rest": pa.array([None] * len(out), pa.binary())})


def _decide(t: int):
    def run(table: pa.Table) -> pa.Table:
        total, head = None, None
        for bucket, keys, docs, rest in zip(*(table.column(c).to_pylist() for c in ("bucket", "keys", "docs", "rest")), strict=True):
            if bucket < 0:
                head = np.frombuffer(keys, np.int64), np.frombuffer(docs, np.int64).reshape(-1, 3), np.frombuffer(rest, np.int64)
            else:
                x = np.frombuffer(keys, np.uint32).astype(np.int64)
                total = x if total is None else total + x
        doc, m, own = head
        got = total[own] if total is not None else np.zeros(len(doc), np.int64)
        active = (m[:, 0] > 0) & (got >= need(m[:, 0], t))
        return pa.table({"doc_id": doc, "n": m[:, 0], "hi": m[:, 1], "lo": m[:, 2], "active": active})

    return run


def _sets(k: int):
    """The sets of the documents that stand for their signature."""

    def run(batches):
        for batch in batches:
            data, offsets = column(batch.column(1))
            want = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for a, b in groups(offsets, 1 << 20):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                keep = [(i, x) for i, x in zip(range(a, b), sets, strict=True) if signature(x) == (want[1][i], want[2][i])]
                yield pa.RecordBatch.from_arrays([pa.array([want[0][i] for i, _ in keep], pa.int64()), pa.array([len(x) for _, x in keep], pa.int64()), pa.array([blob(x) for _, x in keep], pa.binary())], ["rep", "n", "keys"])

    return run


def _sketch(batches):
    """Counts of hashed shingles, in chunks."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(x, np.uint64) >> np.uint64(64 - SKETCH_BITS), minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS)), pa.array([blob(x) for x in np.split(total, CHUNKS)])], ["chunk", "counts"])


def _sum_chunks(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[c] = total.get(c, 0) + np.frombuffer(x, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([blob(x) for x in total.values()], pa.binary())], ["chunk", "counts"])


def rarity(keys: DataFrame, parts: int = CHUNKS) -> np.ndarray:
    """How often keys of each hash value occur in all sets (packed in a column): 2**SKETCH_BITS counts, whatever the input."""
    got = keys.mapInArrow(_sketch, "chunk long, counts binary").repartition(parts, "chunk").mapInArrow(_sum_chunks, "chunk long, counts binary").collect()
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in got:
        total[r.chunk * (len(total) // CHUNKS) :][: len(total) // CHUNKS] += np.frombuffer(r.counts, np.int64)
    return total


def _postings(shared, t: int, n: int):
    def run(batches):
        counts = shared.value
        for batch in batches:
            rep, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(2).to_pylist()]
            got, bins = [], np.zeros((len(sets), BINS), np.uint8)
            for i, x in enumerate(sets):
                p = int(len(x) - need(len(x), t) + 1)
                c = counts[x >> np.uint64(64 - SKETCH_BITS)]
                order = np.lexsort((x, c))[:p]
                got.append(x[order])
                bins[i] = np.minimum(np.bincount(mix(x) & np.uint64(BINS - 1), minlength=BINS), 255)
            keys = np.concatenate(got) if got else np.zeros(0, np.uint64)
            own = np.repeat(np.arange(len(sets)), [len(x) for x in got])
            order = np.argsort(keys, kind="stable")
            keys, own = keys[order], own[order]
            rows = list(cuts(keys, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([blob(keys[i:j]) for _, i, j in rows], pa.binary()), *(pa.array([blob(col[own[i:j]]) for _, i, j in rows], pa.binary()) for col in (rep, size, bins))], ["bucket", "keys", "reps", "sizes", "bins"])

    return run


def _may_link(n1, b1, n2, b2, t: int) -> np.ndarray:
    """Whether sizes and bin counts leave a link possible: their L1 distance never exceeds the symmetric difference."""
    apart = np.abs(b1.astype(np.int16) - b2).sum(-1, dtype=np.int64)
    return (np.minimum(n1, n2) * 100 >= t * np.maximum(n1, n2)) & (apart * (100 + t) <= (100 - t) * (n1 + n2))


def families(t: int, n_bins: int = BINS, sizes=np.int64):
    """Spanning edges of the may-link graph within each list of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        keys, rep, size = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("keys", np.uint64), ("reps", np.int64), ("sizes", sizes)))
        bins = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("bins").to_pylist()]).reshape(-1, n_bins)
        size = size.astype(np.int64)
        order = np.lexsort((rep, keys))
        keys, rep = keys[order], rep[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (rep[1:] != rep[:-1])))  # a set that several blocks sent counts once
        keys, rep, size, bins = keys[new], rep[new], size[order][new], bins[order][new]
        at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        start, length = at[:-1], np.diff(at)
        edges = [np.zeros((0, 2), np.int64)]
        short = np.repeat(length <= SHORT_LIST, length)
        for d in range(1, SHORT_LIST):  # all pairs of the short lists, by distance
            near = np.flatnonzero(short[d:] & (keys[d:] == keys[:-d]))
            if not len(near):
                break
            near = near[np.minimum(size[near], size[near + d]) * 100 >= t * np.maximum(size[near], size[near + d])]
            for c in range(0, len(near), 1 << 17):
                i = near[c : c + (1 << 17)]
                i = i[_may_link(size[i], bins[i], size[i + d], bins[i + d], t)]
                edges.append(np.column_stack((rep[i], rep[i + d])))
        seen = set()
        for s, m in zip(start[length > SHORT_LIST].tolist(), length[length > SHORT_LIST].tolist(), strict=True):
            own = rep[s : s + m]
            if (mark := (m, hash(own.tobytes()))) in seen:  # many shingles stand in the very same sets
                continue
            seen.add(mark)
            edges.append(_spanning(own, size[s : s + m], bins[s : s + m], t))
        e = np.unique(np.concatenate(edges), axis=0)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return run


def _spanning(rep: np.ndarray, size: np.ndarray, bins: np.ndarray, t: int) -> np.ndarray:
    rest, out = np.arange(len(rep)), []
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            ok = _may_link(size[i], bins[i], size[rest], bins[rest], t)
            out += [(rep[i], x) for x in rep[rest[ok]]]
            todo += rest[ok].tolist()
            rest = rest[~ok]
    return np.array(out, np.int64).reshape(-1, 2)


def search(rep: np.ndarray, sets: list[np.ndarray], t: int, mu: float = 0.02) -> np.ndarray:
    """(rep, root): each set that is linked, directly or by way of others, with the smallest rep of its group.

    T-occurrence search: sets go by size; those before the query that are long enough are its candidates. A candidate must occur in
    T = ceil(t * n) of the query's n inverted lists, or more by its own size. The longest T / (mu * log2(M) + 1) lists are set aside,
    the others merged, and what occurs in enough of them is probed by binary search in the long ones. Sets already in
    the query's group are not probed again.
    """
    size = np.array([len(x) for x in sets])
    order = np.lexsort((rep, size))
    rep, sets, size = rep[order], [sets[i] for i in order], size[order]
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(ids, kind="stable")
    lists, ends = owner[by], np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(tokens)))))
    ids = np.split(ids, np.cumsum(size)[:-1])
    root = np.arange(len(sets))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    for q in range(1, len(sets)):
        n, own = int(size[q]), ids[q]
        T, lo = int(need(n, t)), int(np.searchsorted(size[:q], need(n, t)))
        if lo == q:
            continue
        a, b = ends[own], ends[own + 1]
        by_len = np.argsort(b - a, kind="stable")
        longest = int(b[by_len[-1]] - a[by_len[-1]])
        aside = min(T - 1, int(T / (mu * np.log2(max(2, longest)) + 1)))
        short, long = by_len[: n - aside], by_len[n - aside :]
        merged = np.concatenate([lists[a[i] : b[i]] for i in short.tolist()])
        merged = np.sort(merged[(merged >= lo) & (merged < q)], kind="stable")
        if not len(merged):
            continue
        cand, times = np.unique(merged, return_counts=True)
        ok = times >= T - aside
        cand, times = cand[ok], times[ok]
        probes = np.sort(own[long])
        for c, had in zip(cand.tolist(), times.tolist(), strict=True):
            if top(c) == top(q):
                continue
            other = ids[c]
            at = np.minimum(np.searchsorted(other, probes), len(other) - 1)
            both = had + int((other[at] == probes).sum())
            if 100 * both >= t * (n + len(other) - both):
                x, y = sorted((top(c), top(q)))
                root[y] = x
    roots = np.array([top(i) for i in range(len(sets))])
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, rep)
    out = np.column_stack((rep, least[roots]))
    return out[out[:, 0] != out[:, 1]]


def _search_group(t: int):
    def run(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        rep, first = np.unique(rep, return_index=True)
        keys = table.column("keys")
        out = search(rep, [np.frombuffer(keys[int(i)].as_py(), np.uint64) for i in first], t)
        return pa.table({"a": out[:, 1], "b": out[:, 0]})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, t: int = 80, broadcast_rows: int = BROADCAST_ROWS, family_bytes: int = FAMILY_BYTES) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of docs (doc_id, text).

    Documents link when 100 * intersection >= t * union of their sets of k-word shingles; component_id is the smallest doc_id
    reachable. A text of fewer words is one shingle; one without words, or null, links with nothing. Rows with a null doc_id
    have their number of shingles and a null component_id, and link with nothing. A doc_id that occurs on several rows is one node, with the links
    of all of them, but each row keeps its own set.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    size = text_bytes(known)
    n = n_buckets(spark, 1.6 * size)
    sent = known.mapInArrow(_requests(k, n), "bucket long, block long, keys binary, docs binary, rest binary")
    got = ws.table("counts", sent.groupBy("bucket").applyInArrow(_shared_counts, "bucket long, block long, keys binary, docs binary, rest binary"))
    all_docs = ws.table("docs", got.groupBy("block").applyInArrow(_decide(t), "doc_id long, n long, hi long, lo long, active boolean"))
    ws.drop("counts")

    reps = ws.table("reps", all_docs.where("active").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    ids = reps.select("doc_id", "hi", "lo")
    if reps.count() <= broadcast_rows:
        ids = F.broadcast(ids)
    sets = ws.table("sets", known.join(ids, "doc_id").select("doc_id", "text", "hi", "lo").mapInArrow(_sets(k), "rep long, n long, keys binary"))
    ws.drop()
    total = int(sets.agg(F.sum("n")).first()[0] or 0)
    shared = spark.sparkContext.broadcast(rarity(sets.select("keys")))
    n = n_buckets(spark, 56 * total * (101 - t) / 100)
    posted = sets.mapInArrow(_postings(shared, t, n), "bucket long, keys binary, reps binary, sizes binary, bins binary")
    candidates = ws.table("candidates", posted.groupBy("bucket").applyInArrow(families(t), "a long, b long"))
    family = ws.table("family", components(candidates).withColumnsRenamed({"node": "rep", "component": "family"}))
    ws.drop()
    members = sets.join(family, "rep")
    weight = members.groupBy("family").agg(F.sum(8 * F.col("n")).alias("bytes"))
    blocks = weight.select("family", F.ceil(F.col("bytes") / family_bytes).cast("int").alias("g"))
    members = members.join(blocks, "family").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    # of a family in g blocks, each pair of blocks is a task of its own; most families have one block
    members = members.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")})
    edges = ws.table("edges", members.groupBy("family", "x", "y").applyInArrow(_search_group(t), "a long, b long"))
    ws.drop("candidates", "family", "sets", "reps")
    same = ws.table("same", all_docs.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    # rows of one doc_id with different texts are one node
    node = all_docs.join(same.select("hi", "lo", "rep"), ["hi", "lo"])
    several = ws.table("several", node.groupBy("doc_id").agg(F.count("*").alias("k"), F.collect_set(F.when(F.col("n") > 0, F.col("rep"))).alias("reps")).where("k > 1").select("doc_id", "reps"))
    meet = several.where(F.size("reps") > 1).select(F.array_min("reps").alias("a"), F.explode("reps").alias("b"))
    linked = components(edges.unionByName(meet))
    of = same.join(linked, F.col("rep") == F.col("node"), "left").select("hi", "lo", "rep", F.when(F.col("n") > 0, F.coalesce("component", "rep")).alias("component"))
    out = ws.table("linked", all_docs.join(of, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))
    # a row without words goes with the other rows of its doc_id
    least = out.join(several.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("least"))
    out = out.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "component_id").alias("component_id"))
    ws.drop("docs", "edges", "same")
    nobody = docs.where("doc_id is null").select("text").mapInArrow(_sizes(k), "n_shingles long")
    return out.unionAll(nobody.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def _sizes(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = column(batch.column(0))
            for a, b in groups(offsets, 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)], pa.int64())], ["n_shingles"])

    return run


def deduplicate(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """Keep the document with the smallest doc_id of each group; rows whose doc_id is null, and all without words, stay.

    Of several rows with one doc_id all stay or none.
    """
    ids = near_duplicates(docs, k, t).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 90 % of their 3-word shingles, and the components of these links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)

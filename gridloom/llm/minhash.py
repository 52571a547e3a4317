"""Near-duplicate documents by b-bit MinHash: bands find candidates, packed low bits estimate, full sets confirm.

1. Of every document's set of word shingles, HASHES minima are taken. Runs of ROWS full minima make BANDS keys; of each minimum
   only its BITS low bits are kept, packed. Equal sets count once from here on.
2. The members of a band are held against its first one. Each document's most similar such partner, by the estimate that is
   corrected for chance equality of low bits, is verified on full sets: most members of a group of copies are linked by then.
3. Bands that still hold members of different components are looked at again: pairs of different components whose estimate is not
   clearly too low join a family, without a row for each pair. In a family every such pair is verified on full sets, unless
   its documents are connected by then. Bands and families too large for a task are dealt as pairs of blocks.

With 40 bands of 5 rows, two documents of similarity 0.8 have no band in common with probability 1.3e-7; the estimate is 6 standard deviations wide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._bytes import column, groups, mix
from gridloom.llm._components import components
from gridloom.llm._groups import settled, without_id
from gridloom.llm._work import Workspace
from gridloom.llm.jaccard_join import _sets, sets_of, signature

BANDS, ROWS, BITS = 40, 5, 2
HASHES = BANDS * ROWS
PER_WORD = 64 // BITS
WORDS = -(-HASHES // PER_WORD)
#: Rows of a band that one task holds at once; larger bands are dealt as pairs of blocks.
BAND_ROWS = 16384
FAMILY_BYTES = 48 << 20
SLOT_BYTES = 16 << 20
#: Rows of two longs; up to so many go by broadcast, more by a shuffle join.
BROADCAST_ROWS = 500_000
LOW = [f"l{i}" for i in range(WORDS)]

_rng = np.random.default_rng(20250512)
_ODD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_ONES = np.uint64(sum(1 << k for k in range(0, 64, BITS)))


def minima(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The least value under every hash function of each run of x; the runs begin at at."""
    out = np.empty((len(at), HASHES), np.uint64)
    y = np.empty_like(x)
    for i in range(HASHES):
        np.bitwise_xor(x, _XOR[i], out=y)
        y *= _ODD[i]
        out[:, i] = np.minimum.reduceat(y, at)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The BITS low bits of each minimum, PER_WORD of them in a 64-bit word."""
    bits = least & np.uint64((1 << BITS) - 1)
    out = np.zeros((len(least), WORDS), np.uint64)
    for i in range(HASHES):
        out[:, i // PER_WORD] |= bits[:, i] << np.uint64(BITS * (i % PER_WORD))
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(least), 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
    return key


def mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the minima differ in their low bits."""
    x = a ^ b
    for k in range(1, BITS):
        x = x | ((a ^ b) >> np.uint64(k))
    return np.bitwise_count(x & _ONES).sum(-1, dtype=np.int64)


def similarity(differ):
    """Estimated Jaccard similarity: unequal minima have equal low bits with probability 2**-BITS."""
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


def most_mismatches(t: int, deviations: float = 6) -> int:
    """Mismatches that a pair of similarity t percent exceeds with next to no probability."""
    p = 2.0**-BITS + (1 - 2.0**-BITS) * t / 100
    return int(np.ceil(HASHES * (1 - p) + deviations * np.sqrt(HASHES * p * (1 - p))))


def _signatures(k: int):
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), *((c, pa.int64()) for c in LOW), ("bands", pa.list_(pa.int64()))]
    names = [x[0] for x in fields]

    def run(batches):
        for batch in batches:
            data, offsets = column(batch.column(1))
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in groups(offsets, 1 << 20):
                sets = sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                sig = np.array([signature(x) for x in sets], np.int64).reshape(-1, 2)
                _, first, own = np.unique(sig, axis=0, return_index=True, return_inverse=True)  # equal sets of a block are hashed once
                size = np.array([len(x) for x in sets], np.int64)
                some = first[size[first] > 0]
                low, keys = np.zeros((len(sets), WORDS), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
                if len(some):
                    least = minima(np.concatenate([sets[i] for i in some]), np.cumsum(size[some]) - size[some])
                    low[some], keys[some] = packed(least), band_keys(least)
                like = first[own.reshape(-1)]
                low, keys = low[like].view(np.int64), keys[like].view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (b - a) + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[a:b].astype(np.int64)), pa.array(size), pa.array(sig[:, 0]), pa.array(sig[:, 1]), *(pa.array(low[:, i]) for i in range(WORDS)), flat], names)

    return run


def _verified(t: int):
    """Of pairs with both sets, those that are linked."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            ok = [_link(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), t) for u, v in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, k in zip(a, ok, strict=True) if k], pa.int64()), pa.array([v for v, k in zip(b, ok, strict=True) if k], pa.int64())], ["a", "b"])

    return run


def _link(x: np.ndarray, y: np.ndarray, t: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two sorted runs: a merge
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= t * (len(x) + len(y) - n)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys, and where each new key begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _low(table: pa.Table) -> np.ndarray:
    return np.column_stack(_columns(table, *LOW)).view(np.uint64)


def across(t: int):
    """Edges that connect, in each band, every two members of different components whose sizes and estimate leave a link possible."""
    most = most_mismatches(t)

    def run(table: pa.Table) -> pa.Table:
        key, x, y, rep, comp, n = _columns(table, "key", "x", "y", "rep", "comp", "n")
        low = _low(table)
        order, at = _runs(key, x, y)
        edges = [np.zeros((0, 2), np.int64)]
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            own = order[i:j]
            edges.append(rep[own][_spanning(comp[own], n[own], low[own], t, most)])
        e = np.unique(np.sort(np.concatenate(edges), axis=1), axis=0)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return run


def _spanning(comp: np.ndarray, n: np.ndarray, low: np.ndarray, t: int, most: int) -> np.ndarray:
    """At most len(comp) - 1 pairs of places, which connect all that the possible links between components connect."""
    names, times = np.unique(comp, return_counts=True)
    label, out = np.arange(len(comp)), []
    for s in np.flatnonzero(comp != names[times.argmax()]).tolist():
        j = np.flatnonzero((comp != comp[s]) & (label != label[s]) & (np.minimum(n, n[s]) * 100 >= t * np.maximum(n, n[s])))
        j = j[mismatches(low[j], low[s]) <= most]
        met, first = np.unique(label[j], return_index=True)
        out += [(s, int(i)) for i in j[first]]
        label[np.isin(label, met)] = label[s]
    return np.array(out, np.int64).reshape(-1, 2)


def joined(rep: np.ndarray, comp: np.ndarray, low: np.ndarray, sets: list[np.ndarray], t: int) -> np.ndarray:
    """Verified links that connect documents of different components; pairs connected already are passed over."""
    n = np.array([len(x) for x in sets])
    most = most_mismatches(t)
    order = np.lexsort((rep, n))
    rep, comp, low, sets, n = rep[order], comp[order].copy(), low[order], [sets[i] for i in order], n[order]
    out = []
    for q in range(1, len(rep)):
        lo = int(np.searchsorted(n[:q], -(-t * int(n[q]) // 100)))
        c = lo + np.flatnonzero(comp[lo:q] != comp[q])
        differ = mismatches(low[c], low[q])
        c = c[np.argsort(differ, kind="stable")[: int((differ <= most).sum())]]
        for i in c.tolist():
            if comp[i] != comp[q] and _link(sets[i], sets[q], t):
                out.append((rep[i], rep[q]))
                comp[comp == comp[i]] = comp[q]
    return np.array(out, np.int64).reshape(-1, 2)


def _search(t: int):
    def run(table: pa.Table) -> pa.Table:
        family, x, y, rep, comp = _columns(table, "family", "x", "y", "rep", "comp")
        low, keys = _low(table), table.column("keys")
        order, at = _runs(family, x, y)
        edges = [np.zeros((0, 2), np.int64)]
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            own = order[i:j]
            edges.append(joined(rep[own], comp[own], low[own], [np.frombuffer(keys[k].as_py(), np.uint64) for k in own.tolist()], t))
        e = np.concatenate(edges)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return run


def _blocks(rows: DataFrame, by: str, blocks: str) -> DataFrame:
    """rows, once for each pair of blocks x <= y that holds them: a group of many blocks is dealt so that no task holds more than two."""
    rows = rows.withColumn("i", F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return rows.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j")}).drop("i", "j", blocks)


def near_duplicates(docs: DataFrame, k: int = 5, t: int = 80, band_rows: int = BAND_ROWS, family_bytes: int = FAMILY_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document of docs (doc_id, text).

    Documents link when 100 * intersection >= t * union of their sets of k-word shingles; component_id is the smallest doc_id
    reachable, and kept says that it is the document's own. A text of fewer words is one shingle; one without words, or null, links with nothing. Rows
    with a null doc_id link with nothing, have a null component_id and are kept. A doc_id that occurs on several rows is one node, with the
    links of all of them, but each row keeps its own set. Long texts are hashed whole. Other columns, whatever their names, don't matter.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    schema = f"doc_id long, n long, hi long, lo long, {', '.join(f'{c} long' for c in LOW)}, bands array<long>"
    all_docs = ws.table("docs", known.mapInArrow(_signatures(k), schema))
    reps = all_docs.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), *(F.any_value(c).alias(c) for c in ("n", *LOW, "bands")))
    reps = ws.table("reps", reps)
    bands = reps.select("rep", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    met = ws.table("met", bands.join(shared, "key"))
    ws.drop()

    def sets_for(name: str, ids: DataFrame) -> DataFrame:
        ids = reps.join(ids, "rep").select(F.col("rep").alias("doc_id"), "hi", "lo")
        wanted = ws.table(f"{name}_ids", ids)
        wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
        return ws.table(name, known.join(wanted, "doc_id").select("doc_id", "text", "hi", "lo").mapInArrow(_sets(k), "rep long, n long, keys binary"))

    # each document with the most similar of the leaders of its bands
    most = most_mismatches(t)
    narrow = reps.select("rep", "n", *LOW)
    other = narrow.select(F.col("rep").alias("leader"), F.col("n").alias("m"), *(F.col(c).alias(f"o{c}") for c in LOW))
    pairs = met.where("rep <> leader").select("leader", "rep").distinct().join(narrow, "rep").join(other, "leader")
    pairs = pairs.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * t).withColumn("differ", _differ())
    best = pairs.where(F.col("differ") <= most).groupBy("rep").agg(F.min(F.struct("differ", "leader")).alias("b")).select("rep", F.col("b.leader").alias("leader"))
    best = ws.table("best", best)
    ws.drop()
    sets = sets_for("sets", best.select("rep").union(best.select("leader")).distinct())
    held = best.join(sets.select("rep", F.col("keys").alias("x")), "rep").join(sets.select(F.col("rep").alias("leader"), F.col("keys").alias("y")), "leader")
    first = ws.table("first", components(ws.table("links", held.select("leader", "rep", "x", "y").mapInArrow(_verified(t), "a long, b long"))))
    ws.drop("links", "best")

    # what bands still leave open between components
    comp = met.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    comp = ws.table("comp", comp)
    mixed = comp.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("rows")).where("a < b").select("key", F.ceil(F.col("rows") / band_rows).alias("blocks"))
    rows = ws.table("mixed", comp.join(mixed, "key"))
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * 16 * (3 + WORDS) // SLOT_BYTES))
    rows = _blocks(rows, "key", "blocks").join(narrow, "rep").withColumn("slot", F.pmod(F.xxhash64("key", "x", "y"), F.lit(slots)))
    candidates = ws.table("candidates", rows.groupBy("slot").applyInArrow(across(t), "a long, b long"))
    family = ws.table("family", components(candidates).withColumnsRenamed({"node": "rep", "component": "family"}))
    ws.drop("met", "comp", "mixed", "candidates")
    fresh = family.select("rep").join(sets.select("rep"), "rep", "left_anti")
    more = sets.unionAll(sets_for("more", fresh)) if fresh.take(1) else sets
    members = family.join(first.withColumnRenamed("node", "rep"), "rep", "left").join(narrow.drop("n"), "rep").join(more, "rep").withColumn("comp", F.coalesce("component", "rep"))
    weight = members.groupBy("family").agg(F.sum(8 * F.col("n") + 8 * WORDS).alias("bytes"))
    total = int(weight.agg(F.sum("bytes")).first()[0] or 0)
    members = members.join(weight.select("family", F.ceil(F.col("bytes") / family_bytes).alias("blocks")), "family").select("family", "rep", "comp", *LOW, "keys", "blocks")
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // SLOT_BYTES))
    members = _blocks(members, "family", "blocks").withColumn("slot", F.pmod(F.xxhash64("family", "x", "y"), F.lit(slots)))
    links = ws.table("last", members.groupBy("slot").applyInArrow(_search(t), "a long, b long"))
    ws.drop("sets", "more", "family")
    edges = links.unionAll(first.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
    out = settled(ws, all_docs.select("doc_id", "n", "hi", "lo"), edges)
    ws.drop("docs", "reps", "first", "last")
    out = out.unionAll(without_id(docs, k))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def _differ():
    """mismatches() over the words of both sides, as a column."""
    total = None
    for c in LOW:
        x = F.col(c).bitwiseXOR(F.col(f"o{c}"))
        y = x
        for k in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(x, k))
        n = F.bit_count(y.bitwiseAND(F.lit(int(_ONES.view(np.int64)))))
        total = n if total is None else total + n
    return total


def deduplicate(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """The rows of docs whose document is kept; of several rows with one doc_id all stay or none."""
    gone = near_duplicates(docs, k, t).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 80 % of their 2-word shingles, the components of these links, and which document of each is kept."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2, 80)

"""Prefix trie of conversations by partition refinement.

1. Turns become rows of 32 bytes (SHA-256 of role and text) and a number of words; a range partition numbers the turns of
   every conversation, however long, and CHUNK turns after another are packed.
2. All conversations begin in one class. A round splits every class that is too large for a task by its next turn; copies of one chunk
   count once, so a class holds different sequences only. A class that is small enough goes to a task, which splits it turn by turn; a
   class of one sequence retires there, and its tail is a unary chain. Classes that reach the end of a chunk go on in the next one.
3. Sums of leaves and saved words fold back from the deepest classes to the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._work import Workspace

#: Turns of a packed row.
CHUNK = 1024
#: Bytes of the different sequences of a class, up to which one task refines it whole, and of the classes that share a task.
CLASS_BYTES = 1 << 20
SLOT_BYTES = 16 << 20
#: Conversation ids that are joined to one row before they are digested.
IDS = 512
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = b"root"
COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
OUT = f"cls binary, {COLUMNS}"


def _binary_digest(*cols):
    return F.unhex(F.sha2(F.concat(*cols), 256))


def turns_of(ws: Workspace, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (conv_id, pos, h, w) of turns in order, pos from 1, and (conv_id, n): how many there are.

    h stands for role and text, w is the number of words. Rows without a conv_id belong to no conversation. Turns of one number go by their
    digest. No window holds a whole conversation: rows are dealt by ranges of (conv_id, turn, h), and numbered within.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), _binary_digest(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")).alias("h"), words.cast("long").alias("w")
    )
    rows = rows.repartitionByRange(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", F.asc_nulls_first("turn"), "h")
    rows = ws.table("rows", rows.withColumn("part", F.spark_partition_id()))
    held = rows.groupBy("conv_id", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = ws.table("held", held.withColumn("before", before))
    pos = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "h"))
    numbered = rows.withColumn("own", pos).join(held.drop("count"), ["conv_id", "part"])
    return ws.table("turns", numbered.select("conv_id", (F.col("own") + F.col("before")).alias("pos"), "h", "w")), ws.table("lengths", held.groupBy("conv_id").agg(F.sum("count").alias("n")))


def rebuilt(ws: Workspace, turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of rebuilt conversations: the first h turns of conversation c - c % 20, then c's own after its first h; h = crc32(c) % 4."""
    c = F.col("conv_id")
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = lengths.select("conv_id", "n", (c - c % 20).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 4).alias("head")).join(base, "base", "left")
    plan = plan.select("conv_id", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken"), F.greatest(F.col("n") - F.col("head"), F.lit(0)).alias("rest"))
    plan = ws.table("plan", plan)
    first = turns.where((F.col("pos") <= 3) & (c % 20 == 0)).select(F.col("conv_id").alias("base"), "pos", "h", "w")
    heads = plan.where("taken > 0").join(first, "base").where("pos <= taken").select("conv_id", "pos", "h", "w")
    tails = turns.join(plan.where("rest > 0"), "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "h", "w")
    return heads.unionAll(tails), plan.select("conv_id", (F.col("taken") + F.col("rest")).alias("n"))


def _digests(batches):
    """(label, ends_sha256) from (label, ids) that stand by label and in order of their ids; nothing is held but a hash's state."""
    label, state = None, None
    for batch in batches:
        labels, shas = [], []
        for x, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x != label:
                if state:
                    labels.append(label)
                    shas.append(state.hexdigest())
                label, state = x, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.binary()), pa.array(shas, pa.string())], ["label", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["label", "ends"])


def ends_of(convs: DataFrame) -> DataFrame:
    """(label, ends): the digest of the comma-joined ids of every label's conversations, from (label, conv_id)."""
    part = F.floor(F.col("conv_id") / IDS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    rows = convs.groupBy("label", part.alias("part")).agg(ids.alias("ids"))
    return rows.repartition("label").sortWithinPartitions("label", "part").select("label", "ids").mapInArrow(_digests, "label binary, ends string")


class _Nodes:
    """Nodes of the classes of one task, level by level, and their sums."""

    def __init__(self):
        self.parts = []
        self.n = 0

    def add(self, **columns) -> np.ndarray:
        at = np.arange(self.n, self.n + len(columns["conv"]))
        self.parts.append(columns | {"children": np.zeros(len(at), np.int64), "leaves": np.zeros(len(at), np.int64), "saved": np.zeros(len(at), np.int64)})
        self.n += len(at)
        return at

    def done(self) -> dict[str, np.ndarray]:
        return {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}


def refine(cls: np.ndarray, skip: np.ndarray, depth: np.ndarray, up: np.ndarray, rep: np.ndarray, n: np.ndarray, turns: list[tuple[np.ndarray, np.ndarray]], below: np.ndarray, ends: np.ndarray) -> tuple[dict, dict]:
    """Splits whole classes of sequences turn by turn; gives their tops (with sums of what is below) and all nodes below the tops.

    Sequences are (codes, words) of turns, of which the first skip led to the class; depth is that of the class. n conversations share a
    sequence, rep is the smallest; the least up of a class is
    the smallest of all its members, also of those that end at its top. below holds children, leaves and saved words beyond each sequence's end.
    """
    rest = [(c[s:], w[s:]) for (c, w), s in zip(turns, skip.tolist(), strict=True)]
    length = np.array([len(c) for c, _ in rest], np.int64)
    first = np.cumsum(length) - length
    code = np.concatenate([c for c, _ in rest])
    words = np.concatenate([w for _, w in rest])
    tops, label = np.unique(cls, return_inverse=True)
    nodes = _Nodes()
    least, total, at_depth = np.full(len(tops), np.iinfo(np.int64).max), np.zeros(len(tops), np.int64), np.zeros(len(tops), np.int64)
    np.minimum.at(least, label, up)
    np.add.at(total, label, n)
    at_depth[label] = depth
    node = nodes.add(conv=least, n=total, depth=at_depth, parent=np.full(len(tops), -1), words=np.zeros(len(tops), np.int64))[label]
    conv = least
    end = np.empty(len(rep), np.int64)  # the node where a sequence ends
    live, d = np.arange(len(rep)), 0
    while len(live):
        over = length[live] == d
        end[live[over]] = node[live[over]]
        live = live[~over]
        alone = np.bincount(node[live], minlength=nodes.n)[node[live]] == 1
        for_one = live[alone]
        if len(for_one):  # classes of one sequence retire: the rest is a chain
            m = length[for_one] - d
            stop = np.cumsum(m)
            own = np.repeat(for_one, m)
            step = np.arange(stop[-1]) - np.repeat(stop - m, m)
            parent = nodes.n + np.arange(stop[-1]) - 1
            parent[stop - m] = node[for_one]
            made = nodes.add(conv=rep[own], n=n[own], depth=depth[own] + d + 1 + step, parent=parent, words=words[first[own] + d + step])
            end[for_one] = made[stop - 1]
        live = live[~alone]
        if len(live):
            pair = np.column_stack((node[live], code[first[live] + d]))
            classes, own = np.unique(pair, axis=0, return_inverse=True)
            own = own.reshape(-1)
            conv, many = np.full(len(classes), np.iinfo(np.int64).max), np.zeros(len(classes), np.int64)
            np.minimum.at(conv, own, rep[live])
            np.add.at(many, own, n[live])
            one = np.empty(len(classes), np.int64)
            one[own] = live
            node[live] = nodes.add(conv=conv, n=many, depth=depth[one] + d + 1, parent=classes[:, 0], words=words[first[one] + d])[own]
        d += 1
    all_nodes = nodes.done()
    children, leaves, saved = all_nodes["children"], all_nodes["leaves"], all_nodes["saved"]
    np.add.at(children, end, below[:, 0])
    np.add.at(leaves, end, below[:, 1])
    np.add.at(saved, end, below[:, 2])
    saved[len(tops) :] += (all_nodes["n"][len(tops) :] - 1) * all_nodes["words"][len(tops) :]
    parent = all_nodes["parent"]
    np.add.at(children, parent[len(tops) :], 1)
    leaves[children == 0] = 1
    by_depth = np.argsort(all_nodes["depth"], kind="stable")
    cut = np.flatnonzero(np.diff(all_nodes["depth"][by_depth])) + 1
    for i in reversed(np.split(by_depth, cut)):
        i = i[parent[i] >= 0]
        np.add.at(leaves, parent[i], leaves[i])
        np.add.at(saved, parent[i], saved[i])
    shas = np.full(nodes.n, EMPTY, object)
    has = np.array([x is not None for x in ends], bool)
    shas[end[has]] = ends[has]
    all_nodes["ends"] = shas
    all_nodes["parent_conv"] = np.where(parent >= 0, all_nodes["conv"][parent], -1)
    return {k: v[: len(tops)] for k, v in all_nodes.items()} | {"cls": tops}, {k: v[len(tops) :] for k, v in all_nodes.items()}


def _refined(table: pa.Table) -> pa.Table:
    skip, depth, up, rep, n, *below = (table.column(c).to_numpy() for c in ("skip", "depth", "up", "rep", "n", "children", "leaves", "saved"))
    cls = np.array(table.column("cls").to_pylist(), object)
    _, cls_code = np.unique(cls.astype("S33"), return_inverse=True)
    lists = table.column("turns").combine_chunks()
    offsets = lists.offsets.to_numpy()
    h, w = (lists.values.field(c) for c in ("h", "w"))
    _, code = np.unique(np.frombuffer(b"".join(h.to_pylist()), "V32"), return_inverse=True) if len(h) else (None, np.zeros(0, np.int64))
    w = w.to_numpy(zero_copy_only=False)
    turns = [(code[a:b], w[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    tops, nodes = refine(cls_code, skip, depth, up, rep, n, turns, np.column_stack(below).astype(np.int64), np.array(table.column("ends").to_pylist(), object))
    names = {int(c): x for c, x in zip(cls_code, cls, strict=True)}
    rows = []
    for part, keys in ((tops, [names[int(c)] for c in tops["cls"]]), (nodes, [None] * len(nodes["conv"]))):
        parents = pa.array(part["parent_conv"], pa.int64(), mask=part["parent"] < 0) if len(part["conv"]) else pa.array([], pa.int64())
        rows.append(pa.table({"cls": pa.array(keys, pa.binary()), "conv_id": part["conv"], "depth": part["depth"], "parent_conv_id": parents, "n_convs": part["n"], "n_children": part["children"], "n_leaves": part["leaves"], "saved_tokens": part["saved"], "ends_sha256": pa.array(part["ends"].tolist(), pa.string())}))
    return pa.concat_tables(rows)


def trie(ws: Workspace, turns: DataFrame, convs: DataFrame, chunk: int = CHUNK, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, n), whose turns are (conv_id, pos, h, w)."""
    packed = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / chunk).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h", "w"))), lambda x: F.struct(x.h.alias("h"), x.w.alias("w"))).alias("turns"))
    digest = _binary_digest(F.array_join(F.transform("turns", lambda x: F.hex(x.h)), "").cast("binary"))
    packed = packed.join(convs, "conv_id").withColumn("last", F.col("k") == F.floor((F.col("n") - 1) / chunk)).drop("n")
    chunks = ws.table("chunks", packed.withColumn("digest", digest))
    levels, smallest = chunks.agg(F.max("k")).first()[0], convs.agg(F.min("conv_id")).first()[0]
    members = None
    classes, tails, ended = [], [], convs.where("n = 0").select(F.lit(ROOT + b"0").alias("label"), "conv_id")
    for k in range(0 if levels is None else int(levels) + 1):
        here = chunks.where(F.col("k") == k).select("conv_id", "digest", "last")
        here = here.withColumns({"cls": F.lit(ROOT), "up": F.lit(smallest)}) if members is None else here.join(members, "conv_id")
        group = here.groupBy("cls", "digest").agg(F.min("up").alias("up"), F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.count_if("last").alias("n_last"), F.min(F.when(F.col("last"), F.col("conv_id"))).alias("first_last"))
        group = ws.table(f"classes{k}", group.withColumn("label", _binary_digest("cls", "digest")))
        classes.append(group)
        here = here.withColumn("label", _binary_digest("cls", "digest"))
        ended = ended.unionAll(here.where("last").select("label", "conv_id").join(group.where("n_last > 1").select("label"), "label", "left_semi"))
        if k == levels:
            break
        on = here.where("not last").join(group.select("label", "rep", (F.col("n") - F.col("n_last")).alias("going")), "label")
        on = ws.table(f"on{k}", on.select("conv_id", "label", "rep", "going"))
        members = on.where("going > 1").select("conv_id", F.col("label").alias("cls"), F.col("rep").alias("up"))
        tails.append(_tails(chunks, on.where("going = 1"), k, chunk))
        if members.isEmpty():
            break
    ends = ws.table("ends", ends_of(ended))

    sums, nodes = None, tails
    for k in reversed(range(len(classes))):
        rows = classes[k].alias("g").join(chunks.where(F.col("k") == k).select(F.col("conv_id").alias("rep"), "turns"), "rep").join(ends, "label", "left")
        ends_here = F.when(F.col("n_last") == 1, F.sha2(F.col("first_last").cast("string").cast("binary"), 256)).otherwise(F.col("ends"))
        going = F.col("n") - F.col("n_last")
        if sums is not None:
            rows = rows.join(sums.select(F.col("cls").alias("label"), "n_children", "n_leaves", "saved_tokens"), "label", "left")
        sub = [F.coalesce(F.col(c) if sums is not None else F.lit(None).cast("long"), F.when(going == 1, one).otherwise(0)).cast("long").alias(a) for c, one, a in (("n_children", 1, "children"), ("n_leaves", 1, "leaves"), ("saved_tokens", 0, "saved"))]
        rows = ws.table(f"rows{k}", rows.select("cls", F.lit(0).cast("long").alias("skip"), F.lit(k * chunk).cast("long").alias("depth"), "up", "rep", "n", "turns", *sub, ends_here.alias("ends")))
        sums, made = _level(ws, rows, k, class_bytes)
        nodes = [*nodes, made]
    # the root from one-row tables, without a join: what one of them knows is null in the others
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = root.unionByName(ends.where(F.col("label") == F.lit(ROOT + b"0")).select(F.col("ends").alias("ends_sha256")), True)
    if sums is not None:
        root = root.unionByName(sums.where(F.col("cls") == F.lit(ROOT)).select("n_children", "n_leaves", "saved_tokens"), True)
    value = {c: F.max(c) if c in root.columns else F.lit(None).cast("long") for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
    value |= {c: F.coalesce(value[c], F.lit(other)) for c, other in (("n_children", 0), ("n_leaves", 1), ("saved_tokens", 0), ("ends_sha256", EMPTY))}
    root = root.agg(*(x.alias(c) for c, x in value.items())).where("n_convs > 0").withColumns({"depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")})
    root = root.select("conv_id", "depth", "parent_conv_id", "n_convs", *(F.col(c).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")), "ends_sha256")
    for x in nodes:
        root = root.unionByName(x)
    return root


def _tails(chunks: DataFrame, alone: DataFrame, k: int, chunk: int) -> DataFrame:
    """The chains of conversations that go on alone after chunk k."""
    rest = chunks.where(F.col("k") > k).join(alone.select("conv_id", "rep"), "conv_id").select("conv_id", "rep", "k", "last", F.size("turns").alias("m"), F.posexplode("turns").alias("i", "turn"))
    end = F.col("last") & (F.col("i") == F.col("m") - 1)
    depth = F.col("k") * chunk + F.col("i") + 1
    one = F.lit(1).cast("long")
    return rest.select("conv_id", depth.cast("long").alias("depth"), F.when(depth == (k + 1) * chunk + 1, F.col("rep")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"))


def _level(ws: Workspace, rows: DataFrame, k: int, class_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Sums of the classes that rows of one chunk begin in, and all nodes below these."""
    local, split, deep = [], [], 0
    size = 48 + 40 * (F.size("turns") - F.col("skip"))
    while True:
        weight = rows.groupBy("cls").agg(F.sum(size).alias("bytes"))
        large = ws.table(f"large{k}_{deep}", weight.where((F.col("bytes") > class_bytes) | (F.col("cls") == F.lit(ROOT))).select("cls"))
        local.append(rows.join(large, "cls", "left_anti"))
        if large.isEmpty():
            break
        rows = rows.join(large, "cls")
        over = F.size("turns") == F.col("skip")
        turn = F.get("turns", F.col("skip").cast("int"))
        split.append((large, rows.where(over), deep))
        on = rows.where(~over).withColumnRenamed("cls", "parent").withColumn("cls", _binary_digest("parent", turn["h"])).withColumn("w", turn["w"])
        on = on.withColumns({"skip": F.col("skip") + 1, "depth": F.col("depth") + 1, "up": F.col("rep")})
        on = ws.table(f"round{k}_{deep}", on)
        born = on.groupBy("parent", "cls").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"), F.any_value("w").alias("w"), F.any_value("depth").alias("depth"))
        split[-1] += (ws.table(f"born{k}_{deep}", born), rows)
        rows = on.drop("parent", "w")
        deep += 1
    whole = local[0]
    for x in local[1:]:
        whole = whole.unionByName(x)
    total = int(whole.agg(F.sum(size)).first()[0] or 0)
    slots = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SLOT_BYTES))
    made = ws.table(f"made{k}", whole.withColumn("slot", F.pmod(F.xxhash64("cls"), F.lit(slots))).groupBy("slot").applyInArrow(_refined, OUT))
    sums = made.where("cls is not null").select("cls", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    nodes = made.where("cls is null").drop("cls")
    for large, over, step, born, rows in reversed(split):  # fold back: a split class from the classes it was split into
        child = born.join(sums, "cls").withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n") - 1) * F.col("w"))
        least = rows.groupBy("cls").agg(F.min("up").alias("up")).withColumnRenamed("cls", "parent")
        nodes = nodes.unionByName(child.join(least, "parent").select(F.col("rep").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
        own = child.groupBy(F.col("parent").alias("cls")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        at_end = over.groupBy("cls").agg(*(F.sum(c).alias(c) for c in ("children", "leaves", "saved")), F.max("ends").alias("ends"))
        both = large.join(own, "cls", "left").join(at_end, "cls", "left")
        plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        both = both.select("cls", plus("n_children", "children").alias("n_children"), F.greatest(plus("n_leaves", "leaves"), F.lit(1)).alias("n_leaves"), plus("saved_tokens", "saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
        sums = ws.table(f"sums{k}_{step}", sums.unionByName(both))
    return sums, nodes


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text): a row for each node, as in the contract of op11_prefix_trie.

    Null role and text count as empty, a null turn comes first, turns of one number go by the digest of role and text (so repeated rows are
    turns of their own), and rows without a conv_id belong to no conversation. An empty table has no node. Other columns don't matter.
    """
    ws = Workspace(conversations.sparkSession, "trie")
    turns, lengths = turns_of(ws, conversations)
    again, convs = rebuilt(ws, turns, lengths)
    return trie(ws, again, convs, chunk, class_bytes)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of conversations, each rebuilt on the beginning of another: sizes, leaves, words saved by sharing, and which end where."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))

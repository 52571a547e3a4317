"""Approximate nearest neighbours by learned partitions.

The exact neighbour graph of a bounded sample is cut into balanced parts; a small classifier learns to tell in which parts a vector's
neighbours lie. Every row is indexed under its most probable part; a query visits as many probable parts as a second
sample needs for the recall asked for, and is ranked again by the exact measure. Parts are dealt in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that the graph and the classifier are fitted on; every row is indexed.
SAMPLE = 6000
#: Parts: PARTS at least, and one for each PART_ROWS rows, as far as the sample can teach them (50 rows a part).
PARTS, PART_ROWS = 16, 50_000
HIDDEN = 64
RECALL = 0.95
#: Rows of one part that one task ranks.
BLOCK_ROWS = 20_000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the largest inner product for each row, itself left out."""
    out = np.zeros((len(x), k), np.int32)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 0) -> np.ndarray:
    """A partition of the graph with few cut edges: rows move to the part that holds most of their neighbours while it has room."""
    n = len(graph)
    rng = np.random.default_rng(seed)
    both = np.concatenate((np.column_stack((np.repeat(np.arange(n), graph.shape[1]), graph.ravel())), np.column_stack((graph.ravel(), np.repeat(np.arange(n), graph.shape[1])))))
    both = both[np.argsort(both[:, 0], kind="stable")]
    ends = np.searchsorted(both[:, 0], np.arange(n + 1))
    near = both[:, 1]
    part, room, size = np.full(n, -1), int(np.ceil(slack * n / parts)), np.zeros(parts, int)
    for p in range(parts):  # grow each part from a free row along the graph
        free = np.flatnonzero(part < 0)
        if not len(free):
            break
        todo = [int(rng.choice(free))]
        while todo and size[p] < n // parts:
            i = todo.pop(0)
            if part[i] < 0:
                part[i], size[p] = p, size[p] + 1
                todo += near[ends[i] : ends[i + 1]].tolist()
            if not todo and size[p] < n // parts and len(free := np.flatnonzero(part < 0)):
                todo = [int(rng.choice(free))]
    for i in np.flatnonzero(part < 0).tolist():
        part[i] = int(np.argmin(size))
        size[part[i]] += 1
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            votes = np.bincount(part[near[ends[i] : ends[i + 1]]], minlength=parts).astype(float)
            votes[(size >= room) & (np.arange(parts) != part[i])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200:
            break
    return part


class Router:
    """A one-layer network from a vector to the shares of its neighbours in each part, and the number of parts to visit."""

    def __init__(self, x: np.ndarray, parts: int = PARTS, k: int = 20, recall: float = RECALL, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.parts = max(1, min(parts, len(x) // 50))
        self.scale = float(np.sqrt((x**2).sum(1).mean())) or 1.0 if len(x) else 1.0
        self.visits, self.layers = 1, None
        if self.parts < 2:
            return
        own = rng.random(len(x)) < 0.85
        fit, test = x[own], x[~own]
        graph = neighbour_graph(fit, min(k, len(fit) - 1))
        part = balanced_parts(graph, self.parts, seed=seed)
        share = np.stack([np.bincount(part[g], minlength=self.parts) for g in graph]) / graph.shape[1]
        share = 0.5 * share + 0.5 * np.eye(self.parts)[part]
        w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN))
        w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, self.parts))
        self.layers = [w1, np.zeros(HIDDEN), w2, np.zeros(self.parts)]
        m, v, t = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for _ in range(30):
            for i in np.array_split(rng.permutation(len(fit)), -(-len(fit) // 128)):
                z = fit[i] / self.scale * 4
                h = np.maximum(0, z @ self.layers[0] + self.layers[1])
                g = (_softmax(h @ self.layers[2] + self.layers[3]) - share[i]) / len(i)
                gh = (g @ self.layers[2].T) * (h > 0)
                t += 1
                for j, grad in enumerate((z.T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad**2
                    self.layers[j] = self.layers[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-9)
        # visits: what rows outside the fit need to find their neighbours among the fitted rows
        home = self.order(fit)[:, 0]
        s = test @ fit.T
        near = np.argpartition(-s, min(k, len(fit)) - 1, axis=1)[:, : min(k, len(fit))] if len(test) else np.zeros((0, 1), int)
        at = np.argsort(self.order(test), axis=1)  # when each part is visited
        when = np.take_along_axis(at, home[near], axis=1)
        self.visits = next((n for n in range(1, self.parts) if len(test) and (when < n).mean() >= recall), self.parts)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, the most probable first."""
        if self.layers is None:
            return np.zeros((len(x), 1), int)
        w1, b1, w2, b2 = self.layers
        return np.argsort(-(np.maximum(0, x / self.scale * 4 @ w1 + b1) @ w2 + b2), axis=1, kind="stable")


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id whose vector isn't null, empty or zero and holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    # null compares as null, so forall is true only if every component is a finite number
    return out.where("vec_id is not null and size(v) > 0 and coalesce(forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')), false) and exists(v, x -> x <> 0)")


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def fit(vectors: DataFrame, sample: int = SAMPLE, **kw) -> Router:
    """A router from a sample, drawn by hash of the vector and its id: a share of the rows, so no task sends more than its part."""
    n = vectors.count()
    share = min(1.0, 0.9 * sample / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("v", "vec_id"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))).limit(sample).collect()
    rows = [r.v for r in sorted(rows, key=lambda r: (r.v, r.vec_id))]
    return Router(np.array(rows)[np.random.default_rng(0).permutation(len(rows))] if rows else np.zeros((0, 1)), **({"parts": max(PARTS, -(-n // PART_ROWS))} | kw))


def search(vectors: DataFrame, is_query, k: int = 20, block_rows: int = BLOCK_ROWS, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows found for each query, by inner product, ties to the smaller vec_id.

    vectors: vec_id, embedding. Vectors that are null, zero or not finite take no part, nor do those that have not the most frequent length (the
    smallest of several), nor does a query's own id.
    A row that repeats counts once. Fewer candidates than k give them all.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.where(F.size("v") == (length["length"] if length else 0)).dropDuplicates(["vec_id", "v"])
    router = router or fit(rows)
    shared = spark.sparkContext.broadcast(router)

    def route(batches):
        r = shared.value
        for batch in batches:
            if batch.num_rows:
                order = r.order(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(order[:, : r.visits].astype(np.int32)), pa.list_(pa.int32()))], ["vec_id", "v", "q", "parts"])

    routed = rows.withColumn("q", is_query).mapInArrow(route, "vec_id long, v array<double>, q boolean, parts array<int>")
    sizes = {r.part: r.n for r in routed.groupBy(F.col("parts")[0].alias("part")).agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*(F.lit(x) for p in range(router.parts) for x in (p, -(-sizes.get(p, 1) // block_rows))))
    data = routed.select("vec_id", "v", F.col("parts")[0].alias("part"), F.lit(False).alias("q")).withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("part")]).cast("int"))
    asked = routed.where("q").select("vec_id", "v", F.explode("parts").alias("part"), F.lit(True).alias("q"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (blocks[F.col("part")] - 1).cast("int"))))

    def rank(table: pa.Table) -> pa.Table:
        q = table.column("q").to_numpy()
        ids, v = table.column("vec_id").to_numpy(), table.column("v").combine_chunks()
        x = _matrix(v)
        cand, own = np.flatnonzero(~q), np.flatnonzero(q)
        cand = cand[np.argsort(ids[cand], kind="stable")]
        # copies of one vector have one score, which is added up once
        first, copy = np.unique(x[cand], axis=0, return_index=True, return_inverse=True)[1:] if len(cand) else (cand, cand)
        longest = np.sqrt((x[cand] ** 2).sum(1).max()) if len(cand) else 0.0
        out = []
        for a in range(0, len(own), 256):
            part = own[a : a + 256]
            for i, s in zip(part.tolist(), x[part] @ x[cand].T, strict=True) if len(cand) else ():
                s[ids[cand] == ids[i]] = -np.inf
                # the product of a matrix may differ from a plain sum in the last bits, so all that may tie with the k-th are kept
                slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x[i] ** 2).sum()) * longest
                top = np.flatnonzero((s >= np.partition(s, -k)[-k] - slack if len(s) > k else True) & (s > -np.inf))
                own_copy, at = np.unique(copy[top], return_inverse=True)
                exact = np.add.accumulate(x[i] * x[cand[first[own_copy]]], axis=1)[:, -1][at]
                best = np.lexsort((ids[cand[top]], -exact))[:k]
                out += [(ids[i], ids[cand[top[j]]], exact[j]) for j in best.tolist()]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    found = data.unionByName(asked).groupBy("part", "block").applyInArrow(rank, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row whose vec_id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)

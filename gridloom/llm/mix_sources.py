"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains. Projected gradient descent then finds
nonnegative rates r, near 1, whose expected domain tokens sum(r * tokens * posterior) match the targets:

    minimise 1/2 * sum over domains weight / share * ((T(r) - target) / total)**2 + ridge / 2 * weighted mean of (r - 1)**2,  r >= 0

A residual counts against its domain's share of the tokens as they are, so the ridge is as small for a rare domain as for a common
one. Domains with a target above 0 weigh more, so that the ridge moves them little. The ridge is the caller's choice between meeting the targets and
spreading the rates: the smaller it is, the nearer the totals and the more rates are 0 or large. Rates are the optimum as it stands.

A rate's gradient is posterior . w + ridge * (r - 1), where w = weight / share * (T(r) - target) / total has one number a domain; a rate that its projected
gradient leaves in place is max(0, 1 - posterior . w / ridge). So the descent keeps w alone: every step moves it along the gradient, scaled by the
curvature of the rates that are not at 0 (a matrix of domains by domains), and projects all rates to r >= 0. A step that doesn't
lower the objective enough is halved. An iteration is one pass over (tokens, posterior) that sums a dozen numbers; nothing else travels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._bytes import ALNUM, NONSPACE, column, groups, words
from gridloom.llm._work import Workspace, release
from gridloom.llm.language_id import features_of, hash_key, sample

DOMAINS = ("good", "plain", "toxic")
#: Shares of tokens by domain.
TARGETS = {"good": 0.85, "plain": 0.15, "toxic": 0.0}
BITS = 16
#: The classifier is fitted on at most so many labelled rows, drawn by hash of doc_id. Whole texts count; the driver gets their features only.
SAMPLE_ROWS = 6000
#: Posteriors are whole numbers of this part, so that documents of one posterior can be summed for the fit.
GRAIN = 10**6
#: Residuals of domains with a target above 0 count so many times.
WEIGHT = 10
RIDGE = 1e-3
#: Largest difference between the totals, as shares of all tokens, and what the rates' gradient says they are, at which the descent ends.
TOLERANCE = 1e-9
ROUNDS = 200


def features(data: np.ndarray, offsets: np.ndarray):
    """Distinct hashed words and space-parted tokens of each text, and a mark for tokens that repeat at once."""
    per = [words(data, offsets, inside)[2:] for inside in (ALNUM, NONSPACE)]
    for i in range(len(offsets) - 1):
        own = [h[f[i] : f[i + 1]] for h, f in per]
        runs = int((own[1][1:] == own[1][:-1]).sum()) * 20 // max(1, len(own[1]))
        ids = np.concatenate([h >> np.uint64(64 - BITS) for h in own] + [np.arange(runs, dtype=np.uint64)])
        yield np.unique(ids).astype(np.int64)


def presence(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer((text or "").encode(), np.uint8)
    ids = next(features(data, np.array([0, len(data)])))
    return ids, np.zeros(0)


def whole(p: np.ndarray) -> np.ndarray:
    """Probabilities rounded to whole parts of GRAIN that sum to 1: the largest remainders are rounded up."""
    low = np.floor(p * GRAIN + 1e-9).astype(int)
    low[np.argsort(low - p * GRAIN, kind="stable")[: GRAIN - low.sum()]] += 1
    return low / GRAIN


class Classifier:
    """Softmax regression on presence of hashed features that several labelled rows have, by AdaGrad. rows: a text or its features, and domain."""

    def __init__(self, rows: list[tuple], k: int = len(DOMAINS), epochs: int = 12, least: int = 5, seed: int = 2):
        x = [presence(t)[0] if isinstance(t, str) else t for t, _ in rows]
        y = np.array([d for _, d in rows], int)
        seen = np.bincount(np.concatenate(x), minlength=1 << BITS) if x else np.zeros(1 << BITS, int)
        self.w, self.b = np.zeros((1 << BITS, k), np.float32), np.log((np.bincount(y, minlength=k) + 0.5) / (len(y) + 0.5 * k)).astype(np.float32)
        if len(set(y.tolist())) < 2:
            return
        x = [i[seen[i] >= least] for i in x]
        rng, g2 = np.random.default_rng(seed), np.full((1 << BITS, k), 1e-3, np.float32)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), -(-len(x) // 32)):
                p = np.array([self.one(x[i]) for i in part])
                p[np.arange(len(part)), y[part]] -= 1
                g = np.zeros_like(self.w)
                ids = np.concatenate([x[i] for i in part])
                np.add.at(g, ids, np.repeat(p / np.sqrt([max(1, len(x[i])) for i in part])[:, None], [len(x[i]) for i in part], axis=0))
                own = np.unique(ids)
                own_g = g[own] / len(part) + 1e-5 * self.w[own]
                g2[own] += own_g**2
                self.w[own] -= 0.5 * own_g / np.sqrt(g2[own])
                self.b -= 0.05 * p.mean(0)

    def one(self, ids: np.ndarray) -> np.ndarray:
        z = self.w[ids].sum(0) / np.sqrt(max(1, len(ids))) + self.b
        z = np.exp(z - z.max())
        return z / z.sum()


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Domains by label: toxic 1, else quality 0 is plain and 1 is good. Rows with a null label or text teach nothing."""
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("toxic").isNull() | F.col("quality").isNull(), None).when(F.col("quality") == 0, 1).otherwise(0)
    drawn = sample(labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").distinct(), SAMPLE_ROWS, "doc_id")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(drawn), "doc_id").limit(2 * SAMPLE_ROWS)
    model = Classifier([(x[0], d) for _, x, d in sorted(features_of(rows, presence, "domain"), key=lambda r: hash_key(r[0], r[2]))])
    release(docs.sparkSession)
    return model


def posteriors(docs: DataFrame, model: Classifier, names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """docs with n_tokens (space-parted, whole texts; null has none) and posterior (array over names, in whole parts of GRAIN)."""
    docs = docs.drop("n_tokens", "posterior")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = column(batch.column(batch.schema.get_field_index("text")))
            n, p = [], []
            for a, b in groups(offsets, 1 << 20):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                n += np.diff(words(own, at, NONSPACE)[3]).tolist()
                p += [whole(m.one(ids).astype(float)).tolist() for ids in features(own, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _projected(p: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """The rates that the gradient leaves in place."""
    return np.maximum(0.0, 1 - p @ w / ridge)


def fit_rates(scored: DataFrame, targets: dict[str, float] = TARGETS, ridge: float = RIDGE, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> np.ndarray:
    """w, from which rates() follow. scored: n_tokens, posterior."""
    k, want = len(DOMAINS), np.array([targets[d] for d in DOMAINS])
    names = [f"x{i}" for i in range(k + k * k + 1)]
    total = float(scored.agg(F.sum("n_tokens")).first()[0] or 0)

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Tokens by domain, the curvature of rates above 0, and the mean square of the rates."""

        def sums(batches):
            out = np.zeros(len(names))
            for batch in batches:
                p, n = batch.column(1).flatten().to_numpy().reshape(-1, k), batch.column(0).to_numpy().astype(float)
                r = _projected(p, w, ridge)
                on = p[r > 0]
                out += [*((r * n) @ p), *((on * n[r > 0, None]).T @ on).ravel(), n @ r**2]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names)

        row = np.array(scored.select("n_tokens", "posterior").mapInArrow(sums, ", ".join(f"{x} double" for x in names)).agg(*(F.sum(x) for x in names)).first()) / total
        return row[:k], row[k:-1].reshape(k, k), row[-1]

    w = np.zeros(k)
    if not total:
        return w
    tokens, bend, square = at(w)
    scale = np.where(want > 0, WEIGHT, 1) / np.maximum(tokens, 1e-12)
    height = lambda w, square: float(w @ (w / scale) + ridge * square) / 2 + float(want @ w)
    high, length, step, slope = height(w, square), 0.0, None, 0.0
    for _ in range(rounds):
        if step is None:
            gradient = w / scale + want - tokens
            if np.abs(gradient).max() < tolerance:
                return w
            step, length = -np.linalg.solve(bend / ridge + np.diag(1 / scale), gradient), 1.0
            slope = float(gradient @ step)
        tokens, bend, square = at(w + length * step)
        new = height(w + length * step, square)
        if new > high + 1e-4 * length * slope + 1e-14:
            length /= 2
        else:
            w, high, step = w + length * step, new, None
    raise RuntimeError(f"rates have not settled in {rounds} rounds")


def rates(scored: DataFrame, w: np.ndarray, ridge: float = RIDGE) -> DataFrame:
    schema = T.StructType([*scored.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches):
        for batch in batches:
            p = batch.column(batch.schema.get_field_index("posterior")).flatten().to_numpy().reshape(-1, len(DOMAINS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_projected(p, w, ridge))], [f.name for f in schema.fields])

    return scored.mapInArrow(run, schema)


def mix(docs: DataFrame, labelled: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, keep_text: bool = True, ridge: float = RIDGE) -> DataFrame:
    """docs with n_tokens, posterior and rate: how often to draw each document. Every row stays; columns of these names are replaced.

    Without labelled rows the posterior is uniform. labelled: documents that labels refer to. For the fit, tokens are summed by
    posterior. keep_text=False leaves text out. achieved() tells what the rates come to.
    """
    ws = Workspace(docs.sparkSession, "mix")
    scored = posteriors(docs.drop("rate"), fit(labelled, labels))
    scored = ws.table("scored", scored if keep_text else scored.drop("text"))
    small = ws.table("sums", scored.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens")))
    return rates(scored, fit_rates(small, targets, ridge), ridge)


def achieved(mixed: DataFrame) -> dict[str, float]:
    """The share of expected tokens of each domain, of what mix() returns."""
    n = F.col("rate") * F.col("n_tokens")
    row = mixed.agg(*(F.sum(n * F.col("posterior")[i]).alias(d) for i, d in enumerate(DOMAINS)), F.sum(n).alias("all")).first()
    return {d: (row[d] or 0.0) / (row["all"] or 1.0) for d in DOMAINS}


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, posterior by domain and rate."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", "text"), docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False)
    return out.select("doc_id", "n_tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate")

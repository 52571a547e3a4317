"""A decision tree and a network with given parameters, projection pursuit, mixture rendering, k-means, rank correlation and summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.grid import Grid, jround
from gridloom.operators import cells, mining
from gridloom.plans.tables import keep

#: Leaves of the development tree, as (light below, population from, class with at least that population, class with less).
TREE = ((17.61, None, 0, 0), (48.91, None, 1, 1), (81.25, 31.77, 1, 2), (math.inf, 105.7, 2, 4))
#: Weights of population, bias and light of two hidden units; of both units and the bias of the output.
HIDDEN = ((3.06728, 3.26584, 1.77153), (0.00625, 2.82917, -0.03631))
OUTPUT = (2.4291, 3.12817, -11.29847)


def decision_tree(pop: Column, light: Column) -> Column:
    out = F.lit(None).cast("int")
    for below, at, more, less in reversed(TREE):
        leaf = F.lit(more) if at is None else F.when(pop >= at, more).otherwise(less)
        out = leaf if math.isinf(below) else F.when(light < below, leaf).otherwise(out)
    return out


def neural_net(pop: Column, light: Column) -> Column:
    """0..100: the network's probability of the richest class."""
    sigmoid = lambda x: 1 / (1 + F.exp(-x))
    h = [sigmoid(a * pop + b + c * light) for a, b, c in HIDDEN]
    return jround(100 * sigmoid(OUTPUT[0] * h[0] + OUTPUT[1] + OUTPUT[2] * h[1]))


def render_rbf(g: Grid, centres: list[tuple[float, float, float, float]], amplitudes) -> DataFrame:
    """row, col, value and fit: the sum of kernels with their amplitudes."""
    terms = [F.lit(float(w)) * F.exp(-F.pow((F.col("row") - a) / F.lit(float(s)), 2) - F.pow((F.col("col") - b) / F.lit(float(u)), 2)) for (a, b, s, u), w in zip(centres, amplitudes, strict=True)]
    return g.df.select("row", "col", "value", sum(terms, F.lit(0.0)).alias("fit"))


def simulate(g: Grid, centres: list[tuple[float, float, float, float]], amplitudes) -> Grid:
    """Rounded sums of kernels, 0 where they are not positive."""
    return Grid(render_rbf(g, centres, amplitudes).select("row", "col", F.when(F.col("fit") > 0, jround(F.col("fit"))).otherwise(0).alias("value")), g.meta)


def projection_pursuit(g: Grid, most_error: float, most: int) -> list[tuple[tuple[float, float, float, float], float]]:
    """Kernels ((row, col, sx, sy), amplitude), added one by one at the largest residual, all refitted each time.

    A kernel is as wide as the walk from its centre, along its row and its column, to half the largest residual. Ends when the sum of
    absolute residuals is at most most_error or there are most kernels. A round is two aggregations and a slice of one row and one column.
    """
    centres: list[tuple[float, float, float, float]] = []
    amplitudes: list[float] = []
    while len(centres) < most:
        left = render_rbf(g, centres, amplitudes).select("row", "col", (F.col("value") - F.col("fit")).alias("rest"))
        r = left.agg(F.sum(F.abs("rest")).alias("e"), F.max_by(F.struct("row", "col", "rest"), F.struct("rest", -F.col("row"), -F.col("col"))).alias("top")).first()
        if r["e"] is None or r["e"] <= most_error or r["top"]["rest"] <= 0:
            break
        row, col, top = r["top"]["row"], r["top"]["col"], r["top"]["rest"]
        low = F.col("rest") < top / 2
        wide = left.where(low).agg(F.min(F.when(F.col("col") == col, F.nullif(F.abs(F.col("row") - row), F.lit(0)))), F.min(F.when(F.col("row") == row, F.nullif(F.abs(F.col("col") - col), F.lit(0))))).first()
        centres.append((row, col, float(wide[0] or g.meta.nrows), float(wide[1] or g.meta.ncols)))
        amplitudes = [float(x) for x in mining.rbf_fit(g, centres)]
    return list(zip(centres, amplitudes, strict=True))


def gmm_start(g: Grid, k: int, apart: float = 10.0) -> list[tuple[float, float]]:
    """k centres at the highest cells that lie at least apart from all chosen before, in order of value, row and column."""
    chosen: list[tuple[float, float]] = []
    left = g.valid
    while len(chosen) < k:
        top = cells.argmax(Grid(left, g.meta)).first()
        if top is None:
            break
        chosen.append((float(top["row"]), float(top["col"])))
        left = left.where(F.pow(F.col("row") - top["row"], 2) + F.pow(F.col("col") - top["col"], 2) >= apart**2)
    return chosen


def gmm_render(g: Grid, components: list[tuple], scale: float) -> Grid:
    """Sum of the components' densities, each as a share of its peak, times scale."""
    total = F.lit(0.0)
    for mx, my, sxx, sxy, syy in components:
        if (det := sxx * syy - sxy * sxy) > 1e-9:
            x, y = F.col("row") - float(mx), F.col("col") - float(my)
            total = total + F.exp(-(float(syy) * x * x - 2 * float(sxy) * x * y + float(sxx) * y * y) / (2 * float(det)))
    return Grid(g.df.select("row", "col", jround(total * scale).alias("value")), g.meta)


#: Distinct rows that a partition of a k-means fit holds in memory.
FIT_ROWS = 100_000


def _weighted(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[float], list[float]]:
    """Distinct rows of features, standardised, as vectors in partitions of about FIT_ROWS, with how often each occurs (n); means and deviations.

    Rows with a null or NaN take no part. Partitions and their order follow the values alone, not the files or partitions of df.
    """
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(*(F.col(c).cast("double").alias(c) for c in features)).dropna()
    rows = keep(rows.groupBy(*features).agg(F.count("*").cast("double").alias("n")), "kmeans")
    many, total, *sums = rows.agg(F.count("*"), F.sum("n"), *(F.sum(F.col("n") * F.col(c)) for c in features)).first()
    if not many:
        raise ValueError("there are no rows without nulls")
    means = [x / total for x in sums]
    squares = rows.agg(*(F.sum(F.col("n") * F.pow(F.col(c) - m, 2)) for c, m in zip(features, means, strict=True))).first()
    deviations = [math.sqrt(x / max(total - 1, 1)) for x in squares]
    parts = rows.repartition(-(-many // FIT_ROWS), *features).sortWithinPartitions(*features)
    parts = parts.withColumns({c: (F.col(c) - m) / s if s else F.lit(0.0) for c, m, s in zip(features, means, deviations, strict=True)})
    return VectorAssembler(inputCols=features, outputCol="features").transform(parts).select("features", "n"), means, deviations


def kmeans(df: DataFrame, features: list[str], k: int = 3, seed: int = 1) -> tuple[list[list[float]], float]:
    """Centres in original units and the cost in standardised ones. Equal rows are one with a weight."""
    from pyspark.ml.clustering import KMeans

    rows, means, deviations = _weighted(df, features)
    model = KMeans(k=k, seed=seed, weightCol="n").fit(rows)
    return [[float(x) * s + m for x, s, m in zip(c, deviations, means, strict=True)] for c in model.clusterCenters()], float(model.summary.trainingCost)


def _ranked(values: DataFrame, key: str) -> DataFrame:
    """values with part and rank: places in the order of key, from range partitions and their sizes."""
    at = F.monotonically_increasing_id()
    order = keep(values.repartitionByRange(key).sortWithinPartitions(key).select("*", F.spark_partition_id().alias("part"), at.alias("i")), "kendall")
    parts = order.groupBy("part").agg(F.min("i").alias("at"), F.count("*").alias("size"))  # one row a partition
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return order.join(parts.select("part", "at", before.alias("before")), "part").withColumn("rank", F.col("i") - F.col("at") + F.col("before")).drop("i", "at", "before")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, from counts of pairs at each bit where two ranks part; no pair of rows is ever made. Null without pairs that differ.

    Two rows whose ranks of y first differ at a bit share the prefix above it, and agree if the one with that bit clear has the smaller
    x. Rows are counted by (prefix, x); running counts go within ranges of x, so that no task holds a whole prefix, and the ranges'
    totals are added to them.
    """
    v = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n"))
    v = keep(v, "kendall")
    xs = _ranked(v.groupBy("x").agg(F.sum("n").alias("nx")), "x")
    ys = keep(_ranked(v.groupBy("y").agg(F.sum("n").alias("ny")), "y"), "kendall")
    rows = keep(v.join(xs.select("x", "part"), "x").join(ys.select("y", F.col("rank").alias("r")), "y").select("x", "part", "r", "n"), "kendall")
    top = int(ys.agg(F.max("rank")).first()[0] or 0).bit_length()
    agree = None
    for b in range(top):
        clear = F.shiftright("r", b).bitwiseAND(F.lit(1)) == 0
        sums = [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("lo", clear), ("hi", ~clear))]
        by_x = rows.groupBy(F.shiftright("r", b + 1).alias("prefix"), "part", "x").agg(*sums)
        earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner, outer = Window.partitionBy("prefix", "part").orderBy("x"), Window.partitionBy("prefix").orderBy("part")
        totals = by_x.groupBy("prefix", "part").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi")).select("prefix", "part", earlier("lo", outer).alias("lo0"), earlier("hi", outer).alias("hi0"))
        one = by_x.select("*", earlier("lo", inner).alias("lo1"), earlier("hi", inner).alias("hi1")).join(totals, ["prefix", "part"])
        part = one.agg(F.sum(F.col("hi") * (F.col("lo0") + F.col("lo1"))).alias("c"), F.sum(F.col("lo") * (F.col("hi0") + F.col("hi1"))).alias("d"))
        agree = part if agree is None else agree.unionByName(part)
    if agree is None:
        return v.sparkSession.createDataFrame([(None,)], "tau double")
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    sums = agree.agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    tx = xs.agg(pairs("nx").alias("tx"))
    ty = ys.agg(pairs("ny").alias("ty"), F.sum("ny").alias("n"))
    every = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("c") - F.col("d"), F.sqrt((every - F.col("tx")) * (every - F.col("ty"))))
    return sums.join(tx).join(ty).select(tau.alias("tau"))  # each side is one row


def summary(df: DataFrame, value: str) -> DataFrame:
    """min, q1, median, mean, q3 and max; quartiles interpolate."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.agg(F.min(value).alias("min"), q(0.25).alias("q1"), q(0.5).alias("median"), F.avg(value).alias("mean"), q(0.75).alias("q3"), F.max(value).alias("max"))


def fit_tree(df: DataFrame, label: str, features: list[str], depth: int = 5, least: int = 20):
    """A classification tree on label (rounded), as a pipeline model; rows with a null take no part."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    tree = DecisionTreeClassifier(labelCol="__label", maxDepth=depth, minInstancesPerNode=least, seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), tree]).fit(_labelled(df, label))


def fit_net(df: DataFrame, label: str, features: list[str], hidden: int = 2, rounds: int = 100):
    """A network with one hidden layer on label (rounded, classes from 0), over standardised features, as a pipeline model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = _labelled(df, label)
    classes = int(rows.agg(F.max("__label")).first()[0] or 0) + 1
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(labelCol="__label", layers=[len(features), hidden, max(2, classes)], maxIter=rounds, seed=1)]
    return Pipeline(stages=stages).fit(rows)


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("__label", F.floor(F.col(label) + 0.5).cast("double")).where(F.col("__label") >= 0)


def confusion(model, df: DataFrame, label: str) -> DataFrame:
    """label (rounded), prediction and n of a fitted tree or net."""
    return model.transform(_labelled(df, label)).groupBy(F.col("__label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))

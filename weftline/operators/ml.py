"""Anomaly detectors over standardised account matrices.

Forests draw each tree's rows from the whole table by hash, so runs repeat; the other models are fitted on
one-pass sums; every row of the table is scored, in Arrow batches or plain expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.features import OUTLIER_FEATURES, max_abs, rank_normalised, standardised
from weftline.operators.neighbours import neighbour_scores
from weftline.operators.ordering import linear_quantiles, order_statistics, with_scalars
from weftline.session import cut, ship_package


# ---------------------------------------------------------------- isolation forest

def tree_samples(x: DataFrame, cols: Sequence[str], key: str, trees: int, size: int, seed: int) -> pd.DataFrame:
    """For each tree its own ``size`` rows of the whole table: those with the smallest hash of key and tree.

    Hashes above twice the share that is wanted are left out first, in the scan, so what is ranked does not grow with the
    table; a share that large misses no row of the ``size`` smallest but by an accident of many standard deviations, and then
    the tree has a few rows less.
    """
    n = x.count()
    share = min(1.0, 2.0 * size / max(n, 1))
    unit = lambda t: (F.shiftrightunsigned(F.xxhash64(F.col(key), t, F.lit(seed)), 11)) / float(1 << 53)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), unit(t).alias("h"))), lambda d: d["h"] < share)
    rows = x.select(key, *cols, F.explode(drawn).alias("d")).select("d.tree", "d.h", key, *cols)
    near = rows.withColumn("r", F.row_number().over(W.partitionBy("tree").orderBy("h", key))).where(F.col("r") <= size)
    return near.select("tree", key, *cols).orderBy("tree", key).toPandas()


def _grow(data: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """One tree as rows (feature, threshold, left, right, path length to add at a leaf)."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + _average_path(len(rows))])
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(data.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            return at
        f = int(rng.choice(usable))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        left = rows[:, f] < cut
        a, b = add(rows[left], depth + 1), add(rows[~left], depth + 1)
        nodes[at] = [f, cut, a, b, 0.0]
        return at

    add(data, 0)
    return np.array(nodes)


def _average_path(n: int) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _depths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        f = tree[at, 0].astype(int)
        inner = f >= 0
        if not inner.any():
            return tree[at, 4]
        rows = np.flatnonzero(inner)
        go_left = x[rows, f[rows]] < tree[at[rows], 1]
        at[rows] = np.where(go_left, tree[at[rows], 2], tree[at[rows], 3]).astype(int)


def isolation_scores(x: DataFrame, cols: Sequence[str], key: str = "account_no", trees: int = 50, sample: int = 512,
                     seed: int = 42, out: str = "isolation") -> DataFrame:
    """Anomaly score in (0, 1); short average paths score high."""
    ship_package(x.sparkSession)
    drawn = tree_samples(x, cols, key, trees, sample, seed)
    rng = np.random.default_rng(seed)
    size = int(drawn["tree"].value_counts().max()) if len(drawn) else 0
    forest = [_grow(rows[list(cols)].to_numpy(float), int(np.ceil(np.log2(max(size, 2)))), rng) for _, rows in drawn.groupby("tree", sort=True)]
    shared = x.sparkSession.sparkContext.broadcast(forest)
    norm = _average_path(size) or 1.0

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        m = values.to_numpy(float)
        total = sum((_depths(t, m) for t in shared.value), np.zeros(len(m)))
        return pd.Series(2.0 ** (-(total / max(len(shared.value), 1)) / norm))

    return x.select(key, score(F.struct(*cols)).alias(out))


def isolation_flagged(scores: DataFrame, contamination: float, col: str = "isolation") -> DataFrame:
    """Adds ``flagged``: the share ``contamination`` with the highest scores (exact quantile)."""
    limit = linear_quantiles(scores, [], col, {"q": 1.0 - contamination}, width=0.001).select("q")
    s = with_scalars(scores, limit)
    return s.withColumn("flagged", F.col(col) > F.col("scalars")["q"]).drop("scalars")


# ---------------------------------------------------------------- projections

def boundary_scores(x: DataFrame, cols: Sequence[str], key: str = "account_no", features: int = 128, seed: int = 42,
                    out: str = "boundary") -> DataFrame:
    """Distance to the mean of the data in random Fourier space: a one-class boundary with an RBF kernel."""
    ship_package(x.sparkSession)
    d = len(cols)
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 / d), size=(d, features))
    b = rng.uniform(0, 2 * np.pi, size=features)

    def lift(m):
        return np.sqrt(2.0 / features) * np.cos(m @ w + b)

    def partial(batches):
        total, n = np.zeros(features), 0
        for pdf in batches:
            total += lift(pdf[list(cols)].to_numpy(float)).sum(axis=0)
            n += len(pdf)
        yield pd.DataFrame({"i": np.arange(features), "s": total, "n": n})

    sums = x.select(*cols).mapInPandas(partial, "i int, s double, n long").groupBy("i").agg(
        F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    mean = np.array([r["s"] / max(r["n"], 1) for r in sums])

    @F.pandas_udf("double")
    def distance(values: pd.DataFrame) -> pd.Series:
        return pd.Series(np.linalg.norm(lift(values.to_numpy(float)) - mean, axis=1))

    return x.select(key, distance(F.struct(*cols)).alias(out))


def reconstruction_errors(x: DataFrame, cols: Sequence[str], key: str = "account_no", components: int = 12,
                          out: str = "pca") -> DataFrame:
    """Norm of what the leading principal components leave over."""
    ship_package(x.sparkSession)
    k = max(1, min(components, max(2, len(cols) - 1), len(cols)))
    vec = VectorAssembler(inputCols=list(cols), outputCol="v").transform(x.select(key, *cols))
    pc = np.array(PCA(k=k, inputCol="v", outputCol="p").fit(vec).pc.toArray())

    @F.pandas_udf("double")
    def residual(values: pd.DataFrame) -> pd.Series:
        m = values.to_numpy(float)
        return pd.Series(np.linalg.norm(m - (m @ pc) @ pc.T, axis=1))

    return x.select(key, residual(F.struct(*cols)).alias(out))


# ---------------------------------------------------------------- ensembles

DETECTORS = ("isolation", "boundary", "pca", "zscore")


def detector_ranks(x: DataFrame, cols: Sequence[str], key: str = "account_no") -> DataFrame:
    """Percentile ranks of the four detectors; forest scores outside the top tenth count as zero."""
    iso = isolation_flagged(isolation_scores(x, cols, key), 0.1).select(
        key, F.when(F.col("flagged"), F.col("isolation")).otherwise(0.0).alias("isolation"))
    parts = [rank_normalised(iso, "isolation", key, "r_isolation", 0.001),
             rank_normalised(boundary_scores(x, cols, key), "boundary", key, "r_boundary", 0.001),
             rank_normalised(reconstruction_errors(x, cols, key), "pca", key, "r_pca"),
             rank_normalised(max_abs(x, cols, key), "zscore", key, "r_zscore")]
    j = reduce(lambda a, b: a.join(b, key), parts)
    return j.select(key, *[F.round(f"r_{d}", 2).alias(d) for d in DETECTORS])


def ensemble_scores(matrix: DataFrame, cols: Sequence[str], key: str = "account_no", min_txns: int = 1) -> DataFrame:
    rows = matrix.where(F.col("txn_count") >= min_txns)
    # read by four detectors, two of which fit first: written once
    r = detector_ranks(cut(standardised(rows, cols, key)), cols, key)
    mean = reduce(lambda a, b: a + b, [F.col(d) for d in DETECTORS]) / len(DETECTORS)
    return r.withColumn("ensemble_score", F.round(mean, 2))


def outlier_list(matrix: DataFrame, contamination: float = 0.05, min_txns: int = 5, cap: int = 100) -> DataFrame:
    """Accounts flagged by the forest or by a feature at three deviations, most unusual first."""
    rows = cut(matrix.where(F.col("txn_count") >= min_txns))
    x = cut(standardised(rows, OUTLIER_FEATURES, eps=None))
    iso = isolation_flagged(isolation_scores(x, OUTLIER_FEATURES, trees=200, sample=256), contamination)
    z = max_abs(x, OUTLIER_FEATURES)
    ends = iso.agg(F.min("isolation").alias("lo"), F.max("isolation").alias("hi"))
    s = F.col("scalars")
    j = with_scalars(iso.join(z, "account_no").join(rows, "account_no"), ends)
    reasons = F.array_compact(F.array(
        F.when(F.col("flagged"), "unusual overall shape"), F.when(F.col("zscore") >= 3, "extreme feature value"),
        F.when(F.col("rapid_payouts") == 1, "rapid payouts"), F.when(F.col("dormant_activation") == 1, "dormant account reactivated")))
    out = j.where(F.col("flagged") | (F.col("zscore") >= 3)).select(
        "account_no", "txn_count", F.round("total_credit", 2).alias("total_credit"), F.round("total_debit", 2).alias("total_debit"),
        F.round("max_amount", 2).alias("max_amount"), F.round("zscore", 3).alias("zscore"),
        F.round((F.col("isolation") - s["lo"]) / (s["hi"] - s["lo"] + 1e-9) * 100, 2).alias("unified_score"),
        F.concat(F.lit("Marked suspicious due to: "), F.array_join(reasons, ", ")).alias("explanation"))
    return out.orderBy(F.desc("unified_score"), F.desc("max_amount"), "account_no").limit(cap)


def feature_importance(matrix: DataFrame, cols: Sequence[str] = OUTLIER_FEATURES, top: int = 12) -> DataFrame:
    """Mean absolute z of each feature, in percent."""
    z = standardised(matrix, cols, log=False, eps=None)
    long = z.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.col(c)).alias("z")) for c in cols])).alias("f"))
    return (long.groupBy(F.col("f.feature").alias("feature")).agg((F.round(F.avg("f.z"), 2) * 100).alias("importance"))
            .orderBy(F.desc("importance"), "feature").limit(top))


def deviating_features(matrix: DataFrame, cols: Sequence[str] = OUTLIER_FEATURES, top: int = 3) -> DataFrame:
    """Each account's most deviating features: (account_no, rank, feature, z). Sorted inside the row."""
    z = standardised(matrix, cols, log=False, eps=None)
    pairs = F.array_sort(F.array(*[F.struct((-F.round(F.abs(F.col(c)), 4)).alias("k"), F.lit(c).alias("feature")) for c in cols]))
    return (z.select("account_no", F.posexplode(F.slice(pairs, 1, top)).alias("i", "f"))
            .select("account_no", (F.col("i") + 1).alias("rank"), "f.feature", (-F.col("f.k")).alias("z")))


def stratified_split(rows: DataFrame, key: str, label: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Rows with ``train``: in every class the share of keys with the smallest hashes, so that each part holds exactly its quota.

    A class of two and more rows has at least one in each part; a single row is trained on. The hash at the quota is found by
    counting hashes by range, not by sorting a class in one task. Rows whose keys are equal go together.
    """
    marked = rows.withColumn("__hash", F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), 16))
    n = F.col("n")
    quota = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * share + 0.5)))
    last = order_statistics(marked, [label], "__hash", {"__last": (quota - 1).cast("long")}, width=float(2 ** 36)).select(label, "__last")
    return marked.join(F.broadcast(last), label).withColumn("train", F.col("__hash") <= F.col("__last")).drop("__hash", "__last")


def supervised_scores(matrix: DataFrame, labels: DataFrame, cols: Sequence[str], key: str = "account_no", seed: int = 42) -> DataFrame:
    """Forest and boosted-tree probabilities, trained on a stratified 70 % split, as percentile ranks.

    ``labels`` holds the positive keys. Classes are balanced by weight. ``train`` tells the rows that the models were fitted on.
    """
    x = cut(standardised(matrix, cols, key)).join(labels.select(key).distinct().withColumn("label", F.lit(1.0)), key, "left")
    x = VectorAssembler(inputCols=list(cols), outputCol="v").transform(x.withColumn("label", F.coalesce("label", F.lit(0.0))))
    x = cut(stratified_split(x, key, "label", 0.7, seed))
    train = x.where("train")
    stats = train.agg(F.avg("label").alias("p"))
    p = F.col("scalars")["p"]
    train = with_scalars(train, stats).withColumn("weight", F.when(F.col("label") == 1, 0.5 / F.greatest(p, F.lit(1e-9))).otherwise(
        0.5 / F.greatest(1 - p, F.lit(1e-9)))).drop("scalars")
    out = x.select(key, "label", "train")
    for name, est in (("random_forest", RandomForestClassifier(numTrees=50, seed=seed)), ("boosted_trees", GBTClassifier(maxIter=20, maxDepth=4, seed=seed))):
        model = est.setFeaturesCol("v").setLabelCol("label").setWeightCol("weight").fit(train)
        prob = model.transform(x).select(key, vector_to_array("probability")[1].alias("prob"))
        ranked = rank_normalised(prob, "prob", key, name, 0.001).select(key, F.round(name, 2).alias(name))
        out = out.join(ranked, key)
    return out


def embedding_signals(e: DataFrame, key: str = "node", components: int = 8) -> DataFrame:
    """Distance to the centroid, mean distance to five neighbours, PCA residual."""
    cols = [c for c in e.columns if c != key]
    e = cut(e)
    stats = e.agg(*[F.avg(c).alias(c) for c in cols])
    s = F.col("scalars")
    centred = with_scalars(e, stats).select(key, *[(F.col(c) - s[c]).alias(c) for c in cols])
    dist = F.sqrt(reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in cols]))
    return (centred.select(key, dist.alias("embed_dist_centroid"))
            .join(neighbour_scores(e, cols, "knn", key, k=5, out="embed_knn_dist"), key)
            .join(reconstruction_errors(centred, cols, key, components, out="embed_pca_error"), key))

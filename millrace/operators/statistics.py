"""Paired and rank statistics as aggregates, and exact bounds on small tables of counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def auroc(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """Rank-sum AUROC with shared ranks for ties; null where a class is empty. Equal scores are merged first, so the
    window runs over distinct scores and ties cost nothing."""
    g = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    below = F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("u", F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("q") / 2))
    return g.groupBy(*by).agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("q")).alias("auroc"), F.sum("p").alias("positives"), F.sum("q").alias("negatives"))


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Correlation of average ranks; null for a constant side."""
    from millrace.operators.windows import average_ranks

    d = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, a, "__ra"), by, b, "__rb")
    n, s = F.count(F.lit(1)), lambda c: F.sum(c)
    num = n * s(F.col("__ra") * F.col("__rb")) - s("__ra") * s("__rb")
    va, vb = n * s(F.col("__ra") ** 2) - s("__ra") ** 2, n * s(F.col("__rb") ** 2) - s("__rb") ** 2
    return d.groupBy(*by).agg(F.try_divide(num, F.sqrt(va * vb)).alias("spearman"), n.alias("n"))


def z_within(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """(x - mean) / population deviation within a group; null where the deviation is zero."""
    w = Window.partitionBy(*group)
    return df.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def explained_variance(df: DataFrame, group: str, value: str) -> DataFrame:
    """Between-group share of the sum of squares."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(F.lit(1)).alias("n"))
    total, n, q = F.sum("s"), F.sum("n"), F.sum("q")
    return g.agg(F.try_divide(F.sum(F.col("s") * F.col("s") / F.col("n")) - total * total / n, q - total * total / n).alias("explained"), n.alias("n"))


def ndcg(df: DataFrame, query: str, score: Column, gain: str, tie: str, k: int) -> DataFrame:
    """NDCG at k by query; null without gain."""
    w = Window.partitionBy(query)
    d = df.withColumn("__r", F.row_number().over(w.orderBy(score.desc(), F.col(tie)))).withColumn("__i", F.row_number().over(w.orderBy(F.col(gain).desc(), F.col(tie))))
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col(gain) / F.log2(F.col(r) + 1.0)))
    return d.groupBy(query).agg(F.try_divide(part("__r"), part("__i")).alias("ndcg"))


def hoeffding(df: DataFrame, by: list[str], value: str, weight: Column, delta: float, low: float = 0, high: float = 1) -> DataFrame:
    """Weighted mean, effective n and the one-sided Hoeffding lower bound."""
    d = df.where(F.col(value).isNotNull()).withColumn("__w", weight)
    n_eff = F.try_divide(F.sum("__w") ** 2, F.sum(F.col("__w") ** 2))
    mean = F.try_divide(F.sum(F.col("__w") * F.col(value)), F.sum("__w"))
    return d.groupBy(*by).agg(mean.alias("mean"), n_eff.alias("n_eff"), (mean - (high - low) * F.sqrt(F.lit(math.log(1 / delta)) / (2 * n_eff))).alias("lower"))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    i = np.arange(k, n + 1)
    logs = np.array([log_choose(n, int(j)) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def clopper_pearson(k: int, n: int, alpha: float, side: str = "two") -> tuple[float, float]:
    """Exact binomial bounds by bisection on the tail; a one-sided bound spends all of alpha."""
    a = alpha / 2 if side == "two" else alpha

    def solve(f):
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    low = 0.0 if k == 0 or side == "upper" else solve(lambda p: binomial_tail(k, n, p) < a)
    high = 1.0 if k == n or side == "lower" else solve(lambda p: 1 - binomial_tail(k + 1, n, p) > a)
    return low, high


def binomial_bounds(counts: DataFrame, k: str, n: str, alpha: float, side: str = "two") -> DataFrame:
    """Counts by group with exact bounds; one row for each group reaches Python."""

    @F.pandas_udf("low double, high double")
    def bounds(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(x), int(y), alpha, side) if y else (0.0, 1.0) for x, y in zip(a, b, strict=True)], columns=["low", "high"])

    return counts.withColumn("__b", bounds(k, n)).select(*counts.columns, "__b.low", "__b.high")


def mcnemar(counts: DataFrame, b: str, c: str) -> DataFrame:
    """Exact two-sided McNemar p-value and its mid-p from discordant counts."""

    @F.pandas_udf("p double, mid_p double")
    def test(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for i, j in zip(x, y, strict=True):
            n, m = int(i + j), int(min(i, j))
            tail = 1 - binomial_tail(m + 1, n, 0.5)
            point = math.exp(log_choose(n, m) - n * math.log(2))
            out.append((min(1.0, 2 * tail), min(1.0, 2 * tail - point)) if n else (1.0, 1.0))
        return pd.DataFrame(out, columns=["p", "mid_p"])

    return counts.withColumn("__t", test(b, c)).select(*counts.columns, "__t.p", "__t.mid_p")


def gram(df: DataFrame, vector: str) -> np.ndarray:
    """The d x d sum of outer products: one pass, d * d numbers to the driver whatever the rows. Vectors that are null or
    hold nulls are left out; all others must have one length, that of the longest."""
    df = df.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector), lambda x: x.isNull()))
    d = df.agg(F.max(F.size(vector)).alias("d")).first().d or 0
    if not d:
        return np.zeros((0, 0))

    def run(batches):
        g = np.zeros((d, d))
        for pdf in batches:
            x = np.array(pdf[vector].dropna().tolist(), float).reshape(-1, d)
            g += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(d), d), "j": np.tile(np.arange(d), d), "g": g.ravel()})

    rows = df.select(vector).mapInPandas(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    out = np.zeros((d, d))
    for r in rows:
        out[r.i, r.j] = r.g
    return out


def pca(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """The first k right singular vectors, not centred, signs fixed by the largest entry; from the Gram matrix. Fewer, if
    vectors are shorter; none for an empty table."""
    g = gram(df, vector)
    if not g.size:
        return np.zeros((0, 0))
    w, v = np.linalg.eigh(g)
    k = min(k, len(w))
    basis = v[:, np.argsort(-w)[:k]].T
    return basis * np.sign(basis[np.arange(k), np.abs(basis).argmax(1)])[:, None]


def subspace_score(df: DataFrame, vector: str, basis: np.ndarray, out: str) -> DataFrame:
    """Length of the projection on the basis over the length of the vector; null for null vectors and those with nulls."""
    b = np.asarray(basis)

    @F.pandas_udf(T.DoubleType())
    def share(s: pd.Series) -> pd.Series:
        ok = [v is not None and len(v) == b.shape[1] and not any(e is None for e in v) for v in s]
        x = np.array([v for v, o in zip(s, ok, strict=True) if o], float).reshape(-1, max(1, b.shape[1]))
        out = pd.Series([None] * len(s), dtype="float64")
        if len(x):
            out[np.array(ok)] = np.linalg.norm(x @ b.T, axis=1) / np.maximum(np.linalg.norm(x, axis=1), 1e-12)
        return out

    return df.withColumn(out, share(vector))


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> np.ndarray:
    """Ridge weights from sums of products taken in the JVM; only the solve is on the driver."""
    cols = [*features, target]
    sums = df.where(" and ".join(f"{c} is not null" for c in cols)).agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]).first()
    n = len(features)
    g, y = np.zeros((n, n)), np.zeros(n)
    for i in range(n):
        y[i] = sums[f"{i}_{n}"]
        for j in range(i, n):
            g[i, j] = g[j, i] = sums[f"{i}_{j}"]
    return np.linalg.solve(g + penalty * np.eye(n), y)

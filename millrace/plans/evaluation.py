"""Paired statistics, rank statistics and vector reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import statistics as X
from millrace.plans.registry import query


@query("stat_auroc", """
WITH d AS (SELECT lang, quality AS y, n_chars AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM d),
a AS (SELECT lang, sum(y) AS p, count(*) - sum(y) AS q, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS sr FROM r GROUP BY lang)
SELECT lang, CASE WHEN p * q > 0 THEN round((sr - p * (p + 1) / 2.0) / (p * q), 6) END AS auroc, p::BIGINT AS positives, q::BIGINT AS negatives FROM a""")
def auroc(t):
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    return X.auroc(d, "quality", "n_chars", ["lang"]).withColumn("auroc", F.round("auroc", 6))


@query("stat_spearman", """
WITH d AS (SELECT o_orderpriority AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS b FROM orders)
SELECT g AS o_orderpriority, round(corr(a, b), 5) AS spearman, count(*) AS n FROM d GROUP BY g""")
def spearman(t):
    return X.spearman(t.orders.select("o_orderpriority", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey", ["o_orderpriority"]).withColumn("spearman", F.round("spearman", 5))


@query("stat_mcnemar_counts", "SELECT lang, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS b, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS c, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def mcnemar_counts(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    return d.groupBy("lang").agg(F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")).alias("b"), F.sum(((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("long")).alias("c"), F.count(F.lit(1)).alias("n"))


@query("stat_mcnemar_exact")
def mcnemar(t):
    return X.mcnemar(mcnemar_counts(t), "b", "c")


@query("stat_clopper_pearson")
def bounds(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    return X.binomial_bounds(d, "k", "n", 0.05)


@query("stat_paired_interval", """
WITH c AS (SELECT count(*) AS n, sum((quality = 1 AND toxic = 0)::INT) AS b, sum((quality = 0 AND toxic = 1)::INT) AS c FROM labels)
SELECT round((c - b) / n, 6) AS delta, round((c - b) / n - 1.959963984540054 * sqrt((b + c) / n - power((c - b) / n, 2)) / sqrt(n), 6) AS low, round((c - b) / n + 1.959963984540054 * sqrt((b + c) / n - power((c - b) / n, 2)) / sqrt(n), 6) AS high FROM c""")
def paired_interval(t):
    """Wald interval of a paired difference."""
    c = t.labels.agg(F.count(F.lit(1)).alias("n"), F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("b"), F.sum(((F.col("quality") == 0) & (F.col("toxic") == 1)).cast("int")).alias("c"))
    d = (F.col("c") - F.col("b")) / F.col("n")
    h = 1.959963984540054 * F.sqrt((F.col("b") + F.col("c")) / F.col("n") - d * d) / F.sqrt("n")
    return c.select(F.round(d, 6).alias("delta"), F.round(d - h, 6).alias("low"), F.round(d + h, 6).alias("high"))


@query("stat_hoeffding", """
WITH d AS (SELECT lang, quality::DOUBLE AS v, n_chars + 1.0 AS w FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, sum(w * v) / sum(w) AS m, power(sum(w), 2) / sum(w * w) AS e FROM d GROUP BY lang)
SELECT lang, round(m, 6) AS mean, round(e, 4) AS n_eff, round(m - sqrt(ln(20) / (2 * e)), 6) AS lower FROM g""")
def hoeffding(t):
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    h = X.hoeffding(d, ["lang"], "quality", F.col("n_chars") + 1.0, 0.05)
    return h.select("lang", F.round("mean", 6).alias("mean"), F.round("n_eff", 4).alias("n_eff"), F.round("lower", 6).alias("lower"))


@query("stat_z_within", "SELECT doc_id, round((n_chars - avg(n_chars) OVER w) / nullif(stddev_pop(n_chars) OVER w, 0), 5) AS z FROM documents WINDOW w AS (PARTITION BY lang)")
def z_within(t):
    return X.z_within(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", "z").select("doc_id", F.round("z", 5).alias("z"))


@query("stat_explained_variance", """
WITH g AS (SELECT c_mktsegment, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q, count(*) AS n FROM customer GROUP BY 1) SELECT round((sum(s * s / n) - power(sum(s), 2) / sum(n)) / (sum(q) - power(sum(s), 2) / sum(n)), 6) AS explained, sum(n)::BIGINT AS n FROM g""")
def explained(t):
    return X.explained_variance(t.customer, "c_mktsegment", "c_acctbal").withColumn("explained", F.round("explained", 6))


@query("stat_risk_coverage", """
WITH g AS (SELECT source, avg(toxic) AS r, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), t AS (SELECT unnest([5, 10, 15, 20, 30]) AS tau)
SELECT tau, round(sum(CASE WHEN r * 100 <= tau THEN n ELSE 0 END) / sum(n), 6) AS coverage, round(sum(CASE WHEN r * 100 <= tau THEN r * n END) / sum(CASE WHEN r * 100 <= tau THEN n END), 6) AS risk FROM g, t GROUP BY tau""")
def risk_coverage(t):
    g = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.avg("toxic").alias("r"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in (5, 10, 15, 20, 30)])))
    ok = F.col("r") * 100 <= F.col("tau")
    return g.groupBy("tau").agg(F.round(F.sum(F.when(ok, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"), F.round(F.try_divide(F.sum(F.when(ok, F.col("r") * F.col("n"))), F.sum(F.when(ok, F.col("n")))), 6).alias("risk"))


@query("stat_symmetry", """
WITH m AS (SELECT o_custkey % 10 AS i, o_orderkey % 10 AS j, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT count(*) AS pairs, round(corr(a.v, b.v), 5) AS symmetry FROM m a JOIN m b ON a.i = b.j AND a.j = b.i WHERE a.i < a.j""")
def symmetry(t):
    m = t.orders.groupBy((F.col("o_custkey") % 10).alias("i"), (F.col("o_orderkey") % 10).alias("j")).agg(F.avg("o_totalprice").alias("v"))
    b = m.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return m.join(b, ["i", "j"]).where("i < j").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.corr("v", "w"), 5).alias("symmetry"))


@query("stat_linear_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem")
def linear_fit(t):
    """Least squares from sums; the same sums serve the ridge solver."""
    return t.lineitem.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"), F.count(F.lit(1)).alias("n"))


@query("stat_subspace_scores")
def subspace(t):
    basis = X.pca(t.embeddings, "embedding", 4)
    return X.subspace_score(t.embeddings.select("vec_id", "embedding"), "embedding", basis, "score").select("vec_id", F.round("score", 6).alias("score"))


@query("stat_softmax_entropy", """
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice / 100000 AS x, max(o_totalprice / 100000) OVER w AS m FROM orders WINDOW w AS (PARTITION BY o_custkey)), p AS (SELECT o_custkey, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY o_custkey) AS p FROM s)
SELECT o_custkey, round(-sum(p * ln(p)), 5) + 0.0 AS entropy FROM p GROUP BY o_custkey""")
def softmax(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    s = t.orders.select("o_custkey", (F.col("o_totalprice") / 100000).alias("x")).withColumn("e", F.exp(F.col("x") - F.max("x").over(w)))
    return s.withColumn("p", F.col("e") / F.sum("e").over(w)).groupBy("o_custkey").agg((F.round(-F.sum(F.col("p") * F.ln("p")), 5) + 0.0).alias("entropy"))


@query("stat_pair_margins", """
SELECT l_orderkey, round(max(power(greatest(0.5 - (l_discount - l_tax), 0), 2)), 6) AS worst, round(sum(power(greatest(0.5 - (l_discount - l_tax), 0), 2)), 5) AS total FROM lineitem GROUP BY l_orderkey""")
def margins(t):
    h = F.pow(F.greatest(0.5 - (F.col("l_discount") - F.col("l_tax")), F.lit(0.0)), 2)
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.max(h), 6).alias("worst"), F.round(F.sum(h), 5).alias("total"))


@query("stat_kmeans_sizes")
def kmeans(t):
    """K-means from a fixed seed by Spark ML; sizes and mean distances of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    m = KMeans(k=8, seed=1, maxIter=10).fit(d)
    return m.transform(d).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))

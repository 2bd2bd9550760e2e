"""Accounting and evaluation aggregates. Incomplete groups give null, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def composition(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def compact_ledger(df: DataFrame, task: str, order: str, tokens: str, verified: Column, demo: str, limit: int) -> DataFrame:
    """Per task: attempts, tokens, the last verified demo, and whether it was given up (attempts used, none verified)."""
    return df.groupBy(task).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum(tokens).alias("tokens"), F.max_by(F.when(verified, F.col(demo)), F.when(verified, F.col(order))).alias("last_demo"),
        (~F.bool_or(verified) & (F.count(F.lit(1)) >= limit)).alias("infeasible"))


def latest(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last non-null value of each column by key: later records overwrite what they state."""
    return df.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def seed_stats(df: DataFrame, key: list[str], value: str, complete: Column | None = None) -> DataFrame:
    """Mean, sample deviation (null under two), count; incomplete runs don't count but keep their spend elsewhere."""
    d = df if complete is None else df.where(complete)
    return d.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def macro_average(df: DataFrame, over: list[str], category: str, value: str, expected: int | None = None) -> DataFrame:
    """Equal-weight mean of category means; null if a category is missing or has no value."""
    per = df.groupBy(*over, category).agg(F.avg(value).alias("__m"))
    out = per.groupBy(*over).agg(F.avg("__m").alias("macro"), F.count("__m").alias("__n"), F.count(F.lit(1)).alias("__all"))
    want = F.lit(expected) if expected is not None else F.col("__all")
    return out.select(*over, F.when(F.col("__n") == want, F.col("macro")).alias("macro"), F.col("__n").alias("n_categories"))


def weighted_overall(df: DataFrame, group: Column, value: Column, weights: dict[str, float]) -> DataFrame:
    """Group means under fixed weights, normalised over the groups that are there."""
    per = df.groupBy(group.alias("__g")).agg(F.avg(value).alias("__m"))
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("__g"))
    return per.agg((F.sum(w * F.col("__m")) / F.sum(F.when(F.col("__m").isNotNull(), w))).alias("overall"), F.count("__m").alias("n_groups"))


def beta_mean(successes: Column, n: Column) -> Column:
    """Posterior mean under a uniform prior."""
    return (successes + 1) / (n + 2)


def transition_counts(df: DataFrame, before: str, after: str, by: list[str]) -> DataFrame:
    """Repaired, damaged, kept right and kept wrong on the rows that have both outcomes."""
    both = df.where(F.col(before).isNotNull() & F.col(after).isNotNull())
    c = lambda x, y: F.sum(((F.col(before) == x) & (F.col(after) == y)).cast("long"))
    return both.groupBy(*by).agg(c(0, 1).alias("repaired"), c(1, 0).alias("damaged"), c(1, 1).alias("kept_right"), c(0, 0).alias("kept_wrong"))


def cluster_mean(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Mean of cluster means, its least leave-one-cluster-out value, and the clusters' signs."""
    per = df.groupBy(cluster).agg(F.avg(value).alias("m"))
    t = per.agg(F.sum("m").alias("s"), F.count("m").alias("n"))
    return per.crossJoin(F.broadcast(t)).agg(
        F.avg("m").alias("mean"), F.min(F.try_divide(F.col("s") - F.col("m"), F.col("n") - 1)).alias("least_without_one"),
        F.sum((F.col("m") > 0).cast("long")).alias("positive"), F.sum((F.col("m") < 0).cast("long")).alias("negative"), F.count("m").alias("n_clusters"))


def distribution(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """Linear quantiles and a histogram of right-closed bins (the first closed on both sides); nulls as missing."""
    v = F.col(value)
    bins = [F.sum(((v >= a if i == 0 else v > a) & (v <= b)).cast("long")).alias(f"bin_{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    q = [F.percentile(v, F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return df.groupBy(*by).agg(*q, *bins, F.sum(v.isNull().cast("long")).alias("missing"))


def cost_shares(df: DataFrame, task: str, cost: str, out: str = "share") -> DataFrame:
    """A task's cost spread evenly over its rows, so that the shares of a task add up to its cost."""
    return df.withColumn(out, F.col(cost) / F.count(F.lit(1)).over(Window.partitionBy(task)))


def apportion(df: DataFrame, group: list[str], order: list[Column], weight: str, total: Column, out: str) -> DataFrame:
    """Whole parts of a total by weight: floors, then one more to the first rows until the total is reached."""
    w = Window.partitionBy(*group)
    share = F.floor(total * F.col(weight) / F.sum(weight).over(w))
    d = df.withColumn("__s", share).withColumn("__rest", total - F.sum("__s").over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order)))
    return d.withColumn(out, (F.col("__s") + (F.col("__r") <= F.col("__rest")).cast("long")).cast("long")).drop("__s", "__rest", "__r")


def nested_mass(df: DataFrame, levels: list[str], out: str = "mass") -> DataFrame:
    """Each row's share if mass is split evenly at every level of a nesting. Counts are aggregates that combine before the
    shuffle, each level's from the one below. Null levels are values like any other."""
    same = lambda n: reduce(lambda x, y: x & y, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in levels[:n]])
    paths = df.groupBy(*levels).agg(F.count(F.lit(1)).alias("__rows")).withColumn("__m", F.lit(1.0) / F.col("__rows"))
    for i in range(len(levels), 0, -1):
        per = paths.select(*levels[:i]).distinct().groupBy(*levels[: i - 1]).agg(F.count(F.lit(1)).alias("__c"))
        if i == 1:
            paths = paths.crossJoin(F.broadcast(per))  # one row
        else:
            paths = paths.alias("l").join(per.alias("r"), same(i - 1)).select("l.*", "r.__c")
        paths = paths.withColumn("__m", F.col("__m") / F.col("__c")).drop("__c")
    got = df.alias("l").join(paths.alias("r"), same(len(levels)))
    return got.select("l.*", F.col("r.__m").alias(out))


def exposure(df: DataFrame, p: str, cost: str) -> DataFrame:
    """Inverse-cost exposure: q = (p / c) / Z and rho = Z c with Z the sum of p / c."""
    z = df.agg(F.sum(F.col(p) / F.col(cost)).alias("__z"))
    return df.crossJoin(F.broadcast(z)).withColumn("exposure", F.col(p) / F.col(cost) / F.col("__z")).withColumn("ratio", F.col("__z") * F.col(cost)).drop("__z")


def matrix(df: DataFrame, row: str, column: str, seed: str, value: str, seeds: int) -> DataFrame:
    """Cells as means, null unless all seeds have a value."""
    return df.groupBy(row, column).agg(F.when(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(seed))) == seeds, F.avg(value)).alias("cell"), F.count(value).alias("n"))


def affordability(df: DataFrame, cap: str, by: list[str], total: int, percents: list[int]) -> DataFrame:
    """At each share of a total: how many items can be afforded and how many of the dearest would fit."""
    p = df.sparkSession.createDataFrame([(x,) for x in percents], "percent int")
    budget = F.expr(f"cast({int(total)} as bigint) * percent div 100")
    got = df.crossJoin(F.broadcast(p)).withColumn("budget", budget)
    out = got.groupBy("percent", "budget", *by).agg(F.sum((F.col(cap) <= F.col("budget")).cast("long")).alias("affordable"), F.count(F.lit(1)).alias("available"), F.max(cap).alias("dearest"))
    return out.withColumn("capacity", F.least(F.col("available"), F.expr("budget div dearest")))


def mass_overlap(df: DataFrame, side: str, key: str, mass: str) -> DataFrame:
    """Sum of the smaller share by key of two sides, and how many keys are shared or one-sided."""
    g = df.groupBy(key).pivot(side, ["left", "right"]).agg(F.sum(mass)).fillna(0)
    t = g.agg(F.sum("left").alias("__l"), F.sum("right").alias("__r"))
    return g.crossJoin(F.broadcast(t)).agg(
        F.sum(F.least(F.col("left") / F.col("__l"), F.col("right") / F.col("__r"))).alias("overlap"),
        F.sum(((F.col("left") > 0) & (F.col("right") > 0)).cast("long")).alias("shared"),
        F.sum(((F.col("left") > 0) & (F.col("right") == 0)).cast("long")).alias("left_only"), F.sum(((F.col("left") == 0) & (F.col("right") > 0)).cast("long")).alias("right_only"))


def count_from_rate(rate: Column, n: Column) -> Column:
    """The whole count behind a published rate, rounded half to even, within 0 and n."""
    return F.least(F.greatest(F.bround(rate * n, 0).cast("long"), F.lit(0)), n)


def reconcile(ids: DataFrame, failures: DataFrame, key: list[str], category: str) -> DataFrame:
    """Verdicts by category: right is whatever was asked and didn't fail; failures never asked are counted as unknown."""
    asked = ids.select(*key, category)
    bad = failures.select(*key).distinct().withColumn("__bad", F.lit(1))
    got = asked.join(bad, key, "full_outer")
    return got.groupBy(category).agg(F.count(F.when(F.col(category).isNotNull(), 1)).alias("total"), F.count(F.when(F.col(category).isNotNull() & F.col("__bad").isNull(), 1)).alias("correct"), F.count(F.when(F.col(category).isNull(), 1)).alias("unknown"))


def weighted_by_component(df: DataFrame, vector: str, value: Column) -> DataFrame:
    """For each component k: sum of |z_k| v over sum of |z_k|, null values left out."""
    e = df.select(F.posexplode(vector).alias("component", "z"), value.alias("v")).where("v is not null")
    return e.groupBy("component").agg(F.try_divide(F.sum(F.abs("z") * F.col("v")), F.sum(F.abs("z"))).alias("weighted_mean"), F.count(F.lit(1)).alias("n"))

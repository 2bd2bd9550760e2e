"""Ranked and greedy selection under a budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import hash_rank_key
from millrace.operators.windows import fill_within_budget, take_within_budget

#: Order expressions of the selection conditions; `cost`, `score`, `nll`, `similarity` and `id` are the columns used.
CONDITIONS = {
    "all": lambda salt: [F.col("id")],
    "random": lambda salt: [hash_rank_key(salt, "id"), F.col("id")],
    "score": lambda salt: [F.desc("score"), F.col("id")],
    "density": lambda salt: [F.desc(F.col("score") / F.greatest("cost", F.lit(1))), F.col("id")],
    "least_similar": lambda salt: [F.col("similarity"), F.col("id")],
    "most_similar": lambda salt: [F.desc("similarity"), F.col("id")],
    "likely": lambda salt: [F.col("nll"), F.col("id")],
    "unlikely": lambda salt: [F.desc("nll"), F.col("id")],
    "cheapest": lambda salt: [F.col("cost"), F.col("id")],
}


def select(pool: DataFrame, condition: str, budget: float, admit: Column | None = None, salt: str = "select") -> DataFrame:
    """Order x admission x budget: the rows up to the first that would overflow."""
    d = pool if admit is None else pool.where(admit)
    return take_within_budget(d, CONDITIONS[condition](salt), F.col("cost"), budget)


def select_filling(pool: DataFrame, group: list[str], order: str, budget: int) -> DataFrame:
    """The same with rows skipped that don't fit, for each group."""
    kept = fill_within_budget(pool, group, [order], "id", "cost", budget)
    return pool.join(kept, [*group, "id"], "left_semi")


def knapsack(df: DataFrame, group: list[str], budget: float, limit: int) -> DataFrame:
    """By value over cost, skipping what doesn't fit, at most `limit` items; if one item alone is worth more, that one.
    Groups are packages of a bounded size: a group's (id, value, cost) are one row, and many rows are one batch. Items with
    a null id, value or cost are left out; ties go by id."""
    item = F.struct(F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"), F.col("cost").cast("double").alias("cost"))
    rows = df.where((F.col("cost") <= budget) & F.col("value").isNotNull() & F.col("id").isNotNull()).groupBy(*group).agg(F.collect_list(item).alias("__items"))

    @F.pandas_udf("array<long>")
    def pick(s: pd.Series) -> pd.Series:
        out = []
        for items in s:
            spent, keep, worth = 0.0, [], 0.0
            for r in sorted(items, key=lambda r: (-r["value"] / max(r["cost"], 1e-12), r["id"])):
                if spent + r["cost"] <= budget and len(keep) < limit:
                    spent, worth = spent + r["cost"], worth + r["value"]
                    keep.append(r["id"])
            best = min(items, key=lambda r: (-r["value"], r["id"]))
            out.append([best["id"]] if best["value"] > worth else keep)
        return pd.Series(out)

    return rows.select(*group, F.explode(pick("__items")).alias("id"))


def budget_distribution(values: np.ndarray, costs: np.ndarray, budget: float, tau: float) -> np.ndarray:
    """Probabilities exp((v - lambda c) / tau) whose expected cost is the budget at most; lambda by bisection."""

    def p(lam):
        e = (values - lam * costs) / tau
        e = np.exp(e - e.max())
        return e / e.sum()

    lo, hi = 0.0, 1.0
    if p(0.0) @ costs <= budget:
        return p(0.0)
    while p(hi) @ costs > budget and hi < 1e12:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p(mid) @ costs > budget else (lo, mid)
    return p(hi)


def self_consistent(df: DataFrame, item: str, value: str, samples: int, tolerance: float = 0) -> DataFrame:
    """Items with the wanted number of samples, all there and equal within a tolerance."""
    g = df.groupBy(item).agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("spread"), F.count(F.lit(1)).alias("all"))
    return g.where((F.col("n") == samples) & (F.col("all") == samples) & (F.col("spread") <= tolerance)).select(item)


def preference_pairs(df: DataFrame, prompt: str, answer: str, right: Column, order: str, per_prompt: int = 2) -> DataFrame:
    """Distinct wrong answers of a prompt, first seen first, at most `per_prompt`, each with the prompt's first right one."""
    good = df.where(right).groupBy(prompt).agg(F.min_by(answer, F.struct(order, answer)).alias("chosen"))
    bad = df.where(~right).groupBy(prompt, answer).agg(F.min(order).alias("__o"))
    w = Window.partitionBy(prompt).orderBy("__o", answer)
    bad = bad.withColumn("pair", F.row_number().over(w)).where(F.col("pair") <= per_prompt).select(prompt, F.col(answer).alias("rejected"), "pair")
    return bad.join(good, prompt)


def best_of(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Best and worst row of each key (ties by the smaller tie column)."""
    return df.groupBy(key).agg(F.max_by(tie, F.struct(F.col(value), -F.col(tie))).alias("best"), F.min_by(tie, F.struct(F.col(value), F.col(tie))).alias("worst"), F.count(F.lit(1)).alias("n"))


def demand_weights(df: DataFrame, score: Column, out: str = "weight") -> DataFrame:
    """Scores at mean one, clipped to [1 / c, c] with c = 1 + 3 min(1, n / 64)."""
    t = df.agg(F.avg(score).alias("__m"), F.count(F.lit(1)).alias("__n"))
    c = 1 + 3 * F.least(F.lit(1.0), F.col("__n") / 64)
    return df.crossJoin(F.broadcast(t)).withColumn(out, F.least(F.greatest(F.try_divide(score, F.col("__m")), 1 / c), c)).drop("__m", "__n")

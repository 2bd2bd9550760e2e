"""Greedy choices against loops that score every row before every choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import greedy as R


@pytest.fixture(scope="module")
def pool():
    rng = np.random.default_rng(3)
    n = 90
    x = np.maximum(rng.standard_normal((n, 6)), 0).round(2)
    x[40:60] = x[20:40]  # ties in vectors, not in costs
    return np.arange(n), rng.integers(1, 6, n).astype(float), x, rng.integers(0, 9, n).astype(float)


@pytest.fixture(scope="module")
def table(spark, pool):
    rows = [(int(i), float(c), v.tolist(), float(s), "clash") for i, c, v, s in zip(*pool, strict=True)]
    rows += [(None, 1.0, [1.0] * 6, 1.0, ""), (500, None, [1.0] * 6, 1.0, ""), (501, 1.0, None, 99.0, ""), (502, 1.0, [None] * 6, None, ""), rows[3]]
    return spark.createDataFrame(rows, "id long, cost double, x array<double>, score double, pick string").repartition(5)


def loop(pool, score, take, budget, least=-np.inf, gone=(), spent=0.0):
    ids, cost, x, _ = pool
    out, gone = [], set(gone)
    while True:
        can = [i for i in range(len(ids)) if i not in gone and spent + cost[i] <= budget + 1e-9]
        best = min(can, key=lambda i: (-score(i), cost[i], i), default=None)
        if best is None or score(best) <= least:
            return out
        take(best)
        gone.add(best)
        spent += cost[best]
        out.append(best)


def picked(df):
    return [r.id for r in df.orderBy("pick").collect()]


@pytest.mark.parametrize("batch", [1, 7, 256])
def test_cover(table, pool, batch):
    _, cost, x, score = pool
    c = [np.zeros(6)]
    want = loop(pool, lambda i: np.maximum(x[i] - c[0], 0).sum() / cost[i], lambda i: c.__setitem__(0, np.maximum(c[0], x[i])), 60, 0.0)
    spent = cost[want].sum()
    rest = loop(([*range(90)], cost, x, score), lambda i: score[i], lambda i: None, 60, gone=want, spent=spent)
    got = picked(R.cover(table, "id", F.col("cost"), "x", F.col("score"), 60, batch=batch).where("id < 500"))
    assert got[: len(want)] == want and len(rest) > 2
    # the top-up needs no vector: row 501 has the best score of all
    assert 501 in picked(R.cover(table, "id", F.col("cost"), "x", F.col("score"), 60, batch=batch))


@pytest.mark.parametrize("batch", [2, 256])
def test_residual(table, pool, batch):
    _, cost, x, _ = pool
    z = np.minimum(x, 1)
    u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    r, taken = [np.arange(1.0, 7.0)], []
    score = lambda i: (r[0] ** 2 * (1 - (1 - 0.25 * z[i]) ** 2)).sum() / (1 + 1.0 * sum(max(u[i] @ u[j], 0) for j in taken)) / cost[i]

    def take(i):
        r[0] = r[0] * (1 - 0.25 * z[i])
        taken.append(i)

    want = loop(pool, score, take, 40)
    d = table.withColumn("x", F.transform("x", lambda v: F.when(v > 1, 1.0).otherwise(v)))
    assert picked(R.residual(d, "id", F.col("cost"), "x", list(range(1, 7)), 40, batch=batch)) == want
    after = {a.atom: a.after for a in R.residual_after(d.where(F.col("id").isin(want)).dropDuplicates(["id"]), "x", list(range(1, 7)), 0.25).collect()}
    assert np.allclose([after[k] for k in range(6)], r[0])


@pytest.mark.parametrize("batch", [3, 256])
def test_market(table, pool, batch):
    _, cost, x, score = pool
    w = [np.array([3.0, 1, 1, 1, 1, 1]) / 8 * 30]
    supply = x / np.maximum(x.sum(1, keepdims=True), 1e-12) * cost[:, None]
    want = loop(pool, lambda i: np.minimum(w[0], supply[i]).sum() / cost[i], lambda i: w.__setitem__(0, np.maximum(w[0] - supply[i], 0)), 30, 0.0)
    got = picked(R.market(table, "id", F.col("cost"), "x", [3.0, 1, 1, 1, 1, 1], 30, F.col("score"), batch=batch).where("id < 500"))
    assert got[: len(want)] == want


def test_fill(table, pool):
    _, cost, _, score = pool
    d = table.where("id < 500")
    assert picked(R.fill(d, "id", F.col("cost"), F.col("score"), 33, batch=4)) == loop(pool, lambda i: score[i], lambda i: None, 33)
    assert picked(R.fill(d, "id", F.col("cost"), F.col("score"), 33, density=True)) == loop(pool, lambda i: score[i] / cost[i], lambda i: None, 33)
    assert picked(R.fill(d.limit(0), "id", F.col("cost"), F.col("score"), 33)) == [] and picked(R.cover(d.limit(0), "id", F.col("cost"), "x", F.col("score"), 9)) == []


def test_metered(table, pool):
    _, cost, x, _ = pool
    paid = cost * (0.5 + (np.arange(90) % 4) / 2)
    ok = np.arange(90) % 5 != 0
    total = np.full(6, 30 / 6)
    bought, spent, asked, gone, want = np.zeros(6), 0.0, 0.0, [], []
    for k in range(1000):
        rate, demand = (spent / asked if asked else 1.0), np.maximum(total - bought, 0)
        c, left, own = cost * rate, 30 - spent, []
        while left > 0 and len(own) < 3:
            supply = x / np.maximum(x.sum(1, keepdims=True), 1e-12) * np.maximum(c, 1)[:, None]
            s = np.minimum(demand, supply).sum(1) / np.maximum(c, 1)
            can = [i for i in range(90) if i not in gone and i not in own and sum(c[own]) + c[i] <= left + 1e-9]
            best = min(can, key=lambda i: (-s[i], c[i], i), default=None)
            if best is None or s[best] <= 0:
                break
            demand = np.maximum(demand - supply[best], 0)
            own.append(best)
        if not own:
            break
        for i in own:
            spent, asked = spent + paid[i], asked + cost[i]
            if ok[i]:
                bought = bought + x[i] / max(x[i].sum(), 1e-12) * max(paid[i], 1)
            want.append((k, i, bool(ok[i])))
        gone += own
    d = table.where("id < 500").withColumn("paid", F.col("cost") * (0.5 + (F.col("id") % 4) / 2.0))
    got = R.metered(d, "id", F.col("cost"), "paid", "x", [1.0] * 6, 30, F.col("id") % 5 != 0, per_round=3).collect()
    assert [(r["round"], r.id, r.accepted) for r in got] == want and got[-1].spent == pytest.approx(spent) and len({r["round"] for r in got}) > 2

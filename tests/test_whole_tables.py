"""Queries without SQL against brute force over all rows of the smallest tables."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from millrace.operators import statistics as X
from millrace.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_components_of_all_rows(spark):
    d = pd.read_parquet(f"{FOLDER}/lineitem.parquet")
    near: dict = {}
    for s, p in zip(d.l_suppkey.tolist(), d.l_partkey.tolist(), strict=True):
        near.setdefault(2 * s, set()).add(2 * p + 1)
        near.setdefault(2 * p + 1, set()).add(2 * s)
    want: dict = {}
    for top in sorted(near):
        todo = [] if top in want else [top]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = top
                todo += near[x]
    got = registry.QUERIES["jn18_components"](spark, FOLDER).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want


def mismatch(call, truth):
    """Of two calls of one argument list, written out from the rule."""
    (f, given), (g, allowed) = call, truth
    if f != g:
        return 1.0
    total = 0.0
    for k in set(given) | set(allowed):
        if k not in given:
            total += 0.0 if "" in allowed[k] else 1.0
        else:
            total += min(abs(given[k] - v) / (1 + abs(given[k] - v)) if isinstance(v, int) and isinstance(given[k], int) else float(v != given[k]) for v in allowed[k])
    return total / len(set(given) | set(allowed))


def test_binding_distance_of_all_rows(spark):
    d = pd.read_parquet(f"{FOLDER}/lineitem.parquet")
    want = {}
    for k, g in d.groupby("l_orderkey"):
        rows = list(zip(g.l_linenumber.tolist(), g.l_quantity.astype(int).tolist(), g.l_linestatus.tolist(), g.l_returnflag.tolist(), strict=True))
        calls = [(f, {"at": at, "n": n, "status": s}) for at, n, s, f in rows]
        truth = [("R" if at % 2 == 0 else f, {"at": [at + 1], "n": [n, n + 2], "status": ["F", ""], "mode": [""]}) for at, n, s, f in rows]
        cost = [[mismatch(a, b) for b in truth] for a in calls]
        best = {0: 0.0}
        for row in cost:
            more: dict = {}
            for used, total in best.items():
                for j, c in enumerate(row):
                    if not used >> j & 1:
                        m = used | 1 << j
                        more[m] = min(more.get(m, 99.0), total + c)
            best = more
        want[k] = best[(1 << len(rows)) - 1] / len(rows)
    got = registry.QUERIES["jn20_binding_distance"](spark, FOLDER).collect()
    assert len(got) == len(want) and max(len(g) for _, g in d.groupby("l_orderkey")) <= 12
    assert all(abs(r.distance - want[r.l_orderkey]) < 1e-6 for r in got) and len(set(want.values())) > 20


def test_knapsacks_of_all_rows(spark):
    d = pd.read_parquet(f"{FOLDER}/lineitem.parquet")
    want = set()
    for k, g in d[d.l_quantity <= 60].groupby("l_orderkey"):
        rows = sorted(zip(g.l_linenumber.tolist(), g.l_extendedprice.tolist(), g.l_quantity.astype(float).tolist(), strict=True), key=lambda r: (-r[1] / max(r[2], 1e-12), r[0]))
        spent, took = 0.0, []
        for r in rows:
            if spent + r[2] <= 60 and len(took) < 3:
                spent, took = spent + r[2], [*took, r]
        best = min(rows, key=lambda r: (-r[1], r[0]))
        took = [best] if best[1] > sum(r[1] for r in took) else took
        want |= {(k, r[0]) for r in took}
    assert {(r.l_orderkey, r.id) for r in registry.QUERIES["top8_knapsack"](spark, FOLDER).collect()} == want


def test_support_split_of_all_rows(spark):
    d = pd.read_parquet(f"{FOLDER}/documents.parquet")
    digest = lambda salt, i: hashlib.sha256(f"{salt}|{i}".encode()).hexdigest()

    def drawn(rows, total, salt):
        n = Counter(g for _, g in rows)
        quota = {g: total * c // len(rows) for g, c in n.items()}
        left = total - sum(quota.values())
        for g in sorted(n, key=lambda g: (-(total * n[g] % len(rows)), -n[g], g))[:left]:
            quota[g] += 1
        return [r for g in n for r in sorted((r for r in rows if r[1] == g), key=lambda r: (digest(salt, r[0]), r[0]))[: quota[g]]]

    rows = list(zip(d.doc_id.tolist(), d.lang.tolist(), strict=True))
    size = min(max(int(len(rows) * 0.05), 50), 250, len(rows))
    support = drawn(rows, size, "split")
    calibration = {i for i, _ in drawn(support, int(size * 0.2), "split:calibration")}
    want = {i: "calibration" if i in calibration else "support" if (i, g) in set(support) else "demand" for i, g in rows}
    assert {r.doc_id: r.partition for r in registry.QUERIES["smp2_support_split"](spark, FOLDER).collect()} == want


def test_bootstrap_of_all_rows(spark):
    d = pd.read_parquet(f"{FOLDER}/orders.parquet").groupby("o_custkey").o_totalprice.agg(["sum", "count"])
    cuts = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    got = {r["round"]: r["mean"] for r in registry.QUERIES["smp13_cluster_bootstrap"](spark, FOLDER).collect()}
    assert set(got) == set(range(50))
    for k in range(0, 50, 7):
        u = np.array([int(hashlib.sha256(f"boot|{k}|{c}".encode()).hexdigest()[:8], 16) / 2**32 for c in d.index])
        w = (u[:, None] >= cuts[None, :]).sum(1)
        assert got[k] == pytest.approx((w * d["sum"]).sum() / (w * d["count"]).sum(), abs=0.02)


def test_reservations_of_all_rows(spark):
    e = pd.read_parquet(f"{FOLDER}/events.parquet").sort_values("event_id")
    got = {r.sequence: (r.key, r.kind, r.error) for r in registry.QUERIES["str2_reservations"](spark, FOLDER).collect()}
    kinds = {"view": "reserve", "purchase": "settle"}
    state: dict = {}
    for i, user, kind, value in zip(e.event_id.tolist(), e.user_id.tolist(), e.event_type.tolist(), e.value.tolist(), strict=True):
        key, kind, amount = user * 1000 + i % 7, kinds.get(kind, "release"), round(value, 2)
        cap, cost = state.get(key, (None, None))
        error = None
        if kind == "reserve":
            if cost is not None or cap is not None and cap != amount:
                error = "conflicting reserve"
            else:
                state[key] = (amount, None)
        elif kind == "settle":
            if cost is not None:
                error = None if cost == amount else "conflicting settle"
            elif cap is None:
                error = "settle without reservation"
            elif amount > cap:
                error = "over cap"
            else:
                state[key] = (None, amount)
        elif cap is None:
            error = "release without reservation"
        else:
            state[key] = (None, cost)
        assert got[i] == (key, kind, error)
    assert len(got) == len(e)


def test_exact_tests_of_all_rows(spark):
    tail = lambda p, n, a, b: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(a, b + 1))
    rows = registry.QUERIES["stat_mcnemar_exact"](spark, FOLDER).collect()
    for r in rows:
        n, m = r.b + r.c, min(r.b, r.c)
        assert r.p == pytest.approx(min(1.0, 2 * tail(0.5, n, 0, m)), abs=1e-6)
        assert n == 0 or r.mid_p == pytest.approx(min(1.0, 2 * tail(0.5, n, 0, m) - math.comb(n, m) / 2**n), abs=1e-6)
    bounds = registry.QUERIES["stat_clopper_pearson"](spark, FOLDER).collect()
    for r in bounds:
        assert r.low == 0 if r.k == 0 else tail(r.low, r.n, r.k, r.n) == pytest.approx(0.025, abs=1e-5)
        assert r.high == 1 if r.k == r.n else tail(r.high, r.n, 0, r.k) == pytest.approx(0.025, abs=1e-5)
    assert len(rows) > 1 and len(bounds) > 5


def test_subspaces_and_clusters_of_all_rows(spark):
    d = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    x = np.array(d.embedding.tolist(), float)
    v = np.linalg.svd(x, full_matrices=False)[2][:4]
    want = np.linalg.norm(x @ v.T, axis=1) / np.linalg.norm(x, axis=1)
    got = {r.vec_id: r.score for r in registry.QUERIES["stat_subspace_scores"](spark, FOLDER).collect()}
    assert all(abs(got[i] - w) < 1e-5 for i, w in zip(d.vec_id.tolist(), want, strict=True)) and len(got) == len(d)
    sizes = registry.QUERIES["stat_kmeans_sizes"](spark, FOLDER).collect()
    assert sum(r.n for r in sizes) == len(d) and len({r.prediction for r in sizes}) == len(sizes) <= 8
    e = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [3.0, 4.0])], "i long, v array<double>")
    assert {r.i: r.s for r in X.subspace_score(e, "v", np.array([[1.0, 0.0]]), "s").collect()} == {1: None, 2: None, 3: 0.6}
    assert X.pca(e.limit(0), "v", 2).size == 0

"""Draws among closed packages, inventories that fail, and the chance that one rate exceeds another."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import projections as P


def test_closed_draws_against_a_loop(spark):
    deps = {i: [i // 2] if i else [] for i in range(20)} | {7: [1, 3]}
    cost = {i: 1.0 + i % 3 for i in range(20)}
    d = spark.createDataFrame([(i, deps[i], cost[i]) for i in range(20)], "i long, d array<long>, c double").repartition(3)
    got = P.closed_draws(d, "i", "d", "c", 17, "s").orderBy("draw").collect()
    owned, left = set(), 17.0
    for k, r in enumerate(got):
        can = [i for i in range(20) if i not in owned and set(deps[i]) <= owned and cost[i] <= left]
        best = min(can, key=lambda i: (hashlib.sha256(f"s|{k}|{i}".encode()).hexdigest(), str(i)))
        assert (r.id, r.feasible, r.remaining_before) == (str(best), len(can), left)
        owned.add(best)
        left -= cost[best]
    assert len(got) > 5 and not [i for i in range(20) if i not in owned and set(deps[i]) <= owned and cost[i] <= left]
    with pytest.raises(ValueError):
        P.closed_draws(d.withColumn("d", F.array(F.lit(99))), "i", "d", "c", 5, "s")
    assert P.closed_draws(d.limit(0), "i", "d", "c", 5, "s").count() == 0


def test_superiority_against_draws(spark):
    rng = np.random.default_rng(0)
    rows = [(1, 1, 1, 1), (5, 2, 2, 5), (30, 41, 35, 36), (400, 300, 380, 310), (1, 9, 3, 1)]
    got = [r.p for r in spark.createDataFrame(rows, "a long, b long, c long, d long").select(P.beta_superiority(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p")).collect()]
    for (a, b, c, d), p in zip(rows, got, strict=True):
        assert abs((rng.beta(a, b, 200000) > rng.beta(c, d, 200000)).mean() - p) < 0.006


def test_inventories_fail_rather_than_filter(spark):
    schema = "n long, q string, a string, hint string"
    ok = spark.createDataFrame([(0, "x", "y", "h"), (1, "x", None, None)], schema)
    public, audit = P.question_inventory(ok, {"question": "q", "answer": "a"}, ["hint"], "multihop", "b", "n")
    assert [r._id for r in public.orderBy("_id").collect()] == ["b-000000", "b-000001"] and public.columns == ["_id", "question", "answer", "type"] and audit.columns == ["_id", "hint"]
    for bad in ([(0, "", "y", "")], [(0, "x", "y", ""), (0, "z", "y", "")], [(None, "x", "y", "")]):
        with pytest.raises(Exception, match="empty|duplicate"):
            P.question_inventory(spark.createDataFrame(bad, schema), {"question": "q", "answer": "a"}, [], "m", "b", "n")[0].collect()


def test_demos_and_machines(spark):
    demos = spark.createDataFrame([("t1", [("p", "answer here"), ("q", None)]), ("t2", None), ("t3", [])], "task_id string, turns array<struct<prompt:string,target:string>>")
    cats = spark.createDataFrame([("t1", "c"), ("t2", "c"), ("t1", "c")], "task_id string, category string")
    assert [(r.task_id, r.turn_index, r.token_hint) for r in P.demo_rows(demos, cats).orderBy("task_id", "turn_index").collect()] == [("t1", 0, 2), ("t1", 1, 1)]
    with pytest.raises(Exception, match="no category"):
        P.demo_rows(demos, cats.limit(0)).collect()
    schema = "k long, b array<long>, s double, c boolean"
    a = spark.createDataFrame([(1, [1, 2], 1.0, True), (2, [1, 2], 1.0, True), (3, None, 1.0, True), (4, [], 1.0, False)], schema)
    b = spark.createDataFrame([(1, [1, 2], 1.5, True), (2, [2, 1], 9.0, True), (3, [1], 9.0, True), (4, [], 9.0, True)], schema)
    assert {r.k: (r.identical, r.packages, r.effect) for r in P.machine_effects(a, b, ["k"], "b", "s", "c").collect()} == {1: (True, 2, 0.5), 2: (False, 2, None), 3: (None, None, None), 4: (True, 0, None)}
    assert P.reestimate(a, "s", "zero").count() == 0 and P.reestimate(a, "s", "all").count() == 4
    with pytest.raises(ValueError):
        P.reestimate(a, "s", "some")

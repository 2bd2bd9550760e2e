"""Invariants and edge cases of the reference's operators."""

import hashlib
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import calls
from millrace.functions import text as T
from millrace.operators import aggregates as G
from millrace.operators import dedup, graph, sampling, selection
from millrace.operators import joins as J
from millrace.operators import statistics as X
from millrace.operators import windows as W
from millrace.sources import pages, readers, sinks
from millrace.streaming import ledger as L


def test_budget_rules(spark):
    d = spark.createDataFrame([(i, c) for i, c in enumerate([5, 4, 0, 3, 9, 1])], "id long, cost long")
    order = [F.col("id")]
    assert [r.id for r in W.take_within_budget(d, order, F.col("cost"), 12).orderBy("id").collect()] == [0, 1, 2, 3]
    assert [r.id for r in W.take_until_spent(d, order, F.col("cost"), 12).orderBy("id").collect()] == [0, 1, 2, 3]
    assert [r.id for r in W.take_until_spent(d, order, F.col("cost"), 10).orderBy("id").collect()] == [0, 1, 2, 3]
    g = d.withColumn("g", F.lit(1))
    assert sorted(r.id for r in W.fill_within_budget(g, ["g"], ["id"], "id", "cost", 13).collect()) == [0, 1, 2, 3, 5]


def test_prefix_sums_match_a_loop(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 50, 500).tolist()
    d = spark.createDataFrame(list(enumerate(v)), "id long, v long").repartition(7)
    got = {r.id: r.s for r in W.prefix_sums(d, [F.col("id")], {"s": F.col("v")}).collect()}
    assert [got[i] for i in range(500)] == np.cumsum(v).tolist()


def test_schedule_uses_every_token_once(spark):
    d = spark.createDataFrame([(0, 5), (1, 0), (2, 17), (3, 3)], "id long, n long")
    got = W.token_schedule(d, [F.col("id")], F.col("n"), 8).collect()
    per = {}
    for r in got:
        per.setdefault(r.step, 0)
        per[r.step] += r.stop - r.start
    assert per == {0: 8, 1: 8, 2: 8, 3: 1}


def test_null_is_not_zero(spark):
    d = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", 0.0), ("b", "y", 1.0)], "g string, c string, v double")
    got = {r.g: r.macro for r in G.macro_average(d, ["g"], "c", "v").collect()}
    assert got == {"a": None, "b": 0.5}
    assert {r.g: r.std for r in G.seed_stats(d.where("c = 'x'"), ["g"], "v").collect()} == {"a": None, "b": None}


def test_apportionment_adds_up(spark):
    d = spark.createDataFrame([("a", i, w) for i, w in enumerate([3, 3, 1, 7])] + [("b", 0, 5)], "g string, i long, w long")
    got = G.apportion(d, ["g"], [F.col("i")], "w", F.lit(100), "n").groupBy("g").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in got} == {100}


def test_splits_are_disjoint_and_whole(spark):
    d = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(400)], "id long, g string")
    s = sampling.support_split(d, "g", "id", "x")
    assert s.count() == 400 and s.select("id").distinct().count() == 400
    n = {r.partition: r["count"] for r in s.groupBy("partition").count().collect()}
    assert n["support"] + n["calibration"] == 50 and n["calibration"] == 10
    f = sampling.group_folds(d.withColumn("p", F.expr("id div 7")), "p", 5, "y")
    assert f.groupBy("p").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_strict_join_refuses(spark):
    a, b = spark.createDataFrame([(1, 1)], "k long, v int"), spark.createDataFrame([(2, 1)], "k long, v int")
    with pytest.raises(Exception, match="unpaired"):
        J.strict_pairs(a, b, ["k"], "v").collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90


def test_rouge_filter_keeps_the_first(spark):
    rng = np.random.default_rng(5)
    texts = ["a b c d e f", "a b c d e g", "x y z", None, "", "x y z", " x  y z "]
    texts += [" ".join(rng.choice(list("abcdefghijklmnop"), 12)) for _ in range(20)]
    for _ in range(60):
        w = texts[int(rng.integers(7, len(texts)))].split()
        w[int(rng.integers(0, len(w)))] = "new%d" % rng.integers(0, 9)
        texts.append(" ".join(w[int(rng.integers(0, 3)) :]))
    kept, want = [], []
    for i, t in enumerate(texts):
        ws = (t or "").split()
        if not any(dedup.rouge_l(k, ws) > 0.7 for k in kept):
            kept.append(ws)
            want.append(i)
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "i long, t string, at int").repartition(5)
    got = dedup.rouge_filter(d, ["i"], "t", 0.7)
    assert sorted(r.i for r in got.collect()) == want and got.columns == d.columns and len(want) < 60
    assert dedup.rouge_filter(d.limit(0), ["i"], "t", 0.7).count() == 0


def test_knapsack_and_dual(spark):
    d = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 6.0, 5.0), (1, 3, 1.0, 1.0)], "g long, id long, value double, cost double")
    assert [r.id for r in selection.knapsack(d.unionByName(spark.createDataFrame([(1, 4, None, 1.0), (1, 5, 9.0, None)], d.schema)), ["g"], 10, 5).collect()] == [1]
    p = selection.budget_distribution(np.array([1.0, 2.0, 3.0]), np.array([1.0, 5.0, 20.0]), 4.0, 0.5)
    assert abs(p.sum() - 1) < 1e-9 and p @ [1, 5, 20] <= 4 + 1e-6


def test_exact_bounds():
    lo, hi = X.clopper_pearson(3, 10, 0.05)
    assert abs(X.binomial_tail(3, 10, lo) - 0.025) < 1e-6 and abs(1 - X.binomial_tail(4, 10, hi) - 0.025) < 1e-6
    assert X.clopper_pearson(0, 5, 0.05)[0] == 0 and X.clopper_pearson(5, 5, 0.05)[1] == 1


def test_text_functions(spark):
    d = spark.createDataFrame([("The  quick, an APPLE!",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(T.normalize_answer("t")).collect()] == ["quick apple", "", None]
    s = spark.createDataFrame([("4.5 good",), ("7 much",), ("none",)], "t string")
    assert [r[0] for r in s.select(T.leading_score("t")).collect()] == [4.5, None, None]


def test_calls():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 6):
        c = rng.random((n, n)).round(2).tolist()
        assert abs(calls.assignment(c) - min(sum(c[i][p] for i, p in enumerate(o)) for o in itertools.permutations(range(n)))) < 1e-9
    assert calls.binding([], []) == 0 and calls.binding(None, [{"f": {}}]) == 1 and calls.binding([{"f": {}}], [{"f": {}}, {"g": {}}]) == 1
    assert calls.binding([{"f": {"a": 1}}, {"g": {"b": "x"}}], [{"g": {"b": ["y", "x"]}}, {"f": {"a": [3]}}]) == pytest.approx((2 / 3) / 2)
    assert calls.binding([{"f": {}}], [{"f": {"a": [1, ""], "b": [2]}}]) == 0.5 and calls.binding([{"f": {"a": True}}], [{"f": {"a": [1]}}]) == 1
    assert calls.binding([{"f": {}}] * 13, [{"f": {}}] * 13) is None and calls.binding([{"f": {}}] * 12, [{"f": {}}] * 12) == 0
    assert calls.canonical_json('{"b": 1, "a": "é"}') == '{"a":"é","b":1}' and calls.canonical_json("{") is None
    assert calls.compiles("x = 1") and not calls.compiles("x =")
    assert calls.spans_of("The cat sat. the CAT", "the cat") == [(0, 7), (13, 20)]


def test_single_statements(spark):
    one = ["select ';' from t -- x;\n;", "select 1;;", "; select 1", "select [a;b] from t", "select (1", 'select "a;""b;" , `c;`', "/* a;b */ select 1", "select 'it''s; ok'", "x -- '", "'", "select 1 -- /* open", "''", "]", "a */ b", "/* ' */ 'a;b'"]
    many = ["select 1; select 2", "", " ;; ", "-- only", "/* open", "select 'open", 'select "open', "select [open", "a /* b */ ; c", "[a]];b", "select 1 /* x */; /* y */ ; '2'"]
    one.remove("'")
    many += ["'"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate([*one, *many, None])], "i long, s string")
    got = {r.i: r.v for r in d.select("i", calls.is_single_statement("s").alias("v")).collect()}
    assert [got[i] for i in range(len(got))] == [True] * len(one) + [False] * len(many) + [None]
    long = spark.createDataFrame([("select '" + "a''" * 50000 + "'; ",)], "s string")
    assert long.select(calls.is_single_statement("s")).first()[0]


def test_derangement(spark):
    for classes, free in (([5, 4, 3], True), ([6, 3, 3], True), ([8, 1, 1], False), ([1], False), ([2], False), ([1, 1], True)):
        rows = [(f"t{len(classes)}", 100 * c + i, c) for c, n in enumerate(classes) for i in range(n)]
        got = J.derange(spark.createDataFrame(rows, "k string, i long, v int").repartition(3), "k", "i", "v", "s", "dealt").collect()
        assert len(got) == len(rows) and (len(rows) == 1 or sorted(r.dealt for r in got) == sorted(r[2] for r in rows))
        assert not free or all(r.v != r.dealt for r in got)


def test_nearest_against_all(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 5))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (93, [0.0] * 5), (92, [1.0, None, 0.0, 0.0, 0.0])], "i long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for rows in (3, 100):
        got = {r.i: r.max_cosine for r in J.nearest(d, d.where("i % 7 = 0"), "i", "v", "i", "v", rows).collect()}
        assert all(abs(got[i] - (u[i] @ u[::7].T).max()) < 1e-9 for i in range(40)) and got[90] is None and got[92] is None and got[93] == 0
    assert J.nearest(d, d.limit(0), "i", "v", "i", "v").where("max_cosine is not null").count() == 0


def test_draws_against_a_loop(spark):
    w = [3, 0, 5, None, 2, 7, 1]
    d = spark.createDataFrame(list(enumerate(w)), "i long, w long")
    got = {r.draw: r.i for r in sampling.draw_with_replacement(d, "w", "i", 60, "s").collect()}
    ends = np.cumsum([x or 0 for x in w])
    for k in range(60):
        x = int(hashlib.sha256(f"s|{k}".encode()).hexdigest()[:8], 16) / 2**32 * ends[-1]
        assert got[k] == int(np.searchsorted(ends, x, side="right"))
    assert len(got) == 60 and sampling.draw_with_replacement(d.where("w = 0"), "w", "i", 5, "s").count() == 0


def test_length_batches_against_a_plain_planner(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(1, 60)), int(rng.choice([10, 50])), int(rng.integers(0, 40))) for i in range(300)] + [(900, 5000, 10, 99), (901, None, 10, 1)]
    budget, prompts = 400, 4
    want, number = [], {}
    for limit in (10, 50):
        own = sorted((n, i, p) for i, n, l, p in rows if l == limit and n is not None)
        blocks = []
        for _, run in itertools.groupby(own, key=lambda r: r[2]):
            run = list(run)
            room, block = max(1, budget // (run[0][0] + limit)), []
            for r in run:
                if block and (len(block) == room or (len(block) + 1) * (r[0] + limit) > budget or r[0] > 2 * block[0][0]):
                    blocks.append(block)
                    block = []
                block = [*block, r]
            blocks.append(block)
        batches = [[]]
        for b in blocks:
            both = batches[-1] + b
            if batches[-1] and (len({r[2] for r in both}) > prompts or len(both) * (max(r[0] for r in both) + limit) > budget or max(r[0] for r in both) > 2 * batches[-1][0][0]):
                batches.append([])
            batches[-1] += b
        want += [(limit, k, r[1]) for k, b in enumerate(batches) for r in b]
    d = spark.createDataFrame(rows, "i long, n long, l long, p long").repartition(4)
    assert sorted(map(tuple, W.length_batches(d, "i", "n", "l", "p", budget, prompts).collect())) == sorted(want)


def test_reservations_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, "reserve", 5.0), (1, 1, "reserve", 5.0), (1, 2, "settle", 4.0), (1, 3, "settle", 3.0), (2, 0, "settle", 1.0), (2, 4, "reserve", 2.0), (2, 5, "release", 0.0), (2, 5, "release", 0.0)]
    schema = "key long, sequence long, kind string, amount double"
    d = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, L.batch(d).collect()), key=str)
    assert [r[5] for r in want if r[0] == 1] == [None, None, None, "conflicting settle"]
    d.coalesce(1).write.json(str(tmp_path / "in"))
    q = L.stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("res").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from res").collect()), key=str) == want


def test_tail_consumes_once(spark, tmp_path):
    got = []
    spark.createDataFrame([(1,)], "step long").write.json(str(tmp_path / "in"))
    for _ in range(2):
        L.tail(spark, str(tmp_path / "in"), "step long", str(tmp_path / "c"), lambda df, i: got.extend(r.step for r in df.collect()))
    assert got == [1]


def test_strict_and_tolerant_scans(spark, tmp_path):
    good = {"task_id": "a", "teacher": "t", "turn_index": 0, "prompt": "p", "response": "r", "token_hint": 1}
    names = readers._names(readers.POOL)
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"task_id": "b"}) + "\n")
    got = readers.strict_jsonl(spark, str(tmp_path / "a.jsonl"), readers.POOL, names).orderBy("pool_index").collect()
    assert [(r.task_id, r.line, r.pool_index) for r in got] == [("a", 1, 0), ("b", 3, 2)]
    (tmp_path / "b.jsonl").write_text(json.dumps(good | {"turn_index": True}) + "\nnot json\n" + json.dumps(good))
    with pytest.raises(Exception, match=r"b\.jsonl:1"):
        readers.strict_jsonl(spark, str(tmp_path / "b.jsonl"), readers.POOL, names).collect()
    assert readers.tolerant_jsonl(spark, str(tmp_path / "b.jsonl"), readers.POOL, ["task_id", "turn_index"]).count() == 1
    assert readers.ledger(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_chain_and_matrix(spark, tmp_path):
    before, out = "", []
    for i in range(3):
        d = {"sequence": i, "kind": "x", "previous_hash": before}
        before = hashlib.sha256(readers.canonical(d)).hexdigest()
        out.append(json.dumps(d | {"event_hash": before}))
    (tmp_path / "ok.jsonl").write_text("\n".join(out) + "\n")
    (tmp_path / "torn.jsonl").write_text("\n".join(out))
    assert readers.chain(spark, str(tmp_path / "ok.jsonl")).where("error is not null").count() == 0
    assert [r.error for r in readers.chain(spark, str(tmp_path / "torn.jsonl")).where("error is not null").collect()] == ["torn tail"]
    np.savez(tmp_path / "m.npz", keys=np.array(["a", "b"]), values=np.eye(2), version=np.array("v1"))
    assert readers.matrix(spark, str(tmp_path / "m.npz"), "keys", "values", "v1").count() == 2
    with pytest.raises(Exception, match="version"):
        readers.matrix(spark, str(tmp_path / "m.npz"), "keys", "values", "v2").collect()


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", "x", ["b"]), ("b", "y", [])], "id string, body string, deps array<string>")
    assert sinks.immutable(d, str(tmp_path / "t")) and not sinks.immutable(d, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        sinks.immutable(d.limit(1), str(tmp_path / "t"))
    sinks.seal(d, "id", "body", "deps", str(tmp_path / "bank"))
    index, sealed = spark.read.parquet(str(tmp_path / "bank/public")), spark.read.parquet(str(tmp_path / "bank/sealed"))
    assert readers.sealed(index, sealed, index.where("id = 'a'"), "id", "body", "digest").collect()[0].body == "x"
    with pytest.raises(ValueError):
        sinks.seal(spark.createDataFrame([("a", "x", ["b"]), ("b", "y", ["a"])], d.schema), "id", "body", "deps", str(tmp_path / "bad"))
    assert sinks.markdown(d.select("id")).count("\n") == 3 and sinks.latex(d.select("id")).count("\n") == 1
    with pytest.raises(ValueError):
        sinks.latex(spark.range(20), 10)


def test_cycles_and_long_chains(spark):
    chain = [(str(i), [str(i + 1)]) for i in range(70)]
    d = spark.createDataFrame([*chain, ("70", None)], "id string, deps array<string>")
    assert sinks.cyclic(d, "id", "deps").count() == 0
    e = d.unionByName(spark.createDataFrame([("70", ["69"]), ("x", ["nowhere"]), (None, ["0"])], d.schema))
    assert {r.id for r in sinks.cyclic(e, "id", "deps").collect()} == {str(i) for i in range(71)}


def test_cycles_at_the_end_of_long_chains(spark, monkeypatch):
    """Rounds follow the logarithm of a chain; the ids are those that taking away one layer after the other leaves."""
    import random

    from millrace.sources import sinks

    r = random.Random(5)
    deps = {i: [i + 1] for i in range(400)} | {i: [i + 1] for i in range(1000, 1400)} | {1400: [1398], 2000: [2000], 2001: [2000, 9999], 2002: [9999], 2003: []}
    deps |= {i: [3000 + r.randrange(60) for _ in range(r.randrange(4))] for i in range(3000, 3060)}
    left = {x: set(d) for x, d in deps.items()}
    while gone := [x for x, d in left.items() if not d & left.keys()]:
        for x in gone:
            del left[x]
    d = spark.createDataFrame(list(deps.items()), "id long, deps array<long>")
    rounds, kept = [], type(d).checkpoint
    monkeypatch.setattr(type(d), "checkpoint", lambda self, *a, **b: rounds.append(1) or kept(self, *a, **b))
    assert {x.id for x in sinks.cyclic(d, "id", "deps").collect()} == set(left)
    assert 1000 in left and 399 not in left and len(rounds) <= 16


def test_chained_rows(spark):
    rows = [(j, i, f"body {i}", None) for j in ("a", "b") for i in range(40)]
    d = spark.createDataFrame(rows, "j string, i long, body string, extra string").repartition(3)
    got = sorted(sinks.chained(d, "j", "i", ["i", "body", "extra"]).collect())
    before = {"a": "", "b": ""}
    for r in got:
        own = json.dumps({"i": str(r.i), "body": r.body, "extra": None}, sort_keys=True, separators=(",", ":"))
        assert r.previous_hash == before[r.j] and r.event_hash == hashlib.sha256((before[r.j] + own).encode()).hexdigest()
        before[r.j] = r.event_hash


def test_page_parser():
    html = "<div class='mw-search-result-heading'>One</div><p>a b c d</p><p>x</p><script>p p p p</script><ul><li>may refer to: it</li></ul>"
    assert pages.parse(html) == (["One"], True, ["a b c d", "may refer to: it"]) and pages.parse(None) == ([], False, [])


def test_flagship_plan_has_no_global_window(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert "budgeted_selection_report" in e.queries() and math.isfinite(len(e.oracle_sql()))

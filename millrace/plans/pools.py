"""Joins and pool-building composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.operators import joins as J
from millrace.operators import sampling as P
from millrace.operators import windows as W
from millrace.plans.registry import query


@query("jn1_strict_pairs", """
SELECT doc_id, quality AS left_value, toxic AS right_value, concat(quality, toxic) AS outcome, toxic - quality AS delta, 'paired' AS status FROM labels""")
def jn1(t):
    return J.strict_pairs(t.labels.select("doc_id", F.col("quality").alias("v")), t.labels.select("doc_id", F.col("toxic").alias("v")), ["doc_id"], "v")


@query("jn2_inner_pairs", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def jn2(t):
    return t.orders.where("o_totalprice > 200000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment")


@query("jn3_left_default", "SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn3(t):
    return J.left_default(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"], {"quality": -1, "toxic": 0})


@query("jn4_first_failure", """
SELECT o_orderkey, f.part AS first_returned FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS part FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) f ON o_orderkey = l_orderkey""")
def jn4(t):
    f = J.first_match(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey", F.col("l_returnflag") == "R", "first_returned")
    return t.orders.select("o_orderkey").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "first_returned")


@query("jn5_self_mix", """
SELECT o_orderkey AS id, o_custkey AS task, 'base' AS origin FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT -o_orderkey, o_custkey, 'own' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def jn5(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task"))
    c = t.customer.withColumnRenamed("c_custkey", "task")
    return J.self_mix(rows, rows.withColumn("id", -F.col("id")), c.where("c_acctbal > 0"), c.where("c_mktsegment = 'BUILDING'"), "task")


@query("jn6_unfinished", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn6(t):
    return J.unfinished(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("jn7_prompt_conflicts", "SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS n_values, count(*) AS n_rows FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1")
def jn7(t):
    return J.conflicts(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("jn8_aligned", "SELECT vec_id, lang FROM embeddings JOIN documents ON vec_id = doc_id")
def jn8(t):
    return t.embeddings.select("vec_id").join(t.documents.select("doc_id", "lang"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "lang")


@query("jn9_or_join", """
WITH p AS (SELECT s_suppkey AS id, s_nationkey AS n, CAST(floor(s_acctbal / 50) AS BIGINT) AS b FROM supplier)
SELECT a.id AS left_id, b.id AS right_id, array_to_string(list_filter([CASE WHEN a.b = b.b THEN 'b=b' END, CASE WHEN a.n = b.n THEN 'n=n' END], lambda x: x IS NOT NULL), ',') AS via FROM p a JOIN p b ON a.id < b.id AND (a.n = b.n OR a.b = b.b)""")
def jn9(t):
    p = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 50).alias("b"))
    return J.or_join(p, p, [("n", "n"), ("b", "b")], ("id", "id"))


@query("jn10_exclusions", """
WITH m AS (SELECT doc_id, 'text' AS m FROM documents WHERE md5(lower(text)) IN (SELECT md5(lower(text)) FROM benchmark) UNION ALL SELECT doc_id, 'id' FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)
 UNION ALL SELECT doc_id, 'label' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT doc_id, array_to_string(list_sort(list_distinct(list(m))), ',') AS mechanisms FROM m GROUP BY doc_id""")
def jn10(t):
    digest = F.md5(F.lower("text"))
    return J.exclusions(t.documents, "doc_id", {"text": (digest, t.benchmark.select(digest)), "id": (F.col("doc_id"), t.benchmark.select("item_id")), "label": (F.col("doc_id"), t.labels.where("toxic = 1").select("doc_id"))})


@query("jn11_overlap", "SELECT count(*) AS rows_in_both, count(DISTINCT text) AS texts_in_both FROM conversations WHERE role = 'user' AND text IN (SELECT text FROM conversations WHERE role = 'assistant')")
def jn11(t):
    c = t.conversations
    both = c.where("role = 'user'").join(c.where("role = 'assistant'").select("text"), "text", "left_semi")
    return both.agg(F.count(F.lit(1)).alias("rows_in_both"), F.countDistinct("text").alias("texts_in_both"))


@query("jn12_derived_key", "SELECT p_partkey, count(*) AS n FROM part JOIN lineitem ON regexp_replace(concat('gen_', p_partkey), '^gen_', '') = CAST(l_partkey AS VARCHAR) GROUP BY p_partkey")
def jn12(t):
    p = t.part.select("p_partkey", F.regexp_replace(F.concat(F.lit("gen_"), F.col("p_partkey").cast("string")), "^gen_", "").alias("k"))
    return p.join(t.lineitem.select(F.col("l_partkey").cast("string").alias("k")), "k").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_ledger_reconcile", """
SELECT o_orderkey, round(o_totalprice - coalesce(s, 0), 2) AS difference, abs(o_totalprice - coalesce(s, 0)) < 0.01 AS reconciled FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def jn13(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    d = F.col("o_totalprice") - F.coalesce("s", F.lit(0.0))
    return t.orders.select("o_orderkey", "o_totalprice").join(s, "o_orderkey", "left").select("o_orderkey", F.round(d, 2).alias("difference"), (F.abs(d) < 0.01).alias("reconciled"))


@query("jn14_matched_arms", """
WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(concat('arm|', o_orderkey)), o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(concat('arm|', o_orderkey)), o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O'),
n AS (SELECT o_custkey, least(x, y) AS n FROM (SELECT o_custkey, count(*) AS x FROM a GROUP BY 1) JOIN (SELECT o_custkey, count(*) AS y FROM b GROUP BY 1) USING (o_custkey))
SELECT o_custkey, 'first' AS arm, o_orderkey FROM a JOIN n USING (o_custkey) WHERE r <= n UNION ALL SELECT o_custkey, 'second', o_orderkey FROM b JOIN n USING (o_custkey) WHERE r <= n""")
def jn14(t):
    o = t.orders
    return J.matched_sample(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey", T.hash_rank_key("arm", "o_orderkey"))


@query("jn15_max_cosine", """
WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
u AS (SELECT e.vec_id, k, x / n AS x FROM e JOIN n USING (vec_id)),
d AS (SELECT a.vec_id, b.vec_id AS o, sum(a.x * b.x) AS c FROM u a JOIN u b USING (k) WHERE b.vec_id % 100 = 0 GROUP BY ALL)
SELECT vec_id, round(max(c), 4) AS max_cosine FROM d GROUP BY vec_id""")
def jn15(t):
    """The stated set (ids divisible by 100) is the base; every vector meets it in blocks."""
    e = t.embeddings
    return J.nearest(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", "vec_id", "embedding").withColumn("max_cosine", F.round("max_cosine", 4))


@query("jn16_bill_once", "SELECT o_custkey, round(sum(o_totalprice), 2) AS bill, count(*) AS tasks FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey")
def jn16(t):
    """A task is billed once however many of its rows are used."""
    return t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("bill"), F.count(F.lit(1)).alias("tasks"))


@query("jn17_spans", """
SELECT b.event_id, b.user_id, e.event_id AS end_event_id FROM events b LEFT JOIN events e ON e.event_id = b.event_id + 1 AND e.event_type = 'purchase' WHERE b.event_type = 'click'""")
def jn17(t):
    e = t.events
    ends = e.where("event_type = 'purchase'").select((F.col("event_id") - 1).alias("begin"), "event_id")
    return J.spans(e.where("event_type = 'click'").select("event_id", "user_id"), ends, "event_id", "begin", ["event_id"])


@query("jn18_components")
def jn18(t):
    """Connected components of suppliers and parts sold together; see operators.graph."""
    from millrace.operators.graph import connected_components

    return connected_components(t.lineitem.select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")), "a", "b")


@query("jn19_derangement", """
WITH r AS (SELECT o_orderkey, o_orderpriority, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey, sha256(concat('derange|', o_orderkey)), o_orderkey) - 1 AS at, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
c AS (SELECT o_orderpriority, max(c) AS m FROM (SELECT o_orderpriority, o_custkey, count(*) AS c FROM orders GROUP BY ALL) GROUP BY 1)
SELECT a.o_orderkey, a.o_orderpriority, a.o_custkey, b.o_custkey AS dealt FROM r a JOIN c USING (o_orderpriority) JOIN r b ON a.o_orderpriority = b.o_orderpriority AND b.at = (a.at + CASE WHEN 2 * m <= a.n THEN m ELSE 1 END) % a.n WHERE a.n > 1""")
def jn19(t):
    """Right sides dealt anew within a type so that no row gets an equal one."""
    return J.derange(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderpriority", "o_orderkey", "o_custkey", "derange", "dealt")


@query("jn20_binding_distance")
def jn20(t):
    """An order's lines as calls, against the calls allowed for them; see functions.calls."""
    from millrace.functions.calls import binding_distance

    given = F.to_json(F.create_map(F.col("l_returnflag"), F.struct(F.col("l_linenumber").alias("at"), F.col("l_quantity").cast("long").alias("n"), F.col("l_linestatus").alias("status"))))
    options = F.struct(F.array(F.col("l_linenumber") + 1).alias("at"), F.array(F.col("l_quantity").cast("long"), F.col("l_quantity").cast("long") + 2).alias("n"), F.array(F.lit("F"), F.lit("")).alias("status"), F.array(F.lit("")).alias("mode"))
    allowed = F.to_json(F.create_map(F.when(F.col("l_linenumber") % 2 == 0, "R").otherwise(F.col("l_returnflag")), options))
    whole = lambda c: F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(c)), ","), F.lit("]"))
    a = t.lineitem.select("l_orderkey", given.alias("x"), allowed.alias("y")).groupBy("l_orderkey").agg(whole("x").alias("x"), whole("y").alias("y"))
    return a.select("l_orderkey", F.round(binding_distance("x", "y"), 9).alias("distance"))


@query("flt14_legal_candidates", """
WITH owned AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0), c AS (SELECT c_custkey AS id, CAST(abs(floor(c_acctbal)) AS BIGINT) AS cost, [c_custkey // 2, c_custkey // 3] AS deps FROM customer),
ok AS (SELECT id, cost FROM c WHERE id NOT IN (SELECT id FROM owned) AND id NOT IN (SELECT id FROM (SELECT id, unnest(deps) AS d FROM c) WHERE d NOT IN (SELECT id FROM owned))),
r AS (SELECT id, cost, sum(cost) OVER (ORDER BY cost, id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (ORDER BY cost, id) AS k FROM ok) SELECT id, cost FROM r WHERE run <= 20000 AND k <= 25""")
def flt14(t):
    """Not owned, dependencies owned, then a prefix by cost under a budget and a package limit."""
    c = t.customer.select(F.col("c_custkey").alias("id"), F.abs(F.floor("c_acctbal")).cast("long").alias("cost"), F.array(F.expr("c_custkey div 2"), F.expr("c_custkey div 3")).alias("deps"))
    ok = J.dependency_closed(c, c.where("id % 3 = 0"), "id", "deps").select("id", "cost")
    first = ok.orderBy("cost", "id").limit(25)
    return W.take_within_budget(first, [F.col("cost"), F.col("id")], F.col("cost"), 20000).select("id", "cost")


@query("pool1_events_to_pools", """
WITH f AS (SELECT event_id, user_id, event_type, value, props FROM events WHERE value > 1 AND event_type <> 'view'), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value) AS BIGINT) ORDER BY event_id) AS k FROM f),
c AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM d WHERE k = 1) SELECT event_id, user_id, event_type, rank FROM c WHERE rank <= 100""")
def pool1(t):
    """filter -> first of each key -> best of each category -> project."""
    f = t.events.where("value > 1 and event_type <> 'view'").select("event_id", "user_id", "event_type", "value")
    d = P.keep_first(f, [F.col("user_id"), F.col("event_type"), F.floor("value")], [F.col("event_id")])
    return W.top_per_group(d, ["event_type"], [F.desc("value"), F.col("event_id")], 100).drop("value")


@query("pool2_negatives", """
WITH n AS (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS rejected FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey AS task_id, o_custkey AS response, rejected FROM orders LEFT JOIN n ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def pool2(t):
    n = J.first_match(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey", F.col("l_returnflag") == "R", "rejected").withColumnRenamed("l_orderkey", "task_id")
    return t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("response")).join(n, "task_id", "left")


@query("pool3_cost_audit", """
WITH l AS (SELECT l_orderkey AS k, sum(CAST(l_quantity AS BIGINT)) AS spent FROM lineitem GROUP BY 1) SELECT o_orderpriority, count(*) AS tasks, sum(spent)::BIGINT AS spent, count(*) FILTER (WHERE spent > 150) AS over_cap FROM orders JOIN l ON o_orderkey = k GROUP BY 1""")
def pool3(t):
    l = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("spent"))  # noqa: E741
    return t.orders.select("o_orderkey", "o_orderpriority").join(l, "o_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("tasks"), F.sum("spent").alias("spent"), F.count(F.when(F.col("spent") > 150, 1)).alias("over_cap"))


@query("pool4_cluster_subset", """
SELECT e.vec_id, e.label FROM embeddings e JOIN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 20) USING (label)""")
def pool4(t):
    big = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("label")
    return t.embeddings.select("vec_id", "label").join(big, "label", "left_semi")


@query("pool5_alignment_scores", "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def pool5(t):
    """Sums of fixed-point components, which are the same in any order."""
    fixed = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.round(x * 1000).cast("long"))
    return t.embeddings.select("vec_id", F.aggregate(fixed, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))

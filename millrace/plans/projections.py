"""Rows from demonstrations, inventories and paired machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import projections as P
from millrace.plans.registry import query


@query("flt16_reestimate", "SELECT event_id, 'zero' AS which FROM events WHERE floor(value) % 5 = 0 UNION ALL SELECT event_id, 'nonpos' FROM events WHERE floor(value) % 5 <= 0")
def flt16(t):
    d = t.events.select("event_id", (F.floor("value") % 5).alias("delta"))
    return P.reestimate(d, "delta", "zero").select("event_id", F.lit("zero").alias("which")).unionByName(P.reestimate(d, "delta", "nonpos").select("event_id", F.lit("nonpos").alias("which")))


@query("prj3_demo_rows", """
WITH k AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations), u AS (SELECT * FROM k WHERE role = 'user' AND answer IS NOT NULL)
SELECT conv_id::VARCHAR AS task_id, concat('c', conv_id % 4) AS category, 'luna' AS teacher, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, md5(text) AS prompt, md5(answer) AS response, greatest(length(answer) // 4, 1) AS token_hint FROM u""")
def prj3(t):
    """A conversation as a demonstration: what the user says, and what comes next."""
    from pyspark.sql import Window

    k = t.conversations.withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user' and answer is not null")
    demos = k.groupBy(F.col("conv_id").cast("string").alias("task_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("prompt"), F.col("answer").alias("target")))), lambda u: F.struct(u["prompt"].alias("prompt"), u["target"].alias("target"))).alias("turns"))
    got = P.demo_rows(demos, demos.select("task_id", F.concat(F.lit("c"), (F.col("task_id").cast("long") % 4).cast("string")).alias("category")), "luna")
    return got.withColumn("prompt", F.md5("prompt")).withColumn("response", F.md5("response"))


@query("prj6_inventory", "SELECT printf('page-%06d', page_id) AS _id, url AS question, md5(coalesce(html, '')) AS answer, 'multihop' AS type FROM pages")
def prj6(t):
    """Ids from the source's ordinals; pages stand in for questions."""
    rows = t.pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("answer"), F.length("html").alias("size"))
    return P.question_inventory(rows, {"question": "url", "answer": "answer"}, ["size"], "multihop", "page", "page_id")[0]


@query("prj6_annotations", "SELECT printf('page-%06d', page_id) AS _id, length(html) AS size FROM pages")
def prj6_annotations(t):
    rows = t.pages.select("page_id", "url", F.lit("").alias("answer"), F.length("html").cast("long").alias("size"))
    return P.question_inventory(rows, {"question": "url", "answer": "answer"}, ["size"], "multihop", "page", "page_id")[1]


@query("agg30_machine_effects", """
WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber) AS a, list(CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 2 THEN -1 ELSE l_partkey END ORDER BY l_linenumber) AS b, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS s, l_orderkey % 5 <> 0 AS c FROM lineitem GROUP BY l_orderkey)
SELECT k, a = b AS identical, len(a)::INT AS packages, s AS left_score, s * 1.5 AS right_score, CASE WHEN a = b AND c THEN round(s * 0.5, 6) END AS effect FROM l""")
def agg30(t):
    """An order's parts in line order as purchases on two machines, one of which replaced some second purchases."""
    side = lambda part, score: t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", part.alias("p")))), lambda x: x["p"]).alias("bought"), (F.sum(F.col("l_quantity").cast("long")).cast("double") * score).alias("score")).withColumn("complete", F.col("k") % 5 != 0)
    other = F.when((F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 2), F.lit(-1)).otherwise(F.col("l_partkey"))
    return P.machine_effects(side(F.col("l_partkey"), 1.0), side(other, 1.5), ["k"], "bought", "score", "complete")


@query("agg14_beta_superiority", """
WITH g AS (SELECT l_suppkey, 1 + sum((l_returnflag = 'R')::INT) AS a, 1 + sum((l_returnflag <> 'R')::INT) AS b, 1 + sum((l_linestatus = 'F')::INT) AS c, 1 + sum((l_linestatus <> 'F')::INT) AS d FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
t AS (SELECT l_suppkey, b, c, d, a, unnest(range(a::BIGINT)) AS i FROM g)
SELECT l_suppkey, round(sum(exp(lgamma(c + i) + lgamma(b + d) - lgamma(b + c + d + i) - ln(b + i) - (lgamma(1.0 + i) + lgamma(b) - lgamma(1.0 + i + b)) - (lgamma(c) + lgamma(d) - lgamma(c + d)))), 6) AS p FROM t GROUP BY 1""")
def agg14(t):
    """The chance that one rate exceeds another, from counts, in closed form; the first three lines are the attempts."""
    yes = lambda c: (1 + F.sum(c.cast("int"))).cast("long")
    r, s = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    g = t.lineitem.where("l_linenumber <= 3").groupBy("l_suppkey").agg(yes(r).alias("a"), yes(~r).alias("b"), yes(s).alias("c"), yes(~s).alias("d"))
    return g.select("l_suppkey", F.round(P.beta_superiority(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("p"))


@query("top10_closed_draws")
def top10(t):
    """Nations as packages: a nation depends on the first of its region."""
    n = t.nation.select("n_nationkey", "n_regionkey").join(t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("first")), "n_regionkey")
    deps = F.when(F.col("n_nationkey") != F.col("first"), F.array("first")).otherwise(F.array().cast("array<long>"))
    return P.closed_draws(n.select("n_nationkey", deps.alias("deps"), (1 + F.col("n_nationkey") % 4).alias("cost")), "n_nationkey", "deps", "cost", 20, "draw")

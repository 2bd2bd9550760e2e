"""Aggregates over pools, ledgers and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import aggregates as G
from millrace.plans.registry import query


@query("agg1_composition", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def agg1(t):
    return G.composition(t.documents, ["source", "lang"])


@query("agg2_selection_stats", """
SELECT lang, count(*) AS n, sum(greatest(n_chars // 4, 1))::BIGINT AS tokens, round(avg(CASE WHEN quality = 1 THEN n_chars END), 4) AS good_chars, round(avg(quality), 6) AS quality_rate
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def agg2(t):
    d = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.expr("n_chars div 4"), F.lit(1))).alias("tokens"), F.round(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))), 4).alias("good_chars"), F.round(F.avg("quality"), 6).alias("quality_rate"))


@query("agg3_trajectory_summary", "SELECT role, count(DISTINCT conv_id) AS episodes, count(*) AS n_rows, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def agg3(t):
    return t.conversations.groupBy("role").agg(F.countDistinct("conv_id").alias("episodes"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("chars"))


@query("agg4_ledger_compaction", """
SELECT user_id, count(*) AS attempts, sum(CAST(floor(value) AS BIGINT))::BIGINT AS tokens, max(event_id) FILTER (WHERE event_type = 'purchase') AS last_demo,
  (NOT bool_or(event_type = 'purchase')) AND count(*) >= 3 AS infeasible FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def agg4(t):
    e = t.events.where("event_type <> 'error'").withColumn("tok", F.floor("value").cast("long"))
    return G.compact_ledger(e, "user_id", "event_id", "tok", F.col("event_type") == "purchase", "event_id", 3)


@query("agg5_call_merge", "SELECT user_id, arg_max(event_type, event_id) AS status, round(arg_max(value, event_id), 6) AS charge FROM events GROUP BY user_id")
def agg5(t):
    return G.latest(t.events, ["user_id"], "event_id", ["event_type", "value"]).select("user_id", F.col("event_type").alias("status"), F.round("value", 6).alias("charge"))


@query("agg6_duplicate_audit", """
WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL) SELECT c AS attempts, count(*) AS n_keys, sum(c - 1)::BIGINT AS duplicates FROM g GROUP BY c""")
def agg6(t):
    """A histogram of group sizes: two aggregates, the second over counts."""
    g = t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy(F.col("c").alias("attempts")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("c") - 1).alias("duplicates"))


@query("agg7_phase_times", "SELECT event_type AS operation, count(*) AS n, round(sum(value), 3) AS total, round(max(value), 6) AS longest FROM events GROUP BY event_type")
def agg7(t):
    return t.events.groupBy(F.col("event_type").alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.round(F.max("value"), 6).alias("longest"))


@query("agg8_seed_stats", """
SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, count(c_acctbal) AS n FROM customer WHERE c_acctbal > 0 GROUP BY ALL""")
def agg8(t):
    s = G.seed_stats(t.customer, ["c_nationkey", "c_mktsegment"], "c_acctbal", F.col("c_acctbal") > 0)
    return s.select("c_nationkey", "c_mktsegment", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("agg9_macro_average", """
WITH p AS (SELECT source, lang, avg(quality) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT source, CASE WHEN count(m) = count(*) THEN round(avg(m), 6) END AS macro, count(m) AS n_categories FROM p GROUP BY source""")
def agg9(t):
    d = t.documents.select("doc_id", "source", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return G.macro_average(d, ["source"], "lang", "quality").withColumn("macro", F.round("macro", 6))


@query("agg10_weighted_overall", """
WITH p AS (SELECT o_orderpriority AS g, avg((o_orderstatus = 'F')::INT) AS m FROM orders GROUP BY 1), w AS (SELECT g, m, CASE g WHEN '1-URGENT' THEN 10 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 10 WHEN '4-NOT SPECIFIED' THEN 30 WHEN '5-LOW' THEN 40 END AS w FROM p)
SELECT round(sum(w * m) / sum(w), 6) AS overall, count(m) AS n_groups FROM w""")
def agg10(t):
    weights = {"1-URGENT": 10.0, "2-HIGH": 10.0, "3-MEDIUM": 10.0, "4-NOT SPECIFIED": 30.0, "5-LOW": 40.0}
    return G.weighted_overall(t.orders, F.col("o_orderpriority"), (F.col("o_orderstatus") == "F").cast("int"), weights).withColumn("overall", F.round("overall", 6))


@query("agg11_cells_from_tags", r"""
SELECT regexp_extract(concat(lang, '-', source), '^([a-z]+)-src([0-9]+)$', 1) AS method, regexp_extract(concat(lang, '-', source), '^([a-z]+)-src([0-9]+)$', 2) AS seed,
  round(avg(n_chars), 3) AS mean, round(stddev_pop(n_chars), 3) AS std FROM documents GROUP BY ALL""")
def agg11(t):
    tag, pat = F.concat_ws("-", "lang", "source"), r"^([a-z]+)-src([0-9]+)$"
    return t.documents.groupBy(F.regexp_extract(tag, pat, 1).alias("method"), F.regexp_extract(tag, pat, 2).alias("seed")).agg(F.round(F.avg("n_chars"), 3).alias("mean"), F.round(F.stddev_pop("n_chars"), 3).alias("std"))


@query("agg12_without_held_out", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def agg12(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("agg13_beta_means", "SELECT l_orderkey, round((sum((l_returnflag = 'R')::INT) + 1) / (count(*) + 2.0), 6) AS p_hat FROM lineitem GROUP BY l_orderkey")
def agg13(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(G.beta_mean(F.sum((F.col("l_returnflag") == "R").cast("int")), F.count(F.lit(1))), 6).alias("p_hat"))


@query("agg15_component_means", """
WITH e AS (SELECT generate_subscripts(embedding, 1) - 1 AS component, unnest(embedding)::DOUBLE AS z, label AS v FROM embeddings)
SELECT component, round(sum(abs(z) * v) / sum(abs(z)), 4) AS weighted_mean, count(*) AS n FROM e GROUP BY component""")
def agg15(t):
    return G.weighted_by_component(t.embeddings, "embedding", F.col("label")).withColumn("weighted_mean", F.round("weighted_mean", 4))


@query("agg16_cluster_failure", "SELECT source, round(1 - avg(quality), 6) AS failure FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg16(t):
    d = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(F.round(1 - F.avg("quality"), 6).alias("failure"))


@query("agg17_repair_damage", """
SELECT lang, sum((quality = 0 AND toxic = 1)::INT)::BIGINT AS repaired, sum((quality = 1 AND toxic = 0)::INT)::BIGINT AS damaged, sum((quality = 1 AND toxic = 1)::INT)::BIGINT AS kept_right,
  sum((quality = 0 AND toxic = 0)::INT)::BIGINT AS kept_wrong FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def agg17(t):
    return G.transition_counts(t.documents.select("doc_id", "lang").join(t.labels, "doc_id"), "quality", "toxic", ["lang"])


@query("agg18_cluster_mean", """
WITH p AS (SELECT source, avg(toxic - quality) AS m FROM documents JOIN labels USING (doc_id) GROUP BY source), t AS (SELECT sum(m) AS s, count(*) AS n FROM p)
SELECT round(avg(m), 6) AS mean, round(min((s - m) / (n - 1)), 6) AS least_without_one, sum((m > 0)::INT)::BIGINT AS positive, sum((m < 0)::INT)::BIGINT AS negative, count(*) AS n_clusters FROM p, t""")
def agg18(t):
    d = t.documents.select("doc_id", "source").join(t.labels, "doc_id").withColumn("d", F.col("toxic") - F.col("quality"))
    return G.cluster_mean(d, "source", "d").withColumn("mean", F.round("mean", 6)).withColumn("least_without_one", F.round("least_without_one", 6))


@query("agg19_seed_pooling", "SELECT o_custkey, o_orderpriority, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY ALL")
def agg19(t):
    return t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"))


@query("agg20_pair_accuracy", "SELECT l_orderkey, bool_and(l_linestatus = 'F') AS both_right, count(*) AS sides FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey HAVING count(*) = 2")
def agg20(t):
    return t.lineitem.where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("both_right"), F.count(F.lit(1)).alias("sides")).where("sides = 2")


@query("agg21_distribution", """
SELECT lang, quantile_cont(n_chars, 0.1) AS p10, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, quantile_cont(n_chars, 0.9) AS p90,
 sum((n_chars >= 0 AND n_chars <= 500)::INT)::BIGINT AS bin_0, sum((n_chars > 500 AND n_chars <= 2000)::INT)::BIGINT AS bin_1, sum((n_chars > 2000 AND n_chars <= 100000)::INT)::BIGINT AS bin_2, sum((n_chars IS NULL)::INT)::BIGINT AS missing
FROM documents GROUP BY lang""")
def agg21(t):
    d = G.distribution(t.documents, ["lang"], "n_chars", [0, 500, 2000, 100000])
    return d.select("lang", *[F.round(c, 6).alias(c) for c in d.columns if c[0] == "p"], *[c for c in d.columns if c[0] in "bm"])


@query("agg22_buckets", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'zero' WHEN o_totalprice <= 50000 THEN 'small' WHEN o_totalprice <= 200000 THEN 'medium' ELSE 'large' END AS bucket FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256(concat('bucket|', o_orderkey)), o_orderkey) AS rk FROM b) SELECT bucket, o_orderkey FROM r WHERE rk <= 20""")
def agg22(t):
    from millrace.operators.windows import top_per_group

    p = F.col("o_totalprice")
    b = t.orders.select("o_orderkey", F.when(p <= 0, "zero").when(p <= 50000, "small").when(p <= 200000, "medium").otherwise("large").alias("bucket"))
    return top_per_group(b, ["bucket"], [T.hash_rank_key("bucket", "o_orderkey"), F.col("o_orderkey")], 20).drop("rank")


@query("agg23_pool_summary", """
SELECT o_orderstatus, count(*) AS n, sum((o_totalprice > 150000)::INT)::BIGINT AS positive, round(avg((o_totalprice > 150000)::INT), 6) AS share, CAST(ceil(count(*) / 8.0) AS BIGINT) AS steps FROM orders GROUP BY o_orderstatus""")
def agg23(t):
    pos = (F.col("o_totalprice") > 150000).cast("int")
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(pos).alias("positive"), F.round(F.avg(pos), 6).alias("share"), F.ceil(F.count(F.lit(1)) / 8).alias("steps"))


@query("agg24_reach_by_depth", "SELECT least(l_linenumber, 5)::BIGINT AS depth, count(*) AS n, count(DISTINCT l_orderkey) AS tasks FROM lineitem GROUP BY 1")
def agg24(t):
    return t.lineitem.groupBy(F.least(F.col("l_linenumber").cast("long"), F.lit(5)).alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("tasks"))


@query("agg25_cost_shares", "SELECT l_orderkey, l_linenumber, round(o_totalprice / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def agg25(t):
    j = t.lineitem.select("l_orderkey", "l_linenumber").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    return G.cost_shares(j, "l_orderkey", "o_totalprice").select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))


@query("agg26_apportion", """
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(floor(1000 * CAST(l_quantity AS BIGINT) / sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey)) AS BIGINT) AS s, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, (s + (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= 1000 - sum(s) OVER (PARTITION BY l_orderkey))::INT)::BIGINT AS tokens FROM s""")
def agg26(t):
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    d = t.lineitem.select("l_orderkey", *tie, F.col("l_quantity").cast("long").alias("w"))
    return G.apportion(d, ["l_orderkey"], [F.col(c) for c in tie], "w", F.lit(1000), "tokens").select("l_orderkey", "l_linenumber", "tokens")


@query("agg27_nested_mass", """
WITH a AS (SELECT count(DISTINCT lang) AS n0 FROM documents), b AS (SELECT lang, count(DISTINCT source) AS n1 FROM documents GROUP BY lang), c AS (SELECT lang, source, count(*) AS n2 FROM documents GROUP BY ALL)
SELECT doc_id, round(1.0 / n0 / n1 / n2, 9) AS mass FROM documents JOIN b USING (lang) JOIN c USING (lang, source), a""")
def agg27(t):
    return G.nested_mass(t.documents.select("doc_id", "lang", "source"), ["lang", "source"]).select("doc_id", F.round("mass", 9).alias("mass"))


@query("agg28_exposure", """
WITH d AS (SELECT doc_id, n_chars + 1.0 AS c, 1.0 / count(*) OVER () AS p FROM documents), z AS (SELECT sum(p / c) AS z FROM d) SELECT doc_id, round(p / c / z, 9) AS exposure, round(z * c, 6) AS ratio FROM d, z""")
def agg28(t):
    n = t.documents.agg(F.count(F.lit(1)).alias("n"))
    d = t.documents.select("doc_id", (F.col("n_chars") + 1.0).alias("c")).crossJoin(F.broadcast(n)).withColumn("p", 1.0 / F.col("n"))
    return G.exposure(d, "p", "c").select("doc_id", F.round("exposure", 9).alias("exposure"), F.round("ratio", 6).alias("ratio"))


@query("agg29_attempt_ledger", """
SELECT l_orderkey, bool_or(l_returnflag = 'N') AS usable, sum(CAST(l_quantity AS BIGINT))::BIGINT AS cost, CASE WHEN bool_or(l_linestatus = 'O') THEN 'estimated' ELSE 'exact' END AS confidence FROM lineitem GROUP BY l_orderkey""")
def agg29(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("usable"), F.sum(F.col("l_quantity").cast("long")).alias("cost"), F.when(F.bool_or(F.col("l_linestatus") == "O"), "estimated").otherwise("exact").alias("confidence"))


@query("agg31_official_metrics", """
WITH p AS (SELECT l_orderkey, avg(l_discount) AS m FROM lineitem GROUP BY 1) SELECT round(100 * avg(l_discount), 6) AS reward, (SELECT round(avg(m), 6) FROM p) AS pass_one, count(*) - count(DISTINCT l_partkey) AS repeated FROM lineitem""")
def agg31(t):
    l = t.lineitem  # noqa: E741
    one = l.groupBy("l_orderkey").agg(F.avg("l_discount").alias("m")).agg(F.round(F.avg("m"), 6).alias("pass_one"))
    return l.agg(F.round(100 * F.avg("l_discount"), 6).alias("reward"), (F.count(F.lit(1)) - F.countDistinct("l_partkey")).alias("repeated")).crossJoin(one)


@query("agg32_matrix", """
SELECT source, lang, CASE WHEN count(DISTINCT CASE WHEN quality IS NOT NULL THEN doc_id % 3 END) = 3 THEN round(avg(quality), 6) END AS cell, count(quality) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def agg32(t):
    d = t.documents.select("doc_id", "source", "lang", (F.col("doc_id") % 3).alias("seed")).join(t.labels, "doc_id", "left")
    return G.matrix(d, "source", "lang", "seed", "quality", 3).withColumn("cell", F.round("cell", 6))


@query("agg33_distinct", "SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT md5(text)) AS texts FROM documents")
def agg33(t):
    return t.documents.agg(F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"), F.countDistinct(F.md5("text")).alias("texts"))


@query("agg34_decimal_cost", "SELECT event_type, sum(CAST(floor(value) AS DECIMAL(18,0)) * 0.0000025)::DOUBLE AS usd FROM events GROUP BY event_type")
def agg34(t):
    usd = F.floor("value").cast("decimal(18,0)") * F.lit("0.0000025").cast("decimal(10,7)")
    return t.events.groupBy("event_type").agg(F.sum(usd).cast("double").alias("usd"))


@query("agg35_reconcile", """
WITH a AS (SELECT doc_id, lang FROM documents), f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 UNION SELECT -1)
SELECT a.lang, count(a.doc_id) AS total, count(*) FILTER (WHERE a.doc_id IS NOT NULL AND f.doc_id IS NULL) AS correct, count(*) FILTER (WHERE a.doc_id IS NULL) AS unknown FROM a FULL JOIN f USING (doc_id) GROUP BY a.lang""")
def agg35(t):
    bad = t.labels.where("quality = 0").select("doc_id").union(t.spark.range(-1, 0).toDF("doc_id"))
    return G.reconcile(t.documents, bad, ["doc_id"], "lang")


@query("agg36_role_usage", "SELECT role, sum(CASE WHEN turn % 3 = 0 THEN 100 + turn WHEN turn % 3 = 1 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) ELSE length(text) END)::BIGINT AS tokens, max(CASE WHEN turn % 3 = 1 THEN 'estimated' ELSE 'exact' END) AS status FROM conversations GROUP BY role")
def agg36(t):
    """Charge, else reported usage, else an estimate."""
    charge, usage = F.when(F.col("turn") % 3 == 0, 100 + F.col("turn")), F.when(F.col("turn") % 3 == 2, F.length("text"))
    return t.conversations.groupBy("role").agg(F.sum(F.coalesce(charge, usage, T.token_estimate("text"))).alias("tokens"), F.max(F.when(F.col("turn") % 3 == 1, "estimated").otherwise("exact")).alias("status"))


@query("agg37_success_rates", """
WITH a AS (SELECT l_orderkey AS k, avg((l_returnflag = 'R')::INT) AS p FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), b AS (SELECT l_orderkey AS k, avg((l_returnflag = 'R')::INT) AS p FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS task, round(coalesce(b.p, a.p), 6) AS p_hat FROM a FULL JOIN b ON a.k = b.k""")
def agg37(t):
    r = lambda odd, c: t.lineitem.where(F.col("l_linenumber") % 2 == odd).groupBy(F.col("l_orderkey").alias("task")).agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias(c))
    return r(1, "a").join(r(0, "b"), "task", "full_outer").select("task", F.round(F.coalesce("b", "a"), 6).alias("p_hat"))


@query("agg38_affordability", """
WITH p AS (SELECT unnest([10, 25, 50]) AS percent), d AS (SELECT lang, n_chars FROM documents), g AS (SELECT percent, 20000 * percent // 100 AS budget, lang, sum((n_chars <= 20000 * percent // 100)::INT)::BIGINT AS affordable, count(*) AS available, max(n_chars) AS dearest FROM d, p GROUP BY ALL)
SELECT *, least(available, budget // dearest) AS capacity FROM g""")
def agg38(t):
    return G.affordability(t.documents.select("lang", "n_chars"), "n_chars", ["lang"], 20000, [10, 25, 50])


@query("agg39_mass_overlap", """
WITH g AS (SELECT source, coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0) AS l, coalesce(sum(n_chars) FILTER (WHERE lang = 'de'), 0) AS r FROM documents WHERE lang IN ('en', 'de') GROUP BY source), t AS (SELECT sum(l) AS tl, sum(r) AS tr FROM g)
SELECT round(sum(least(l / tl, r / tr)), 6) AS overlap, sum((l > 0 AND r > 0)::INT)::BIGINT AS shared, sum((l > 0 AND r = 0)::INT)::BIGINT AS left_only, sum((l = 0 AND r > 0)::INT)::BIGINT AS right_only FROM g, t""")
def agg39(t):
    d = t.documents.where(F.col("lang").isin("en", "de")).select("source", "n_chars", F.when(F.col("lang") == "en", "left").otherwise("right").alias("side"))
    return G.mass_overlap(d, "side", "source", "n_chars").withColumn("overlap", F.round("overlap", 6))


@query("agg40_gain_matrix", """
WITH b AS (SELECT avg(quality) AS base FROM labels) SELECT lang AS i, source AS j, round(avg(quality - base), 6) AS gain, count(*) AS n FROM documents JOIN labels USING (doc_id), b GROUP BY ALL""")
def agg40(t):
    base = t.labels.agg(F.avg("quality").alias("base"))
    d = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id").crossJoin(F.broadcast(base))
    return d.groupBy(F.col("lang").alias("i"), F.col("source").alias("j")).agg(F.round(F.avg(F.col("quality") - F.col("base")), 6).alias("gain"), F.count(F.lit(1)).alias("n"))


@query("agg41_changes", """
SELECT lang, sum((toxic > quality)::INT)::BIGINT AS raised, sum((toxic < quality)::INT)::BIGINT AS lowered, sum((quality IS NULL)::INT)::BIGINT AS missing, round(avg(toxic - quality), 6) AS mean_change FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def agg41(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    s = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return d.groupBy("lang").agg(s(F.col("toxic") > F.col("quality")).alias("raised"), s(F.col("toxic") < F.col("quality")).alias("lowered"), s(F.col("quality").isNull()).alias("missing"), F.round(F.avg(F.col("toxic") - F.col("quality")), 6).alias("mean_change"))


@query("agg42_count_from_rate", "WITH r AS (SELECT lang, count(*) AS n, avg(quality) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, n, least(greatest(CAST(round_even(rate * n, 0) AS BIGINT), 0), n) AS k FROM r")
def agg42(t):
    r = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("rate"))
    return r.select("lang", "n", G.count_from_rate(F.col("rate"), F.col("n")).alias("k"))


@query("agg43_eval_summary", """
WITH s AS (SELECT DISTINCT l_partkey, l_returnflag, l_linestatus FROM lineitem) SELECT count(*) AS states, round(sum((l_returnflag = 'R')::INT) / nullif(sum((l_linestatus = 'F')::INT), 0), 6) AS rate FROM s""")
def agg43(t):
    s = t.lineitem.select("l_partkey", "l_returnflag", "l_linestatus").distinct()
    return s.agg(F.count(F.lit(1)).alias("states"), F.round(F.try_divide(F.sum((F.col("l_returnflag") == "R").cast("int")), F.sum((F.col("l_linestatus") == "F").cast("int"))), 6).alias("rate"))

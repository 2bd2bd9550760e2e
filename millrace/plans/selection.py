"""Budgets, windows and ranked selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import greedy as R
from millrace.operators import selection as S
from millrace.operators import windows as W
from millrace.plans.registry import query

BUDGETED = """
WITH d AS (SELECT doc_id, source, lang, CAST(ceil(n_chars / 4.0) AS BIGINT) AS cost, coalesce(quality, -1) AS q FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, sum(cost) OVER (ORDER BY q DESC, sha256(concat('select|', doc_id)), doc_id ROWS UNBOUNDED PRECEDING) AS running FROM d)"""


def pool(t):
    """documents as a candidate pool: id, cost, score."""
    d = t.documents.select(F.col("doc_id").alias("id"), "source", "lang", F.ceil(F.col("n_chars") / 4).cast("long").alias("cost"))
    return d.join(t.labels.select(F.col("doc_id").alias("id"), "quality"), "id", "left").withColumn("score", F.coalesce("quality", F.lit(-1)))


@query("budgeted_selection_report", BUDGETED + " SELECT source, lang, count(*) AS n, sum(cost)::BIGINT AS tokens FROM r WHERE running <= 200000 GROUP BY source, lang")
def budgeted(t):
    """The flagship: rank by quality, then hash; take rows while the budget lasts; report what was taken."""
    took = W.take_within_budget(pool(t), [F.desc("score"), T.hash_rank_key("select", "id"), F.col("id")], F.col("cost"), 200000)
    return took.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"))


@query("win1_budget_prefix", BUDGETED + " SELECT doc_id AS id, cost, running::BIGINT AS running_cost FROM r WHERE running <= 200000")
def win1(t):
    return W.take_within_budget(pool(t), [F.desc("score"), T.hash_rank_key("select", "id"), F.col("id")], F.col("cost"), 200000).select("id", "cost", "running_cost")


@query("win2_skip_fill", """
WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars % 101, doc_id) AS rn FROM documents WHERE ceil(n_chars / 4.0) <= 5000),
f AS (SELECT source, 0::BIGINT AS rn, 0::BIGINT AS spent, -1::BIGINT AS doc_id, false AS kept FROM (SELECT DISTINCT source FROM d)
 UNION ALL SELECT f.source, d.rn, CASE WHEN f.spent + d.cost <= 5000 THEN f.spent + d.cost ELSE f.spent END, d.doc_id, f.spent + d.cost <= 5000 FROM f JOIN d ON d.source = f.source AND d.rn = f.rn + 1)
SELECT source, doc_id AS id FROM f WHERE kept""")
def win2(t):
    d = t.documents.select("source", F.col("doc_id").alias("id"), F.ceil(F.col("n_chars") / 4).cast("long").alias("cost"), (F.col("n_chars") % 101).alias("ord"))
    return W.fill_within_budget(d, ["source"], ["ord"], "id", "cost", 5000)


@query("win3_group_cap", "SELECT source, doc_id, n_chars, rank FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def win3(t):
    return W.top_per_group(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)


@query("win4_first_per_key", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1")
def win4(t):
    return W.first_per_key(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("win5_round_robin", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('rr|', doc_id)), doc_id) AS turn, sha256(concat('rr|', source)) AS place FROM documents")
def win5(t):
    d = t.documents.select("doc_id", "source")
    return W.interleave(d, ["source"], [T.hash_rank_key("rr", "doc_id"), F.col("doc_id")], T.hash_rank_key("rr", "source")).select("doc_id", "turn", "place")


@query("win6_capped_share", """
WITH k AS (SELECT doc_id, lang = 'en' AS k FROM documents), c AS (SELECT count(*) FILTER (WHERE NOT k) AS o FROM k), r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM k)
SELECT doc_id FROM r, c WHERE NOT k OR rn <= floor(1 * o / 2.0)""")
def win6(t):
    return W.cap_share(t.documents.select("doc_id", "lang"), F.col("lang") == "en", [F.col("doc_id")], 1, 3).select("doc_id")


@query("win7_average_ranks", "SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rank FROM documents")
def win7(t):
    return W.average_ranks(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], "n_chars", "rank").select("doc_id", "rank")


@query("win8_ordinal_ranks", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rank FROM documents")
def win8(t):
    return W.ordinal_ranks(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], [F.col("n_chars"), F.col("doc_id")], "rank").select("doc_id", "rank")


@query("win9_overlap_with_previous", r"""
WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w, lag(list_distinct(string_split(lower(text), ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT conv_id, turn, len(list_intersect(w, coalesce(p, []))) AS common FROM w""")
def win9(t):
    """Words a turn shares with the one before."""
    w = F.array_distinct(F.split(F.lower("text"), " "))
    d = t.conversations.select("conv_id", "turn", w.alias("w")).withColumn("p", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn")))
    return d.select("conv_id", "turn", F.size(F.array_intersect("w", F.coalesce("p", F.array().cast("array<string>")))).cast("long").alias("common"))


@query("win10_seen_before", """
SELECT conv_id, turn, (SELECT count(DISTINCT p.role) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn) AS roles_before FROM conversations c""")
def win10(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return t.conversations.select("conv_id", "turn", F.size(F.collect_set("role").over(w)).cast("long").alias("roles_before"))


@query("win11_probe_positions", """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, k - 1 AS position FROM r WHERE k IN (ceil(n / 3.0), ceil(2 * n / 3.0), n)""")
def win11(t):
    return W.probe_positions(t.conversations.select("conv_id", "turn"), ["conv_id"], [F.col("turn")], 3)


@query("win12_gap_midpoints", """
SELECT * FROM (SELECT l_orderkey, l_partkey AS "left", lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS "right", CAST(floor((l_partkey + lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey)) / 2.0) AS BIGINT) AS midpoint FROM lineitem)
WHERE "right" - "left" > 1""")
def win12(t):
    return W.gap_midpoints(t.lineitem.select("l_orderkey", "l_partkey"), ["l_orderkey"], "l_partkey")


@query("win13_chain_check", "SELECT * FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, event_id % 7 = coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) % 7 AS linked FROM events)")
def win13(t):
    p = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.events.select("user_id", "event_id", p.alias("previous"), (F.col("event_id") % 7 == F.coalesce(p, F.lit(0)) % 7).alias("linked"))


@query("win14_energy_cutoff", """
WITH r AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS run, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem)
SELECT l_orderkey, sum((run * 10 < total * 9)::INT)::BIGINT + 1 AS components FROM r GROUP BY l_orderkey""")
def win14(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").cast("decimal(18,0)").alias("q"))
    return W.energy_cutoff(d.withColumn("q", F.col("q") * 1), ["l_orderkey"], "q", [F.desc("q"), F.col("l_linenumber")], F.lit("0.9").cast("decimal(2,1)"))


@query("win15_trajectory", """
WITH s AS (SELECT user_id, event_id, value, sign(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS d FROM events)
SELECT user_id, round(arg_min(value, event_id), 6) AS first_value, round(arg_max(value, event_id), 6) AS last_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value,
  sum(CASE WHEN d > 0 THEN 1 WHEN d IS NOT NULL THEN 0 END)::BIGINT AS rises, sum(CASE WHEN d < 0 THEN 1 WHEN d IS NOT NULL THEN 0 END)::BIGINT AS falls, round(avg((value >= 50)::INT), 6) AS at_cap FROM s GROUP BY user_id""")
def win15(t):
    d = W.trajectory(t.events, ["user_id"], "event_id", "value", 50)
    return d.select("user_id", *[F.round(c, 6).alias(c) for c in ("first_value", "last_value", "min_value", "max_value", "at_cap")], "rises", "falls")


@query("win16_leave_one_out", """
SELECT o_orderkey, round(CASE WHEN count(*) OVER w > 1 THEN (sum(c) OVER w - c)::DOUBLE / (count(*) OVER w - 1) END, 3) AS others FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) WINDOW w AS (PARTITION BY o_custkey)""")
def win16(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")
    return W.leave_one_out(t.orders.select("o_orderkey", "o_custkey", cents), ["o_custkey"], "cents", "others").select("o_orderkey", F.round("others", 3).alias("others"))


@query("win17_token_schedule", """
WITH r AS (SELECT doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS n, sum(CAST(ceil(n_chars / 4.0) AS BIGINT)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM documents),
x AS (SELECT doc_id, n, e, unnest(range((e - n) // 2048, (e - 1) // 2048 + 1)) AS step FROM r WHERE n > 0)
SELECT doc_id, step, greatest(step * 2048, e - n) - (e - n) AS start, least((step + 1) * 2048, e) - (e - n) AS stop FROM x""")
def win17(t):
    d = t.documents.select("doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("n"))
    return W.token_schedule(d, [F.col("doc_id")], F.col("n"), 2048).select("doc_id", "step", "start", "stop")


@query("win19_resumed_spend", """
WITH r AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id, n_chars FROM r WHERE 5000 + before < 100000""")
def win19(t):
    todo = t.documents.select("doc_id", "n_chars").where("doc_id % 4 <> 0")
    return W.take_until_spent(todo, [F.col("doc_id")], F.col("n_chars"), 100000, 5000).select("doc_id", "n_chars")


@query("win18_length_batches")
def win18(t):
    """Texts of a source are a prompt's rows; the limit is by language."""
    d = t.documents.select("doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("n"), (F.length("lang") * 64 + F.ascii("lang")).cast("long").alias("limit"), F.expr("doc_id div 3").alias("prompt"))
    return W.length_batches(d, "doc_id", "n", "limit", "prompt", 16384, 24)


@query("top1_stable_order", "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 50")
def top1(t):
    """A limit in the plan, so that a task keeps 50 rows and no more."""
    top = t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))


@query("top2_conditions", """
WITH d AS (SELECT doc_id AS id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS cost, coalesce(quality, -1) AS score FROM documents LEFT JOIN labels USING (doc_id)),
a AS (SELECT 'random' AS c, id, cost, sum(cost) OVER (ORDER BY sha256(concat('select|', id)), id ROWS UNBOUNDED PRECEDING) AS run FROM d
 UNION ALL SELECT 'score', id, cost, sum(cost) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) FROM d
 UNION ALL SELECT 'cheapest', id, cost, sum(cost) OVER (ORDER BY cost, id ROWS UNBOUNDED PRECEDING) FROM d
 UNION ALL SELECT 'all', id, cost, sum(cost) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) FROM d)
SELECT c AS condition, count(*) AS n, sum(cost)::BIGINT AS tokens FROM a WHERE run <= 100000 GROUP BY c""")
def top2(t):
    p, out = pool(t), None
    for c in ("random", "score", "cheapest", "all"):
        one = S.select(p, c, 100000).groupBy(F.lit(c).alias("condition")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out


def offers(t):
    """embeddings as a pool: loadings are the positive parts of the vector, costs and scores come from the ids."""
    loads = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(x, F.lit(0.0)))
    return t.embeddings.select(F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 7).cast("double").alias("cost"), loads.alias("x"), F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double").alias("score"), "label")


DEMAND = [1.0 + k % 5 for k in range(64)]


@query("top4_facility_location")
def top4(t):
    """Greedy cover of 64 stated directions over the whole table, then a top-up by score."""
    return R.cover(offers(t), "id", F.col("cost"), "x", F.col("score"), 150.0)


@query("top5_market_clearing")
def top5(t):
    return R.market(offers(t), "id", F.col("cost"), "x", DEMAND, 150.0, F.col("score"))


@query("top6_residual_greedy")
def top6(t):
    return R.residual(offers(t), "id", F.col("cost"), "x", DEMAND, 150.0, 0.25, 1.0)


@query("top6_residual_replay", """
WITH e AS (SELECT generate_subscripts(embedding, 1) - 1 AS atom, greatest(unnest(embedding)::DOUBLE, 0) AS z FROM embeddings WHERE vec_id % 7 = 0)
SELECT atom::INT AS atom, 1.0 + atom % 5 AS before, round((1.0 + atom % 5) * exp(sum(ln(1 - 0.25 * z))), 6) AS after FROM e GROUP BY atom""")
def top6_replay(t):
    """What the rows of cost one leave of the residual, whatever their order."""
    return R.residual_after(offers(t).where("cost = 1"), "x", DEMAND, 0.25).withColumn("after", F.round("after", 6))


@query("top7_policies")
def top7(t):
    """Offline policies on one pool and budget: what each takes, skipping what doesn't fit."""
    p = offers(t)
    took = {
        "random": R.fill(p, "id", F.col("cost"), -F.conv(F.substring(T.hash_rank_key("policy", "id"), 1, 12), 16, 10).cast("double"), 60.0), "score": R.fill(p, "id", F.col("cost"), F.col("score"), 60.0),
        "density": R.fill(p, "id", F.col("cost"), F.col("score"), 60.0, density=True), "cheapest": R.fill(p, "id", F.col("cost"), -F.col("cost"), 60.0), "cover": R.cover(p, "id", F.col("cost"), "x", F.col("score"), 60.0),
        "market": R.market(p, "id", F.col("cost"), "x", DEMAND, 60.0, F.col("score")), "residual": R.residual(p, "id", F.col("cost"), "x", DEMAND, 60.0),
    }
    return reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("policy"), "pick", "id", "cost") for k, d in took.items()])


@query("top17_metered_rounds")
def top17(t):
    """A quote is the cost, what is paid differs from it, and every fifth row is paid and not accepted."""
    p = offers(t).withColumn("paid", F.col("cost") * (0.5 + (F.col("id") % 4) / 2.0))
    return R.metered(p, "id", F.col("cost"), "paid", "x", DEMAND, 150.0, F.col("id") % 5 != 0)


@query("top19_probe_uncertainty", """
WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS atom, greatest(unnest(embedding)::DOUBLE, 0) AS z FROM embeddings),
g AS (SELECT atom, label, sum(z) AS s, count(*) AS n FROM e GROUP BY 1, 2), l AS (SELECT atom, label, s, sum(s) OVER (PARTITION BY atom) AS ts, (sum(s) OVER (PARTITION BY atom) - s) / (sum(n) OVER (PARTITION BY atom) - n) AS m FROM g)
SELECT atom::INT AS atom, round(stddev_pop(m), 9) AS uncertainty, round(max(s / ts), 9) AS anchor_share FROM l GROUP BY atom ORDER BY stddev_pop(m) DESC, atom LIMIT 5""")
def top19(t):
    got = R.probe_uncertainty(offers(t), "label", "x", 5)
    return got.select("atom", F.round("uncertainty", 9).alias("uncertainty"), F.round("anchor_share", 9).alias("anchor_share"))


@query("top21_deficit_order", """
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, greatest(unnest(embedding)::DOUBLE, 0) AS z FROM embeddings), d AS (SELECT k, avg(z) AS m FROM e WHERE vec_id % 10 = 3 GROUP BY k)
SELECT vec_id AS id, round(sum(z * m), 6) AS deficit_score FROM e JOIN d USING (k) WHERE vec_id % 10 <> 3 GROUP BY vec_id""")
def top21(t):
    """Rows by how far they serve the mean loadings of failed rows (ids that end in 3)."""
    p = offers(t)
    got = R.by_deficit(p.where("id % 10 <> 3"), "x", R.deficit(p.where("id % 10 = 3"), "x"))
    return got.select("id", F.round("deficit_score", 6).alias("deficit_score"))


@query("top8_knapsack")
def top8(t):
    d = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("id"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").cast("double").alias("cost"))
    return S.knapsack(d, ["l_orderkey"], 60.0, 3)


@query("top12_density", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY coalesce(quality, 0) * 1.0 / greatest(n_chars, 1) DESC, doc_id) AS rn FROM documents LEFT JOIN labels USING (doc_id)) WHERE rn <= 100")
def top12(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.orderBy(F.desc(F.coalesce("quality", F.lit(0)) / F.greatest("n_chars", F.lit(1))), "doc_id").limit(100).select("doc_id")


@query("top13_tranches", """
WITH a AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 50),
b AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars % 1000 DESC, doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a)) WHERE rn <= 50)
SELECT doc_id, 1 AS tranche FROM a UNION ALL SELECT doc_id, 2 FROM b""")
def top13(t):
    d = t.documents.select("doc_id", "n_chars")
    a = d.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id")
    b = d.join(a, "doc_id", "left_anti").orderBy(F.desc(F.col("n_chars") % 1000), "doc_id").limit(50).select("doc_id")
    return a.withColumn("tranche", F.lit(1)).unionByName(b.withColumn("tranche", F.lit(2)))


@query("top14_best_of", """
SELECT l_orderkey, arg_max(l_linenumber, l_quantity * 100 - l_linenumber)::INT AS best, arg_min(l_linenumber, l_quantity * 100 + l_linenumber)::INT AS worst, count(*) AS n FROM lineitem GROUP BY l_orderkey""")
def top14(t):
    return S.best_of(t.lineitem, "l_orderkey", "l_quantity", "l_linenumber").select("l_orderkey", F.col("best").cast("int").alias("best"), F.col("worst").cast("int").alias("worst"), "n")


@query("top15_first_n_shuffled", "SELECT doc_id FROM documents ORDER BY sha256(concat('first|', doc_id)), doc_id LIMIT 100")
def top15(t):
    return t.documents.select("doc_id").orderBy(T.hash_rank_key("first", "doc_id"), "doc_id").limit(100)


@query("top16_ndcg", """
WITH r AS (SELECT o_custkey AS q, o_orderkey AS id, o_totalprice % 1000 AS s, (o_orderstatus = 'F')::INT AS g FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS a, row_number() OVER (PARTITION BY q ORDER BY g DESC, id) AS b FROM r)
SELECT q, round(sum(CASE WHEN a <= 5 THEN g / log2(a + 1.0) END) / nullif(sum(CASE WHEN b <= 5 THEN g / log2(b + 1.0) END), 0), 6) AS ndcg FROM k GROUP BY q""")
def top16(t):
    from millrace.operators.statistics import ndcg

    d = t.orders.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 1000).alias("s"), (F.col("o_orderstatus") == "F").cast("int").alias("g"))
    return ndcg(d, "q", F.col("s"), "g", "id", 5).withColumn("ndcg", F.round("ndcg", 6))


@query("top22_self_consistent", """
SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(*) = 3 AND max(l_quantity) - min(l_quantity) <= 15""")
def top22(t):
    return S.self_consistent(t.lineitem.where("l_linenumber <= 3"), "l_orderkey", "l_quantity", 3, 15)


@query("top23_preference_pairs", """
WITH g AS (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) AS chosen FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), b AS (SELECT l_orderkey, l_partkey AS rejected, min(l_linenumber) AS o FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
r AS (SELECT l_orderkey, rejected, row_number() OVER (PARTITION BY l_orderkey ORDER BY o, rejected) AS pair FROM b) SELECT l_orderkey, rejected, pair, chosen FROM r JOIN g USING (l_orderkey) WHERE pair <= 2""")
def top23(t):
    return S.preference_pairs(t.lineitem, "l_orderkey", "l_partkey", F.col("l_returnflag") == "N", "l_linenumber")


@query("top24_demand_weights", """
WITH d AS (SELECT doc_id, n_chars::DOUBLE AS s FROM documents), m AS (SELECT avg(s) AS m, 1 + 3 * least(1.0, count(*) / 64.0) AS c FROM d) SELECT doc_id, round(least(greatest(s / m, 1 / c), c), 6) AS weight FROM d, m""")
def top24(t):
    return S.demand_weights(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("s")), F.col("s")).select("doc_id", F.round("weight", 6).alias("weight"))

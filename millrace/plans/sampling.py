"""Sets, duplicates, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import sampling as P
from millrace.plans.registry import query

QUOTA = """
WITH c AS (SELECT lang AS g, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT sum(n) AS t, count(*) AS k FROM c),
q AS (SELECT g, n, CAST(({total} - {floor} * k) * n AS BIGINT) // t::BIGINT AS q, CAST(({total} - {floor} * k) * n AS BIGINT) % t::BIGINT AS rem, {total} - {floor} * k AS room FROM c, t),
a AS (SELECT g, n, q + {floor} + (row_number() OVER (ORDER BY rem DESC, n DESC, g) <= room - sum(q) OVER ())::INT AS quota FROM q)"""


@query("set1_union_all", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def set1(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(t.pages.select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


@query("set2_id_algebra", """
(SELECT doc_id AS id, 'both' AS part FROM documents INTERSECT SELECT doc_id, 'both' FROM labels) UNION ALL (SELECT doc_id, 'missing' FROM documents EXCEPT SELECT doc_id, 'missing' FROM labels)
UNION ALL (SELECT doc_id, 'extra' FROM labels EXCEPT SELECT doc_id, 'extra' FROM documents)""")
def set2(t):
    """Intersection and both differences from one outer join."""
    a, b = t.documents.select("doc_id", F.lit(1).alias("a")).distinct(), t.labels.select("doc_id", F.lit(1).alias("b")).distinct()
    part = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("both")
    return a.join(b, "doc_id", "full_outer").select(F.col("doc_id").alias("id"), part.alias("part"))


@query("set3_keep_first", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text[:30], source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def set3(t):
    return P.keep_first(t.documents.select("doc_id", "text", "source"), [F.substring("text", 1, 30), F.col("source")], [F.col("doc_id")]).select("doc_id")


@query("set4_merge_sources", "SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM documents GROUP BY 1")
def set4(t):
    return P.merge_sources(t.documents, F.col("text"), "doc_id", "source")


@query("set5_quarantine", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)")
def set5(t):
    return P.quarantine(t.orders, ["o_custkey"], "o_orderstatus").select("o_orderkey")


@query("set6_rouge_filter")
def set6(t):
    """Sequential ROUGE-L filter over all whole prompts; see operators.dedup."""
    from millrace.operators.dedup import rouge_filter

    return rouge_filter(t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")), ["conv_id", "turn"], "prompt", 0.7).select("conv_id", "turn")


@query("set7_prompt_dedup", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1")
def set7(t):
    u = t.conversations.where("role = 'user'").select("conv_id", "turn", "text")
    return P.keep_first(u, [F.col("text")], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn")


@query("smp1_stratified", QUOTA.format(total=100, floor=2) + """,
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('sample|', doc_id)), doc_id) AS rn FROM documents) SELECT doc_id, lang FROM r JOIN a ON lang = g WHERE rn <= quota""")
def smp1(t):
    return P.stratified(t.documents.select("doc_id", "lang"), "lang", "doc_id", 100, "sample", 2).select("doc_id", "lang")


@query("smp2_support_split")
def smp2(t):
    return P.support_split(t.documents, "lang", "doc_id", "split")


@query("smp3_largest_remainder", QUOTA.format(total=77, floor=0) + " SELECT g AS lang, n, quota::BIGINT AS quota FROM a")
def smp3(t):
    return P.largest_remainder(t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", 77)


@query("smp4_equal_quotas", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('equal|', doc_id)), doc_id) AS rn FROM documents) WHERE rn <= 5")
def smp4(t):
    from millrace.operators.windows import top_per_group

    return top_per_group(t.documents.select("doc_id", "source"), ["source"], [T.hash_rank_key("equal", "doc_id"), F.col("doc_id")], 5).drop("rank")


@query("smp6_new_events", """
WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256(concat('new|', event_id)), event_id) AS rn FROM events WHERE event_type <> 'view') SELECT user_id, count(*) AS got, 10 - count(*) AS short FROM n WHERE rn <= 10 GROUP BY user_id""")
def smp6(t):
    from millrace.operators.windows import top_per_group

    got = top_per_group(t.events.where("event_type <> 'view'").select("event_id", "user_id"), ["user_id"], [T.hash_rank_key("new", "event_id"), F.col("event_id")], 10)
    return got.groupBy("user_id").agg(F.count(F.lit(1)).alias("got"), (10 - F.count(F.lit(1))).alias("short"))


@query("smp7_hash_parity", "SELECT doc_id, (instr('0123456789abcdef', right(sha256(concat('fold|', doc_id)), 1)) - 1)::INT % 2 AS fold FROM documents")
def smp7(t):
    return t.documents.select("doc_id", T.hash_parity(T.hash_rank_key("fold", "doc_id")).alias("fold"))


@query("smp8_group_folds", """
WITH g AS (SELECT source, ((row_number() OVER (ORDER BY sha256(concat('folds|', source)), source) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, fold FROM documents JOIN g USING (source)""")
def smp8(t):
    return P.group_folds(t.documents.select("doc_id", "source"), "source", 5, "folds").select("doc_id", "fold")


@query("smp9_pair_split", """
WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT source FROM g ORDER BY n, source LIMIT 1),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('pair|', doc_id)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN source IN (SELECT source FROM s) THEN 'heldout' WHEN rn <= ceil(n * 0.2) THEN 'within' ELSE 'train' END AS part FROM r""")
def smp9(t):
    """The smallest group is held out; of every other a fifth."""
    from pyspark.sql import Window

    d = t.documents.select("doc_id", "source")
    least = d.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("n", "source").limit(1).select("source", F.lit(1).alias("h"))
    w = Window.partitionBy("source")
    r = d.withColumn("rn", F.row_number().over(w.orderBy(T.hash_rank_key("pair", "doc_id"), "doc_id"))).withColumn("n", F.count(F.lit(1)).over(w)).join(F.broadcast(least), "source", "left")
    return r.select("doc_id", F.when(F.col("h") == 1, "heldout").when(F.col("rn") <= F.ceil(F.col("n") * 0.2), "within").otherwise("train").alias("part"))


@query("smp10_stopping_rule", """
WITH s AS (SELECT l_orderkey, sum((l_returnflag = 'R')::INT) AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, s::BIGINT AS s, n, n < 7 AND abs((s + 1) / (n + 2.0) - 0.5) < 0.25 AS go_on FROM s""")
def smp10(t):
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum((F.col("l_returnflag") == "R").cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("go_on", (F.col("n") < 7) & (F.abs((F.col("s") + 1) / (F.col("n") + 2.0) - 0.5) < 0.25))


@query("smp11_permuted", """
WITH a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), b AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('perm|', doc_id)), doc_id) AS r FROM documents)
SELECT doc_id, b.n_chars AS permuted FROM a JOIN b USING (lang, r)""")
def smp11(t):
    return P.permute_within(t.documents.select("doc_id", "lang", "n_chars"), ["lang"], "doc_id", "n_chars", "perm", "permuted").select("doc_id", "permuted")


@query("smp5_deficit_round_robin", """
WITH p AS (SELECT doc_id, lang, source, n_chars % 997 AS parent, sha256(concat('deal|', doc_id)) AS h FROM documents), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY h, doc_id) AS r FROM p) WHERE r = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS k FROM o), w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k, source) AS turn FROM k)
SELECT doc_id, lang, source FROM w ORDER BY (turn - 1) / CASE lang WHEN 'en' THEN 3.0 WHEN 'de' THEN 2.0 ELSE 1.0 END, k, source, turn LIMIT 60""")
def smp5(t):
    """Parents are disjoint by taking one row of each; languages weigh 3, 2 and 1."""
    d = t.documents.select("doc_id", "lang", "source", (F.col("n_chars") % 997).alias("parent"))
    return P.deficit_round_robin(d, "lang", "source", "parent", "doc_id", {"en": 3.0, "de": 2.0}, 60, "deal")


@query("smp12_weighted_draws")
def smp12(t):
    return P.draw_with_replacement(t.customer.select("c_custkey", F.floor(F.greatest("c_acctbal", F.lit(0.0)) * 100).cast("long").alias("w")), "w", "c_custkey", 200, "draw")


@query("smp14_permutation_test", """
WITH d AS (SELECT doc_id AS u, quality AS y, n_chars::DOUBLE AS v FROM documents JOIN labels USING (doc_id)), n AS (SELECT sum(y) AS n1, count(*) AS n, sum(v) AS s, avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0) AS o FROM d),
r AS (SELECT round, v, row_number() OVER (PARTITION BY round ORDER BY sha256(concat('perm|', round, '|', u)), u) AS k FROM d, (SELECT unnest(range(40)) AS round)), p AS (SELECT round, sum(v) AS s1 FROM r, n WHERE k <= n1 GROUP BY round),
a AS (SELECT count(*) AS rounds, count(*) FILTER (WHERE abs(s1 / n1 - (s - s1) / (n - n1)) >= abs(o) - 1e-12) AS at_least, max(o) AS o FROM p, n)
SELECT round(o, 4) AS observed, at_least, rounds, (at_least + 1.0) / (rounds + 1) AS p_value FROM a""")
def smp14(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    return P.permutation_test(d, "doc_id", "quality", "n_chars", 40, "perm").withColumn("observed", F.round("observed", 4))


@query("smp13_cluster_bootstrap")
def smp13(t):
    return P.bootstrap_means(t.orders, "o_custkey", "o_totalprice", 50, "boot").withColumn("mean", F.round("mean", 2))

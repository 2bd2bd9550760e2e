"""Projections, filters, scalar functions and conversation rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import arrays as A
from millrace.functions import text as T
from millrace.operators import windows as W
from millrace.plans.registry import query

BARE = r"""array_to_string(list_filter(string_split_regex(regexp_replace({t}, '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('a', 'an', 'the', '')), ' ')"""


@query("prj1_pool_rows", "SELECT doc_id, lang, source, greatest(length(text) // 4, 1) AS token_hint, concat(lang, '_', source) AS category FROM documents")
def prj1(t):
    return t.documents.select("doc_id", "lang", "source", T.token_hint("text").alias("token_hint"), F.concat_ws("_", "lang", "source").alias("category"))


@query("prj2_rollout_rows", """
SELECT o_orderkey AS task_id, l_linenumber AS turn_index, CAST(l_quantity AS BIGINT) AS token_hint,
  concat(o_orderkey, '#', CASE WHEN o_orderstatus = 'F' THEN 'g' ELSE 'u' END, l_linenumber - 1) AS traj
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'O') AND l_returnflag <> 'R'""")
def prj2(t):
    """Turns of kept attempts, with a trajectory label."""
    j = t.orders.where(F.col("o_orderstatus").isin("F", "O")).join(t.lineitem.where("l_returnflag <> 'R'"), F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "g").otherwise("u")
    return j.select(F.col("o_orderkey").alias("task_id"), F.col("l_linenumber").alias("turn_index"), F.col("l_quantity").cast("long").alias("token_hint"),
                    F.concat(F.col("o_orderkey").cast("string"), F.lit("#"), kind, (F.col("l_linenumber") - 1).cast("string")).alias("traj"))


@query("prj4_prefix_rows", r"""
SELECT conv_id, turn, coalesce((SELECT string_agg(p.role || ': ' || p.text, chr(10) ORDER BY p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn), '') AS prompt,
  text AS response FROM conversations c WHERE role = 'assistant'""")
def prj4(t):
    """One training row for each assistant turn; the prompt is what came before, in order."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array_join(F.collect_list(F.concat(F.col("role"), F.lit(": "), F.col("text"))).over(w), "\n")
    return t.conversations.withColumn("prompt", before).where("role = 'assistant'").select("conv_id", "turn", "prompt", F.col("text").alias("response"))


@query("prj5_event_convert", """
SELECT event_id, event_type AS kind, CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN round(value, 6) END AS metric,
  CASE event_type WHEN 'purchase' THEN 'teacher' ELSE 'student' END AS role FROM events""")
def prj5(t):
    return t.events.select("event_id", F.col("event_type").alias("kind"), F.round(T.finite("value"), 6).alias("metric"), F.when(F.col("event_type") == "purchase", "teacher").otherwise("student").alias("role"))


@query("prj7_pair_sides", """
SELECT o_orderkey AS pair_id, 1 AS side, o_custkey AS state FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_custkey % 4 AS BIGINT) FROM orders""")
def prj7(t):
    return t.orders.select(F.col("o_orderkey").alias("pair_id"), F.posexplode(F.array(F.col("o_custkey").cast("long"), (F.col("o_custkey") % 4).cast("long"))).alias("p", "state")).select("pair_id", (F.col("p") + 1).alias("side"), "state")


@query("flt1_event_eligibility", """
SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE value > 0 AND coalesce(event_type, '') <> '' AND event_type <> 'view'""")
def flt1(t):
    return t.events.where((F.col("value") > 0) & (F.coalesce("event_type", F.lit("")) != "") & (F.col("event_type") != "view")).select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("flt2_sign_partitions", """
SELECT CASE WHEN coalesce(o_totalprice, 0) > 200000 THEN 'positive' WHEN coalesce(o_totalprice, 0) > 100000 THEN 'consequential' ELSE 'agreement' END AS part, count(*) AS n FROM orders GROUP BY 1""")
def flt2(t):
    u = F.coalesce("o_totalprice", F.lit(0.0))
    return t.orders.groupBy(F.when(u > 200000, "positive").when(u > 100000, "consequential").otherwise("agreement").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("flt3_task_filter", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license')")
def flt3(t):
    return t.documents.where(T.contains_any_case("text", "LICENSE")).select("doc_id", "lang")


@query("flt7_quality_or_top_half", """
WITH s AS (SELECT doc_id, quality + toxic AS score FROM labels), c AS (SELECT sum(CASE WHEN score >= 2 THEN 1 ELSE 0 END) AS hits, count(*) AS n FROM s),
r AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM s)
SELECT doc_id, score FROM r, c WHERE CASE WHEN hits > 0 THEN score >= 2 ELSE rn <= greatest(1, n // 2) END""")
def flt7(t):
    """Rows at or over a threshold; if none are, the better half. The half is cut at a value found from counts, not by
    a global sort: rows over the cut value stay, and of those at it as many as fit, by id."""
    s = t.labels.select("doc_id", (F.col("quality") + F.col("toxic")).alias("score"))
    if s.where("score >= 2").limit(1).count():
        return s.where("score >= 2")
    return W.prefix_sums(s, [F.desc("score"), F.col("doc_id")], {"rn": F.lit(1)}).where(F.col("rn") <= max(1, s.count() // 2)).drop("rn")


@query("flt8_conformal_admission", """
WITH cal AS (SELECT length(text) % 97 AS s FROM documents WHERE doc_id % 5 = 0), n AS (SELECT count(*) AS n FROM cal),
p AS (SELECT doc_id, length(text) % 97 AS s FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, round((1 + (SELECT count(*) FROM cal WHERE cal.s <= p.s)) / (n.n + 1.0), 6) AS p_value FROM p, n
WHERE (1 + (SELECT count(*) FROM cal WHERE cal.s <= p.s)) / (n.n + 1.0) >= 0.05""")
def flt8(t):
    """p = (1 + calibration scores at or under s) / (n + 1) >= alpha / 2. Calibration scores are merged to distinct ones
    with running counts, and met by one sweep over sorted scores instead of a row-by-row count."""
    d = t.documents.select("doc_id", (F.length("text") % 97).alias("s"))
    cal = d.where("doc_id % 5 = 0").groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    n = cal.agg(F.sum("c").alias("n"))
    scores = d.where("doc_id % 5 <> 0").groupBy("s").agg(F.lit(0).cast("long").alias("c")).unionByName(cal).groupBy("s").agg(F.sum("c").alias("c"))
    # distinct scores are as few as the score's values
    upto = scores.withColumn("k", F.sum("c").over(Window.orderBy("s"))).select("s", "k").crossJoin(F.broadcast(n))
    p = (F.col("k") + 1) / (F.col("n") + 1.0)
    return d.where("doc_id % 5 <> 0").join(upto, "s").where(p >= 0.05).select("doc_id", F.round(p, 6).alias("p_value"))


@query("flt9_conformal_cutoff", """
WITH r AS (SELECT lang, length(text) AS s, row_number() OVER (PARTITION BY lang ORDER BY length(text)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, s AS cutoff, n FROM r WHERE rn = greatest(CAST(floor(0.1 * (n + 1)) AS BIGINT), 1)""")
def flt9(t):
    return W.order_statistic(t.documents.select("lang", F.length("text").alias("s")), ["lang"], "s", F.floor(F.lit(0.1) * (F.col("n") + 1)), "cutoff")


@query("flt10_pool_audit", r"""
SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS empty_texts, count(*) FILTER (WHERE n_chars <> length(text)) AS bad_counts,
  count(*) FILTER (WHERE lang NOT IN ('en', 'de', 'fr', 'es')) AS bad_lang, count(*) FILTER (WHERE NOT regexp_matches(source, '^src[0-9]+$')) AS bad_source,
  max_by(doc_id, n_chars * 1000000 - doc_id) AS longest_doc FROM documents""")
def flt10(t):
    """All checks of a pool in one pass, with the row that names the worst."""
    bad = lambda c: F.sum(c.cast("long"))
    return t.documents.agg(F.count(F.lit(1)).alias("n"), bad(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty_texts"), bad(F.col("n_chars") != F.length("text")).alias("bad_counts"),
                           bad(~F.col("lang").isin("en", "de", "fr", "es")).alias("bad_lang"), bad(~F.col("source").rlike("^src[0-9]+$")).alias("bad_source"), F.max_by("doc_id", F.col("n_chars") * 1000000 - F.col("doc_id")).alias("longest_doc"))


@query("flt11_count_audit", """
WITH e AS (SELECT l_orderkey AS k, count(*) AS actual FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), x AS (SELECT o_orderkey AS k, o_custkey % 4 AS expected FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(x.k, e.k) AS k, expected, actual FROM x FULL JOIN e ON x.k = e.k WHERE expected IS DISTINCT FROM actual""")
def flt11(t):
    actual = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("actual"))
    expected = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4).alias("expected"))
    return expected.join(actual, "k", "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


@query("flt12_duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def flt12(t):
    return t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("flt13_manifest_errors", """
SELECT o_orderkey AS id, e AS error FROM (SELECT o_orderkey, unnest([CASE WHEN o_totalprice <= 50000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
  CASE WHEN o_custkey % 10 = 3 THEN 'customer' END]) AS e FROM orders) WHERE e IS NOT NULL""")
def flt13(t):
    errors = F.array(F.when(F.col("o_totalprice") <= 50000, "price"), F.when(~F.col("o_orderstatus").isin("F", "O"), "status"), F.when(F.col("o_custkey") % 10 == 3, "customer"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))


@query("flt15_curriculum", """
WITH r AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY turn, conv_id) AS rn, count(*) OVER () AS n FROM conversations),
c AS (SELECT turn AS cut FROM r WHERE rn = greatest(CAST(floor(0.5 * n) AS BIGINT), 1))
SELECT conv_id, turn, role FROM conversations, c WHERE turn <= cut""")
def flt15(t):
    """Rows up to the order statistic int(f * n) of the turn index. Turns take few values, so their counts give it."""
    c = t.conversations.groupBy("turn").agg(F.count(F.lit(1)).alias("n"))
    up = c.withColumn("upto", F.sum("n").over(Window.orderBy("turn"))).crossJoin(F.broadcast(c.agg(F.sum("n").alias("all"))))
    cut = up.where(F.col("upto") >= F.greatest(F.floor(0.5 * F.col("all")), F.lit(1))).agg(F.min("turn").alias("cut"))
    return t.conversations.crossJoin(F.broadcast(cut)).where("turn <= cut").select("conv_id", "turn", "role")


@query("fn_normalize_answer", f"SELECT doc_id, md5({BARE.format(t='lower(text)')}) AS normalized FROM documents")
def fn_normalize(t):
    return t.documents.select("doc_id", F.md5(T.normalize_answer("text")).alias("normalized"))


@query("fn_answer_f1", f"""
WITH p AS (SELECT a.conv_id, a.turn, string_split({BARE.format(t='lower(a.text)')}, ' ') AS x, string_split({BARE.format(t='lower(b.text)')}, ' ') AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
cx AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(x) AS w FROM p) WHERE w <> '' GROUP BY ALL),
cy AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(y) AS w FROM p) WHERE w <> '' GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(cx.n, cy.n)) AS common FROM cx JOIN cy USING (conv_id, turn, w) GROUP BY ALL),
l AS (SELECT conv_id, turn, len(list_filter(x, lambda z: z <> '')) AS nx, len(list_filter(y, lambda z: z <> '')) AS ny FROM p)
SELECT conv_id, turn, round(CASE WHEN nx + ny = 0 THEN 0 ELSE 2.0 * coalesce(common, 0) / (nx + ny) END, 6) AS f1 FROM l LEFT JOIN o USING (conv_id, turn)""")
def fn_f1(t):
    """Token-multiset F1 of a user turn and the reply: counts by word on both sides, one aggregate, no pairwise loop."""
    c = t.conversations
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    p = c.select("conv_id", "turn", "role", "text", F.lead("role").over(nxt).alias("r2"), F.lead("turn").over(nxt).alias("t2"), F.lead("text").over(nxt).alias("y"))
    p = p.where("role = 'user' and r2 = 'assistant' and t2 = turn + 1").select("conv_id", "turn", T.answer_tokens("text").alias("x"), T.answer_tokens("y").alias("y"))
    words = p.select("conv_id", "turn", F.explode_outer(F.concat(F.transform("x", lambda w: F.struct(w.alias("w"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("y", lambda w: F.struct(w.alias("w"), F.lit(0).alias("a"), F.lit(1).alias("b"))))).alias("e"))
    per = words.groupBy("conv_id", "turn", "e.w").agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))
    g = per.groupBy("conv_id", "turn").agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("nx"), F.sum("b").alias("ny"))
    return g.select("conv_id", "turn", F.round(F.when(F.coalesce(F.col("nx") + F.col("ny"), F.lit(0)) == 0, 0.0).otherwise(2.0 * F.col("common") / (F.col("nx") + F.col("ny"))), 6).alias("f1"))


@query("fn_sentences", r"""
SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]\s+|\n'), lambda x: x <> '')) AS n_sentences FROM documents""")
def fn_sentences(t):
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", r"[.!?]\s+|\n"), lambda x: x != "")).cast("long").alias("n_sentences"))


@query("fn_strip_reply", r"""
SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '(?s)```[a-zA-Z0-9_]*\n?', '', 'g'), '(?i)^\s*(answer|prompt|question|response)\s*:\s*', '', 'g'), ' ')) AS body FROM conversations""")
def fn_strip(t):
    return t.conversations.select("conv_id", "turn", F.md5(T.strip_reply("text")).alias("body"))


@query("fn_leading_score", r"""
SELECT event_id, CASE WHEN v BETWEEN 0 AND 5 THEN v END AS score FROM (SELECT event_id, try_cast(regexp_extract(concat(event_id % 8, '.5 ', event_type), '^\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS v FROM events)""")
def fn_score(t):
    return t.events.select("event_id", T.leading_score(F.concat((F.col("event_id") % 8).cast("string"), F.lit(".5 "), "event_type")).alias("score"))


@query("fn_last_two_numbers", r"""
SELECT page_id, CASE WHEN len(n) >= 2 THEN CAST(n[-2] AS BIGINT) END AS a, CASE WHEN len(n) >= 2 THEN CAST(n[-1] AS BIGINT) END AS b FROM (SELECT page_id, regexp_extract_all(url, '(-?[0-9]+)', 1) AS n FROM pages)""")
def fn_numbers(t):
    n = T.last_two_numbers("url")
    return t.pages.select("page_id", n[0].alias("a"), n[1].alias("b"))


@query("fn_mask_volatile", r"""
SELECT event_id, regexp_replace(concat(event_type, ' ', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z'), '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?', '<time>', 'g') AS masked FROM events""")
def fn_mask(t):
    return t.events.select("event_id", T.mask_volatile(F.concat("event_type", F.lit(" "), T.utc_stamp("ts"))).alias("masked"))


@query("fn_line_weights", r"""
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN regexp_matches(l, '[A-Za-z_][A-Za-z0-9_.]*\(') THEN 2.0 WHEN regexp_matches(l, '^\s*[A-Za-z_][A-Za-z0-9_]*\s*=') THEN 1.5 ELSE 1.0 END)::DOUBLE AS weight
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def fn_lines(t):
    return t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("l")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(T.line_weight("l")).alias("weight"))


@query("fn_first_words", r"""
SELECT doc_id, md5(array_to_string(string_split_regex(trim(regexp_replace(text, '<[^>]*>', ' ', 'g')), '\s+')[1:40], ' ')) AS first_words FROM documents""")
def fn_first(t):
    return t.documents.select("doc_id", F.md5(T.first_words("text")).alias("first_words"))


@query("fn_token_bounds", "SELECT conv_id, 256 + sum(64 + strlen(text))::BIGINT AS prompt_bound, sum(CAST(ceil(length(text) / 4.0) AS BIGINT))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def fn_bounds(t):
    return t.conversations.groupBy("conv_id").agg((F.sum(T.prompt_bound("text")) + 256).alias("prompt_bound"), F.sum(T.token_estimate("text")).alias("tokens"))


@query("fn_id_parts", "SELECT doc_id, regexp_replace(concat(lang, '_', source, '_', doc_id), '_[^_]*$', '') AS parent, sha256(concat('fold|', doc_id)) AS digest FROM documents")
def fn_ids(t):
    return t.documents.select("doc_id", T.parent_of(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string"))).alias("parent"), T.hash_rank_key("fold", "doc_id").alias("digest"))


@query("fn_json_fields", "SELECT event_id, len(json_keys(props::JSON)) AS n_keys, list_sort(json_keys(props::JSON))[1] AS first_key FROM events")
def fn_json(t):
    k = F.json_object_keys("props")
    return t.events.select("event_id", F.size(k).cast("long").alias("n_keys"), F.sort_array(k)[0].alias("first_key"))


@query("fn_iso_dates", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, ts > TIMESTAMP '2024-06-01' AS future FROM events")
def fn_dates(t):
    return t.events.select("event_id", T.utc_stamp("ts").alias("stamp"), (F.col("ts") > F.lit("2024-06-01").cast("timestamp")).alias("future"))


@query("vec_unit_norms", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, list_position(embedding, list_max(embedding)) - 1 AS top FROM embeddings""")
def vec_norms(t):
    return t.embeddings.select("vec_id", F.round(A.norm("embedding"), 4).alias("norm"), A.argmax(F.col("embedding")).alias("top"))


@query("vec_centroid_cosine", """
WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY ALL)
SELECT vec_id, e.label, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 4) AS cosine FROM e JOIN c USING (label, k) GROUP BY vec_id, e.label""")
def vec_centroid(t):
    """Cosine to the mean of the own label; centroids are one small row for each label."""
    e = t.embeddings
    c = e.select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    c = c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centroid"))
    return e.join(c, "label").select("vec_id", "label", F.round(A.cosine("embedding", "centroid"), 4).alias("cosine"))


@query("src16_pages", r"""
SELECT page_id, regexp_extract(html, '<title>(?s)(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, len(regexp_extract_all(html, '<li>')) AS n_items,
  contains(lower(html), 'may refer to') AS disambiguation FROM pages""")
def src16(t):
    """Page facts that expressions can read; sources.html has the parser for page texts."""
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return t.pages.select("page_id", F.regexp_extract("html", r"<title>(?s)(.*?)</title>", 1).alias("title"), n("<p>").alias("n_paragraphs"), n("<li>").alias("n_items"), F.contains(F.lower("html"), F.lit("may refer to")).alias("disambiguation"))

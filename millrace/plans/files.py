"""Sources and sinks: tables written in the reference's formats and read back, in the shared folder.

The tables stand in for files: each query writes one, reads it with the operator it is about, and returns what it read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators.windows import shared_folder
from millrace.plans.registry import query
from millrace.sources import readers, sinks


def folder(t, name: str) -> str:
    """A new folder beside the checkpoints."""
    shared_folder(t.documents)
    return f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def pool(t):
    """documents as pool rows."""
    return t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("task_id"), F.col("source").alias("teacher"), (F.col("doc_id") % 7).alias("turn_index"), F.coalesce("text", F.lit("")).alias("prompt"), F.col("lang").alias("response"), F.greatest(F.expr("n_chars div 4"), F.lit(1)).alias("token_hint"))


POOL = "SELECT concat('d', doc_id) AS task_id, {teacher} AS teacher, doc_id % 7 AS turn_index, {prompt} AS prompt, lang AS response, greatest(n_chars // 4, 1) AS token_hint FROM documents"


@query("src1_strict_pool", POOL.format(teacher="source", prompt="md5(coalesce(text, ''))"))
def src1(t):
    """Strict scan: every line has all fields, of the right kind, or the scan fails."""
    path = folder(t, "pool")
    sinks.jsonl(pool(t), path)
    got = readers.strict_jsonl(t.spark, path, readers.POOL, readers._names(readers.POOL))
    return got.select("task_id", "teacher", "turn_index", F.md5("prompt").alias("prompt"), "response", "token_hint")


@query("src1_places", "SELECT count(*) AS n, count(DISTINCT place) AS places, min(place) AS first_place, max(place) AS last_place FROM (SELECT row_number() OVER () - 1 AS place FROM documents)")
def src1_places(t):
    """Lines are numbered densely over files that are split."""
    path = folder(t, "places")
    sinks.jsonl(pool(t).select("task_id"), path)
    got = readers.strict_jsonl(t.spark, path, "task_id string", ["task_id"])
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pool_index").alias("places"), F.min("pool_index").alias("first_place"), F.max("pool_index").alias("last_place"))


@query("src2_pool_files", POOL.format(teacher="source", prompt="md5(coalesce(text, ''))") + " WHERE lang = 'en'")
def src2(t):
    """Many files at once, the teacher from the folder, one domain's verified rows."""
    path = folder(t, "files")
    rows = pool(t).withColumn("domain", F.col("response")).withColumn("verified", F.lit(True)).withColumn("folder", F.col("teacher")).drop("teacher")
    rows.write.partitionBy("folder").json(path)
    # the folder's name is folder=<teacher>
    got = readers.pool(t.spark, f"{path}/*/*.json", "en")
    return got.select("task_id", F.regexp_replace("teacher", "^folder=", "").alias("teacher"), "turn_index", F.md5("prompt").alias("prompt"), "response", "token_hint")


@query("src3_second_source", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def src3(t):
    return readers.extend(t.documents.select(F.col("doc_id").alias("id"), "lang"), t.pages.select(F.col("page_id").alias("id"), "url"))


@query("src4_array_or_lines", "SELECT c_custkey AS id, c_mktsegment AS segment, kind FROM customer, (VALUES ('array'), ('lines')) k(kind)")
def src4(t):
    """One file as a JSON array and as lines: both are read."""
    a, b = folder(t, "array"), folder(t, "lines")
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    each = rows.select(F.to_json(F.struct("id", "segment")).alias("value"))
    whole = each.agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))  # an array is one record by nature
    whole.write.text(a)
    each.write.text(b)
    read = lambda p, k: readers.array_or_lines(t.spark, p, "id long, segment string").withColumn("kind", F.lit(k))
    return read(a, "array").unionByName(read(b, "lines"))


@query("src6_ledger", """
SELECT concat('t', o_custkey) AS task_id, o_orderkey AS attempt_index, o_orderstatus = 'F' AS verified, CAST(floor(o_totalprice) AS BIGINT) AS tokens_spent, CASE WHEN o_orderkey % 3 = 0 THEN 'probe' ELSE 'teacher' END AS purpose, 'v1' AS prompt_version FROM orders""")
def src6(t):
    """Old rows lack purpose and prompt version; a verified row has a demonstration."""
    path = folder(t, "ledger")
    rows = t.orders.select(
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("task_id"), F.lit("luna").alias("teacher"), F.col("o_orderkey").alias("attempt_index"), F.lit(0.7).alias("temperature"), (F.col("o_orderstatus") == "F").alias("verified"),
        F.floor("o_totalprice").cast("long").alias("tokens_spent"), F.when(F.col("o_orderkey") % 3 == 0, "probe").alias("purpose"), F.when(F.col("o_orderstatus") == "F", "shown").alias("demo"))
    sinks.jsonl(rows, path)
    return readers.ledger(t.spark, path).select("task_id", "attempt_index", "verified", "tokens_spent", "purpose", "prompt_version")


@query("src7_tolerant", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 <> 0")
def src7(t):
    """Every fifth line is torn or lacks a field; a resumed run skips it."""
    path = folder(t, "torn")
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))
    torn = F.when(F.col("c_custkey") % 10 == 0, F.substring(line, 1, 9)).when(F.col("c_custkey") % 5 == 0, "{\"id\": 1}").otherwise(line)
    t.customer.select(torn.alias("value")).write.text(path)
    return readers.tolerant_jsonl(t.spark, path, "id long, segment string", ["id", "segment"])


@query("src8_episodes", "SELECT concat('d', doc_id) AS task_id, source AS teacher, doc_id % 7 AS turn_index FROM documents WHERE doc_id % 7 >= 3")
def src8(t):
    """A folder for each teacher, from a turn on."""
    path = folder(t, "episodes")
    pool(t).select("task_id", "turn_index", "teacher").write.partitionBy("teacher").json(path)
    return readers.episodes(t.spark, f"{path}/*/*.json", "task_id string, turn_index long", 3).select("task_id", "teacher", "turn_index")


@query("src10_percent_csv", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 100)::DOUBLE END AS accuracy FROM part")
def src10(t):
    """Percentages become numbers, N/A becomes null."""
    path = folder(t, "percent")
    share = F.when(F.col("p_partkey") % 4 != 0, F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("%")))
    sinks.csv(t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), share.alias("accuracy")), path)
    got = readers.percent_csv(t.spark, path)
    return got.select(F.substring("id", 2, 20).alias("id"), F.col("accuracy").cast("double").alias("accuracy"))


@query("src13_sealed_lookup", "SELECT concat('d', doc_id) AS task_id, md5(coalesce(text, '')) AS body FROM documents WHERE doc_id % 20 = 0")
def src13(t):
    """SNK-7 and SRC-13: a bank with a public index and sealed bodies; a lookup checks each body against its digest."""
    path = folder(t, "bank")
    rows = pool(t).select("task_id", F.col("prompt").alias("body"), F.array().cast("array<string>").alias("deps"))
    sinks.seal(rows, "task_id", "body", "deps", path)
    index, sealed = t.spark.read.parquet(f"{path}/public"), t.spark.read.parquet(f"{path}/sealed")
    wanted = index.where(F.substring("task_id", 2, 20).cast("long") % 20 == 0)
    return readers.sealed(index, sealed, wanted, "task_id", "body", "digest").select("task_id", F.md5("body").alias("body"))


@query("src15_frozen_scan", "SELECT o_orderkey, o_custkey FROM orders")
def src15(t):
    """SNK-4 and SRC-15: written once, read back only if its content is what was written."""
    path = folder(t, "frozen")
    rows = t.orders.select("o_orderkey", "o_custkey")
    sinks.immutable(rows, path)
    sinks.immutable(rows, path)  # the same content again is accepted
    return readers.frozen(t.spark, path, sinks.content_hash(rows))


@query("snk3_versions", "SELECT r_regionkey AS id, version FROM region, (VALUES (1), (2)) v(version) WHERE version = 2 OR r_regionkey < 3")
def snk3(t):
    """A new version beside the old one: readers see the one they are told."""
    path = folder(t, "versions")
    one = sinks.replace(t.region.where("r_regionkey < 3").select(F.col("r_regionkey").alias("id")), path, "1")
    two = sinks.replace(t.region.select(F.col("r_regionkey").alias("id")), path, "2")
    return t.spark.read.parquet(one).withColumn("version", F.lit(1)).unionByName(t.spark.read.parquet(two).withColumn("version", F.lit(2)))


@query("snk5_chained_journal", """
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, concat('{"event_id":"', event_id, '","event_type":"', event_type, '"}') AS own FROM events),
c AS (SELECT user_id, event_id, k, '' AS previous_hash, sha256(own) AS event_hash FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, c.event_hash, sha256(concat(c.event_hash, e.own)) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, event_id, previous_hash, event_hash FROM c""")
def snk5(t):
    """A user's events as a journal, each row's hash over the hash before it."""
    return sinks.chained(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", ["event_id", "event_type"]).select("user_id", "event_id", "previous_hash", "event_hash")


@query("snk6_manifest", "SELECT doc_id, lang, n_chars AS length FROM documents WHERE n_chars > 500")
def snk6(t):
    """Private columns go, named scores stay."""
    took = t.documents.where("n_chars > 500").select("doc_id", "lang", F.col("n_chars").alias("_length"), F.col("source").alias("_where"))
    return sinks.manifest(took, ["_length"])[0]


@query("snk6_manifest_audit", "SELECT count(*) AS n, round(avg(n_chars), 6) AS mean_length FROM documents WHERE n_chars > 500")
def snk6_audit(t):
    took = t.documents.where("n_chars > 500").select("doc_id", F.col("n_chars").alias("_length"))
    return sinks.manifest(took, ["_length"])[1].withColumn("mean_length", F.round("mean_length", 6))


@query("snk7_cycles", """
WITH RECURSIVE e AS (SELECT c_custkey AS x, CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 + (c_custkey + 1) % 3 ELSE c_custkey + 200 END AS d FROM customer), n AS (SELECT x, d FROM e WHERE d IN (SELECT x FROM e)),
r AS (SELECT x AS origin, d AS goal FROM n UNION SELECT r.origin, n.d FROM r JOIN n ON r.goal = n.x) SELECT DISTINCT origin AS id FROM r WHERE origin = goal OR goal IN (SELECT origin FROM r WHERE origin = goal)""")
def snk7(t):
    """Dependencies that form cycles of three, and chains that end."""
    k = F.col("c_custkey")
    d = t.customer.select(k.alias("id"), F.array(F.when(k % 10 < 3, k - k % 10 + (k + 1) % 3).otherwise(k + 200)).alias("deps"))
    return sinks.cyclic(d, "id", "deps")

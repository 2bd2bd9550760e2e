"""URL rules as a sort-merge range join, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased. Path: from there up to '?', '#' or the end.
    Null and no '://': both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def key_of(host: Column) -> Column:
    """Canonical key: the labels reversed, each ended by '.'. A host and all its subdomains are the keys that begin with it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """All columns of `pages` under `page`, with host, path, rule and verdict.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the path starts with the rule's path; the
    longest wins (by length of host and path, then by the longer host, then by text). The keys under a rule's host are
    one interval, and intervals nest. Rules and urls are sorted by key together; a rule's start carries the stack of
    rules active from there, its end the stack below it, and each url takes the last stack before it. The sweep is
    dealt by top label and a salt: a hot host, or a top label with most rows, spreads over all tasks. Rules go to
    every salt, so their number times `salts` is what is copied. Nulls and urls without '://' have an empty host,
    which no rule fits. Repeated rows are judged each; rules with a null or empty host are dropped.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_path(F.col(url).cast("string"))
    r = (
        rules.where(F.length("host") > 0).select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
        .groupBy("host").agg(F.collect_list(F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("deep"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("own"))
        .withColumn("key", key_of(F.col("host")))
    )
    labels = F.split("host", r"\.")
    # The rules that stay active when this one ends: those of the hosts above it.
    up = r.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(F.reverse(labels), F.lit(1), i), "."), F.lit(".")))).alias("above"))
    up = up.where("above <> key").join(r.select(F.col("key").alias("above"), F.col("own").alias("theirs")), "above")
    up = up.groupBy("key").agg(F.flatten(F.collect_list("theirs")).alias("below"))
    r = r.join(up, "key", "left").withColumn("below", F.coalesce("below", F.slice("own", 1, 0)))
    opens = r.select("key", F.lit(0).alias("kind"), F.concat("below", "own").alias("stack"))
    closes = r.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("kind"), F.col("below").alias("stack"))
    top = lambda: F.substring_index(F.regexp_replace("key", "/$", "."), ".", 1)
    marks = opens.union(closes).withColumn("top", top()).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", key_of(F.col("host"))).withColumn("top", top()).withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(salts)).cast("int")).withColumn("kind", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("top", "salt").orderBy("key", "kind")
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter(F.coalesce("active", F.lit(None)), lambda x: F.startswith(F.col("path"), x["path"]))
    best = F.array_max(fits)
    return swept.select("page", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))

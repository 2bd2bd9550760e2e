"""Sinks: compact JSON lines, versioned replacement, immutable writes, manifests, sealed banks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """Null fields are left out; an append is committed whole."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def content_hash(df: DataFrame) -> str:
    """Order-free digest of a table: rows are hashed where they are and summed."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    r = df.agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return f"{r.n}:{r.s or 0}"


def replace(df: DataFrame, root: str, version: str) -> str:
    """Write a new version beside the old ones and return its folder; readers take the version they are told."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def immutable(df: DataFrame, path: str) -> bool:
    """Create a table, or accept one that is there with the same content; anything else is an error. True if written."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if content_hash(spark.read.parquet(path)) != content_hash(df):
            raise ValueError(f"{path} is there with other content")
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def manifest(selected: DataFrame, scores: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without private columns but with the named scores, an audit row)."""
    public = [c for c in selected.columns if not c.startswith("_")]
    audit = selected.agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(f"mean_{s.lstrip('_')}") for s in scores])
    return selected.select(*public, *[F.col(s).alias(s.lstrip("_")) for s in scores if s not in public]), audit


def cyclic(records: DataFrame, ident: str, dependencies: str) -> DataFrame:
    """Ids that lie on, or depend on, a cycle: what is left when ids without open dependencies are taken away in turn,
    until none is. Dependencies on ids that aren't there are met; null ids are left out.

    An id with one open dependency stands and falls with it, so what depends on that id is led on to its dependency in
    every round: rounds grow with the logarithm of such a chain's length, and with the layers of ids that have several.
    """
    from millrace.operators.windows import shared_folder

    shared_folder(records)
    left = records.select(F.col(ident).alias("x"), F.explode_outer(dependencies).alias("d")).where("x is not null").distinct().checkpoint(eager=True)
    n = left.select("x").distinct().count()
    while n:
        stuck = left.join(left.select(F.col("x").alias("d")).distinct(), "d", "left_semi").select("x", "d")
        one = stuck.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("on")).where("n = 1").select(F.col("x").alias("d"), "on")
        # every id that was stuck still is: an edge of the next round stands for a path of this one
        left = stuck.join(one, "d", "left").select("x", F.coalesce("on", "d").alias("d")).distinct().checkpoint(eager=True)
        m = left.select("x").distinct().count()
        if m == n:
            break
        n = m
    return left.select(F.col("x").alias(ident)).distinct()


def seal(records: DataFrame, ident: str, body: str, dependencies: str, root: str) -> None:
    """Public index with digests and private payloads as two tables; cycles and existing banks are refused."""
    if cyclic(records, ident, dependencies).limit(1).count():
        raise ValueError("dependencies form a cycle")
    records.select(*[c for c in records.columns if c != body], F.sha2(body, 256).alias("digest")).write.mode("errorifexists").parquet(f"{root}/public")
    records.select(ident, body).write.mode("errorifexists").parquet(f"{root}/sealed")


def chained(df: DataFrame, journal: str, order: str, columns: list[str]) -> DataFrame:
    """Rows of journals with previous_hash and event_hash, the SHA-256 of the row before's hash and the row's own columns
    (canonical JSON of strings; nulls as they are): what an appended journal records. `order` must be total in a journal.

    A chain is sequential by nature: a journal is read in order by one task, of which only the last hash is in memory.
    """
    import hashlib
    import json

    import pyarrow as pa

    names = df.columns
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"})
    src = df.withColumn("__own", text).repartition(journal).sortWithinPartitions(journal, order)
    at, own = names.index(journal), len(names)

    def run(batches):
        key, before = None, ""
        for b in batches:
            previous, mine = [], []
            for k, t in zip(b.column(at).to_pylist(), b.column(own).to_pylist(), strict=True):
                if k != key or not mine and not previous and key is None:
                    key, before = k, ""
                previous.append(before)
                before = hashlib.sha256((before + json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)).encode()).hexdigest()
                mine.append(before)
            yield pa.RecordBatch.from_arrays([*b.columns[:own], pa.array(previous, pa.string()), pa.array(mine, pa.string())], names=[*names, "previous_hash", "event_hash"])

    return src.mapInArrow(run, df.schema.add("previous_hash", "string").add("event_hash", "string"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table; more rows than a report can hold are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def latex(df: DataFrame, most: int = 1000) -> str:
    """The same as rows of a LaTeX table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "--" if v is None else str(v).replace("_", "\\_").replace("%", "\\%").replace("&", "\\&")
    return "\n".join(" & ".join(cell(v) for v in r) + r" \\" for r in rows)


def csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; nulls are N/A."""
    df.write.mode("errorifexists").option("header", True).option("nullValue", "N/A").csv(path)

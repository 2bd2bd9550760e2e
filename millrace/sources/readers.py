"""Scans: strict and tolerant JSON lines, score files, percent tables, chained journals, matrices, pages."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POOL = "task_id string, teacher string, turn_index long, prompt string, response string, token_hint long"
LEDGER = "task_id string, teacher string, attempt_index long, temperature double, verified boolean, tokens_spent long, purpose string, timestamp string, prompt_version string, source_id string, demo string"
EVENT = (
    "benchmark string, split string, task_id string, state_id string, state_hash string, student_checkpoint string, student_continuation string, teacher_model string, teacher_continuation string, "
    "student_branch_outcomes array<struct<kind:string,metric:string,value:double,k:int,n_success:int>>, teacher_branch_outcomes array<struct<kind:string,metric:string,value:double,k:int,n_success:int>>, "
    "student_output_tokens long, teacher_output_tokens long, fingerprint_version string, fingerprint_path string, atom_dictionary_version string, atom_loading array<double>, provenance map<string,string>, state_text string"
)


def _names(schema: str) -> list[str]:
    return [f.name for f in StructType.fromDDL(schema)]


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): non-blank lines with their place, from 1. Large files are split: a line's number is its place in
    its split and the lines of the splits before it, which are one row each."""
    from millrace.operators.windows import shared_folder

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__from"), F.monotonically_increasing_id().alias("__i"), "value")
    shared_folder(raw)
    raw = raw.checkpoint(eager=True)
    per = raw.groupBy("file", "__from").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("file").orderBy("__from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("file", "__from", "__first", before.alias("__before"))
    # the rows of a split have consecutive numbers
    placed = raw.join(F.broadcast(per), ["file", "__from"]).select("file", (F.col("__before") + F.col("__i") - F.col("__first") + 1).alias("line"), "value")
    return placed.where("trim(value) <> ''")


def strict_jsonl(spark: SparkSession, path: str | list[str], schema: str, required: list[str], defaults: dict | None = None, closed: bool = False) -> DataFrame:
    """Rows with pool_index (by file, then line). A line that isn't JSON, lacks a required field, holds one of the wrong
    JSON type (true is no number), or, if `closed`, has a field the schema doesn't know, fails the scan and names
    file:line. Missing optional fields take their defaults."""
    src = lines(spark, path).withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("keys", F.json_object_keys("value"))
    kinds = {f.name: f.dataType.typeName() for f in StructType.fromDDL(schema)}
    bad = F.when(F.col("keys").isNull(), "not an object")
    for name in required:
        bad = bad.when(F.col(f"r.{name}").isNull(), f"missing or ill-typed: {name}")
    for name, kind in kinds.items():
        raw = F.get_json_object("value", f"$.{name}")
        if kind in ("long", "integer", "double"):
            bad = bad.when(raw.isin("true", "false") | (raw.isNotNull() & F.col(f"r.{name}").isNull()), f"not a number: {name}")
    if closed:
        bad = bad.when(F.size(F.array_except("keys", F.array(*[F.lit(n) for n in kinds]))) > 0, "unknown field")
    where = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "))
    checked = src.withColumn("r", F.when(bad.isNotNull(), F.raise_error(F.concat(where, bad)).cast(src.schema["r"].dataType)).otherwise(F.col("r")))
    cols = [F.coalesce(F.col(f"r.{n}"), F.lit((defaults or {}).get(n))).alias(n) if n in (defaults or {}) else F.col(f"r.{n}").alias(n) for n in kinds]
    return with_index(checked.select("file", "line", *cols))


def with_index(df: DataFrame) -> DataFrame:
    """pool_index: dense places by (file, line), from counts by file, so that no task sees all rows."""
    per = df.groupBy("file").agg(F.max("line").alias("n"))
    before = per.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(F.broadcast(before.select("file", "base")), "file").withColumn("pool_index", F.col("base") + F.col("line") - 1).drop("base")


def tolerant_jsonl(spark: SparkSession, path: str | list[str], schema: str, required: list[str]) -> DataFrame:
    """Rows of the lines that parse and have the required fields; the rest is skipped, as a resumed run wants."""
    r = lines(spark, path).withColumn("r", F.from_json("value", schema))
    return r.where(" and ".join(f"r.{n} is not null" for n in required)).select(*[F.col(f"r.{n}").alias(n) for n in _names(schema)])


def array_or_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array or JSON lines; the mark that its first line with text begins with decides."""
    first = spark.read.text(path).where("trim(value) <> ''").select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    return spark.read.schema(schema).option("multiLine", bool(first and first.c == "[")).json(path)


def pool(spark: SparkSession, paths: str | list[str], domain: str | None = None) -> DataFrame:
    """Pool rows of many files; teacher, where absent, is the folder's name; optionally one domain's verified rows."""
    df = spark.read.schema(POOL + ", domain string, verified boolean").json(paths).withColumn("file", F.col("_metadata.file_path"))
    df = df.withColumn("teacher", F.coalesce("teacher", F.element_at(F.split("file", "/"), -2))).drop("file")
    return df if domain is None else df.where((F.col("domain") == domain) & F.col("verified"))


def extend(base: DataFrame, more: DataFrame | None) -> DataFrame:
    """A second source, if any, under the same columns."""
    return base if more is None else base.unionByName(more, allowMissingColumns=True)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger rows with the defaults of older ones; no file gives no rows. A row that is verified without a demonstration, or
    has one without being verified, fails the scan, as do negative attempts and costs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], LEDGER)
    got = spark.read.schema(LEDGER).json(path).fillna({"purpose": "teacher", "prompt_version": "v1"})
    bad = F.when(F.col("verified") != F.col("demo").isNotNull(), "verified and demo disagree").when((F.col("attempt_index") < 0) | (F.col("tokens_spent") < 0), "negative count")
    return got.withColumn("task_id", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("ledger row of "), F.coalesce("task_id", F.lit("?")), F.lit(": "), bad))).otherwise(F.col("task_id")))


def episodes(spark: SparkSession, files: str, schema: str, least_turn: int = 0) -> DataFrame:
    """Rows of <teacher>/train.jsonl or the like (`files` is a pattern), the teacher from the file's folder, which may be
    named teacher=<teacher>; from a turn on. `schema` has turn_index; rows without one are left out."""
    got = spark.read.schema(schema).option("basePath", files.split("/*")[0]).json(files)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return got.withColumn("teacher", F.url_decode(F.regexp_replace(folder, "^teacher=", ""))).where(F.col("turn_index") >= least_turn)


def frozen(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """A table whose content is bound by a digest (see sinks.content_hash); other content is an error."""
    from millrace.sources.sinks import content_hash

    got = spark.read.parquet(path)
    if content_hash(got) != digest:
        raise ValueError(f"{path} is not what the manifest says")
    return got


def score_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summaries, failures) of files whose first line is a summary and whose others are failed items."""
    src = lines(spark, path).withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    category = F.regexp_extract("file", r"([^/]+?)(?:_score)?\.jsonl?$", 1).alias("category")
    head = src.where("n = 1").select(category, F.from_json("value", "accuracy double, correct_count long, total_count long").alias("h")).select("category", "h.*")
    tail = src.where("n > 1").select(category, F.get_json_object("value", "$.id").alias("id"))
    return head, tail


def percent_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose percentages become numbers and whose N/A becomes null."""
    df = spark.read.option("header", True).option("nullValue", "N/A").csv(path)
    num = lambda c: F.coalesce(F.regexp_replace(F.col(f"`{c}`"), "%$", "").try_cast("double").cast("string"), F.col(f"`{c}`"))
    return df.select(*[num(c).alias(c) for c in df.columns])


def canonical(value: dict) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def chain(spark: SparkSession, path: str, self_hash: str = "event_hash", repair: bool = False) -> DataFrame:
    """(file, line, value, sequence, error) of hash-chained journals: the sequence counts up, previous_hash is the line
    before's hash, and the hash is the SHA-256 of the line without it. An unterminated last line is an error, or is left
    out if `repair`. Hashes are taken in Arrow batches; the chain is a window by file."""
    import hashlib

    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))
    cut = raw.withColumn("torn", ~F.col("body").endswith("\n") & (F.length("body") > 0)).select("file", "torn", F.posexplode(F.split("body", "\n")).alias("line", "value"))
    w = Window.partitionBy("file")
    rows = cut.where("value <> ''").withColumn("last", F.col("line") == F.max("line").over(w))
    if repair:
        rows = rows.where("not (torn and last)")

    @F.pandas_udf("sequence long, previous string, own string, good boolean")
    def check(s):
        import pandas as pd

        out = []
        for v in s:
            try:
                d = json.loads(v)
                own = d.pop(self_hash, None)
                out.append((d.get("sequence"), d.get("previous_hash"), own, own == hashlib.sha256(canonical(d)).hexdigest()))
            except (ValueError, AttributeError):
                out.append((None, None, None, False))
        return pd.DataFrame(out, columns=["sequence", "previous", "own", "good"])

    o = w.orderBy("line")
    got = rows.withColumn("c", check("value")).withColumn("before", F.lag("c.own").over(o)).withColumn("at", F.row_number().over(o) - 1)
    error = F.when(F.col("torn") & F.col("last"), "torn tail").when(~F.coalesce("c.good", F.lit(False)), "hash").when(F.col("c.sequence") != F.col("at"), "sequence").when(~F.coalesce("before", F.lit("")).eqNullSafe(F.coalesce("c.previous", F.lit(""))), "previous hash")
    return got.select("file", "line", "value", F.col("c.sequence").alias("sequence"), error.alias("error"))


def matrix(spark: SparkSession, path: str, keys: str, values: str, version: str | None = None) -> DataFrame:
    """(key, vector) of .npz files; files of another version fail the scan. Object arrays aren't loaded."""

    def run(batches):
        for b in batches:
            for body in b.column(0):
                with np.load(io.BytesIO(body.as_py()), allow_pickle=False) as z:
                    if version is not None and str(z["version"]) != version:
                        raise ValueError(f"matrix version {z['version']}, wanted {version}")
                    yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in z[keys]]), pa.array([list(map(float, v)) for v in z[values]], pa.list_(pa.float64()))], names=["key", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, vector array<double>")


def manifest_scan(rows: DataFrame, manifest: DataFrame, ident: str, order: str) -> DataFrame:
    """The rows a frozen manifest names, in its order; an id it names that isn't there fails the scan."""
    j = manifest.select(ident, order).join(rows, ident, "left").withColumn("__here", F.lit(True))
    probe = [c for c in rows.columns if c != ident][0]
    return j.withColumn(probe, F.when(F.col(probe).isNull(), F.raise_error(F.concat(F.lit("not in source: "), F.col(ident).cast("string"))).cast(rows.schema[probe].dataType)).otherwise(F.col(probe))).drop("__here").orderBy(order)


def sealed(index: DataFrame, payloads: DataFrame, chosen: DataFrame, ident: str, body: str, digest: str) -> DataFrame:
    """Payloads of chosen requests only, digests checked; the payload table is joined last, on the chosen ids."""
    want = index.join(chosen.select(ident), ident, "left_semi").select(ident, digest)
    got = want.join(payloads.select(ident, body), ident)
    return got.withColumn(body, F.when(F.sha2(body, 256) == F.col(digest), F.col(body)).otherwise(F.raise_error(F.concat(F.lit("digest: "), F.col(ident))).cast("string")))

"""Corpus pipeline: toxicity, SimHash near-duplicates, repeated passages, benchmark items, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common, contamination, packing, queries, simhash, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose highest window scores under 0.5, with the columns of documents."""
    names = docs.columns
    text = F.col("text").alias("__text")
    net = queries.toxic_net(spark, sf_dir, docs)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)], text)
    scored = toxicity.score(rows.withColumn("__doc", F.lit(0)), net, doc_id="__doc", text="__text", keep=tuple(f"__{i}" for i in range(len(names))))
    return scored.where("score < 0.5").select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(names)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.dedup(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Paragraphs stay in the first document that has them."""
    return substring.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items stay."""
    return contamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("passages", drop_repeated_passages), ("benchmark", drop_contaminated), ("packing", pack)]

#: Scores, fingerprints and token ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread by the next. What a stage wrote goes once the
    next one is written; the last one's files are what the result is read from."""
    import uuid

    folder, before = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs

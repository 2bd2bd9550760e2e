"""Helpers shared by the training-data operators: token rules, Arrow scans, exact blocks of
pairs within a group, connected components, and lineage cuts in the shared folder.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside a Python worker, so that memory follows neither the table nor the Arrow batch.
CHUNK_ROWS = 256
#: Bytes of text handled at once inside a Python worker (a longer document is a chunk of its own).
CHUNK_BYTES = 1 << 20


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased (bytes.lower and bytes.split keep to ASCII); null is empty."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def chunks(texts: list, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """[start, end) ranges of at most `rows` texts and about `size` characters."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (i - start >= rows or total + n > size):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def scan(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with an empty input giving an empty output."""
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32(doc_id as text) mod folds; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local mode a folder is made where it is unset: executors elsewhere
    don't see the driver's disk, and the job fails at once instead."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lineage ends here and a lost executor costs nothing above it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def block_pairs(members: DataFrame, key: list[str], ident: str, block: int = 2048) -> DataFrame:
    """Deal the members of each key into blocks so that every pair of members meets in one (key, p, q) group.

    A key with n members gets ceil(n / block) blocks; each member goes to the groups of its block with every
    other, so a group holds 2 * block members or so however large the key is and no pair is lost. Keys of one
    member are dropped. The count per key is taken with map-side partial sums.
    """
    n = members.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    b = F.col("__blocks")
    mine = F.pmod(F.xxhash64(F.col(ident), F.lit(7)), b)
    dealt = members.join(n, key).withColumn("__blocks", F.ceil(F.col("__n") / F.lit(block)).cast("long")).withColumn("__mine", mine)
    return (
        dealt.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), b - 1)))
        .withColumn("__p", F.least("__mine", "__other")).withColumn("__q", F.greatest("__mine", "__other"))
        .drop("__n", "__blocks", "__other")
    )


def with_last(items):
    """(is it the last, item)."""
    before = None
    for x in items:
        if before is not None:
            yield False, before
        before = x
    if before is not None:
        yield True, before


def by_group(df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b) longs that `fn` makes of each group of `keys` (not null), given as arrays by column.

    Rows are dealt and sorted by the keys and read as a stream, so that very many small groups cost little and one
    group at a time is in memory; groups must be bounded, as those of block_pairs are.
    """
    names = df.columns

    def run(batches):
        held: dict | None = None
        for b in batches:
            cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
            n = len(cols[names[0]])
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            edges = np.append(0, np.flatnonzero(new))
            held = {c: cols[c][edges[-1] :] for c in names}
            yield from made([{c: cols[c][i:j] for c in names} for i, j in zip(edges, edges[1:], strict=False)])
        if held is not None:
            yield from made([held])

    def made(groups):
        got = [fn(g) for g in groups]
        if got:
            a, b = (np.concatenate([x[i] for x in got]).astype(np.int64) for i in (0, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def merge_labels(labels: np.ndarray, hit: np.ndarray) -> None:
    """Union the classes that `hit` indexes, keeping the smallest label."""
    own = np.unique(labels[hit])
    if len(own) > 1:
        labels[np.isin(labels, own[1:])] = own[0]


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Connected components of long nodes: (node, component), component the smallest node reachable.

    Edges point from the larger node to the smaller. A round keeps each node's smallest parent, links its other
    parents to that one, and lets every parent jump to its own. Aggregates combine map-side; a node of very many
    neighbours is a parent in most of its edges, where the join has one row on the other side and can be split.
    Each round is cut in the shared folder. Nodes without edges aren't returned; null ends and loops are dropped.
    """
    e = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct()
    )
    for _ in range(rounds):
        m = e.groupBy("child").agg(F.min("parent").alias("p"))
        both = F.explode(F.array(F.struct(F.col("child").alias("c"), F.col("p").alias("p")), F.struct(F.col("parent").alias("c"), F.col("p").alias("p"))))
        hooked = e.join(m, "child").select(both.alias("x")).select(F.col("x.c").alias("child"), F.col("x.p").alias("parent")).where("child > parent").distinct()
        up = m.select(F.col("child").alias("k"), F.col("p").alias("up"))
        e = cut(hooked.join(up, hooked.parent == up.k, "left").select("child", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")))
        s = e.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.max("moved").alias("moved")).agg(F.max("n").alias("n"), F.max("moved").alias("moved")).first()
        e = e.select("child", "parent").distinct()
        if s.n is None or (s.n == 1 and not s.moved):
            return e.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(e.select("parent", "parent").distinct())
    raise RuntimeError(f"components: not settled after {rounds} rounds")

"""SimHash near-duplicates by vantage-point trees over Hamming distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common as C


def shingle_hashes(tokens: list[bytes], width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words joined by spaces; fewer words: of the whole sequence; none: empty."""
    if not tokens:
        return np.empty(0, np.uint64)
    whole = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(n + 1) - 1
    starts = ends - n
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(whole[i:j], 42) for i, j in zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(tokens) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hashes: 0."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and __fp (the 64 bits as a long) of every row; null or blank texts have fingerprint 0."""
    src = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = src.drop("__text").schema
    names = list(keep)

    def run(batches):
        for b in batches:
            texts = b.column("__text")
            fps = np.fromiter((fingerprint(shingle_hashes(C.words(t.as_py()), width)) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(fps)], names=[*names, "__fp"])

    return src.mapInArrow(run, schema.add("__fp", "long"))


def build_tree(sample: np.ndarray, leaves: int, radius: int) -> list[tuple]:
    """A vantage-point tree over a bounded sample, as nodes (vantage, mu, inner, outer) or (leaf,).

    Of eight candidates the vantage with the widest spread of distances is taken and split at its median. A node
    stays a leaf if it has its share of the sample, or if no split would spare most queries one side.
    """
    nodes: list[tuple] = []
    least = max(2, len(sample) // max(1, leaves))
    count = 0
    rng = np.random.default_rng(5)

    def grow(points: np.ndarray) -> int:
        nonlocal count
        me = len(nodes)
        nodes.append(())
        best = None
        if len(points) > least and leaves > 1:
            for v in points[rng.integers(0, len(points), 8)]:
                d = np.bitwise_count(points ^ v).astype(np.int64)
                mu = int(np.median(d))
                if mu == d.max():
                    mu -= 1
                both = float(np.mean((d <= mu + radius) & (d > mu - radius)))
                if 0 < (d <= mu).sum() < len(d) and (best is None or both < best[0]):
                    best = (both, v, mu, d)
        if best is None or best[0] > 0.8:
            nodes[me] = (count,)
            count += 1
        else:
            _, v, mu, d = best
            inner = grow(points[d <= mu])
            nodes[me] = (int(v), mu, inner, grow(points[d > mu]))
        return me

    grow(sample)
    return nodes


def route(nodes: list[tuple], points: np.ndarray, radius: int, own: np.ndarray | None = None):
    """Yields (leaf, indexes at home there, indexes that only query it) of points, of which those that are not `own` only
    query. A query goes to both sides of a split if the triangle bound |d(query, vantage) - mu| lets a point within
    `radius` lie on either."""
    own = np.ones(len(points), bool) if own is None else own
    stack = [(0, np.flatnonzero(own), np.flatnonzero(~own))]
    while stack:
        at, home, ask = stack.pop()
        if not len(home) and not len(ask):
            continue
        node = nodes[at]
        if len(node) == 1:
            yield node[0], home, ask
            continue
        v, mu, inner, outer = node
        d = np.bitwise_count(points[home] ^ np.uint64(v)).astype(np.int64)
        e = np.bitwise_count(points[ask] ^ np.uint64(v)).astype(np.int64)
        ins = d <= mu
        stack.append((inner, home[ins], np.concatenate([home[~ins & (d <= mu + radius)], ask[e <= mu + radius]])))
        stack.append((outer, home[~ins], np.concatenate([home[ins & (d > mu - radius)], ask[e > mu - radius]])))


def forest(group: dict, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links between the points at home and the points that ask, as a spanning forest (classes of up to a few
    thousand points; distances are taken 128 queries at a time)."""
    points = np.unique(group["__fp"]).view(np.uint64)
    home = np.unique(group["__fp"][group["__home"].astype(bool)]).view(np.uint64)
    place = np.searchsorted(points.view(np.int64), home.view(np.int64))
    labels = np.arange(len(points))
    for i in range(0, len(points), 128):
        near = np.bitwise_count(points[i : i + 128, None] ^ home[None, :]) <= radius
        for j in np.flatnonzero(near.sum(1)):
            C.merge_labels(labels, np.append(place[near[j]], i + j))
    linked = np.flatnonzero(labels != np.arange(len(points)))
    return points[linked].view(np.int64), points[labels[linked]].view(np.int64)


def links(classes: DataFrame, radius: int = 2, leaf_rows: int = 2048, sample_rows: int = 20000, max_leaves: int = 4096, block: int = 2048, levels: int = 4) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints `__fp` within `radius` bits.

    A tree is built on the driver from at most 2 * `sample_rows` fingerprints, chosen by hash; then, level by level, leaves
    that still hold over four times `leaf_rows` get trees of their own, at most `max_leaves` of them at once and from at
    most 1024 of their fingerprints each. Trees decide only where points meet, not what is found: every fingerprint is at
    home in one leaf and asks in each leaf the triangle bound leaves open. Leaves that no split helps are dealt into blocks,
    so that dense ones aren't one task.
    """
    spark = classes.sparkSession
    classes = classes.select("__fp")
    schema = "__leaf long, __home boolean, __fp long"
    n = classes.count()
    take = max(1, -(-n // sample_rows))
    rows = classes.where(F.pmod(F.xxhash64("__fp"), F.lit(take)) == 0).limit(2 * sample_rows).collect()
    sample = np.unique(np.array([r[0] for r in rows], np.int64)).view(np.uint64)
    trees = {0: build_tree(sample, min(max_leaves, -(-n // leaf_rows)), radius)}
    wide = max_leaves

    def deal(batches, trees, wide):
        """Points of a leaf that has a tree go on to that tree's leaves; others stay."""
        for b in batches:
            leaf, home = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            points = b.column(2).to_numpy().view(np.uint64)
            for at in np.unique(leaf):
                mine = np.flatnonzero(leaf == at)
                parts = route(trees[at], points[mine], radius, home[mine]) if at in trees else [(0, np.flatnonzero(home[mine]), np.flatnonzero(~home[mine]))]
                for sub, own, ask in parts:
                    for idx, here in ((own, True), (ask, False)):
                        if len(idx):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(idx), at * wide + sub)), pa.array(np.full(len(idx), here)), pa.array(points[mine[idx]].view(np.int64))], names=["__leaf", "__home", "__fp"])

    placed = classes.select(F.lit(0).cast("long").alias("__leaf"), F.lit(True).alias("__home"), "__fp")
    for level in range(levels):
        sent = spark.sparkContext.broadcast(trees)
        placed = C.cut(placed.mapInArrow(lambda batches, sent=sent, wide=wide: deal(batches, sent.value, wide), schema))
        if level + 1 == levels or n <= 4 * leaf_rows:
            break
        # the largest leaves, one row each
        big = {r[0]: r.n for r in placed.where("__home").groupBy("__leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * leaf_rows).orderBy(F.desc("n"), "__leaf").limit(max_leaves).collect()}
        if not big:
            break
        share = spark.createDataFrame([(k, 512.0 / v) for k, v in big.items()], "__leaf long, share double")
        chosen = placed.where("__home").join(F.broadcast(share), "__leaf").where(F.pmod(F.xxhash64("__fp", F.lit(level)), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("__leaf", "__fp")
        wide = 64
        trees, own = {}, {}
        for r in chosen.collect():
            own.setdefault(r[0], []).append(r[1])
        for k, points in own.items():
            tree = build_tree(np.unique(np.array(points[:1024], np.int64)).view(np.uint64), min(wide, -(-big[k] // leaf_rows)), radius)
            if len(tree) > 1:
                trees[k] = tree
        if not trees:
            break

    per = placed.groupBy("__leaf").agg(
        F.ceil(F.sum(F.col("__home").cast("long")) / block).cast("int").alias("__hb"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__qb"))
    placed = placed.join(per, "__leaf")
    pick = lambda n, salt: F.pmod(F.xxhash64("__fp", F.lit(salt)), F.greatest(n, F.lit(1))).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    asks = placed.select("__leaf", "__fp", F.lit(False).alias("__home"), pick(F.col("__qb"), 1).alias("__q"), F.explode(span(F.col("__hb"))).alias("__h"))
    homes = placed.where("__home").select("__leaf", "__fp", F.lit(True).alias("__home"), F.explode(span(F.col("__qb"))).alias("__q"), pick(F.col("__hb"), 2).alias("__h"))
    return C.by_group(asks.unionByName(homes), ["__leaf", "__q", "__h"], lambda g: forest(g, radius))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, width: int = 3, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Documents link if their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id
    reachable over links, itself included. Exact: the tree only prunes by the triangle bound.
    Null and blank texts have fingerprint 0 and link like any other. Repeated rows each give a row. Rows with a null
    doc_id carry links but no name: their component is the smallest known id, null if there is none. An empty table
    gives an empty result. Other columns are neither read nor returned.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__t"))
    fps = C.cut(fingerprints(src, "__t", width, ("__id",)))
    classes = fps.groupBy("__fp").agg(F.min("__id").alias("__rep"))
    comp = C.components(links(classes, radius, **options), "a", "b")
    named = classes.join(comp, classes["__fp"] == comp["node"], "left").select("__fp", "__rep", F.coalesce("component", "__fp").alias("__c"))
    named = C.cut(named)
    least = named.groupBy("__c").agg(F.min("__rep").alias("component_id"))
    named = named.join(least, "__c").select("__fp", "component_id")
    return fps.join(named, "__fp").select(F.col("__id").alias("doc_id"), F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of one document (the smallest doc_id) of each near-duplicate group, all columns kept as they are.

    A doc_id that occurs in several rows counts as one document, and its first row by text stays. Rows without an id
    can't be named by a group and stay.
    """
    keep, rank = C.fresh(docs, "__keep", "__rank")
    got = near_duplicates(docs, doc_id, text, **options).where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    one = docs.where(F.col(doc_id).isNotNull()).join(got, F.col(doc_id) == F.col(keep), "left_semi")
    first = one.withColumn(rank, F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last()))).where(F.col(rank) == 1).drop(rank)
    return first.unionByName(docs.where(F.col(doc_id).isNull()))

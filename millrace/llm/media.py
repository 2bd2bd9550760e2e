"""Media columns: chroma fingerprints of recordings, aligned by offset histograms and bit errors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Samples a second, samples in a frame, from frame to frame; frames a filter looks at.
RATE, FRAME, HOP, SPAN = 8000, 1024, 512, 12
#: A link has so many aligned values at least and at most this share of differing bits.
OVERLAP, ERRORS = 16, 0.15
#: Keys join two halves of values: bits (lowest bit of the half) of one value, of the value `gap` later, and the gap.
KEYS = ((16, 16, 4), (0, 0, 4), (8, 8, 4), (16, 16, 8), (0, 0, 8), (8, 8, 8))
#: Bits in which the two whole values of a key may differ between recordings, out of 64, for the key to vote.
WRONG = 14
#: Places that share a key and are paired at once; keys of more are verified in blocks.
PAIRED = 64
#: Keys of more places that are broadcast, 8 bytes each; more of them are joined.
HANDED = 100_000


def _pitch_class() -> np.ndarray:
    """Weights from spectrum bins (110 Hz up) to the twelve pitch classes."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    ok = hz >= 110
    out[np.flatnonzero(ok), np.round(12 * np.log2(hz[ok] / 440)).astype(int) % 12] = 1
    return out


_CLASS = _pitch_class()
_HANN = np.hanning(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) energy of pitch classes, each frame of length one; quiet frames are zero."""
    if len(samples) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP] * _HANN
    c = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _CLASS
    norm = np.sqrt((c * c).sum(1, keepdims=True))
    return np.where(norm > 1e-3 * FRAME, c / np.maximum(norm, 1e-9), 0).astype(np.float32)


def _filters() -> list[tuple[list, list]]:
    """Sixteen pairs of sets of rectangles (time, pitch, width, height) by rule: a band's early against its late half,
    a band against the opposite one, the ends of a band against its middle, and two bands crosswise."""
    out, mid, quarter = [], SPAN // 2, SPAN // 4
    for k in range(16):
        y = ((3 if k < 4 else 5) * k) % 12
        h = min(2 + k % 3, 12 - y)
        z = (y + (6 if k % 4 == 1 else 4)) % 12
        g = min(h, 12 - z)
        out.append((
            ([(0, y, mid, h)], [(mid, y, SPAN - mid, h)]),
            ([(0, y, SPAN, h)], [(0, z, SPAN, g)]),
            ([(0, y, quarter, h), (SPAN - quarter, y, quarter, h)], [(quarter, y, SPAN - 2 * quarter, h)]),
            ([(0, y, mid, h), (mid, z, SPAN - mid, g)], [(mid, y, SPAN - mid, h), (0, z, mid, g)]),
        )[k % 4])
    return out


_FILTERS = _filters()


def _values(c: np.ndarray) -> np.ndarray:
    n = len(c) - SPAN + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def total(boxes):
        s = np.zeros(n)
        for t, y, w, h in boxes:
            s += image[t + w : t + w + n, y + h] - image[t : t + n, y + h] - image[t + w : t + w + n, y] + image[t : t + n, y]
        return s

    out = np.zeros(n, np.uint32)
    gray = np.array([0, 1, 3, 2], np.uint32)
    for a, b in _FILTERS:
        level = np.digitize(np.log((total(a) + 0.3) / (total(b) + 0.3)), (-0.5, 0.0, 0.5))
        out = out << np.uint32(2) | gray[level]
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One 32-bit value for each window of SPAN frames: sixteen filters, each the log ratio of two sums of rectangles
    taken from the integral image, in four levels (Gray code)."""
    return _values(chroma(samples))


_SILENCE = _values(np.zeros((SPAN, 12), np.float32))[0]


def keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, both whole values) of a fingerprint; of equal keys in a row the first counts. Silence has none."""
    k, at, whole = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    y = x.astype(np.int64)
    for tag, (a, b, gap) in enumerate(KEYS):
        if len(y) > gap:
            u, v = y[: len(y) - gap], y[gap:]
            one = tag << 32 | (u >> a & 0xFFFF) << 16 | v >> b & 0xFFFF
            keep = (u != _SILENCE) | (v != _SILENCE)
            keep[1:] &= one[1:] != one[:-1]
            k.append(one[keep])
            at.append(np.flatnonzero(keep))
            whole.append((u << 32 | v)[keep])
    return np.concatenate(k), np.concatenate(at), np.concatenate(whole)


def _votes(batches):
    """(a, b, offset) of the pairs of places that share a key of at most PAIRED, from (key, node, at, whole) sorted by key.
    The last key of a batch waits for the next."""
    held = None
    for last, t in C.with_last(batches):
        key, node, at, whole = (np.concatenate([h, t.column(i).to_numpy()]) if held else t.column(i).to_numpy() for i, h in enumerate(held or (None,) * 4))
        if not len(key):
            held = None
            continue
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        done = len(key) if last else starts[-1]
        held = None if last else (key[done:], node[done:], at[done:], whole[done:])
        key, node, at, whole = key[:done], node[:done], at[:done].astype(np.int64), whole[:done].view(np.uint64)
        for k in range(1, done):
            i = np.flatnonzero(key[k:] == key[:-k])
            if not len(i):
                break
            i = i[(node[i] != node[i + k]) & (np.bitwise_count(whole[i] ^ whole[i + k]) <= WRONG)]
            if len(i):
                a, b = node[i], node[i + k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.where(a < b, at[i] - at[i + k], at[i + k] - at[i]).astype(np.int32))], names=["a", "b", "offset"])


def linked(x: np.ndarray, y: np.ndarray, offset: int) -> bool:
    """Do x[i + offset] and y[i] overlap in OVERLAP values or more, with at most ERRORS of their bits differing?"""
    x, y = x[max(0, offset) :], y[max(0, -offset) :]
    n = min(len(x), len(y))
    return n >= OVERLAP and int(np.bitwise_count(x[:n] ^ y[:n]).sum()) <= ERRORS * 32 * n


def _block(group: dict) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block of one key, as a spanning forest: pairs whose links are known already aren't verified again."""
    node, at, whole = group["node"], group["at"], group["whole"].view(np.uint64)
    prints = [np.frombuffer(p, np.uint32) for p in group["print"]]
    mine, across = group["__mine"], group["__p"][0] != group["__q"][0]
    labels = np.unique(group["comp"], return_inverse=True)[1]
    order = np.argsort(labels, kind="stable")
    out = []
    for i in order.tolist():
        while True:
            others = np.flatnonzero(labels != labels[i])
            others = others[(others > i) & (np.bitwise_count(whole[others] ^ whole[i]) <= WRONG)] if len(others) else others
            if across:
                others = others[mine[others] != mine[i]]
            hit = next((j for j in others.tolist() if linked(prints[i], prints[j], int(at[i] - at[j]))), None)
            if hit is None:
                break
            out.append((node[i], node[hit]))
            labels[labels == labels[hit]] = labels[i]
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, offset) that link: votes for each offset are summed, and offsets are tried from the one
    with most votes on until the bit errors there decide for a link."""
    votes = pairs.groupBy("a", "b", "offset").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "offset")), asc=False).alias("votes")).select("a", "b", F.col("votes.offset").alias("offsets"))
    both = votes.join(prints.select(F.col("node").alias("a"), F.col("print").alias("x")), "a").join(prints.select(F.col("node").alias("b"), F.col("print").alias("y")), "b")

    def run(batches):
        for t in batches:
            x, y = ([np.frombuffer(v, np.uint32) for v in t.column(i).to_pylist()] for i in (1, 2))
            ok = [any(linked(p, q, o) for o in offsets) for p, q, offsets in zip(x, y, t.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in (t.column(3), t.column(4))], names=["a", "b"])

    return both.select("offsets", "x", "y", "a", "b").mapInArrow(run, "a long, b long")


def match(recordings: DataFrame, rec_id: str = "rec_id", audio: str = "audio", paired: int = PAIRED, block: int = 1024) -> DataFrame:
    """rec_id, class_id, component_id, n_values for every row of `recordings` (audio: 16-bit little-endian mono samples).

    Recordings of one fingerprint are a class, named by its smallest rec_id; component_id is the smallest rec_id that
    can be reached over links. Two classes link if, at an offset for which one of their shared keys votes, at least 16
    values overlap with at most 15 % of their bits wrong. A key joins halves of two values (see KEYS) and votes if both
    values agree but for WRONG bits; where noise changes up to 15 % of the bits, nearly all pairs have such a key (README
    has the recall at each level).

    Within a key that few places share, all pairs vote. Where many share one, each is compared with the smallest class
    that has it, which is linear and joins copies; then, in blocks, all that are still in different components. So no
    link between components is lost.
    Null, empty, short and silent audio has no keys: its class is its component. Rows with null ids belong to a class
    and carry links, but don't name it (null, if no row does). Repeated rows give a row each, an empty table none; other
    columns aren't read.
    """
    src = recordings.select(F.col(rec_id).cast("long").alias("rec"), F.col(audio).alias("pcm"))

    def run(batches):
        for b in batches:
            got = [fingerprint(np.frombuffer(x.as_py() or b"", "<i2", count=len(x.as_py() or b"") // 2)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.tobytes() for g in got], pa.binary())], names=["rec", "print"])

    rows = C.cut(src.mapInArrow(run, "rec long, print binary").withColumn("h", F.sha2("print", 256)))
    classes = rows.groupBy("h").agg(F.min("rec").alias("class_id"), F.first("print").alias("print"))
    classes = C.cut(classes.withColumn("node", F.monotonically_increasing_id()))
    prints = classes.select("node", "print")

    def post(batches):
        for b in batches:
            for node, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k, at, whole = keys(np.frombuffer(p, np.uint32))
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), node)), pa.array(at.astype(np.int32)), pa.array(whole)], names=["key", "node", "at", "whole"])

    posts = prints.mapInArrow(post, "key long, node long, at int, whole long")
    hot = C.cut(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > paired).select("key"))
    if hot.count() <= HANDED:
        hot = F.broadcast(hot)
    few = posts.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key")
    many = C.cut(posts.join(hot, "key"))
    first = many.groupBy("key").agg(F.min(F.struct("node", "at", "whole")).alias("f")).select("key", F.col("f.node").alias("a"), F.col("f.at").alias("from"), F.col("f.whole").alias("w"))
    star = many.join(first, "key").where((F.col("node") != F.col("a")) & (F.bit_count(F.col("whole").bitwiseXOR(F.col("w"))) <= WRONG))
    star = star.select("a", F.col("node").alias("b"), (F.col("from") - F.col("at")).alias("offset"))
    known = C.cut(_verified(few.mapInArrow(_votes, "a long, b long, offset int").unionByName(star), prints))
    comp = C.components(known, "a", "b")

    named = many.join(comp, "node", "left").select("key", "node", "at", "whole", F.coalesce("component", "node").alias("comp"))
    open_ = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    dealt = C.block_pairs(named.join(open_, "key"), ["key"], "node", block).join(prints, "node")
    rest = C.by_group(dealt.select("key", "__p", "__q", "__mine", "node", "at", "whole", "comp", "print"), ["key", "__p", "__q"], _block)
    comp = C.components(known.unionByName(rest), "a", "b")

    joined = C.cut(classes.join(comp, "node", "left").select("h", "class_id", F.coalesce("component", "node").alias("comp")))
    least = joined.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    joined = joined.join(least, "comp").select("h", "class_id", "component_id")
    return rows.join(joined, "h").select(F.col("rec").alias("rec_id"), "class_id", "component_id", (F.length("print") / 4).cast("long").alias("n_values"))


def tones(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Recordings (rec_id, audio) for a table that has none: each component of a vector becomes two notes of one hop, one
    of its value in fortieths, one of the running sum in twelfths. Equal vectors sound the same, near ones nearly so. Null
    vectors are empty."""
    src = vectors.select(F.col(vec_id).cast("long").alias("rec_id"), F.col(vector).cast("array<double>").alias("v"))
    t = np.arange(HOP) / RATE

    def run(batches):
        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # audio is larger than vectors are
            out = []
            for v in b.column(1).to_pylist():
                x = np.nan_to_num(np.array([i for i in v or [] if i is not None], float))
                one, two = (np.sin(2 * np.pi * (220 * 2 ** (np.floor(k) % 36 / 12))[:, None] * t) for k in (40 * x, 12 * np.cumsum(x)))
                out.append((5000 * one + 3000 * two).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["rec_id", "audio"])

    return src.mapInArrow(run, "rec_id long, audio binary")

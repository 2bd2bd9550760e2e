"""Quality: Bradley-Terry scores learned from pairs, thresholded at a score quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

PUNCT = np.array([i for i in range(33, 127) if not chr(i).isalnum()])


def features(text: str | None) -> np.ndarray:
    """Shape of the whole text: length, case, digits, marks, repetition of words, pairs of words and lines."""
    raw = (text or "").encode("utf-8", "replace")
    ws = raw.lower().split()
    n, size = len(ws), len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    upper, lower, digit, mark = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum(), hist[PUNCT].sum()
    lines = raw.split(b"\n")
    pairs = set(zip(ws, ws[1:], strict=False))
    k = max(1, n)
    dense = [
        np.log1p(n), size / (k + 1) / 10, upper / (upper + lower + 1), digit / (size + 1), np.log1p(100 * mark / (size + 1)),
        len(set(ws)) / k, len(pairs) / max(1, n - 1), len(set(lines)) / len(lines), hist[128:].sum() / (size + 1), np.log1p(n / len(lines)),
        sum(w.isalpha() or max(w) > 127 for w in ws) / k, sum(len(w) == 1 for w in ws) / k, sum(len(w) > 20 for w in ws) / k, float(n == 0),
    ]
    return np.concatenate([dense, np.log1p(200 * hist[PUNCT] / (size + 1))])


class Ranker:
    """score(text) = w . (features standardised); (good beats bad) has probability sigmoid(score difference)."""

    def __init__(self, mean, scale, w, cut, slope):
        self.mean, self.scale, self.w, self.cut, self.slope = mean, scale, w, cut, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -4, 4) @ self.w

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.cut), -40, 40)))


def train(texts: list[str | None], labels: list[int], share: float | None = None, pairs: int = 20000, rounds: int = 300, ridge: float = 1e-3, seed: int = 2) -> Ranker:
    """Logistic loss on feature differences of (good, bad) pairs, by gradient steps with momentum. The cut is the
    quantile of the training scores at `share`, the part of bad documents, each class weighted by its share."""
    y = np.array(labels)
    dim = len(features(""))
    if not len(y) or y.min() == y.max():
        return Ranker(np.zeros(dim), np.ones(dim), np.zeros(dim), -1.0 if len(y) and y[0] else 1.0, 1.0)
    x = np.array([features(t) for t in texts])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -4, 4)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, step = np.zeros(dim), np.zeros(dim)
    for _ in range(rounds):
        g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))[:, None]).mean(0) + ridge * w
        step = 0.9 * step - 0.1 * g
        w = w + step
    s = z @ w
    share = len(bad) / len(y) if share is None else share
    weight = np.where(y == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share))
    ss = s[order]
    at = min(max(at, 0), len(ss) - 2)
    # within a gap of scores around the quantile the cut lies in the middle of the widest step
    lo, hi = max(0, at - len(ss) // 50), min(len(ss) - 1, at + len(ss) // 50 + 1)
    gap = lo + int(np.argmax(np.diff(ss[lo : hi + 1])))
    cut = (ss[gap] + ss[gap + 1]) / 2
    return Ranker(mean, scale, w, float(cut), 1.0)


#: Labelled rows that are paired with each other, or so; the rarer class has about LEAST of them at least.
BLOCK, LEAST = 512, 16


def _sums(df: DataFrame, fn, size: int) -> np.ndarray:
    """Sum of the vectors of `size` numbers that `fn` makes of each (x, y) block of `df`, added up by Spark."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                y = np.frombuffer(y.as_py(), np.int8)
                total += fn(np.frombuffer(x.as_py(), np.float64).reshape(len(y), -1), y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for r in df.select("x", "y").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


def pair_terms(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of all (good, bad) pairs of a block: their number, the sum of logistic losses, its gradient and its Hessian, flat."""
    good, bad = z[y == 1], z[y == 0]
    p, grad, hess = 0.0, np.zeros(len(w)), np.zeros((len(w), len(w)))
    for i in range(0, len(good), BLOCK):  # a block of a rare class may be long
        for j in range(0, len(bad), BLOCK):
            g, b = good[i : i + BLOCK], bad[j : j + BLOCK]
            d = (g @ w)[:, None] - (b @ w)[None]
            lose = 1 / (1 + np.exp(np.clip(d, -40, 40)))
            p += np.logaddexp(0, -d).sum()
            grad += lose.sum(0) @ b - lose.sum(1) @ g
            q = lose * (1 - lose)
            cross = g.T @ q @ b
            hess += (g * q.sum(1)[:, None]).T @ g + (b * q.sum(0)[:, None]).T @ b - cross - cross.T
    return np.concatenate([[len(good) * len(bad), p], grad, hess.ravel()])


def _quantile(scores: DataFrame, weights: tuple[float, float], at: float) -> float:
    """The least score up to which the rows weigh `at` (0 to 1) or more; weights: of a bad and of a good row. Exact: bins
    are parted again until one score is left in the bin; what is collected is 1024 rows at most."""
    weight = F.when(F.col("y") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    lo, hi = scores.agg(F.min("s"), F.max("s")).first()
    below, part = 0.0, scores
    while hi > lo:
        place = F.least(F.floor((F.col("s") - F.lit(lo)) / F.lit((hi - lo) / 1024)), F.lit(1023))
        rows = sorted(part.groupBy(place.alias("k")).agg(F.sum(weight).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect())
        for i, r in enumerate(rows):
            if below + r.n >= at - 1e-12 or i == len(rows) - 1:
                break
            below += r.n
        lo, hi = r.lo, r.hi
        part = scores.where(F.col("s").between(lo, hi))
    return lo


def _cut(scores: DataFrame, good: int, bad: int, share: float) -> float:
    """As in `train`: the middle of the widest step within a fiftieth of the rows on either side of the quantile at `share`.
    Steps are told apart down to a 4096th of that stretch."""
    n = good + bad
    middle = _quantile(scores, (share / bad, (1 - share) / good), share)
    rank = scores.where(F.col("s") < middle).count()
    lo, hi = (_quantile(scores, (1 / n, 1 / n), (min(max(r, 0), n - 1) + 1) / n) for r in (rank - n // 50, rank + n // 50 + 1))
    if lo == hi:
        return lo
    place = F.least(F.floor((F.col("s") - F.lit(lo)) / F.lit((hi - lo) / 4096)), F.lit(4095))
    rows = sorted(scores.where(F.col("s").between(lo, hi)).groupBy(place.alias("k")).agg(F.min("s").alias("lo"), F.max("s").alias("hi")).collect())
    if len(rows) < 2:
        return (lo + hi) / 2
    steps = [b.lo - a.hi for a, b in zip(rows, rows[1:], strict=False)]
    i = int(np.argmax(steps))
    return (rows[i].hi + rows[i + 1].lo) / 2


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, y, x) of every labelled document outside the held-out fold; x: its features' bytes. Features are made where
    the texts lie, and only they are shuffled. Null labels are left out; of rows with one id and label one counts."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).distinct()
    src = docs.where(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()).astype("<f8").tobytes() for t in b.column(1)], pa.binary())], names=["id", "x"])

    return C.cut(src.mapInArrow(run, "id long, x binary").join(y, "id").groupBy("id", "y").agg(F.min("x").alias("x")))


def fit(rows: DataFrame, share: float | None, ridge: float = 1e-3, passes: int = 40) -> Ranker:
    """Train on all rows of `labelled_features`. They are dealt into blocks by a hash of the id, each class by itself, and
    all (good, bad) pairs of a block count, so that pairs grow with the rows. Newton's steps on the same loss as `train`'s;
    each pass over the blocks sends sums to the driver. `share`, which places the quantile, is the part of bad documents
    among all labelled rows of the training folds."""
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    dim = len(features(""))
    if len(n) < 2:
        return train([], []) if not n else train([""], [next(iter(n))])
    blocks = max(1, min(sum(n.values()) // BLOCK, min(n.values()) // LEAST))
    names = ["block", "x", "y"]

    def gather(batches):
        held: tuple = (None, [], [])
        made = lambda h: pa.RecordBatch.from_arrays([pa.array([h[0]]), pa.array([b"".join(h[1])], pa.binary()), pa.array([bytes(h[2])], pa.binary())], names=names)
        for b in batches:
            for k, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if k != held[0]:
                    if held[1]:
                        yield made(held)
                    held = (k, [], [])
                held[1].append(x)
                held[2].append(y)
        if held[1]:
            yield made(held)

    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(blocks)).alias("block"), "x", "y", "id").repartition("block").sortWithinPartitions("block", "id").drop("id")
    by_block = C.cut(dealt.mapInArrow(gather, "block long, x binary, y binary"))
    total = sum(n.values())
    mean = _sums(by_block, lambda x, y: x.sum(0), dim) / total
    scale = np.sqrt(_sums(by_block, lambda x, y: ((x - mean) ** 2).sum(0), dim) / total) + 1e-6
    standard = lambda x: np.clip((x - mean) / scale, -4, 4)

    def loss(w):
        got = _sums(by_block, lambda x, y: pair_terms(standard(x), y, w), 2 + dim + dim * dim)
        k = max(1.0, got[0])
        return got[1] / k + ridge * w @ w / 2, got[2 : 2 + dim] / k + ridge * w, got[2 + dim :].reshape(dim, dim) / k + ridge * np.eye(dim)

    w = np.zeros(dim)
    value, grad, hess = loss(w)
    step = np.linalg.solve(hess, grad)
    for _ in range(passes):
        if np.abs(grad).max() < 1e-7 or np.abs(step).max() < 1e-9:
            break
        new = loss(w - step)
        if new[0] > value + 1e-12 * (1 + value):  # sums come in any order
            step = step / 2
            continue
        w = w - step
        value, grad, hess = new
        step = np.linalg.solve(hess, grad)

    def scored(batches):
        for b in batches:
            for x, y in zip(b.column(0), b.column(1), strict=True):
                y = np.frombuffer(y.as_py(), np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(standard(np.frombuffer(x.as_py(), np.float64).reshape(len(y), -1)) @ w), pa.array(y.astype(np.int32))], names=["s", "y"])

    scores = C.cut(by_block.select("x", "y").mapInArrow(scored, "s double, y int"))
    return Ranker(mean, scale, w, _cut(scores, n[1], n[0], n[0] / total if share is None else share), 1.0)


def score(docs: DataFrame, ranker: Ranker, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, score for every row, 0.5 at the quantile. Null texts are empty; repeated rows and null ids are
    scored each; other columns aren't read. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(ranker)
    names = list(keep)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *names, F.col(text).cast("string").alias("__t"))

    def run(batches):
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column("__t")]).reshape(b.num_rows, -1)
            got = sent.value.probability(x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *names)), pa.array(got)], names=["doc_id", *names, "score"])

    return src.mapInArrow(run, src.drop("__t").schema.add("score", "double"))

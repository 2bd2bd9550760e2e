"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all overlapping windows."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

BUCKETS = 1 << 14
CHAR, WORD, HIDDEN = 6, 6, 8
#: Words in a window, and from one window's start to the next.
WINDOW, STRIDE = 16, 8
#: A word of more bytes than LONG is read as pieces of PIECE bytes, each starting half a piece after the one before.
LONG, PIECE = 64, 12
#: Bytes in a character gram; every word with its two marks has one of each.
SIZES = (3, 4)


def _tanh(x):
    return np.tanh(x, out=x)


def _sigmoid(x):
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; a very long one as overlapping pieces, which are words of their own."""
    ws = C.words(text)
    if not ws or max(map(len, ws)) <= LONG:
        return ws
    return [p for w in ws for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]


def grams(ws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each gram size, the hash buckets of the grams of '<word>', for all words at once, and how many each word has."""
    if not ws:
        return [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in SIZES]
    flat = np.frombuffer(b"<" + b"><".join(ws) + b">", np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    left = np.repeat(np.cumsum(n), n) - np.arange(len(flat))
    out = []
    for size in SIZES:
        m = max(0, len(flat) - size + 1)
        h = np.full(m, size, np.uint32)
        for k in range(size):
            h *= np.uint32(0x01000193)
            h ^= flat[k : m + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        out.append(((h >> np.uint32(18))[left[:m] >= size].astype(np.int64), np.maximum(n - size + 1, 0)))
    return out


class Net:
    """Word input: an embedding of the word's hash; character input: the mean embedding of its grams. Two GRUs read a
    window both ways; attention pools their states; a logistic unit scores the window."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d, h = CHAR + WORD, HIDDEN
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"char": np.zeros((BUCKETS, CHAR), np.float32), "word": np.zeros((BUCKETS, WORD), np.float32), "att": g(2 * h, 8), "attv": g(8), "out": g(2 * h), "bias": np.zeros(1, np.float32)}
        self.p["char"][:] = r.standard_normal(self.p["char"].shape) * 0.05
        self.p["word"][:] = r.standard_normal(self.p["word"].shape) * 0.05
        for side in "fb":
            self.p |= {f"W{side}": g(d, 3 * h), f"U{side}": g(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}

    def inputs(self, ws: list[bytes]):
        """(features of each distinct word, what is needed to go back): the last row is for padding."""
        ids = np.fromiter((xxhash.xxh32_intdigest(w, 9) & (BUCKETS - 1) for w in ws), np.int64, len(ws))
        x = np.zeros((len(ws) + 1, CHAR + WORD), np.float32)
        own = grams(ws)
        total = sum(n for _, n in own)
        for g, n in own:
            some = n > 0
            if some.any():
                x[:-1][some, :CHAR] += np.add.reduceat(self.p["char"][g], (np.cumsum(n) - n)[some], axis=0)
        x[:-1, :CHAR] /= np.maximum(total, 1)[:, None]
        x[:-1, CHAR:] = self.p["word"][ids]
        return x, (ids, own, total)

    def project(self, x: np.ndarray) -> dict:
        """The inputs of the gates of both directions, once for each distinct word."""
        return {side: x @ self.p[f"W{side}"] + self.p[f"c{side}"] for side in "fb"}

    def windows(self, x: np.ndarray, idx: np.ndarray, keep: bool = False, pre: dict | None = None):
        """Logits of windows; idx: (windows, WINDOW) rows of x, the last row of x being padding."""
        p, h = self.p, HIDDEN
        size, length = idx.shape
        pad = idx == len(x) - 1
        at, some, pre = np.ascontiguousarray(idx.T), pad.any(0), pre or self.project(x)
        states = np.empty((length, size, 2 * h), np.float32)
        trace = {}
        for side, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            gates = pre[side]
            u1, u2, s = np.ascontiguousarray(p[f"U{side}"][:, : 2 * h]), np.ascontiguousarray(p[f"U{side}"][:, 2 * h :]), np.zeros((size, h), np.float32)
            steps = []
            for t in order:
                a = gates.take(at[t], axis=0)
                zr = s @ u1
                zr += a[:, : 2 * h]
                _sigmoid(zr)
                z, r = zr[:, :h], zr[:, h:]
                rs = r * s
                c = rs @ u2
                c += a[:, 2 * h :]
                _tanh(c)
                m = pad[:, t]
                new = c - s
                new *= z
                new += s
                if some[t]:
                    new[m] = s[m]
                if keep:
                    steps.append((t, s, z, r, rs, c, m))
                s = new
                states[t, :, h * (side == "b") : h * (side == "b") + h] = s
            trace[side] = steps
        q = _tanh(states @ p["att"])
        e = q @ p["attv"]
        e[pad.T] = -1e9
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tb,tbh->bh", e, states)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (trace, states, q, e, pooled, pad)) if keep else logit

    def backward(self, x, idx, kept, back, grad_logit):
        """Gradients of sum(grad_logit * logit)."""
        p, h = self.p, HIDDEN
        trace, states, q, e, pooled, pad = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = pooled.T @ grad_logit, np.array([grad_logit.sum()], np.float32)
        dpool = grad_logit[:, None] * p["out"]
        dstates = e[:, :, None] * dpool[None]
        de = np.einsum("tbh,bh->tb", states, dpool)
        ds = e * (de - (e * de).sum(0))
        g["attv"] = np.einsum("tb,tbk->k", ds, q)
        dq = ds[:, :, None] * p["attv"] * (1 - q * q)
        g["att"] = np.einsum("tbh,tbk->hk", states, dq)
        dstates += dq @ p["att"].T
        dx = np.zeros_like(x)
        for side in "fb":
            u, w = p[f"U{side}"], p[f"W{side}"]
            carry = np.zeros((len(idx), h), np.float32)
            dpre = np.zeros((len(x), 3 * h), np.float32)
            for t, s, z, r, rs, c, m in reversed(trace[side]):
                d = dstates[t, :, h * (side == "b") : h * (side == "b") + h] + carry
                live = np.where(m[:, None], 0, d)
                dc = live * z * (1 - c * c)
                dz = live * (c - s) * z * (1 - z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                carry = np.where(m[:, None], d, d * (1 - z)) + drs * r + dz @ u[:, :h].T + dr @ u[:, h : 2 * h].T
                a = np.concatenate([dz, dr, dc], 1)
                np.add.at(dpre, idx[:, t], a)
                g[f"U{side}"][:, : 2 * h] += s.T @ a[:, : 2 * h]
                g[f"U{side}"][:, 2 * h :] += rs.T @ dc
            dpre[-1] = 0
            g[f"W{side}"] = x.T @ dpre
            g[f"c{side}"] = dpre.sum(0)
            dx += dpre @ w.T
        ids, own, total = back
        np.add.at(g["word"], ids, dx[:-1, CHAR:])
        for gr, n in own:
            np.add.at(g["char"], gr, np.repeat(dx[:-1, :CHAR] / np.maximum(total, 1)[:, None], n, axis=0))
        return g


def layout(docs: list[list[bytes]]):
    """(distinct words, windows as rows of word numbers, the document of each window). Windows overlap and
    cover every word; a document without words has one window of padding."""
    seen: dict = defaultdict()
    seen.default_factory = seen.__len__
    idx, owner = [], []
    for i, ws in enumerate(docs):
        x = np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws))
        k = max(1, -(-(len(x) - WINDOW) // STRIDE) + 1)
        full = np.full((k - 1) * STRIDE + WINDOW, -1, np.int64)
        full[: len(x)] = x
        idx.append(np.lib.stride_tricks.sliding_window_view(full, WINDOW)[::STRIDE])
        owner.append(np.full(k, i))
    idx, owner = np.concatenate(idx), np.concatenate(owner)
    idx = np.where(idx < 0, len(seen), idx)
    return list(seen), idx, owner


def train(texts: list[str | None], labels: list[int], rounds: int = 5, steps: int = 3, size: int = 256, seed: int = 1) -> Net:
    """Multiple-instance learning: a document's score is its highest window's. Gram and word embeddings start from
    smoothed log-odds of document counts in one coordinate, so that the first highest windows mean something."""
    net = Net()
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["out"][:] = 0
        net.p["bias"][:] = 3.0 if len(y) and y[0] else -3.0
        return net
    docs = [tokens(t) for t in texts]
    at = {"char": np.zeros((2, BUCKETS)), "word": np.zeros((2, BUCKETS))}
    for ws, k in zip(docs, labels, strict=True):
        own = list(set(ws))
        at["char"][k, np.unique(np.concatenate([g for g, _ in grams(own)]))] += 1
        at["word"][k, np.unique([xxhash.xxh32_intdigest(w, 9) & (BUCKETS - 1) for w in own]).astype(np.int64)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    for kind, c in at.items():
        odds = np.log((c[1] + 2) / (n1 + 4)) - np.log((c[0] + 2 * n0 / n1) / (n0 + 4 * n0 / n1))
        net.p[kind][:, 0] = np.clip(odds, -1, 3) * (0.5 if kind == "word" else 1.0)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    # documents in blocks, each with its own numbering of words
    blocks = [layout(docs[i : i + 128]) for i in range(0, len(docs), 128)]
    for turn in range(rounds):
        chosen = []
        for b, (ws, idx, owner) in enumerate(blocks):
            x, _ = net.inputs(ws)
            if turn == 0:
                z = x[:, 0] + x[:, CHAR]
                z[-1] = -9
                logit = np.sort(z[idx], 1)[:, -2:].sum(1) + 3 * z[idx].max(1)
            else:
                pre = net.project(x)
                logit = np.concatenate([net.windows(x, idx[i : i + 1536], pre=pre) for i in range(0, len(idx), 1536)])
            order = np.lexsort((-logit, owner))
            first = np.unique(owner[order], return_index=True)[1]
            for d, f in enumerate(first):
                k = b * 128 + d
                chosen.append((b, order[f], y[k]))
                if y[k] == 0:  # further windows of clean documents are clean too
                    own = order[f : first[d + 1] if d + 1 < len(first) else None]
                    chosen += [(b, own[j], 0.0) for j in ([1] if len(own) > 1 else [])] + [(b, int(rng.choice(own)), 0.0)]
        for _ in range(steps if turn else 2 * steps):
            by_block = rng.permutation(len(chosen))
            for i in range(0, len(by_block), size):
                part = sorted((chosen[j] for j in by_block[i : i + size]), key=lambda t: t[0])
                words_: dict = {}
                idx = np.empty((len(part), WINDOW), np.int64)
                for r, (b, w, _y) in enumerate(part):
                    ws, win, _ = blocks[b]
                    for c, q in enumerate(win[w].tolist()):
                        idx[r, c] = words_.setdefault(ws[q], len(words_)) if q < len(ws) else -1
                idx[idx < 0] = len(words_)
                t = np.array([p[2] for p in part], np.float32)
                x, back = net.inputs(list(words_))
                logit, kept = net.windows(x, idx, keep=True)
                weight = np.where(t > 0, len(t) / max(1.0, t.sum()) / 4, 1.0)
                grad = net.backward(x, idx, kept, back, ((1 / (1 + np.exp(-logit)) - t) * weight / len(t)).astype(np.float32))
                step += 1
                for k in net.p:
                    gk = np.clip(grad[k], -1, 1)
                    if k in ("char", "word"):
                        rows = np.flatnonzero(np.abs(gk).sum(1))
                    else:
                        rows = slice(None)
                    m[k][rows] = 0.9 * m[k][rows] + 0.1 * gk[rows]
                    v2[k][rows] = 0.99 * v2[k][rows] + 0.01 * gk[rows] ** 2
                    net.p[k][rows] -= 0.01 * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(v2[k][rows] / (1 - 0.99**step)) + 1e-6)
    return net


def score_texts(net: Net, texts: list[str | None]) -> np.ndarray:
    """The probability of each text's highest window."""
    ws, idx, owner = layout([tokens(t) for t in texts])
    x, _ = net.inputs(ws)
    pre = net.project(x)
    best = np.full(len(texts), -np.inf)
    for i in range(0, len(idx), 1536):
        np.maximum.at(best, owner[i : i + 1536], net.windows(x, idx[i : i + 1536], pre=pre))
    return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


#: Labelled texts of each class that training sees at most.
PER_CLASS = 800


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic") -> Net:
    """Train on a bounded set of labelled texts (see `labelled_rows`). Texts that share their two smallest word hashes
    count as copies and only one is used."""
    rows, seen = [], set()
    for r in sorted(labelled.select(F.col(text).alias("t"), F.col(label).alias("y")).collect(), key=lambda r: (r.y, r.t or "")):
        sign = (r.y, *sorted({xxhash.xxh64_intdigest(w) for w in C.words(r.t)})[:2])
        if sign not in seen:
            seen.add(sign)
            rows.append(r)
    return train([r.t for r in rows], [r.y for r in rows])


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, score (0 to 1) for every row: the highest score over all overlapping windows of the whole text.
    Null and empty texts are one window of padding. Repeated rows and null ids are scored each. One pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    names = list(keep)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *names, F.col(text).cast("string").alias("__t"))

    def run(batches):
        net = sent.value
        for b in batches:
            texts = b.column("__t")
            for i, j in C.chunks(texts.to_pylist()):
                got = score_texts(net, texts[i:j].to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", *names)), pa.array(got)], names=["doc_id", *names, "score"])

    return src.mapInArrow(run, src.drop("__t").schema.add("score", "double"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most `per_class` labelled documents of each class outside the held-out fold, chosen by a hash
    of their id. Ids are chosen before any text is read, so what is broadcast is 2 * per_class ids at most, and the
    documents are filtered where they lie. Null labels are left out; of rows with one id the first text counts."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias(label))
    by_hash = F.xxhash64("__id", F.lit(29))
    some = [y.where(F.col(label) == k).orderBy(by_hash, "__id").limit(per_class) for k in (0, 1)]
    got = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias(text)).join(F.broadcast(some[0].unionByName(some[1])), "__id")
    return got.groupBy("__id", label).agg(F.min(text).alias(text)).select(text, label)

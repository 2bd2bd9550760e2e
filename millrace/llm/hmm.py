"""Hidden Markov language model over words."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from millrace.llm import common as C

#: Distinct words held by a counting task before it hands them on.
FLUSH = 200_000
TINY = 1e-30


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts: counted per task, then summed. One row with a null word counts the texts."""
    kinds = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        seen: Counter = Counter()
        n = 0
        for b in batches:
            for t in b.column(0):
                n += 1
                seen.update(C.words(t.as_py()))
                if len(seen) > FLUSH:
                    yield C.batch(kinds, list(seen), list(seen.values()))
                    seen = Counter()
        yield C.batch(kinds, [*seen, None], [*seen.values(), n])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Model:
    """start (K), move (K, K), emit (K, S): symbols are the head words, then the end, then one for all other words."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit


class _Laid:
    """Sequences side by side, longest first: at step t the first live[t] of them go on. x holds their symbols in the
    order of steps, rows offsets[t] : offsets[t + 1] for step t, without padding."""

    def __init__(self, seqs: list[np.ndarray]):
        n = np.array([len(q) for q in seqs])
        self.order = np.argsort(-n, kind="stable")
        self.n = n[self.order]
        self.live = np.searchsorted(-self.n, -np.arange(self.n[0]), side="left")
        self.offsets = np.append(0, np.cumsum(self.live))
        flat = np.concatenate([seqs[i] for i in self.order])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        rank = np.repeat(np.arange(len(seqs)), self.n)
        at = self.offsets[step] + rank
        self.x, self.rank = np.empty(len(flat), np.int32), np.empty(len(flat), np.int32)
        self.x[at], self.rank[at] = flat, rank


def forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion."""
    if not seqs:
        return np.zeros(0)
    laid, emit = _Laid(seqs), np.ascontiguousarray(model.emit.T)
    scale = np.empty(len(laid.x))
    a = np.broadcast_to(model.start, (len(seqs), len(model.start)))
    for t, k in enumerate(laid.live.tolist()):
        i = laid.offsets[t]
        a = a[:k] @ model.move if t else a[:k]
        a = a * emit.take(laid.x[i : i + k], axis=0)
        s = a.sum(1)
        a /= s[:, None]
        scale[i : i + k] = s
    out = np.empty(len(seqs))
    out[laid.order] = np.bincount(laid.rank, weights=np.log(scale), minlength=len(seqs))
    return out


def _split(seqs: list[np.ndarray], segment: int):
    """(segments, the sequence of each, its place in the sequence)."""
    n = np.array([max(1, -(-len(q) // segment)) for q in seqs], np.int64)
    owner = np.repeat(np.arange(len(seqs)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return [seqs[o][i * segment : (i + 1) * segment] for o, i in zip(owner.tolist(), place.tolist(), strict=True)], owner, place


def _transfer(model: Model, segs: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """(segments, K, K): what each segment makes of the states before it (for first segments: of its own first states),
    up to a factor for each segment."""
    laid, emit, k_states = _Laid(segs), np.ascontiguousarray(model.emit.T), len(model.start)
    out = np.where(first[laid.order][:, None, None], np.eye(k_states), model.move)
    for t, k in enumerate(laid.live.tolist()):
        e = emit.take(laid.x[laid.offsets[t] : laid.offsets[t] + k], axis=0)[:, None, :]
        if t:
            out[:k] = (out[:k].reshape(-1, k_states) @ model.move).reshape(k, k_states, k_states) * e
        else:
            out *= e
        if t % 8 == 7:
            out[:k] /= out[:k].max((1, 2), keepdims=True)
    back = np.empty_like(out)
    back[laid.order] = out / out.max((1, 2), keepdims=True)
    return back


def _bounds(model: Model, segs: list[np.ndarray], owner: np.ndarray, place: np.ndarray, group: int):
    """(states that enter each segment, weights of its last states given all that follows it): exact, each sequence's
    segments chained by their transfer matrices. Sequences of one segment need none."""
    k = len(model.start)
    enter, leave = np.tile(model.start, (len(segs), 1)), np.ones((len(segs), k))
    count = np.bincount(owner)
    long = np.flatnonzero(count[owner] > 1)
    if not len(long):
        return enter, leave
    moves = np.concatenate([_transfer(model, [segs[i] for i in long[j : j + group]], place[long[j : j + group]] == 0) for j in range(0, len(long), group)])
    at = np.full(len(segs), -1)
    at[long] = np.arange(len(long))
    steps = [np.flatnonzero((place == j) & (at >= 0)) for j in range(place.max() + 1)]
    for j in range(1, len(steps)):
        i = steps[j]
        v = np.einsum("dk,dkl->dl", enter[i - 1], moves[at[i - 1]])
        enter[i] = v / v.sum(1, keepdims=True)
    for j in range(len(steps) - 1, 0, -1):
        i = steps[j]
        v = np.einsum("dkl,dl->dk", moves[at[i]], leave[i])
        leave[i - 1] = v / v.max(1, keepdims=True)
    return enter, leave


def expect(model: Model, seqs: list[np.ndarray], sums: tuple, segment: int = 256, group: int = 1024) -> None:
    """Add the Baum-Welch expected counts of starts, moves and emissions to `sums`, exactly, over every token.

    Long sequences are read in segments, side by side with short ones: what enters a segment and what follows it comes
    from the transfer matrices of the segments around it, so that the counts are those of the whole sequence. `group`
    segments are in memory at once.
    """
    if not seqs:
        return
    segs, owner, place = _split(seqs, segment)
    enter, leave = _bounds(model, segs, owner, place, group)
    for i in range(0, len(segs), group):
        j = slice(i, i + group)
        _expect(model, segs[j], place[j] == 0, enter[j], leave[j], sums)


def _expect(model: Model, segs: list[np.ndarray], first: np.ndarray, enter: np.ndarray, leave: np.ndarray, sums: tuple) -> None:
    start, move, emit = sums
    laid = _Laid(segs)
    first, enter, leave = first[laid.order], enter[laid.order], leave[laid.order]
    k_states, n = len(model.start), len(laid.x)
    e = np.ascontiguousarray(model.emit.T).take(laid.x, axis=0)
    alpha, beta, scale = np.empty((n, k_states)), np.empty((n, k_states)), np.empty((n, 1))
    live, offsets = laid.live.tolist(), laid.offsets.tolist()
    a = np.where(first[:, None], enter, enter @ model.move)
    for t, k in enumerate(live):
        rows = slice(offsets[t], offsets[t] + k)
        a = (a[:k] @ model.move if t else a) * e[rows]
        s = a.sum(1, keepdims=True)
        a /= s
        alpha[rows], scale[rows] = a, s
    e /= scale
    back = np.ascontiguousarray(model.move.T)
    last = np.asarray(offsets)[laid.n - 1] + np.arange(len(segs))
    leave = leave / (alpha[last] * leave).sum(1, keepdims=True)
    beta[last] = leave
    for t in range(len(live) - 1, 0, -1):
        rows, before = slice(offsets[t], offsets[t] + live[t]), offsets[t - 1]
        np.matmul(e[rows] * beta[rows], back, out=beta[before : before + live[t]])
    later = offsets[1]
    steps = np.repeat(np.arange(len(live)), live)[later:]
    e *= beta
    pairs = alpha[np.asarray(offsets)[steps - 1] + laid.rank[later:]].T @ e[later:]
    pairs += enter[~first].T @ e[:later][~first]
    move += model.move * pairs
    alpha *= beta
    start += alpha[:later][first].sum(0)
    for s in range(k_states):
        emit[s] += np.bincount(laid.x, weights=alpha[:, s], minlength=emit.shape[1])


def normalised(start, move, emit, unigram, weight: float = 20.0) -> Model:
    """Maximum likelihood with priors: emissions are drawn to the unigram, moves to uniform."""
    k = len(start)
    e = emit + weight * unigram[None, :] + TINY
    return Model((start + 1) / (start.sum() + k), (move + 1) / (move + 1).sum(1, keepdims=True), e / e.sum(1, keepdims=True))


#: Segments of 64 tokens, evenly spaced over the sampled texts, that starting values are taken from at most.
SAMPLE_SEGMENTS = 6000


def first_model(seqs: list[np.ndarray], unigram: np.ndarray, states: int, rounds: int) -> Model:
    """Starting values: segments of sequences are clustered by their words (mixture of unigrams, hashed starts), one
    state to a cluster, then Baum-Welch on the same bounded sample. Only where training starts depends on it."""
    s = len(unigram)
    rng = np.random.default_rng(11)
    if not seqs or s < 2:
        noise = rng.random((states, s)) * 0.1 + 1
        return normalised(np.zeros(states), np.zeros((states, states)), noise * unigram, unigram)
    cut = [q[i : i + 64] for q in seqs for i in range(0, len(q), 64)]
    if len(cut) > SAMPLE_SEGMENTS:
        cut = [cut[i] for i in np.linspace(0, len(cut) - 1, SAMPLE_SEGMENTS).astype(int)]
    owner = np.repeat(np.arange(len(cut)), [len(q) for q in cut])
    flat = np.concatenate(cut)
    pick = rng.integers(0, len(cut), states)
    emit = np.array([np.bincount(cut[i], minlength=s) for i in pick], float)
    for _ in range(12):
        m = normalised(np.zeros(states), np.zeros((states, states)), emit, unigram, 5.0)
        logs = np.log(m.emit)[:, flat]
        ll = np.array([np.bincount(owner, weights=row, minlength=len(cut)) for row in logs])
        z = np.exp(np.clip(ll - ll.max(0), -50, 0))
        z /= z.sum(0)
        emit = np.array([np.bincount(flat, weights=z[k, owner], minlength=s) for k in range(states)])
    model = normalised(np.ones(states), 20 * np.eye(states) + 1, emit, unigram)
    for _ in range(rounds):
        sums = (np.zeros(states), np.zeros((states, states)), np.zeros((states, s)))
        expect(model, cut, sums)
        model = normalised(*sums, unigram)
    return model


def encoder(head: dict):
    """text -> (symbols of its words and the end, its words outside the head)."""
    other, end, get = len(head) + 1, len(head), head.get

    def encode(text, rest=True):
        ws = C.words(text)
        x = np.array([get(w, other) for w in ws], np.int32)
        if not rest:
            return np.append(x, np.int32(end))
        rest = [ws[i] for i in np.flatnonzero(x == other)]
        return np.append(x, np.int32(end)), rest

    return encode


def cutoff(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it or more, up to steps of an eighth: from a histogram whose
    size doesn't depend on the table. Equal counts are all in or all out."""
    step = F.floor(8 * F.log2("n")).cast("int")
    own = counts.where("word is not null").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    got, least = 0, 1 << 62
    for r in sorted(own, key=lambda r: -r.step):
        got += r.words
        if got > most:
            break
        least = r.least
    return least


def sample(train: DataFrame, doc_id: str, text: str, rows: int, total: int) -> list[str | None]:
    """About `rows` texts (four times as many at most), those with the smallest hashes of their ids: the threshold is
    set before a text is read."""
    by = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(31))
    share = min(1.0, rows / max(1, total))
    got = train.where(by <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))).select(F.col(text).cast("string").alias("t"), by.alias("h")).limit(4 * rows).collect()
    return [r.t for r in sorted(got, key=lambda r: (r.h, r.t or ""))]


class Trained:
    """The head (word -> symbol), the model, the counts of all words and what the base probabilities need."""

    def __init__(self, head, model, base, known, total, floor, counts):
        self.head, self.model, self.base, self.known, self.total, self.floor, self.counts = head, model, base, known, total, floor, counts


def fit(
    train: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = 10, head_words: int = 32768, rounds: int = 2, sample_docs: int = 400, sample_rounds: int = 6,
) -> Trained:
    """The model of `score_documents`."""
    spark = train.sparkSession
    counts = C.cut(count_words(train, text))
    tot = counts.agg(F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("d"), F.sum("n").alias("n"), F.count("word").alias("v")).first()
    ends, total, distinct = tot.d or 0, tot.n or 0, tot.v + (1 if tot.d else 0)
    top = sorted(counts.where(F.col("word").isNotNull() & (F.col("n") >= cutoff(counts, head_words))).collect(), key=lambda r: (-r.n, bytes(r.word)))
    head = {bytes(r.word): i for i, r in enumerate(top)}
    head_n = np.array([r.n for r in top] + [ends], float)
    floor = total + 0.1 * (distinct + 1)
    base = np.append((head_n + 0.1) / floor, 0.0)
    in_tail = distinct - len(top) - (1 if ends else 0)  # training words outside the head
    rest_n = total - head_n.sum()
    # one unknown word, and the end where no training text had it, are outside the counted words
    base[-1] = (rest_n + 0.1 * (in_tail + 1)) / floor
    if not ends:
        base[len(head)] = 0.1 / floor
    unigram = base / base.sum()
    encode = encoder(head)
    model = first_model([encode(t)[0] for t in sample(train, doc_id, text, sample_docs, ends)] if total else [], unigram, states, sample_rounds)
    sizes = (states, len(unigram))
    for _ in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast((head, model))

        def run(batches, sent=sent):
            head, model = sent.value
            enc = encoder(head)
            k, s = sizes
            sums = (np.zeros(k), np.zeros((k, k)), np.zeros((k, s)))
            for b in batches:
                got = b.column(0).to_pylist()
                for i, j in C.chunks(got):
                    expect(model, [enc(t, False) for t in got[i:j]], sums)
            start, move, emit = sums
            used = np.flatnonzero(emit.sum(0) > 0)
            ids = np.concatenate([[-1], -2 - np.arange(k), used]).astype(np.int32)
            rows = np.concatenate([start[None], move, emit.T[used]])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(rows[:, i]) for i in range(k))], names=["id", *(f"s{i}" for i in range(k))])

        schema = "id int, " + ", ".join(f"s{i} double" for i in range(states))
        got = train.select(F.col(text).cast("string")).mapInArrow(run, schema).groupBy("id").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]).collect()
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros(sizes)
        for r in got:
            if r[0] == -1:
                start += r[1:]
            elif r[0] < -1:
                move[-2 - r[0]] += r[1:]
            else:
                emit[:, r[0]] += r[1:]
        model = normalised(start, move, emit, unigram)
        sent.unpersist()
    return Trained(head, model, base, head_n > 0, total, floor, counts)


def score_documents(
    docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = 10, head_words: int = 32768, rounds: int = 2,
    sample_docs: int = 400, sample_rounds: int = 6, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of `docs`: doc_id, `keep`, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, then one end. Base: add-0.1 unigram over the training tokens and one unknown. Model: an HMM of
    `states` states. A state emits a word of the head, the end, or "other"; "other" gives a word with its base
    probability among those outside the head. Probabilities over all words sum to one. The head is the commonest
    training words, `head_words` at most and down to a count that all of its words reach (see `cutoff`).
    Word counts cover all training rows. Starting values come from `sample_docs` rows or so; then `rounds` Baum-Welch
    rounds run over all training rows and whole texts, expected counts summed across partitions. The recursion is over
    whole texts.
    The head and the model are broadcast (head_words x (states + a word)); words outside the head meet their counts in
    a join. Null text: the end alone. No training rows: N = V = 0, every token has base probability 1.
    Repeated rows and null ids are scored each; other columns aren't read.
    """
    got = fit(train, doc_id, text, states, head_words, rounds, sample_docs, sample_rounds)
    counts, base, floor, names = got.counts, got.base, got.floor, list(keep)
    sent = docs.sparkSession.sparkContext.broadcast((got.head, got.model, np.log10(np.append(base[:-1], 1.0)), got.known))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *names, F.col(text).cast("string").alias("__t"))
    kinds = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rest", pa.list_(pa.binary()))])

    def judge(batches):
        head, model, logs, known = sent.value
        enc = encoder(head)
        known = np.append(known, False)
        for b in batches:
            got = b.column("__t").to_pylist()
            for i, j in C.chunks(got, 1024, 4 << 20):
                both = [enc(t) for t in got[i:j]]
                seqs = [x for x, _ in both]
                own = C.batch(kinds, [len(x) for x in seqs], [int(known[x].sum()) for x in seqs], [float(logs[x].sum()) for x in seqs], forward(model, seqs) / np.log(10), [r for _, r in both])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("doc_id", *names)), *own.columns], names=["doc_id", *names, *kinds.names])

    out = src.drop("__t").schema
    for f, t in (("n_tokens", "long"), ("n_known", "long"), ("base", "double"), ("score", "double"), ("rest", ArrayType(BinaryType()))):
        out = out.add(f, t)
    scored = C.cut(src.mapInArrow(judge, out).withColumn("__row", F.monotonically_increasing_id()))
    p = lambda n: F.log10((F.coalesce(n, F.lit(0)) + 0.1) / F.lit(float(floor)))
    tail = scored.select("__row", F.explode("rest").alias("word"))
    tail = tail.join(counts.where("word is not null"), "word", "left").groupBy("__row").agg(F.sum(p(F.col("n"))).alias("p"), F.count("n").alias("k"), F.count(F.lit(1)).alias("m"))
    whole = scored.drop("rest").join(tail, "__row", "left")
    inside = float(np.log10(base[-1])) if base[-1] > 0 else 0.0
    nil = lambda c: F.coalesce(c, F.lit(0))
    return whole.select(
        "doc_id", *names, "n_tokens", (F.col("n_known") + nil("k")).alias("n_known"), F.lit(int(got.total)).cast("long").alias("train_tokens"),
        (F.col("base") + nil("p")).alias("base_score"), (F.col("score") + nil("p") - inside * nil("m")).alias("score"))

"""The network's scores and the ranker's weights against plain loops."""

import numpy as np
import xxhash

from millrace.llm import quality, toxicity


def plain_features(net, w):
    p = net.p
    marked = b"<" + w + b">"
    rows = []
    for size in toxicity.SIZES:
        for i in range(len(marked) - size + 1):
            h = size
            for c in marked[i : i + size]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ c
            h ^= h >> 15
            rows.append(p["char"][(h * 0x9E3779B1 & 0xFFFFFFFF) >> 18])
    own = xxhash.xxh32_intdigest(w, 9) & (toxicity.BUCKETS - 1)
    return np.concatenate([np.mean(rows, axis=0), p["word"][own]])


def plain_window(net, xs):
    """One window's logit, word by word."""
    p, h = net.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for side, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        s, own = np.zeros(h), {}
        for t in order:
            a = xs[t] @ p[f"W{side}"] + p[f"c{side}"]
            z, r = sig(a[:h] + s @ p[f"U{side}"][:, :h]), sig(a[h : 2 * h] + s @ p[f"U{side}"][:, h : 2 * h])
            c = np.tanh(a[2 * h :] + (r * s) @ p[f"U{side}"][:, 2 * h :])
            s = own[t] = (1 - z) * s + z * c
        states.append(own)
    both = np.array([np.concatenate([states[0][t], states[1][t]]) for t in range(len(xs))])
    e = np.tanh(both @ p["att"]) @ p["attv"]
    e = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
    return (e @ both) @ p["out"] + p["bias"][0]


def test_scores_are_the_highest_of_all_windows():
    rng = np.random.default_rng(5)
    net = toxicity.Net(7)
    net.p["char"] *= 20
    net.p["word"] *= 20
    texts = [" ".join("".join(rng.choice(list("abcdeÄ"), rng.integers(1, 9))) for _ in range(n)) for n in (1, 3, 15, 16, 17, 23, 24, 25, 60)]
    got = toxicity.score_texts(net, [*texts, "x" * 3000 + " bad"])
    for t, s in zip([*texts, "x" * 3000 + " bad"], got, strict=True):
        xs = [plain_features(net, w) for w in toxicity.tokens(t)]
        starts = range(0, max(1, -(-(len(xs) - toxicity.WINDOW) // toxicity.STRIDE) * toxicity.STRIDE + 1), toxicity.STRIDE)
        best = max(plain_window(net, xs[i : i + toxicity.WINDOW]) for i in starts)
        assert abs(s - 1 / (1 + np.exp(-best))) < 1e-4


def test_ranker_weights_and_cut():
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(80)]
    texts = [" ".join(rng.choice(words, 40)) + ("!!! 99 " * int(rng.integers(1, 9)) if i % 4 == 0 else ".") for i in range(200)]
    labels = [int(i % 4 != 0) for i in range(200)]
    r = quality.train(texts, labels, 0.25, pairs=4000, rounds=3000)
    z = np.clip((np.array([quality.features(t) for t in texts]) - r.mean) / r.scale, -4, 4)
    y = np.array(labels)
    # the loss of all (good, bad) pairs, one after the other, is near its least: no coordinate lowers it by much
    good, bad = z[y == 1][::5], z[y == 0][::2]

    def loss(w):
        return np.mean([np.log1p(np.exp(-(a - b) @ w)) for a in good for b in bad]) + 0.0005 * w @ w

    base = loss(r.w)
    assert base < 0.2 and all(loss(r.w + s * e) > base - 0.01 for e in np.eye(len(r.w)) for s in (-0.2, 0.2))
    # the cut parts the share of bad documents from the others, and scores order as raw scores do
    raw = z @ r.w
    assert abs(np.mean(raw < r.cut) - 0.25) <= 0.03
    p = r.probability(np.array([quality.features(t) for t in texts]))
    assert np.all((p >= 0.5) == (raw >= r.cut)) and np.mean((p >= 0.5) == y) > 0.97
    assert 0 <= r.probability(quality.features("")[None])[0] <= 1

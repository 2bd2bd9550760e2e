"""Toxicity of texts without white space, and of words some way apart."""

import numpy as np

from millrace.llm import toxicity


def test_long_words_are_read_whole():
    w = "".join(chr(97 + i % 26) for i in range(1000))
    got = toxicity.tokens(w + " end")
    assert got[-1] == b"end" and all(len(x) <= 64 for x in got)
    assert all(any(w[i : i + 6].encode() in x for x in got) for i in range(len(w) - 5))
    assert toxicity.tokens("x" * 64) == [b"x" * 64] and toxicity.tokens(None) == []


def test_cue_far_into_a_word_counts():
    rng = np.random.default_rng(3)
    plain = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    texts = [" ".join([*(plain(6) for _ in range(20)), *(["vileword"] if i % 3 == 0 else [])]) for i in range(150)]
    net = toxicity.train(texts, [int(i % 3 == 0) for i in range(150)])
    clean = [plain(200) for _ in range(8)]
    a, b = toxicity.score_texts(net, clean), toxicity.score_texts(net, [c[:150] + "vileword" + c[150:] for c in clean])
    assert (b > a + 0.05).all()


def test_words_half_a_window_apart_share_one():
    _, idx, _ = toxicity.layout([[b"w%d" % i for i in range(60)]])
    rows = [set(r.tolist()) for r in idx]
    assert all(any({i, i + 8} <= r for r in rows) for i in range(52))

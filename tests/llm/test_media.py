"""Audio alignment against brute force over all pairs, and recall against brute force over all offsets."""

import numpy as np
import pytest

from millrace.llm import media

T = np.arange(media.HOP) / media.RATE


def song(seed, notes=64):
    one, two = np.random.default_rng(seed).integers(0, 36, (2, notes))
    a, b = (np.sin(2 * np.pi * (220 * 2 ** (k / 12))[:, None] * T) for k in (one, two))
    return (5000 * a + 3000 * b).ravel()


def pcm(x):
    return np.clip(x, -32768, 32767).astype("<i2")


def components(links, names):
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in names}


def voted(x, y):
    (k, p, u), (m, q, v) = media.keys(x), media.keys(y)
    return {int(i - j) for a, i, c in zip(k, p, u, strict=True) for b, j, d in zip(m, q, v, strict=True) if a == b and int(c ^ d).bit_count() <= media.WRONG}


@pytest.mark.parametrize(("paired", "block", "handed"), [(64, 1024, 100), (2, 3, 0)])
def test_match_against_all_pairs(spark, monkeypatch, paired, block, handed):
    monkeypatch.setattr(media, "HANDED", handed)
    rng = np.random.default_rng(6)
    sounds = [song(i) for i in range(6)]
    for i, x in enumerate(sounds[:3]):
        for level in (200, 2500):
            sounds.append(x + rng.normal(0, level * (i + 1) / 2, len(x)))
        sounds += [x[4096:], x[512 * 10 + 100 : 512 * 45], np.concatenate([song(20 + i, 20), x])]
    sounds += [sounds[0], np.concatenate([song(0), song(1)]), np.zeros(20000), np.zeros(30000), np.sin(2 * np.pi * 440 * np.arange(30000) / 8000) * 9000]
    rows = [(i, pcm(x).tobytes()) for i, x in enumerate(sounds)] + [(900, b""), (901, None), (None, pcm(sounds[5]).tobytes()), (None, pcm(song(77)).tobytes()), (902, b"\x01"), (0, pcm(sounds[0]).tobytes())]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "rec_id long, audio binary, print string, node int")
    got = media.match(d, paired=paired, block=block).collect()
    prints = {i: media.fingerprint(pcm(x)) for i, x in enumerate(sounds)}
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i].tobytes() == prints[j].tobytes() or any(media.linked(prints[i], prints[j], o) for o in voted(prints[i], prints[j])))]
    want = components(links, list(prints))
    assert len(got) == len(rows) and {r.rec_id: r.component_id for r in got if r.rec_id is not None and r.rec_id < 900} == want
    assert len(set(want.values())) < len(want) - 8
    assert {r.component_id for r in got if r.rec_id in (900, 901, 902)} == {900}
    assert sorted((r.class_id or -1, r.component_id or -1) for r in got if r.rec_id is None) == [(-1, -1), (5, want[5])]
    assert {r.n_values for r in got if r.rec_id == 900} == {0} and media.match(d.limit(0)).count() == 0


@pytest.mark.parametrize(("change", "least"), [(("noise", 2000), 0.98), (("noise", 3000), 0.9), (("shift", 128), 0.98), (("shift", 200), 0.9), (("cut", 100), 0.9)])
def test_recall_against_all_offsets(change, least):
    rng, kind, by = np.random.default_rng(1), *change
    near = found = 0
    for seed in range(80):
        x = song(seed)
        y = {"noise": lambda x: x + rng.normal(0, by, len(x)), "shift": lambda x: x[by:], "cut": lambda x: x[512 * 20 + by : 512 * 50]}[kind](x)
        p, q = media.fingerprint(pcm(x)), media.fingerprint(pcm(y))
        if any(media.linked(p, q, o) for o in range(-len(q), len(p))):
            near += 1
            found += any(media.linked(p, q, o) for o in voted(p, q))
    assert near > 40 and found >= least * near

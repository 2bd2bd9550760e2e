"""Training-data operators against brute force, round trips and odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chat, common, contamination, hmm, media, packing, quality, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __t string, score double"
RNG = np.random.default_rng(4)
VOCAB = ["".join(RNG.choice(list("abcdefgh"), RNG.integers(2, 7))) for _ in range(120)]


def prose(rng, n):
    return " ".join(w + ("." if rng.random() < 0.08 else "") for w in rng.choice(VOCAB, n))


def odd_docs(spark, texts):
    rows = [(i, t, "en", None, len(t or ""), "clash", 9.0) for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, "s", None, None, None), (None, None, None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    base = [prose(rng, n) for n in (0, 1, 2, 3, 40, 80, 120, 400)]
    near = base[7].replace(VOCAB[3], "zzz", 1)
    return odd_docs(spark, [None, "", " \n\t", *base, base[5], base[6] + " tail", near, "ÀÉ ß 漢字 " * 30, "x" * 30000])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ascii_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_words_and_chunks():
    t = "A\x0bb\x85c D É\x1fF\r\n"
    assert [w.decode() for w in common.words(t)] == ascii_words(t) and common.words(None) == []
    assert list(common.chunks(["a" * 10] * 5, rows=2, size=100)) == [(0, 2), (2, 4), (4, 5)] and list(common.chunks([])) == []


def test_block_pairs_loses_none(spark):
    d = spark.createDataFrame([("k", i) for i in range(50)] + [("one", 1)], "k string, i long")
    got = common.block_pairs(d, ["k"], "i", block=8).groupBy("k", "__p", "__q").agg(F.collect_set("i").alias("s")).collect()
    met = {(a, b) for r in got for a in r.s for b in r.s if a < b}
    assert len(met) == 50 * 49 // 2 and max(len(r.s) for r in got) < 40


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(3, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got.get(x, x) == find(x) for x in list(parent))
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# 1. toxicity


def test_network_gradient():
    net = toxicity.Net()
    ws, idx, _ = toxicity.layout([[b"ab", b"cd", b"ef", b"ab", b"gh"], [b"cd"]])
    x, back = net.inputs(ws)
    g = np.array([1.0, -0.5], np.float32)
    _, kept = net.windows(x, idx, keep=True)
    grad = net.backward(x, idx, kept, back, g)
    for name, at in (("Uf", (1, 3)), ("Ub", (2, 20)), ("Wf", (0, 5)), ("att", (3, 2)), ("out", (4,)), ("cb", (17,))):
        old, eps = net.p[name][at], 1e-2
        net.p[name][at] = old + eps
        up = net.windows(x, idx) @ g
        net.p[name][at] = old - eps
        down = net.windows(x, idx) @ g
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 5e-3, name


def test_windows_cover_every_word():
    for n in (0, 1, 16, 17, 28, 29, 100):
        _, idx, owner = toxicity.layout([[b"w%d" % i for i in range(n)]])
        assert len(owner) == len(idx) and set(idx[idx < n].tolist()) == set(range(n))


def test_toxicity_learns_and_odd_rows(spark, docs, empty):
    rng = np.random.default_rng(2)
    texts, labels = [], []
    for i in range(240):
        ws = prose(rng, 60).split()
        if i % 3 == 0:
            for b in ("vileword", "nastyterm"):
                ws.insert(int(rng.integers(0, 60)), b)
        texts.append(" ".join(ws))
        labels.append(int(i % 3 == 0))
    net = toxicity.train(texts[:180], labels[:180])
    got = toxicity.score_texts(net, texts[180:]) >= 0.5
    assert np.mean(got == np.array(labels[180:])) > 0.95
    out = toxicity.score(docs, net).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty, net).count() == 0
    assert toxicity.score_texts(toxicity.train([], []), ["a"])[0] < 0.5


def test_labelled_rows_are_bounded(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_rows(docs, labels, "quality", lambda i: common.fold_of(i, 3) == 1, 3)
    n = Counter(r.quality for r in got.collect())
    assert set(n) <= {0, 1} and max(n.values()) <= 3
    assert toxicity.labelled_rows(docs, labels, "toxic", lambda i: common.fold_of(i, 5) == 0, 3).count() == 0


# 2. language model


def test_hmm_is_a_distribution_and_exact(spark):
    words = ["a", "b", "c d", "a b", "", None, "a a a b c"]
    train = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    probe = ["", "a", "b", "c", "d", "new", "A", "a b c d new"]
    got = {r.t: r for r in hmm.score_documents(spark.createDataFrame([(i, t, t) for i, t in enumerate(probe)], "doc_id long, text string, t string"), train, states=3, head_words=2, keep=("t",)).collect()}
    c = Counter(w for t in words for w in ascii_words(t))
    total, v = sum(c.values()) + len(words), len(c) + 1
    p = lambda n: np.log10((n + 0.1) / (total + 0.1 * (v + 1)))
    for t, r in got.items():
        ws = ascii_words(t)
        assert abs(r.base_score - (sum(p(c[w]) for w in ws) + p(len(words)))) < 1e-9
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, total)
    # the score is the plain forward recursion over states that emit every word: head, tail and one unknown
    f = hmm.fit(train, states=3, head_words=2)
    share = {w: 10 ** p(c[w]) / f.base[-1] for w in [*c, "new"] if w.encode() not in f.head}
    emit = lambda w: f.model.emit[:, -1] * share[w] if w in share else f.model.emit[:, f.head[w.encode()] if w is not None else len(f.head)]
    assert sum(emit(w) @ f.model.start for w in [*c, "new", None]) == pytest.approx(1) and f.model.start.sum() == pytest.approx(1)
    for t, r in got.items():
        a = f.model.start
        for i, w in enumerate([*ascii_words(t), None]):
            a = (a @ f.model.move if i else a) * emit(w)
        assert r.score == pytest.approx(np.log10(a.sum()))


def test_forward_and_expectation_match_enumeration():
    rng = np.random.default_rng(0)
    k, s = 3, 5
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k))
    seqs = [rng.integers(0, s, n).astype(np.int32) for n in (4, 1, 6)]
    import itertools

    ll, want = [], (np.zeros(k), np.zeros((k, k)), np.zeros((k, s)))
    for q in seqs:
        paths = {z: m.start[z[0]] * m.emit[z[0], q[0]] * np.prod([m.move[a, b] * m.emit[b, x] for a, b, x in zip(z, z[1:], q[1:], strict=False)]) for z in itertools.product(range(k), repeat=len(q))}
        total = sum(paths.values())
        ll.append(np.log(total))
        for z, p in paths.items():
            want[0][z[0]] += p / total
            for a, b in zip(z, z[1:], strict=False):
                want[1][a, b] += p / total
            for a, x in zip(z, q, strict=True):
                want[2][a, x] += p / total
    assert np.allclose(hmm.forward(m, seqs), ll)
    for segment, group in ((256, 1024), (1, 1024), (2, 2), (3, 1)):
        sums = (np.zeros(k), np.zeros((k, k)), np.zeros((k, s)))
        hmm.expect(m, seqs, sums, segment, group)
        assert all(np.allclose(a, b) for a, b in zip(sums, want, strict=True))


def test_head_is_bounded(spark):
    rows = [(f"w{i}".encode(), 1 + 100000 // (i + 1)) for i in range(2000)] + [(None, 5)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (1, 10, 500, 1999, 2000):
        least = hmm.cutoff(counts, most)
        head = [n for w, n in rows if w and n >= least]
        assert len(head) <= most and (most < 10 or len(head) >= most / 2)
    assert hmm.cutoff(counts.limit(0), 5) > 1 << 60


def test_hmm_odd_tables(spark, docs, empty):
    got = hmm.score_documents(docs, empty)
    assert got.count() == docs.count() and got.where("base_score <> 0 or train_tokens <> 0").count() == 0
    assert hmm.score_documents(empty, docs, states=2).count() == 0
    full = hmm.score_documents(docs, docs, states=2, head_words=8).collect()
    assert len(full) == docs.count() and all(np.isfinite(r.score) for r in full)


# 3. URLs


def judge_plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


def test_url_sweep(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/x/", "block"), ("a.example.net", "/", "block"), ("org", "/fr/", "allow"), ("org-x", "/", "block"), ("b.org", "", "block")]
    hosts = ["net", "x.net", "example.net", "A.Example.NET", "c.a.example.net", "xexample.net", "org", "b.org", "org-x", "q.org-x", "orgx", "", "net.", ".net", "b.org:80", "net/x", "é.net"]
    seen = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en/x/1?q=/fr/", "/fr/a#b", "?x", "#/en/")] + [None, "", "no scheme", "://", "http://a.net/en/://b.org/"]
    d = spark.createDataFrame([(i % 70, u, "h", "k") for i, u in enumerate(seen)] * 2, "page_id long, url string, host string, key string")
    got = urls.judge(d, spark.createDataFrame(rules, "host string, path string, verdict string"), salts=3).collect()
    assert len(got) == 2 * len(seen)
    assert Counter((r.page.url, r.host, r.path, r.rule, r.verdict) for r in got) == Counter({(u, *judge_plain(u, rules)): 2 for u in seen})
    assert urls.judge(d.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert urls.judge(d, spark.createDataFrame([], "host string, path string, verdict string")).where("rule is not null").count() == 0


# 4. packing


def test_packing(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((d, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    got = packing.pack_documents(docs, path, size=256).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for o, n in sorted(own):
            assert o == at and n > 0
            at += n
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    total = Counter()
    for r in got:
        total[r.doc_id, r.doc_tokens] += r.length
    assert total == Counter({k: k[1] * n for k, n in want.items()})
    # every piece's ids, of one of the texts of its document
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    assert all(any(len(x) == r.doc_tokens and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in ids[r.doc_id]) for r in got)
    assert packing.pack_documents(empty, path).count() == 0


def test_words_are_encoded_as_texts_are():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, rng = P.path("word_bpe_49k.json"), np.random.default_rng(1)
    tok, words = Tokenizer.from_file(path), packing.Words(path, most=40)
    for _ in range(12):  # tables of 40 words turn over again and again
        texts = [prose(rng, 60), "\x01 a\x01b \x01\x01", "ÀÉ ß 漢字 \u2028x\xa0y", None, "a  b\tc\n", prose(rng, 9) + " new%d" % rng.integers(0, 99)]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_plain_words_go_to_the_model_alone(monkeypatch):
    """Pre-tokens of plain words are cut as the tokenizer cuts them; only other words go through the whole tokenizer."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(path), packing.Words(path)
    plain = ["Don't 'twas 'S I'LL'd' ''re x'", "a1b22c 3,14 (thn)*** the,&&& !?", "\xc9t\xe9 l'\xeatre stra\xdfe \xbfqu\xe9? \xa1\xd1o! na\xefve1\xff"]
    odd = ["x<|y <|endoftext|> a<|startoftext|>b", "\xd7 \xf7 \xaa \xba \xb5 \xb2 \xbd \xa0 x\x85y", "\u0130 \u03a3\u03a3 e\u0301 \u212a \u212b \u1e9e \ufb01 a\u200bb \u6f22\u5b57 \x01 \x7f a\x00b \u0661"]
    for t in plain + odd:
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    words.table.clear(), words.older.clear(), words.pieces.clear()
    monkeypatch.setattr(words, "tokenizer", None)
    for t in plain:
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def plain_pack(sizes, size, most):
    """The same rule over a plain list of windows: (pieces by window, in the order in which windows are done)."""
    open_, done = [], []
    fill = lambda w: sum(n for _, _, n in w)
    squares = lambda ws: sum(n * n for n in Counter(fill(w) for w in ws if fill(w) < size).values())

    def put(i, piece):
        if i is None:
            open_.append([piece])
        else:
            open_.append([*open_.pop(i), piece])  # of one level the last touched goes first
        if fill(open_[-1]) == size:
            done.append(open_.pop())

    def choose(options, n):
        return min(options, key=lambda i: (squares([w if j != i else [*w, (0, 0, n)] for j, w in enumerate(open_)] + ([[(0, 0, n)]] if i is None else [])), -(fill(open_[i]) if i is not None else 0), -(i or 0)))

    def squeeze(d, start, n):
        while n:
            if not open_:
                return put(None, (d, start, n))
            fits = [i for i, w in enumerate(open_) if fill(w) + n <= size]
            if fits:
                return put(choose(fits, n), (d, start, n))
            common = Counter(map(fill, open_))
            i = max(range(len(open_)), key=lambda i: (common[fill(open_[i])], fill(open_[i]), i))
            k = size - fill(open_[i])
            put(i, (d, start, k))
            start, n = start + k, n - k

    for d, n in enumerate(sizes):
        done += [[(d, i * size, size)] for i in range(n // size)]
        if n % size:
            if len(open_) < most:
                put(choose([None, *(i for i, w in enumerate(open_) if fill(w) + n % size <= size)], n % size), (d, n - n % size, n % size))
            else:
                squeeze(d, n - n % size, n % size)
    for k in range(size.bit_length() - 1):
        done += [open_.pop(i) for i in reversed(range(len(open_))) if fill(open_[i]) == 1 << k]
    while len(open_) > 1:
        least = min(map(fill, open_))
        for d, start, n in open_.pop(max(i for i, w in enumerate(open_) if fill(w) == least)):
            squeeze(d, start, n)
    return done, open_


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_placement_against_a_plain_loop(most):
    rng = np.random.default_rng(5)
    for size, n in ((8, 60), (64, 300), (64, 0), (16, 1)):
        sizes = rng.integers(1, 2 * size + 9, n).tolist() if n > 1 else [5] * n
        got = [[(d, at, len(ids) // 4) for d, at, ids, _ in w] for w in packing.pack([(i, bytes(4 * k), k) for i, k in enumerate(sizes)], size, most)]
        want, left = plain_pack(sizes, size, most)
        assert got[: len(want)] == want
        lengths = [sum(k for _, _, k in w) for w in got[len(want) :]]
        assert sum(lengths) == sum(k for w in left for _, _, k in w) < size and len(set(lengths)) == len(lengths) and all(k & (k - 1) == 0 for k in lengths)


def test_small_tasks_are_packed_by_the_rule():
    rng = np.random.default_rng(2)
    sizes = np.minimum(rng.lognormal(5.5, 1.1, 250).astype(int) + 1, 20000).tolist()
    got = list(packing.pack([(i, bytes(4 * k), k) for i, k in enumerate(sizes)]))
    rest = [w for w in got if len(w) > 1 or len(w[0][2]) // 4 < 4096]
    full = [w for w in rest if sum(len(p[2]) for p in w) == 4 * 4096]
    assert sum(len(p[2]) for w in full for p in w) >= 0.9 * sum(len(p[2]) for w in rest for p in w)
    pieces = Counter(p[0] for w in got for p in w)
    assert sum(pieces.values()) - sum(-(-k // 4096) for k in sizes) <= len(got)  # a cut closes a window


# 7. contamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_and_pigeonhole():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item, text = "".join(rng.choice(list("abc"), rng.integers(1, 90))), "".join(rng.choice(list("abcd"), rng.integers(0, 60)))
        assert contamination.myers(item, text) == plain_distance(item, text)
    for n in (30, 101):
        for k in (0, 2, 9):
            ps = contamination.pieces("x" * n, k)
            assert len(ps) == k + 1 and sum(len(p) for _, p in ps) == n


def test_matches_against_brute_force(spark, empty):
    rng = np.random.default_rng(7)
    items = [prose(rng, 12) for _ in range(6)] + ["tiny", "", None, "Q", "two  words"]
    texts = []
    for i in range(30):
        body = prose(rng, 40)
        if i % 2:
            it = list(items[i % 6])
            for _ in range(i % 5):
                it[int(rng.integers(0, len(it)))] = "#"
            body = body[:50] + "  " + "".join(it).upper() + "\n" + body[50:]
        texts.append(body)
    texts += [None, "", "tiny", "a tinytiny", "is Tiny, or\tTINY\n", "q", "two\nwords", "two words.", "qq"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    d = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, edits int")
    want = set()
    for i, t in enumerate(texts):
        for j, it in enumerate(items):
            n, m = contamination.normal(it), contamination.normal(t)
            if len(n) >= contamination.LEAST and m and plain_distance(n, m) <= int(contamination.RATE * len(n)):
                want.add((i, j))
            elif 0 < len(n) < contamination.LEAST and f" {n} " in f" {m} ":
                want.add((i, j))
    got = contamination.matches(d, bench, block=4).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) and len(want) > 8
    assert contamination.clean(d, bench).count() == len(texts) - len({i for i, _ in want})
    assert contamination.matches(empty, bench).count() == 0 and contamination.matches(d, bench.limit(0)).count() == 0


# 8. quality


def test_quality_learns_from_every_labelled_row(spark):
    """Weights and cut are those of all pairs of all labelled rows, more of each class than the old bound of 2000."""
    rng = np.random.default_rng(3)
    texts = [prose(rng, int(rng.integers(3, 12))) + ("!!" if rng.random() < 0.2 + 0.5 * (i % 2) else "") for i in range(6400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(6400)] + [(None, 1), (9, None), (99999, 0)], "doc_id long, quality int")
    rows = quality.labelled_features(d, y, "quality", lambda i: common.fold_of(i, 3) == 1)
    kept = [i for i in range(6400) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted((r.id, r.y) for r in rows.collect()) == [(i, i % 2) for i in kept] and len(kept) > 4000
    r = quality.fit(rows, None)
    x, label = np.array([quality.features(texts[i]) for i in kept]), np.array(kept) % 2
    assert np.allclose(r.mean, x.mean(0)) and np.allclose(r.scale, x.std(0) + 1e-6)
    # the mean over blocks' pairs is near that over all pairs, whose gradient is nought at the true weights
    got = quality.pair_terms(np.clip((x - r.mean) / r.scale, -4, 4), label, r.w)
    assert np.abs(got[2 : 2 + len(r.w)] / got[0] + 1e-3 * r.w).max() < 0.02
    s, k = np.sort(r.raw(x)), len(x)
    at, share = int(np.ceil(k * np.mean(label == 0))) - 1, np.mean(label == 0)
    assert s[max(0, at - k // 50 - 1)] <= r.cut <= s[at + k // 50 + 2] and abs(np.mean(s < r.cut) - share) < 0.03
    few = rows.where("id < 300")
    r = quality.fit(few, None)  # one block
    x, label = x[np.array(kept) < 300], label[np.array(kept) < 300]
    got = quality.pair_terms(np.clip((x - r.mean) / r.scale, -4, 4), label, r.w)
    assert np.abs(got[2 : 2 + len(r.w)] / got[0] + 1e-3 * r.w).max() < 1e-6
    assert quality.fit(few.where("y = 1"), None).raw(x[:1])[0] > quality.fit(few.where("y = 1"), None).cut
    assert quality.fit(few.limit(0), None).probability(x[:1])[0] < 0.5


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(3)
    texts = [prose(rng, 50) if i % 4 else " ".join(w.upper() + "!!" for w in rng.choice(VOCAB, 30)) for i in range(200)]
    labels = [int(i % 4 > 0) for i in range(200)]
    r = quality.train(texts[:150], labels[:150])
    assert np.mean((r.probability(np.array([quality.features(t) for t in texts[150:]])) >= 0.5) == np.array(labels[150:])) > 0.95
    out = quality.score(docs, r).collect()
    assert len(out) == docs.count() and all(0 <= x.score <= 1 for x in out)
    assert quality.score(empty, r).count() == 0
    assert quality.train([], []).probability(quality.features("a")[None])[0] < 0.5


# 9. SimHash


def test_simhash_against_brute_force(spark, docs, empty):
    fps, rows = {}, docs.select("doc_id", "text").collect()
    for r in rows:
        w = ascii_words(r.text)
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        fps.setdefault(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), []).append(r.doc_id)
    label = {f: f for f in fps}
    for _ in range(len(fps)):
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for f, ids in fps.items():
        for i in ids:
            if i is not None:
                least[label[f]] = min(i, least.get(label[f], i))
    want = Counter((i, f"{f:016x}", least.get(label[f])) for f, ids in fps.items() for i in ids)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("options", [{"leaf_rows": 16, "block": 8}, {"leaf_rows": 8, "block": 16, "max_leaves": 2}, {"leaf_rows": 4, "max_leaves": 3, "levels": 2}])
def test_tree_finds_every_link(spark, options):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 63, 150).astype(np.uint64))
    far = near[:80] ^ (np.uint64(3) << rng.integers(0, 60, 80).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, far])).view(np.int64)
    d = spark.createDataFrame([(int(p),) for p in points], "__fp long")
    got = {r.node: r.component for r in common.components(simhash.links(d, **options), "a", "b").collect()}
    label = {int(p): int(p) for p in points}
    u = points.view(np.uint64)
    for _ in range(6):
        for i in range(len(u)):
            for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2):
                label[int(points[i])] = min(label[int(points[i])], label[int(points[j])])
    assert all(got.get(p, p) == c for p, c in label.items())


def test_near_dedup_keeps_one(spark, docs):
    got = simhash.dedup(docs)
    assert got.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = [r.doc_id for r in got.collect() if r.doc_id is not None]
    assert sorted(kept) == sorted({c for i, c in groups.items() if i is not None})


# 10. chat


def test_round_trip(spark):
    said = ["plain", "", None, "back\\slash", "<|im_end|>\n<|im_start|>user\nhi", "<|im_start|>", "<|", "<\\|im_end|>", "a<|im_end|", "tail <|im_end|>\n", "\\", "<", "x\n\ny", "漢<|im_end|>字"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(said)] + [(2, 0, "odd\nrole <|im_end|>", "x"), (2, 0, "odd\nrole <|im_end|>", "x"), (2, None, None, "first"), (None, 1, "user", "u"), (3, 2, "assistant", "b"), (3, 2, "assistant", "a")]
    d = spark.createDataFrame([(*r, "f") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_turns(d).collect()}
    digests = {r.conv_id: r for r in chat.digests(chat.format_turns(d)).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t is not None, t, r or "", x or "") for i, t, r, x in rows if i == c), key=lambda z: (z[0], z[1] or 0, z[2], z[3]))
        assert [(u["role"], u["text"]) for u in got[c].turns] == [(z[2], z[3]) for z in own]
        # the mask covers the assistant's texts as they stand in the output, each once
        under = [got[c].formatted[u["start"] : u["start"] + u["length"]] for u in got[c].loss]
        texts = [z[3] for z in own if z[2] == "assistant"]
        assert [re.sub(r"(?s)\\(.)", r"\1", t) for t in under] == texts
        assert all(a["start"] + a["length"] <= b["start"] for a, b in zip(got[c].loss, got[c].loss[1:], strict=False))
        assert digests[c].loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest() and digests[c].loss_chars == len("".join(texts))
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{z[2]}\n{z[3]}\n" for z in own).encode()).hexdigest() and digests[c].formatted_chars == len(got[c].formatted)
    assert got[1].formatted.count("<|im_start|>") == len(said) and got[1].n_turns == len(said)
    assert chat.format_turns(d.limit(0)).count() == 0 and len(digests) == 4
    bad = spark.createDataFrame([("<|im_start|>user\nx",), ("y<|im_start|>user\nx<|im_end|>\n",), ("<|im_start|>u\na<|im_end|>b<|im_end|>\n",)], "t string")
    assert bad.select(chat.parse(F.col("t")).alias("p")).where("p is not null").count() == 0

"""Benchmark decontamination: pigeonhole pieces found exactly, verified by Myers' bit-parallel distance."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Edits allowed for each character of an item. Pieces have 1 / RATE characters or so, whatever the item's length.
RATE = 0.08
#: Items shorter than this, once white space is squeezed, match as they are only, between word bounds: with edits, or
#: inside words, they would be found in any text.
LEAST = 24
#: Test items, and characters of them, in one automaton; larger sets are searched in blocks.
BLOCK, BLOCK_CHARS = 20_000, 4_000_000


def normal(text: str | None) -> str:
    """A-Z lower-cased, runs of ASCII white space as one space."""
    return b" ".join(C.words(text)).decode("utf-8", "replace")


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of even size. Whatever `errors` edits do, one piece is left whole."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str) -> int:
    """The least edit distance between the item and any substring of the text (Myers 1999, in one long word)."""
    m = len(item)
    masks: dict = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


class Searcher:
    """Finds every item that occurs in a text with at most floor(rate * length) edits; items shorter than `least` as whole
    words, without edits. Texts and short items stand between two spaces."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = LEAST):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            t = normal(text)
            if t:
                k = int(rate * len(t)) if len(t) >= least else 0
                if len(t) < least:
                    t = f" {t} "
                for a, p in pieces(t, k):
                    places.setdefault(p, []).append((len(self.items), a))
                self.items.append((item_id, t, k))
        self.automaton = ahocorasick.Automaton()
        for p, where in places.items():
            self.automaton.add_word(p, (len(p), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, edits), the least for each item found."""
        if not self.items or not text:
            return []
        t = f" {normal(text)} "
        starts: dict = {}
        for end, (n, where) in self.automaton.iter(t):
            for i, a in where:
                starts.setdefault(i, []).append(end - n + 1 - a)
        out = []
        for i, own in starts.items():
            item_id, item, k = self.items[i]
            best = None
            lo = hi = None
            # starts of occurrences next to each other are checked in one window
            for s in [*sorted(own), None]:
                if lo is not None and (s is None or s - hi > 2 * k + 8):
                    part = t[max(0, lo - k) : hi + len(item) + k]
                    d = 0 if item in part else myers(item, part) if k else k + 1
                    if d <= k and (best is None or d < best):
                        best = d
                    lo = None
                if s is not None:
                    lo, hi = (s if lo is None else lo), s
                if best == 0:
                    break
            if best is not None:
                out.append((item_id, best))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block: int = BLOCK, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The stated query set in blocks of a bounded number and length, each with its own pass over the documents."""
    own: list = []
    size = 0
    for r in benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull()).toLocalIterator():
        if own and (len(own) == block or size + len(r[1]) > chars):
            yield own
            own, size = [], 0
        own.append((r[0], r[1]))
        size += len(r[1])
    if own:
        yield own


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_key, item_id, edits): the items each document holds, with the fewest edits found.

    Letters A-Z fold and white space is squeezed on both sides. An item of n characters may differ by floor(rate * n)
    edits; it is cut into one piece more, one of which must occur exactly; each such place is verified. An item shorter
    than `least` must occur as whole words, without edits. All of every text is searched. Null and blank texts and items
    match nothing; repeated rows give a row each, as do items of one id. text_key is the hash of the text. No shuffle.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), F.col(text).cast("string").alias("t"))
    schema = "doc_id long, text_key long, item_id long, edits int"
    kinds = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())])
    found = None
    for items in item_blocks(benchmark, item_id, item_text, block):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            search = Searcher(sent.value, rate, least)
            for b in batches:
                ids, keys = b.column(0), b.column(1)
                rows = [(ids[i].as_py(), keys[i].as_py(), *m) for i in range(b.num_rows) for m in search.find(b.column(2)[i].as_py())]
                if rows:
                    yield C.batch(kinds, *map(list, zip(*rows, strict=True)))

        part = src.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no test item, all columns as they are, whatever their names."""
    mine, key = C.fresh(docs, "__id", "__key")
    hit = matches(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(mine), F.col("text_key").alias(key)).distinct()
    return docs.join(hit, F.col(doc_id).cast("long").eqNullSafe(F.col(mine)) & F.xxhash64(F.col(text).cast("string")).eqNullSafe(F.col(key)), "left_anti")

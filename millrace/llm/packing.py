"""Packing of token ids into windows by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: A control character as a word: one token that stands between words encoded together.
MARK = b"\x01"
#: The pre-tokens of a tokenizer that lower-cases and cuts words by this pattern; _CUT is the same over plain characters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_CUT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+").findall
#: Plain: characters of ASCII, Latin letters with accents, and the two marks of Spanish; NFC leaves them as they are.
_PLAIN = re.compile(f"[!-~\xa1\xbf{_LETTERS}\xc0-\xd6\xd8-\xde]*").fullmatch
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes as the characters that a byte-level model has for them.
_BYTES = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words:
    """Token ids of texts, with the ids of each word kept: the tokenizer's pre-tokens never cross white space.

    `table` holds the little-endian ids of words; beyond `most` it becomes the older of two, from which words that come
    again are taken over, so that common words stay. A worker's later tasks go on with both. Of a tokenizer whose rules
    are those of `_PATTERN`, plain words are cut here, and each pre-token goes to its model by itself, once.
    """

    _of: ClassVar[dict] = {}

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        if path not in self._of:
            self._of[path] = (Tokenizer.from_file(path), {}, {}, {})
        self.tokenizer, self.table, self.older, self.pieces = self._of[path]
        self.model = self.tokenizer.model if self._cuts_by_pattern() else None
        self.mark = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids[-1]
        # a tokenizer that lower-cases knows one form of A-Z in each word
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.fold = all(ids(t) == ids(t.lower()) for t in (*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "The Quick 'S I'LL E\u0301"))
        self.most = most

    def _cuts_by_pattern(self) -> bool:
        """Are the tokenizer's rules those that `_plain` follows?"""
        rules = json.loads(self.tokenizer.to_str())
        model = rules["model"]
        return (
            rules["normalizer"] == {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
            and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            and model["type"] == "BPE" and not model["dropout"] and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        )

    def _plain(self, new: list[bytes]) -> list[bytes]:
        """Learn the plain words among new ones; returns the rest. What could hold an added token isn't plain."""
        pieces, model, rest = self.pieces, self.model.tokenize, []
        if len(pieces) > self.most:
            pieces.clear()
        for w in new:
            s = w.decode("utf-8", "replace").lower()
            if b"<|" in w or not _PLAIN(s):
                rest.append(w)
                continue
            own = [s] if s.isalpha() else _CUT(s)
            for p in own:
                if p not in pieces:
                    shown = p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES)
                    pieces[p] = np.array([t.id for t in model(shown)], "<u4").tobytes()
            self.table[w] = b"".join([pieces[p] for p in own])
        return rest

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new words. Other than plain ones, many are encoded in one text, between marks that are a token of their own; a word that
        holds the mark, or a text whose marks don't come back as sent, is encoded by itself."""
        if self.model is not None:
            new = self._plain(new)
        for i in range(0, len(new), 2048):
            part = [w for w in new[i : i + 2048] if MARK not in w]
            text = (b" " + MARK + b" ").join(part).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(part) - 1:
                starts, ends = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
                raw = ids.tobytes()
                self.table.update((w, raw[a:b]) for w, a, b in zip(part, starts, ends, strict=True))
            for w in new[i : i + 2048]:
                if w not in self.table:
                    self.table[w] = np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        table, older = self.table, self.older
        if len(table) > self.most:
            older.clear()
            older.update(table)
            table.clear()
        raw = (t.encode("utf-8", "replace") if t else b"" for t in texts)
        own = [(r.lower() if self.fold else r).split() for r in raw]
        new = set().union(*own).difference(table)
        if older:
            again = new.intersection(older)
            table.update(zip(again, map(older.__getitem__, again), strict=True))
            new -= again
        self._learn(list(new))
        return [b"".join(map(table.__getitem__, ws)) for ws in own]


class SumOfSquares:
    """Online packing. count[h] is the number of open windows filled to level h, 0 < h < size; a full window is closed and
    counts no more. Of equal choices the fullest level is taken, an open window before a new one."""

    def __init__(self, size: int):
        self.size, self.count, self.open, self.live = size, np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)], 0

    def _fit(self, s: int) -> tuple[int, int]:
        """(level, growth of the sum of squares) for a piece of size s on an open window; level 0: it fits on none."""
        size, count = self.size, self.count
        h = np.flatnonzero(count[: size - s + 1])
        if not len(h):
            return 0, 0
        grow = 2 * (count[h + s] - count[h]) + 2
        grow[h + s == size] = 1 - 2 * count[size - s]
        i = len(h) - 1 - int(np.argmin(grow[::-1]))
        return int(h[i]), int(grow[i])

    def _put(self, level: int, s: int) -> tuple[list, bool]:
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = []
            self.live += 1
        if level + s == self.size:
            self.live -= 1
            return window, True
        self.count[level + s] += 1
        self.open[level + s].append(window)
        return window, False

    def place(self, s: int) -> tuple[list, bool]:
        """(window, is it full now): the level for which the sum of squares grows least, level 0 being a new window."""
        level, grow = self._fit(s)
        new = 0 if s == self.size else 2 * int(self.count[s]) + 1
        return self._put(level if level and grow <= new else 0, s)

    def squeeze(self, s: int) -> tuple[list, int, bool]:
        """(window, how much of the piece it takes, is it full now), without a new window: the whole piece where it fits,
        by the same rule; otherwise it is cut into the level that the cut closes and for which the sum falls most."""
        level, _ = self._fit(s)
        if not level:
            h = np.flatnonzero(self.count)
            level = int(h[len(h) - 1 - int(np.argmax(self.count[h][::-1]))])
            s = self.size - level
        return *self._put(level, s)[:1], s, level + s == self.size

    def take(self, level: int) -> list:
        """An open window of this level, which is open no more."""
        self.count[level] -= 1
        self.live -= 1
        return self.open[level].pop()


def pack(items, size: int = 4096, most_open: int = 4096):
    """items: (doc, ids as little-endian bytes, tokens of the document). Yields sequences as lists of pieces
    [doc, start, ids, tokens of the document].

    Documents longer than a window are cut into whole windows and a rest; rests are placed by the sum-of-squares rule.
    While `most_open` windows are open, none is opened: a rest that fits on none is cut, each cut closing a window by the
    same rule. So it is at the end, where the least filled windows are taken apart, until one is left. It is cut into
    sequences whose lengths are powers of two, which need no padding; open windows of such a fill stay as they are.
    """
    bins = SumOfSquares(size)

    def squeezed(piece):
        doc, start, ids, total = piece
        while ids:
            if not bins.live:
                bins.place(len(ids) // 4)[0].append([doc, start, ids, total])
                return
            window, n, full = bins.squeeze(len(ids) // 4)
            window.append([doc, start, ids[: 4 * n], total])
            start, ids = start + n, ids[4 * n :]
            if full:
                yield window

    for doc, ids, total in items:
        n, start = len(ids) // 4, 0
        while n - start >= size:
            yield [[doc, start, ids[4 * start : 4 * (start + size)], total]]
            start += size
        if start < n:
            piece = [doc, start, ids[4 * start :], total]
            if bins.live < most_open:
                window, full = bins.place(n - start)
                window.append(piece)
                if full:
                    yield window
            else:
                yield from squeezed(piece)
    for k in range(size.bit_length() - 1):
        while bins.count[1 << k]:
            yield bins.take(1 << k)
    while bins.live > 1:
        for piece in bins.take(int(np.flatnonzero(bins.count)[0])):
            yield from squeezed(piece)
    if bins.live:
        level = int(np.flatnonzero(bins.count)[0])
        run = bins.take(level)
        for bit in reversed(range(size.bit_length())):
            if level >> bit & 1:
                need, one = 1 << bit, []
                while need:
                    doc, start, ids, total = run[0]
                    n = min(need, len(ids) // 4)
                    one.append([doc, start, ids[: 4 * n], total])
                    need -= n
                    if 4 * n == len(ids):
                        run.pop(0)
                    else:
                        run[0] = [doc, start + n, ids[4 * n :], total]
                yield one


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end: int = 2) -> DataFrame:
    """Pieces of documents in sequences of at most `size` ids: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its text's ids, then `end`; null and empty texts are `end` alone. Each id lies in exactly one piece.
    A sequence is full or has a power of two as its length, so that none needs padding. Every partition packs for
    itself, one pass with bounded state and no shuffle (see `pack`); sequence_id is unique over partitions. A null doc_id is
    carried as null, repeated rows are packed each, an empty table gives no rows, other columns aren't read.
    """
    src = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    kinds = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        words = Words(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36

        def items():
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for i, j in C.chunks(texts):
                    for d, got in zip(ids[i:j], words.encode(texts[i:j]), strict=True):
                        yield d, got + tail, len(got) // 4 + 1

        rows = []
        for k, seq in enumerate(pack(items(), size)):
            at = 0
            for doc, start, ids, total in seq:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, base + k, at))
                at += n
            if len(rows) >= 4096:
                yield C.batch(kinds, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield C.batch(kinds, *map(list, zip(*rows, strict=True)))

    return src.mapInArrow(run, SCHEMA)

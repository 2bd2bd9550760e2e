"""Text expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII punctuation marks, as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = ("a", "an", "the")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_answer(text) -> Column:
    """Lower-cased, without ASCII punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(_col(text)), PUNCTUATION, "")
    kept = F.filter(F.split(bare, r"\s+"), lambda w: ~w.isin(*ARTICLES) & (w != ""))
    return F.array_join(kept, " ")


def answer_tokens(text) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


def token_hint(text) -> Column:
    """max(len // 4, 1)."""
    return F.greatest(F.floor(F.length(_col(text)) / 4), F.lit(1)).cast("long")


def token_estimate(text) -> Column:
    """ceil(len / 4)."""
    return F.ceil(F.length(_col(text)) / 4).cast("long")


def prompt_bound(text) -> Column:
    """Bytes and 64 of overhead for a message; 256 more are added once a prompt."""
    return (F.octet_length(_col(text)) + 64).cast("long")


def strip_reply(text) -> Column:
    """A model's reply without its <think> block, code fences and a leading label."""
    s = F.regexp_replace(_col(text), r"(?is)<think>.*?</think>", "")
    s = F.regexp_replace(s, r"(?s)```[a-zA-Z0-9_]*\n?", "")
    return F.trim(F.regexp_replace(s, r"(?i)^\s*(answer|prompt|question|response)\s*:\s*", ""))


def fenced_code(text) -> Column:
    """The body of the first fenced block, else the whole text, trimmed."""
    body = F.regexp_extract(_col(text), r"(?s)```[a-zA-Z0-9_]*\n(.*?)```", 1)
    return F.trim(F.when(body != "", body).otherwise(_col(text)))


def leading_score(text, low: float = 0, high: float = 5) -> Column:
    """The number a reply begins with, null if there is none or it lies outside [low, high]."""
    n = F.regexp_extract(_col(text), r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(n.between(low, high), n)


def last_two_numbers(text) -> Column:
    """The last two integers of a text as an array, null if it has fewer."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(-?[0-9]+)"), F.lit(1))
    return F.when(F.size(found) >= 2, F.transform(F.slice(found, -2, 2), lambda x: x.cast("long")))


def mask_volatile(text) -> Column:
    """Three-part signed tokens and ISO timestamps as fixed marks, so that effects of two runs compare."""
    s = F.regexp_replace(_col(text), r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "<token>")
    return F.regexp_replace(s, r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z?", "<time>")


def line_weight(line) -> Column:
    """2 for a line that calls something, 1.5 for one that assigns, else 1."""
    s = _col(line)
    return F.when(s.rlike(r"[A-Za-z_][A-Za-z0-9_.]*\("), F.lit(2.0)).when(s.rlike(r"^\s*[A-Za-z_][A-Za-z0-9_]*\s*="), F.lit(1.5)).otherwise(F.lit(1.0))


def degenerate_code(code) -> Column:
    """Code that returns a constant, or has fewer than two assignments."""
    s = _col(code)
    constant = s.rlike(r"(?m)^\s*return\s+(?:-?[0-9.]+|True|False|None|'[^']*'|\"[^\"]*\")\s*$")
    return constant | (F.size(F.regexp_extract_all(s, F.lit(r"(?m)^\s*[A-Za-z_][A-Za-z0-9_]*\s*=[^=]"), F.lit(0))) < 2)


def parent_of(task_id) -> Column:
    """What stands before the last underscore."""
    s = _col(task_id)
    return F.regexp_replace(s, r"_[^_]*$", "")


def first_words(text, n: int = 40) -> Column:
    """The first n words, tags taken out."""
    bare = F.trim(F.regexp_replace(_col(text), r"<[^>]*>", " "))
    return F.array_join(F.slice(F.split(bare, r"\s+"), 1, n), " ")


def contains_any_case(text, needle: str) -> Column:
    return F.contains(F.lower(_col(text)), F.lit(needle.lower()))


def finite(x) -> Column:
    """NaN and infinities as null: a missing outcome is never a number."""
    c = _col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def hash_rank_key(salt: str, *ids) -> Column:
    """Salted SHA-256 whose order replaces a seeded shuffle; equal on every engine."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *[_col(c).cast("string") for c in ids]), 256)


def hash_parity(hex_digest) -> Column:
    """0 or 1: the parity of a hexadecimal number, from its last digit."""
    return (F.conv(F.right(_col(hex_digest), F.lit(1)), 16, 10).cast("int") % 2).cast("int")


def utc_stamp(ts) -> Column:
    """ISO-8601 with a Z; the session's zone is expected to be UTC."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")

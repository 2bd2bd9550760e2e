"""Tool-call lists and other small state machines that expressions can't say; Arrow batches, never row by row."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Calls in a list from which on no distance is taken.
MOST_CALLS = 12


def value_distance(a, b) -> float:
    """0 for equal values of one type, a number's difference d as d / (1 + d), else 1. True is no number."""
    if type(a) in (int, float) and type(b) in (int, float):
        return abs(a - b) / (1 + abs(a - b))
    return float(type(a) is not type(b) or a != b)


def call_distance(call: tuple, truth: tuple) -> float:
    """Mean mismatch over the arguments of either call; the truth lists allowed values, "" among them: may be absent."""
    (name, given), (wanted, allowed) = call, truth
    if name != wanted:
        return 1.0
    total = 0.0
    for k in {**given, **allowed}:
        options = allowed.get(k, [])
        options = options if isinstance(options, list) else [options]
        if k not in given:
            total += "" not in options
        else:
            total += min((value_distance(given[k], v) for v in options), default=1.0)
    return total / max(1, len({**given, **allowed}))


def assignment(cost: list[list[float]]) -> float:
    """The least sum of a square cost matrix with one entry in each row and column: shortest augmenting paths over
    potentials, one row after the other."""
    n = len(cost)
    rows, cols, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)  # the last column stands for the row being placed
    for i in range(n):
        owner[n], j, reach, via, done = i, n, [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[j] != n or j == n:
            done[j], r = True, owner[j]
            for k in range(n):
                if not done[k]:
                    d = cost[r][k] - rows[r] - cols[k]
                    if d < reach[k]:
                        reach[k], via[k] = d, j
            nearest = min((k for k in range(n) if not done[k]), key=reach.__getitem__)
            step = reach[nearest]
            for k in range(n + 1):
                if done[k]:
                    rows[owner[k]] += step
                    cols[k] -= step
                elif k < n:
                    reach[k] -= step
            j = nearest
        while j != n:
            owner[j] = owner[via[j]]
            j = via[j]
    return sum(cost[owner[j]][j] for j in range(n))


def binding(calls: list[dict] | None, truth: list[dict] | None) -> float | None:
    """Distance of a list of calls, each {name: arguments}, to the nearest allowed binding, calls in any order: the least
    mean of call distances. 1 if the lists differ in length, null beyond MOST_CALLS."""
    if not calls or not truth:
        return float(bool(calls) != bool(truth))
    a, b = ([x for c in side for x in c.items()] for side in (calls, truth))
    if len(a) != len(b):
        return 1.0
    return None if len(a) > MOST_CALLS else assignment([[call_distance(x, y) for y in b] for x in a]) / max(1, len(a))


@F.pandas_udf(T.DoubleType())
def binding_distance(calls: pd.Series, truth: pd.Series) -> pd.Series:
    """`binding` of two JSON columns; null where either is null or isn't a list of objects of objects."""

    def one(x, y):
        try:
            return binding(json.loads(x), json.loads(y))
        except (TypeError, ValueError, AttributeError):
            return None

    return pd.Series([one(x, y) for x, y in zip(calls, truth, strict=True)], dtype="float64")


#: A comment, or (group 1) a quoted stretch; a doubled closing mark stands for itself.
_QUOTED = r"""'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|`[^`]*+(?:``[^`]*+)*+`|\[[^\]]*+(?:\]\][^\]]*+)*+\]"""
_SKIPPED = rf"(?s)--[^\n]*+|/\*.*?\*/|({_QUOTED})"
_MARK = "\x01"


def is_single_statement(sql) -> Column:
    """Whether a text holds exactly one SQL statement: semicolons in quotes ('', "", ``, []) and comments don't count, empty
    statements neither; what is quoted or commented must end. Null stays null. JVM expressions only."""
    col = F.col(sql) if isinstance(sql, str) else sql
    bare = F.regexp_replace(F.regexp_replace(F.translate(col, _MARK, "x"), _SKIPPED, _MARK + "$1"), rf"(?s){_MARK}(?:{_QUOTED})", "x")
    bare = F.translate(bare, _MARK, " ")
    open_ = bare.rlike(r"""['"`\[]|/\*""")
    return ~open_ & (F.size(F.filter(F.split(bare, ";"), lambda p: p.rlike(r"\S"))) == 1)


def canonical_json(text: str | None) -> str | None:
    """Keys sorted, no spaces, characters as they are; null for what isn't JSON or holds a number JSON can't say."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    return s.map(canonical_json)


def compiles(code: str | None) -> bool:
    """Whether Python accepts the source. It is never run."""
    if code is None:
        return False
    try:
        compile(code, "<pool>", "exec")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def code_compiles(s: pd.Series) -> pd.Series:
    return s.map(compiles)


def spans_of(text: str | None, needle: str | None) -> list[tuple[int, int]]:
    """Character spans of a needle's words in a row in a text, case folded, whole words."""
    import re

    if not text or not needle:
        return []
    words = [(m.group().casefold(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
    want = [w.casefold() for w in re.findall(r"\w+", needle)]
    k = len(want)
    return [(words[i][1], words[i + k - 1][2]) for i in range(len(words) - k + 1) if k and [w[0] for w in words[i : i + k]] == want]


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())))
def matching_spans(text: pd.Series, needle: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b} for a, b in spans_of(x, y)] for x, y in zip(text, needle, strict=True)])

"""Stages on tables whose columns are named as theirs are."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import contamination, simhash, substring, toxicity

NAMES = ["__id", "__key", "__keep", "__spans", "__rank", "__ID_", "doc", "u", "class", "component", "item_id", "keeper"]


@pytest.fixture(scope="module")
def table(spark):
    long = "one two three four five six seven eight nine ten eleven twelve. "
    rows = [(1, long * 3), (2, long + "and more of it than there was before, as it seems to me. " + long), (3, "short"), (None, None), (2, long)]
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    return d.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def test_simhash(table):
    got = simhash.dedup(table)
    assert got.columns == table.columns and got.where(" and ".join(f"`{n}` = {i}" for i, n in enumerate(NAMES))).count() == got.count() > 0


def test_passages(table):
    got = substring.dedup(table)
    assert got.columns == table.columns and got.where(" and ".join(f"`{n}` = {i}" for i, n in enumerate(NAMES))).count() == table.count()


def test_benchmark(spark, table):
    got = contamination.clean(table, spark.createDataFrame([(1, "short")], "item_id long, text string"))
    assert got.columns == table.columns and got.count() == table.count() - 1


def test_toxicity(table):
    got = toxicity.score(table, toxicity.Net(), keep=tuple(NAMES))
    assert got.columns == ["doc_id", *NAMES, "score"] and got.count() == table.count()

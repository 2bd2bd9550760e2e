"""The pipeline's stages on a small table, and the entry without the subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage, item = prose(60), prose(25)
    texts = [prose(120) for _ in range(60)]
    for i in range(0, 24):
        texts[i] = texts[i] + " vileword nastyterm " + prose(10)
    texts[30] = texts[31] = prose(150)
    texts[32], texts[33] = texts[32] + "\n" + passage, texts[33] + "\n" + passage
    texts[34] = texts[34] + "\n" + item + "\n" + prose(20)
    out = tmp_path_factory.mktemp("tables")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i < 24)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), passage


def test_stages(spark, folder):
    import corpus_pipeline as P

    d, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    at = {}
    for name, stage in P.STAGES:
        got = stage(spark, docs, d)
        if name != "packing":
            assert got.columns == docs.columns
        at[name] = docs = spark.createDataFrame(got.collect(), got.schema)
    ids = {n: {r.doc_id for r in f.collect()} for n, f in at.items()}
    assert not ids["toxicity"] & set(range(24)) and ids["toxicity"] >= set(range(24, 60))
    assert ids["toxicity"] - ids["simhash"] == {31}
    assert ids["passages"] == ids["simhash"] and sum(passage in r.text for r in at["passages"].collect()) == 1
    assert ids["passages"] - ids["benchmark"] == {34} and ids["packing"] == ids["benchmark"]


def test_run(spark, folder):
    import corpus_pipeline as P

    assert P.run(spark, folder[0]).count() > 0 and P.ORACLE_SQL is None


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'budgeted_selection_report' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})

"""The pipeline's stages against brute-force versions on the small tables; the entry without it."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline as P
from hashsieve.llm import quality
from hashsieve.llm.common import written
from tests.conftest import SF001
from tests.llm.test_minhash import brute as near_classes

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, rows = docs.schema, {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = written(stage(spark, docs, SF001), f"test-{name}")
        assert docs.schema == columns, name
        rows[name] = ({r.doc_id: r.text for r in before.collect()}, [r.doc_id for r in docs.collect()])
        assert len(rows[name][1]) == len(set(rows[name][1]))
    before, after = rows["quality"]
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    all_docs = spark.read.parquet(f"{SF001}/documents.parquet")
    scores = {r.doc_id: r.score for r in quality.score(all_docs, quality.fit(all_docs, labels)).collect()}
    assert sorted(after) == sorted(i for i, s in scores.items() if s >= 0.3)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & set(after)) >= 0.97 * len(good)
    before, after = rows["exact_dedup"]
    last = {}
    for i, t in before.items():
        last[t.lower()] = max(i, last.get(t.lower(), i))
    assert sorted(after) == sorted(last.values())
    before, after = rows["near_dedup"]
    assert sorted(after) == sorted(i for i, (_, c) in near_classes(list(before.items()), P.NEAR).items() if i == c)
    before, after = rows["mixing"]
    assert set(after) <= set(before) and len(after) > 0.6 * len(before)
    tokens = P.STAGES[-1][1](spark, docs, SF001).collect()
    assert sorted(r.doc_id for r in tokens) == sorted(rows["mixing"][1])


def test_run(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    got = P.run(spark, SF001)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_stages_on_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (2, "", "en", "s", 0, None), (None, "some words of text in a row", "en", "s", 1, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES[:-1]:
            docs = written(stage(spark, docs, SF001), f"test-odd-{name}")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"], name
        assert P.STAGES[-1][1](spark, docs, SF001).count() == docs.count()


@pytest.mark.parametrize("gone", [True, False])
def test_entry_with_and_without_this_folder(gone):
    """In a fresh interpreter, with the folder and the pipeline hidden or not."""
    code = f"""
import sys, json
if {gone}:
    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("hashsieve.llm"):
                raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
    sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    queries, oracles = json.loads(out.stdout.strip().splitlines()[-1])
    mine = {q for q in queries if q.startswith("op") or q == "pipeline"}
    assert len(mine) == (0 if gone else 14) and set(oracles) <= set(queries) and len(queries) > 50


def test_oracles(spark):
    """The queries that SQL can express, side by side with DuckDB."""
    from hashsieve.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    for name, sql in Q.ORACLES.items():
        got = Q.QUERIES[name](spark, SF001)
        columns = sorted(got.columns)
        mine = sorted((tuple(r) for r in got.select(columns).collect()), key=str)
        other = sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=str)
        assert mine == other, name

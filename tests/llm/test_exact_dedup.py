"""Exact dedup against a brute-force grouping, spilling, and the defined edge cases."""

import hashlib
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashsieve.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, kept string, __id int"


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate({c: c + 32 for c in range(65, 91)}), []).append(doc_id)
    out = {}
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, text] = (keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_matches_brute_force_with_small_budget(spark):
    rng = random.Random(3)
    texts = ["", None, "a", "A", "É", "é", "x" * 50_000, "X" * 50_000] + [f"word {i}" for i in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(3000)] + [(3000 + i, "hot text") for i in range(1500)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(7)
    expected = brute(rows)
    for budget in (1000, X.TABLE_BYTES):
        got = X.decisions(df, budget=budget).collect()
        assert len(got) == len(rows)
        by_id = dict(rows)
        for r in got:
            text = (by_id[r.doc_id] or "").translate({c: c + 32 for c in range(65, 91)})
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == expected[r.doc_id, text]
        kept = X.survivors(df, budget=budget)
        assert kept.schema == df.schema
        assert sorted(r.doc_id for r in kept.collect()) == sorted({v[0] for v in expected.values()})
        assert {r.doc_id: r.text for r in kept.collect()} == {i: by_id[i] for i in {v[0] for v in expected.values()}}


def test_grace_spills_recursively_and_equals_a_dict():
    rng = random.Random(5)
    contents = [f"{rng.random()}".encode() * 20 for _ in range(400)]
    records = [X._record(i, 1, rng.choice(contents), None) for i in range(5000)]
    got = sorted((e[0], e[2], e[3]) for e in X.grace(iter(records), budget=3000))
    want = {}
    for digest, _, doc_id, rows, _, _ in records:
        keep, n = want.get(digest, (-1, 0))
        want[digest] = (max(keep, doc_id), n + rows)
    assert got == sorted((d, k, n) for d, (k, n) in want.items())


def test_table_compares_complete_content():
    table = X.ContentTable()
    table.add(b"\0" * 32, b"one", 1, 1, b"one", None)
    table.add(b"\0" * 32, b"two", 2, 1, b"two", None)  # same digest, other content
    table.add(b"\0" * 32, b"one", 3, 1, b"one", None)
    assert sorted((e[1], e[2], e[3]) for e in table.entries) == [(b"one", 3, 2), (b"two", 2, 1)]


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.decisions(empty).count() == 0 and X.survivors(empty).count() == 0
    rows = [(None, "t", "a", 1), (4, "T", "a", 1), (4, "T", "a", 1), (None, "only null", "b", 2), (7, None, None, None), (9, "", "c", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in X.decisions(df).collect()}
    assert got == {(None, 4, 3, False), (4, 4, 3, True), (None, None, 1, True), (7, 9, 2, False), (9, 9, 2, True)}
    kept = X.survivors(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == [(False, 4, "T"), (False, 9, ""), (True, 0, "only null")]
    typed = df.withColumn("at", F.lit("2024-01-01").cast("date")).withColumn("tags", F.array(F.lit("x")))
    assert X.survivors(typed).dtypes == typed.dtypes
    assert isinstance(typed.schema["tags"].dataType, T.ArrayType)

"""DED-5 .. DED-9 and AGG-1: first-seen dedup against a sequential loop."""

import random

import pytest
from pyspark.sql import functions as F

from hashsieve.operators import dedup, reports
from hashsieve.operators.fingerprints import simhash

from .conftest import SF01


def _sequential(rows, threshold, registry=()):
    reg = list(registry)
    out = {}
    for seq, fp in sorted(rows):
        if fp is None:
            out[seq] = "store_with_error"
            continue
        if any(bin((fp ^ r) & ((1 << 64) - 1)).count("1") <= threshold for r in reg):
            out[seq] = "skip_duplicate"
        else:
            out[seq] = "store_unique"
            reg.append(fp)
    return out


def _signed(v):
    return v - (1 << 64) if v >= (1 << 63) else v


def _chains(n, seed):
    rnd = random.Random(seed)
    vals, cur = [], rnd.getrandbits(64)
    for i in range(n):
        if rnd.random() < 0.3:
            cur = rnd.getrandbits(64)
        else:
            for _ in range(rnd.randint(0, 4)):
                cur ^= 1 << rnd.randrange(64)
        vals.append((i * 3 + rnd.randint(0, 2), _signed(cur)))
    return vals


def test_golden_order_matters(spark):
    a, b, c = 0x0, 0x7, 0x3F
    r1 = {r.seq: r.action for r in dedup.greedy_dedup(spark.createDataFrame([(1, a), (2, b), (3, c)], "seq long, fp long")).collect()}
    assert r1 == {1: "store_unique", 2: "skip_duplicate", 3: "store_unique"}
    r2 = {r.seq: r.action for r in dedup.greedy_dedup(spark.createDataFrame([(1, b), (2, a), (3, c)], "seq long, fp long")).collect()}
    assert r2 == {1: "store_unique", 2: "skip_duplicate", 3: "skip_duplicate"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_sequential(spark, seed):
    rows = _chains(300, seed) + [(10_000 + seed, None)]
    df = spark.createDataFrame(rows, "seq long, fp long")
    got = {r.seq: r.action for r in dedup.greedy_dedup(df, 5).collect()}
    assert got == _sequential(rows, 5)


def test_greedy_with_registry(spark):
    rows = _chains(200, 9)
    reg_vals = [fp for _, fp in _chains(40, 10)]
    reg = spark.createDataFrame([(-1000 + i, v) for i, v in enumerate(reg_vals)], "seq long, fp long")
    df = spark.createDataFrame(rows, "seq long, fp long")
    got = {r.seq: r.action for r in dedup.greedy_dedup(df, 5, registry=reg).collect()}
    assert got == _sequential(rows, 5, reg_vals)


def test_duplicate_matches_only_earlier_uniques(spark):
    rows = [(1, 0x0), (2, 0x7), (3, 0x3F), (4, 0x1)]
    res = dedup.greedy_dedup(spark.createDataFrame(rows, "seq long, fp long"))
    m = {r.seq: r for r in dedup.duplicate_matches(res).collect()}
    assert set(m) == {2, 4}
    assert m[2].closest.seq == 1 and m[2].closest.distance == 3
    # row 4 is 1 bit from row 1 and 5 bits from row 3 (a later unique it may still see)
    assert [(x.seq, x.distance) for x in m[4].similar] == [(1, 1), (3, 5)]


def test_check_against_registry(spark):
    reg = spark.createDataFrame([(1, 0x0), (2, 0xFF00)], "seq long, fp long")
    inc = spark.createDataFrame([(10, 0x3), (11, 0xFF0F), (12, None), (13, 0x0FFF_0000)], "seq long, fp long")
    out = {r.seq: r for r in dedup.check_against_registry(inc, reg).collect()}
    assert out[10].action == "skip_duplicate" and out[10].closest.seq == 1
    assert out[11].action == "skip_duplicate" and out[11].closest.distance == 4
    assert out[12].action == "store_with_error"
    assert out[13].action == "store_unique" and out[13].n_similar == 0


def test_documents_golden_counts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    fps = simhash(docs)
    assert fps.select("fp").distinct().count() == 927
    stats = {}
    res = dedup.greedy_dedup(fps, 5, seq="doc_id", stats=stats)
    s = reports.batch_summary(res).collect()[0]
    assert (s.total_processed, s.duplicates_found, s.unique_images, s.errors) == (1000, 107, 893, 0)
    assert abs(s.duplicate_rate - 10.7) < 1e-9


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "seq long, fp long, is_duplicate boolean, action string")
    s = reports.batch_summary(empty).collect()[0]
    assert s.total_processed == 0 and s.duplicate_rate == 0.0
    size = spark.createDataFrame([(0,)], "total_hashes long")
    st = reports.registry_statistics(empty, size, 5)
    rep = reports.dedup_report(st, empty.withColumn("job_id", F.lit("j"))).collect()[0]
    assert rep.duplicate_rate == 0.0
    assert rep.recommendations == ["Low duplicate rate - deduplication is working efficiently"]


def _dense(n_groups, size, seed, flips=2):
    """Groups of distinct near-copies (each within `flips` bits of its centre)."""
    rnd = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n_groups):
        centre = rnd.getrandbits(64)
        for _ in range(size):
            v = centre
            for _ in range(rnd.randint(0, flips)):
                v ^= 1 << rnd.randrange(64)
            rows.append((seq, _signed(v)))
            seq += rnd.randint(1, 3)
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [4, 5])
def test_pivot_rounds_equal_sequential(spark, seed):
    rows = _chains(250, seed) + _dense(3, 60, seed, flips=4) + [(99_999, None)]
    rows = list({s: (s, f) for s, f in rows}.values())
    df = spark.createDataFrame(rows, "seq long, fp long")
    st = {}
    got = {r.seq: r.action for r in dedup.greedy_dedup(df, 5, strategy="pivot", stats=st, hot_bucket_pairs=50).collect()}
    assert got == _sequential(rows, 5) and st["strategy"] == "pivot"


def test_auto_picks_pivot_for_dense_group(spark):
    rows = _dense(1, 1500, 8, flips=3)
    rows = list({s: (s, f) for s, f in rows}.values())
    df = spark.createDataFrame(rows, "seq long, fp long")
    st = {}
    got = {r.seq: r.action for r in dedup.greedy_dedup(df, 5, stats=st).collect()}
    assert st["strategy"] == "pivot" and got == _sequential(rows, 5)
    st2 = {}
    dedup.greedy_dedup(spark.createDataFrame(_chains(100, 1), "seq long, fp long"), 5, stats=st2).count()
    assert st2["strategy"] == "edges"


def test_pivot_rounds_with_block_tables(spark):
    from hashsieve.operators.similarity import KeyScheme
    rows = _chains(200, 12) + _dense(2, 50, 12, flips=4)
    rows = list({s: (s, f) for s, f in rows}.values())
    df = spark.createDataFrame(rows, "seq long, fp long")
    reps = df.groupBy("fp").agg(F.min("seq").alias("rep_seq"))
    state, _ = dedup.pivot_rounds(reps, 5, scheme=KeyScheme(5, 8))
    uniq = {r.node for r in state.filter("unique").collect()}
    want = {s for s, a in _sequential(rows, 5).items() if a == "store_unique"}
    rep_of = {r.rep_seq for r in reps.collect()}
    assert uniq == want & rep_of


def test_auto_picks_edges_for_uniform_fingerprints(spark):
    """Random bucket collisions are not density: 200,000 uniform fingerprints collide thousands of times per bucket."""
    df = spark.range(200_000).select(F.col("id").alias("rep_seq"), F.xxhash64("id").alias("fp"))
    assert dedup.near_pairs_per_row(df, 200_000) < dedup.EDGE_PAIRS_PER_ROW


def test_leader_rounds_of_a_long_chain(spark):
    """One round decides little of a chain; no limit on rounds stops it."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "i long, j long")
    dups, rounds = dedup.leader_rounds(edges)
    assert sorted(r.node for r in dups.collect()) == [1, 3, 5, 7, 9, 11] and rounds == 6
    one, rounds = dedup.leader_rounds(edges.limit(1))
    assert [r.node for r in one.collect()] == [1] and rounds == 1


def test_matches_in_a_registry_numbered_later(spark):
    reg = spark.createDataFrame([(1000, 0), (1001, 0xFFFF)], "seq long, fp long")
    batch = spark.createDataFrame([(1, 1), (2, 0xF0F0F0F000), (3, 0xF0F0F0F001), (4, 0xFFFE)], "seq long, fp long")
    res = dedup.greedy_dedup(batch, registry=reg)
    m = {r.seq: r.closest for r in dedup.duplicate_matches(res, registry=reg).collect()}
    assert {s: (c.distance, c.origin, c.seq) for s, c in m.items()} == {1: (1, 0, 1000), 3: (1, 1, 2), 4: (1, 0, 1001)}


def test_hot_fingerprint_join_is_splittable(spark):
    """The label join has a plain exchange on both sides (what the skew join needs)."""
    reg = spark.range(50).select(F.col("id").alias("seq"), F.xxhash64("id").alias("fp"))
    inc = spark.range(500).select(F.col("id").alias("seq"), F.xxhash64(F.col("id") % 60).alias("fp"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = dedup.check_against_registry(inc, reg, lists=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "HashAggregate" not in plan and plan.count("ENSURE_REQUIREMENTS") >= 2


def test_empty_and_all_identical(spark):
    empty = spark.createDataFrame([], "seq long, fp long")
    assert dedup.greedy_dedup(empty).count() == 0
    assert reports.batch_summary(dedup.greedy_dedup(empty)).collect()[0].total_processed == 0
    same = spark.createDataFrame([(i, 12345) for i in range(50)], "seq long, fp long")
    got = {r.seq: r.action for r in dedup.greedy_dedup(same).collect()}
    assert got[0] == "store_unique" and all(got[i] == "skip_duplicate" for i in range(1, 50))
    m = {r.seq: r for r in dedup.duplicate_matches(dedup.greedy_dedup(same)).collect()}
    assert len(m) == 49 and all(r.closest.seq == 0 and r.closest.distance == 0 for r in m.values())
    none = spark.createDataFrame([(1, None), (2, None)], "seq long, fp long")
    assert {r.action for r in dedup.greedy_dedup(none).collect()} == {"store_with_error"}

"""DED-1 .. DED-4: banded Hamming join against brute force (property tests)."""

import random

import pytest
from pyspark.sql import functions as F

from hashsieve.functions.hashing import hamming_hex, hex_to_long, long_to_hex
from hashsieve.operators.similarity import band_layout, closest_and_similar, similarity_join

from .brute import brute_force_join


def _signed(v):
    return v - (1 << 64) if v >= (1 << 63) else v


def _clustered(n, seed, flips=8):
    """Random 64-bit values with near copies (0..flips bits flipped)."""
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(max(1, n // 4))]
    out = []
    for i in range(n):
        v = rnd.choice(base)
        for _ in range(rnd.randint(0, flips)):
            v ^= 1 << rnd.randrange(64)
        out.append((i, _signed(v)))
    return out


def test_band_layout_covers_all_bits():
    for n in range(1, 12):
        bands = band_layout(n)
        assert sum(b.width for b in bands) == 64
        assert bands[0].offset == 0 and bands[-1].offset + bands[-1].width == 64


def test_hamming_golden(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("zz", "0000000000000000"),
                                ("00000000000000ff", "000000000000000f"), (None, "0000000000000000")], "a string, b string")
    got = [r[0] for r in df.select(hamming_hex("a", "b")).collect()]
    assert got == [64, 64, 4, 64]


def test_hex_round_trip(spark):
    vals = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 0x0123456789ABCDEF]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    rows = df.select("v", long_to_hex("v").alias("h")).select("v", "h", hex_to_long("h").alias("back")).collect()
    for r in rows:
        assert r.v == r.back and len(r.h) == 16
    assert [r.h for r in rows][2] == "ffffffffffffffff"


@pytest.mark.parametrize("threshold", [0, 1, 3, 5, 6])
def test_banded_equals_brute_force(spark, threshold):
    data = _clustered(400, seed=threshold)
    df = spark.createDataFrame(data, "id long, fp long")
    want = {tuple(r) for r in brute_force_join(df, df, threshold, order="lt").select("l_id", "r_id", "distance").collect()}
    got = similarity_join(df, df, threshold, order="lt").select("l_id", "r_id", "distance").collect()
    assert len(got) == len(set(map(tuple, got))), "a pair was emitted twice"
    assert {tuple(r) for r in got} == want


def test_hot_bucket_split_is_exact(spark):
    # every row shares band 0 (same low 11 bits): one hot bucket
    rnd = random.Random(7)
    data = [(i, _signed((rnd.getrandbits(53) << 11) | 0x5A5)) for i in range(300)]
    data += [(300 + i, data[i][1] ^ (1 << (20 + i % 40))) for i in range(100)]
    df = spark.createDataFrame(data, "id long, fp long")
    want = {tuple(r) for r in brute_force_join(df, df, 5, order="lt").select("l_id", "r_id").collect()}
    got = similarity_join(df, df, 5, order="lt", hot_bucket_pairs=10).select("l_id", "r_id").collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == want and len(want) >= 100


def test_two_sided_join_and_closest(spark):
    reg = spark.createDataFrame([(1, 0), (2, 7), (3, 0x3F)], "id long, fp long")
    tgt = spark.createDataFrame([(10, 1), (11, 0x3E), (12, 0x0F0F0F0F0F0F0F00)], "id long, fp long")
    pairs = similarity_join(tgt, reg, 5)
    cs = {r.l_id: r for r in closest_and_similar(pairs).collect()}
    assert cs[10].closest.seq == 1 and cs[10].closest.distance == 1
    assert [(m.seq, m.distance) for m in cs[10].similar] == [(1, 1), (2, 2), (3, 5)]
    assert cs[11].closest.seq == 3 and cs[11].closest.distance == 1
    assert 12 not in cs


def test_null_fingerprints_never_match(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5)], "id long, fp long")
    assert similarity_join(df, df, 5, order="lt").count() == 0


@pytest.mark.parametrize("threshold,blocks", [(5, 7), (5, 8), (5, 10), (3, 6), (1, 4), (0, 2)])
def test_table_join_equals_brute_force(spark, threshold, blocks):
    from hashsieve.operators.similarity import table_join
    data = _clustered(300, seed=blocks * 10 + threshold)
    df = spark.createDataFrame(data, "id long, fp long")
    want = {tuple(r) for r in brute_force_join(df, df, threshold, order="lt").select("l_id", "r_id", "distance").collect()}
    for hot in (4_000_000, 3):  # with and without splitting hot buckets
        got = table_join(df, df, threshold, blocks, order="lt", hot_bucket_pairs=hot).select("l_id", "r_id", "distance").collect()
        assert len(got) == len(set(map(tuple, got))), "a pair was emitted twice"
        assert {tuple(r) for r in got} == want


def test_choose_blocks_grows_with_rows():
    from hashsieve.operators.similarity import choose_blocks
    assert choose_blocks(10_000, 10_000, 5) == 6
    assert choose_blocks(5_000_000, 5_000_000, 5) == 6
    assert 6 < choose_blocks(10**8, 10**8, 5) <= choose_blocks(10**10, 10**10, 5)


def test_hot_buckets_of_tables_are_split(spark):
    """Every row agrees on three of eight blocks: without splitting, one key of a table would hold all of them."""
    from hashsieve.operators.similarity import KeyScheme, scheme_join
    rnd = random.Random(3)
    data = [(i, _signed((rnd.getrandbits(40) << 24) | 0xABCDEF)) for i in range(400)]
    data += [(400 + i, _signed((data[i][1] & ((1 << 64) - 1)) ^ (1 << (24 + i % 40)))) for i in range(200)]
    df = spark.createDataFrame(data, "id long, fp long")
    scheme = KeyScheme(5, 8)
    keyed = scheme.tables(df)
    hot = scheme.hot(keyed, None, (600, 600), 1000)
    assert hot is not None
    rows = scheme.split(keyed, hot).groupBy("tbl", "tkey", "sub", "skey").count()
    assert keyed.groupBy("tbl", "tkey").count().agg(F.max("count")).first()[0] == 600
    assert rows.agg(F.max("count")).first()[0] < 100
    want = {tuple(r) for r in brute_force_join(df, df, 5, order="lt").select("l_id", "r_id").collect()}
    got = [tuple(r) for r in scheme_join(df, df, scheme, (600, 600), order="lt", hot_bucket_pairs=1000).select("l_id", "r_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_auto_join_switches_to_tables_and_stays_exact(spark):
    from hashsieve.operators.similarity import KeyScheme, auto_join
    assert KeyScheme.for_rows(5, 10**8).kind == "tables"
    data = _clustered(250, seed=77)
    df = spark.createDataFrame(data, "id long, fp long")
    want = {tuple(r) for r in brute_force_join(df, df, 5, order="lt").select("l_id", "r_id").collect()}
    big = auto_join(df, df, 5, order="lt", rows=(10**8, 10**8)).select("l_id", "r_id").collect()
    small = auto_join(df, df, 5, order="lt").select("l_id", "r_id").collect()
    assert {tuple(r) for r in big} == want == {tuple(r) for r in small}
    assert len(big) == len(want)


def test_banded_join_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    longs = st.sampled_from([0, -1, 1, -(1 << 63), (1 << 63) - 1]) | st.integers(-(1 << 63), (1 << 63) - 1)

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(longs, min_size=1, max_size=40), st.lists(st.integers(0, 63), max_size=40), st.integers(0, 6))
    def check(base, flips, t):
        vals = list(base) + [_signed((base[i % len(base)] ^ (1 << f)) & ((1 << 64) - 1)) for i, f in enumerate(flips)]
        df = spark.createDataFrame(list(enumerate(vals)), "id long, fp long")
        want = {tuple(r) for r in brute_force_join(df, df, t, order="lt").select("l_id", "r_id").collect()}
        got = similarity_join(df, df, t, order="lt", hot_bucket_pairs=4).select("l_id", "r_id").collect()
        assert len(got) == len(set(map(tuple, got))) and {tuple(r) for r in got} == want

    check()


def test_buckets_of_some_hundred_rows_are_split_by_default(spark):
    """A bucket costs its square: 400 rows in one are split without being told to, with the same pairs."""
    from hashsieve.operators.similarity import KeyScheme
    df = spark.range(400).select("id", F.xxhash64("id").bitwiseAND(F.lit(~0x7FF)).alias("fp"))
    df = df.unionByName(df.filter("id < 20").select((F.col("id") + 1000).alias("id"), F.col("fp").bitwiseXOR(F.lit(1 << 40)).alias("fp")))
    scheme = KeyScheme(5)
    from hashsieve.operators.similarity import DEFAULT_HOT_BUCKET_PAIRS
    assert scheme.hot(scheme.tables(df), None, (420, 420), DEFAULT_HOT_BUCKET_PAIRS).collect() == [(0, 0)]
    pairs = similarity_join(df, df, 5, order="lt").select("l_id", "r_id").collect()
    assert sorted(map(tuple, pairs)) == [(k, k + 1000) for k in range(20)]

"""STR-1 .. STR-8 and MTH-1 .. MTH-4 golden rows (worked from the rules)."""

import pytest
from pyspark.sql import functions as F

from hashsieve.functions import numeric as N
from hashsieve.functions import strings as S
from hashsieve.functions.hashing import content_digest


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).collect()[0].r


@pytest.mark.parametrize("raw,want", [("  Metal -- Cards! ", "metal_cards"), ("!!!", ""), ("Nfc2Go", "nfc2go"),
                                      ("__a__b__", "a_b")])
def test_normalize_type(spark, raw, want):
    assert one(spark, S.normalize_type("x"), raw) == want


@pytest.mark.parametrize("raw,want", [("nfc2go_cards", "Nfc2Go Cards"), ("metal_cards", "Metal Cards"), ("a1b", "A1B")])
def test_display_name(spark, raw, want):
    assert one(spark, S.display_name("x"), raw) == want


def test_public_id(spark):
    df = spark.createDataFrame([("My Art v1.2.psd", "standees")], "f string, t string")
    pid, folder = S.public_id("f", "t")
    r = df.select(pid.alias("p"), folder.alias("d")).collect()[0]
    assert (r.p, r.d) == ("product_My_Art_v1_2", "products/standees")


@pytest.mark.parametrize("name,a,b,c", [("card.front.psd", "card.front.jpeg", "card.front.jpeg", "card.front.jpg"),
                                        (".psd", ".jpeg", ".psd.jpeg", ".psd.jpg"),
                                        ("card", "card.jpeg", "card.jpeg", "card.jpg")])
def test_output_names(spark, name, a, b, c):
    assert one(spark, S.catalogue_name("x"), name) == a
    assert one(spark, S.converted_name("x", F.lit("jpeg")), name) == b
    assert one(spark, S.output_file_name("x", F.lit("jpeg")), name) == c


@pytest.mark.parametrize("name,ext,ok", [("card", "card", False), ("A.PSD", "psd", True), ("a.", "", False), ("", "", False)])
def test_extension(spark, name, ext, ok):
    assert one(spark, S.extension("x"), name) == ext
    assert one(spark, S.has_allowed_extension("x", ["psd"]), name) is ok


@pytest.mark.parametrize("raw,want", [("a<b>:c?.psd ", "a_b__c_.psd"), (" .. ", "untitled"), ('x"y|z*', "x_y_z_"),
                                      ("back\\slash", "back_slash")])
def test_sanitize(spark, raw, want):
    assert one(spark, S.sanitize_filename("x"), raw) == want


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023.0 B"), (1280, "1.2 KB"), (1536, "1.5 KB"),
                                    (1024 ** 3 * 3, "3.0 GB"), (1024 ** 5 * 2, "2048.0 TB")])
def test_human_size(spark, n, want):
    assert one(spark, S.human_size("x"), n, "x long") == want


def test_hash_filename(spark):
    df = spark.createDataFrame([("dir/card.psd", "0123456789abcdef", "2024-01-02 03:04:05"), ("card", "ffffffffffffffff", "2024-01-02 03:04:05")],
                               "p string, h string, t string")
    got = [r.n for r in df.select(S.hash_filename("p", "h", F.to_timestamp("t")).alias("n")).collect()]
    assert got == ["01234567_card_20240102_030405.psd", "ffffffff_card_20240102_030405."]


def test_sha256_golden(spark):
    assert one(spark, content_digest("x"), "a") == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    assert one(spark, content_digest("x", "md5"), None) == ""


@pytest.mark.parametrize("i,o,want", [(200, 25, 87.5), (100, 150, -50.0), (0, 10, 0.0), (3, 1, 66.67), (8, 7, 12.5)])
def test_compression_ratio(spark, i, o, want):
    df = spark.createDataFrame([(i, o)], "i long, o long")
    assert df.select(N.compression_ratio("i", "o").alias("r")).collect()[0].r == want


def test_py_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (2.675,)], "x double")
    got = [r.r for r in df.select(N.py_round("x", 2).alias("r")).collect()]
    assert got == [round(0.125, 2), round(0.375, 2), round(-0.125, 2), 2.68]  # 2.675*100 rounds up in IEEE


@pytest.mark.parametrize("w,h,q,want", [(100, 50, 90, 15000), (100, 50, 75, 10000), (101, 33, 50, 4999), (10, 10, 49, 100),
                                        (0, 10, 90, None)])
def test_estimate_bytes(spark, w, h, q, want):
    df = spark.createDataFrame([(w, h, q)], "w int, h int, q int")
    assert df.select(N.estimate_bytes("w", "h", "q").alias("r")).collect()[0].r == want


@pytest.mark.parametrize("w,h,q,want", [(4000, 3000, 20, (1920, 1440)), (4000, 3000, 40, (2048, 1536)),
                                        (2048, 100, 49, (2048, 100)), (9000, 9000, 60, (9000, 9000))])
def test_low_quality_target(spark, w, h, q, want):
    df = spark.createDataFrame([(w, h, q)], "w int, h int, q int")
    nw, nh = N.low_quality_target("w", "h", "q")
    r = df.select(nw.alias("a"), nh.alias("b")).collect()[0]
    assert (r.a, r.b) == want


@pytest.mark.parametrize("w,h,m,want", [(4000, 3000, 2000, (2000, 1500)), (3000, 4000, 2000, (1500, 2000)),
                                        (100, 50, 2000, (100, 50)), (5000, 1, 100, (100, 1)), (1001, 1000, 100, (100, 100))])
def test_cap_resolution(spark, w, h, m, want):
    df = spark.createDataFrame([(w, h)], "w int, h int")
    nw, nh = N.cap_resolution("w", "h", F.lit(m))
    r = df.select(nw.alias("a"), nh.alias("b")).collect()[0]
    assert (r.a, r.b) == want


def test_subsampling_and_extension(spark):
    df = spark.createDataFrame([(95, "jpeg"), (80, "jpeg"), (10, "jpeg"), (95, "webp"), (95, "gif")], "q int, f string")
    got = [(r.s, r.e) for r in df.select(N.subsampling("q", "f").alias("s"), N.format_extension("f").alias("e")).collect()]
    assert got == [(0, "jpg"), (1, "jpg"), (2, "jpg"), (None, "webp"), (None, None)]


def test_tokens_equal_letter_digit_runs(spark):
    from hashsieve.operators.fingerprints import TOKEN_PATTERN, tokens
    texts = ["", "   ", "--Hello, World!! hello", "Straße 12ab ÉCOLE école", "日本語テキスト and 中文", "a_b-c.d", None, "x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0))
    rows = df.select(F.sort_array(tokens("text")).alias("a"), F.sort_array(want).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert rows[2].a == ["hello", "world"]

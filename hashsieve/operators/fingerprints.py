"""Fingerprint jobs over tables (FPR-1, FPR-2, FPR-7, FPR-8).

Image decoding jobs (FPR-3..FPR-6) live in ``image_hashes.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

from ..functions.hashing import (average_hash_array, content_digest, difference_hash_array, long_to_hex,
                                 md5_prefix_long, pack_bits)

# Fixed value: a token is a maximal run of Unicode letters and digits, matched
# after lower-casing the text.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
SEPARATOR_PATTERN = r"[^\p{L}\p{N}]+"


def tokens(text_col: str = "text"):
    """Distinct lower-cased word tokens of a text column, as an array.

    Splitting on separator runs gives the same tokens as extracting letter/digit
    runs (after dropping the empty edge pieces) and is cheaper.
    """
    pieces = F.split(F.lower(F.col(text_col)), SEPARATOR_PATTERN)
    return F.array_distinct(F.array_remove(pieces, ""))


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "fp",
            keep: list[str] | None = None) -> DataFrame:
    """FPR-8: 64-bit SimHash of each row's text.

    Token hash = first 64 bits of md5(token).  Bit i of the fingerprint is set
    when more than half of the row's distinct tokens have bit i set.  A text
    without tokens gets fingerprint 0; a NULL text gets NULL (an error row
    downstream).  ``keep`` columns must be functionally dependent on ``key``
    (they ride along in the grouping key).

    Plan: explode (narrow) -> 32 partial sums per key (two bit counters per sum)
    in a codegen'd hash aggregate -> one exchange of one small row per key and
    map task.  All JVM
    side; the text itself never crosses a shuffle.
    """
    keys = [key] + list(keep or [])
    df = spread(df.select(*keys, text))
    toks = df.select(*keys, F.col(text).isNull().alias("_missing"), F.explode_outer(tokens(text)).alias("_tok"))
    hashed = toks.select(*keys, "_missing", md5_prefix_long("_tok").alias("_h"))
    # Two counters per sum ("lanes"): (h >>> i) & (1 | 1 << 32) puts bit i in the
    # low half and bit i + 32 in the high half, so 32 sums count all 64 bits.  A
    # Spark string is < 2 GB, so a row has < 2^30 tokens: no lane can overflow.
    lanes = F.lit((1 << 32) | 1).cast("long")
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(lanes)).alias(f"_s{i}") for i in range(32)]
    agg = hashed.groupBy(*keys).agg(F.max("_missing").alias("_missing"), F.count("_h").alias("n_tokens"), *sums)

    def ones(bit: int):
        v = F.col(f"_s{bit % 32}")
        return F.shiftrightunsigned(v, 32) if bit >= 32 else v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    bits = [F.when(F.coalesce(ones(i), F.lit(0)) * 2 > F.col("n_tokens"), 1).otherwise(0) for i in range(64)]
    fp = F.when(~F.col("_missing"), pack_bits(bits))
    return agg.select(*keys, fp.alias(out), "n_tokens")


def array_hashes(df: DataFrame, grid: str = "embedding", size: int = 8) -> DataFrame:
    """FPR-1 and FPR-2 on grids stored as arrays (row-major, ``size x size``)."""
    return df.withColumn("ahash", average_hash_array(grid, size)).withColumn("dhash", difference_hash_array(grid, size))


def digests(df: DataFrame, content: str = "content") -> DataFrame:
    """FPR-7: md5 / sha1 / sha256 of a content column; '' when missing."""
    return (df.withColumn("md5", content_digest(content, "md5"))
              .withColumn("sha1", content_digest(content, "sha1"))
              .withColumn("sha256", content_digest(content, "sha256")))


def with_hex(df: DataFrame, col: str = "fp", out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_hex", long_to_hex(col))

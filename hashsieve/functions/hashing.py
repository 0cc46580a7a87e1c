"""Fingerprint expressions: 64-bit hashes as signed ``LONG`` columns.

Inside Spark a fingerprint is a ``LONG`` (two's complement), so distance is
``bit_count(a ^ b)`` and stays in whole-stage codegen.  Hex strings (16 lower-case
digits, most significant first) exist only at the edges: registry files, reports
and the SQL oracle, where signed/unsigned handling differs between engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64

# A well-formed fingerprint is 16 hexadecimal digits.
HEX_PATTERN = "^[0-9a-fA-F]{16}$"
# Fixed value: distance reported when either side cannot be read.
MALFORMED_DISTANCE = 64
# Fixed value: default Hamming threshold (inclusive).
DEFAULT_THRESHOLD = 5


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_long(c) -> Column:
    """16 hex digits -> signed LONG; anything else -> NULL.

    ``conv`` alone turns garbage into 0, so the pattern guard comes first.
    """
    c = _c(c)
    return F.when(c.rlike(HEX_PATTERN), F.conv(F.lower(c), 16, -10).cast("long"))


def long_to_hex(c) -> Column:
    """Signed LONG -> 16 lower-case hex digits (NULL stays NULL)."""
    return F.lpad(F.lower(F.hex(_c(c))), 16, "0")


def hamming(a, b) -> Column:
    """Hamming distance of two LONG fingerprints; 64 when either is NULL (DED-1)."""
    return F.coalesce(F.bit_count(_c(a).bitwiseXOR(_c(b))), F.lit(MALFORMED_DISTANCE))


def hamming_hex(a, b) -> Column:
    """DED-1 on hex strings: malformed input on either side gives 64."""
    return hamming(hex_to_long(a), hex_to_long(b))


def md5_prefix_long(c) -> Column:
    """First 64 bits of md5 as a signed LONG: the token hash used by SimHash."""
    return F.conv(F.substring(F.md5(_c(c)), 1, 16), 16, -10).cast("long")


def content_digest(c, algorithm: str = "sha256") -> Column:
    """FPR-7: hex digest of bytes/strings; empty string when the input is missing."""
    c = _c(c)
    algorithm = algorithm.lower()
    if algorithm == "sha256":
        d = F.sha2(c, 256)
    elif algorithm == "sha1":
        d = F.sha1(c)
    elif algorithm == "md5":
        d = F.md5(c)
    else:
        raise ValueError(f"unsupported digest: {algorithm}")
    return F.coalesce(d, F.lit(""))


def pack_bits(bits: list[Column]) -> Column:
    """OR together ``bits[i] << i`` (bits are 0/1 INT/LONG columns, bit 0 first)."""
    terms = [F.shiftleft(b.cast("long"), i) for i, b in enumerate(bits)]
    return reduce(lambda x, y: x.bitwiseOR(y), terms)


def _shl1(bits: Column) -> Column:
    """``1L << bits`` for a column shift amount."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def average_hash_array(c, size: int = 8) -> Column:
    """FPR-1 on a row-major grey grid stored as an array of ``size*size`` numbers.

    Bit = cell > mean of the grid; the first cell is the most significant bit.
    Pure higher-order SQL functions, no Python on the executors.
    """
    c = _c(c)
    n = size * size
    total = F.aggregate(c, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))
    mean = total / F.lit(float(n))
    flags = F.transform(c, lambda x, i: F.when(x.cast("double") > mean, _shl1(F.lit(n - 1) - i))
                        .otherwise(F.lit(0).cast("long")))
    return F.when(F.size(c) == n, F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def difference_hash_array(c, size: int = 8) -> Column:
    """FPR-2 on a ``size x size`` row-major grid: bit = right cell > left cell.

    A square grid gives ``size-1`` comparisons per row (56 bits for 8x8); the first
    comparison is the most significant bit.
    """
    c = _c(c)
    per_row = size - 1
    nbits = size * per_row
    idx = F.sequence(F.lit(0), F.lit(nbits - 1))

    def bit(k):
        row = F.floor(k / per_row).cast("int")
        col = k - row * per_row
        left = F.element_at(c, row * size + col + 1).cast("double")
        right = F.element_at(c, row * size + col + 2).cast("double")
        return F.when(right > left, _shl1(F.lit(nbits - 1) - k)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(c) == size * size,
                  F.aggregate(F.transform(idx, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))

"""Hamming-threshold joins over 64-bit fingerprints (DED-2, DED-3, DED-4).

A join on ``bit_count(a ^ b) <= t`` is a theta join; Spark would run it as a
nested loop.  It is rewritten as an *exact* equi-join on masked fingerprints:

* Split the 64 bits into ``b > t`` blocks.  Two fingerprints at distance <= t differ
  in at most t blocks, so they agree on at least ``k = b - t`` of them.  One
  table per combination of k blocks, keyed by ``fp & mask`` of the combination, brings
  every such pair together (pigeonhole).  ``b = t + 1`` gives t + 1 tables of one
  block each (*bands*); larger b gives more tables with longer, rarer keys.
* Every row is exploded into its table keys, equi-joined, and verified.  A pair is
  kept only in the table of the first k blocks on which it agrees, a row-level
  predicate instead of a ``distinct`` (another shuffle).
* Hot buckets.  A template can put very many rows under one key.  Buckets whose
  pair count exceeds ``hot_bucket_pairs`` are split again, in every table layout: the bits
  outside the table's mask must still be within t, so they are cut into t + 1
  parts, each a second-level key, and the pigeonhole argument applies once
  more.  Recall stays exact.
* The layout follows from exact row counts and a cost model; all layouts give the same pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import DEFAULT_THRESHOLD, HASH_BITS
from ..session import cut_lineage

# Default pair budget per bucket before it is split a second time: splitting writes each row six times, the pairs of
# some 300 rows cost about as much.  A larger budget lets the join grow with the square of the rows up to it.
DEFAULT_HOT_BUCKET_PAIRS = 100_000
KEY = ["tbl", "tkey", "sub", "skey"]


@dataclass(frozen=True)
class Band:
    index: int
    offset: int  # lowest bit
    width: int

    @property
    def mask(self) -> int:
        """The block's bits, in place."""
        return ((1 << self.width) - 1) << self.offset


def band_layout(n_bands: int, bits: int = HASH_BITS) -> list[Band]:
    """Split ``bits`` into ``n_bands`` contiguous bands, wider bands first."""
    if not 1 <= n_bands <= bits:
        raise ValueError("need 1..bits bands")
    base, extra = divmod(bits, n_bands)
    out, off = [], 0
    for i in range(n_bands):
        w = base + (1 if i < extra else 0)
        out.append(Band(i, off, w))
        off += w
    return out


def _long(mask: int) -> Column:
    """A 64-bit mask as a signed LONG literal."""
    return F.lit(mask - (1 << 64) if mask >= (1 << 63) else mask).cast("long")


def _longs(masks: list[int]) -> Column:
    return F.array(*[_long(m) for m in masks])


def _parts(mask: int, n: int) -> list[int]:
    """The bits outside ``mask`` cut into n masks of nearly equal size; empty if there are fewer bits."""
    bits = [i for i in range(HASH_BITS) if not mask >> i & 1]
    if len(bits) < n:
        return []
    base, extra = divmod(len(bits), n)
    out, at = [], 0
    for i in range(n):
        w = base + (i < extra)
        out.append(sum(1 << b for b in bits[at:at + w]))
        at += w
    return out


def table_count(blocks: int, threshold: int) -> int:
    return comb(blocks, blocks - threshold)


# Below this many rows on the larger side the t + 1 bands, with hot buckets split a second
# time, keep buckets small; more tables only pay off beyond it.
MIN_ROWS_FOR_TABLES = 10_000_000
MAX_BLOCKS = 10  # 252 tables for t = 5, chosen up to about 10^11 rows


def choose_blocks(n_left: int, n_right: int, threshold: int = DEFAULT_THRESHOLD, max_blocks: int = MAX_BLOCKS,
                  row_cost: float = 10.0) -> int:
    """Pick the block count from a cost model: rows written to the shuffle
    (``tables x (n_left + n_right)``, weighted by ``row_cost``) plus expected
    candidate pairs of random fingerprints (``tables x n_left x n_right / 2^key_bits``)."""
    if max(n_left, n_right) < MIN_ROWS_FOR_TABLES:
        return threshold + 1
    best, best_cost = threshold + 1, None
    for b in range(threshold + 1, min(HASH_BITS, max(threshold + 1, max_blocks)) + 1):
        widths = sorted(blk.width for blk in band_layout(b))[:b - threshold]  # shortest key of a table
        tables = table_count(b, threshold)
        cost = tables * (n_left + n_right) * row_cost + tables * float(n_left) * float(n_right) / 2.0 ** sum(widths)
        if best_cost is None or cost < best_cost:
            best, best_cost = b, cost
    return best


class KeyScheme:
    """How fingerprints are keyed: ``blocks`` blocks, a table per combination of ``blocks - t`` of them."""

    def __init__(self, threshold: int, blocks: int | None = None):
        if not 0 <= threshold < HASH_BITS:
            raise ValueError("threshold must be in 0..63")
        blocks = blocks or threshold + 1
        if not threshold + 1 <= blocks <= HASH_BITS:
            raise ValueError("need threshold + 1 <= blocks <= 64")
        self.t, self.blocks, self.k = threshold, blocks, blocks - threshold
        self.kind = "tables" if self.k > 1 else "bands"
        self.layout = band_layout(blocks)
        self.combos = list(combinations(range(blocks), self.k))
        self.masks = [sum(self.layout[i].mask for i in c) for c in self.combos]
        parts = [_parts(m, threshold + 1) for m in self.masks]
        self.parts = parts if all(parts) else None  # near t = 63 too few bits are left to split by

    @classmethod
    def for_rows(cls, threshold: int, n_left: int, n_right: int | None = None) -> "KeyScheme":
        return cls(threshold, choose_blocks(n_left, n_right if n_right is not None else n_left, threshold))

    def tables(self, df: DataFrame, fp: str = "fp") -> DataFrame:
        """One row per table: ``tbl`` and ``tkey``, the fingerprint masked to the table's blocks."""
        return df.select("*", F.posexplode(F.array(*[F.col(fp).bitwiseAND(_long(m)) for m in self.masks])).alias("tbl", "tkey"))

    def hot(self, left: DataFrame, right: DataFrame | None, rows: tuple[int, int], hot_bucket_pairs: int | None) -> DataFrame | None:
        """Buckets to split, written (a bucket count is one small row); None when no bucket can be hot.

        ``left`` and ``right`` (None: a self-join) are the outputs of ``tables``.
        """
        if hot_bucket_pairs is None or self.parts is None or rows[0] * rows[1] <= hot_bucket_pairs:
            return None
        n = left.groupBy("tbl", "tkey").agg(F.count(F.lit(1)).alias("nl"))
        if right is None:
            n = n.withColumn("nr", F.col("nl"))
        else:
            n = n.join(right.groupBy("tbl", "tkey").agg(F.count(F.lit(1)).alias("nr")), ["tbl", "tkey"])
        found = cut_lineage(n.filter(F.col("nl") * F.col("nr") > F.lit(hot_bucket_pairs)).select("tbl", "tkey"))
        return None if found.isEmpty() else found

    def split(self, keyed: DataFrame, hot: DataFrame | None, fp: str = "fp") -> DataFrame:
        """Second-level keys ``sub``, ``skey``: one per part of the remaining bits in hot buckets, -1 and 0 elsewhere."""
        if hot is None:
            return keyed.withColumns({"sub": F.lit(-1), "skey": F.lit(0).cast("long")})
        n = self.t + 1
        keyed = keyed.join(hot.withColumn("_hot", F.lit(True)), ["tbl", "tkey"], "left")
        flat = _longs([m for parts in self.parts for m in parts])
        subs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.struct(
            s.alias("sub"), F.col(fp).bitwiseAND(F.get(flat, F.col("tbl") * n + s)).alias("skey")))
        plain = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("skey")))
        return keyed.withColumn("_s", F.explode(F.when(F.col("_hot"), subs).otherwise(plain))).select("*", "_s.sub", "_s.skey").drop("_s", "_hot")

    def canonical(self, x: Column, split: bool) -> Column:
        """True on the one bucket row where a pair within t is counted; ``x`` is ``a ^ b``."""
        agree = None
        for i, blk in enumerate(self.layout):
            bit = F.when(x.bitwiseAND(_long(blk.mask)) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
            agree = bit if agree is None else agree.bitwiseOR(bit)
        first = F.lit(0).cast("long")
        for _ in range(self.k):  # the k lowest bits that are set
            rest = agree.bitwiseAND(F.bitwise_not(first))
            first = first.bitwiseOR(rest.bitwiseAND(-rest)) if self.k > 1 else rest.bitwiseAND(-rest)
        combo = F.get(F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for c in self.combos]), F.col("tbl"))
        keep = first == combo
        if not split:
            return keep
        n = self.t + 1
        flat = _longs([m for parts in self.parts for m in parts])
        first_sub = F.coalesce(*[F.when(x.bitwiseAND(F.get(flat, F.col("tbl") * n + s)) == 0, F.lit(s)) for s in range(n)])
        return keep & ((F.col("sub") < 0) | (F.col("sub") == first_sub))


def _side(df: DataFrame, id_col: str, fp: str, prefix: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{prefix}_id"), F.col(fp).alias(f"{prefix}_fp")).filter(F.col(f"{prefix}_fp").isNotNull())


def scheme_join(left: DataFrame, right: DataFrame, scheme: KeyScheme, rows: tuple[int, int], left_id: str = "id", right_id: str = "id",
                fp: str = "fp", order: str | None = None, hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS) -> DataFrame:
    """All pairs within the scheme's threshold: ``l_id, l_fp, r_id, r_fp, distance``, each once."""
    lk, rk = scheme.tables(_side(left, left_id, fp, "l"), "l_fp"), scheme.tables(_side(right, right_id, fp, "r"), "r_fp")
    same = left is right and left_id == right_id
    pairs = scheme_pairs(lk, rk, scheme, rows, hot_bucket_pairs, same, F.col("l_id") < F.col("r_id") if order == "lt" else None)
    return pairs.select("l_id", "l_fp", "r_id", "r_fp", F.bit_count(F.col("l_fp").bitwiseXOR(F.col("r_fp"))).cast("int").alias("distance"))


def scheme_pairs(lk: DataFrame, rk: DataFrame, scheme: KeyScheme, rows: tuple[int, int], hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS,
                 same: bool = False, condition: Column | None = None) -> DataFrame:
    """Rows of two sides that are keyed by the scheme's tables (``tbl, tkey``, fingerprints ``l_fp`` and ``r_fp``), joined where
    they lie within its threshold, each pair once."""
    hot = scheme.hot(lk, None if same else rk, rows, hot_bucket_pairs)
    keys = KEY if hot is not None else KEY[:2]
    if hot is not None:
        lk, rk = scheme.split(lk, hot, "l_fp"), scheme.split(rk, hot, "r_fp")
    pairs = lk.join(rk, keys)
    if condition is not None:
        pairs = pairs.filter(condition)
    x = F.col("l_fp").bitwiseXOR(F.col("r_fp"))
    # the cheap distance test comes first; few pairs pass it
    return pairs.filter((F.bit_count(x) <= scheme.t) & scheme.canonical(x, hot is not None))


def similarity_join(left: DataFrame, right: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                    left_id: str = "id", right_id: str = "id", fp: str = "fp",
                    order: str | None = None, hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS,
                    rows: tuple[int, int] | None = None) -> DataFrame:
    """All pairs ``(l, r)`` with ``hamming(l.fp, r.fp) <= threshold`` (DED-2).

    Returns ``l_id, l_fp, r_id, r_fp, distance``.  ``order='lt'`` keeps only
    ``l_id < r_id`` (self-join edges from earlier to later).  Rows with a NULL
    fingerprint never match.  Exact for any threshold below 64.  The layout follows
    from the row counts: ``rows`` when the caller knows them, else they are counted.
    """
    if not 0 <= threshold < HASH_BITS:
        raise ValueError("threshold must be in 0..63")
    if rows is None:
        n = left.count()
        rows = (n, n if left is right else right.count())
    return scheme_join(left, right, KeyScheme.for_rows(threshold, *rows), rows, left_id, right_id, fp, order, hot_bucket_pairs)


auto_join = similarity_join


def table_join(left: DataFrame, right: DataFrame, threshold: int, blocks: int,
               left_id: str = "id", right_id: str = "id", fp: str = "fp", order: str | None = None,
               hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS) -> DataFrame:
    """DED-2 with a given number of blocks."""
    n = left.count()
    rows = (n, n if left is right else right.count())
    return scheme_join(left, right, KeyScheme(threshold, blocks), rows, left_id, right_id, fp, order, hot_bucket_pairs)


def match_struct(distance="distance", seq="r_id", fp="r_fp") -> Column:
    """Sort key and payload of one match: (distance, registered order, fingerprint)."""
    return F.struct(F.col(distance).alias("distance"), F.col(seq).alias("seq"), F.col(fp).alias("fp"))


def closest_and_similar(pairs: DataFrame) -> DataFrame:
    """DED-3 and DED-4 per left id from ``similarity_join`` output.

    ``closest`` is the nearest match, ties going to the earlier-registered one;
    ``similar`` is every match in that same order.
    """
    m = match_struct()
    return (pairs.groupBy("l_id")
            .agg(F.min(m).alias("closest"), F.sort_array(F.collect_list(m)).alias("similar")))

"""Size and ratio rules as native expressions (MTH-1 .. MTH-4).

Rounding: Python's ``round`` is half-even on the exact binary value, Spark's
``round``/``bround`` work on the shortest decimal form, DuckDB multiplies first.
``py_round`` spells one rule out in plain IEEE arithmetic (scale, floor,
compare the remainder with 0.5, ties to even), so every engine that evaluates
the same SQL text gets the same double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Bytes-per-pixel tiers of the size estimate: (lowest quality, bpp), best first.
BPP_TIERS = [(90, 3.0), (75, 2.0), (50, 1.5), (0, 1.0)]
# Low-quality downscale: below quality 50, images with a side over 2048 are
# fitted into 1920 (quality < 30) or 2048.
DOWNSCALE_QUALITY = 50
DOWNSCALE_SIDE = 2048
DOWNSCALE_SMALL_QUALITY = 30
DOWNSCALE_SMALL_SIDE = 1920
# JPEG chroma subsampling tiers: (lowest quality, tier).
SUBSAMPLING_TIERS = [(90, 0), (75, 1), (0, 2)]
# Output formats that can be encoded, and the file extension of each.
FORMAT_EXTENSIONS = {"jpeg": "jpg", "webp": "webp", "avif": "avif"}
# ------------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round_sql(x: str, digits: int) -> str:
    """SQL text for half-even rounding of a DOUBLE expression ``x`` (same text
    runs in Spark SQL and DuckDB)."""
    s = f"{float(10 ** digits)!r}"
    y = f"(abs({x}) * {s})"
    f = f"floor{y}"
    up = f"(CASE WHEN {y} - {f} > 0.5 THEN 1.0 WHEN {y} - {f} < 0.5 THEN 0.0 " \
         f"WHEN {f} - 2.0 * floor({f} / 2.0) = 1.0 THEN 1.0 ELSE 0.0 END)"
    return f"(sign({x}) * ({f} + {up}) / {s})"


def py_round(c, digits: int) -> Column:
    """Half-even rounding of ``c`` times ``10^digits``, computed in double.

    It differs from Python's ``round`` only where the decimal value is a tie but the
    double is not: ``round(0.015, 2)`` is 0.01 there, and 0.02 here, because 0.015 * 100
    is exactly 1.5 in double.
    """
    col = _c(c).cast("double")
    s = float(10 ** digits)
    y = F.abs(col) * F.lit(s)
    f = F.floor(y).cast("double")
    rem = y - f
    up = (F.when(rem > 0.5, F.lit(1.0)).when(rem < 0.5, F.lit(0.0))
          .when(f - F.lit(2.0) * F.floor(f / F.lit(2.0)) == F.lit(1.0), F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.signum(col) * (f + up) / F.lit(s)


def compression_ratio(original, converted) -> Column:
    """MTH-1: ``round((1 - out/in) * 100, 2)``, 0 when ``in`` is 0 (may be negative)."""
    o, c = _c(original).cast("double"), _c(converted).cast("double")
    raw = (F.lit(1.0) - c / o) * F.lit(100.0)
    return F.when(o > 0, py_round(raw, 2)).otherwise(F.lit(0.0))


def bytes_per_pixel(quality) -> Column:
    q = _c(quality)
    chain = None
    for lo, bpp in BPP_TIERS:
        if chain is None:
            chain = F.when(q >= lo, F.lit(bpp))
        elif lo > 0:
            chain = chain.when(q >= lo, F.lit(bpp))
        else:
            chain = chain.otherwise(F.lit(bpp))
    return chain


def estimate_bytes(width, height, quality) -> Column:
    """MTH-2: ``int(width * height * bpp(quality))``; NULL when the size is unknown."""
    w, h = _c(width), _c(height)
    px = (w.cast("long") * h.cast("long")).cast("double")
    return F.when(w.isNotNull() & h.isNotNull() & (w > 0) & (h > 0),
                  F.floor(px * bytes_per_pixel(quality)).cast("long"))


def low_quality_target(width, height, quality) -> tuple[Column, Column]:
    """MTH-3 (a): below quality 50, fit a side over 2048 into 1920/2048 (truncating)."""
    w, h, q = _c(width).cast("double"), _c(height).cast("double"), _c(quality)
    side = F.when(q < DOWNSCALE_SMALL_QUALITY, F.lit(float(DOWNSCALE_SMALL_SIDE))).otherwise(F.lit(float(DOWNSCALE_SIDE)))
    ratio = F.least(F.try_divide(side, w), F.try_divide(side, h))
    shrink = (q < DOWNSCALE_QUALITY) & ((w > DOWNSCALE_SIDE) | (h > DOWNSCALE_SIDE)) & (ratio < 1.0)
    nw = F.when(shrink, F.floor(w * ratio)).otherwise(w).cast("int")
    nh = F.when(shrink, F.floor(h * ratio)).otherwise(h).cast("int")
    return nw, nh


def cap_resolution(width, height, max_side) -> tuple[Column, Column]:
    """MTH-3 (b): fit into ``max_side x max_side`` keeping the aspect; never enlarge.

    The long side becomes ``max_side``; the short side is the floor or ceiling of
    the exact value, whichever keeps the aspect ratio closer (at least 1).
    """
    w, h, m = _c(width).cast("double"), _c(height).cast("double"), _c(max_side).cast("double")
    aspect = F.try_divide(w, h)
    # landscape (or square): width -> m, height from m / aspect
    hy = F.try_divide(m, aspect)
    hf, hc = F.floor(hy), F.ceil(hy)
    key_f = F.when(hf == 0, F.lit(0.0)).otherwise(F.abs(aspect - F.try_divide(m, hf)))
    key_c = F.when(hc == 0, F.lit(0.0)).otherwise(F.abs(aspect - F.try_divide(m, hc)))
    h_land = F.greatest(F.when(key_c < key_f, hc).otherwise(hf), F.lit(1.0))
    # portrait: height -> m, width from m * aspect
    wx = m * aspect
    wf, wc = F.floor(wx), F.ceil(wx)
    w_port = F.greatest(F.when(F.abs(aspect - F.try_divide(wc, m)) < F.abs(aspect - F.try_divide(wf, m)), wc).otherwise(wf), F.lit(1.0))
    needs = (w > m) | (h > m)
    portrait = aspect <= 1.0  # square box: the height is the binding side
    nw = F.when(~needs, w).when(portrait, w_port).otherwise(m)
    nh = F.when(~needs, h).when(portrait, m).otherwise(h_land)
    return nw.cast("int"), nh.cast("int")


def subsampling(quality, fmt) -> Column:
    """JPEG chroma subsampling tier (MTH-4); NULL for other formats."""
    q = _c(quality)
    chain = None
    for lo, tier in SUBSAMPLING_TIERS:
        if chain is None:
            chain = F.when(q >= lo, F.lit(tier))
        elif lo > 0:
            chain = chain.when(q >= lo, F.lit(tier))
        else:
            chain = chain.otherwise(F.lit(tier))
    return F.when(F.lower(_c(fmt)) == "jpeg", chain)


def format_extension(fmt) -> Column:
    f = F.lower(_c(fmt))
    return F.coalesce(*[F.when(f == k, F.lit(v)) for k, v in FORMAT_EXTENSIONS.items()])

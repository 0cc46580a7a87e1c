"""Image fingerprints (FPR-3 .. FPR-6) over Spark's ``image`` source.

Decoding is Spark's; channel handling, grey scale and shrinking run as numpy
inside ``mapInPandas``, image by image because sizes differ; the small grids of
a batch are then stacked and hashed together.  Images are spread over all tasks and
never reach the driver.

Definitions (the library behind the reference resamples with Lanczos, which is
not available here; these are ours, stated exactly):

* pixels: Spark stores BGR(A) rows top to bottom.  The fingerprint job (FPR-5) drops
  alpha and reports mode ``RGB``, its images being RGB from there on; the converter's
  form (FPR-6, ``alpha="over_white"``) composites four channels over white.
* grey: ``(299 R + 587 G + 114 B) / 1000`` (Rec. 601 luma).
* shrink: box average over the source rectangle of each target cell.
* average hash (FPR-1): 8x8, bit = cell > mean.
* difference hash (FPR-2): 9x8, bit = right neighbour > left.
* perceptual hash (FPR-3): 32x32, 2-D DCT-II, top-left 8x8, bit = coef > median.
* wavelet hash (FPR-4): 64x64, three Haar averaging steps to 8x8, bit > median.
Bits are read row by row; the first is the most significant.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import long_to_hex
from ..session import spread

# Executors may not have this package on their path: ship this module's
# functions with the task (pickled by value) instead of by import name.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older pickler
    pass

HASHES = ("phash", "ahash", "dhash", "whash")
_HASH_COLUMNS = ", ".join(f"{h} LONG" for h in HASHES)
IMAGE_SCHEMA = f"origin STRING, width INT, height INT, n_channels INT, image_mode STRING, {_HASH_COLUMNS}, error STRING"

# Spark's image source channel counts -> mode names.
MODES = {1: "L", 3: "RGB", 4: "RGBA"}


def to_rgb(data: bytes, h: int, w: int, c: int, alpha: str = "drop") -> np.ndarray:
    """FPR-6: decoded bytes (BGR/BGRA/grey) -> float RGB array (h, w, 3)."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c).astype(np.float64)
    if c == 1:
        return np.repeat(a, 3, axis=2)
    rgb = a[:, :, 2::-1]
    if c == 4 and alpha == "over_white":
        share = a[:, :, 3:4] / 255.0
        rgb = rgb * share + 255.0 * (1.0 - share)
    return rgb


def grey(rgb: np.ndarray) -> np.ndarray:
    return (rgb[:, :, 0] * 299 + rgb[:, :, 1] * 587 + rgb[:, :, 2] * 114) / 1000.0


def shrink(g: np.ndarray, tw: int, th: int) -> np.ndarray:
    """Box average into ``th x tw`` cells using an integral image."""
    h, w = g.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = g.cumsum(0).cumsum(1)
    ys = np.floor(np.arange(th + 1) * h / th).astype(int)
    xs = np.floor(np.arange(tw + 1) * w / tw).astype(int)
    y0, y1 = ys[:-1], np.maximum(ys[1:], ys[:-1] + 1).clip(max=h)
    x0, x1 = xs[:-1], np.maximum(xs[1:], xs[:-1] + 1).clip(max=w)
    y0 = np.minimum(y0, y1 - 1)
    x0 = np.minimum(x0, x1 - 1)
    tot = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    area = np.outer(y1 - y0, x1 - x0)
    return tot / area


def small_grids(g: np.ndarray) -> tuple[np.ndarray, ...]:
    """The four grids that the hashes of one grey image are made of: 8x8, 9 wide x 8, 32x32, and 64x64 averaged to 8x8."""
    haar = shrink(g, 64, 64).reshape(8, 8, 8, 8).mean(axis=(1, 3))  # three averaging steps of 2x2
    return shrink(g, 8, 8), shrink(g, 9, 8), shrink(g, 32, 32), haar


def _packed(bits: np.ndarray) -> np.ndarray:
    """(n, 8, 8) booleans as n signed 64-bit integers, first bit most significant."""
    return np.packbits(bits.reshape(len(bits), 64), axis=1).view(">i8").ravel().astype(np.int64)


def _above_median(cells: np.ndarray) -> np.ndarray:
    return cells > np.median(cells.reshape(len(cells), -1), axis=1)[:, None, None]


def _dct_rows(rows: int = 8, n: int = 32) -> np.ndarray:
    return 2.0 * np.cos(np.pi * np.arange(rows)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def hash_grids(a8: np.ndarray, d: np.ndarray, p: np.ndarray, w: np.ndarray) -> dict[str, np.ndarray]:
    """Hashes of n images from their stacked small grids."""
    dct = _dct_rows()
    return {"phash": _packed(_above_median(dct @ p @ dct.T)), "ahash": _packed(a8 > a8.mean(axis=(1, 2), keepdims=True)),
            "dhash": _packed(d[:, :, 1:] > d[:, :, :-1]), "whash": _packed(_above_median(w))}


def _with_hashes(columns: dict, ok: np.ndarray, grids: list[np.ndarray] | None, error: str | list) -> pd.DataFrame:
    """The columns with nullable hashes where ``ok`` and an error elsewhere."""
    out = pd.DataFrame(columns)
    found = hash_grids(*grids) if grids is not None else {}
    for name in HASHES:
        out[name] = pd.array([None] * len(ok), dtype="Int64")
        if found:
            out.loc[ok, name] = found[name]
    out["error"] = np.where(ok, None, error)
    return out


def _hash_batches(alpha: str):
    def run(batches):
        for pdf in batches:
            images = pdf["image"]
            columns = {"origin": [i["origin"] for i in images], "width": [int(i["width"]) for i in images],
                       "height": [int(i["height"]) for i in images], "n_channels": [int(i["nChannels"]) for i in images]}
            ok, grids, errors = np.zeros(len(images), bool), [], []
            for k, (img, w, h, c) in enumerate(zip(images, columns["width"], columns["height"], columns["n_channels"])):
                errors.append("undecodable image")
                if h > 0 and w > 0 and c in MODES:
                    try:
                        grids.append(small_grids(grey(to_rgb(img["data"], h, w, c, alpha))))
                        ok[k] = True
                    except ValueError as e:  # a buffer of the wrong length becomes an error row
                        errors[-1] = f"{type(e).__name__}: {e}"
            modes = [("RGB" if alpha == "drop" else MODES[c]) if good else None for c, good in zip(columns["n_channels"], ok)]
            stacked = [np.stack(g) for g in zip(*grids)] if grids else None
            yield _with_hashes({**columns, "image_mode": modes}, ok, stacked, np.array(errors, dtype=object))
    return run


def _shown(df: DataFrame, *first: str) -> DataFrame:
    """Hashes as hex strings, and the perceptual hash also as ``fp``."""
    return df.select(*first, *[long_to_hex(h).alias(h) for h in HASHES], F.col("phash").alias("fp"), "error")


def image_fingerprints(images: DataFrame, sizes: DataFrame | None = None, alpha: str = "drop") -> DataFrame:
    """FPR-5: all four hashes plus size and mode for every image row.

    ``images`` comes from ``image_scan``; ``sizes`` (``path, length``) from a
    content-pruned ``binaryFile`` listing adds the file size.  ``alpha``: ``drop`` or
    ``over_white`` (the converter's form, which reports the mode as decoded).
    """
    if alpha not in ("drop", "over_white"):
        raise ValueError(f"unsupported alpha handling: {alpha}")
    out = spread(images.select("image")).mapInPandas(_hash_batches(alpha), IMAGE_SCHEMA)
    out = _shown(out, "origin", "width", "height", "n_channels", "image_mode")
    if sizes is not None:
        # the two sources spell local URIs differently (file:/ vs file:///)
        norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
        s = sizes.select(norm(F.col("path")).alias("_p"), F.col("length").alias("file_size"))
        out = out.join(s, norm(F.col("origin")) == F.col("_p"), "left").drop("_p")
    return out


def _grid_operators(size: int) -> tuple[np.ndarray, ...]:
    """Shrinking is linear: the small grids of a ``size x size`` grid as matrices, from the grids of its unit cells."""
    unit = np.eye(size * size).reshape(-1, size, size)
    return tuple(np.stack(g) for g in zip(*map(small_grids, unit)))


def _grid_batches(size: int):
    def run(batches):
        operators = _grid_operators(size)
        for pdf in batches:
            ok = pdf["grid"].map(lambda g: g is not None and len(g) == size * size).to_numpy(bool)
            stacked = None
            if ok.any():
                cells = np.stack(pdf["grid"][ok].to_numpy()).astype(np.float64)
                stacked = [np.tensordot(cells, op, axes=1) for op in operators]
            yield _with_hashes({"id": pdf["id"].to_numpy()}, ok, stacked, "grid must hold size*size values")
    return run


def grid_fingerprints(df: DataFrame, key: str, grid: str, size: int = 8) -> DataFrame:
    """FPR-3..5 on grey grids stored as arrays (row-major ``size x size``): the same
    hashes as ``image_fingerprints``, the grid standing for a decoded image."""
    src = spread(df.select(F.col(key).cast("long").alias("id"), F.col(grid).alias("grid")))
    made = src.mapInPandas(_grid_batches(size), f"id LONG, {_HASH_COLUMNS}, error STRING")
    return _shown(made, F.col("id").alias(key))

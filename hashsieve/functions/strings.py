"""Naming and formatting rules as native column expressions (STR-1 .. STR-8).

Every function takes and returns a ``Column``; nothing here runs Python on the
executors.  Where Python string semantics differ from the JVM (title case,
``splitext``, float formatting) the rule is spelled out with regular
expressions so both agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- fixed values
# Characters replaced by '_' in file names.
INVALID_FILENAME_CHARS = '<>:"/\\|?*'
# Name used when sanitising leaves nothing.
EMPTY_FILENAME = "untitled"
# Size units, smallest first, 1024 apart.
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]
# Prefix and folder of public ids.
PUBLIC_ID_PREFIX = "product_"
FOLDER_PREFIX = "products/"
# Extension given to catalogue names.
CATALOGUE_EXTENSION = ".jpeg"
# Timestamp layout inside hash-based names.
HASH_NAME_TIME_FORMAT = "yyyyMMdd_HHmmss"
# ------------------------------------------------------------------------------


def normalize_type(c) -> Column:
    """STR-1: lower case, runs of non-ASCII-alphanumerics -> '_', no edge '_'.

    May return '' (the caller rejects it).
    """
    runs = F.regexp_replace(F.lower(_c(c)), r"[^a-zA-Z0-9]+", "_")
    return F.regexp_replace(runs, r"^_+|_+$", "")


def display_name(c) -> Column:
    """STR-2: '_' -> ' ' and title case, where every run of letters is capitalised.

    ``initcap`` only capitalises after spaces (``nfc2go`` -> ``Nfc2go``); here a
    letter following a digit starts a new word (``Nfc2Go``).
    """
    pieces = F.regexp_extract_all(F.regexp_replace(_c(c), "_", " "), F.lit(r"[A-Za-z]+|[^A-Za-z]+"), 0)
    cap = F.transform(pieces, lambda p: F.when(p.rlike("^[A-Za-z]"),
                                                  F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2)))))
                      .otherwise(p))
    return F.array_join(cap, "")


def splitext_stem(c) -> Column:
    """Everything but the last extension, where leading dots of the last path
    piece do not start an extension (``.psd`` has none, ``a.`` has ``.``)."""
    c = _c(c)
    m = F.regexp_extract(c, r"^(.*[^/.][^/]*?)(\.[^./]*)$", 1)
    return F.when(c.rlike(r"^(.*[^/.][^/]*?)(\.[^./]*)$"), m).otherwise(c)


def splitext_ext(c) -> Column:
    c = _c(c)
    return F.when(c.rlike(r"^(.*[^/.][^/]*?)(\.[^./]*)$"), F.regexp_extract(c, r"(\.[^./]*)$", 1)).otherwise(F.lit(""))


def basename(c) -> Column:
    return F.regexp_extract(_c(c), r"[^/]*$", 0)


def path_stem(c) -> Column:
    """Stem of the last path piece: cut at the last '.', unless that dot is the
    first or the last character."""
    b = basename(c)
    return F.when(b.rlike(r"^.+\.[^.]+$"), F.regexp_extract(b, r"^(.+)\.[^.]+$", 1)).otherwise(b)


def public_id(filename, product_type=None) -> tuple[Column, Column]:
    """STR-3: ``product_<stem with [^a-zA-Z0-9_-] -> '_'>`` and ``products/<type>``."""
    pid = F.when(_c(filename).isNotNull() & (_c(filename) != ""),
                 F.concat(F.lit(PUBLIC_ID_PREFIX), F.regexp_replace(splitext_stem(filename), r"[^a-zA-Z0-9_-]", "_")))
    folder = None
    if product_type is not None:
        t = _c(product_type)
        folder = F.when(t.isNotNull() & (t != ""), F.concat(F.lit(FOLDER_PREFIX), t))
    return pid, folder


def catalogue_name(c) -> Column:
    """STR-4 (a): text before the last '.', plus ``.jpeg`` (no dot: append)."""
    c = _c(c)
    return F.when(c.isNotNull() & (c != ""), F.concat(F.regexp_replace(c, r"\.[^.]*$", ""), F.lit(CATALOGUE_EXTENSION)))


def converted_name(c, fmt) -> Column:
    """STR-4 (b): ``splitext`` stem + '.' + format."""
    return F.concat(splitext_stem(c), F.lit("."), _c(fmt))


def output_file_name(c, fmt) -> Column:
    """STR-4 (c): path stem + '.jpg' for jpeg, else '.' + format."""
    f = _c(fmt)
    return F.concat(path_stem(c), F.lit("."), F.when(f == "jpeg", F.lit("jpg")).otherwise(f))


def extension(c) -> Column:
    """STR-5: last '.'-piece of the lower-cased name (a name without a dot is
    its own extension)."""
    return F.element_at(F.split(F.lower(_c(c)), r"\.", -1), -1)


def has_allowed_extension(c, allowed: list[str]) -> Column:
    c = _c(c)
    return F.coalesce(c.isNotNull() & (c != "") & extension(c).isin([a.lower() for a in allowed]), F.lit(False))


def sanitize_filename(c) -> Column:
    """STR-6: invalid characters -> '_', strip spaces and dots at both ends,
    empty -> 'untitled'."""
    escaped = "".join("\\" + ch if ch in "\\[]^-" else ch for ch in INVALID_FILENAME_CHARS)
    s = F.regexp_replace(_c(c), f"[{escaped}]", "_")
    s = F.regexp_replace(s, r"^[ .]+|[ .]+$", "")
    return F.when(s == "", F.lit(EMPTY_FILENAME)).otherwise(s)


def human_size(c) -> Column:
    """STR-7: ``0 B``; else divide by 1024 while >= 1024 (up to TB), one decimal.

    Python formats with round-half-even on the exact value; ``bround`` first makes
    Java's half-up formatter print the same digit.
    """
    v = _c(c).cast("double")
    chain = None
    for i, unit in enumerate(SIZE_UNITS):
        scaled = v / F.lit(float(1024 ** i))
        piece = F.concat(F.format_string("%.1f", F.bround(scaled, 1)), F.lit(" " + unit))
        if chain is None:
            chain = F.when(v < F.lit(1024.0), piece)
        elif i < len(SIZE_UNITS) - 1:
            chain = chain.when(v < F.lit(float(1024 ** (i + 1))), piece)
        else:
            chain = chain.otherwise(piece)
    return F.when(v == 0, F.lit("0 B")).otherwise(chain)


def hash_filename(path, fp_hex, ts, ext=None) -> Column:
    """STR-8: ``<first 8 hex>_<stem>_<yyyyMMdd_HHmmss><.ext>``.

    The time is a column (not the clock) so reruns agree.  The extension
    defaults to the path's own; one without a leading dot gets one.
    """
    e = splitext_ext(path) if ext is None else _c(ext)
    e = F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    stem = splitext_stem(basename(path))
    return F.concat(F.substring(_c(fp_hex), 1, 8), F.lit("_"), stem, F.lit("_"),
                    F.date_format(_c(ts), HASH_NAME_TIME_FORMAT), e)

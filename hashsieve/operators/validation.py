"""Filters and admission checks (FLT-1 .. FLT-3, FLT-7).

Catalogue and job filters (FLT-4 .. FLT-6) sit with their tables in
``catalog.py`` and ``jobs.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import extension, human_size

# ---------------------------------------------------------------- fixed values
DEFAULT_PRODUCT_TYPE = "metal_cards"
DEFAULT_QUALITY = 75
DEFAULT_FORMAT = "jpeg"
ALLOWED_EXTENSIONS = ["psd"]
MAX_FILE_BYTES = 1024 * 1024 * 1024
BATCH_FACTOR = 5
QUALITY_MIN, QUALITY_MAX = 1, 100
RETENTION_DAYS = 30
# Error priority of an upload batch: lower wins (status code, code).
ERR_NO_FILES = (1, 400)
ERR_NO_NAME = (2, 400)
ERR_EXTENSION = (2, 400)
ERR_FILE_SIZE = (3, 413)
ERR_BATCH_SIZE = (4, 413)
ERR_QUALITY = (5, 400)
ERR_PRODUCT_TYPE = (6, 400)
# Messages of the errors, in that order; values stand between the parts.
MSG_NO_FILES = "No files provided."
MSG_NO_NAME = "One or more files have no filename"
MSG_EXTENSION = ("Only PSD files allowed for product uploads. File '", "' has extension: .")
MSG_FILE_SIZE = ("File '", "' too large: ", ". Maximum allowed: ")
MSG_BATCH_SIZE = ("Total batch size too large: ", ". Maximum allowed: ")
MSG_QUALITY = "Quality must be between 1 and 100"
MSG_PRODUCT_TYPE = ("Invalid product type '", "'. Allowed types: ")
# ------------------------------------------------------------------------------


def _blank(c: Column) -> Column:
    """NULL, empty, or white space of any kind only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


def retention(df: DataFrame, created_at: str, now, max_age_days: int = RETENTION_DAYS) -> DataFrame:
    """FLT-1: keep rows created at or after ``now - max_age_days``.

    Rows whose time is missing or cannot be parsed are kept.  ``now`` is a
    parameter (a literal or column), never the clock, so reruns agree.
    """
    c = F.col(created_at)
    ts = c if dict(df.dtypes)[created_at].startswith("timestamp") else F.try_to_timestamp(c)
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    cutoff = now_c - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
    return df.filter(F.coalesce(ts.cast("timestamp") >= cutoff, F.lit(True)))


def fill_defaults(df: DataFrame, product_type: str = "product_type", quality: str = "quality",
                  fmt: str = "format") -> DataFrame:
    """FLT-3: blank type -> metal_cards, NULL quality -> 75, blank format -> jpeg.

    Case is kept (``Metal_Cards`` stays and is rejected later).  ``fallbacks``
    lists the defaults that were applied.
    """
    t, q, f = F.col(product_type), F.col(quality), F.col(fmt)
    applied = F.filter(F.array(F.when(_blank(t), F.lit("product_type")), F.when(q.isNull(), F.lit("quality")),
                               F.when(_blank(f), F.lit("format"))), lambda x: x.isNotNull())
    return (df.withColumn("fallbacks", applied)
            .withColumn(product_type, F.when(_blank(t), F.lit(DEFAULT_PRODUCT_TYPE)).otherwise(t))
            .withColumn(quality, F.coalesce(q, F.lit(DEFAULT_QUALITY)))
            .withColumn(fmt, F.when(_blank(f), F.lit(DEFAULT_FORMAT)).otherwise(f)))


def file_errors(files: DataFrame, filename: str = "filename", size: str = "size",
                allowed: list[str] = ALLOWED_EXTENSIONS, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Per-file error of FLT-2: ``(priority, position, status, message)`` or NULL."""
    n, s = F.col(filename), F.col(size)
    ext = extension(n)
    no_name = n.isNull() | (n == "")
    bad_ext = ~ext.isin([a.lower() for a in allowed])
    too_big = s > F.lit(max_bytes)
    err = (F.when(no_name, F.struct(F.lit(ERR_NO_NAME[0]).alias("priority"), F.col("position"),
                                    F.lit(ERR_NO_NAME[1]).alias("status"),
                                    F.lit(MSG_NO_NAME).alias("message")))
           .when(bad_ext, F.struct(F.lit(ERR_EXTENSION[0]).alias("priority"), F.col("position"),
                                   F.lit(ERR_EXTENSION[1]).alias("status"),
                                   F.concat(F.lit(MSG_EXTENSION[0]), n, F.lit(MSG_EXTENSION[1]), ext).alias("message")))
           .when(too_big, F.struct(F.lit(ERR_FILE_SIZE[0]).alias("priority"), F.col("position"),
                                   F.lit(ERR_FILE_SIZE[1]).alias("status"),
                                   F.concat(F.lit(MSG_FILE_SIZE[0]), n, F.lit(MSG_FILE_SIZE[1]), human_size(s),
                                            F.lit(MSG_FILE_SIZE[2]), human_size(F.lit(max_bytes))).alias("message"))))
    return files.withColumn("file_error", err)


def batch_admission(files: DataFrame, requests: DataFrame, product_types: DataFrame,
                    batch: str = "batch_id", allowed: list[str] = ALLOWED_EXTENSIONS,
                    max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """FLT-2: all-or-nothing admission of each upload batch; first error by priority.

    ``files``: ``batch_id, position, filename, size``.  ``requests``: one row per
    batch, ``batch_id, product_type, quality, format`` (after FLT-3).
    ``product_types``: the allowed dimension (a small dimension; the planner broadcasts it).

    One aggregation per batch: ``min`` of the per-file error structs picks the
    first error in (priority, position) order, ``sum`` gives the batch size.
    """
    fe = file_errors(files, allowed=allowed, max_bytes=max_bytes)
    per_batch = fe.groupBy(batch).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_size"),
                                      F.min("file_error").alias("file_error"))
    # the allowed list is one value: a scalar subquery, evaluated once
    allowed_list = product_types.agg(F.array_join(F.sort_array(F.collect_list(F.struct("position", "product_type")))["product_type"], ", "))
    known = product_types.select(F.col("product_type").alias("_pt"), F.lit(True).alias("_known"))
    r = (requests.join(per_batch, batch, "left")
         .join(known, F.col("product_type") == F.col("_pt"), "left")
         .withColumn("allowed_types", allowed_list.scalar()))
    max_batch = max_bytes * BATCH_FACTOR
    fe_ = F.col("file_error")
    err = (F.when(F.coalesce(F.col("n_files"), F.lit(0)) == 0,
                  F.struct(F.lit(ERR_NO_FILES[1]).alias("status"), F.lit(MSG_NO_FILES).alias("message")))
           .when(fe_.isNotNull() & (fe_["priority"] < ERR_BATCH_SIZE[0]), F.struct(fe_["status"].alias("status"), fe_["message"].alias("message")))
           .when(F.col("total_size") > F.lit(max_batch),
                 F.struct(F.lit(ERR_BATCH_SIZE[1]).alias("status"),
                          F.concat(F.lit(MSG_BATCH_SIZE[0]), human_size(F.col("total_size")), F.lit(MSG_BATCH_SIZE[1]), human_size(F.lit(max_batch))).alias("message")))
           .when(~F.col("quality").between(QUALITY_MIN, QUALITY_MAX),
                 F.struct(F.lit(ERR_QUALITY[1]).alias("status"), F.lit(MSG_QUALITY).alias("message")))
           .when(F.col("_known").isNull(),
                 F.struct(F.lit(ERR_PRODUCT_TYPE[1]).alias("status"),
                          F.concat(F.lit(MSG_PRODUCT_TYPE[0]), F.col("product_type"), F.lit(MSG_PRODUCT_TYPE[1]), F.col("allowed_types")).alias("message"))))
    return r.select(batch, "product_type", "quality", "format", F.coalesce(F.col("n_files"), F.lit(0)).alias("n_files"),
                    F.coalesce(F.col("total_size"), F.lit(0)).alias("total_size"),
                    err.isNull().alias("accepted"), err["status"].alias("status"), err["message"].alias("message"))


def quarantine(df: DataFrame, size: str = "size", width: str | None = None, height: str | None = None,
               exists: str | None = None) -> DataFrame:
    """FLT-7: reason a file cannot be converted (NULL when readable)."""
    reason = F.when(F.col(exists).isNull() | ~F.col(exists), F.lit("missing")) if exists else None
    zero = F.coalesce(F.col(size), F.lit(0)) == 0
    reason = reason.when(zero, F.lit("empty")) if reason is not None else F.when(zero, F.lit("empty"))
    if width and height:
        reason = reason.when((F.coalesce(F.col(width), F.lit(0)) <= 0) | (F.coalesce(F.col(height), F.lit(0)) <= 0),
                             F.lit("zero_dimensions"))
    return df.withColumn("reject_reason", reason)

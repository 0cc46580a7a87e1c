"""The asset catalogue (FLT-4, TOP-1, AGG-8, SNK-3/SNK-4 logic).

Catalogue rows: ``document_id, product_type, image_url, filename, uploaded_at``.
Stored as Parquet partitioned by ``product_type``, so a type filter prunes
partitions and the time sort of TOP-1 runs as TakeOrderedAndProject (per-task
top-n, then a merge of n rows per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import catalogue_name

# ---------------------------------------------------------------- fixed values
DEFAULT_LIMIT = 100
ALL_FILTER = "all"
# ------------------------------------------------------------------------------


def _blank(v) -> bool:
    return v is None or str(v).strip() == ""


def filter_type(catalog: DataFrame, product_type: str | None = None) -> DataFrame:
    """FLT-4: optional equality on the type (blank = everything)."""
    return catalog if _blank(product_type) else catalog.filter(F.col("product_type") == F.lit(product_type))


def newest(catalog: DataFrame, product_type: str | None = None, limit: int = DEFAULT_LIMIT,
           tie_break: list[str] | None = None) -> DataFrame:
    """TOP-1: newest ``limit`` rows (optionally of one type).

    ``tie_break`` columns make the order total, so equal times give the same rows
    on every run.
    """
    keys = [F.col("uploaded_at").desc()] + [F.col(c).asc() for c in (tie_break or ["document_id"])]
    return filter_type(catalog, product_type).orderBy(*keys).limit(limit)


def listing_counts(catalog: DataFrame, product_type: str | None = None) -> DataFrame:
    """AGG-8: row count of the filtered listing plus the echoed filter."""
    echo = ALL_FILTER if _blank(product_type) else product_type
    return filter_type(catalog, product_type).agg(F.count(F.lit(1)).alias("count")).withColumn("filter", F.lit(echo))


def listing_counts_by(catalog: DataFrame, product_types: list[str | None]) -> DataFrame:
    """AGG-8 for several filters in one pass: one row per entry of ``product_types`` (blank = all)."""
    wanted = [F.count_if(F.lit(True) if _blank(t) else F.col("product_type") == F.lit(t)).alias(f"n{k}") for k, t in enumerate(product_types)]
    rows = F.array(*[F.struct(F.col(f"n{k}").alias("count"), F.lit(ALL_FILTER if _blank(t) else t).alias("filter"))
                     for k, t in enumerate(product_types)])
    return catalog.agg(*wanted).select(F.inline(rows))


def new_documents(uploads: DataFrame) -> DataFrame:
    """SNK-3 rows: catalogue documents for stored uploads (``original_filename`` ->
    ``.jpeg`` name; the upload time comes from the data, not the clock)."""
    return uploads.select("document_id", "product_type", "image_url",
                          catalogue_name("original_filename").alias("filename"), "uploaded_at")


def delete_documents(catalog: DataFrame, deletes: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """SNK-4: (catalogue without the deleted ids, per-request report).

    The report says ``deleted`` or ``not_found`` for each requested id; the
    catalogue keeps everything else (left anti join).
    """
    ids = deletes.select(key).distinct()
    remaining = catalog.join(ids, key, "left_anti")
    # the small request set travels, not the ids of the whole catalogue
    found = catalog.join(ids, key, "left_semi").select(key).distinct().withColumn("_found", F.lit(True))
    report = (deletes.join(found, key, "left")
              .withColumn("outcome", F.when(F.col("_found"), F.lit("deleted")).otherwise(F.lit("not_found")))
              .drop("_found"))
    return remaining, report

"""The product-type dimension (SET-1 .. SET-3, JOI-1, AGG-7, STR-2 listing).

The dimension is ``position, product_type, source`` with the base types first.
It is small by nature (a list of folders), so joins against it broadcast it.
Requests against it (adds, removals, uploads) can be any size and are handled
with aggregations and joins, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions.strings import display_name, normalize_type

# ---------------------------------------------------------------- fixed values
BASE_PRODUCT_TYPES = ["metal_cards", "nfc_cards", "standees"]
SOURCE_BASE = "base"
SOURCE_DYNAMIC = "dynamic"
DESCRIPTION_PREFIX = "Custom "
# ------------------------------------------------------------------------------


def _stripped(c: Column) -> Column:
    """Without white space of any kind at the ends; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def base_types(spark) -> DataFrame:
    return spark.createDataFrame([(i, t, SOURCE_BASE) for i, t in enumerate(BASE_PRODUCT_TYPES)],
                                 "position LONG, product_type STRING, source STRING")


def all_types(spark, dynamic: DataFrame) -> DataFrame:
    """SET-1: base types followed by the dynamic ones (``position, product_type``)."""
    n = len(BASE_PRODUCT_TYPES)
    dyn = dynamic.select((F.col("position") + F.lit(n)).cast("long").alias("position"), "product_type",
                         F.lit(SOURCE_DYNAMIC).alias("source"))
    return base_types(spark).unionByName(dyn)


def folder_listing(types: DataFrame) -> DataFrame:
    """STR-2 / AGG-7 per row: display name, source, deletable flag."""
    return types.select("position", "product_type", display_name("product_type").alias("name"), "source",
                        (F.col("source") != SOURCE_BASE).alias("can_delete"))


def type_counts(types: DataFrame) -> DataFrame:
    """AGG-7: totals over the dimension."""
    return types.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(F.col("source") == SOURCE_BASE).alias("base_count"),
                     F.count_if(F.col("source") == SOURCE_DYNAMIC).alias("dynamic_count"))


def add_types(types: DataFrame, requests: DataFrame) -> DataFrame:
    """SET-2: apply folder-creation requests (``position, name, description``) in order.

    A request is refused when the name is blank, normalises to nothing, or its
    type exists already (in the dimension or from an earlier request).  The
    first request per type is found with an aggregation, not a window, so one
    popular name does not land in a single task.
    """
    name = _stripped(F.col("name"))
    r = requests.withColumn("_name", name).withColumn("product_type", normalize_type(F.col("_name")))
    valid = (F.col("_name") != "") & (F.col("product_type") != "")
    first = (r.filter(valid).groupBy("product_type").agg(F.min("position").alias("_first")))
    existing = types.select(F.col("product_type"), F.lit(True).alias("_exists"))
    out = (r.join(first, "product_type", "left")
           .join(existing, "product_type", "left"))
    outcome = (F.when(F.col("_name") == "", F.lit("missing_name"))
               .when(F.col("product_type") == "", F.lit("invalid_name"))
               .when(F.col("_exists") | (F.col("position") != F.col("_first")), F.lit("exists"))
               .otherwise(F.lit("created")))
    desc = _stripped(F.col("description"))
    return out.select("position", F.col("name"), "product_type", outcome.alias("outcome"),
                      F.when(outcome == "created", 200).otherwise(400).alias("status"),
                      F.when(desc != "", desc).otherwise(F.concat(F.lit(DESCRIPTION_PREFIX), F.lower(F.col("_name")))).alias("description"))


def types_after_add(types: DataFrame, added: DataFrame) -> DataFrame:
    """The dimension after SET-2: created types appended in request order.

    Positions only order the list, so new ones are the request positions shifted
    past the current maximum (no global ranking window).
    """
    top = types.agg(F.max("position")).scalar()
    created = added.filter(F.col("outcome") == "created")
    return types.unionByName(created.select((top + 1 + F.col("position")).cast("long").alias("position"),
                                            "product_type", F.lit(SOURCE_DYNAMIC).alias("source")))


def remove_types(types: DataFrame, requests: DataFrame) -> DataFrame:
    """SET-3: apply removal requests (``position, product_type``) in order.

    Base types are refused (400); unknown types, and a type already removed by an
    earlier request, are not found (404); the rest are removed (200).
    """
    first = requests.groupBy("product_type").agg(F.min("position").alias("_first"))
    known = types.select("product_type", "source")
    out = requests.join(first, "product_type").join(known, "product_type", "left")
    status = (F.when(F.col("source") == SOURCE_BASE, F.lit(400))
              .when(F.col("source").isNull() | (F.col("position") != F.col("_first")), F.lit(404))
              .otherwise(F.lit(200)))
    return out.select("position", "product_type", status.alias("status"))


def types_after_remove(types: DataFrame, removals: DataFrame) -> DataFrame:
    gone = removals.filter(F.col("status") == 200).select("product_type")
    return types.join(gone, "product_type", "left_anti")


def type_membership(requests: DataFrame, types: DataFrame, col: str = "product_type") -> tuple[DataFrame, DataFrame]:
    """JOI-1: (requests with a known type, requests with an unknown one)."""
    t = types.select(F.col("product_type").alias(col))
    return requests.join(t, col, "left_semi"), requests.join(t, col, "left_anti")

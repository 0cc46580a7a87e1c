"""Dedup roll-ups (AGG-1 .. AGG-4): single-pass aggregations with partial
(map-side) aggregation; no row lists are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import ACTION_DUPLICATE, ACTION_ERROR, ACTION_UNIQUE

# ---------------------------------------------------------------- fixed values
# Estimated megabytes saved per skipped duplicate.
SAVED_MB_PER_DUPLICATE = 2.5
# Recommendation rules: (threshold, message).
HIGH_RATE = 20
LOW_RATE = 5
LARGE_REGISTRY = 10000
MSG_HIGH_RATE = "High duplicate rate detected - consider reviewing source data"
MSG_LOW_RATE = "Low duplicate rate - deduplication is working efficiently"
MSG_LARGE_REGISTRY = "Large hash database - consider periodic cleanup"
# ------------------------------------------------------------------------------


def batch_summary(result: DataFrame) -> DataFrame:
    """AGG-1: processed / duplicates / unique / errors and the rate over the input count."""
    n = F.count(F.lit(1))
    dups = F.count_if(F.col("is_duplicate"))
    return result.agg(
        n.alias("total_processed"),
        dups.alias("duplicates_found"),
        F.count_if(F.col("action") == ACTION_UNIQUE).alias("unique_images"),
        F.count_if(~F.col("is_duplicate") & (F.col("action") != ACTION_UNIQUE)).alias("errors"),
        F.when(n > 0, dups / n * F.lit(100.0)).otherwise(F.lit(0.0)).alias("duplicate_rate"),
    )


def registry_statistics(result: DataFrame, registry_size: DataFrame, threshold: int,
                        size_mb: float | None = None) -> DataFrame:
    """AGG-2: runtime counters of a run plus registry size and rate over max(processed, 1).

    ``registry_size`` is a one-row frame with ``total_hashes``; ``size_mb`` (from
    ``stores.size_mb`` on the stored registry) adds ``database_size_mb``.
    """
    n = F.count(F.lit(1))
    dups = F.count_if(F.col("action") == ACTION_DUPLICATE)
    stats = result.agg(n.alias("total_processed"), dups.alias("duplicates_found"),
                       F.count_if(F.col("action") == ACTION_UNIQUE).alias("unique_images"))
    return (stats.withColumn("total_hashes", registry_size.select("total_hashes").scalar())
            .withColumn("threshold", F.lit(threshold))
            .withColumn("duplicate_rate", F.col("duplicates_found") / F.greatest(F.col("total_processed"), F.lit(1)) * F.lit(100.0))
            .withColumn("storage_saved", F.col("duplicates_found"))
            .transform(lambda d: d if size_mb is None else d.withColumn("database_size_mb", F.lit(float(size_mb)))))


def recommendations(rate, total_hashes):
    msgs = F.array(F.when(rate > HIGH_RATE, F.lit(MSG_HIGH_RATE)),
                   F.when(rate < LOW_RATE, F.lit(MSG_LOW_RATE)),
                   F.when(total_hashes > LARGE_REGISTRY, F.lit(MSG_LARGE_REGISTRY)))
    return F.filter(msgs, lambda m: m.isNotNull())


def dedup_report(stats: DataFrame, routed: DataFrame, job: str = "job_id") -> DataFrame:
    """AGG-3: AGG-2 plus the storage view and the recommendations.

    Stored uniques are counted from the routed rows; duplicate records are one
    file per job that saw a duplicate.
    """
    storage = routed.agg(F.count_if(F.col("action") == ACTION_UNIQUE).alias("unique_files"),
                         F.count_distinct(F.when(F.col("is_duplicate"), F.col(job))).alias("duplicate_records"))
    return (stats.withColumn("unique_files", storage.select("unique_files").scalar())
            .withColumn("duplicate_records", storage.select("duplicate_records").scalar())
            .withColumn("total_storage_saved_mb", F.col("storage_saved") * F.lit(SAVED_MB_PER_DUPLICATE))
            .withColumn("recommendations", recommendations(F.col("duplicate_rate"), F.col("total_hashes"))))


def per_job_dedup(result: DataFrame, job: str = "job_id") -> DataFrame:
    """AGG-4: per job, files checked, duplicates, uniques (errors count in neither).

    The per-file results of a job are the input rows filtered by job; they are not
    gathered into one map, since one job may hold a large share of all files.
    """
    return (result.groupBy(job)
            .agg(F.count(F.lit(1)).alias("files_checked"),
                 F.count_if(F.col("is_duplicate")).alias("duplicates_found"),
                 F.count_if(~F.col("is_duplicate") & (F.col("action") != ACTION_ERROR)).alias("unique_files")))

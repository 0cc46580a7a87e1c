"""Conversion batches: tallies, reports, progress and rendition plans
(AGG-5, AGG-6, WIN-1, WIN-2, MTH-4).

Per-file results: ``batch_id, position, filename, success, original_size,
converted_size, quality, format, width, height``.  Batch reports are
aggregations (partial, then one exchange); the per-file lists of a report are
the rows themselves, filtered by batch, rather than arrays collected into one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running_within
from ..functions.numeric import (compression_ratio, estimate_bytes, format_extension, low_quality_target, py_round,
                                 subsampling)

# ---------------------------------------------------------------- fixed values
STATUS_COMPLETED = "completed"
STATUS_PARTIAL = "partially_completed"
# Rendition grid of MTH-4: (quality, format).
RENDITION_GRID = [(q, f) for f in ("jpeg", "webp", "avif") for q in (50, 75, 90)]
# ------------------------------------------------------------------------------


def with_ratio(results: DataFrame) -> DataFrame:
    """MTH-1 on each successful file."""
    return results.withColumn("compression_ratio",
                              F.when(F.col("success"), compression_ratio("original_size", "converted_size")))


def conversion_tally(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """AGG-5: successful / total per batch."""
    return results.groupBy(batch).agg(F.count_if(F.col("success")).alias("successful"), F.count(F.lit(1)).alias("total"))


def batch_report(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """AGG-6: status, counts, byte totals, mean ratio over completed files
    (divided by max(n, 1)), success rate and message."""
    r = with_ratio(results)
    ok = F.col("success")
    g = r.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("completed_files"),
        F.count_if(~ok).alias("failed_files"),
        F.sum("original_size").alias("total_original_size"),
        F.coalesce(F.sum(F.when(ok, F.col("converted_size"))), F.lit(0)).alias("total_optimized_size"),
        F.coalesce(F.sum(F.when(ok, F.col("compression_ratio"))), F.lit(0.0)).alias("_ratio_sum"))
    rate = F.col("completed_files") / F.col("total_files") * F.lit(100.0)
    return g.select(
        batch,
        F.when(F.col("failed_files") == 0, F.lit(STATUS_COMPLETED)).otherwise(F.lit(STATUS_PARTIAL)).alias("status"),
        "total_files", "completed_files", "failed_files", "total_original_size", "total_optimized_size",
        py_round(F.col("_ratio_sum") / F.greatest(F.col("completed_files"), F.lit(1)), 6).alias("average_compression_ratio"),
        py_round(rate, 6).alias("success_rate"),
        F.concat(F.lit("Batch processing completed: "), F.col("completed_files"), F.lit("/"), F.col("total_files"),
                 F.lit(" files successful ("), F.format_string("%.1f", F.bround(rate, 1)), F.lit("%)")).alias("message"))


def batch_progress(results: DataFrame, batch: str = "batch_id", order: list[str] | None = None,
                   keep: list[str] | None = None) -> DataFrame:
    """WIN-1: progress before file i (i/n*100) and after it ((i+1)/n*100).

    Positions come from ``running_within`` (no window over a whole batch); ``keep``
    names the other columns wanted, since each of them is written once on the way."""
    r = running_within(results, [batch], order or ["position"], {"_cnt": F.lit(1)}, keep=keep)
    i = F.col("_cnt") - 1
    n = F.col("_cnt_total")
    return (r.withColumn("progress_before", i / n * F.lit(100.0))
            .withColumn("progress_after", (i + 1) / n * F.lit(100.0))
            .drop("_cnt", "_cnt_total"))


def eta(updates: DataFrame, key: str, ts: str, order: list[str], increment: str | None = None,
        total: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """WIN-2: a progress tracker per key, folded over its updates.

    ``current = min(running sum of increments, total)``; percentage (2 places),
    elapsed seconds since the key's first update, remaining = elapsed/fraction -
    elapsed (0 while nothing is done), and ``is_complete``.  ``total`` defaults
    to the number of updates of the key.  Running sums come from
    ``running_within`` (no window over a whole key).
    """
    inc = F.col(increment) if increment else F.lit(1)
    secs = updates.withColumn("_t", F.col(ts).cast("timestamp").cast("double"))
    r = running_within(secs, [key], order, {"_inc": inc.cast("long"), "_one": F.lit(1).cast("long")}, firsts=["_t"],
                       keep=None if keep is None else [*keep, *([total] if total else [])])
    tot = F.col(total) if total else F.col("_one_total")
    u = (r.withColumn("total", tot)
         .withColumn("current", F.least(F.col("_inc"), F.col("total")))
         .withColumn("_pct", F.when(F.col("total") > 0, F.col("current") / F.col("total") * F.lit(100.0)).otherwise(F.lit(0.0)))
         .withColumn("_elapsed", F.col("_t") - F.col("_t_first")))
    remaining = F.when(F.col("_pct") > 0, F.col("_elapsed") / (F.col("_pct") / F.lit(100.0)) - F.col("_elapsed")).otherwise(F.lit(0.0))
    return (u.withColumn("percentage", py_round(F.col("_pct"), 2))
            .withColumn("elapsed_seconds", py_round(F.col("_elapsed"), 2))
            .withColumn("remaining_seconds", py_round(remaining, 2))
            .withColumn("is_complete", F.col("current") >= F.col("total"))
            .drop("_pct", "_elapsed", "_t", "_t_first", "_inc", "_inc_total", "_one", "_one_total"))


def rendition_plan(assets: DataFrame, grid: list[tuple[int, str]] = RENDITION_GRID) -> DataFrame:
    """MTH-4: one row per asset and (quality, format) of a fixed grid.

    The grid is a literal array exploded on each row (a generator, no join).
    Unsupported formats give ``error`` instead of a plan.
    """
    g = F.array(*[F.struct(F.lit(q).alias("quality"), F.lit(f).alias("format")) for q, f in grid])
    x = assets.withColumn("_r", F.explode(g)).select("*", F.col("_r.quality").alias("r_quality"),
                                                   F.col("_r.format").alias("r_format")).drop("_r")
    tw, th = low_quality_target("width", "height", "r_quality")
    ext = format_extension("r_format")
    return (x.withColumn("extension", ext)
            .withColumn("subsampling", subsampling("r_quality", "r_format"))
            .withColumn("target_width", F.when(ext.isNotNull(), tw))
            .withColumn("target_height", F.when(ext.isNotNull(), th))
            .withColumn("estimated_bytes", F.when(ext.isNotNull(), estimate_bytes("width", "height", "r_quality")))
            .withColumn("error", F.when(ext.isNull(), F.concat(F.lit("Unsupported format: "), F.col("r_format")))))


def storage_plan(plan: DataFrame) -> DataFrame:
    """MTH-4 roll-up: estimated bytes per (format, quality)."""
    return (plan.groupBy("r_format", "r_quality")
            .agg(F.count(F.lit(1)).alias("assets"), F.sum("estimated_bytes").alias("estimated_bytes")))

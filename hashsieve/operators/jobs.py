"""Job state as a fold of an update log (JOB-1, FLT-5, FLT-6).

An update sets some fields and leaves the others NULL ("not set").  The state
of a job is, per field, the value of the latest update that set it.  Each field
is ``max(struct(seq, value))`` over the rows that set it: an ordinary
aggregate, so it combines map-side and a job with a huge log costs one row per
map task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: fields folded from the update log.
STATE_FIELDS = ["status", "progress", "message", "error", "current_file",
                "completed_files", "failed_files", "total_files", "is_batch"]


def latest(field: str, seq_cols: list[str]):
    seq = F.struct(*[F.col(c) for c in seq_cols])
    return F.max(F.when(F.col(field).isNotNull(), F.struct(seq.alias("_s"), F.col(field).alias("_v"))))["_v"].alias(field)


def fold_state(updates: DataFrame, job: str = "job_id", seq: list[str] | None = None, ts: str = "ts",
               fields: list[str] | None = None) -> DataFrame:
    """JOB-1: the current state of every job.

    ``created_at`` is the time of the first update; ``is_batch`` defaults to false.
    """
    seq = seq or [ts]
    fields = [f for f in (fields or STATE_FIELDS) if f in updates.columns]
    out = updates.groupBy(job).agg(F.min(ts).alias("created_at"), F.count(F.lit(1)).alias("n_updates"),
                                   *[latest(f, seq) for f in fields])
    if "is_batch" in out.columns:
        out = out.withColumn("is_batch", F.coalesce(F.col("is_batch"), F.lit(False)))
    return out


def filter_jobs(state: DataFrame, status: str | None = None, is_batch: bool | None = None) -> DataFrame:
    """FLT-5: optional status (blank = all) and optional batch flag."""
    out = state
    if status is not None and str(status).strip() != "":
        out = out.filter(F.col("status") == F.lit(status))
    if is_batch is not None:
        out = out.filter(F.coalesce(F.col("is_batch"), F.lit(False)) == F.lit(bool(is_batch)))
    return out


def lookup_job(state: DataFrame, job_id, job: str = "job_id") -> DataFrame:
    """FLT-6: one job (empty = not found).  The key filter is pushed below the
    fold to the scan, so only that job's updates are read."""
    return state.filter(F.col(job) == F.lit(job_id))

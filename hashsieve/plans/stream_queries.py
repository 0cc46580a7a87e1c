"""Registered streaming queries (DED-10, JOB-2).

Each runs a Structured Streaming query to completion (``availableNow``) over
data Spark derives from the driver tables, writes through ``foreachBatch`` into
the session's shared checkpoint folder, and returns the written result.  The
oracles are those of the batch forms, because the streamed result must equal
them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import long_to_hex
from ..session import cut_lineage, scratch_path
from ..streaming import ingest
from . import standins as SI
from .dedup_queries import _WALK_SQL, HEX
from .registry import query

# Number of steps in which the rows arrive, each at least one micro-batch; folders of the registry.
ARRIVALS = 4
REGISTRY_PARTS = 8


@query("ded10_incremental_ingest", _WALK_SQL + f"""
SELECT doc_id, {HEX('fp')} AS fp_hex, is_duplicate, action FROM res""")
def ded10_incremental_ingest(spark, sf):
    run = scratch_path(spark, f"ded10-{uuid.uuid4().hex}")
    fps = cut_lineage(SI.doc_fingerprints(spark, sf).select(F.col("doc_id").alias("seq"), "fp"))
    for _ in ingest.stage_steps(fps, f"{run}/in", "seq", ARRIVALS):
        stream = spark.readStream.schema("seq long, fp long").parquet(f"{run}/in/arrived=*")
        ingest.start_ingest(stream, f"{run}/registry", f"{run}/results", f"{run}/checkpoint", parts=REGISTRY_PARTS).awaitTermination()
    res = spark.read.parquet(f"{run}/results")
    return res.select(F.col("seq").alias("doc_id"), long_to_hex("fp").alias("fp_hex"), "is_duplicate", "action")


@query("job2_state_stream", f"""WITH {SI.JOB_UPDATES_SQL}
SELECT job_id, created_at, n_updates, status, progress, message, error, current_file, is_batch FROM state""")
def job2_state_stream(spark, sf):
    run = scratch_path(spark, f"job2-{uuid.uuid4().hex}")
    ev = SI.table(spark, sf, "events")

    def sink(batch, batch_id):
        # one folder per micro-batch, replaced when it is replayed
        batch.write.mode("overwrite").parquet(f"{run}/state/_batch={batch_id}")

    arriving = ev.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    for _ in ingest.stage_steps(arriving, f"{run}/in", "_at", ARRIVALS):
        stream = spark.readStream.schema(ev.schema).parquet(f"{run}/in/arrived=*")
        state = ingest.job_state_stream(SI.job_updates_from(stream), job="job_id", seq=["ts", "event_id"], ts="ts")
        q = (state.writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    rows = spark.read.option("basePath", f"{run}/state").parquet(f"{run}/state/_batch=*")
    cols = [c for c in rows.columns if c not in ("job_id", "_batch")]
    latest = rows.groupBy("job_id").agg(F.max(F.struct("_batch", *cols)).alias("s")).select("job_id", "s.*").drop("_batch")
    return latest.select("job_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "n_updates",
                         "status", "progress", "message", "error", "current_file",
                         F.coalesce(F.col("is_batch"), F.lit(False)).alias("is_batch"))


# Fixed stand-in values: a job is what a user does on one day, so its updates end with the day; jobs expire three days later.
JOB_MAX_AGE_DAYS = 3


def _daily_jobs(ev):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000))
    return SI.job_updates_from(ev).withColumn("job_id", F.concat_ws("-", F.col("job_id").cast("string"), day.cast("string")))


@query("job2_state_expiry", f"""WITH {SI.JOB_UPDATES_SQL.split("state AS")[0]}
daily AS (SELECT user_id_job || '-' || (epoch_us(ts) // 86400000000)::VARCHAR AS job_id, * EXCLUDE (user_id_job, job_id)
          FROM (SELECT *, job_id::VARCHAR AS user_id_job FROM upd))
SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at, count(*) AS n_updates,
       arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status,
       arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL) AS progress,
       arg_max(message, (ts, event_id)) FILTER (WHERE message IS NOT NULL) AS message,
       arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error,
       coalesce(arg_max(is_batch, (ts, event_id)) FILTER (WHERE is_batch IS NOT NULL), false) AS is_batch,
       epoch_us(max(ts)) // 1000 + {JOB_MAX_AGE_DAYS} * 86400000 < (SELECT max(epoch_us(ts)) // 1000 FROM upd) AS expired
FROM daily GROUP BY job_id""")
def job2_state_expiry(spark, sf):
    """JOB-2 with expiry over four arrivals: the last state of every job and whether it has left the store."""
    run = scratch_path(spark, f"job2x-{uuid.uuid4().hex}")
    ev = SI.table(spark, sf, "events")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{run}/state/_batch={batch_id}")

    for _ in ingest.stage_steps(ev.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), f"{run}/in", "_at", ARRIVALS):
        stream = spark.readStream.schema(ev.schema).parquet(f"{run}/in/arrived=*")
        states = ingest.expiring_job_states(_daily_jobs(stream), f"{JOB_MAX_AGE_DAYS} DAYS", seq=["ts", "event_id"])
        (states.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{run}/checkpoint")
         .trigger(availableNow=True).start()).awaitTermination()
    rows = spark.read.option("basePath", f"{run}/state").parquet(f"{run}/state/_batch=*")
    cols = [c for c in rows.columns if c not in ("job_id", "_batch")]
    last = rows.groupBy("job_id").agg(F.max(F.struct("_batch", *cols)).alias("s")).select("job_id", "s.*")
    return last.select("job_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"), "n_updates",
                       "status", "progress", "message", "error", F.coalesce("is_batch", F.lit(False)).alias("is_batch"), "expired")

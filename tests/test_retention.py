"""FLT-1 on the registry kept by day, and the expiring job states of JOB-2."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from hashsieve.operators import jobs
from hashsieve.sources import daily, stores
from hashsieve.streaming import ingest


def registry(spark, rows):
    """Registry rows of (seq, created_at or None)."""
    df = spark.createDataFrame(rows, "seq long, created string")
    return df.select(*[(F.col("seq") if f.name == "seq" else F.col("created").cast("timestamp") if f.name == "created_at" else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in stores.REGISTRY.fields])


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "/day=" in d}


def seqs(spark, root, version=None):
    return sorted(r.seq for r in daily.load(spark, root, version).collect())


def test_only_the_border_day_is_rewritten(spark, tmp_path):
    root = str(tmp_path / "reg")
    assert daily.load(spark, root).count() == 0 and daily.cleanup(spark, root, "2024-03-15 00:00:00") == 0 and daily.vacuum(spark, root) == []
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        rows = [(1, "2024-01-01 10:00:00"), (2, "2024-02-14 11:59:59"), (3, "2024-02-14 12:00:00"), (4, "2024-02-20 01:00:00"), (5, None), (6, "2024-03-01 00:00:00")]
        assert daily.append(registry(spark, rows[:4]), root) == 1 and daily.append(registry(spark, rows[4:]), root) == 2
        before = files(root)
        assert seqs(spark, root) == [1, 2, 3, 4, 5, 6] and seqs(spark, root, 1) == [1, 2, 3, 4]
        assert daily.cleanup(spark, root, "2024-03-15 12:00:00", 30) == 2
        assert seqs(spark, root) == [3, 4, 5, 6] and seqs(spark, root, 2) == [1, 2, 3, 4, 5, 6]
        after = files(root)
        assert {f: after[f] for f in before} == before
        new = [f for f in after if f not in before]
        assert len(new) == 1 and new[0].startswith("write=00000003/day=19767/")
        assert daily.cleanup(spark, root, "2024-03-15 12:00:00", 30) == 0 and stores.versions(spark, root) == [1, 2, 3]
        # at the start of a day nothing is rewritten, expired days just leave the manifest
        assert daily.cleanup(spark, root, "2024-03-16 00:00:00", 30) == 1 and stores.versions(spark, root) == [1, 2, 3, 4]
        assert set(files(root)) == set(after)
        want = stores.REGISTRY
        plain = stores.load_registry(spark, str(tmp_path / "plain"))
        assert daily.load(spark, root).schema == plain.schema == want
        dropped = daily.vacuum(spark, root)
        assert len(dropped) == 3 and stores.versions(spark, root) == [4] and seqs(spark, root) == [4, 5, 6]
        assert {f.rsplit("/", 1)[0] for f in files(root)} == {"write=00000001/day=19773", f"write=00000002/day={daily.NO_DAY}", "write=00000002/day=19783"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_days_equal_the_plain_registry(spark, tmp_path):
    import random
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if rnd.random() < 0.1 else str(start + dt.timedelta(minutes=rnd.randrange(60 * 24 * 60)))) for i in range(400)]
    by_day, plain = str(tmp_path / "days"), str(tmp_path / "plain")
    for k in range(3):
        daily.append(registry(spark, rows[k::3]), by_day)
    stores.save_registry(registry(spark, rows), plain, 1)
    for now in ("2024-02-10 07:31:00", "2024-02-10 07:31:00", "2024-02-25 00:00:00", "2024-06-01 00:00:00"):
        assert daily.cleanup(spark, by_day, now) == stores.cleanup_registry(spark, plain, now)
        assert seqs(spark, by_day) == sorted(r.seq for r in stores.load_registry(spark, plain).collect())


def test_a_version_without_its_mark_is_not_read(spark, tmp_path):
    root = str(tmp_path / "reg")
    daily.append(registry(spark, [(1, "2024-01-01 10:00:00")]), root)
    daily.append(registry(spark, [(2, "2024-01-01 11:00:00")]), root)
    os.remove(os.path.join(root, "version=00000002", "_SUCCESS"))
    assert seqs(spark, root) == [1]
    with pytest.raises(FileNotFoundError):
        daily.load(spark, root, 2)
    assert daily.append(registry(spark, [(3, None)]), root) == 2 and seqs(spark, root) == [1, 3]


UPDATE = "job_id long, ts timestamp, n int, status string, progress double, completed_files int, is_batch boolean, other string"


def updates(spark, rows):
    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(j, None if h is None else base + dt.timedelta(hours=h), n, *rest) for j, h, n, *rest in rows], UPDATE)


def test_expired_jobs_leave_the_store(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [
        [(1, 0, 1, "queued", None, 0, None, "x"), (1, 1, 2, "running", 0.25, 3, True, None), (2, 0, 3, "queued", 1e-7, None, None, None),
         (2, 0, 4, None, float("nan"), 2**31 - 1, False, None), (4, None, 9, "lost", None, None, None, None)],
        [(3, 40, 5, "queued", None, None, None, None), (1, 30, 6, "done", 1.0, 5, None, None)],
        [(3, 41, 7, "done", 0.5, 1, None, None), (2, 41, 8, "again", None, None, None, None)],
    ]

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    for k, rows in enumerate(arrivals):
        updates(spark, rows).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(UPDATE).parquet(f"{source}/*")
        (ingest.expiring_job_states(stream, "1 DAY", seq=["ts", "n"]).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()).awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/_batch=*").orderBy("_batch").collect()
    last, expired = {r.job_id: r for r in rows}, {r.job_id for r in rows if r.expired}
    assert expired == {2, 4}
    # job 2 left the store at hour 40 and starts anew; 1 and 3 equal the batch fold
    assert (last[2].n_updates, last[2].status, last[2].expired, last[2].progress) == (1, "again", False, None)
    gone = next(r for r in rows if r.job_id == 2 and r.expired)
    assert (gone.n_updates, gone.status, gone.completed_files, gone.is_batch) == (2, "queued", 2**31 - 1, False) and gone.progress != gone.progress
    want = {r.job_id: r for r in jobs.fold_state(updates(spark, sum(arrivals, [])), seq=["ts", "n"]).collect()}
    for job in (1, 3):
        for field in ("created_at", "n_updates", "status", "progress", "completed_files"):
            assert getattr(last[job], field) == getattr(want[job], field), (job, field)
    assert last[1].is_batch is True and not last[1].expired and not last[3].expired


def test_a_job_in_many_chunks_folds_alike(spark, tmp_path):
    """One job with more updates than an Arrow batch holds, beside small ones."""
    source = str(tmp_path / "in")
    spark.range(25_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(-1).alias("job_id"),
                               F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 25_000).alias("ts"), F.col("id").cast("int").alias("n"),
                               F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("status"), (F.col("id") / 8).alias("progress"),
                               F.when(F.col("id") % 1000 == 1, F.col("id").cast("int")).alias("completed_files"), F.lit(None).cast("boolean").alias("is_batch"),
                               F.lit("x").alias("other")).write.parquet(source)
    stream = spark.readStream.schema(UPDATE).parquet(source)
    (ingest.expiring_job_states(stream, "2 DAYS", seq=["ts", "n"]).writeStream.outputMode("update").format("memory").queryName("many_chunks")
     .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()).awaitTermination()
    names = ["job_id", "created_at", "n_updates", "status", "progress", "completed_files"]
    want = jobs.fold_state(spark.read.schema(UPDATE).parquet(source), seq=["ts", "n"]).select(names).collect()
    assert sorted(map(str, spark.table("many_chunks").select(names).collect())) == sorted(map(str, want))


def test_groups_hold_many_jobs(spark, tmp_path):
    """Four groups for 90 jobs: each job has its own expiry and its own state."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [[(j, j / 10, j, "queued", j / 4, j, j % 2 == 0, None) for j in range(90)] + [(None, 2, 0, "no job", None, None, None, None)],
                [(j, 30 + j / 100, 1000 + j, 'do"ne, é', None, None, None, None) for j in range(0, 90, 3)]]

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    for k, rows in enumerate(arrivals):
        updates(spark, rows).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(UPDATE).parquet(f"{source}/*")
        (ingest.expiring_job_states(stream, "1 DAY", seq=["ts", "n"], groups=4).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()).awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/_batch=*").orderBy("_batch").collect()
    last = {r.job_id: r for r in rows}
    # the latest update is at hour 30.87: untouched jobs whose last update is before hour 6.87 are gone
    assert {r.job_id for r in rows if r.expired} == {None} | {j for j in range(90) if j % 3 and j / 10 < 6.87}
    want = {r.job_id: r for r in jobs.fold_state(updates(spark, sum(arrivals, [])), seq=["ts", "n"]).collect()}
    assert last.keys() == want.keys()
    for job, row in last.items():
        for field in ("created_at", "n_updates", "status", "progress", "completed_files", "is_batch"):
            assert (getattr(row, field) or False) == (getattr(want[job], field) or False), (job, field)

"""Streaming ingest and live job state (DED-10, JOB-2).

DED-10: files arrive over time; each micro-batch is checked against the
registry as it stood after the previous batch, deduplicated inside itself,
and its own uniques are written as the next registry version.  ``foreachBatch``
gives each batch an id; version ``batch_id + 1`` of the registry is the commit record:

* results of batch b go to ``results/batch=b`` (overwritten on replay);
* then registry version ``b + 1`` = the batch's uniques.  The registry before
  batch b is the union of the versions up to b.

The registry is stored by its join key.  A registered fingerprint lies there once per table of
the similarity join (``tbl, tkey``: the fingerprint masked to the table's blocks), in the folder ``part`` of
its key.  A batch computes its own keys, reads the folders they fall in (a partition filter) and
joins them on the key; the registry is never keyed, exploded or listed whole again.  While a batch's keys are
few, Spark broadcasts them and the registry is not shuffled at all; the planner decides by the size
of the written keys.

Versions are merged like the levels of a log-structured tree: after every ``MERGE``-th version the last ``MERGE`` of
them become one segment, after ``MERGE`` of those one of the next level, and so on.  A row is
rewritten once per level, a reader opens at most ``MERGE`` - 1 segments of each.

So a batch writes what it adds, whatever the registry's size.  A batch that is
replayed after a failure recomputes from the versions up to ``b`` (still there;
nothing overwrites them) and rewrites the same two folders, so the outcome equals one
clean run.  When micro-batches arrive in ``seq`` order, the labels
equal those of DED-6 over the whole input.

JOB-2: the job-state fold of JOB-1 as a streaming aggregation (``update``
mode); each field keeps ``max(struct(seq, value))``, so state per job is one
row whatever the length of its log.  ``expiring_job_states`` is the form for streams that never end: a job without
updates for ``max_age`` leaves the store, with a last row that says so.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.hashing import DEFAULT_THRESHOLD
from ..operators.dedup import greedy_dedup
from ..operators.jobs import STATE_FIELDS, latest
from ..operators.similarity import DEFAULT_HOT_BUCKET_PAIRS, KeyScheme, scheme_pairs
from ..session import cut_lineage
from ..sources.stores import version_path, versions

REGISTRY_ROW = "seq LONG, fp LONG"
KEYED_ROW = "tbl INT, tkey LONG, seq LONG, fp LONG, part INT"
MERGED_DIR = "_merged"
PARTS = 256  # folders of a segment; the keys of a batch that is small beside the registry fall in few of them.  A segment has a file
# for each, so a small registry takes fewer.
MERGE = 8  # segments that make one of the next level


def part_of(parts: int = PARTS):
    """The folder of a key."""
    return F.pmod(F.xxhash64("tbl", "tkey"), F.lit(parts)).cast("int")


def _level(registry_root: str, level: int) -> str:
    return registry_root.rstrip("/") if level == 0 else f"{registry_root.rstrip('/')}/{MERGED_DIR}/level={level}"


def segments(spark: SparkSession, registry_root: str, up_to: int) -> list[str]:
    """Folders that make up the registry after version ``up_to``, the largest segments first."""
    found, at, level = [], 0, 0
    while MERGE ** (level + 1) <= up_to:
        level += 1
    while level >= 0:
        have = versions(spark, _level(registry_root, level))
        for v in have:
            # segment v of a level holds the MERGE**level versions up to v
            if at < v <= up_to and v - MERGE ** level == at:
                found.append(version_path(_level(registry_root, level), v))
                at = v
        level -= 1
    if at < up_to and any(at < v <= up_to for v in versions(spark, registry_root)):
        raise FileNotFoundError(f"{registry_root}: the registry before version {up_to} has a gap after version {at}")
    return found


def keyed_registry(spark: SparkSession, registry_root: str, up_to: int | None = None) -> DataFrame:
    """``tbl, tkey, seq, fp, part`` of the registry after a version (default: the last)."""
    up_to = max(versions(spark, registry_root), default=0) if up_to is None else up_to
    return _read_segments(spark, segments(spark, registry_root, up_to))


def ingested(spark: SparkSession, registry_root: str, up_to: int | None = None) -> DataFrame:
    """``seq, fp`` registered by the batches committed so far (or up to a version)."""
    return keyed_registry(spark, registry_root, up_to).filter(F.col("tbl") == 0).select("seq", "fp")


def _write_segment(rows: DataFrame, path: str) -> None:
    rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)


def commit(uniques: DataFrame, registry_root: str, version: int, threshold: int = DEFAULT_THRESHOLD, parts: int = PARTS) -> None:
    """Add ``seq, fp`` rows as a registry version, then merge the levels that are full.

    A merge that a failure cuts short is made good by the next one; until then readers use the smaller segments.
    """
    spark = uniques.sparkSession
    keyed = KeyScheme(threshold).tables(uniques.select("seq", "fp")).withColumn("part", part_of(parts))
    _write_segment(keyed, version_path(registry_root, version))
    level = 1
    while version % MERGE ** level == 0:
        path = version_path(_level(registry_root, level), version)
        if version not in versions(spark, _level(registry_root, level)):
            first = version - MERGE ** level
            step = MERGE ** (level - 1)
            smaller = [version_path(_level(registry_root, level - 1), v) for v in range(first + step, version + 1, step)
                       if v in versions(spark, _level(registry_root, level - 1))]
            if len(smaller) < MERGE:
                break
            _write_segment(_read_segments(spark, smaller), path)
        level += 1


def _read_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = spark.createDataFrame([], KEYED_ROW)
    for n, path in enumerate(paths):
        segment = spark.read.schema(KEYED_ROW).parquet(path)
        out = segment if n == 0 else out.unionByName(segment)
    return out


def registered_near(fps: DataFrame, registry_root: str, up_to: int, threshold: int = DEFAULT_THRESHOLD, parts: int = PARTS,
                    hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS) -> DataFrame:
    """``fp`` of the rows of ``fps`` that lie within the threshold of a fingerprint registered up to a version."""
    spark = fps.sparkSession
    scheme = KeyScheme(threshold)
    rows = fps.filter(F.col("fp").isNotNull()).select(F.col("fp").alias("l_fp")).distinct()
    keys = cut_lineage(scheme.tables(rows, "l_fp").withColumn("part", part_of(parts)))
    hit = [r.part for r in keys.select("part").distinct().collect()]  # at most ``parts`` numbers
    wanted = keys.select("tbl", "tkey").distinct()
    known = keyed_registry(spark, registry_root, up_to).filter(F.col("part").isin(hit)).select("tbl", "tkey", F.col("fp").alias("r_fp"))
    # only what shares a key with the batch goes on; its size follows the batch and the keys it hits
    known = cut_lineage(known.join(wanted, ["tbl", "tkey"], "left_semi"))
    return scheme_pairs(keys.select("tbl", "tkey", "l_fp"), known, scheme, (keys.count(), known.count()), hot_bucket_pairs).select(F.col("l_fp").alias("fp")).distinct()


def make_batch_handler(registry_root: str, results_root: str, threshold: int = DEFAULT_THRESHOLD,
                       seq: str = "seq", fp: str = "fp", parts: int = PARTS):
    """A ``foreachBatch`` function implementing DED-10 (see module docs)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id + 1 in versions(spark, registry_root):
            return  # already committed (replay of a finished batch)
        rows = cut_lineage(batch.select(F.col(seq).cast("long").alias("seq"), F.col(fp).cast("long").alias("fp")))
        near = registered_near(rows, registry_root, batch_id, threshold, parts) if batch_id else None  # the state this batch must see
        res = greedy_dedup(rows, threshold, matched=near, written=True)
        res.write.mode("overwrite").parquet(f"{results_root.rstrip('/')}/batch={batch_id:08d}")
        commit(res.filter(F.col("action") == "store_unique"), registry_root, batch_id + 1, threshold, parts)

    return handle


def start_ingest(stream: DataFrame, registry_root: str, results_root: str, checkpoint: str,
                 threshold: int = DEFAULT_THRESHOLD, seq: str = "seq", fp: str = "fp", available_now: bool = True, parts: int = PARTS):
    """Start DED-10 on a streaming frame of ``(seq, fp)`` rows; ``parts`` stays the same for the life of a registry."""
    w = (stream.writeStream.foreachBatch(make_batch_handler(registry_root, results_root, threshold, seq, fp, parts))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def job_state_stream(updates: DataFrame, job: str = "job_id", seq: list[str] | None = None, ts: str = "ts",
                     fields: list[str] | None = None) -> DataFrame:
    """JOB-2: streaming fold of job updates (use ``outputMode('update')``)."""
    seq = seq or [ts]
    fields = [f for f in (fields or STATE_FIELDS) if f in updates.columns]
    return updates.groupBy(job).agg(F.min(ts).alias("created_at"), F.count(F.lit(1)).alias("n_updates"),
                                    *[latest(f, seq) for f in fields])


NO_SEQ = -(1 << 63)  # a missing order value sorts first, as in a struct
JOB_GROUPS = 1 << 13  # groups of the job store; a call of Python folds what a group's jobs receive in a micro-batch


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A job's key as text that gives the key back."""
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)):
        return c.cast("string")
    return F.to_json(F.struct(c.alias("k")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def _from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)):
        return c.cast(kind)
    return F.from_json(c, T.StructType([T.StructField("k", kind)]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})["k"]


def _merge(state: list, update: list, width: int) -> None:
    """Fold an update ``[ts, seq..., field...]`` into its job's state ``[created, last, n_updates, per field (seq..., value) of the latest update that set it]``."""
    at = update[0]
    if at is not None:
        at = int(at)
        state[0] = at if state[0] is None else min(state[0], at)
        state[1] = at if state[1] is None else max(state[1], at)
    state[2] += 1
    order = [int(s) for s in update[1:width]]
    for k, value in enumerate(update[width:], 3):
        if value is not None and (state[k] is None or state[k] < [*order, value]):
            state[k] = [*order, value]


def expiring_job_states(updates: DataFrame, max_age: str, delay: str = "0 seconds", job: str = "job_id", seq: list[str] | None = None,
                        ts: str = "ts", fields: list[str] | None = None, groups: int = JOB_GROUPS) -> DataFrame:
    """JOB-2 with a bounded store (use ``outputMode('update')``): ``job, created_at, n_updates``, the fields, ``expired``.

    A job whose last update is more than ``max_age`` behind the watermark (the latest time seen less ``delay``)
    is removed; its last state comes out once more with ``expired`` true.  An update after that starts the job anew.  ``ts`` and
    the columns of ``seq`` are times or whole numbers; updates without a time do not move a job's expiry, and a job without
    any time expires ``max_age`` after the watermark at its last update.  Of updates at one place of the order, the largest value, as text, counts.

    The store is kept by ``groups`` hash groups of jobs, so a call of Python, its frames and its state serve all the group's
    jobs of a micro-batch.  A group's timer is the first expiry among its jobs.  ``groups`` stays the same for the life of a
    store.  A group's updates come in chunks and a job's state is its latest values, so a huge log is never held whole.
    """
    seq = seq or [ts]
    fields = [f for f in (fields or STATE_FIELDS) if f in updates.columns]
    schema = updates.schema
    age = updates.sparkSession.range(1).select(F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {max_age}"))
                                               - F.unix_micros(F.timestamp_seconds(F.lit(0)))).first()[0] // 1000

    def whole(name: str):
        c = F.col(name)
        is_time = schema[name].dataType.typeName().startswith("timestamp")
        return F.coalesce(F.unix_micros(c.cast("timestamp")) if is_time else c.cast("long"), F.lit(NO_SEQ))

    # an update and a job's state travel as JSON arrays of texts: one column instead of one for each field
    texts = [_as_text(F.col(job), schema[job].dataType), F.unix_micros(F.col(ts).cast("timestamp")).cast("string"),
             *[whole(s).cast("string") for s in seq], *[F.col(f).cast("string") for f in fields]]
    rows = updates.select(F.pmod(F.xxhash64(job), F.lit(groups)).alias("__group"), F.col(ts).cast("timestamp").alias("__at"),
                          F.to_json(F.array(*texts)).alias("__update"))
    width, empty = len(seq) + 1, [None, None, 0, *[None] * len(fields)]

    def run(key, chunks, held):
        # [expiry, state] of each live job
        jobs = {name: rest for name, *rest in json.loads(held.get[0])} if held.exists else {}
        now, touched, out = held.getCurrentWatermarkMs(), {}, []
        if not held.hasTimedOut:
            for chunk in chunks:
                for name, *update in json.loads(f"[{','.join(chunk['__update'])}]"):
                    state = touched.get(name)
                    if state is None:
                        state = touched[name] = jobs[name][1] if name in jobs else [*empty]
                    _merge(state, update, width)

        def shown(name, state, expired):
            values = [v and v[-1] for v in state[3:]]
            out.append(json.dumps([name, state[0], state[2], *values, expired], ensure_ascii=False))

        for name, state in touched.items():
            last = state[1] // 1000 if state[1] is not None else now
            jobs[name] = [max(now + 1, last + age), state]
            shown(name, state, False)
        for name in [n for n, (expiry, _) in jobs.items() if expiry < now]:  # never one that was touched
            shown(name, jobs.pop(name)[1], True)
        if jobs:
            held.update((json.dumps([[name, *rest] for name, rest in jobs.items()], ensure_ascii=False),))
            held.setTimeoutTimestamp(min(expiry for expiry, _ in jobs.values()))
        else:
            held.remove()
        yield pd.DataFrame({"__state": out})

    states = rows.withWatermark("__at", delay).groupBy("__group").applyInPandasWithState(
        run, "__state string", "jobs string", "update", GroupStateTimeout.EventTimeTimeout)
    parts = F.from_json("__state", "array<string>")
    return states.select(parts.alias("s")).select(
        _from_text(F.get("s", F.lit(0)), schema[job].dataType).alias(job), F.timestamp_micros(F.get("s", F.lit(1)).cast("long")).alias("created_at"),
        F.get("s", F.lit(2)).cast("long").alias("n_updates"),
        *[F.get("s", F.lit(3 + k)).cast(schema[f].dataType).alias(f) for k, f in enumerate(fields)],
        F.get("s", F.lit(3 + len(fields))).cast("boolean").alias("expired"))


def stage_steps(df: DataFrame, folder: str, order: str, steps: int):
    """Write ``df`` as ``steps`` contiguous ranges of ``order``, one folder each, yielding after each of them.

    Whoever iterates processes what has arrived so far: the order of arrival is the order of the
    folders, whatever file times a store keeps.  A step is written by many tasks.
    """
    bounds = df.approxQuantile(order, [k / steps for k in range(1, steps)], 0.001) if steps > 1 else []
    c = F.col(order).cast("double")
    for k in range(steps):
        part = df
        if k > 0:
            part = part.filter(c > bounds[k - 1])
        if k < steps - 1:
            part = part.filter((c <= bounds[k]) | (c.isNull() if k == 0 else F.lit(False)))
        path = f"{folder.rstrip('/')}/arrived={k:04d}"
        part.write.mode("overwrite").parquet(path)
        yield path

"""Session helpers.

On a cluster the session is built by the caller (spark-submit, a notebook);
these helpers only fill in what is missing.  ``local_session`` is for tests,
``bench.py`` and the examples.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in the library relies on.  They are applied only when a
# session is created here; an existing session keeps its own configuration.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "hashsieve",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("HASHSIEVE_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    It is read from the session (``spark.checkpoint.dir`` or a directory set on
    the context).  Only a local-mode session without one gets a fresh scratch
    folder; a cluster session without one is a configuration error, because a
    machine-local folder is not visible to other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) before running iterative jobs")
    scratch = tempfile.mkdtemp(prefix="hashsieve-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir() or scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables, next to the checkpoints (shared storage).

    All of an application's tables lie in one folder, which is deleted when its driver ends.
    """
    sc = spark.sparkContext
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/{sc.applicationId}"
    if getattr(sc, "_hashsieve_scratch", None) != folder:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._hashsieve_scratch = folder
    return f"{folder}/{name}"


def spread(df, min_partitions: int | None = None):
    """Rebalance ``df`` before heavy per-row work when its scan is under-split.

    A large unsplittable file (one Parquet row group, a gzip file) is read by a
    single task.  When the frame has fewer partitions than the cluster's default
    parallelism it is round-robin repartitioned to that parallelism; otherwise
    (the normal case at scale: many files, many splits) it is returned as is and
    no shuffle is added.  The partition count is known at planning time.
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def cut_lineage(df):
    """``df`` written as a table in the shared checkpoint folder, and read again.

    Used where later steps read the same rows several times and must see the
    same values (or to keep iterative plans short).  The result survives the loss
    of the executors that computed it, is computed once (a reliable checkpoint
    runs its plan twice), and has the sizes the planner needs for its joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

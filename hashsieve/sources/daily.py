"""The registry kept by day of creation, with retention by folder (FLT-1 on the stored registry).

Layout under a root::

    write=<n>/day=<d>/*.parquet       rows, by the day they were created on
    version=<n>/                      the manifest: a row (day, write, n_rows) per folder in use

A version is its manifest.  Retention writes a manifest that leaves out the folders of
expired days and rewrites the one day that the cut-off falls into; the files of all other days
are neither read nor copied, whatever the registry's size.  What is removed is counted from the manifest.
Older versions stay readable until ``vacuum`` deletes the folders that no kept version lists.

A manifest counts once its ``_SUCCESS`` lies there, which is last; a run that dies before leaves the
last version in place, and a rerun replaces what it wrote.  ``d`` counts days since 1970 in UTC, so it does not
depend on a session's time zone; rows without a time lie under ``NO_DAY`` and are always kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import REGISTRY, _fs, version_path, versions, write_version

MANIFEST = "day INT, write INT, n_rows LONG"
NO_DAY = -(1 << 31)
DAY_MICROS = 86_400_000_000
_WRITE = re.compile(r"write=(\d+)$")


def _day(created_at: str = "created_at") -> Column:
    return F.coalesce(F.floor(F.unix_micros(created_at) / F.lit(DAY_MICROS)).cast("int"), F.lit(NO_DAY))


def _write_path(root: str, write: int) -> str:
    return f"{root.rstrip('/')}/write={write:08d}"


def manifest(spark: SparkSession, root: str, version: int | None = None) -> list:
    """``day, write, n_rows`` of a version (default: the last): a row per day, as a listing of folders would be."""
    known = versions(spark, root)
    if version is not None and version not in known:
        raise FileNotFoundError(f"{root} has no version {version}")
    if not known:
        return []
    return spark.read.schema(MANIFEST).parquet(version_path(root, known[-1] if version is None else version)).orderBy("day", "write").collect()


def _read(spark: SparkSession, root: str, entries: list) -> DataFrame:
    paths = [f"{_write_path(root, e.write)}/day={e.day}" for e in entries]
    return spark.read.schema(REGISTRY).parquet(*paths) if paths else spark.createDataFrame([], REGISTRY)


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The registry at a version (default: the last); empty when nothing was saved."""
    return _read(spark, root, manifest(spark, root, version))


def _write(rows: DataFrame, root: str, write: int) -> list[tuple]:
    """Write ``rows`` by day and return the folders with their row counts (from the files' footers)."""
    spark = rows.sparkSession
    path = _write_path(root, write)
    rows.select(*[f.name for f in REGISTRY.fields], _day().alias("day")).write.mode("overwrite").partitionBy("day").parquet(path)
    found = spark.read.schema("day INT").parquet(path).groupBy("day").count().collect()
    return [(r.day, write, r["count"]) for r in found]


def _commit(spark: SparkSession, root: str, version: int, entries: list[tuple]) -> None:
    write_version(spark.createDataFrame(entries, MANIFEST).coalesce(1), root, version)


def append(rows: DataFrame, root: str) -> int:
    """Add registry rows as the next version and return its number; earlier folders are shared, not copied."""
    spark = rows.sparkSession
    version = max(versions(spark, root), default=0) + 1
    before = [tuple(e) for e in manifest(spark, root)]
    _commit(spark, root, version, before + _write(rows, root, version))
    return version


def cleanup(spark: SparkSession, root: str, now, max_age_days: int = 30) -> int:
    """FLT-1: keep entries created at or after ``now - max_age_days`` (or without a time); the number removed.

    A new version is written only if something was removed.
    """
    from ..operators.validation import retention

    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    cutoff = spark.range(1).select(F.unix_micros(at - F.expr(f"INTERVAL {int(max_age_days)} DAYS"))).first()[0]
    border, inside = divmod(cutoff, DAY_MICROS)
    entries = manifest(spark, root)
    expired = [e for e in entries if NO_DAY < e.day < border]
    split = [e for e in entries if e.day == border and inside]
    kept = [tuple(e) for e in entries if e not in expired and e not in split]
    removed = sum(e.n_rows for e in expired)
    version = max(versions(spark, root), default=0) + 1
    left = retention(_read(spark, root, split), "created_at", at, max_age_days)
    gone = sum(e.n_rows for e in split) - (left.count() if split else 0)
    kept += _write(left, root, version) if gone else [tuple(e) for e in split]
    removed += gone
    if removed:
        _commit(spark, root, version, kept)
    return removed


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete manifests but the last ``keep`` and the day folders that none of these lists; the folders deleted.

    To run while nobody writes, and after readers of older versions are done.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    known = versions(spark, root)
    if not known:
        return []
    used = {f"{_write_path('', e.write)}/day={e.day}" for v in known[-keep:] for e in manifest(spark, root, v)}
    fs, p = _fs(spark, root)
    deleted = []
    for version in known[:-keep]:
        fs.delete(_fs(spark, version_path(root, version))[1], True)
    for folder in fs.listStatus(p):
        if not _WRITE.search(folder.getPath().getName()):
            continue
        for day in fs.listStatus(folder.getPath()):
            name = f"/{folder.getPath().getName()}/{day.getPath().getName()}"
            if day.isDirectory() and name not in used:
                fs.delete(day.getPath(), True)
                deleted.append(name.lstrip("/"))
    return sorted(deleted)

"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, spread

# Decisions about rows (doc ids and a few numbers) are broadcast up to this many
# rows, about 16 MB; beyond it the planner joins by shuffle.
MAX_BROADCAST_DECISIONS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared checkpoint folder and read it back.

    A writer holds one row group per task in memory: ``row_group`` (bytes) keeps it small for wide rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str = "doc_id") -> Column:
    """``crc32`` of the id's decimal text modulo 5; 0 is the held-out fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from.  A null id has no fold and is held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_hashsieve_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="hashsieve-pyfiles-"), "hashsieve_pyfiles.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._hashsieve_shipped = True


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over a scan that is spread over the cluster when it has too few splits."""
    ship(df.sparkSession)
    return spread(df).mapInArrow(fn, schema)


_KEPT: dict[str, Any] = {}  # at most one entry: what this worker holds for later tasks of the same operator


def kept(key: str, build: Callable[[], Any]) -> Any:
    """``build()``, held by the worker for its later tasks until one of another key or operator begins (see ``freed``)."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = build()
    return _KEPT[key]


def let_go() -> None:
    if _KEPT:
        _KEPT.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def freed(fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
          keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for ``mapInArrow``; the worker, which lives on, gives its unused memory back at the end of the task.

    What an earlier operator left in the worker (``kept``) goes first, unless ``fn`` itself ``keeps`` something.
    """

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        try:
            yield from fn(incoming)
        finally:
            trim()

    return run


def row_blocks(column: pa.Array, max_rows: int, max_bytes: int) -> Iterator[tuple[int, list]]:
    """Where each block starts and its byte strings: at most ``max_rows`` rows and, beyond the first row, ``max_bytes``."""
    at, held, size = 0, [], 0
    for start in range(0, len(column), max_rows):
        for value in strings(column.slice(start, max_rows)):
            if held and (len(held) >= max_rows or size + len(value or b"") > max_bytes):
                yield at, held
                at, held, size = at + len(held), [], 0
            held.append(value)
            size += len(value or b"")
    if held:
        yield at, held


def strings(column: pa.Array) -> list:
    """UTF-8 ``bytes`` (or None) of a string column, without decoding them."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 2000, max_bytes: int = 8 << 20,
            weigh: Callable[[tuple], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Pack row tuples into record batches bounded in rows and, with ``weigh``, in bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) if weigh else 0
        if len(held) >= max_rows or size >= max_bytes:
            yield _pack(held, schema)
            held, size = [], 0
    if held:
        yield _pack(held, schema)


def _pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def drop_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not among ``dropped``.

    The usual filter drops few rows, so the small side travels: up to
    ``MAX_BROADCAST_DECISIONS`` ids (counted first) are broadcast and the texts
    stay where they are; more are joined by shuffle.  Null keys are never dropped.
    """
    ids = dropped.filter(F.col(key).isNotNull()).select(F.col(key).alias("__dropped_id"))
    if ids.limit(MAX_BROADCAST_DECISIONS + 1).count() <= MAX_BROADCAST_DECISIONS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key] == ids["__dropped_id"], "left_anti")

"""Exact dedup by Grace hashing.

Records are partitioned by a digest of their normalised text.  Each task fills
an open-addressing table that compares complete content; when the contents in
it outgrow the memory budget, the table and the rest of the stream go to spill
files by the next four bits of the digest, and each file is treated the same
way, until every bucket fits.  Copies collapse in the table, so only distinct
contents can overflow it and four more bits always separate them.

A combiner with the same table (flushed when full) runs on each input split
before the shuffle: a text held by a third of all rows leaves every split as one
record.  Spill files are anonymous files of the one task that reads them, like
Spark's own spills; nothing is shared through them and a lost executor takes
none of the result with it.

Defined cases: null text is the empty text; equality ignores the case of A-Z
only; the largest doc_id stays, a null doc_id ranks below all others; rows that
repeat one doc_id and text are one document (``decisions`` marks each of them,
``survivors`` returns one); extra columns of any name pass through
``survivors`` and are ignored by ``decisions``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, freed, map_rows, strings, table

TABLE_BYTES = 48 << 20  # content held by one table before it spills (or, in the combiner, is flushed)
FANOUT_BITS = 4


class ContentTable:
    """Open addressing with linear probing over (digest, content) -> [doc_id, rows, text, extra]."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, doc_id, rows: int, text: bytes, extra) -> None:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self.slots[at]) >= 0:
            held = self.entries[k]
            if held[0] == digest and held[1] == content:
                held[3] += rows
                if _ranks_above(doc_id, text, extra, held):
                    held[2], held[4], held[5] = doc_id, text, extra
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, doc_id, rows, text, extra])
        self.bytes += 2 * len(content) + 200
        if 3 * len(self.entries) > 2 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _ranks_above(doc_id, text: bytes, extra, held: list) -> bool:
    if doc_id == held[2]:
        return (text, repr(extra)) > (held[4], repr(held[5]))
    return doc_id is not None and (held[2] is None or doc_id > held[2])


def _record(doc_id, rows: int, text: bytes | None, extra) -> tuple:
    text = text or b""
    content = text.lower()  # bytes.lower changes A-Z only
    return hashlib.sha256(content).digest(), content, doc_id, rows, text, extra


def combine(records: Iterable[tuple], budget: int = TABLE_BYTES) -> Iterator[list]:
    """Collapse copies within a bounded table; flushed whenever it is full."""
    seen = ContentTable()
    for record in records:
        seen.add(*record)
        if seen.bytes > budget:
            yield from seen.entries
            seen = ContentTable()
    yield from seen.entries


def grace(records: Iterable[tuple], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """One entry per distinct content, using at most about ``budget`` bytes of content at a time."""
    seen = ContentTable()
    records = iter(records)
    for record in records:
        seen.add(*record)
        if seen.bytes > budget and len(seen.entries) > 1 and level < 256 // FANOUT_BITS:
            break
    else:
        yield from seen.entries
        return
    files = [tempfile.TemporaryFile() for _ in range(1 << FANOUT_BITS)]
    try:
        for part in (seen.entries, records):
            for record in part:
                pickle.dump(tuple(record), files[_digit(record[0], level)], protocol=5)
            seen = None
        while files:
            with files.pop() as spill:
                spill.seek(0)
                yield from grace(_unspill(spill), budget, level + 1)
    finally:
        for spill in files:
            spill.close()


def _digit(digest: bytes, level: int) -> int:
    byte = digest[level // 2]
    return byte >> 4 if level % 2 == 0 else byte & 15


def _unspill(spill) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(spill)
        except EOFError:
            return


def _records(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in incoming:
        extras = batch.column("__extra").to_pylist() if "__extra" in batch.schema.names else [None] * batch.num_rows
        yield from map(_record, batch.column("__id").to_pylist(), batch.column("__rows").to_pylist(),
                       strings(batch.column("__text")), extras)


def _distinct(docs: DataFrame, budget: int, payload: T.StructType | None) -> DataFrame:
    """One row per distinct content: ``__digest, __id`` (largest), ``__rows``, and with ``payload`` its row."""
    id_type = docs.schema["__id"].dataType
    fields = [T.StructField("__id", id_type), T.StructField("__rows", T.LongType()), T.StructField("__text", T.StringType())]
    if payload is not None:
        fields.append(T.StructField("__extra", payload))
    carried = T.StructType([T.StructField("__bucket", T.LongType()), *fields])
    done = T.StructType([T.StructField("__digest", T.StringType()), *(f for f in fields if payload is not None or f.name != "__text")])
    carried_pa, done_pa = to_arrow_schema(carried), to_arrow_schema(done)

    def combined(incoming):
        rows = ((int.from_bytes(e[0][:8], "big", signed=True), e[2], e[3], e[4].decode("utf-8", "replace"), e[5])[: len(carried)]
                for e in combine(_records(incoming), budget))
        yield from batches(rows, carried_pa, weigh=lambda r: len(r[3]))

    def reduced(incoming):
        if payload is None:
            rows = ((e[0].hex(), e[2], e[3]) for e in grace(_records(incoming), budget))
        else:
            rows = ((e[0].hex(), e[2], e[3], e[4].decode("utf-8", "replace"), e[5]) for e in grace(_records(incoming), budget))
        yield from batches(rows, done_pa, weigh=lambda r: len(r[3]) if payload is not None else 0)

    return map_rows(docs, freed(combined), carried).repartition("__bucket").mapInArrow(freed(reduced), done)


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The digest names a group because the tables above have compared the complete
    contents behind it; rows find their group by a join on it (both sides plain
    exchanges, so a hot digest is split by the skew join).
    """
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.lit(1).cast("long").alias("__rows"))
    groups = _distinct(base, budget, None)
    out = T.StructType([T.StructField("__id", base.schema["__id"].dataType), T.StructField("__sha", T.StringType())])
    out_pa = to_arrow_schema(out)

    def digests(incoming):
        for batch in incoming:
            hexes = [hashlib.sha256((t or b"").lower()).hexdigest() for t in strings(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(hexes, pa.string())], schema=out_pa)

    rows = map_rows(base.select("__id", "__text"), digests, out)
    groups = groups.select("__digest", F.col("__id").alias("__keep"), "__rows")
    return (rows.join(groups, rows["__sha"] == groups["__digest"])
            .select(F.col("__id").alias("doc_id"), F.col("__keep").alias("keep_id"), F.col("__rows").alias("group_size"),
                    F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"), F.col("__sha").alias("text_sha256")))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; texts cross one shuffle."""
    payload = docs.schema
    base = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.lit(1).cast("long").alias("__rows"),
                       F.struct(*[F.lit(None).cast(f.dataType).alias(f"c{i}") if f.name == text_col else F.col(f"`{f.name}`").alias(f"c{i}")
                                  for i, f in enumerate(payload)], F.col(text_col).isNull().alias("null_text")).alias("__extra"))
    kept = _distinct(base, budget, base.schema["__extra"].dataType)
    text = F.when(~F.col("__extra.null_text"), F.col("__text"))
    return kept.select(*[(text if f.name == text_col else F.col(f"__extra.c{i}")).alias(f.name) for i, f in enumerate(payload)])


ORACLE = r"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))

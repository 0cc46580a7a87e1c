"""Nearest neighbours by an exact block matrix join.

Vectors are stored a second time as int8 with one scale each.  Products of int8
tiles (exact integers) times the scales estimate inner products; with ``e`` the
norm of what quantisation cut off, ``|<x,y> - estimate| <= e_x |y| + |x^| e_y``.
In a tile only pairs whose upper bound reaches the query's k-th best lower
bound survive; these are recomputed in double precision from the original
vectors and merged by a heap per query.  The answer is that of brute force.

Candidates are dealt into blocks, each read by one task that holds it in memory
(``BLOCK_ROWS`` vectors, ``BLOCK_BYTES`` of components); the stated query set is sent to
every block and streamed past it, a chunk at a time.  So what is shuffled grows with queries
times blocks: vectors travel in the type they are stored in (float components stay
floats), a block holds them once besides their int8 codes, widened tile by tile, and small
tables get few blocks.  Survivors are recomputed where they lie: a dense group of near
copies never leaves its blocks.  Each block returns at most k rows per query, and the last
ranking merges those.

Vectors that are null, empty, zero or hold a null or non-finite component take no part.

Defined cases: vectors of different lengths are never compared; candidates that
share the query's vec_id are the query's own row; rows that repeat another
vec_id are candidates each; queries that repeat a vec_id count once, with the
smallest vector; ties in score go to the smaller vec_id; rows with a null
vec_id take no part; with fewer than k candidates all are returned; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import batches, ship, table

BLOCK_ROWS = 131_072  # candidates held by a task, at most
BLOCK_BYTES = 48 << 20  # their components, about: blocks are dealt by a hash
LEAST_ROWS = 4096  # blocks are not made smaller than this only to have more of them
TILE = 2048  # candidates in a product tile
CHUNK = 256  # queries in a product tile
PAIRS = 65_536  # pairs recomputed at once


class Quantised:
    """Vectors as they are stored and as int8 with scales and error norms, quantised a tile at a time."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.codes = np.empty(vectors.shape, np.int8)
        self.scale, self.norm, self.rounded_norm, self.error = np.empty((4, len(vectors)))
        # integer products of this type are exact
        self.product = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
        for at in range(0, len(vectors), TILE):
            self._quantise(slice(at, at + TILE))

    def _quantise(self, cut: slice) -> None:
        part = self.vectors[cut].astype(np.float64)
        peak = np.abs(part).max(axis=1)
        # norms are those of the vectors divided by their largest component: squares neither overflow nor vanish
        unit = part / peak[:, None]
        codes = np.rint(unit * 127.0)
        rounded = codes / 127.0
        self.codes[cut], self.scale[cut] = codes, peak / 127.0
        # a little is added for the rounding of these few double operations
        norm, rounded_norm, error = (np.sqrt((v ** 2).sum(axis=1)) * (1 + 1e-9) for v in (unit, rounded, unit - rounded))
        with np.errstate(over="ignore"):
            self.norm[cut], self.rounded_norm[cut], self.error[cut] = norm * peak, rounded_norm * peak, (error + 1e-12 * norm) * peak

    def tile(self, cut: slice) -> np.ndarray:
        return self.codes[cut].astype(self.product)

    @property
    def wide(self) -> np.ndarray:
        return self.tile(slice(None))

    def __len__(self) -> int:
        return len(self.ids)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k].astype(np.float64) * b[:, k]
    return total


def search(queries: Quantised, block: Quantised, k: int) -> list[list[tuple[float, int]]]:
    """Per query its k best (score, -id) in the block, as a heap."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(queries))]
    floor = np.full(len(queries), -np.inf)  # k-th best score so far
    wide = queries.wide
    with np.errstate(over="ignore", invalid="ignore"):  # components near the largest double: such pairs are recomputed
        for at in range(0, len(block), TILE):
            cut = slice(at, at + TILE)
            if (queries.norm * block.norm[cut].max() < floor).all():
                continue  # the norms alone say that no pair of the tile can enter
            estimate = (wide @ block.tile(cut).T).astype(np.float64) * queries.scale[:, None] * block.scale[None, cut]
            bound = queries.error[:, None] * block.norm[None, cut] + queries.rounded_norm[:, None] * block.error[None, cut]
            other = queries.ids[:, None] != block.ids[None, cut]
            lower = estimate - bound
            lower = np.where(other & ~np.isnan(lower), lower, -np.inf)
            limit = floor
            if lower.shape[1] >= k:
                limit = np.maximum(floor, np.partition(lower, -k, axis=1)[:, -k])
            rows, columns = np.nonzero(other & ~(estimate + bound < limit[:, None]))
            for part in range(0, len(rows), PAIRS):
                r, c = rows[part:part + PAIRS], columns[part:part + PAIRS] + at
                scores = inner(queries.vectors[r], block.vectors[c])
                for query, item in zip(r.tolist(), zip(scores.tolist(), (-block.ids[c]).tolist())):
                    heap = heaps[query]
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    return heaps


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    stored = vectors.schema[vector_col].dataType
    kept = "array<float>" if isinstance(stored, ArrayType) and isinstance(stored.elementType, FloatType) else "array<double>"
    return (vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .filter(finite & F.exists(vector_col, lambda x: x != 0))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kept).alias("vector"),
                    F.size(vector_col).alias("dim")))


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = BLOCK_ROWS,
               id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k nearest rows of ``vectors`` by inner product."""
    spark = vectors.sparkSession
    ship(spark)
    candidates, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    if candidates.schema["vector"].dataType != asked.schema["vector"].dataType:  # float and double: both as double
        candidates, asked = (df.withColumn("vector", F.col("vector").cast("array<double>")) for df in (candidates, asked))
    asked = asked.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    width = 4 if candidates.schema["vector"].dataType.elementType == FloatType() else 8
    total, components = candidates.agg(F.count(F.lit(1)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    blocks = max(math.ceil(total / block_rows), math.ceil(components * width / BLOCK_BYTES),
                 min(2 * spark.sparkContext.defaultParallelism, math.ceil(total / LEAST_ROWS)), 1)
    dealt = (candidates.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
             .withColumn("kind", F.lit(0)))
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(1))
    columns = ["dim", "block", "kind", "vec_id", "vector"]
    cells = (dealt.select(columns).unionByName(sent.select(columns))
             .repartition(blocks, "block").sortWithinPartitions("block", "dim", "kind", "vec_id"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        def found():
            here, held, block = None, [], None
            for batch in incoming:
                dims, at, kinds = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(3))
                ids = batch.column(3).to_numpy(zero_copy_only=False)
                lists = batch.column(4)
                cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(at) != 0) | (np.diff(kinds) != 0)) + 1
                for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                    flat = lists.slice(low, high - low).flatten().to_numpy(zero_copy_only=False)
                    rows = flat.reshape(high - low, int(dims[low]))
                    cell = (int(dims[low]), int(at[low]))
                    if cell != here:
                        here, held, block = cell, [], None
                    if kinds[low] == 0:
                        held.append((ids[low:high], rows))
                        continue
                    if block is None and held:
                        block, held = Quantised(np.concatenate([i for i, _ in held]), np.concatenate([r for _, r in held])), []
                    if block is None:
                        continue
                    for cut in range(0, high - low, CHUNK):
                        chunk = Quantised(ids[low:high][cut:cut + CHUNK], rows[cut:cut + CHUNK])
                        for query, heap in zip(chunk.ids.tolist(), search(chunk, block, k)):
                            for score, negative in heap:
                                yield query, -negative, score

        yield from batches(found(), schema, max_rows=20_000)

    best = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.filter(F.col("vec_id") % 20 == 0))

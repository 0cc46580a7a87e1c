"""Exact integer k-means with a PCA-rotated filter.

Vectors become integers ``floor(scale * x)`` and are written once, with the leading
``LEADING`` coordinates of a rotation to their principal axes and the norm of the rest.  For a vector x and
a centroid c

    |x - c|^2  >=  |leading(x) - leading(c)|^2 + (rest(x) - rest(c))^2,

where rest is the norm of the coordinates left out.  In a block the bounds to all centroids are
one small matrix product; the centroid with the least bound is measured in integers, and only
centroids whose bound does not exceed that distance survive and are measured too.  So every
assignment is exact, whatever the rotation, and ties go to the smaller number.

The principal axes come from the sums of products over all vectors, added up in Spark.  A round is one pass
over the written table; tasks return a row of sums per cluster, which Spark adds up in decimals.  The driver
holds the centroids (k vectors), never rows.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no
part; repeated ids are vectors each; starting vectors that tie in their hash go by their components; null ids are assigned but start
no centroid while others can; with fewer vectors than k there are fewer centroids; empty clusters keep
their centroid; components beyond 2^27 in size raise an error, as distances would not fit a long; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, ship, table, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
LEADING = 16  # rotated coordinates stored
BLOCK = 4096  # vectors filtered at once
LARGEST = 1 << 27


def usable(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``vec_id, v``: ids and integer components of the vectors that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) == dimensions)).filter(finite)
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall("s", lambda x: F.abs(x) <= F.lit(LARGEST))
    return (kept.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("s"))
            .select("vec_id", F.when(fits, F.col("s").cast("array<int>"))
                    .otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).alias("v")))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def principal_axes(vectors: DataFrame, dimensions: int) -> np.ndarray:
    """Rows: axes by falling variance.  Any rotation gives exact results; this one makes the bounds tight."""
    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])

    def run(incoming: Iterator[pa.RecordBatch]):
        total = np.zeros((dimensions + 1, dimensions + 1))
        for batch in incoming:
            x = np.hstack([matrix(batch.column(0), dimensions).astype(np.float64), np.ones((batch.num_rows, 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], schema=schema)

    parts = map_rows(vectors.select("v"), run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # (dimensions + 1)^2 numbers
    total = np.zeros((dimensions + 1, dimensions + 1))
    for row in sums:
        total[row.i, row.j] = row.s
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1].T


class Rotation:
    """Leading coordinates and the norm of the rest, of vectors and centroids alike."""

    def __init__(self, axes: np.ndarray, leading: int) -> None:
        self.axes, self.leading = axes, leading

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = x.astype(np.float64) @ self.axes.T
        return turned[:, :self.leading], np.sqrt((turned[:, self.leading:] ** 2).sum(axis=1))


def rotated(vectors: DataFrame, rotation: Rotation, dimensions: int) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("leading", pa.list_(pa.float64())), ("rest", pa.float64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        for batch in incoming:
            leading, rest = rotation(matrix(batch.column(1), dimensions))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * rotation.leading), pa.array(leading.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), lists, pa.array(rest)], schema=schema)

    return map_rows(vectors, run, "vec_id long, v array<int>, leading array<double>, rest double")


def nearest_centroids(x: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and exact squared distance of each row; the number of exact distances taken."""
    c_leading, c_rest = rotation(centroids)
    size = (leading ** 2).sum(axis=1)[:, None] + (c_leading ** 2).sum(axis=1)[None, :]
    bound = size - 2.0 * (leading @ c_leading.T) + (rest[:, None] - c_rest[None, :]) ** 2
    # rounding of these sums of products is far below this share of the sizes that enter them
    bound -= 1e-9 * (size + rest[:, None] ** 2 + c_rest[None, :] ** 2) + 1e-6
    guess = bound.argmin(axis=1)

    def exact(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        difference = x[rows].astype(np.int64) - centroids[numbers]
        return np.einsum("ij,ij->i", difference, difference)

    every = np.arange(len(x))
    distance = exact(every, guess)
    survivors = bound <= distance[:, None]
    survivors[every, guess] = False
    rows, numbers = np.nonzero(survivors)
    best = guess.astype(np.int64)
    measured = exact(rows, numbers)
    order = np.lexsort((numbers, measured, rows))  # per row the nearest survivor, ties to the smaller number
    rows, numbers, measured = rows[order], numbers[order], measured[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1) != 0)
    r, k, d = rows[first], numbers[first], measured[first]
    closer = (d < distance[r]) | ((d == distance[r]) & (k < best[r]))
    best[r[closer]], distance[r[closer]] = k[closer], d[closer]
    return best, distance, len(x) + len(rows)


def blocks(incoming: Iterator[pa.RecordBatch], centroids: np.ndarray, rotation: Rotation, dimensions: int):
    """``ids, x, cluster, distance`` per block of the rows of a rotated table."""
    for whole in incoming:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            x = matrix(batch.column(1), dimensions)
            best, distance, _ = nearest_centroids(x, matrix(batch.column(2), rotation.leading), batch.column(3).to_numpy(), centroids, rotation)
            yield batch.column(0), x, best, distance


def starting(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of least hash of their id, in the order of the hashes."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.withColumn("h", key).orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()  # k vectors
    return np.array([r.v for r in rows], np.int64)


def next_centroids(data: DataFrame, centroids: np.ndarray, rotation: Rotation, dimensions: int) -> np.ndarray:
    names = [f"s{i}" for i in range(dimensions)]
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), *((c, pa.int64()) for c in names)])

    def run(incoming: Iterator[pa.RecordBatch]):
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)

        def row():
            used = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(sums[used, i]) for i in range(dimensions))], schema=schema)

        since = 0
        for _, x, best, _ in blocks(incoming, centroids, rotation, dimensions):
            np.add.at(sums, best, x)
            counts += np.bincount(best, minlength=len(counts))
            since += len(x)
            if since > 1 << 34:  # sums of components up to 2^27 still fit
                yield row()
                sums[:], counts[:], since = 0, 0, 0
        yield row()

    parts = map_rows(data, run, ", ".join(["cluster int", "n long", *(f"{c} long" for c in names)]))
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in names)).collect()  # at most k rows
    moved = centroids.copy()
    for row in found:
        moved[row.cluster] = [int(row[c]) // row.n for c in names]
    return moved


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: str = "2:",
             leading: int = LEADING, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    ship(spark)
    whole = usable(vectors, id_col, vector_col, dimensions, scale)
    rotation = Rotation(principal_axes(whole, dimensions), min(leading, dimensions))
    data = written(rotated(whole, rotation, dimensions), "rotated")
    centroids = starting(data.select("vec_id", "v"), k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = next_centroids(data, centroids, rotation, dimensions)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        for ids, _, best, distance in blocks(incoming, centroids, rotation, dimensions):
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], schema=schema)

    return map_rows(data, run, "vec_id long, cluster int, distance long"), centroids


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL: every round compares all vectors with all centroids."""
    parts = ["""x AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT cluster, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS cluster, v FROM x)
  WHERE cluster < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(key) AS key FROM (
    SELECT x.row, x.vec_id, x.v, (list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c.cluster) AS key FROM x, c{r} c)
  GROUP BY row)""")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (SELECT cluster, list(mean ORDER BY i) AS v FROM (
    SELECT key[2] AS cluster, i, sum(v[i]) AS s, count(*) AS n, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END::BIGINT AS mean
    FROM a{r}, range(1, 65) t(i) GROUP BY key[2], i) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, key[2]::INTEGER AS cluster, key[1]::BIGINT AS distance, (sum(key[1]) OVER (PARTITION BY key[2]))::BIGINT AS cluster_inertia,
       (sum(key[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = key[2]"""


ORACLE = _oracle()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    found = written(found, "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    whole = sum(int(r.s) for r in sums)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(r.cluster, int(r.s), whole, digest[r.cluster]) for r in sums],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

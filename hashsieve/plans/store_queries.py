"""Registered queries over files that Spark writes from the driver tables and reads back (SRC-1..5, SNK-1, 2, 5, FPR-5, FPR-6).

Each writes into a fresh folder of the session's shared checkpoint folder.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import functions as F

from ..functions.hashing import long_to_hex
from ..operators.image_hashes import image_fingerprints
from ..session import scratch_path, spread
from ..sources import daily, stores
from . import standins as SI
from .registry import query

HEX = SI.hex_sql
# Fixed stand-in values.
CREATED = "2024-01-02 03:04:05"
HEADER = {"created_at": "2024-01-01T00:00:00", "last_updated": "2024-01-02T03:04:05", "version": "1.0",
          "stats": {"total_processed": 6, "duplicates_found": 1, "unique_images": 5}}


def _folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


# ------------------------------------------------------------------ registry
def _registry(spark, sf):
    """One registry row per distinct fingerprint of the documents; paths hold quotes, braces and backslashes."""
    fps = SI.doc_fingerprints(spark, sf).filter(F.col("fp").isNotNull())
    first = fps.groupBy("fp").agg(F.min(F.struct("doc_id", "source", "n_chars", "n_tokens")).alias("d")).select("fp", "d.*")
    path = F.concat(F.lit('{"'), F.coalesce("source", F.lit("")), F.lit('"}, \\{'), F.col("doc_id").cast("string"), F.lit('}: "\\'))
    return first.select(long_to_hex("fp").alias("phash"), *[F.lit(None).cast("string").alias(c) for c in ("ahash", "dhash", "whash")], "fp",
                        F.col("n_tokens").cast("int").alias("width"), F.lit(1).alias("height"), F.col("source").alias("image_mode"),
                        F.col("n_chars").cast("long").alias("file_size"), F.lit(CREATED).cast("timestamp").alias("created_at"),
                        path.alias("source_path"), F.col("doc_id").cast("long").alias("seq"))


_REGISTRY_SQL = f"""WITH {SI.SIMHASH_SQL},
reg AS (SELECT fp, min(doc_id) AS doc_id FROM fps WHERE fp IS NOT NULL GROUP BY fp),
rows AS (SELECT {HEX('reg.fp')} AS phash, {HEX('reg.fp')} AS fp_hex, f.n_tokens::INTEGER AS width, f.source AS image_mode, f.n_chars::BIGINT AS file_size,
                '{CREATED}' AS created, '{{"' || coalesce(f.source, '') || '"}}, \\{{' || f.doc_id::VARCHAR || '}}: "\\' AS source_path, f.doc_id AS seq
         FROM reg JOIN fps f USING (doc_id))
"""


def _shown(rows):
    return rows.select("phash", long_to_hex("fp").alias("fp_hex"), "width", "image_mode", "file_size",
                       F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"), "source_path", "seq")


@query("src1_registry_round_trip", _REGISTRY_SQL + f"""
SELECT *, '{HEADER["version"]}' AS version, {HEADER["stats"]["unique_images"]}::BIGINT AS unique_images, true AS has_size FROM rows""")
def src1_registry_round_trip(spark, sf):
    """SNK-1 and SRC-1: the registry saved as a version with its header, and loaded."""
    root = _folder(spark, "src1")
    stores.save_registry(_registry(spark, sf), root, 1, HEADER)
    meta = stores.load_registry_meta(spark, root)
    return _shown(stores.load_registry(spark, root)).withColumns({
        "version": F.lit(meta["version"]), "unique_images": F.lit(meta["stats"]["unique_images"]).cast("long"),
        "has_size": F.lit(stores.size_mb(spark, root) > 0)})


@query("src2_registry_document", _REGISTRY_SQL + f"""
SELECT * REPLACE (row_number() OVER (ORDER BY seq) - 1 AS seq), '{HEADER["last_updated"]}' AS last_updated FROM rows""")
def src2_registry_document(spark, sf):
    """SNK-2 and SRC-2: the registry as one JSON document in ordered parts, cut into its entries in parallel."""
    path = _folder(spark, "src2")
    stores.export_registry_map(_registry(spark, sf), path, HEADER)
    return _shown(stores.import_registry_json(spark, path)).withColumn("last_updated", F.lit(stores.import_registry_meta(spark, path)["last_updated"]))


# ------------------------------------------------------------------ product types
@query("src5_product_types", f"""WITH {SI.DYNAMIC_TYPES_SQL}
SELECT (row_number() OVER (ORDER BY position) - 1)::INTEGER AS position, product_type FROM dyn""")
def src5_product_types(spark, sf):
    """SNK-5 and SRC-5: the dynamic product types saved and loaded."""
    path = _folder(spark, "src5")
    stores.save_product_types(SI.dynamic_types(spark, sf), path, 1.0)
    return stores.load_product_types(spark, path)


# ------------------------------------------------------------------ uploads
# The files are the pages; the manifest says what was sent: of one page in 11 another length, and further files, by page
# one in 13 that never arrived and one in 17 without bytes; one page in 19 was never announced.
@query("src3_upload_reconciliation", """WITH f AS (SELECT 'page' || page_id::VARCHAR AS filename, strlen(coalesce(html, '')) + 1 AS n, page_id FROM pages),
sent AS (SELECT filename, n + CASE WHEN page_id % 11 = 3 THEN 1 ELSE 0 END AS n FROM f WHERE page_id % 19 <> 4
         UNION ALL SELECT 'lost' || page_id::VARCHAR, n FROM f WHERE page_id % 13 = 5 UNION ALL SELECT 'blank' || page_id::VARCHAR, 0 FROM f WHERE page_id % 17 = 2)
SELECT filename, sent.n::BIGINT AS sent_length, f.n::BIGINT AS found_length,
       CASE WHEN sent.n <= 0 THEN 'empty' WHEN f.n IS NULL THEN 'missing' WHEN sent.n IS NULL THEN 'unlisted' WHEN sent.n <> f.n THEN 'changed' ELSE 'ok' END AS status
FROM sent FULL OUTER JOIN f USING (filename)""")
def src3_upload_reconciliation(spark, sf):
    """SRC-3: the pages written as files, listed (content pruned) and set against the manifest of what was sent."""
    path = _folder(spark, "src3")
    pages = SI.table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    name = F.concat(F.lit("page"), F.col("page_id").cast("string"))
    stores.write_files(pages.select(name.alias("filename"), F.col("html").alias("value")), path, "filename", "value")
    accepted, _ = stores.binary_scan(spark, path)
    found = accepted.select(F.regexp_extract("path", "filename=([^/]*)", 1).alias("filename"), "length")
    i = F.col("page_id")
    sent_length = (F.octet_length("html") + 1).cast("long")
    sent = pages.filter(i % 19 != 4).select(name.alias("filename"), (sent_length + F.when(i % 11 == 3, 1).otherwise(0)).alias("length"))
    lost = pages.filter(i % 13 == 5).select(F.concat(F.lit("lost"), i.cast("string")).alias("filename"), sent_length.alias("length"))
    blank = pages.filter(i % 17 == 2).select(F.concat(F.lit("blank"), i.cast("string")).alias("filename"), F.lit(0).cast("long").alias("length"))
    return stores.reconcile_uploads(found, sent.unionByName(lost).unionByName(blank)).select("filename", "sent_length", "found_length", "status")


# ------------------------------------------------------------------ images
# Each embedding is a picture of 32x32 pixels, 4x4 for each cell of its 8x8 grid; by vec_id mod 5 it is grey, RGB, RGBA (transparent
# where the value is a multiple of 4), RGB, or a broken file.
def _png(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    rows = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def _pictures(batches):
    import pandas as pd

    for pdf in batches:
        files = []
        for i, cells in zip(pdf["vec_id"], pdf["cells"]):
            grey = np.kron(np.array(cells, np.uint8).reshape(8, 8), np.ones((4, 4), np.uint8))
            kind = i % 5
            if kind == 4:
                files.append(b"not an image")
            elif kind == 0:
                files.append(_png(grey[:, :, None]))
            else:
                alpha = [np.where(grey % 4 == 0, 0, 255).astype(np.uint8)] if kind == 2 else []
                files.append(_png(np.stack([grey, grey, grey, *alpha], axis=2)))
        yield pd.DataFrame({"vec_id": pdf["vec_id"], "nth": pdf["nth"], "png": files})


def write_pictures(spark, sf, path):
    """A file per embedding, written by every task (bytes as they are)."""
    cells = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * x.cast("double")))).cast("int"))
    e = spread(SI.table(spark, sf, "embeddings").select("vec_id", F.monotonically_increasing_id().alias("nth"), cells.alias("cells")))
    made = e.mapInPandas(_pictures, "vec_id long, nth long, png binary")
    stores.write_files(made, path, "vec_id", "png", "nth")


def _vec_id(path):
    return F.regexp_extract(path, "vec_id=([0-9]+)", 1).cast("long").alias("vec_id")


_PICTURE_SQL = """WITH px AS (SELECT vec_id, pos // 8 AS r, pos % 8 AS c, greatest(0, least(255, floor(128 + 256 * embedding[pos + 1]::DOUBLE))) AS q FROM embeddings, range(64) t(pos)),
cell AS (SELECT vec_id, r, c, {value} AS x FROM px WHERE vec_id % 5 <> 4),
kind AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 1 WHEN 2 THEN 4 WHEN 4 THEN -1 ELSE 3 END AS n_channels FROM embeddings),
stat AS (SELECT vec_id, avg(x) AS mean, median(x) AS middle FROM cell GROUP BY vec_id),
h AS (SELECT vec_id, sum(CASE WHEN x > mean THEN (1::UBIGINT << (63 - (r * 8 + c))) ELSE 0::UBIGINT END)::UBIGINT AS ahash,
             sum(CASE WHEN x > middle THEN (1::UBIGINT << (63 - (r * 8 + c))) ELSE 0::UBIGINT END)::UBIGINT AS whash FROM cell JOIN stat USING (vec_id) GROUP BY vec_id)
"""


@query("src4_image_scan", _PICTURE_SQL.replace("{value}", "q") + """
SELECT vec_id, CASE WHEN n_channels > 0 THEN 32 ELSE -1 END AS width, CASE WHEN n_channels > 0 THEN 32 ELSE -1 END AS height, n_channels,
       CASE WHEN n_channels > 0 THEN 1024 * n_channels ELSE 0 END AS data_bytes FROM kind""")
def src4_image_scan(spark, sf):
    """SRC-4: pictures in three channel layouts and broken files through the image source."""
    path = _folder(spark, "src4")
    write_pictures(spark, sf, path)
    image = stores.image_scan(spark, path)
    return image.select(_vec_id("image.origin"), "image.width", "image.height", F.col("image.nChannels").alias("n_channels"),
                        F.octet_length("image.data").alias("data_bytes"))


@query("fpr5_fingerprint_job", _PICTURE_SQL.replace("{value}", "q") + f"""
SELECT vec_id, CASE WHEN n_channels > 0 THEN 'RGB' END AS image_mode, {HEX('ahash')} AS ahash, {HEX('whash')} AS whash, true AS sized,
       n_channels < 0 AS failed FROM kind LEFT JOIN h USING (vec_id)""")
def fpr5_fingerprint_job(spark, sf):
    """FPR-5 over SRC-4: hashes, mode, size and error of every file, alpha dropped."""
    path = _folder(spark, "fpr5")
    write_pictures(spark, sf, path)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    found = image_fingerprints(stores.image_scan(spark, path), sizes)
    return found.select(_vec_id("origin"), "image_mode", "ahash", "whash", (F.col("file_size") > 0).alias("sized"), F.col("error").isNotNull().alias("failed"))


@query("fpr6_pixel_normalise", _PICTURE_SQL.replace("{value}", "CASE WHEN vec_id % 5 = 2 AND q % 4 = 0 THEN 255 ELSE q END") + f"""
SELECT vec_id, CASE n_channels WHEN 1 THEN 'L' WHEN 3 THEN 'RGB' WHEN 4 THEN 'RGBA' END AS image_mode, {HEX('ahash')} AS ahash, {HEX('whash')} AS whash
FROM kind LEFT JOIN h USING (vec_id)""")
def fpr6_pixel_normalise(spark, sf):
    """FPR-6 over SRC-4: transparent pixels are laid over white."""
    path = _folder(spark, "fpr6")
    write_pictures(spark, sf, path)
    found = image_fingerprints(stores.image_scan(spark, path), alpha="over_white")
    return found.select(_vec_id("origin"), "image_mode", "ahash", "whash")


# ------------------------------------------------------------------ retention
@query("flt1_stored_retention", f"""WITH reg AS (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN ts::TIMESTAMP END AS created FROM events),
kept AS (SELECT * FROM reg WHERE coalesce(created >= TIMESTAMP '{SI.RETENTION_NOW}' - INTERVAL 30 DAY + INTERVAL 5 HOUR, true))
SELECT event_id, strftime(created, '%Y-%m-%d %H:%M:%S') AS created, ((SELECT count(*) FROM reg) - (SELECT count(*) FROM kept))::BIGINT AS n_removed FROM kept""")
def flt1_stored_retention(spark, sf):
    """FLT-1 on the registry kept by day: two appends, a cut-off inside a day, the unused folders deleted."""
    root = _folder(spark, "flt1")
    ev = SI.table(spark, sf, "events")
    known = {"created_at": F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")), "seq": F.col("event_id").cast("long"),
             "source_path": F.col("event_type"), "file_size": F.col("user_id").cast("long")}
    rows = ev.select("event_type", *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stores.REGISTRY.fields])
    daily.append(rows.filter("event_type = 'error'"), root)
    daily.append(rows.filter("event_type <> 'error'"), root)
    removed = daily.cleanup(spark, root, F.lit(SI.RETENTION_NOW).cast("timestamp") + F.expr("INTERVAL 5 HOURS"))
    daily.vacuum(spark, root)
    return daily.load(spark, root).select(F.col("seq").alias("event_id"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"),
                                          F.lit(removed).cast("long").alias("n_removed"))

"""SRC/SNK round trips, image fingerprints (FPR-3..6) on generated PNGs, and the
streaming jobs (DED-10 equals DED-6; JOB-2 equals JOB-1)."""

import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashsieve.functions.hashing import long_to_hex
from hashsieve.operators import dedup, jobs
from hashsieve.operators.fingerprints import simhash
from hashsieve.operators.image_hashes import image_fingerprints
from hashsieve.sources import stores
from hashsieve.streaming import ingest

from .conftest import SF001


def _document(folder):
    """The JSON document of a folder's parts, in the order of their names."""
    parts = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
    return json.loads("".join(open(os.path.join(folder, p)).read() for p in parts))


def write_png(path, arr):
    """Minimal PNG writer (8-bit grey, RGB or RGBA) using zlib only."""
    h, w = arr.shape[:2]
    c = 1 if arr.ndim == 2 else arr.shape[2]
    ctype = {1: 0, 3: 2, 4: 6}[c]
    raw = b"".join(b"\x00" + arr[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, ctype, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_registry_versions_round_trip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "registry")
    assert stores.load_registry(spark, root).count() == 0
    reg = spark.createDataFrame([("00000000000000ff", 255, 3)], "phash string, fp long, seq long")
    full = reg.select(*[F.col(c) if c in reg.columns else F.lit(None).cast(f.dataType).alias(c)
                        for c, f in ((f.name, f) for f in stores.REGISTRY.fields)])
    stores.save_registry(full, root, 1)
    stores.save_registry(full.union(full.withColumn("seq", F.lit(4).cast("long"))), root, 2)
    assert stores.versions(spark, root) == [1, 2]
    assert stores.load_registry(spark, root).count() == 2 and stores.load_registry(spark, root, 1).count() == 1
    out = os.path.join(tmp_dir, "export")
    stores.export_registry_map(stores.load_registry(spark, root, 1), out)
    doc = _document(out)
    assert list(doc["hashes"]) == ["00000000000000ff"]


def test_registry_json_import(spark, tmp_dir):
    p = os.path.join(tmp_dir, "db.json")
    with open(p, "w") as f:
        json.dump({"hashes": {"00000000000000ff": {"phash": "00000000000000ff", "image_size": [4, 3], "image_mode": "RGB",
                                                   "file_size": 10, "created_at": "2024-01-01T00:00:00", "source_path": "a.png"},
                              "zz": {"image_size": [1, 1], "created_at": "not a time"}},
                   "created_at": "2024-01-01T00:00:00", "version": "1.0"}, f, indent=2)
    rows = {r.seq: r for r in stores.import_registry_json(spark, p).collect()}
    assert rows[0].fp == 255 and rows[0].width == 4 and rows[0].created_at is not None
    assert rows[1].fp is None and rows[1].created_at is None


def test_binary_scan_and_product_types(spark, tmp_dir):
    d = os.path.join(tmp_dir, "up")
    os.makedirs(d)
    for name, data in (("a.psd", b"xx"), ("b.psd", b""), ("c.txt", b"x")):
        open(os.path.join(d, name), "wb").write(data)
    ok, bad = stores.binary_scan(spark, d, allowed=["psd"])
    assert [r.filename for r in ok.collect()] == ["a.psd"]
    # Spark's file sources skip zero-byte files, so b.psd is known from a manifest only
    assert {r.filename: r.reject_reason for r in bad.collect()} == {"c.txt": "extension"}
    listed = spark.createDataFrame([(os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for n in os.listdir(d)], "path string, length long")
    ok, bad = stores.binary_scan(spark, d, allowed=["psd"], manifest=listed)
    assert [r.filename for r in ok.collect()] == ["a.psd"]
    assert {r.filename: r.reject_reason for r in bad.collect()} == {"c.txt": "extension", "b.psd": "empty"}
    p = os.path.join(tmp_dir, "types")
    assert stores.load_product_types(spark, p).count() == 0
    stores.save_product_types(spark.createDataFrame([(0, "posters"), (1, "mugs")], "position int, product_type string"), p, 1.0)
    assert [r.product_type for r in stores.load_product_types(spark, p).orderBy("position").collect()] == ["posters", "mugs"]


def test_catalogue_append_partitions(spark, tmp_dir):
    root = os.path.join(tmp_dir, "cat")
    assert stores.catalogue_read(spark, root).count() == 0
    docs = spark.createDataFrame([("1", "a", "u", "f.jpeg"), ("2", "b", "u", "g.jpeg")],
                                 "document_id string, product_type string, image_url string, filename string")
    stores.catalogue_append(docs.withColumn("uploaded_at", F.current_timestamp()), root)
    assert {"product_type=a", "product_type=b"} <= set(os.listdir(os.path.join(root, "step=1")))
    assert stores.catalogue_read(spark, root).filter("product_type = 'b'").count() == 1


def test_image_fingerprints(spark, tmp_dir):
    d = os.path.join(tmp_dir, "img")
    os.makedirs(d)
    rng = np.random.default_rng(0)
    base = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    rgb = np.stack([base, base[::-1], base.T], axis=2)
    write_png(os.path.join(d, "a.png"), rgb)
    noisy = np.clip(rgb.astype(int) + rng.integers(-3, 4, rgb.shape), 0, 255)
    write_png(os.path.join(d, "b.png"), noisy)
    alpha = np.concatenate([rgb, np.full((64, 64, 1), 255)], axis=2)
    write_png(os.path.join(d, "c.png"), alpha)
    write_png(os.path.join(d, "g.png"), base)
    open(os.path.join(d, "bad.png"), "wb").write(b"not an image")
    imgs = stores.image_scan(spark, d)
    sizes = spark.read.format("binaryFile").load(d).select("path", "length")
    out = {os.path.basename(r.origin): r for r in image_fingerprints(imgs, sizes).collect()}
    assert out["bad.png"].error is not None
    a, b, c = out["a.png"], out["b.png"], out["c.png"]
    assert (a.width, a.height, a.image_mode) == (64, 64, "RGB") and a.file_size > 0
    assert a.phash == c.phash and a.ahash == c.ahash  # opaque alpha changes nothing
    dist = bin(int(a.phash, 16) ^ int(b.phash, 16)).count("1")
    assert dist <= 5  # light noise keeps the perceptual hash close
    assert out["g.png"].image_mode == "RGB" and len(out["g.png"].whash) == 16
    assert long_to_hex  # fp column is the signed form of phash
    assert format(a.fp & (2**64 - 1), "016x") == a.phash


def test_alpha_is_dropped_or_composited(spark, tmp_dir):
    """The fingerprint job drops alpha; the converter's form lays the image over white."""
    d = os.path.join(tmp_dir, "alpha")
    os.makedirs(d)
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (64, 64, 3)).astype(np.uint8)
    alpha = np.repeat(np.linspace(0, 255, 64).astype(np.uint8)[None, :, None], 64, axis=0)
    write_png(os.path.join(d, "opaque.png"), rgb)
    write_png(os.path.join(d, "faded.png"), np.concatenate([rgb, alpha], axis=2))
    over = np.round(rgb * (alpha / 255.0) + 255.0 * (1 - alpha / 255.0)).astype(np.uint8)
    write_png(os.path.join(d, "white.png"), over)
    dropped = {os.path.basename(r.origin): r for r in image_fingerprints(stores.image_scan(spark, d)).collect()}
    assert {r.image_mode for r in dropped.values()} == {"RGB"}
    assert [getattr(dropped["faded.png"], h) for h in ("phash", "ahash", "dhash", "whash")] == \
        [getattr(dropped["opaque.png"], h) for h in ("phash", "ahash", "dhash", "whash")]
    laid = {os.path.basename(r.origin): r for r in image_fingerprints(stores.image_scan(spark, d), alpha="over_white").collect()}
    assert laid["faded.png"].image_mode == "RGBA" and laid["faded.png"].ahash == laid["white.png"].ahash != laid["opaque.png"].ahash


def test_images_to_registry_to_json_and_back(spark, tmp_dir):
    """Images -> fingerprints -> first-seen dedup -> registry with its header -> JSON -> registry, without loss."""
    d, root, out = (os.path.join(tmp_dir, n) for n in ("imgs", "registry", "json"))
    os.makedirs(d)
    rng = np.random.default_rng(9)
    for k in range(4):
        write_png(os.path.join(d, f"i{k}.png"), np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8))
    write_png(os.path.join(d, "i4.png"), np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8))).astype(np.uint8))
    with open(os.path.join(d, "i0.png"), "rb") as f, open(os.path.join(d, "z_copy.png"), "wb") as g:
        g.write(f.read())
    sizes = spark.read.format("binaryFile").load(d).select("path", "length")
    seq = F.when(F.col("origin").contains("copy"), 9).otherwise(F.regexp_extract("origin", r"i(\d)\.png$", 1).cast("int"))
    rows = stores.registry_rows(image_fingerprints(stores.image_scan(spark, d), sizes), "2024-01-02 03:04:05", seq)
    found = dedup.greedy_dedup(rows)
    assert {r.seq: r.action for r in found.collect()}[9] == "skip_duplicate"
    kept = rows.join(found.filter("action = 'store_unique'").select("seq"), "seq", "left_semi")
    meta = {"created_at": "2024-01-01T00:00:00", "last_updated": "2024-01-02T03:04:05", "version": "1.0",
            "stats": {"total_processed": 6, "duplicates_found": 1, "unique_images": 5}}
    stores.save_registry(kept, root, 1, meta)
    assert stores.load_registry_meta(spark, root) == meta
    saved = stores.load_registry(spark, root)
    assert saved.count() == 5
    stores.export_registry_map(saved, out, stores.load_registry_meta(spark, root))
    back = stores.import_registry_json(spark, out)
    assert stores.import_registry_meta(spark, out) == meta
    columns = [c for c in saved.columns if c != "seq"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, saved.select(columns).collect()))
    order = [r.phash for r in saved.orderBy("seq").collect()]
    assert [r.phash for r in back.orderBy("seq").collect()] == order


def test_unreadable_hash_survives_export(spark, tmp_dir):
    p, out = os.path.join(tmp_dir, "db.json"), os.path.join(tmp_dir, "out")
    with open(p, "w") as f:
        json.dump({"hashes": {"zz": {"phash": "zz", "file_size": 1}, "00000000000000ff": {"phash": "00000000000000ff"}}}, f)
    stores.export_registry_map(stores.import_registry_json(spark, p), out)
    assert set(_document(out)["hashes"]) == {"zz", "00000000000000ff"}
    assert stores.import_registry_json(spark, out).count() == 2
    stores.export_registry_map(stores.import_registry_json(spark, p).limit(0), os.path.join(tmp_dir, "none"))
    assert _document(os.path.join(tmp_dir, "none")) == {"hashes": {}}


def test_absent_version_is_an_error(spark, tmp_dir):
    root = os.path.join(tmp_dir, "r")
    assert stores.load_registry(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        stores.load_registry(spark, root, 3)


def test_streaming_ingest_equals_batch(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    fps = simhash(docs).select(F.col("doc_id").alias("seq"), "fp")
    src = os.path.join(tmp_dir, "in")
    bounds = [0, 50, 120, 200, 10**9]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        fps.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    stream = (spark.readStream.schema("seq long, fp long").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    reg_root, res_root = os.path.join(tmp_dir, "reg"), os.path.join(tmp_dir, "res")
    q = ingest.start_ingest(stream, reg_root, res_root, os.path.join(tmp_dir, "ck"))
    q.awaitTermination(600)
    got = {r.seq: r.action for r in spark.read.parquet(res_root).collect()}
    want = {r.seq: r.action for r in dedup.greedy_dedup(fps).collect()}
    assert got == want
    # replaying a committed batch changes nothing
    handler = ingest.make_batch_handler(reg_root, res_root)
    before = stores.versions(spark, reg_root)
    handler(spark.read.parquet(os.path.join(src, "part0")), 0)
    assert stores.versions(spark, reg_root) == before
    # a batch writes its own uniques only; merging the versions changes nothing
    uniques = {s for s, a in want.items() if a == "store_unique"}
    assert [r.seq for r in ingest.ingested(spark, reg_root).orderBy("seq").collect()] == sorted(uniques)
    # a batch that was not committed gives the same when it is run again
    first = fps.filter("seq < 50")
    for _ in range(2):
        handler = ingest.make_batch_handler(os.path.join(tmp_dir, "reg_again"), os.path.join(tmp_dir, "res_again"))
        handler(first, 0)
        seen = {r.seq: r.action for r in spark.read.parquet(os.path.join(tmp_dir, "res_again")).collect()}
        assert seen == {s: a for s, a in want.items() if s < 50}
        for name in os.listdir(os.path.join(tmp_dir, "reg_again")):
            mark = os.path.join(tmp_dir, "reg_again", name, "_SUCCESS")
            if os.path.exists(mark):
                os.remove(mark)  # as if the commit had not happened


def test_job_state_stream_equals_batch(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF001}/events.parquet").select(
        F.col("user_id").alias("job_id"), "ts", "event_id", F.col("event_type").alias("status"), F.col("value").alias("progress"))
    src = os.path.join(tmp_dir, "ev")
    ev.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ingest.job_state_stream(stream, seq=["ts", "event_id"]).writeStream.outputMode("update")
         .format("memory").queryName("job_state_test").trigger(availableNow=True)
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start())
    q.awaitTermination(600)
    live = spark.sql("SELECT * FROM job_state_test")
    from pyspark.sql import Window
    last = live.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("n_updates")))).filter("_r = 1")
    got = {(r.job_id, r.status, r.progress, r.n_updates) for r in last.collect()}
    want = {(r.job_id, r.status, r.progress, r.n_updates) for r in jobs.fold_state(ev, seq=["ts", "event_id"]).collect()}
    assert got == want


def test_grid_equals_image(spark, tmp_dir):
    from hashsieve.operators.image_hashes import grid_fingerprints
    rng = np.random.default_rng(5)
    cells = rng.integers(0, 256, (8, 8)).astype(np.uint8)
    d = os.path.join(tmp_dir, "grid")
    os.makedirs(d)
    write_png(os.path.join(d, "g.png"), cells)
    img = image_fingerprints(stores.image_scan(spark, d)).collect()[0]
    grid = spark.createDataFrame([(1, [float(v) for v in cells.ravel()]), (2, [1.0, 2.0])], "k long, cells array<double>")
    out = {r.k: r for r in grid_fingerprints(grid, "k", "cells", 8).collect()}
    assert (out[1].phash, out[1].ahash, out[1].dhash, out[1].whash) == (img.phash, img.ahash, img.dhash, img.whash)
    assert out[2].error is not None


def test_catalogue_tombstones_and_routing(spark, tmp_dir):
    root = os.path.join(tmp_dir, "cat2")
    docs = spark.createDataFrame([("1", "a", "u", "f.jpeg"), ("2", "b", "u", "g.jpeg"), ("3", "b", "u", "h.jpeg")],
                                 "document_id string, product_type string, image_url string, filename string")
    stores.catalogue_append(docs.withColumn("uploaded_at", F.current_timestamp()), root)
    rep = stores.catalogue_delete(spark, root, spark.createDataFrame([("2",), ("9",)], "document_id string"))
    assert {r.document_id: r.outcome for r in rep.collect()} == {"2": "deleted", "9": "not_found"}
    assert sorted(r.document_id for r in stores.catalogue_read(spark, root).collect()) == ["1", "3"]
    again = stores.catalogue_delete(spark, root, spark.createDataFrame([("2",)], "document_id string"))
    assert again.collect()[0].outcome == "not_found"
    # an id that comes back after its deletion is there again, and a replayed append adds nothing
    back = docs.filter("document_id = '2'").withColumn("uploaded_at", F.current_timestamp())
    step = stores.catalogue_append(back, root)
    assert stores.catalogue_append(back, root, step) == step
    assert sorted(r.document_id for r in stores.catalogue_read(spark, root).collect()) == ["1", "2", "3"]
    stores.catalogue_delete(spark, root, spark.createDataFrame([("2",)], "document_id string"))
    assert sorted(r.document_id for r in stores.catalogue_read(spark, root).collect()) == ["1", "3"]
    res = dedup.greedy_dedup(spark.createDataFrame([(1, 0), (2, 1), (3, None)], "seq long, fp long"))
    out = os.path.join(tmp_dir, "routed")
    stores.write_routed(dedup.route(res), out)
    assert {"route=unique_stored", "route=duplicate_skipped", "route=error"} <= set(os.listdir(out))


def test_registry_cleanup(spark, tmp_dir):
    import datetime as dt
    root = os.path.join(tmp_dir, "reg2")
    rows = spark.createDataFrame([(1, 10, dt.datetime(2024, 1, 1)), (2, 20, dt.datetime(2024, 3, 1)), (3, 30, None)],
                                 "seq long, fp long, created_at timestamp")
    full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
                         for f in stores.REGISTRY.fields])
    stores.save_registry(full, root, 1)
    assert stores.size_mb(spark, root) > 0
    assert stores.cleanup_registry(spark, root, "2024-03-15 00:00:00", 30) == 1
    assert stores.versions(spark, root) == [1, 2]
    assert sorted(r.seq for r in stores.load_registry(spark, root).collect()) == [2, 3]
    assert stores.cleanup_registry(spark, root, "2024-03-15 00:00:00", 30) == 0 and stores.versions(spark, root) == [1, 2]


def test_a_batch_reads_the_parts_its_keys_fall_in(spark, tmp_dir):
    import random
    rnd = random.Random(4)
    reads = {}
    for size in (300, 3000):
        root = os.path.join(tmp_dir, f"reg{size}")
        rows = [(i, rnd.getrandbits(64) - 2**63) for i in range(size)]
        ingest.commit(spark.createDataFrame(rows, "seq long, fp long"), root, 1)
        batch = spark.createDataFrame([(rows[7][1] ^ 5,), (rows[9][1],), (0x0123456789ABCDEF,)], "fp long")
        near = {r.fp for r in ingest.registered_near(batch, root, 1).collect()}
        assert near == {rows[7][1] ^ 5, rows[9][1]}
        keys = {(r.tbl, r.tkey) for r in ingest.KeyScheme(5).tables(batch).collect()}
        hit = [r.part for r in ingest.KeyScheme(5).tables(batch).select(ingest.part_of().alias("part")).distinct().collect()]
        assert len(hit) <= len(keys) == 18
        read = ingest.keyed_registry(spark, root, 1).filter(F.col("part").isin(hit))
        plan = read._jdf.queryExecution().toString()
        assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
        files = {f.split("part=")[1].split("/")[0] for f in read.inputFiles()}
        reads[size] = len({f for f in files if int(f) in hit}) / ingest.PARTS
    assert max(reads.values()) <= 18 / ingest.PARTS


def test_registry_levels_and_gaps(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(ingest, "MERGE", 2)
    root, far = os.path.join(tmp_dir, "levels"), [(k * 0x0F0F0F0F0F0F0F) ^ (k << 40) for k in range(9)]
    opened = []
    for v in range(1, 9):
        ingest.commit(spark.createDataFrame([(v, far[v])], "seq long, fp long"), root, v)
        assert sorted(r.seq for r in ingest.ingested(spark, root).collect()) == list(range(1, v + 1))
        opened.append(len(ingest.segments(spark, root, v)))
    assert opened == [bin(v).count("1") for v in range(1, 9)]  # levels of 1, 2, 4 and 8 versions
    assert sorted(r.seq for r in ingest.ingested(spark, root, 5).collect()) == [1, 2, 3, 4, 5]  # an earlier state is still there
    for level in (1, 2, 3):  # merged segments are a short cut: without them the versions are read
        mark = os.path.join(root, ingest.MERGED_DIR, f"level={level}", "version=00000008", "_SUCCESS")
        if os.path.exists(mark):
            os.remove(mark)
    assert sorted(r.seq for r in ingest.ingested(spark, root, 8).collect()) == list(range(1, 9))
    os.remove(os.path.join(root, "version=00000007", "_SUCCESS"))
    with pytest.raises(FileNotFoundError):
        ingest.ingested(spark, root, 8)


def test_concurrent_catalogue_steps_and_compaction(spark, tmp_dir):
    root = os.path.join(tmp_dir, "cat3")
    doc = lambda i: spark.createDataFrame([(i, "a", "u", "f.jpeg")], "document_id string, product_type string, image_url string, filename string").withColumn("uploaded_at", F.current_timestamp())
    ids = lambda: sorted(r.document_id for r in stores.catalogue_read(spark, root).collect())
    first, second = stores.claim_step(spark, root), stores.claim_step(spark, root)  # two writers that both look before either writes
    assert second == first + 1
    stores.catalogue_append(doc("d2"), root, second)
    stores.catalogue_append(doc("d1"), root, first)
    assert ids() == ["d1", "d2"]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(4) as pool:
        steps = list(pool.map(lambda k: stores.catalogue_append(doc(f"t{k}"), root), range(4)))
    assert len(set(steps)) == 4 and ids() == ["d1", "d2", "t0", "t1", "t2", "t3"]
    slow = stores.claim_step(spark, root)  # a writer that has not finished
    stores.catalogue_delete(spark, root, spark.createDataFrame([("d1",), ("t3",)], "document_id string"))
    half = os.path.join(root, f"step={slow}")
    doc("half").drop("product_type").write.parquet(os.path.join(half, "product_type=a"))
    assert ids() == ["d2", "t0", "t1", "t2"]  # the half-written step is not read
    assert stores.catalogue_compact(spark, root) == slow - 1 and ids() == ["d2", "t0", "t1", "t2"]
    stores.catalogue_append(doc("slow"), root, slow)
    assert ids() == ["d2", "slow", "t0", "t1", "t2"]
    assert stores.catalogue_compact(spark, root) == slow + 1 == stores.catalogue_compact(spark, root)
    assert ids() == ["d2", "slow", "t0", "t1", "t2"]
    # reading opens the merged part only, which holds the live documents and nothing else
    assert all("/_live/" in f for f in stores.catalogue_read(spark, root).inputFiles())
    stores.catalogue_append(doc("d1"), root)
    stores.catalogue_delete(spark, root, spark.createDataFrame([("d2",)], "document_id string"))
    assert ids() == ["d1", "slow", "t0", "t1", "t2"]


def test_large_document_is_cut_into_entries_by_ranges(spark, tmp_dir):
    """One file in many byte ranges gives what a JSON parser reads: quotes, braces, escapes, nested objects, a header before and after."""
    nasty = ['plain', 'quote " in', 'brace } { in', 'end\\', 'esc \\" }', '\u00e9}\u65e5"', '}', '{"hash', ', "x": {', '"', '']
    hashes = {}
    for i in range(400):
        key = f"{i * 7919:016x}" if i % 9 else f'k{i}"}}{{'
        hashes[key] = {"phash": f"{i:016x}", "image_size": [i, i + 1], "image_mode": nasty[i % len(nasty)], "source_path": nasty[(i * 5) % len(nasty)] * (i % 4),
                       "file_size": i, "created_at": "2024-01-01T00:00:00"}
        if i % 6 == 0:
            hashes[key]["extra"] = {"deep": {"er": "}"}, "list": [{}, {"a": 1}]}
    document = {"created_at": "2024-01-01T00:00:00", "stats": {"total_processed": 3, "duplicates_found": 1, "unique_images": 2},
                "hashes": hashes, "other": {"not": {"phash": "an entry"}}, "version": 'v"}1', "last_updated": "x"}
    want = [(v["phash"], v["image_size"][0], v["image_mode"], v["source_path"], v["file_size"]) for v in hashes.values()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for indent in (None, 2):
        p = os.path.join(tmp_dir, f"doc{indent}.json")
        with open(p, "w") as f:
            json.dump(document, f, indent=indent, ensure_ascii=bool(indent))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
        try:
            assert spark.read.option("lineSep", "}").text(p).rdd.getNumPartitions() > 20
            got = [(r.phash, r.width, r.image_mode, r.source_path, r.file_size) for r in stores.import_registry_json(spark, p).orderBy("seq").collect()]
            meta = stores.import_registry_meta(spark, p)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == want
        assert meta == {k: document[k] for k in ("created_at", "last_updated", "version", "stats")}


def test_registry_map_in_many_parts(spark, tmp_dir):
    rows = spark.range(500).selectExpr("hex(id) phash", "cast(null as string) ahash", "cast(null as string) dhash", "cast(null as string) whash", "id fp", "1 width",
                                       "2 height", "'a\"}' image_mode", "id file_size", "timestamp'2024-01-01' created_at", "'p' source_path", "id seq")
    out = os.path.join(tmp_dir, "parts")
    stores.export_registry_map(rows, out, {"version": "2"}, files=7)
    assert len([f for f in os.listdir(out) if f.startswith("part-")]) == 7
    assert list(_document(out)["hashes"]) == [f"{i:X}" for i in range(500)] and _document(out)["version"] == "2"
    back = stores.import_registry_json(spark, out).orderBy("seq").collect()
    assert [(r.seq, r.file_size) for r in back] == [(i, i) for i in range(500)]
    assert stores.import_registry_meta(spark, out)["version"] == "2"


def test_every_outcome_of_the_reconciliation_occurs(spark):
    from hashsieve import plans
    found = plans.queries()["src3_upload_reconciliation"](spark, "/root/testdata/sf0.01").groupBy("status").count().collect()
    assert {r.status for r in found} == {"ok", "changed", "missing", "empty", "unlisted"}


def test_files_share_folders(spark, tmp_dir):
    """A file per name, not a folder per name; rows of one name lie in one file in their order, an empty content is its newline."""
    rows = [(f"f{k}", bytes([k, 0, 255]) * k) for k in range(1, 80)] + [("twice", b"one"), ("twice", b"two"), (None, b"x"), ("none", None)]
    path = os.path.join(tmp_dir, "files")
    assert stores.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(5).orderBy("content"), path, "name", "content") == 82
    found = {r.filename.removeprefix("name="): r for r in stores.binary_scan(spark, path)[0].collect()}
    want = {n: c + b"\n" for n, c in rows[:79]} | {"twice": b"one\ntwo\n", stores.NO_NAME: b"x\n", "none": b"\n"}
    assert {n: bytes(r.content) for n, r in found.items()} == want
    assert len({os.path.dirname(r.path) for r in found.values()}) <= 8  # the session's shuffle partitions
    empty = os.path.join(tmp_dir, "empty")
    assert stores.write_files(spark.createDataFrame([], "name string, content binary"), empty, "name", "content") == 0
    assert stores.image_scan(spark, empty).count() == 0


def test_pictures_share_folders(spark, tmp_dir):
    from hashsieve.plans import store_queries
    grid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * F.col("id")) % 64 / 256).cast("float"))
    spark.range(60).select(F.col("id").alias("vec_id"), grid.alias("embedding")).write.parquet(f"{tmp_dir}/embeddings.parquet")
    path = os.path.join(tmp_dir, "pictures")
    store_queries.write_pictures(spark, tmp_dir, path)
    seen = stores.image_scan(spark, path).select("image.origin", "image.width").collect()
    assert len(seen) == 60 and sum(r.width == 32 for r in seen) == 48
    assert len({os.path.dirname(r.origin) for r in seen}) <= 8

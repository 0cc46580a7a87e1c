"""FLT, SET, JOI, AGG-5..8, TOP-1, WIN, JOB golden rows."""

import datetime as dt

from pyspark.sql import functions as F

from hashsieve.operators import batches, catalog, jobs, product_types, validation


def test_retention_keeps_missing_and_boundary(spark):
    df = spark.createDataFrame([(1, "2024-01-01T00:00:00"), (2, "2023-12-31T23:59:59"), (3, None), (4, "garbage")],
                               "id int, created_at string")
    kept = {r.id for r in validation.retention(df, "created_at", "2024-01-31 00:00:00", 30).collect()}
    assert kept == {1, 3, 4}


def test_fill_defaults_keeps_case(spark):
    df = spark.createDataFrame([(None, None, None), ("  ", 90, " "), ("Metal_Cards", 10, "webp")],
                               "product_type string, quality int, format string")
    rows = validation.fill_defaults(df).collect()
    assert [(r.product_type, r.quality, r.format) for r in rows] == [("metal_cards", 75, "jpeg"), ("metal_cards", 90, "jpeg"),
                                                                    ("Metal_Cards", 10, "webp")]
    assert rows[0].fallbacks == ["product_type", "quality", "format"] and rows[2].fallbacks == []
    types = product_types.base_types(spark)
    known, unknown = product_types.type_membership(validation.fill_defaults(df), types)
    assert [r.product_type for r in unknown.collect()] == ["Metal_Cards"]


def test_blank_means_any_white_space(spark):
    df = spark.createDataFrame([("\t", None, "\n"), (" \u00a0", 1, "webp")], "product_type string, quality int, format string")
    rows = validation.fill_defaults(df).collect()
    assert [(r.product_type, r.format) for r in rows] == [("metal_cards", "jpeg"), ("metal_cards", "webp")]
    req = spark.createDataFrame([(1, "\tPosters\n", "\t"), (2, "\n", None)], "position int, name string, description string")
    added = {r.position: r for r in product_types.add_types(product_types.base_types(spark), req).collect()}
    assert added[1].description == "Custom posters" and added[2].outcome == "missing_name"


def test_every_outcome_occurs(spark):
    """A green row says something only if each outcome of its operator is in it."""
    from hashsieve import plans
    from .conftest import SF01
    qs = plans.queries()
    admission = qs["flt2_batch_admission"](spark, SF01).collect()
    starts = ("No files", "One or more files", "Only PSD", "File '", "Total batch", "Quality must", "Invalid product")
    assert all(any((r.message or "").startswith(s) for r in admission) for s in starts) and any(r.accepted for r in admission)
    assert {r.reject_reason for r in qs["flt7_asset_quarantine"](spark, SF01).select("reject_reason").distinct().collect()} == {
        None, "missing", "empty", "zero_dimensions"}
    filters = {r["filter"]: r["count"] for r in qs["flt5_jobs_filter"](spark, SF01).groupBy("filter").count().collect()}
    assert set(filters) == {"click, single", "batch", "view", "view, batch"} and filters["view, batch"] < filters["view"]
    assert {r.action for r in qs["ded5_check_against_registry"](spark, SF01).select("action").distinct().collect()} == {
        "store_with_error", "skip_duplicate", "store_unique"}
    assert {r.route for r in qs["ded8_route_outcomes"](spark, SF01).select("route").distinct().collect()} == {
        "unique_stored", "duplicate_skipped", "error"}
    assert qs["agg1_batch_summary"](spark, SF01).first().errors > 0


def test_long_names_stay_whole(spark):
    from hashsieve.functions.strings import display_name
    name = "a" * 2_000_000
    got = spark.createDataFrame([(name,)], "n string").select(display_name("n")).first()[0]
    assert got == "A" + "a" * 1_999_999


def test_rounding_golden(spark):
    """Worked by hand: half-even on the scaled double; 0.015 is where Python's round differs (0.01)."""
    from hashsieve.functions.numeric import py_round
    cases = [(0.125, 0.12), (0.375, 0.38), (2.5, 2.5), (-0.125, -0.12), (1.005, 1.0), (0.015, 0.02), (87.654321, 87.65)]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "x double").select(py_round("x", 2)).collect()
    assert [r[0] for r in rows] == [b for _, b in cases]


def test_batch_admission_priority(spark):
    files = spark.createDataFrame([(1, 0, "big.psd", 10_000), (1, 1, "notes.txt", 10), (2, 0, "a.psd", 10), (2, 1, "b.psd", 20),
                                   *[(3, i, f"p{i}.psd", 900) for i in range(6)], (4, 0, "a.psd", 10), (5, 0, "a.psd", 10)],
                                  "batch_id long, position int, filename string, size long")
    req = spark.createDataFrame([(1, "metal_cards", 75, "jpeg"), (2, "metal_cards", 75, "jpeg"), (3, "metal_cards", 75, "jpeg"),
                                 (4, "metal_cards", 0, "jpeg"), (5, "Metal_Cards", 75, "jpeg"), (6, "metal_cards", 75, "jpeg")],
                                "batch_id long, product_type string, quality int, format string")
    out = {r.batch_id: r for r in validation.batch_admission(files, req, product_types.base_types(spark), max_bytes=1000).collect()}
    assert out[1].status == 400 and "notes.txt" in out[1].message  # extension error outranks the size error of file 0
    assert out[2].accepted and out[2].total_size == 30
    assert out[3].status == 413 and out[3].message.startswith("Total batch size too large: 5.3 KB. Maximum allowed: 4.9 KB")
    assert out[4].message == "Quality must be between 1 and 100"
    assert out[5].message.startswith("Invalid product type 'Metal_Cards'. Allowed types: metal_cards, nfc_cards, standees")
    assert out[6].status == 400 and out[6].n_files == 0


def test_product_type_sets(spark):
    dyn = spark.createDataFrame([(0, "stickers")], "position int, product_type string")
    types = product_types.all_types(spark, dyn)
    listing = {r.product_type: r for r in product_types.folder_listing(types).collect()}
    assert listing["nfc_cards"].name == "Nfc Cards" and not listing["nfc_cards"].can_delete and listing["stickers"].can_delete
    c = product_types.type_counts(types).collect()[0]
    assert (c.total, c.base_count, c.dynamic_count) == (4, 3, 1)
    req = spark.createDataFrame([(1, "Posters", None), (2, "  posters ", "x"), (3, "!!", None), (4, "", None), (5, "Stickers", None),
                                 (6, "Wall Art", "Big prints")], "position int, name string, description string")
    added = {r.position: r for r in product_types.add_types(types, req).collect()}
    assert [added[i].outcome for i in range(1, 7)] == ["created", "exists", "invalid_name", "missing_name", "exists", "created"]
    assert added[1].description == "Custom posters" and added[6].description == "Big prints"
    after = product_types.types_after_add(types, product_types.add_types(types, req))
    assert [r.product_type for r in after.orderBy("position").collect()][-2:] == ["posters", "wall_art"]
    rem = spark.createDataFrame([(1, "standees"), (2, "stickers"), (3, "stickers"), (4, "ghost")], "position int, product_type string")
    st = {r.position: r.status for r in product_types.remove_types(types, rem).collect()}
    assert st == {1: 400, 2: 200, 3: 404, 4: 404}
    left = {r.product_type for r in product_types.types_after_remove(types, product_types.remove_types(types, rem)).collect()}
    assert left == {"metal_cards", "nfc_cards", "standees"}


def test_catalogue_filter_top_and_delete(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"d{i}", "a" if i % 2 else "b", f"u{i}", f"f{i}.jpeg", t0 + dt.timedelta(hours=i % 5)) for i in range(20)]
    cat = spark.createDataFrame(rows, "document_id string, product_type string, image_url string, filename string, uploaded_at timestamp")
    assert catalog.filter_type(cat, " ").count() == 20 and catalog.filter_type(cat, "a").count() == 10
    top = [r.document_id for r in catalog.newest(cat, "a", 3).collect()]
    assert top == ["d19", "d9", "d13"]  # hour 4 first, ties by id
    counts = catalog.listing_counts(cat, None).collect()[0]
    assert (counts["count"], counts["filter"]) == (20, "all")
    assert [tuple(r) for r in catalog.listing_counts_by(cat, [None, "a"]).collect()] == [(20, "all"), (10, "a")]
    remaining, report = catalog.delete_documents(cat, spark.createDataFrame([("d1",), ("zz",)], "document_id string"))
    assert remaining.count() == 19
    assert {r.document_id: r.outcome for r in report.collect()} == {"d1": "deleted", "zz": "not_found"}


def test_batch_report_and_progress(spark):
    res = spark.createDataFrame([(1, 0, True, 200, 25), (1, 1, True, 100, 150), (1, 2, False, 50, None), (2, 0, True, 10, 5)],
                                "batch_id long, position int, success boolean, original_size long, converted_size long")
    rep = {r.batch_id: r for r in batches.batch_report(res).collect()}
    b1 = rep[1]
    assert b1.status == "partially_completed" and (b1.completed_files, b1.failed_files) == (2, 1)
    assert b1.total_original_size == 350 and b1.total_optimized_size == 175
    assert b1.average_compression_ratio == (87.5 - 50.0) / 2 and abs(b1.success_rate - 66.666667) < 1e-6
    assert b1.message == "Batch processing completed: 2/3 files successful (66.7%)" and rep[2].status == "completed"
    tally = {r.batch_id: (r.successful, r.total) for r in batches.conversion_tally(res).collect()}
    assert tally == {1: (2, 3), 2: (1, 1)}
    four = spark.createDataFrame([(9, i) for i in range(4)], "batch_id long, position int")
    p = {r.position: r for r in batches.batch_progress(four).collect()}
    assert (p[1].progress_before, p[1].progress_after) == (25.0, 50.0)


def test_eta(spark):
    t0 = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t0, 1), (1, t0 + dt.timedelta(seconds=10), 1), (1, t0 + dt.timedelta(seconds=30), 5)],
                               "k long, ts timestamp, inc int")
    rows = batches.eta(ev, "k", "ts", ["ts"], increment="inc", total=None).orderBy("ts").collect()
    assert [r.current for r in rows] == [1, 2, 3] and rows[-1].is_complete
    assert rows[1].percentage == 66.67 and rows[1].elapsed_seconds == 10.0 and rows[1].remaining_seconds == 5.0
    assert rows[0].remaining_seconds == 0.0


def test_job_state_fold(spark):
    t0 = dt.datetime(2024, 1, 1)
    upd = spark.createDataFrame([("j1", t0, "processing", 0.0, None, None), ("j1", t0 + dt.timedelta(seconds=1), None, 30.0, None, None),
                                 ("j1", t0 + dt.timedelta(seconds=2), "failed", 0.0, "boom", None),
                                 ("j2", t0, "processing", 10.0, None, True)],
                                "job_id string, ts timestamp, status string, progress double, error string, is_batch boolean")
    st = {r.job_id: r for r in jobs.fold_state(upd).collect()}
    assert (st["j1"].status, st["j1"].progress, st["j1"].error, st["j1"].is_batch) == ("failed", 0.0, "boom", False)
    assert st["j2"].is_batch and st["j1"].n_updates == 3
    assert [r.job_id for r in jobs.filter_jobs(jobs.fold_state(upd), "", True).collect()] == ["j2"]
    assert jobs.lookup_job(jobs.fold_state(upd), "nope").count() == 0

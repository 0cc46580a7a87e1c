"""Registered table-job queries (STR, MTH, FLT, JOI, SET, AGG-5..8, TOP, WIN, JOB)
and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..functions.numeric import py_round_sql
from ..operators import batches, catalog, jobs, product_types, validation
from . import standins as SI
from .registry import query

NORM = SI.normalize_sql
STEM_RE = r"^(.*[^/.][^/]*?)(\.[^./]*)$"


def human_size_sql(v: str) -> str:
    parts = ["CASE", f"WHEN ({v}) = 0 THEN '0 B'"]
    units = S.SIZE_UNITS
    for i, u in enumerate(units[:-1]):
        parts.append(f"WHEN ({v}) < {float(1024 ** (i + 1))!r} THEN printf('%.1f {u}', ({v})::DOUBLE / {float(1024 ** i)!r})")
    parts.append(f"ELSE printf('%.1f {units[-1]}', ({v})::DOUBLE / {float(1024 ** (len(units) - 1))!r}) END")
    return " ".join(parts)


def display_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(replace({x}, '_', ' '), '[A-Za-z]+|[^A-Za-z]+'), "
            f"lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z]') THEN upper(p[1]) || lower(p[2:]) ELSE p END), '')")


def stem_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{STEM_RE}') THEN regexp_extract({x}, '{STEM_RE}', 1) ELSE {x} END"


def path_stem_sql(x: str) -> str:
    b = f"regexp_extract({x}, '[^/]*$', 0)"
    return f"CASE WHEN regexp_matches({b}, '^.+\\.[^.]+$') THEN regexp_extract({b}, '^(.+)\\.[^.]+$', 1) ELSE {b} END"


def sanitize_sql(x: str) -> str:
    s = rf"""regexp_replace(regexp_replace({x}, '[<>:"/\\|?*]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')"""
    return f"CASE WHEN {s} = '' THEN 'untitled' ELSE {s} END"


# ------------------------------------------------------------------ STR
@query("str1_normalize_type", f"SELECT p_partkey, {NORM('p_type')} AS type_norm, {NORM('p_name')} AS name_norm FROM part")
def str1_normalize_type(spark, sf):
    p = SI.table(spark, sf, "part")
    return p.select("p_partkey", S.normalize_type("p_type").alias("type_norm"), S.normalize_type("p_name").alias("name_norm"))


@query("str2_display_name", f"SELECT p_partkey, {display_sql(NORM('p_name'))} AS display FROM part")
def str2_display_name(spark, sf):
    p = SI.table(spark, sf, "part")
    return p.select("p_partkey", S.display_name(S.normalize_type("p_name")).alias("display"))


_FOLDER_SQL = r"regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1)"


@query("str3_public_id", f"""WITH {SI.UPLOAD_FILES_SQL}
SELECT page_id, filename,
       CASE WHEN filename <> '' THEN 'product_' || regexp_replace({stem_sql('filename')}, '[^a-zA-Z0-9_-]', '_', 'g') END AS public_id,
       CASE WHEN {_FOLDER_SQL} <> '' THEN 'products/' || {_FOLDER_SQL} END AS folder
FROM files""")
def str3_public_id(spark, sf):
    f = SI.upload_files(spark, sf).withColumn("_t", F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1))
    pid, folder = S.public_id("filename", "_t")
    return f.select("page_id", "filename", pid.alias("public_id"), folder.alias("folder"))


@query("str4_output_name", rf"""WITH {SI.UPLOAD_FILES_SQL}
SELECT page_id,
       CASE WHEN filename <> '' THEN regexp_replace(filename, '\.[^.]*$', '') || '.jpeg' END AS catalogue_name,
       {stem_sql('filename')} || '.jpeg' AS converted_name,
       {path_stem_sql('filename')} || '.jpg' AS output_file
FROM files""")
def str4_output_name(spark, sf):
    f = SI.upload_files(spark, sf)
    return f.select("page_id", S.catalogue_name("filename").alias("catalogue_name"),
                    S.converted_name("filename", F.lit("jpeg")).alias("converted_name"),
                    S.output_file_name("filename", F.lit("jpeg")).alias("output_file"))


@query("str5_extension", f"""WITH {SI.UPLOAD_FILES_SQL}
SELECT page_id, string_split(lower(filename), '.')[-1] AS extension,
       coalesce(filename <> '' AND string_split(lower(filename), '.')[-1] IN ('html'), false) AS allowed
FROM files""")
def str5_extension(spark, sf):
    f = SI.upload_files(spark, sf)
    return f.select("page_id", S.extension("filename").alias("extension"),
                    S.has_allowed_extension("filename", SI.UPLOAD_ALLOWED).alias("allowed"))


@query("str6_sanitize_filename", f"SELECT page_id, {sanitize_sql('url')} AS sanitized FROM pages")
def str6_sanitize_filename(spark, sf):
    p = SI.table(spark, sf, "pages")
    return p.select("page_id", S.sanitize_filename("url").alias("sanitized"))


@query("str7_human_size", f"""SELECT doc_id, {human_size_sql('n_chars')} AS size_text,
       {human_size_sql('n_chars * 40000000')} AS big_text FROM documents""")
def str7_human_size(spark, sf):
    d = SI.table(spark, sf, "documents")
    return d.select("doc_id", S.human_size("n_chars").alias("size_text"),
                    S.human_size(F.col("n_chars") * 40000000).alias("big_text"))


# ------------------------------------------------------------------ MTH
_RATIO_SQL = f"CASE WHEN original_size > 0 THEN {py_round_sql('((1.0 - converted_size::DOUBLE / original_size::DOUBLE) * 100.0)', 2)} ELSE 0.0 END"


@query("mth1_compression_ratio", f"""WITH {SI.CONVERSIONS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, {_RATIO_SQL} AS compression_ratio FROM conv""")
def mth1_compression_ratio(spark, sf):
    c = SI.conversions(spark, sf)
    return c.select("l_orderkey", "l_linenumber", "l_partkey",
                    N.compression_ratio("original_size", "converted_size").alias("compression_ratio"))


def _bpp_sql(q: str) -> str:
    return f"(CASE WHEN {q} >= 90 THEN 3.0 WHEN {q} >= 75 THEN 2.0 WHEN {q} >= 50 THEN 1.5 ELSE 1.0 END)"


def _estimate_sql(w, h, q):
    return f"CASE WHEN {w} > 0 AND {h} > 0 THEN floor(({w}::BIGINT * {h}::BIGINT)::DOUBLE * {_bpp_sql(q)})::BIGINT END"


@query("mth2_estimate_bytes", f"""WITH {SI.CONVERSIONS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, quality, {_estimate_sql('width', 'height', 'quality')} AS estimated_bytes FROM conv""")
def mth2_estimate_bytes(spark, sf):
    c = SI.conversions(spark, sf)
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "quality",
                    N.estimate_bytes("width", "height", "quality").alias("estimated_bytes"))


def _low_sql(w, h, q):
    side = f"(CASE WHEN {q} < 30 THEN 1920.0 ELSE 2048.0 END)"
    ratio = f"least({side} / {w}::DOUBLE, {side} / {h}::DOUBLE)"
    shrink = f"({q} < 50 AND ({w} > 2048 OR {h} > 2048) AND {ratio} < 1.0)"
    return (f"CASE WHEN {shrink} THEN floor({w}::DOUBLE * {ratio}) ELSE {w} END::INTEGER",
            f"CASE WHEN {shrink} THEN floor({h}::DOUBLE * {ratio}) ELSE {h} END::INTEGER")


def _cap_sql(w, h, m):
    a = f"({w}::DOUBLE / {h}::DOUBLE)"
    hy = f"({m} / {a})"
    hf, hc = f"floor({hy})", f"ceil({hy})"
    kf = f"(CASE WHEN {hf} = 0 THEN 0.0 ELSE abs({a} - {m} / {hf}) END)"
    kc = f"(CASE WHEN {hc} = 0 THEN 0.0 ELSE abs({a} - {m} / {hc}) END)"
    h_land = f"greatest(CASE WHEN {kc} < {kf} THEN {hc} ELSE {hf} END, 1.0)"
    wx = f"({m} * {a})"
    wf, wc = f"floor({wx})", f"ceil({wx})"
    w_port = f"greatest(CASE WHEN abs({a} - {wc} / {m}) < abs({a} - {wf} / {m}) THEN {wc} ELSE {wf} END, 1.0)"
    needs = f"({w} > {m} OR {h} > {m})"
    nw = f"(CASE WHEN NOT {needs} THEN {w}::DOUBLE WHEN {a} <= 1.0 THEN {w_port} ELSE {m} END)::INTEGER"
    nh = f"(CASE WHEN NOT {needs} THEN {h}::DOUBLE WHEN {a} <= 1.0 THEN {m} ELSE {h_land} END)::INTEGER"
    return nw, nh


_CAP = 4096


@query("mth3_target_size", f"""WITH {SI.CONVERSIONS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, {_low_sql('width', 'height', 'quality')[0]} AS low_width,
       {_low_sql('width', 'height', 'quality')[1]} AS low_height,
       {_cap_sql('width', 'height', f'{float(_CAP)!r}')[0]} AS cap_width,
       {_cap_sql('width', 'height', f'{float(_CAP)!r}')[1]} AS cap_height
FROM conv""")
def mth3_target_size(spark, sf):
    c = SI.conversions(spark, sf)
    lw, lh = N.low_quality_target("width", "height", "quality")
    cw, ch = N.cap_resolution("width", "height", F.lit(_CAP))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", lw.alias("low_width"), lh.alias("low_height"),
                    cw.alias("cap_width"), ch.alias("cap_height"))


_GRID_SQL = "(VALUES " + ", ".join(f"({q}, '{f}')" for q, f in batches.RENDITION_GRID) + ") grid(r_quality, r_format)"
_PLAN_SQL = f"""WITH {SI.CONVERSIONS_SQL},
plan AS (SELECT l_orderkey, l_linenumber, l_partkey, r_quality, r_format,
                CASE r_format WHEN 'jpeg' THEN 'jpg' WHEN 'webp' THEN 'webp' WHEN 'avif' THEN 'avif' END AS extension,
                CASE WHEN r_format = 'jpeg' THEN (CASE WHEN r_quality >= 90 THEN 0 WHEN r_quality >= 75 THEN 1 ELSE 2 END) END AS subsampling,
                {_low_sql('width', 'height', 'r_quality')[0]} AS target_width,
                {_low_sql('width', 'height', 'r_quality')[1]} AS target_height,
                {_estimate_sql('width', 'height', 'r_quality')} AS estimated_bytes
         FROM conv, {_GRID_SQL})
"""


@query("mth4_rendition_plan", _PLAN_SQL + "SELECT * FROM plan")
def mth4_rendition_plan(spark, sf):
    c = SI.conversions(spark, sf)
    p = batches.rendition_plan(c)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "r_quality", "r_format", "extension", "subsampling",
                    "target_width", "target_height", "estimated_bytes")


@query("mth4_storage_plan", _PLAN_SQL + """
SELECT r_format, r_quality, count(*) AS assets, sum(estimated_bytes)::BIGINT AS estimated_bytes FROM plan GROUP BY r_format, r_quality""")
def mth4_storage_plan(spark, sf):
    return batches.storage_plan(batches.rendition_plan(SI.conversions(spark, sf)))


# ------------------------------------------------------------------ FLT
@query("flt1_registry_retention", f"""
SELECT event_id, user_id FROM (
  SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN props ELSE ts::VARCHAR END AS created_at FROM events)
WHERE coalesce(try_cast(created_at AS TIMESTAMP) >= TIMESTAMP '{SI.RETENTION_NOW}' - INTERVAL 30 DAY, true)""")
def flt1_registry_retention(spark, sf):
    ev = SI.table(spark, sf, "events")
    reg = ev.select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("props"))
                    .otherwise(F.col("ts").cast("string")).alias("created_at"))
    return validation.retention(reg, "created_at", SI.RETENTION_NOW).select("event_id", "user_id")


def _admission_sql():
    mb = SI.UPLOAD_MAX_BYTES
    return f"""WITH {SI.UPLOAD_BATCHES_SQL},
fe AS (SELECT *, string_split(lower(filename), '.')[-1] AS ext FROM bfiles),
fe2 AS (SELECT batch_id, position, size,
               CASE WHEN filename IS NULL OR filename = '' THEN 2 WHEN ext NOT IN ('html') THEN 2 WHEN size > {mb} THEN 3 END AS prio,
               CASE WHEN filename IS NULL OR filename = '' THEN 400 WHEN ext NOT IN ('html') THEN 400 WHEN size > {mb} THEN 413 END AS st,
               CASE WHEN filename IS NULL OR filename = '' THEN 'One or more files have no filename'
                    WHEN ext NOT IN ('html') THEN 'Only PSD files allowed for product uploads. File ''' || filename || ''' has extension: .' || ext
                    WHEN size > {mb} THEN 'File ''' || filename || ''' too large: ' || {human_size_sql('size')} || '. Maximum allowed: ' || {human_size_sql(str(mb))}
               END AS msg
        FROM fe),
pb AS (SELECT batch_id, count(*) AS n_files, sum(size)::BIGINT AS total_size,
              arg_min(st, (prio, position)) FILTER (WHERE prio IS NOT NULL) AS fst,
              arg_min(msg, (prio, position)) FILTER (WHERE prio IS NOT NULL) AS fmsg
       FROM fe2 GROUP BY batch_id),
j AS (SELECT breq.*, coalesce(pb.n_files, 0) AS n_files, coalesce(pb.total_size, 0) AS total_size, pb.fst, pb.fmsg FROM breq LEFT JOIN pb USING (batch_id)),
e AS (SELECT *,
        CASE WHEN n_files = 0 THEN 400 WHEN fst IS NOT NULL THEN fst WHEN total_size > {mb * 5} THEN 413
             WHEN NOT (quality BETWEEN 1 AND 100) THEN 400
             WHEN product_type NOT IN ('metal_cards', 'nfc_cards', 'standees') THEN 400 END AS status,
        CASE WHEN n_files = 0 THEN 'No files provided.' WHEN fst IS NOT NULL THEN fmsg
             WHEN total_size > {mb * 5} THEN 'Total batch size too large: ' || {human_size_sql('total_size')} || '. Maximum allowed: ' || {human_size_sql(str(mb * 5))}
             WHEN NOT (quality BETWEEN 1 AND 100) THEN 'Quality must be between 1 and 100'
             WHEN product_type NOT IN ('metal_cards', 'nfc_cards', 'standees') THEN 'Invalid product type ''' || product_type || '''. Allowed types: metal_cards, nfc_cards, standees' END AS message
      FROM j)
SELECT batch_id, product_type, quality, format, n_files, total_size, status IS NULL AS accepted, status, message FROM e"""


@query("flt2_batch_admission", _admission_sql())
def flt2_batch_admission(spark, sf):
    files, req = SI.upload_batches(spark, sf)
    types = product_types.base_types(spark)
    return validation.batch_admission(files, req, types, allowed=SI.UPLOAD_ALLOWED, max_bytes=SI.UPLOAD_MAX_BYTES)


@query("flt3_default_fill", f"""WITH {SI.UPLOAD_REQUESTS_SQL}
SELECT p_partkey, product_type, quality, format, fallbacks FROM filled""")
def flt3_default_fill(spark, sf):
    f = validation.fill_defaults(SI.upload_requests(spark, sf))
    return f.select("p_partkey", "product_type", "quality", "format", F.array_join("fallbacks", ",").alias("fallbacks"))


_TS = "'%Y-%m-%d %H:%M:%S'"


@query("flt4_catalogue_filter", f"""WITH {SI.CATALOGUE_SQL}
SELECT document_id, product_type, filename, strftime(uploaded_at, {_TS}) AS uploaded_at FROM cat WHERE product_type = '{SI.CATALOGUE_TYPE}'""")
def flt4_catalogue_filter(spark, sf):
    c = catalog.filter_type(SI.catalogue(spark, sf), SI.CATALOGUE_TYPE)
    return c.select("document_id", "product_type", "filename", F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"))


_TIE = ["document_id", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("top1_newest_n", f"""WITH {SI.CATALOGUE_SQL}
SELECT document_id, filename, l_partkey, strftime(uploaded_at, {_TS}) AS uploaded_at FROM cat WHERE product_type = '{SI.CATALOGUE_TYPE}'
ORDER BY cat.uploaded_at DESC, {', '.join(_TIE)} LIMIT 100""")
def top1_newest_n(spark, sf):
    c = catalog.newest(SI.catalogue(spark, sf), SI.CATALOGUE_TYPE, 100, tie_break=_TIE)
    return c.select("document_id", "filename", "l_partkey", F.date_format("uploaded_at", "yyyy-MM-dd HH:mm:ss").alias("uploaded_at"))


@query("agg8_listing_counts", f"""WITH {SI.CATALOGUE_SQL}
SELECT count(*) AS count, 'all' AS filter FROM cat
UNION ALL SELECT count(*), '{SI.CATALOGUE_TYPE}' FROM cat WHERE product_type = '{SI.CATALOGUE_TYPE}'""")
def agg8_listing_counts(spark, sf):
    return catalog.listing_counts_by(SI.catalogue(spark, sf), [None, SI.CATALOGUE_TYPE])


_DELETES_SQL = """
del AS (SELECT o_orderkey::VARCHAR || '-' || substr(o_orderpriority, 1, 1) AS document_id FROM orders WHERE o_orderstatus = 'F')
"""


def _deletes(spark, sf):
    o = SI.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.substring("o_orderpriority", 1, 1)).alias("document_id"))


@query("snk4_catalogue_delete", f"""WITH {SI.CATALOGUE_SQL}, {_DELETES_SQL}
SELECT document_id, CASE WHEN document_id IN (SELECT document_id FROM cat) THEN 'deleted' ELSE 'not_found' END AS outcome FROM del""")
def snk4_catalogue_delete(spark, sf):
    _, report = catalog.delete_documents(SI.catalogue(spark, sf), _deletes(spark, sf))
    return report.select("document_id", "outcome")


@query("snk4_catalogue_remaining", f"""WITH {SI.CATALOGUE_SQL}, {_DELETES_SQL}
SELECT product_type, count(*) AS remaining FROM cat WHERE document_id NOT IN (SELECT document_id FROM del) GROUP BY product_type""")
def snk4_catalogue_remaining(spark, sf):
    remaining, _ = catalog.delete_documents(SI.catalogue(spark, sf), _deletes(spark, sf))
    return remaining.groupBy("product_type").agg(F.count(F.lit(1)).alias("remaining"))


# Stand-in sizes in which every reason occurs: Spanish files are missing, one length in seven is an empty file, one in eleven has no height.
@query("flt7_asset_quarantine", """
SELECT doc_id, CASE WHEN text IS NULL OR lang = 'es' THEN 'missing' WHEN coalesce(n_chars, 0) % 7 = 0 THEN 'empty'
                    WHEN coalesce(n_chars, 0) % 11 = 0 THEN 'zero_dimensions' END AS reject_reason FROM documents""")
def flt7_asset_quarantine(spark, sf):
    n = F.coalesce(F.col("n_chars"), F.lit(0))
    d = SI.table(spark, sf, "documents").select(
        "doc_id", (F.col("text").isNotNull() & (F.col("lang") != "es")).alias("exists"), (n % 7).alias("size"),
        F.lit(64).alias("width"), (n % 11).alias("height"))
    return validation.quarantine(d, size="size", width="width", height="height", exists="exists").select("doc_id", "reject_reason")


# ------------------------------------------------------------------ product types
def _types(spark, sf):
    return product_types.all_types(spark, SI.dynamic_types(spark, sf))


@query("set1_all_types", f"""WITH {SI.DYNAMIC_TYPES_SQL}
SELECT position, product_type, {display_sql('product_type')} AS name, source, source <> 'base' AS can_delete FROM types""")
def set1_all_types(spark, sf):
    return product_types.folder_listing(_types(spark, sf))


@query("agg7_type_counts", f"""WITH {SI.DYNAMIC_TYPES_SQL}
SELECT count(*) AS total, count(*) FILTER (WHERE source = 'base') AS base_count, count(*) FILTER (WHERE source = 'dynamic') AS dynamic_count FROM types""")
def agg7_type_counts(spark, sf):
    return product_types.type_counts(_types(spark, sf))


@query("set2_add_types", f"""WITH {SI.DYNAMIC_TYPES_SQL},
r AS (SELECT p_partkey AS position, p_name AS name, trim(coalesce(p_name, '')) AS nm, {NORM("trim(coalesce(p_name, ''))")} AS product_type FROM part),
f AS (SELECT product_type, min(position) AS first FROM r WHERE nm <> '' AND product_type <> '' GROUP BY product_type)
SELECT r.position, r.name, r.product_type,
       CASE WHEN nm = '' THEN 'missing_name' WHEN r.product_type = '' THEN 'invalid_name'
            WHEN r.product_type IN (SELECT product_type FROM types) OR r.position <> f.first THEN 'exists' ELSE 'created' END AS outcome,
       CASE WHEN nm <> '' AND r.product_type <> '' AND r.product_type NOT IN (SELECT product_type FROM types) AND r.position = f.first THEN 200 ELSE 400 END AS status,
       'Custom ' || lower(nm) AS description
FROM r LEFT JOIN f USING (product_type)""")
def set2_add_types(spark, sf):
    p = SI.table(spark, sf, "part")
    req = p.select(F.col("p_partkey").alias("position"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"))
    return product_types.add_types(_types(spark, sf), req)


_REMOVE_REQ_SQL = f"""
rr AS (SELECT p_partkey AS position,
              CASE WHEN p_size = 1 THEN 'nfc_cards' WHEN p_size IN (2, 3) THEN {NORM('p_brand')} ELSE {NORM('p_type')} END AS product_type
       FROM part)
"""


@query("set3_remove_types", f"""WITH {SI.DYNAMIC_TYPES_SQL}, {_REMOVE_REQ_SQL},
f AS (SELECT product_type, min(position) AS first FROM rr GROUP BY product_type)
SELECT rr.position, rr.product_type,
       CASE WHEN t.source = 'base' THEN 400 WHEN t.source IS NULL OR rr.position <> f.first THEN 404 ELSE 200 END AS status
FROM rr JOIN f USING (product_type) LEFT JOIN types t USING (product_type)""")
def set3_remove_types(spark, sf):
    p = SI.table(spark, sf, "part")
    pt = (F.when(F.col("p_size") == 1, F.lit("nfc_cards")).when(F.col("p_size").isin(2, 3), S.normalize_type("p_brand"))
          .otherwise(S.normalize_type("p_type")))
    req = p.select(F.col("p_partkey").alias("position"), pt.alias("product_type"))
    return product_types.remove_types(_types(spark, sf), req)


@query("joi1_type_membership", f"""WITH {SI.DYNAMIC_TYPES_SQL}, {SI.UPLOAD_REQUESTS_SQL}
SELECT p_partkey, product_type, product_type IN (SELECT product_type FROM types) AS known FROM filled""")
def joi1_type_membership(spark, sf):
    filled = validation.fill_defaults(SI.upload_requests(spark, sf)).select("p_partkey", "product_type")
    known, unknown = product_types.type_membership(filled, _types(spark, sf))
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))


# ------------------------------------------------------------------ batches
@query("agg5_conversion_tally", f"""WITH {SI.CONVERSIONS_SQL}
SELECT batch_id, count(*) FILTER (WHERE success) AS successful, count(*) AS total FROM conv GROUP BY batch_id""")
def agg5_conversion_tally(spark, sf):
    return batches.conversion_tally(SI.conversions(spark, sf))


@query("agg6_batch_report", f"""WITH {SI.CONVERSIONS_SQL},
r AS (SELECT *, CASE WHEN success THEN {_RATIO_SQL} END AS ratio FROM conv),
g AS (SELECT batch_id, count(*) AS total_files, count(*) FILTER (WHERE success) AS completed_files,
             count(*) FILTER (WHERE NOT success) AS failed_files, sum(original_size)::BIGINT AS total_original_size,
             coalesce(sum(converted_size) FILTER (WHERE success), 0)::BIGINT AS total_optimized_size,
             coalesce(sum(ratio) FILTER (WHERE success), 0.0) AS rsum
      FROM r GROUP BY batch_id)
SELECT batch_id, CASE WHEN failed_files = 0 THEN 'completed' ELSE 'partially_completed' END AS status,
       total_files, completed_files, failed_files, total_original_size, total_optimized_size,
       {py_round_sql('(rsum / greatest(completed_files, 1))', 6)} AS average_compression_ratio,
       {py_round_sql('(completed_files / total_files * 100.0)', 6)} AS success_rate,
       'Batch processing completed: ' || completed_files::VARCHAR || '/' || total_files::VARCHAR || ' files successful (' ||
       printf('%.1f', completed_files / total_files * 100.0) || '%)' AS message
FROM g""")
def agg6_batch_report(spark, sf):
    return batches.batch_report(SI.conversions(spark, sf))


@query("win1_batch_progress", f"""WITH {SI.CONVERSIONS_SQL},
w AS (SELECT l_orderkey, l_linenumber, l_partkey,
             row_number() OVER (PARTITION BY batch_id ORDER BY {', '.join(SI.LINE_ORDER)}) - 1 AS i,
             count(*) OVER (PARTITION BY batch_id) AS n FROM conv)
SELECT l_orderkey, l_linenumber, l_partkey, i / n * 100.0 AS progress_before, (i + 1) / n * 100.0 AS progress_after FROM w""")
def win1_batch_progress(spark, sf):
    p = batches.batch_progress(SI.conversions(spark, sf), order=SI.LINE_ORDER, keep=["l_orderkey"])
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "progress_before", "progress_after")


@query("win2_eta", f"""WITH e AS (
  SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id) AS total,
         least(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), count(*) OVER (PARTITION BY user_id)) AS current,
         epoch(ts) - min(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS el
  FROM events),
p AS (SELECT *, CASE WHEN total > 0 THEN current / total * 100.0 ELSE 0.0 END AS pct FROM e)
SELECT event_id, user_id, current, total, {py_round_sql('pct', 2)} AS percentage, {py_round_sql('el', 2)} AS elapsed_seconds,
       {py_round_sql('(CASE WHEN pct > 0 THEN el / (pct / 100.0) - el ELSE 0.0 END)', 2)} AS remaining_seconds,
       current >= total AS is_complete
FROM p""")
def win2_eta(spark, sf):
    ev = SI.table(spark, sf, "events")
    t = batches.eta(ev, key="user_id", ts="ts", order=["ts", "event_id"], keep=[])
    return t.select("event_id", "user_id", "current", "total", "percentage", "elapsed_seconds", "remaining_seconds", "is_complete")


# ------------------------------------------------------------------ jobs
def _state(spark, sf):
    st = jobs.fold_state(SI.job_updates(spark, sf), job="job_id", seq=["ts", "event_id"], ts="ts")
    return st.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("job1_state_fold", f"""WITH {SI.JOB_UPDATES_SQL}
SELECT job_id, created_at, n_updates, status, progress, message, error, current_file, completed_files, failed_files, total_files,
       is_batch FROM state""")
def job1_state_fold(spark, sf):
    return _state(spark, sf).select("job_id", "created_at", "n_updates", "status", "progress", "message", "error",
                                    "current_file", "completed_files", "failed_files", "total_files", "is_batch")


@query("flt5_jobs_filter", f"""WITH {SI.JOB_UPDATES_SQL}
SELECT 'click, single' AS filter, job_id, status, progress FROM state WHERE status = 'click' AND NOT coalesce(is_batch, false)
UNION ALL SELECT 'batch', job_id, status, progress FROM state WHERE coalesce(is_batch, false)
UNION ALL SELECT 'view', job_id, status, progress FROM state WHERE status = 'view'
UNION ALL SELECT 'view, batch', job_id, status, progress FROM state WHERE status = 'view' AND coalesce(is_batch, false)""")
def flt5_jobs_filter(spark, sf):
    state = _state(spark, sf)
    parts = [jobs.filter_jobs(state, **asked).select(F.lit(name).alias("filter"), "job_id", "status", "progress")
             for name, asked in (("click, single", {"status": "click", "is_batch": False}), ("batch", {"status": " ", "is_batch": True}),
                                 ("view", {"status": "view"}), ("view, batch", {"status": "view", "is_batch": True}))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("flt6_job_lookup", f"""WITH {SI.JOB_UPDATES_SQL}
SELECT job_id, status, progress, n_updates FROM state WHERE job_id = {SI.LOOKUP_JOB}""")
def flt6_job_lookup(spark, sf):
    return jobs.lookup_job(_state(spark, sf), SI.LOOKUP_JOB).select("job_id", "status", "progress", "n_updates")

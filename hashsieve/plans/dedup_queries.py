"""Registered near-duplicate queries (DED, FPR-1/2/7/8, AGG-1..4) and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.hashing import DEFAULT_THRESHOLD as T
from ..functions.hashing import hamming, hamming_hex, long_to_hex
from ..operators import dedup, reports
from ..operators.fingerprints import array_hashes, digests
from ..operators.similarity import similarity_join
from . import standins as SI
from .registry import query

HEX = SI.hex_sql


# ------------------------------------------------------------------ FPR
@query("fpr8_simhash", f"""WITH {SI.SIMHASH_SQL}
SELECT doc_id, {HEX('fp')} AS fp_hex, n_tokens FROM fps""")
def fpr8_simhash(spark, sf):
    return SI.doc_fingerprints(spark, sf).select("doc_id", long_to_hex("fp").alias("fp_hex"), "n_tokens")


def _grid_sql():
    # average hash: cell > mean, first cell = bit 63; difference hash: 7 comparisons per row
    return """
g AS (SELECT vec_id, label, embedding, list_sum([x::DOUBLE for x in embedding]) / 64.0 AS mean FROM embeddings),
ah AS (SELECT vec_id, sum(CASE WHEN embedding[i + 1]::DOUBLE > mean THEN (1::UBIGINT << (63 - i)) ELSE 0::UBIGINT END)::UBIGINT AS ahash
       FROM g, range(64) r(i) GROUP BY vec_id),
dh AS (SELECT vec_id, sum(CASE WHEN embedding[(i // 7) * 8 + (i % 7) + 2]::DOUBLE > embedding[(i // 7) * 8 + (i % 7) + 1]::DOUBLE
                               THEN (1::UBIGINT << (55 - i)) ELSE 0::UBIGINT END)::UBIGINT AS dhash
       FROM g, range(56) r(i) GROUP BY vec_id)
"""


@query("fpr1_average_hash", f"""WITH {_grid_sql()}
SELECT g.vec_id, g.label, {HEX('ahash')} AS ahash_hex FROM g JOIN ah USING (vec_id)""")
def fpr1_average_hash(spark, sf):
    e = array_hashes(SI.table(spark, sf, "embeddings"))
    return e.select("vec_id", "label", long_to_hex("ahash").alias("ahash_hex"))


@query("fpr2_difference_hash", f"""WITH {_grid_sql()}
SELECT vec_id, {HEX('dhash')} AS dhash_hex FROM dh""")
def fpr2_difference_hash(spark, sf):
    e = array_hashes(SI.table(spark, sf, "embeddings"))
    return e.select("vec_id", long_to_hex("dhash").alias("dhash_hex"))


@query("ded1_hamming", f"""WITH {_grid_sql()}
SELECT vec_id, {SI.dist_sql('ahash', 'dhash')} AS distance, 64 AS malformed_distance
FROM ah JOIN dh USING (vec_id)""")
def ded1_hamming(spark, sf):
    e = array_hashes(SI.table(spark, sf, "embeddings"))
    return e.select("vec_id", hamming("ahash", "dhash").cast("int").alias("distance"),
                    hamming_hex(long_to_hex("ahash"), F.lit("zz")).cast("int").alias("malformed_distance"))


# Each coefficient is a dot product of the 64 cells with constants: a cell stands for a 4x4 block of the 32x32 grid.
_GRID_CELLS = "cell AS (SELECT vec_id, pos // 8 AS r, pos % 8 AS c, embedding[pos + 1]::DOUBLE AS x FROM embeddings, range(64) t(pos))"


def _median_bits_sql(rows):
    """Hash of ``rows(vec_id, r, c, x)``: bit = x > median, row by row."""
    return f"""md AS (SELECT vec_id, median(x) AS m FROM {rows} GROUP BY vec_id),
h AS (SELECT vec_id, sum(CASE WHEN x > m THEN (1::UBIGINT << (63 - (r * 8 + c))) ELSE 0::UBIGINT END)::UBIGINT AS hash
      FROM {rows} JOIN md USING (vec_id) GROUP BY vec_id)"""


@query("fpr3_perceptual_hash", f"""WITH {_GRID_CELLS},
dct AS (SELECT k, i, sum(2 * cos(pi() * k * (2 * (4 * i + s) + 1) / 64.0)) AS v FROM range(8) a(k), range(8) b(i), range(4) d(s) GROUP BY k, i),
half AS (SELECT vec_id, k, c, sum(v * x) AS y FROM cell JOIN dct ON dct.i = cell.r GROUP BY vec_id, k, c),
coef AS (SELECT vec_id, half.k AS r, dct.k AS c, sum(v * y) AS x FROM half JOIN dct ON dct.i = half.c GROUP BY vec_id, half.k, dct.k),
{_median_bits_sql('coef')}
SELECT vec_id, {HEX('hash')} AS phash_hex FROM h""")
def fpr3_perceptual_hash(spark, sf):
    """pHash of each 8x8 embedding grid."""
    from ..operators.image_hashes import grid_fingerprints
    g = grid_fingerprints(SI.table(spark, sf, "embeddings"), "vec_id", "embedding", 8)
    return g.select("vec_id", F.col("phash").alias("phash_hex"))


@query("fpr4_wavelet_hash", f"""WITH {_GRID_CELLS}, {_median_bits_sql('cell')}
SELECT vec_id, {HEX('hash')} AS whash_hex FROM h""")
def fpr4_wavelet_hash(spark, sf):
    """wHash of each 8x8 embedding grid."""
    from ..operators.image_hashes import grid_fingerprints
    g = grid_fingerprints(SI.table(spark, sf, "embeddings"), "vec_id", "embedding", 8)
    return g.select("vec_id", F.col("whash").alias("whash_hex"))


@query("fpr7_content_digest", """SELECT doc_id, coalesce(sha256(text), '') AS sha256, coalesce(md5(text), '') AS md5,
       coalesce(sha1(text), '') AS sha1 FROM documents""")
def fpr7_content_digest(spark, sf):
    d = digests(SI.table(spark, sf, "documents"), "text")
    return d.select("doc_id", "sha256", "md5", "sha1")


# ------------------------------------------------------------------ DED-2
@query("ded2_similarity_join", f"""WITH {SI.SIMHASH_SQL},
reps AS (SELECT fp, min(doc_id) AS first_doc, count(*) AS copies FROM fps WHERE fp IS NOT NULL GROUP BY fp)
SELECT a.first_doc AS a_doc, b.first_doc AS b_doc, {HEX('a.fp')} AS a_fp_hex, {HEX('b.fp')} AS b_fp_hex,
       {SI.dist_sql('a.fp', 'b.fp')} AS distance, a.copies AS a_copies, b.copies AS b_copies
FROM reps a JOIN reps b ON a.first_doc < b.first_doc AND {SI.dist_sql('a.fp', 'b.fp')} <= {T}""")
def ded2_similarity_join(spark, sf):
    """Distinct fingerprints within the threshold of each other (copies counted,
    not expanded into pairs)."""
    fps = SI.doc_fingerprints(spark, sf).filter(F.col("fp").isNotNull())
    reps = dedup._cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")))
    pairs = similarity_join(reps, reps, T, left_id="first_doc", right_id="first_doc", order="lt")
    c = reps.select("first_doc", "copies")
    return (pairs.join(c.withColumnRenamed("first_doc", "l_id").withColumnRenamed("copies", "a_copies"), "l_id")
            .join(c.withColumnRenamed("first_doc", "r_id").withColumnRenamed("copies", "b_copies"), "r_id")
            .select(F.col("l_id").alias("a_doc"), F.col("r_id").alias("b_doc"), long_to_hex("l_fp").alias("a_fp_hex"),
                    long_to_hex("r_fp").alias("b_fp_hex"), "distance", "a_copies", "b_copies"))


# ------------------------------------------------------------------ DED-5 / 3 / 4
_MATCH_SQL = f"""WITH RECURSIVE {SI.SIMHASH_SQL}, {SI.REGISTRY_SQL},
m AS (SELECT inc.doc_id, reg.seq, reg.fp AS rfp, {SI.dist_sql('inc.fp', 'reg.fp')} AS d
      FROM inc JOIN reg ON {SI.dist_sql('inc.fp', 'reg.fp')} <= {T}),
agg AS (SELECT doc_id, first(seq ORDER BY d, seq) AS closest_doc, first(rfp ORDER BY d, seq) AS closest_fp,
               min(d) AS closest_distance, count(*) AS n_similar,
               string_agg(d::VARCHAR || ':' || seq::VARCHAR, ',' ORDER BY d, seq) AS similar_list
        FROM m GROUP BY doc_id)
"""


def _checked(spark, sf, lists=False):
    fps = dedup._cut(SI.parsed(SI.doc_fingerprints(spark, sf)))
    reg, inc = SI.split_registry(spark, sf, fps)
    return dedup.check_against_registry(inc, reg, T, seq="doc_id", fp="fp", lists=lists)


@query("ded5_check_against_registry", _MATCH_SQL + """
SELECT inc.doc_id, agg.doc_id IS NOT NULL AS is_duplicate,
       CASE WHEN inc.fp IS NULL THEN 'store_with_error' WHEN agg.doc_id IS NOT NULL THEN 'skip_duplicate' ELSE 'store_unique' END AS action,
       agg.closest_doc, agg.closest_distance, coalesce(agg.n_similar, 0) AS n_similar
FROM inc LEFT JOIN agg USING (doc_id)""")
def ded5_check_against_registry(spark, sf):
    c = _checked(spark, sf)
    return c.select(F.col("seq").alias("doc_id"), "is_duplicate", "action", F.col("closest.seq").alias("closest_doc"),
                    F.col("closest.distance").alias("closest_distance"), F.col("n_similar").cast("long").alias("n_similar"))


@query("ded3_closest_match", _MATCH_SQL + f"""
SELECT doc_id, closest_doc, {HEX('closest_fp')} AS closest_fp_hex, closest_distance FROM agg""")
def ded3_closest_match(spark, sf):
    c = _checked(spark, sf).filter("is_duplicate")
    return c.select(F.col("seq").alias("doc_id"), F.col("closest.seq").alias("closest_doc"),
                    long_to_hex("closest.fp").alias("closest_fp_hex"), F.col("closest.distance").alias("closest_distance"))


@query("ded4_similar_list", _MATCH_SQL + """
SELECT doc_id, similar_list, n_similar FROM agg""")
def ded4_similar_list(spark, sf):
    c = _checked(spark, sf, lists=True).filter("is_duplicate")
    lst = F.array_join(F.transform("similar", lambda x: F.concat(x["distance"].cast("string"), F.lit(":"), x["seq"].cast("string"))), ",")
    return c.select(F.col("seq").alias("doc_id"), lst.alias("similar_list"), F.col("n_similar").cast("long").alias("n_similar"))


# ------------------------------------------------------------------ DED-6 and friends
def _walk_sql(rows):
    return f"""WITH RECURSIVE {SI.SIMHASH_SQL},
{SI.greedy_walk_sql(rows, 'walk', T)},
res AS ({SI.walk_result_sql('walk')})
"""


_WALK_SQL, _WALK_ERRORS_SQL = _walk_sql("fps"), _walk_sql("fpe")  # the second with files that cannot be read


def _batch(spark, sf, errors=False):
    fps = SI.doc_fingerprints(spark, sf)
    fps = dedup._cut(SI.parsed(fps) if errors else fps)
    res = dedup.greedy_dedup(fps, T, seq="doc_id", fp="fp", written=True)
    return fps, res


@query("ded6_batch_dedup", _WALK_SQL + f"""
SELECT doc_id, {HEX('fp')} AS fp_hex, is_duplicate, action FROM res""")
def ded6_batch_dedup(spark, sf):
    _, r = _batch(spark, sf)
    return r.select(F.col("seq").alias("doc_id"), long_to_hex("fp").alias("fp_hex"), "is_duplicate", "action")


@query("agg1_batch_summary", _WALK_ERRORS_SQL + """
SELECT count(*) AS total_processed, count(*) FILTER (WHERE is_duplicate) AS duplicates_found,
       count(*) FILTER (WHERE action = 'store_unique') AS unique_images,
       count(*) FILTER (WHERE NOT is_duplicate AND action <> 'store_unique') AS errors,
       CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE is_duplicate) / count(*) * 100.0 ELSE 0.0 END AS duplicate_rate
FROM res""")
def agg1_batch_summary(spark, sf):
    _, r = _batch(spark, sf, errors=True)
    return reports.batch_summary(r)


_DUP_REF_SQL = _WALK_SQL + f""",
src AS (SELECT doc_id, source FROM documents),
u AS (SELECT doc_id, fp FROM res WHERE action = 'store_unique'),
dm AS (SELECT d.doc_id, first(u.doc_id ORDER BY {SI.dist_sql('d.fp', 'u.fp')}, u.doc_id) AS matched_doc,
              first(u.fp ORDER BY {SI.dist_sql('d.fp', 'u.fp')}, u.doc_id) AS matched_fp,
              min({SI.dist_sql('d.fp', 'u.fp')}) AS distance
       FROM res d JOIN u ON u.doc_id < d.doc_id AND {SI.dist_sql('d.fp', 'u.fp')} <= {T}
       WHERE d.is_duplicate GROUP BY d.doc_id)
"""


@query("ded7_duplicate_reference", _DUP_REF_SQL + f"""
SELECT dm.doc_id, dm.matched_doc, {HEX('dm.matched_fp')} AS matched_fp_hex, dm.distance, src.source AS matched_source,
       'kept_for_job' AS action
FROM dm JOIN src ON src.doc_id = dm.matched_doc""")
def ded7_duplicate_reference(spark, sf):
    fps, r = _batch(spark, sf)
    m = dedup.duplicate_matches(r, T)
    src = fps.select(F.col("doc_id").alias("matched_doc"), F.col("source").alias("matched_source"))
    return (m.select(F.col("seq").alias("doc_id"), F.col("closest.seq").alias("matched_doc"),
                     long_to_hex("closest.fp").alias("matched_fp_hex"), F.col("closest.distance").alias("distance"))
            .join(src, "matched_doc")
            .withColumn("action", F.lit("kept_for_job")))


# The registry is numbered behind the batch here: its entries still count as earlier.
@query("ded7_registry_reference", f"""WITH RECURSIVE {SI.SIMHASH_SQL}, {SI.REGISTRY_SQL},
{SI.greedy_walk_sql('inc', 'rwalk', T, initial='(SELECT coalesce(list(fp ORDER BY seq), []::UBIGINT[]) FROM reg)')},
rres AS ({SI.walk_result_sql('rwalk')}),
known AS (SELECT 0 AS origin, seq + 1000000000 AS seq, fp FROM reg UNION ALL SELECT 1, doc_id, fp FROM rres WHERE action = 'store_unique'),
m AS (SELECT d.doc_id, k.origin, k.seq, k.fp, {SI.dist_sql('d.fp', 'k.fp')} AS distance FROM rres d
      JOIN known k ON (k.origin = 0 OR k.seq < d.doc_id) AND {SI.dist_sql('d.fp', 'k.fp')} <= {T} WHERE d.is_duplicate)
SELECT doc_id, first(origin ORDER BY distance, origin, seq) AS matched_origin, first(seq ORDER BY distance, origin, seq) AS matched_seq,
       {HEX('first(fp ORDER BY distance, origin, seq)')} AS matched_fp_hex, min(distance) AS distance FROM m GROUP BY doc_id""")
def ded7_registry_reference(spark, sf):
    fps = dedup._cut(SI.parsed(SI.doc_fingerprints(spark, sf)))
    reg, inc = SI.split_registry(spark, sf, fps)
    reg = reg.select("fp", (F.col("seq") + 1_000_000_000).alias("seq"))
    res = dedup.greedy_dedup(inc, T, registry=reg, seq="doc_id", fp="fp")
    m = dedup.duplicate_matches(res, T, registry=reg)
    return m.select(F.col("seq").alias("doc_id"), F.col("closest.origin").alias("matched_origin"), F.col("closest.seq").alias("matched_seq"),
                    long_to_hex("closest.fp").alias("matched_fp_hex"), F.col("closest.distance").alias("distance"))


def _stored_name_sql(fp: str) -> str:
    return (f"substr({HEX(fp)}, 1, 8) || '_doc_' || doc_id::VARCHAR || '_' || "
            f"strftime(TIMESTAMP '{SI.BATCH_TIME}', '%Y%m%d_%H%M%S') || '.txt'")


@query("ded8_route_outcomes", _WALK_ERRORS_SQL + f"""
SELECT doc_id,
       CASE action WHEN 'store_unique' THEN 'unique_stored' WHEN 'skip_duplicate' THEN 'duplicate_skipped' ELSE 'error' END AS route,
       CASE WHEN action = 'store_unique' THEN {_stored_name_sql('fp')} END AS stored_name
FROM res""")
def ded8_route_outcomes(spark, sf):
    fps, r = _batch(spark, sf, errors=True)
    routed = dedup.route(r)
    path = F.concat(F.lit("doc_"), F.col("seq").cast("string"), F.lit(".txt"))
    name = S.hash_filename(path, long_to_hex("fp"), F.lit(SI.BATCH_TIME).cast("timestamp"))
    return routed.select(F.col("seq").alias("doc_id"), "route",
                         F.when(F.col("action") == dedup.ACTION_UNIQUE, name).alias("stored_name"))


@query("str8_hash_filename", f"""WITH {SI.SIMHASH_SQL}
SELECT doc_id, {_stored_name_sql('fp')} AS stored_name FROM fps""")
def str8_hash_filename(spark, sf):
    fps = SI.doc_fingerprints(spark, sf)
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return fps.select("doc_id", S.hash_filename(path, long_to_hex("fp"), F.lit(SI.BATCH_TIME).cast("timestamp")).alias("stored_name"))


# ------------------------------------------------------------------ with an existing registry
_REG_WALK_SQL = f"""WITH RECURSIVE {SI.SIMHASH_SQL}, {SI.REGISTRY_SQL},
{SI.greedy_walk_sql('inc', 'rwalk', T, initial='(SELECT coalesce(list(fp ORDER BY seq), []::UBIGINT[]) FROM reg)')},
rres AS ({SI.walk_result_sql('rwalk')}),
newreg AS (SELECT fp, seq AS registered_seq, 'existing' AS origin FROM reg
           UNION ALL SELECT fp, doc_id, 'new' FROM rres WHERE action = 'store_unique')
"""


def _registry_run(spark, sf):
    fps = dedup._cut(SI.parsed(SI.doc_fingerprints(spark, sf)))
    reg, inc = SI.split_registry(spark, sf, fps)
    res = dedup.greedy_dedup(inc, T, registry=reg, seq="doc_id", fp="fp")
    new = dedup.register_uniques(reg.select("fp", F.col("seq").alias("registered_seq"), F.lit("existing").alias("origin")), res)
    return inc, res, new.withColumn("origin", F.coalesce("origin", F.lit("new")))


@query("ded9_register_uniques", _REG_WALK_SQL + f"""
SELECT {HEX('fp')} AS fp_hex, registered_seq, origin FROM newreg""")
def ded9_register_uniques(spark, sf):
    _, _, new = _registry_run(spark, sf)
    return new.select(long_to_hex("fp").alias("fp_hex"), "registered_seq", "origin")


_STATS_SQL = _REG_WALK_SQL + f""",
st AS (SELECT count(*) AS total_processed, count(*) FILTER (WHERE action = 'skip_duplicate') AS duplicates_found,
              count(*) FILTER (WHERE action = 'store_unique') AS unique_images,
              (SELECT count(*) FROM newreg) AS total_hashes, {T} AS threshold
       FROM rres),
st2 AS (SELECT *, duplicates_found / greatest(total_processed, 1) * 100.0 AS duplicate_rate, duplicates_found AS storage_saved FROM st)
"""


@query("agg2_registry_statistics", _STATS_SQL + "SELECT * FROM st2")
def agg2_registry_statistics(spark, sf):
    _, res, new = _registry_run(spark, sf)
    size = new.agg(F.count(F.lit(1)).alias("total_hashes"))
    return reports.registry_statistics(res, size, T)


@query("agg3_dedup_report", _STATS_SQL + """
SELECT st2.*, (SELECT count(*) FROM rres WHERE action = 'store_unique') AS unique_files,
       (SELECT count(DISTINCT inc.source) FROM rres JOIN inc USING (doc_id) WHERE rres.is_duplicate) AS duplicate_records,
       (storage_saved * 2.5)::DOUBLE AS total_storage_saved_mb,
       array_to_string(list_filter([
           CASE WHEN duplicate_rate > 20 THEN 'High duplicate rate detected - consider reviewing source data' END,
           CASE WHEN duplicate_rate < 5 THEN 'Low duplicate rate - deduplication is working efficiently' END,
           CASE WHEN total_hashes > 10000 THEN 'Large hash database - consider periodic cleanup' END], lambda x: x IS NOT NULL), ' | ') AS recommendations
FROM st2""")
def agg3_dedup_report(spark, sf):
    inc, res, new = _registry_run(spark, sf)
    size = new.agg(F.count(F.lit(1)).alias("total_hashes"))
    stats = reports.registry_statistics(res, size, T)
    routed = res.join(inc.select(F.col("doc_id").alias("seq"), F.col("source").alias("job_id")), "seq")
    rep = reports.dedup_report(stats, routed)
    return rep.withColumn("recommendations", F.array_join("recommendations", " | "))


@query("agg4_per_job_dedup", _WALK_ERRORS_SQL + """
SELECT d.source AS job_id, count(*) AS files_checked, count(*) FILTER (WHERE is_duplicate) AS duplicates_found,
       count(*) FILTER (WHERE NOT is_duplicate AND action <> 'store_with_error') AS unique_files
FROM res JOIN fpe d USING (doc_id) GROUP BY d.source""")
def agg4_per_job_dedup(spark, sf):
    fps, r = _batch(spark, sf, errors=True)
    j = r.join(fps.select(F.col("doc_id").alias("seq"), F.col("source").alias("job_id")), "seq")
    return reports.per_job_dedup(j, job="job_id")

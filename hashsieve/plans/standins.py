"""Stand-ins: the reference's entities mapped onto the driver tables.

Each stand-in exists twice: a DataFrame builder (what the library runs) and a
SQL fragment (what the DuckDB oracle runs).  Both read whole tables.

| entity                       | table and mapping |
|------------------------------|-------------------|
| asset, arrival order, job    | ``documents``: text = content, doc_id = order, source = job |
| existing registry / incoming | ``documents`` with / without a row in ``labels`` (reviewed vs new) |
| pixel grid                   | ``embeddings.embedding`` as an 8x8 grid |
| uploaded file, batch         | ``pages``: name = last URL path piece, size = bytes of html, batch = page_id div 2 |
| conversion result            | ``lineitem``: original = cents of l_extendedprice, converted = original x (1 - l_discount), batch = l_orderkey, success = l_returnflag <> 'R', quality = 2 x l_quantity |
| image size                   | width = whole part of l_extendedprice, height = l_partkey |
| catalogue                    | ``lineitem`` join ``part``: id = orderkey-linenumber, type = normalised p_type, time = l_shipdate |
| product types                | base types + normalised distinct ``part.p_type`` (first part key orders them) |
| job updates                  | ``events``: job = user_id, seq = (ts, event_id), status = event_type, progress = value |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators.dedup import ACTION_UNIQUE, greedy_dedup
from ..operators.fingerprints import simhash

# Fixed stand-in parameters.
BATCH_TIME = "2024-01-01 00:00:00"          # time used in hash-based names
RETENTION_NOW = "2024-02-14 00:00:00"       # "now" of the retention run
UPLOAD_ALLOWED = ["html"]                   # accepted extension of the page uploads
UPLOAD_MAX_BYTES = 20_000                   # per-file limit of the page uploads
UPLOAD_BATCH_FILES = 12                     # pages per upload batch
CATALOGUE_TYPE = "standard"                 # type used by the catalogue filters
LOOKUP_JOB = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ documents
def doc_fingerprints(spark, sf_dir) -> DataFrame:
    """``doc_id, source, n_chars, fp, n_tokens`` for every document (FPR-8)."""
    docs = table(spark, sf_dir, "documents")
    return simhash(docs, key="doc_id", text="text", keep=["source", "n_chars"])


def parsed(fps: DataFrame) -> DataFrame:
    """``fps`` and, as further rows without a fingerprint, files that a job fails to read: for one document in 89 (by its
    length) a second file, numbered ``-1 - doc_id``.  Every document itself is there and is compared."""
    failed = fps.filter(F.col("n_chars") % 89 == 0).withColumns({"doc_id": -1 - F.col("doc_id"), "fp": F.lit(None).cast("long")})
    return fps.unionByName(failed)


def split_registry(spark, sf_dir, fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, incoming): the registry is what DED-6 registers of the labelled
    (reviewed) documents; incoming is every unlabelled document."""
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    first = greedy_dedup(fps.join(labels, "doc_id", "left_semi"), seq="doc_id", fp="fp")
    reg = first.filter(F.col("action") == ACTION_UNIQUE).select("fp", "seq")
    return reg, fps.join(labels, "doc_id", "left_anti")


SIMHASH_SQL = r"""
sh_tok AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS tok FROM documents),
sh_h AS (SELECT doc_id, ('0x' || substr(md5(tok), 1, 16))::UBIGINT AS h FROM sh_tok),
sh_n AS (SELECT doc_id, count(*) AS n FROM sh_h GROUP BY doc_id),
sh_b AS (SELECT doc_id, i, sum(((h >> i) & 1)::BIGINT) AS s FROM sh_h, range(64) r(i) GROUP BY doc_id, i),
sh_f AS (SELECT sh_b.doc_id, sum(CASE WHEN 2 * s > sh_n.n THEN (1::UBIGINT << i) ELSE 0::UBIGINT END)::UBIGINT AS fp
         FROM sh_b JOIN sh_n USING (doc_id) GROUP BY sh_b.doc_id),
fps AS MATERIALIZED (SELECT d.doc_id, d.source, d.n_chars,
               CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(sh_f.fp, 0::UBIGINT) END AS fp,
               coalesce(sh_n.n, 0) AS n_tokens
        FROM documents d LEFT JOIN sh_f USING (doc_id) LEFT JOIN sh_n USING (doc_id)),
fpe AS MATERIALIZED (SELECT doc_id, source, fp FROM fps UNION ALL SELECT -1 - doc_id, source, NULL FROM fps WHERE n_chars % 89 = 0)
"""


def hex_sql(x: str) -> str:
    return f"lower(printf('%016x', {x}))"


def dist_sql(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}))::INTEGER"


def greedy_walk_sql(rows: str, name: str, threshold: int = 5, initial: str = "[]::UBIGINT[]") -> str:
    """Oracle of DED-6: a recursive CTE that walks ``rows(doc_id, fp)`` in doc_id
    order carrying the list of registered fingerprints (the sequential rule)."""
    hit = f"len(list_filter(w.uniq, lambda u: {dist_sql('u', 'o.fp')} <= {threshold}))"
    return f"""
{name}_ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, fp FROM {rows}),
{name} AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS doc_id, NULL::UBIGINT AS fp, NULL::BOOLEAN AS dup, {initial} AS uniq
  UNION ALL
  SELECT o.rn, o.doc_id, o.fp,
         CASE WHEN o.fp IS NULL THEN false ELSE {hit} > 0 END,
         CASE WHEN o.fp IS NOT NULL AND {hit} = 0 THEN list_append(w.uniq, o.fp) ELSE w.uniq END
  FROM {name} w JOIN {name}_ord o ON o.rn = w.rn + 1
)"""


REGISTRY_SQL = f"""
lab AS MATERIALIZED (SELECT doc_id, fp FROM fpe WHERE doc_id IN (SELECT doc_id FROM labels)),
{greedy_walk_sql('lab', 'lwalk')},
reg AS MATERIALIZED (SELECT fp, doc_id AS seq FROM lwalk WHERE rn > 0 AND fp IS NOT NULL AND NOT dup),
inc AS MATERIALIZED (SELECT doc_id, source, fp FROM fpe WHERE doc_id NOT IN (SELECT doc_id FROM labels))
"""


def walk_result_sql(name: str) -> str:
    """doc_id, fp, is_duplicate, action from a walk CTE."""
    return f"""SELECT doc_id, fp, dup AS is_duplicate,
       CASE WHEN fp IS NULL THEN 'store_with_error' WHEN dup THEN 'skip_duplicate' ELSE 'store_unique' END AS action
FROM {name} WHERE rn > 0"""


# ------------------------------------------------------------------ pages
def upload_files(spark, sf_dir) -> DataFrame:
    """``batch_id, position, filename, size`` from pages."""
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "")
    return p.select(F.floor(F.col("page_id") / 2).cast("long").alias("batch_id"), F.col("page_id").alias("position"),
                    F.regexp_extract(path, r"[^/]*$", 0).alias("filename"),
                    F.octet_length("html").cast("long").alias("size"), "page_id", "url")


UPLOAD_FILES_SQL = r"""
files AS (SELECT (page_id // 2)::BIGINT AS batch_id, page_id AS position,
                 regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$', 0) AS filename,
                 strlen(html)::BIGINT AS size, page_id, url FROM pages)
"""


# Seven kinds of batches, by batch_id mod 7, so that every outcome of the admission occurs: 0 accepted, 1 a file without
# name, 2 a wrong extension, 3 a file too large, 4 a total too large, 5 a bad quality, 6 an unknown type.  Requests with
# negative batch ids have no files.  Apart from these planted faults, names and sizes are the pages' own, saved as a browser
# does: a name without extension gets .html, an empty one is index.html.
def upload_batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(files: ``batch_id, position, filename, size``; requests: ``batch_id, product_type, quality, format``) from pages."""
    f = upload_files(spark, sf_dir)
    batch = F.floor(F.col("page_id") / UPLOAD_BATCH_FILES).cast("long")
    kind, at = F.pmod(F.col("batch_id"), F.lit(7)), F.pmod(F.col("page_id"), F.lit(UPLOAD_BATCH_FILES))
    saved = (F.when(F.col("filename") == "", F.lit("index.html")).when(F.col("filename").contains("."), F.col("filename"))
             .otherwise(F.concat("filename", F.lit(".html"))))
    name = F.when((kind == 1) & (at == 5), F.lit("")).when((kind == 2) & (at == 3), F.concat(saved, F.lit(".psb"))).otherwise(saved)
    size = (F.when((kind == 3) & (at == 7), F.col("size") + UPLOAD_MAX_BYTES).when(kind == 4, F.lit(UPLOAD_MAX_BYTES)).otherwise(F.col("size"))).cast("long")
    files = f.withColumn("batch_id", batch).select("batch_id", F.col("page_id").alias("position"), name.alias("filename"), size.alias("size"))
    ids = files.select("batch_id").distinct()
    ids = ids.unionByName(ids.filter(F.col("batch_id") % 5 == 0).select((-1 - F.col("batch_id")).alias("batch_id")))
    kind = F.pmod(F.col("batch_id"), F.lit(7))
    return files, ids.select("batch_id", F.when(kind == 6, "Metal_Cards").otherwise("metal_cards").alias("product_type"),
                             F.when(kind == 5, 0).otherwise(75).alias("quality"), F.lit("jpeg").alias("format"))


UPLOAD_BATCHES_SQL = f"""{UPLOAD_FILES_SQL.strip()},
ub AS (SELECT (page_id // {UPLOAD_BATCH_FILES})::BIGINT AS batch_id, page_id, size,
              CASE WHEN filename = '' THEN 'index.html' WHEN contains(filename, '.') THEN filename ELSE filename || '.html' END AS saved FROM files),
bfiles AS (SELECT batch_id, page_id AS position,
                  CASE WHEN batch_id % 7 = 1 AND page_id % {UPLOAD_BATCH_FILES} = 5 THEN ''
                       WHEN batch_id % 7 = 2 AND page_id % {UPLOAD_BATCH_FILES} = 3 THEN saved || '.psb'
                       ELSE saved END AS filename,
                  (CASE WHEN batch_id % 7 = 3 AND page_id % {UPLOAD_BATCH_FILES} = 7 THEN size + {UPLOAD_MAX_BYTES}
                        WHEN batch_id % 7 = 4 THEN {UPLOAD_MAX_BYTES} ELSE size END)::BIGINT AS size FROM ub),
bids AS (SELECT DISTINCT batch_id FROM bfiles UNION ALL SELECT DISTINCT -1 - batch_id FROM bfiles WHERE batch_id % 5 = 0),
breq AS (SELECT batch_id, CASE WHEN (batch_id % 7 + 7) % 7 = 6 THEN 'Metal_Cards' ELSE 'metal_cards' END AS product_type,
                CASE WHEN (batch_id % 7 + 7) % 7 = 5 THEN 0 ELSE 75 END AS quality, 'jpeg' AS format FROM bids)
"""


# ------------------------------------------------------------------ lineitem
def conversions(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    orig = F.floor(F.col("l_extendedprice") * 100).cast("long")
    return li.select(F.col("l_orderkey").alias("batch_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
                     (F.col("l_returnflag") != "R").alias("success"),
                     orig.alias("original_size"),
                     F.floor(orig * (F.lit(1.0) - F.col("l_discount"))).cast("long").alias("converted_size"),
                     (F.col("l_quantity") * 2).cast("int").alias("quality"),
                     F.floor("l_extendedprice").cast("int").alias("width"),
                     F.col("l_partkey").cast("int").alias("height"))


CONVERSIONS_SQL = """
conv AS (SELECT l_orderkey AS batch_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
                l_returnflag <> 'R' AS success,
                floor(l_extendedprice * 100)::BIGINT AS original_size,
                floor(floor(l_extendedprice * 100)::BIGINT * (1.0 - l_discount))::BIGINT AS converted_size,
                (l_quantity * 2)::INTEGER AS quality,
                floor(l_extendedprice)::INTEGER AS width,
                l_partkey::INTEGER AS height
         FROM lineitem)
"""

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]


def normalize_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def catalogue(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    doc = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
            .select(doc.alias("document_id"), S.normalize_type("p_type").alias("product_type"),
                    F.concat(F.lit("https://cdn.example.invalid/"), doc).alias("image_url"),
                    S.catalogue_name(F.concat(F.lit("item_"), F.col("l_partkey").cast("string"), F.lit(".psd"))).alias("filename"),
                    F.col("l_shipdate").alias("uploaded_at"), *[c for c in li.columns if c != "l_shipdate"]))


CATALOGUE_SQL = f"""
cat AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS document_id,
               {normalize_sql('p_type')} AS product_type,
               'https://cdn.example.invalid/' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS image_url,
               'item_' || l_partkey::VARCHAR || '.jpeg' AS filename,
               l_shipdate AS uploaded_at, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus
        FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


# ------------------------------------------------------------------ part
def dynamic_types(spark, sf_dir) -> DataFrame:
    """Dynamic product types: normalised distinct p_type, ordered by first part key."""
    part = table(spark, sf_dir, "part")
    return (part.select(S.normalize_type("p_type").alias("product_type"), "p_partkey")
            .filter(F.col("product_type") != "")
            .groupBy("product_type").agg(F.min("p_partkey").alias("position")))


DYNAMIC_TYPES_SQL = f"""
dyn AS (SELECT product_type, min(p_partkey) AS position FROM
          (SELECT {normalize_sql('p_type')} AS product_type, p_partkey FROM part) WHERE product_type <> '' GROUP BY product_type),
types AS (SELECT * FROM (VALUES (0, 'metal_cards', 'base'), (1, 'nfc_cards', 'base'), (2, 'standees', 'base')) t(position, product_type, source)
          UNION ALL SELECT position + 3, product_type, 'dynamic' FROM dyn)
"""


def upload_requests(spark, sf_dir) -> DataFrame:
    """Upload form values per part (before FLT-3): some blank, some NULL, some
    not normalised, so every default and the case trap are exercised."""
    part = table(spark, sf_dir, "part")
    pt = (F.when(F.col("p_type") == "PROMO", F.lit(None).cast("string"))
          .when(F.col("p_type") == "ECONOMY", F.lit(" \t\n "))
          .when(F.col("p_type") == "LARGE", F.col("p_type"))
          .otherwise(F.lower("p_type")))
    q = F.when(F.col("p_size") > 40, F.lit(None).cast("int")).otherwise(F.col("p_size") * 3)
    fmt = F.when(F.col("p_brand").endswith("1"), F.lit("")).otherwise(F.lit("webp"))
    return part.select("p_partkey", pt.alias("product_type"), q.alias("quality"), fmt.alias("format"))


UPLOAD_REQUESTS_SQL = """
req AS (SELECT p_partkey,
               CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'ECONOMY' THEN ' ' || chr(9) || chr(10) || ' ' WHEN p_type = 'LARGE' THEN p_type ELSE lower(p_type) END AS product_type,
               CASE WHEN p_size > 40 THEN NULL ELSE p_size * 3 END AS quality,
               CASE WHEN suffix(p_brand, '1') THEN '' ELSE 'webp' END AS format
        FROM part),
filled AS (SELECT p_partkey,
                  CASE WHEN product_type IS NULL OR NOT regexp_matches(product_type, '\\S') THEN 'metal_cards' ELSE product_type END AS product_type,
                  coalesce(quality, 75) AS quality,
                  CASE WHEN format IS NULL OR trim(format) = '' THEN 'jpeg' ELSE format END AS format,
                  array_to_string(list_filter([CASE WHEN product_type IS NULL OR NOT regexp_matches(product_type, '\\S') THEN 'product_type' END,
                                               CASE WHEN quality IS NULL THEN 'quality' END,
                                               CASE WHEN format IS NULL OR trim(format) = '' THEN 'format' END], lambda x: x IS NOT NULL), ',') AS fallbacks
           FROM req)
"""


# ------------------------------------------------------------------ events
# Job counters, the event type that sets each, and its smallest value.
JOB_COUNTERS = [("total_files", "purchase", 50), ("completed_files", "click", 0), ("failed_files", "error", 0)]


def job_updates(spark, sf_dir) -> DataFrame:
    return job_updates_from(table(spark, sf_dir, "events"))


def job_updates_from(ev: DataFrame) -> DataFrame:
    """Job updates from event rows (batch or streaming frame)."""
    return ev.select(F.col("user_id").alias("job_id"), "ts", "event_id",
                     F.col("event_type").alias("status"), F.col("value").alias("progress"),
                     F.col("props").alias("message"),
                     F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
                     F.when(F.col("event_type") == "view", F.concat(F.lit("file_"), F.col("event_id").cast("string"))).alias("current_file"),
                     F.when(F.col("event_type") == "purchase", F.col("event_id") % 2 == 0).alias("is_batch"),
                     # a batch job's counters: files asked for, then files done or failed so far
                     *[F.when(F.col("event_type") == event, F.col("event_id") % 50 + least).cast("int").alias(counter)
                       for counter, event, least in JOB_COUNTERS])


JOB_UPDATES_SQL = f"""
upd AS (SELECT user_id AS job_id, ts, event_id, event_type AS status, value AS progress, props AS message,
               CASE WHEN event_type = 'error' THEN props END AS error,
               CASE WHEN event_type = 'view' THEN 'file_' || event_id::VARCHAR END AS current_file,
               CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END AS is_batch,
               {", ".join(f"CAST(CASE WHEN event_type = '{event}' THEN event_id % 50 + {least} END AS INTEGER) AS {counter}" for counter, event, least in JOB_COUNTERS)}
        FROM events),
state AS (SELECT job_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at, count(*) AS n_updates,
                 arg_max(status, (ts, event_id)) FILTER (WHERE status IS NOT NULL) AS status,
                 arg_max(progress, (ts, event_id)) FILTER (WHERE progress IS NOT NULL) AS progress,
                 arg_max(message, (ts, event_id)) FILTER (WHERE message IS NOT NULL) AS message,
                 arg_max(error, (ts, event_id)) FILTER (WHERE error IS NOT NULL) AS error,
                 arg_max(current_file, (ts, event_id)) FILTER (WHERE current_file IS NOT NULL) AS current_file,
                 {", ".join(f"arg_max({c}, (ts, event_id)) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c, _, _ in JOB_COUNTERS)},
                 coalesce(arg_max(is_batch, (ts, event_id)) FILTER (WHERE is_batch IS NOT NULL), false) AS is_batch
          FROM upd GROUP BY job_id)
"""

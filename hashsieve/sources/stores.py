"""Sources and sinks (SRC-1 .. SRC-5, SNK-1 .. SNK-5).

Tables live as Parquet under a root folder, one sub-folder per version
(``version=<n>``).  A writer always creates the next version and never touches
the one being read, so a job that dies half-way leaves the last good version in
place and a rerun of the same step rewrites the same folder.  Versions are
found by listing folder names (metadata only).
"""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hex_to_long, long_to_hex
from ..functions.strings import has_allowed_extension
from ..session import cut_lineage

# ---------------------------------------------------------------- schemas
HASH_INFO = T.StructType([
    T.StructField("phash", T.StringType()), T.StructField("ahash", T.StringType()),
    T.StructField("dhash", T.StringType()), T.StructField("whash", T.StringType()),
    T.StructField("image_size", T.ArrayType(T.IntegerType())), T.StructField("image_mode", T.StringType()),
    T.StructField("file_size", T.LongType()), T.StructField("created_at", T.StringType()),
    T.StructField("source_path", T.StringType()),
])

REGISTRY_JSON = T.StructType([
    T.StructField("hashes", T.MapType(T.StringType(), HASH_INFO)),
    T.StructField("created_at", T.StringType()), T.StructField("last_updated", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("stats", T.StructType([T.StructField("total_processed", T.LongType()),
                                         T.StructField("duplicates_found", T.LongType()),
                                         T.StructField("unique_images", T.LongType())])),
])

REGISTRY = T.StructType([
    T.StructField("phash", T.StringType()), T.StructField("ahash", T.StringType()),
    T.StructField("dhash", T.StringType()), T.StructField("whash", T.StringType()),
    T.StructField("fp", T.LongType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("image_mode", T.StringType()), T.StructField("file_size", T.LongType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("source_path", T.StringType()),
    T.StructField("seq", T.LongType()),
])

CATALOGUE = T.StructType([
    T.StructField("document_id", T.StringType()), T.StructField("product_type", T.StringType()),
    T.StructField("image_url", T.StringType()), T.StructField("filename", T.StringType()),
    T.StructField("uploaded_at", T.TimestampType()),
])

PRODUCT_TYPES_JSON = T.StructType([T.StructField("dynamic_types", T.ArrayType(T.StringType())),
                                   T.StructField("last_updated", T.DoubleType())])

_VERSION = re.compile(r"version=(\d+)$")


# ---------------------------------------------------------------- versioned folders
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        m = _VERSION.search(st.getPath().getName())
        if m and st.isDirectory() and fs.exists(st.getPath().suffix("/_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version:08d}"


def read_version(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The given (or latest complete) version; an empty frame when nothing has been written yet.

    A version that is named must exist: reading it as empty would make every item unique.
    """
    vs = versions(spark, root)
    if version is None:
        version = vs[-1] if vs else None
    elif version not in vs:
        raise FileNotFoundError(f"{root} has no version {version}")
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(version_path(root, version))


def write_version(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as ``version``; rewriting the same version replaces it (replay)."""
    path = version_path(root, version)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


# ---------------------------------------------------------------- registry
def load_registry(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """SRC-1: the registry (latest version); a missing registry is empty.

    A corrupt version fails the read instead of silently starting empty."""
    return read_version(spark, root, REGISTRY, version)


META_DIR = "_meta"  # headers of the versions; Spark's listing skips folders starting with '_'
REGISTRY_META = T.StructType([f for f in REGISTRY_JSON.fields if f.name != "hashes"])


def save_registry(registry: DataFrame, root: str, version: int, meta: dict | None = None) -> str:
    """SNK-1: a new registry version (the old one stays readable).

    ``meta`` is its header: ``created_at, last_updated, version, stats`` as in the
    interchange form, any of them absent.  It is written first, so that a version that
    counts as complete has its header.
    """
    if meta is not None:
        header = registry.sparkSession.createDataFrame([meta], REGISTRY_META)
        header.coalesce(1).write.mode("overwrite").json(version_path(f"{root.rstrip('/')}/{META_DIR}", version))
    return write_version(registry.select(*[f.name for f in REGISTRY.fields]), root, version)


def load_registry_meta(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The header of a registry version (default: the latest); empty when none was saved."""
    vs = versions(spark, root)
    version = version if version is not None else (vs[-1] if vs else None)
    path = version_path(f"{root.rstrip('/')}/{META_DIR}", version) if version is not None else None
    if path is None or not path_exists(spark, path):
        return {}
    return spark.read.schema(REGISTRY_META).json(path).first().asDict(recursive=True)


def registry_rows(fingerprints: DataFrame, created_at, seq) -> DataFrame:
    """FPR-5 -> SNK-1: registry entries from ``image_fingerprints`` rows that have a hash.

    ``created_at`` (a timestamp column or literal, never the clock) and ``seq``, the order of
    registration, are the caller's.
    """
    at = created_at if isinstance(created_at, Column) else F.lit(created_at)
    size = F.col("file_size") if "file_size" in fingerprints.columns else F.lit(None)
    made = fingerprints.filter(F.col("fp").isNotNull()).select(
        "phash", "ahash", "dhash", "whash", "fp", "width", "height", "image_mode", size.cast("long").alias("file_size"),
        at.cast("timestamp").alias("created_at"), F.col("origin").alias("source_path"),
        (seq if isinstance(seq, Column) else F.col(seq)).cast("long").alias("seq"))
    return made.select(*[f.name for f in REGISTRY.fields])


def _write_lines(parts: list[DataFrame], path: str, files: int | None = None) -> None:
    """A text document from ``part, pos, key, line`` rows in that order.

    The rows are dealt by ranges and every task writes its range, so the part files, in the order of their
    names, are the document.  ``files=1`` makes it one file, for documents that stay small.
    """
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    order = ["part", "pos", "key"]
    lines = lines.repartition(1) if files == 1 else lines.repartitionByRange(*([files] if files else []), *order)
    lines.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def _line(spark: SparkSession, part: int, line: str) -> DataFrame:
    return spark.createDataFrame([(part, 0, "", line)], "part INT, pos LONG, key STRING, line STRING")


def _json_string(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _joined(entries: DataFrame) -> DataFrame:
    """``pos, key, line`` entries with a comma before all but the first."""
    first = entries.agg(F.min(F.struct("pos", "key")).alias("f")).scalar()
    comma = F.when(F.struct("pos", "key") == first, F.lit("")).otherwise(F.lit(","))
    return entries.select(F.lit(1).alias("part"), "pos", "key", F.concat(comma, "line").alias("line"))


_STRINGS = r'"[^"]*("|$)'  # of a text without escapes
_HASHES_KEY = r'"hashes"\s*:\s*\{'
_UP_TO_ENTRIES = rf"(?s)^.*?{_HASHES_KEY}"


def _before(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` (``file, block, nth``) with the sum of ``value`` over the rows before, in the order of the document.

    Inside a block (a split of a file) it is a running sum; blocks are few, and their totals are added up before.
    """
    rows = rows.withColumn("_v", value)
    inside = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("file", "block").agg(F.sum("_v").alias("_t"))
               .select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_o")))
    rows = rows.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    rows = rows.join(offsets, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return rows.withColumn(name, F.col("_i") + F.col("_o")).drop("_v", "_i", "_o", "_f", "_b")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """``entry, in_map, ends, text``: the interchange document cut behind each entry of a map in it, read by byte ranges.

    The text source splits files at any ``}`` and reads the ranges in parallel.  Two prefix sums over these pieces
    say what each of them is: the quotes before it, whether it starts inside a string; the braces before it,
    outside strings, how deep it lies.  A ``}`` outside strings that leads back to depth 2 ends an entry (the
    document is depth 1, ``hashes`` 2).  ``in_map`` numbers the objects of the document's first level; what follows the last
    entry is a row that does not end one.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("nth"))
    raw = cut_lineage(raw)
    # only a file's last piece may lack its brace; lengths tell
    size = F.sum(F.octet_length("value")) + F.count(F.lit(1))
    last = (raw.groupBy(F.col("file").alias("_file")).agg(F.max(F.struct("block", "nth")).alias("_at"), (size > F.first("bytes")).alias("_open")))
    pieces = raw.join(last, F.col("file") == F.col("_file"))
    pieces = pieces.withColumn("braced", ~(F.col("_open") & (F.struct("block", "nth") == F.col("_at")))).drop("_file", "_at", "_open")
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    pieces = cut_lineage(_before(pieces.withColumn("quotes", quotes), F.col("quotes"), "q"))
    starts_inside, ends_inside = F.col("q") % 2 == 1, (F.col("q") + F.col("quotes")) % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(starts_inside, F.lit('"')).otherwise(F.lit("")), bare), _STRINGS, "")
    opened = F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))
    closed = (F.col("braced") & ~ends_inside).cast("int")
    pieces = _before(pieces.withColumns({"opened": opened, "closed": closed}), F.col("opened") - F.col("closed"), "deep")
    depth = F.col("deep") + F.col("opened") - F.col("closed")
    pieces = cut_lineage(pieces.withColumns({"ends": ((F.col("closed") == 1) & (depth == 2)).cast("int"), "leaves": ((F.col("closed") == 1) & (depth == 1)).cast("int")}))
    pieces = _before(_before(pieces, F.col("ends"), "entry"), F.col("leaves"), "in_map")
    text = F.concat("value", F.when(F.col("braced"), F.lit("}")).otherwise(F.lit("")))
    return (pieces.groupBy("entry").agg(F.sort_array(F.collect_list(F.struct("file", "block", "nth", text.alias("text")))).alias("t"),
                                        F.max("ends").alias("ends"), F.max("in_map").alias("in_map"))
            .select("entry", "in_map", "ends", F.array_join(F.col("t.text"), "").alias("text")))


def import_registry_meta(spark: SparkSession, path: str) -> dict:
    """SRC-2: the header of the map-shaped interchange JSON: the document without its entries."""
    found = _entries(spark, path)
    edges = found.agg(F.min("entry").alias("a"), F.max("entry").alias("z")).first()
    if edges.a is None:
        return {}
    rows = {r.entry: r for r in found.filter(F.col("entry").isin([edges.a, edges.z])).collect()}
    head, tail = rows[edges.a].text, rows[edges.z].text if not rows[edges.z].ends else ""
    if rows[edges.a].ends:  # the text before the first entry
        m = re.search(_UP_TO_ENTRIES, head)
        head = m.group(0) if m else ""
        document = head + tail
    else:
        document = tail
    schema = REGISTRY_META.simpleString()
    got = spark.createDataFrame([(document,)], "t string").select(F.from_json("t", schema).alias("m")).first()
    return got.m.asDict(recursive=True) if got.m else {}


def import_registry_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2: read the map-shaped interchange JSON into registry rows.

    The document may be one large file or several part files; it is cut into its entries in parallel
    (``_entries``).  A folder may also hold several whole documents.  The document records no registration
    order, so ``seq`` is the entry's position among the entries.
    """
    found = cut_lineage(_entries(spark, path).filter(F.col("ends") == 1))
    maps = found.filter(F.col("text").rlike(_HASHES_KEY)).select(F.col("in_map").alias("_m")).distinct()
    found = found.join(maps, F.col("in_map") == F.col("_m"), "left_semi")
    first = found.agg(F.min("entry")).scalar()
    body = F.regexp_replace(F.regexp_replace("text", _UP_TO_ENTRIES, ""), r"^[\s,]*", "")
    parsed = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), T.MapType(T.StringType(), HASH_INFO))
    e = found.select((F.col("entry") - first).alias("pos"), F.explode(parsed).alias("key", "info"))
    return e.select(
        F.coalesce(F.col("info.phash"), F.col("key")).alias("phash"), F.col("info.ahash").alias("ahash"),
        F.col("info.dhash").alias("dhash"), F.col("info.whash").alias("whash"),
        hex_to_long(F.col("key")).alias("fp"),
        F.get("info.image_size", F.lit(0)).alias("width"), F.get("info.image_size", F.lit(1)).alias("height"),
        F.col("info.image_mode").alias("image_mode"), F.col("info.file_size").alias("file_size"),
        F.try_to_timestamp(F.col("info.created_at")).alias("created_at"), F.col("info.source_path").alias("source_path"),
        F.col("pos").cast("long").alias("seq"))


def export_registry_json(registry: DataFrame, path: str) -> None:
    """SNK-2: JSON lines, one registry entry per line, written by every task."""
    registry.withColumn("hash", long_to_hex("fp")).drop("fp").write.mode("overwrite").json(path)


def export_registry_map(registry: DataFrame, path: str, meta: dict | None = None, files: int | None = None) -> None:
    """SNK-2, interchange form: one JSON document ``{"hashes": {hash: info}, ...header}``.

    Entries keep the hash they are stored under, readable or not.  ``meta`` is the header as in
    ``save_registry``.  Every task writes a range of the entries; the document is the part files in the order of
    their names (``files`` of them at most; 1 for tools that want one file).
    """
    info = F.struct(F.col("phash"), F.col("ahash"), F.col("dhash"), F.col("whash"),
                    F.array("width", "height").alias("image_size"), F.col("image_mode"), F.col("file_size"),
                    F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"), F.col("source_path"))
    key = F.coalesce("phash", long_to_hex("fp"), F.lit(""))
    entries = registry.select(F.coalesce("seq", F.lit(0)).cast("long").alias("pos"), key.alias("key"),
                              F.concat(_json_string(key), F.lit(": "), F.to_json(info)).alias("line"))
    spark = registry.sparkSession
    header = "".join(f", {json.dumps(k)}: {json.dumps(v)}" for k, v in (meta or {}).items() if v is not None)
    _write_lines([_line(spark, 0, '{"hashes": {'), _joined(entries), _line(spark, 2, "}" + header + "}")], path, files)


# ---------------------------------------------------------------- files
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # Spark's name for a null value in a path


def write_files(rows: DataFrame, path: str, name: str, content: str, order: str | None = None) -> int:
    """A file per name under ``path``, by every task; returns their number.

    The bytes of a name's rows, each ended by a newline, lie in one file ``files=<task>/<name column>=<name>``, by ``order`` (default: as the
    rows come); a null name is Spark's default partition name, ``%`` and ``/`` are percent-encoded.  Files come with many others in a task's folder: Spark's sinks name only folders by a value, and
    one folder for each file costs the listing a task and the file system several calls.  The folder must be on storage
    that pyarrow opens (local or shared files, S3, GCS, HDFS).  A file appears whole, by renaming, so a task that runs again replaces it.
    """
    spark = rows.sparkSession
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    root = fs.makeQualified(p).toString()

    def run(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        store, base = pafs.FileSystem.from_uri(root)
        folder = f"{base.rstrip('/')}/files={TaskContext.get().partitionId():05d}"
        last, out, files, part = None, None, 0, f"{folder}/_{uuid.uuid4().hex}"

        def finish():
            out.close()
            store.move(part, f"{folder}/{name}={last.replace('%', '%25').replace('/', '%2F')}")

        for batch in batches:
            for label, value in zip(batch.column(0), batch.column(1)):
                label = label.as_py()
                if out is None or label != last:
                    if out is not None:
                        finish()
                    else:
                        store.create_dir(folder)
                    last, out, files = label, store.open_output_stream(part), files + 1
                out.write((value.as_py() or b"") + b"\n")
        if out is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    nth = F.col(order) if order else F.monotonically_increasing_id()
    named = rows.select(F.coalesce(F.col(name).cast("string"), F.lit(NO_NAME)).alias("name"), F.col(content).cast("binary").alias("content"), nth.alias("nth"))
    named = named.repartition("name").sortWithinPartitions("name", "nth").select("name", "content")
    return named.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def binary_scan(spark: SparkSession, path: str, glob: str | None = None, allowed: list[str] | None = None,
                recursive: bool = True, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-3: whole files as rows ``path, modificationTime, length, content``.

    Returns (accepted, rejected); empty files and disallowed extensions are rejected with a
    reason.  Spark's file sources skip zero-byte files, so these are known only from a
    ``manifest`` (``path, length`` of every upload), where one exists.  Selecting only
    ``path``/``length`` later prunes the content column, so listings stay cheap.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    if manifest is not None:
        df = df.unionByName(manifest.filter(F.col("length") <= 0).select("path", F.col("length").cast("long").alias("length")),
                            allowMissingColumns=True)
    df = df.withColumn("filename", F.regexp_extract("path", r"[^/]*$", 0))
    reason = F.when(F.col("length") <= 0, F.lit("empty"))
    if allowed:
        reason = reason.when(~has_allowed_extension("filename", allowed), F.lit("extension"))
    df = df.withColumn("reject_reason", reason)
    return df.filter(F.col("reject_reason").isNull()).drop("reject_reason"), df.filter(F.col("reject_reason").isNotNull())


def reconcile_uploads(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC-3: every file of a listing or of the upload manifest (both ``filename, length``) with what became of it.

    ``status``: ``ok``; ``changed`` (another length than was sent); ``missing`` (sent, not there); ``empty`` (sent with no bytes,
    which Spark's file sources do not list); ``unlisted`` (there, never sent).
    """
    sent = manifest.select("filename", F.col("length").cast("long").alias("sent_length"))
    there = found.select("filename", F.col("length").cast("long").alias("found_length"))
    status = (F.when(F.coalesce("sent_length", F.lit(1)) <= 0, "empty").when(F.col("found_length").isNull(), "missing")
              .when(F.col("sent_length").isNull(), "unlisted").when(F.col("sent_length") != F.col("found_length"), "changed").otherwise("ok"))
    return sent.join(there, "filename", "full_outer").withColumn("status", status)


def image_scan(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """SRC-4: decoded raster images (Spark ``image`` source); undecodable files
    are kept with width -1 so they become error rows, not silent drops."""
    return (spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", recursive)
            .load(path))


# ---------------------------------------------------------------- catalogue
DELETED_DIR = "_deleted"  # tombstones; Spark's listing skips folders starting with '_'
CLAIMS_DIR = "_claims"  # one empty file per step that has been given out
LIVE_DIR = "_live"  # merged steps
_STEP = re.compile(r"step=(\d+)$")


def _under(root: str, folder: str) -> str:
    return f"{root.rstrip('/')}/{folder}" if folder else root.rstrip("/")


def _steps(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the steps that are completely written."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [(_STEP.search(st.getPath().getName()), st.getPath()) for st in fs.listStatus(p)]
    return sorted(int(m.group(1)) for m, path in found if m and fs.exists(path.suffix("/_SUCCESS")))


def _claimed(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, _under(root, CLAIMS_DIR))
    found = [_STEP.search(st.getPath().getName()) for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m.group(1)) for m in found if m)


def catalogue_next_step(spark: SparkSession, root: str) -> int:
    """The number after all that were given out or written: what the next claim starts at."""
    return 1 + max([0, *_claimed(spark, root), *(s for d in ("", DELETED_DIR, LIVE_DIR) for s in _steps(spark, _under(root, d)))])


def claim_step(spark: SparkSession, root: str) -> int:
    """A step number that no other writer has: its claim is a file created without overwriting.

    Creating a file that must not exist is atomic on HDFS and local file systems; the loser of a race takes the next number.
    A claim without a written step (its writer died) is a gap that readers do not see.
    """
    step = catalogue_next_step(spark, root)
    while True:
        fs, p = _fs(spark, f"{_under(root, CLAIMS_DIR)}/step={step}")
        try:
            fs.create(p, False).close()
            return step
        except Py4JJavaError:
            if not fs.exists(p):  # not a lost race
                raise
            step += 1


def catalogue_append(docs: DataFrame, root: str, step: int | None = None) -> int:
    """SNK-3: append documents, partitioned by type (type filters prune folders); returns the step.

    Without a ``step`` one is claimed, so concurrent appends never meet in a folder.  A job that may be
    replayed claims its step once, names it, and replaces what it wrote under it before.
    """
    step = claim_step(docs.sparkSession, root) if step is None else step
    docs.select(*[f.name for f in CATALOGUE.fields]).write.mode("overwrite").partitionBy("product_type").parquet(f"{_under(root, '')}/step={step}")
    return step


_STEPPED = T.StructType([*CATALOGUE.fields, T.StructField("step", T.IntegerType())])


def _read_steps(spark: SparkSession, folder: str, steps: list[int], schema) -> DataFrame | None:
    paths = [f"{folder}/step={s}" for s in steps]
    return spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else None


def _live(spark: SparkSession, root: str, up_to: int = 1 << 62) -> DataFrame:
    """Documents that are there after step ``up_to``, with the step that brought them.

    Reading starts at the latest merged part; only steps and tombstones behind it are opened.
    """
    merged = max((s for s in _steps(spark, _under(root, LIVE_DIR)) if s <= up_to), default=0)

    def behind(folder: str, schema) -> DataFrame | None:
        return _read_steps(spark, _under(root, folder), [s for s in _steps(spark, _under(root, folder)) if merged < s <= up_to], schema)

    base = spark.read.schema(_STEPPED).parquet(f"{_under(root, LIVE_DIR)}/step={merged}") if merged else None
    later, dead = behind("", _STEPPED), behind(DELETED_DIR, "document_id STRING, step INT")
    docs = base if later is None else later if base is None else base.unionByName(later)
    if docs is None:
        return spark.createDataFrame([], _STEPPED)
    if dead is not None:
        gone = dead.groupBy(F.col("document_id").alias("_id")).agg(F.max("step").alias("_step"))
        docs = docs.join(gone, (F.col("document_id") == F.col("_id")) & (F.col("step") < F.col("_step")), "left_anti")
    return docs


def catalogue_read(spark: SparkSession, root: str) -> DataFrame:
    """The live catalogue: appended documents minus the ids deleted after they were appended."""
    return _live(spark, root).select([f.name for f in CATALOGUE.fields])


def catalogue_compact(spark: SparkSession, root: str) -> int:
    """Merge steps and tombstones into one part of live documents; returns the step merged up to (0: nothing to merge).

    A step that is claimed and not yet written ends the merge, so a slow writer's documents come behind it.
    The merged steps stay, for readers that have listed them.  Reading then opens the live part and what came later.
    """
    merged = max(_steps(spark, _under(root, LIVE_DIR)), default=0)
    done = {s for d in ("", DELETED_DIR) for s in _steps(spark, _under(root, d)) if s > merged}
    waiting = min((s for s in _claimed(spark, root) if s > merged and s not in done), default=1 << 62)
    last = max((s for s in done if s < waiting), default=merged)
    if last > merged:
        _live(spark, root, last).write.mode("overwrite").partitionBy("product_type").parquet(f"{_under(root, LIVE_DIR)}/step={last}")
    return last


def catalogue_delete(spark: SparkSession, root: str, deletes: DataFrame, step: int | None = None) -> DataFrame:
    """SNK-4, persisted: report each requested id as deleted / not_found and
    append the found ones to the tombstone set.

    Deleting never rewrites the catalogue (an append-only id list, applied with
    an anti join on read), so its cost follows the delete set, not the table.
    The report is materialised before the tombstones are written, so it
    reflects the catalogue as it was.
    """
    from ..operators.catalog import delete_documents

    step = claim_step(spark, root) if step is None else step
    _, report = delete_documents(catalogue_read(spark, root), deletes)
    report = cut_lineage(report)
    (report.filter(F.col("outcome") == "deleted").select("document_id").distinct()
     .write.mode("overwrite").parquet(f"{_under(root, DELETED_DIR)}/step={step}"))
    return report


def write_routed(routed: DataFrame, path: str) -> None:
    """DED-8 sink: rows partitioned by storage outcome (``route=unique_stored`` ...)."""
    routed.write.mode("overwrite").partitionBy("route").parquet(path)


def size_mb(spark: SparkSession, path: str) -> float:
    """Bytes under ``path`` in MB, from file-system metadata (0 when missing)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0.0
    return fs.getContentSummary(p).getLength() / 1024 / 1024


def cleanup_registry(spark: SparkSession, root: str, now, max_age_days: int = 30) -> int:
    """FLT-1 on the stored registry: keep entries created on/after the cut-off
    (missing times are kept), write a new version only when something was
    removed, and return the number removed."""
    from ..operators.validation import retention

    vs = versions(spark, root)
    if not vs:
        return 0
    current = load_registry(spark, root, vs[-1])
    kept = retention(current, "created_at", now, max_age_days)
    counts = current.agg(F.count(F.lit(1)).alias("n")).withColumn("kept", kept.agg(F.count(F.lit(1))).scalar()).collect()[0]
    removed = int(counts["n"] - counts["kept"])
    if removed > 0:
        save_registry(kept, root, vs[-1] + 1)
    return removed


# ---------------------------------------------------------------- product types
def load_product_types(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: dynamic types from ``{"dynamic_types": [...], "last_updated": t}``;
    a missing file means none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "position INT, product_type STRING")
    raw = spark.read.schema(PRODUCT_TYPES_JSON).option("multiLine", True).json(path)
    return raw.select(F.posexplode("dynamic_types").alias("position", "product_type"))


def save_product_types(dynamic: DataFrame, path: str, updated_at: float) -> None:
    """SNK-5: one JSON document for the dimension, in the order of ``position``."""
    entries = dynamic.select(F.col("position").cast("long").alias("pos"), F.col("product_type").alias("key"), _json_string(F.col("product_type")).alias("line"))
    spark = dynamic.sparkSession
    tail = f'], "last_updated": {json.dumps(float(updated_at))}}}'
    _write_lines([_line(spark, 0, '{"dynamic_types": ['), _joined(entries), _line(spark, 2, tail)], path, files=1)

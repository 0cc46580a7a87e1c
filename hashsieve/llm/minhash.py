"""Near-duplicate classes by MinHash with tensored banding.

A document's set holds the distinct shingles of ``SHINGLE`` words.  Small
collections of ``WIDTH`` minhashes each are computed; the key of a table is
the pair of two collections, so ``c`` collections serve c(c-1)/2 tables: 48 minhashes
give 120 tables of 6 where plain banding would need 720.  Two documents meet in a
table when at least two of their collections agree, which at a similarity s
fails with probability (1-p)^c + c p (1-p)^(c-1), p = s^WIDTH.  ``layout`` takes the
least c that keeps this within ``MISS_TABLES`` for the similarity asked for: 16 at
0.85 (6e-6), 21 at 0.8 (7e-6).
Table keys are formed only from collections that some other set shares; the
others cannot meet anybody.

Documents with equal sets collapse to the smallest id first.  Every link is
confirmed on full sets: intersection and union of the shingles, in whole
numbers.  What is asked for is the classes, so pairs are compared only until
their classes are joined:

1. Star round.  Every member of a table's bucket is compared with one leader of
   the bucket (smallest by a hash order, so that the many buckets of one dense
   group agree on few leaders).  Links are contracted to classes.
2. Class rounds.  Of the classes that are the most frequent of one of its buckets, a member
   asks for the largest one it is not in, and is compared with all of it, in blocks.
3. Remainder.  Pairs of a bucket that still are in different classes are
   compared by signature, in blocks.  Where enough of the minhashes
   agree (``layout``: a linked pair falls short with probability ``MISS_SIGNATURE`` at most) and the table is the
   first that the two share, both rows go on to the group of the table's first collection (a row is in few
   of these, though in many tables), where they are compared as in the class rounds.  This settles
   every pair the rounds have left.

Buckets and classes of any size are dealt in blocks of ``BLOCK`` rows; a block
lists no pairs, it returns links that join its rows, fewer than it has rows.  Nothing is capped.

Defined cases: a null or wordless text has the empty set and is linked with
nothing; fewer words than a shingle make one shingle; rows that repeat a doc_id
are one document, linked as any of its texts is; a row with a null doc_id is linked
with nothing, has a null component and is kept; extra columns are ignored (and
pass through ``representatives``); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_DECISIONS, batches, drop_ids, freed, map_rows, row_blocks, ship, table, written

SHINGLE = 5
WIDTH = 3
SIMILARITY = 85  # per cent
MISS_TABLES = 1e-5  # at most, for a pair just at the similarity, to share no table
MISS_SIGNATURE = 2.5e-6  # and to agree in too few minhashes
CLASS_ROUNDS = 2
BLOCK = 256  # rows of a block
BLOCK_BYTES = 2 << 20  # and bytes of their texts
HELD_SHINGLES = 1 << 20  # shingles sorted together when sets are compared
ASKING_BYTES = 16 << 20  # shingles of the rows compared with them at a time
ROW_GROUP = 8 << 20  # of the tables of sets
MEMO_WORDS = 100_000


@lru_cache(maxsize=None)
def layout(similarity: int) -> tuple[int, int]:
    """Collections, and minhashes that must agree, for pairs at ``similarity`` per cent."""
    if not 1 <= similarity <= 100:
        raise ValueError(f"similarity of {similarity} per cent")
    s = similarity / 100
    p, c = s ** WIDTH, 2
    while (1 - p) ** c + c * p * (1 - p) ** (c - 1) > MISS_TABLES:
        c += 1
    n, agree, short = c * WIDTH, 0, (1 - s) ** (c * WIDTH)  # short: the probability of at most ``agree`` equal minhashes
    while short <= MISS_SIGNATURE and agree < n:
        agree += 1
        short += math.comb(n, agree) * s ** agree * (1 - s) ** (n - agree)
    return c, agree


COLLECTIONS, MIN_AGREE = layout(SIMILARITY)
HASHES = COLLECTIONS * WIDTH


@lru_cache(maxsize=None)
def _seeds(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20240501)
    return drawn.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), drawn.integers(0, 1 << 63, hashes, dtype=np.uint64)


_MIX = np.random.default_rng(20240501).integers(1, 1 << 63, 2 * HASHES + SHINGLE + WIDTH, dtype=np.uint64)[2 * HASHES:] * np.uint64(2) + np.uint64(1)


class Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


def shingle_set(text: bytes | None, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text."""
    found = (text or b"").lower().split()  # A-Z only; splits at exactly x20 and x09 to x0D
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))] if found else [], np.uint64)
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    mixed = np.zeros(len(found) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ hashes[k:k + len(mixed)]) * _MIX[k]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """One row of ``hashes`` 32-bit minhashes per non-empty set."""
    factors, offsets = _seeds(hashes)
    joined = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), hashes), np.uint32)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat((joined * factors[k] + offsets[k]) >> np.uint64(32), starts)
    return out


def collections_of(signature: np.ndarray) -> np.ndarray:
    parts = signature.astype(np.uint64).reshape(len(signature), -1, WIDTH)
    mixed = np.zeros(parts.shape[:2], np.uint64)
    for k in range(WIDTH):
        mixed = (mixed ^ parts[:, :, k]) * _MIX[SHINGLE + k]
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n, set_id, cols, sig`` for every row; the last three are null for the empty set."""
    hashes = layout(similarity)[0] * WIDTH
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.string()), ("cols", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(incoming: Iterator[pa.RecordBatch]):
        words = Words()
        for batch in incoming:
            ids = batch.column(0)
            for at, texts in row_blocks(batch.column(1), BLOCK, BLOCK_BYTES):
                sets = [shingle_set(t, words) for t in texts]
                full = [s for s in sets if len(s)]
                found = iter(zip(sigs := signatures(full, hashes), collections_of(sigs)) if full else ())
                rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), *next(found)) if len(s) else (0, None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                     pa.array([r[3] if r[3] is None else r[3].tolist() for r in rows], pa.list_(pa.int64())),
                     pa.array([r[2] if r[2] is None else r[2].tobytes() for r in rows], pa.binary())], schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return map_rows(base, freed(run), "doc_id long, n long, set_id string, cols array<long>, sig binary")


def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs at least twice, with ``cnt``, how often.

    The counts are written first: the join then has two plain exchanges, and a
    key that very many rows hold is split.
    """
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("cnt")).filter("cnt > 1"), "minhash-counts")
    return rows.join(counts, keys)


def buckets(reps: DataFrame) -> DataFrame:
    """``key, i, j, rep, cnt``: the buckets, with at least two sets, of the table of collections i and j."""
    cells = shared(reps.select("rep", F.posexplode("cols").alias("i", "u")), ["i", "u"])
    own = cells.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("i", "u"))).alias("s")).filter(F.size("s") > 1)
    pairs = F.expr("flatten(transform(sequence(0, size(s) - 2), a -> transform(sequence(a + 1, size(s) - 1), "
                   "b -> struct(xxhash64(s[a].i, s[b].i, s[a].u, s[b].u) AS key, s[a].i AS i, s[b].i AS j))))")
    return shared(own.select("rep", F.inline(pairs)), ["key"])


def shingles_of(docs: DataFrame, reps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rep, shingles`` (sorted 64-bit hashes as binary) of the documents named in ``reps``."""
    ids = reps.select(F.col("rep").alias("__rep")).distinct()
    if ids.limit(MAX_BROADCAST_DECISIONS + 1).count() <= MAX_BROADCAST_DECISIONS:
        ids = F.broadcast(ids)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    base = base.join(ids, F.col("__id") == F.col("__rep"), "left_semi")

    def run(incoming: Iterator[pa.RecordBatch]):
        words = Words()
        for batch in incoming:
            for at, texts in row_blocks(batch.column(1), BLOCK, BLOCK_BYTES):
                found = [shingle_set(t, words).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), pa.array(found, pa.binary())], names=["rep", "shingles"])

    ship(docs.sparkSession)
    return base.mapInArrow(freed(run), "rep long, shingles binary")


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def _dealt(row_id: str, n: str, salt: int) -> Column:
    return F.pmod(F.xxhash64(row_id, F.lit(salt)), F.col(n)).cast("int")


def _cells(incoming: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list, list]]:
    """(key, held, asking) rows of each cell from a stream sorted by the key columns and ``kind`` (0 held, 1 asking).

    A cell has about ``BLOCK`` rows of either kind, and asking rows are handed on by ``BLOCK``, or by ``ASKING_BYTES``
    in the column behind their id.
    """
    here, held, asking, size = None, [], [], 0
    for whole in incoming:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:n_keys] != here:
                    if held and asking:
                        yield here, held, asking
                    here, held, asking, size = row[:n_keys], [], [], 0
                if row[n_keys] == 0:
                    held.append(row[n_keys + 1:])
                elif held:
                    asking.append(row[n_keys + 1:])
                    size += len(row[n_keys + 2]) if isinstance(row[n_keys + 2], bytes) else 0
                    if len(asking) >= BLOCK or size >= ASKING_BYTES:
                        yield here, held, asking
                        asking, size = [], 0
    if held and asking:
        yield here, held, asking


def compare(asks: DataFrame, members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links ``a, b`` that join each ``rep`` of ``asks`` with the members of group ``d`` it is linked to, block by block."""
    sizes = (asks.groupBy("d").agg(F.count("*").alias("asked"))
             .join(members.groupBy("d").agg(F.count("*").alias("size")), "d")
             .select("d", _blocks(F.col("size")).alias("nb"), _blocks(F.col("asked")).alias("nc")))
    sizes = written(sizes, "minhash-sizes")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = members.join(sizes, "d").select("d", _dealt("rep", "nb", 1).alias("b"), whole("nc").alias("c"), F.lit(0).alias("kind"), "rep")
    asking = asks.join(sizes, "d").select("d", whole("nb").alias("b"), _dealt("rep", "nc", 2).alias("c"), F.lit(1).alias("kind"), "rep")
    rows = (held.unionByName(asking).join(sets, "rep").select("d", "b", "c", "kind", "rep", "shingles")
            .repartition("d", "b", "c").sortWithinPartitions("d", "b", "c", "kind", "rep"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        yield from batches((link for _, held, asking in _cells(incoming, 3) for link in linked(held, asking, similarity)), schema)

    return rows.mapInArrow(freed(run), "a long, b long")


def linked(held: list, asking: list, similarity: int) -> list[tuple[int, int]]:
    """(asking, held) pairs at ``similarity`` per cent or more, confirmed on the full sets: as many as join the rows so linked."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out, first = [], 0
    while first < len(held):
        last, total = first, 0
        while last < len(held) and (last == first or total + len(held[last][1]) // 8 <= HELD_SHINGLES):
            total += len(held[last][1]) // 8
            last += 1
        ids = np.array([r for r, _ in held[first:last]])
        sets = [np.frombuffer(s, np.uint64) for _, s in held[first:last]]
        size = np.array([len(s) for s in sets])
        joined, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(joined, kind="stable")
        joined, owner = joined[order], owner[order]
        for rep, shingles in asking:
            own = np.frombuffer(shingles, np.uint64)
            low, high = np.searchsorted(joined, own, "left"), np.searchsorted(joined, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            hit = (100 * common >= similarity * (len(own) + size - common)) & (common > 0) & (ids != rep)
            for other in ids[hit].tolist():
                x, y = top(rep), top(other)
                if x != y:
                    parent[x] = y
                    out.append((rep, other))
        first = last
    return out


def components(links: DataFrame) -> DataFrame:
    """``rep, label``: for each node of ``links`` the smallest node it reaches.

    Every node points to its smallest neighbour; pointers are followed once more, the edges between the
    nodes pointed to are what remains, until none does.  Only id pairs move, written between the rounds.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "minhash-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("m"))
                     .select("rep", F.least("rep", "m").alias("up")), "minhash-up")
        jump = up.select(F.col("rep").alias("__r"), F.col("up").alias("__u"))
        top = written(up.join(jump, F.col("up") == F.col("__r"), "left").select("rep", F.coalesce("__u", "up").alias("label")), "minhash-top")
        step = top.select(F.col("rep").alias("__r"), F.col("label").alias("__l"))
        if labels is None:
            labels = top
        else:
            labels = written(labels.join(step, F.col("label") == F.col("__r"), "left").select("rep", F.coalesce("__l", "label").alias("label")), "minhash-labels")
        for end in ("a", "b"):
            edges = edges.join(step, F.col(end) == F.col("__r")).drop("__r", end).withColumnRenamed("__l", end)
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "minhash-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("rep"), F.col("b").alias("label"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of their ``rep`` (itself where no link has been found)."""
    own = labels.select(F.col("rep").alias("__rep"), F.col("label").alias("__label"))
    return rows.join(own, F.col("rep") == F.col("__rep"), "left").withColumn("label", F.coalesce("__label", "rep")).drop("__rep", "__label")


def star_asks(met: DataFrame) -> DataFrame:
    """``rep, d``: each member of a bucket asks for the bucket's leader ``d``."""
    order = F.struct(F.xxhash64("rep"), "rep")
    leaders = written(met.groupBy("key").agg(F.min(order).alias("first")).select(F.col("key").alias("__key"), "first.rep"), "minhash-leaders")
    leaders = leaders.withColumnRenamed("rep", "d")
    joined = met.join(leaders, F.col("key") == F.col("__key")).filter(F.col("rep") != F.col("d"))
    return written(joined.select("rep", "d").distinct(), "minhash-asks")


def class_round_asks(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``rep, d``: members of buckets of three or more ask for the largest class ``d`` that is the most frequent of a bucket of theirs.

    One row per member at most, whatever the size of the buckets.
    """
    rows = labelled(met.filter("cnt > 2").select("key", "rep"), labels)
    top = (rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
           .agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).withColumnRenamed("label", "__l")
    top = top.select(F.col("key").alias("__key"), F.col("top.label").alias("d")).join(sizes, F.col("d") == F.col("__l"), "left")
    top = written(top.select("__key", "d", F.coalesce("size", F.lit(1)).alias("size")), "minhash-top")
    joined = rows.join(top, F.col("key") == F.col("__key")).filter(F.col("label") != F.col("d"))
    asked = joined.groupBy("rep").agg(F.max(F.struct("size", "d")).alias("most"))
    return written(asked.select("rep", F.col("most.d").alias("d")), "minhash-asks")


def members_of(met: DataFrame, labels: DataFrame, asks: DataFrame) -> DataFrame:
    """``d, rep``: the members of the classes asked for."""
    rows = labelled(met.select("rep").distinct(), labels).select(F.col("label").alias("d"), "rep")
    return rows.join(asks.select("d").distinct(), "d", "left_semi")


def remainder(met: DataFrame, labels: DataFrame, reps: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``kind, d, rep``: asking (1) and held (0) rows of the pairs that still need to be confirmed, by group ``d``.

    Buckets of two are settled by the star round.  Of the others only rows outside the bucket's most
    frequent class ask; they are compared with all rows of the bucket, block by block, first by signature.
    """
    rows = labelled(met.filter("cnt > 2").select("key", "i", "j", "rep"), labels)
    per_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = (per_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("labels"))
             .filter("labels > 1").select(F.col("key").alias("__key"), F.col("top.label").alias("top"), _blocks(F.col("n")).alias("nb"),
                                          _blocks(F.col("n") - F.col("top.n")).alias("nc")))
    mixed = written(mixed, "minhash-mixed")
    signs = reps.select(F.col("rep").alias("__rep"), "sig")
    rows = rows.join(mixed, F.col("key") == F.col("__key")).drop("__key").join(signs, F.col("rep") == F.col("__rep"))
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tail = ["rep", "label", "sig", "i", "j"]
    held = rows.select("key", _dealt("rep", "nb", 3).alias("b"), whole("nc").alias("c"), F.lit(0).alias("kind"), *tail)
    asking = (rows.filter("label <> top")
              .select("key", whole("nb").alias("b"), _dealt("rep", "nc", 4).alias("c"), F.lit(1).alias("kind"), *tail))
    cells = held.unionByName(asking).repartition("key", "b", "c").sortWithinPartitions("key", "b", "c", "kind", "rep")
    schema = pa.schema([("kind", pa.int32()), ("d", pa.int64()), ("rep", pa.int64())])
    min_agree = layout(similarity)[1]

    def by_signature(incoming: Iterator[pa.RecordBatch]):
        yield from batches((row for _, held_rows, asking_rows in _cells(incoming, 3) for row in staying(held_rows, asking_rows, min_agree)), schema)

    return written(cells.mapInArrow(freed(by_signature), "kind int, d long, rep long").distinct(), "minhash-remainder")


def staying(held: list, asking: list, min_agree: int) -> Iterator[tuple[int, int, int]]:
    """(kind, group, member) of the rows in a pair of different classes whose signatures mostly agree and whose first table
    this is; the group is the value of the table's first collection."""
    signs = np.frombuffer(b"".join(r[2] for r in held), np.uint32).reshape(len(held), -1)
    asked = np.frombuffer(b"".join(r[2] for r in asking), np.uint32).reshape(len(asking), -1)
    own, theirs = collections_of(signs), collections_of(asked)
    labels = np.array([r[1] for r in held])
    first, second = held[0][3:5]
    group, met = int(own[0, first]), np.zeros(len(held), bool)
    for row, (rep, label, *_) in enumerate(asking):
        same = own == theirs[row]
        # the first two collections that agree are those of this table
        here = (labels != label) & same[:, first] & same[:, second] & (same[:, :second].sum(axis=1) == 1)
        here &= (signs == asked[row]).sum(axis=1) >= min_agree
        if here.any():
            met |= here
            yield 1, group, rep
    for k in np.flatnonzero(met).tolist():
        yield 0, group, held[k][0]


def same_document(drawn: DataFrame, reps: DataFrame) -> DataFrame:
    """Links ``a, b`` between the sets of ids that rows with different texts repeat: such rows are one document."""
    usable = drawn.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "set_id")
    ids = (usable.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).filter("low <> high")
           .select(F.col("doc_id").alias("__id")))
    found = (usable.join(written(ids, "minhash-repeated"), F.col("doc_id") == F.col("__id"), "left_semi").distinct()
             .join(reps.select(F.col("set_id").alias("__set"), "rep"), F.col("set_id") == F.col("__set")))
    # a set's rep is the smallest id that has it, so the document's own id, where it is one, is the rep of its set alone
    return found.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(
        found.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    drawn = written(sketches(docs, id_col, text_col, similarity), "minhash-sketches", ROW_GROUP)
    reps = written(drawn.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set_id")
                   .agg(F.min("doc_id").alias("rep"), F.first("cols").alias("cols"), F.first("sig").alias("sig")), "minhash-reps")
    met = written(buckets(reps), "minhash-buckets")
    sets = written(shingles_of(docs, met, id_col, text_col), "minhash-sets", ROW_GROUP)
    asks = star_asks(met)
    links = compare(asks, asks.select("d").distinct().withColumn("rep", F.col("d")), sets, similarity)
    links = written(links.unionByName(same_document(drawn, reps)), "minhash-links")
    labels = components(links)
    for _ in range(CLASS_ROUNDS):
        asks = class_round_asks(met, labels)
        links = written(links.unionByName(compare(asks, members_of(met, labels, asks), sets, similarity)), "minhash-links")
        labels = components(links)
    left = remainder(met, labels, reps, similarity)
    found = compare(left.filter("kind = 1").select("rep", "d"), left.filter("kind = 0").select("d", "rep"), sets, similarity)
    labels = components(links.unionByName(found))
    of_set = labelled(reps.select("set_id", "rep"), labels).select(F.col("set_id").alias("__set"), F.col("label").alias("__component"))
    of_set = written(of_set, "minhash-sets-classes")
    out = drawn.select("doc_id", "n", "set_id").join(of_set, F.col("set_id") == F.col("__set"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each class, all columns unchanged."""
    found = near_duplicates(docs, id_col, text_col, similarity)
    return drop_ids(docs, found.filter("NOT kept").select(F.col("doc_id").alias(id_col)).distinct(), id_col)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n
"""


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

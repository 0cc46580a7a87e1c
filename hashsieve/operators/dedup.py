"""First-seen near-duplicate decisions (DED-5 .. DED-9).

Semantics (the sequential rule this reproduces): items are taken in ``seq``
order; an item is a *duplicate* when some already-registered item is within
the threshold, otherwise it is *unique* and is registered.  Duplicates are
never registered, so a later item that is close only to a duplicate is still
unique.  Over a whole batch this is the lexicographically-first maximal
independent set of the similarity graph, computed here in rounds:

1. Rows without a fingerprint are errors; they are neither registered nor
   compared (``store_with_error``).
2. With an existing registry: any row within the threshold of a registered
   fingerprint is a duplicate.  Only the rest goes on.
3. Equal fingerprints collapse to their first row (one partial aggregation, so a
   group of copies holding a third of the input costs one row downstream).
   Every later copy is a duplicate, whatever its representative turns out to be.
4. Near-duplicate edges ``i < j`` among representatives come from the exact
   banded join.
5. Rounds over the edge table only: a node with no earlier neighbour is unique;
   an undecided node with an earlier unique neighbour is a duplicate; one whose
   earlier neighbours are all duplicates is unique.  Every round decides at
   least the lowest undecided node, so the rounds end by themselves.  Lineage is
   cut each round with a table written in the session's checkpoint folder.

Rounds touch only nodes that have a near neighbour, so their cost follows the
number of near-duplicate pairs, not the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import DEFAULT_THRESHOLD
from ..session import cut_lineage
from .similarity import DEFAULT_HOT_BUCKET_PAIRS, KEY, KeyScheme, match_struct, similarity_join

# Near pairs per representative above which the edge rounds give way to pivot
# rounds (dense groups of distinct near-copies), and the rows the estimate looks at.
EDGE_PAIRS_PER_ROW = 100
DENSITY_SAMPLE_ROWS = 4_000

# Outcome labels of a duplicate check.
ACTION_DUPLICATE = "skip_duplicate"
ACTION_UNIQUE = "store_unique"
ACTION_ERROR = "store_with_error"
# Routing labels after storage.
ROUTE = {ACTION_UNIQUE: "unique_stored", ACTION_DUPLICATE: "duplicate_skipped", ACTION_ERROR: "error"}


_cut = cut_lineage


def _std(df: DataFrame, seq: str, fp: str) -> DataFrame:
    return df.select(F.col(seq).alias("seq"), F.col(fp).alias("fp"))


def registry_matches(items: DataFrame, registry: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                     seq: str = "seq", fp: str = "fp", hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS) -> DataFrame:
    """Matches of each distinct incoming fingerprint in a fixed registry.

    Returns ``fp, r_seq, r_fp, distance``: one row per (distinct incoming
    fingerprint, registered fingerprint within threshold).  Computed on distinct
    fingerprints so copies do not multiply the join.
    """
    fps = _cut(_std(items, seq, fp).filter(F.col("fp").isNotNull()).select("fp").distinct().withColumn("id", F.col("fp")))
    reg = _cut(_std(registry, seq, fp).filter(F.col("fp").isNotNull()))
    pairs = similarity_join(fps, reg, threshold, left_id="id", right_id="seq", hot_bucket_pairs=hot_bucket_pairs)
    return pairs.select(F.col("l_fp").alias("fp"), F.col("r_id").alias("r_seq"), "r_fp", "distance")


def check_against_registry(items: DataFrame, registry: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                           seq: str = "seq", fp: str = "fp", lists: bool = True,
                           hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS) -> DataFrame:
    """DED-5: label each incoming row against a fixed registry.

    Returns ``seq, fp, is_duplicate, action, closest, similar, n_similar``;
    ``closest``/``similar`` are structs ``(distance, seq, fp)`` of registered
    entries, nearest first, ties to the earlier-registered.  The list of a
    registry made by DED-6/DED-9 is short (its entries are pairwise more than the
    threshold apart); ``lists=False`` leaves it out and gathers nothing.
    """
    rows = _std(items, seq, fp)
    m = registry_matches(rows, registry, threshold, hot_bucket_pairs=hot_bucket_pairs)
    ms = match_struct("distance", "r_seq", "r_fp")
    wanted = [F.min(ms).alias("closest"), F.count(F.lit(1)).cast("int").alias("n_similar")]
    wanted += [F.sort_array(F.collect_list(ms)).alias("similar")] if lists else []
    # written, so that its layout by fp is forgotten: the join below then has two plain
    # exchanges, and a fingerprint held by very many rows can be split
    per_fp = _cut(m.groupBy("fp").agg(*wanted))
    out = rows.join(per_fp, "fp", "left")
    action = (F.when(F.col("fp").isNull(), F.lit(ACTION_ERROR))
              .when(F.col("closest").isNotNull(), F.lit(ACTION_DUPLICATE))
              .otherwise(F.lit(ACTION_UNIQUE)))
    return out.select("seq", "fp", F.col("closest").isNotNull().alias("is_duplicate"), action.alias("action"),
                      "closest", *(["similar"] if lists else []), F.coalesce("n_similar", F.lit(0)).alias("n_similar"))


def leader_rounds(edges: DataFrame) -> tuple[DataFrame, int]:
    """Decide every node of a DAG of near-duplicate edges ``(i, j)``, ``i < j``.

    A node without an earlier neighbour is unique, its later neighbours are
    duplicates, and a duplicate's edges say nothing any more.  Each round takes
    these edges away until none is left; nodes that lose all their earlier
    neighbours this way are unique.  So only the duplicates need to be collected:
    returns ``(duplicates, rounds)`` with one column, ``node``.
    """
    spark = edges.sparkSession
    e, rounds = _cut(edges.select("i", "j")), 0
    duplicates = spark.createDataFrame([], e.select(F.col("j").alias("node")).schema)
    while not e.isEmpty():
        rounds += 1
        later = e.select(F.col("j").alias("i")).distinct()
        unique = e.join(later, "i", "left_anti")
        found = _cut(unique.select(F.col("j").alias("node")).distinct())
        duplicates = duplicates.unionByName(found)
        rest = e.join(found.withColumnRenamed("node", "j"), "j", "left_anti")
        e = _cut(rest.join(found.withColumnRenamed("node", "i"), "i", "left_anti").select("i", "j"))
    return duplicates, rounds


def pivot_rounds(reps: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                 hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS,
                 references: int = 2, scheme: KeyScheme | None = None) -> tuple[DataFrame, int]:
    """First-seen decisions without materialising the near-duplicate graph.

    ``reps``: ``rep_seq, fp`` (distinct fingerprints).  Each round works on the
    undecided set X (nobody in X has an earlier unique neighbour):

    1. a *pivot* is a node of X with no earlier neighbour in X; it is unique;
    2. "has an earlier neighbour" is settled for most members of a dense group
       by comparing each member with the first member of each of its buckets
       (an aggregation per bucket), then, for those still open, with the first
       *open* member of the bucket (``references`` passes in all); only the
       rest are compared with the earlier members of their buckets;
    3. the later neighbours of pivots are duplicates (pivots are pairwise more
       than t apart, so a bucket holds few of them).

    The first node of X is always a pivot, so every round makes progress.  In a
    group of near-copies the work per round is linear in the group size, where
    the edge table would be quadratic.  Only ``(seq, fp)`` rows are written between
    the steps; keys are derived in the plan.  Returns ``(state, rounds)``.
    """
    t = threshold
    x = _cut(reps.select(F.col("rep_seq").alias("seq"), "fp"))
    parts, rounds = [], 0
    while n := x.count():
        rounds += 1
        scheme = scheme or KeyScheme.for_rows(t, n)
        hot = scheme.hot(scheme.tables(x), None, (n, n), hot_bucket_pairs)

        def keyed(rows: DataFrame, prefix: str) -> DataFrame:
            k = scheme.split(scheme.tables(rows), hot)
            return k.select(*KEY, F.col("seq").alias(f"{prefix}_seq"), F.col("fp").alias(f"{prefix}_fp"))

        def near(a: DataFrame, b: DataFrame, cond) -> DataFrame:
            d = F.col("a_fp").bitwiseXOR(F.col("b_fp"))
            return a.join(b, KEY).filter(cond & (F.bit_count(d) <= t) & scheme.canonical(d, hot is not None))

        still_open = x
        for _ in range(max(1, references)):
            # the earliest open member of a bucket precedes every other open member
            k = keyed(still_open, "a")
            first = k.groupBy(*KEY).agg(F.min(F.struct("a_seq", "a_fp")).alias("m"))
            settled = (k.join(first, KEY)
                       .filter((F.col("a_seq") != F.col("m.a_seq")) & (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("m.a_fp"))) <= t))
                       .select(F.col("a_seq").alias("seq")).distinct())
            still_open = _cut(still_open.join(settled, "seq", "left_anti"))
        everybody = keyed(x, "b")
        hit = near(keyed(still_open, "a"), everybody, F.col("b_seq") < F.col("a_seq")).select(F.col("a_seq").alias("seq")).distinct()
        pivots = _cut(still_open.join(hit, "seq", "left_anti"))
        dups = near(keyed(pivots, "a"), everybody, F.col("b_seq") > F.col("a_seq")).select(F.col("b_seq").alias("seq")).distinct()
        step = _cut(pivots.select("seq", F.lit(True).alias("unique")).unionByName(dups.withColumn("unique", F.lit(False))))
        parts.append(step)
        x = _cut(x.join(step.select("seq"), "seq", "left_anti"))
    state = reps.sparkSession.createDataFrame([], "seq LONG, unique BOOLEAN")
    for p in parts:
        state = state.unionByName(p)
    return state.withColumnRenamed("seq", "node"), rounds


def near_pairs_per_row(reps: DataFrame, n: int, threshold: int = DEFAULT_THRESHOLD, sample_rows: int = DENSITY_SAMPLE_ROWS) -> float:
    """Estimated near-duplicate pairs per row: near pairs, not bucket pairs, of a hash sample, scaled up.

    The estimate chooses between two plans with equal results; the sample takes no part in either.
    """
    share = min(1.0, sample_rows / max(1, n))
    picked = F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = reps.select(F.col("rep_seq").alias("id"), "fp").filter(picked) if share < 1 else reps.select(F.col("rep_seq").alias("id"), "fp")
    expected = max(1, int(n * share))
    pairs = similarity_join(sample, sample, threshold, order="lt", hot_bucket_pairs=None, rows=(expected, expected)).count()
    return pairs / expected / share


def greedy_dedup(items: DataFrame, threshold: int = DEFAULT_THRESHOLD, registry: DataFrame | None = None,
                 seq: str = "seq", fp: str = "fp", hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS,
                 stats: dict | None = None, strategy: str = "auto", written: bool = False, matched: DataFrame | None = None) -> DataFrame:
    """DED-6: first-seen dedup of a whole batch, optionally against a registry.

    ``strategy``: ``edges`` (rounds over the near-duplicate edge table),
    ``pivot`` (rounds without the edge table, for dense near-copy groups) or
    ``auto``, which picks ``pivot`` when the edge table would hold more than
    ``EDGE_PAIRS_PER_ROW`` near pairs per distinct fingerprint.

    Returns ``seq, fp, is_duplicate, action`` for every input row.
    ``registry`` rows (``seq, fp``) count as registered before every batch row; ``matched`` (``fp``), instead, names the
    fingerprints that are known to lie near a registered one.
    The narrow ``(seq, fp)`` input is written once, so fingerprinting runs
    once however many jobs follow (``written=True``: the caller has done so).
    """
    rows = _std(items, seq, fp) if written else _cut(_std(items, seq, fp))
    ok = rows.filter(F.col("fp").isNotNull())
    if registry is not None:
        matched = registry_matches(ok, registry, threshold, hot_bucket_pairs=hot_bucket_pairs).select("fp").distinct()
    if matched is not None:
        ok = ok.join(_cut(matched), "fp", "left_anti")
    reps = _cut(ok.groupBy("fp").agg(F.min("seq").alias("rep_seq")))
    n = reps.count()  # reps is a written table: an exact, cheap count
    if strategy == "auto":
        strategy = "pivot" if near_pairs_per_row(reps, n, threshold) > EDGE_PAIRS_PER_ROW else "edges"
    if strategy == "pivot":
        state, rounds = pivot_rounds(reps, threshold, hot_bucket_pairs)
        duplicates = state.filter(~F.col("unique")).select("node")
    else:
        edges = (similarity_join(reps, reps, threshold, left_id="rep_seq", right_id="rep_seq", order="lt",
                                 hot_bucket_pairs=hot_bucket_pairs, rows=(n, n))
                 .select(F.col("l_id").alias("i"), F.col("r_id").alias("j")))
        duplicates, rounds = leader_rounds(edges)
    if stats is not None:
        stats["rounds"] = rounds
        stats["strategy"] = strategy
    # the first row of each fingerprint that is unique; every other row with a fingerprint is a duplicate
    leaders = reps.join(duplicates.withColumnRenamed("node", "rep_seq"), "rep_seq", "left_anti").withColumnRenamed("fp", "_fp")
    out = rows.join(leaders, (F.col("fp") == F.col("_fp")) & (F.col("seq") == F.col("rep_seq")), "left")
    unique = F.col("rep_seq").isNotNull()
    action = (F.when(F.col("fp").isNull(), F.lit(ACTION_ERROR))
              .when(unique, F.lit(ACTION_UNIQUE))
              .otherwise(F.lit(ACTION_DUPLICATE)))
    # the labels feed several consumers (matches, reports, the next registry):
    # write them once instead of re-running the label join for each
    return _cut(out.select("seq", "fp", (F.col("fp").isNotNull() & ~unique).alias("is_duplicate"), action.alias("action")))


def duplicate_matches(result: DataFrame, threshold: int = DEFAULT_THRESHOLD, registry: DataFrame | None = None,
                      hot_bucket_pairs: int | None = DEFAULT_HOT_BUCKET_PAIRS) -> DataFrame:
    """DED-3 / DED-4 for the duplicates of a ``greedy_dedup`` result.

    A duplicate at ``seq`` is matched against what was registered when it was
    checked: the whole registry, whatever its numbering, plus batch uniques with a
    smaller ``seq``.  Returns ``seq, fp, closest, similar`` (structs ``distance, origin, seq,
    fp``; origin 0 is the registry, 1 the batch; nearest first, then the registry, then the earlier).
    """
    uniques = result.filter(F.col("action") == ACTION_UNIQUE).select(F.struct(F.lit(1).alias("origin"), "seq").alias("seq"), "fp")
    if registry is not None:
        known = registry.filter(F.col("fp").isNotNull())
        uniques = known.select(F.struct(F.lit(0).alias("origin"), "seq").alias("seq"), "fp").unionByName(uniques)
    dups = result.filter(F.col("is_duplicate")).select("seq", "fp")
    m = registry_matches(dups, uniques, threshold, hot_bucket_pairs=hot_bucket_pairs)
    ms = F.struct("distance", F.col("r_seq.origin").alias("origin"), F.col("r_seq.seq").alias("seq"), F.col("r_fp").alias("fp"))
    # one list per distinct fingerprint (bounded: registered entries are > t apart),
    # then each row keeps the entries registered before it; written so that the join can split a hot fingerprint
    per_fp = _cut(m.groupBy("fp").agg(F.sort_array(F.collect_list(ms)).alias("_all")))
    j = dups.join(per_fp, "fp")
    similar = F.filter("_all", lambda x: (x["origin"] == 0) | (x["seq"] < F.col("seq")))
    return j.select("seq", "fp", F.get(similar, F.lit(0)).alias("closest"), similar.alias("similar"))


def register_uniques(registry: DataFrame, result: DataFrame) -> DataFrame:
    """DED-9: the registry after a batch (new uniques appended, keyed by fingerprint)."""
    new = result.filter(F.col("action") == ACTION_UNIQUE).select(
        F.col("fp"), F.col("seq").alias("registered_seq"))
    return registry.unionByName(new, allowMissingColumns=True)


def route(result: DataFrame) -> DataFrame:
    """DED-8: storage outcome per row."""
    expr = F.coalesce(*[F.when(F.col("action") == k, F.lit(v)) for k, v in ROUTE.items()])
    return result.withColumn("route", expr)

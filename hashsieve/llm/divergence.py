"""Source divergence audit: how far the word use of the sources of a language lies apart.

Counting is done in numpy inside the tasks that read the texts.  A block of texts is one
array of bytes; terms are runs of letter bytes (ASCII letters, small, and all bytes from 128
on).  Terms are dealt by length: up to 8 bytes they are one big-endian uint64, up to 16 bytes two, and
these are sorted by least-significant-digit radix passes over 16-bit digits.  Longer terms lie in
separate buckets, by the power of two their length fits in, as byte strings that are sorted as
such.  The sorts are stable and the texts come group by group, so that after one sort the runs of
equal (term, group) lie together in the order of the documents: run lengths are the
occurrences, and the changes of document inside a run are the documents.

A block's counts leave as rows ``lang, source, term, occurrences, documents``; Spark sums them (with a
partial sum in each task before the shuffle) and does the rest on counts:

* terms in at least ``MIN_DOCUMENTS`` documents of a language are kept (a window per (language, term), one row a source);
* ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` in decimals, exact at any count;
* ``f = floor((p - q)^2 / (p + q))`` in longs (p is at most 10^9 + 1).

The value of a pair of sources is a sum of f over all kept terms, most of which neither may use.  With
p0 the p of a count of 0, it is V f(p0, q0), plus for the terms of the first source f(p, q0) - f(p0, q0), the same for the
second, plus for the terms of both f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).  The one-sided sums are
taken over the distinct counts of a source, of which there are few, and only the last one reads pairs of
sources per term.

Defined cases: null text, lang and source are empty strings, which are a group as any other; rows are
documents, repeated ids included; groups without terms count 0 everywhere; a language without kept terms has
pair values of 0 and no term rows; ties in value go to the smaller item in UTF-8; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, strings, table, written

MIN_DOCUMENTS = 10
TOP_TERMS = 10
BLOCK_BYTES = 8 << 20
SCALE = 1_000_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable order by several uint64 keys, the first the most significant: passes over 16-bit digits, the lowest first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit integers by radix
    return order


def runs(sorted_keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First rows of the runs of equal (keys, group), their lengths, and the documents in them."""
    n = len(group)
    new = np.zeros(n, bool)
    new[:1] = True
    for key in [*sorted_keys, group]:
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return starts, np.diff(np.append(starts, n)), np.add.reduceat(other.astype(np.int64), starts) if n else starts


def packed_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, word: int) -> np.ndarray:
    """Bytes 8 word .. 8 word + 7 of each term as a big-endian uint64, zeros behind its end.

    ``data`` has 8 bytes more than the terms reach.
    """
    at = starts + 8 * word
    left = np.clip(sizes - 8 * word, 0, 8)
    value = np.zeros(len(starts), np.uint64)
    for k in range(8):
        value = (value << np.uint64(8)) | np.where(k < left, data[np.minimum(at + k, len(data) - 1)], 0).astype(np.uint64)
    return value


def count_block(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Per bucket of lengths: group, term, occurrences and documents of the block's (group, term) pairs."""
    order = np.argsort(groups, kind="stable")
    texts, groups = [texts[i] for i in order], groups[order]
    data = np.frombuffer(b"\0".join(texts) + bytes(16), np.uint8)
    letter = _LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate([[0], edge])
    starts, sizes = edge[0::2], edge[1::2] - edge[0::2]
    data = _SMALL[data]
    ends = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(ends, starts, "right").astype(np.int32)
    for low, high, words in ((0, 8, 1), (8, 16, 2)):
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        if not len(rows):
            continue
        keys = [packed_words(data, starts[rows], sizes[rows], w) for w in range(words)]
        sort = radix_order(keys)
        keys, rows = [k[sort] for k in keys], rows[sort]
        first, counts, documents = runs(keys, groups[doc[rows]], doc[rows])
        spelled = np.stack([k[first] for k in keys], axis=1).astype(">u8").view(f"S{8 * words}").ravel().tolist()
        yield groups[doc[rows[first]]], spelled, counts, documents
    width = 32
    while width // 2 < (sizes.max() if len(sizes) else 0):
        rows = np.flatnonzero((sizes > width // 2) & (sizes <= width))
        if len(rows):
            flat = data.tobytes()
            terms = np.array([flat[a:a + n] for a, n in zip(starts[rows].tolist(), sizes[rows].tolist())], f"S{width}")
            sort = np.argsort(terms, kind="stable")
            terms, rows = terms[sort], rows[sort]
            first, counts, documents = runs([terms], groups[doc[rows]], doc[rows])
            yield groups[doc[rows[first]]], terms[first].tolist(), counts, documents
        width *= 2


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents; a group without terms has a row with a null term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        for batch in incoming:
            columns = [strings(batch.column(i)) for i in range(3)]
            texts = [t or b"" for t in columns[0]]
            names: dict[tuple[bytes, bytes], int] = {}
            groups = np.array([names.setdefault((a or b"", b or b""), len(names)) for a, b in zip(columns[1], columns[2])], np.int64)
            spelled = list(names)
            langs, sources = ([s[i] for s in spelled] for i in (0, 1))
            nothing = [None] * len(spelled)
            zeros = [0] * len(spelled)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.binary()).cast(pa.string()), pa.array(sources, pa.binary()).cast(pa.string()),
                                              pa.array(nothing, pa.string()), pa.array(zeros, pa.int64()), pa.array(zeros, pa.int64())], schema=schema)
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
                    size += len(texts[to])
                    to += 1
                for group, terms, counts, documents in count_block(texts[at:to], groups[at:to]):
                    for low in range(0, len(terms), 50_000):
                        cut = slice(low, low + 50_000)
                        pick = pa.array(group[cut])
                        yield pa.RecordBatch.from_arrays([
                            pa.array(langs, pa.binary()).cast(pa.string()).take(pick), pa.array(sources, pa.binary()).cast(pa.string()).take(pick),
                            pa.array(terms[cut], pa.binary()).cast(pa.string()), pa.array(counts[cut]), pa.array(documents[cut])], schema=schema)
                at = to

    made = map_rows(docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")),
                    run, "lang string, source string, term string, n long, d long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE (count + 2) / (total + 2 kept))``; null without kept terms."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)")))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS,
          top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` (see the module's text and the contract of op12)."""
    counts = written(term_counts(docs, text, lang, source), "terms")
    here = Window.partitionBy("lang", "term")
    kept = written(counts.filter(F.col("term").isNotNull()).withColumn("docs", F.sum("d").over(here)).withColumn("lang_n", F.sum("n").over(here))
                   .filter(F.col("docs") >= min_documents).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("v"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counts.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
                      F.coalesce("v", F.lit(0)).alias("v")))
    groups = written(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "groups")
    shares = (kept.join(groups, ["lang", "source"])
              .select("lang", "source", "term", "p0", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
                      share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")))
    shares = written(shares, "shares")

    terms = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    # sums over the terms of both sources, each pair once (a < b)
    entry = F.struct("source", "p", "p0")
    a, b = F.col("a"), F.col("b")
    both = (shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(entry)).alias("users")).filter(F.size("users") > 1)
            .select("lang", F.posexplode("users").alias("at", "a"), "users")
            .select("lang", "a", F.explode(F.slice("users", F.col("at") + 2, F.size("users"))).alias("b"))
            .groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"))
            .agg(F.sum(gap(a["p"], b["p"]) - gap(a["p"], b["p0"]) - gap(a["p0"], b["p"]) + gap(a["p0"], b["p0"])).alias("value")))
    both = both.unionByName(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    # sums over the terms of one source, by its distinct counts
    rows = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    histogram = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    one = (histogram.join(rows, "lang").filter(F.col("source") != F.col("other"))
           .groupBy("lang", "source", "other").agg(F.sum(F.col("terms") * (gap(F.col("p"), F.col("q0")) - gap(F.col("p0"), F.col("q0")))).alias("value")))
    one = one.unionByName(one.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    neither = (groups.join(rows, "lang").filter(F.col("source") != F.col("other"))
               .select("lang", "source", "other", F.when(F.col("v") > 0, F.col("v") * gap(F.col("p0"), F.col("q0"))).otherwise(F.lit(0)).alias("value")))
    pairs = (neither.unionByName(one).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
             .withColumn("rank", F.row_number().over(order)))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
total AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 2) // (total.total + 2 * v.v) AS p,
             1 + 1000000000::HUGEINT * (kept.lang_n + 2) // (v.total + 2 * v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) JOIN total USING (lang, source) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))

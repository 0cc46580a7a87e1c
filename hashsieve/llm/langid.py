"""Language identification, word first with backoff to character n-grams.

Each language has a list of its words with their frequencies and, made from the
same words, lists of character n-grams (with word boundaries) for n from
``MAX_N`` down to 1.  A word that any language knows scores, per language, the
negative logarithm of its relative frequency there, or a fixed penalty where
that language lacks it.  A word that no language knows falls back to the mean
of that over its n-grams, at the largest n of which any language knows one; a
word without even a known letter scores the penalty everywhere.  The language
of a text is the one with the smallest mean over its words, every word of the
whole text counted.

Learned from: text and non-null lang outside the held-out fold, at most about
``max_docs`` documents per language taken by a hash of the id.  Counting is a
Spark aggregation; the model keeps the ``max_words`` and ``max_grams`` most
frequent entries per language and n, so its size is fixed by these parameters
and the number of languages.

Defined cases: a text that is null, empty or without a letter is ``und`` with
score 0.0, as is every text when nothing could be learned; ties between
languages go to the alphabetically first; repeated rows get equal results; a
null doc_id is held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, held_out, map_rows, table

MAX_DOCS = 2500  # learned from, per language
MAX_WORDS = 12_000  # kept per language
MAX_GRAMS = 6_000  # kept per language and n
MAX_N = 4
PENALTY = 7.0  # in place of -log10 of a frequency of zero
MEMO = 300_000  # unseen words remembered per worker
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; empty if the text has no letter at all."""
    found = WORD.findall((text or "").lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


def grams_of(word: str, n: int) -> list[str]:
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class Model:
    def __init__(self, rows: list) -> None:
        """``rows``: (lang, n, item, count, total) with n = 0 for words."""
        self.langs = sorted({r[0] for r in rows})
        column = {lang: k for k, lang in enumerate(self.langs)}
        self.lists: list[dict[str, np.ndarray]] = [{} for _ in range(MAX_N + 1)]
        for lang, n, item, count, total in rows:
            vector = self.lists[n].get(item)
            if vector is None:
                vector = self.lists[n][item] = np.full(len(self.langs), PENALTY, np.float32)
            vector[column[lang]] = min(PENALTY, -np.log10(count / total))
        self.none = np.full(len(self.langs), PENALTY, np.float32)

    def word(self, word: str) -> np.ndarray:
        known = self.lists[0].get(word)
        if known is not None:
            return known
        for n in range(MAX_N, 0, -1):
            found = [v for g in grams_of(word, n) if (v := self.lists[n].get(g)) is not None]
            if found:
                missing = len(grams_of(word, n)) - len(found)
                return (np.sum(found, axis=0) + missing * self.none) / (len(found) + missing)
        return self.none


class Scorer(dict):
    """word -> row of a growing matrix of score vectors; unseen words are scored when first met."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.rows = np.empty((1024, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        self.rows[at] = self.model.word(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self) > MEMO:
            self.clear()
        at = list(map(self.__getitem__, words))
        mean = self.rows[at].sum(axis=0, dtype=np.float64) / len(words)
        best = int(np.argmin(mean))
        odds = np.exp(-np.log(10) * (mean - mean[best]) * min(len(words), 20))
        return self.model.langs[best], float(1.0 / odds.sum())


def _counts(sample: DataFrame) -> DataFrame:
    """``lang, n, item, count`` over the sample: words (n = 0) and their n-grams; one partial count per task."""
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("item", pa.string()), ("count", pa.int64())])

    def count_words(incoming: Iterator[pa.RecordBatch]):
        seen: dict[str, Counter] = {}
        for batch in incoming:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(words_of(text))
        yield from batches(((lang, 0, w, c) for lang, own in seen.items() for w, c in own.items()), schema)

    def count_grams(incoming: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()
        for batch in incoming:
            for lang, word, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for n in range(1, MAX_N + 1):
                    for gram in grams_of(word, n):
                        seen[lang, n, gram] += count
        yield from batches(((*key, c) for key, c in seen.items()), schema)

    out = "lang string, n int, item string, count long"
    words = (map_rows(sample.select("lang", "text"), count_words, out).groupBy("lang", "n", "item").agg(F.sum("count").alias("count")))
    grams = (words.select("lang", "item", "count").mapInArrow(count_grams, out)
             .groupBy("lang", "n", "item").agg(F.sum("count").alias("count")))
    return words.unionByName(grams)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("__docs"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = (labelled.join(F.broadcast(sizes.withColumnRenamed("lang", "__lang")), F.col("lang") == F.col("__lang"))
              .filter(share < F.lit(float(max_docs)) / F.col("__docs")).select("lang", "text"))
    per_list = Window.partitionBy("lang", "n")
    kept = (_counts(sample).withColumn("total", F.sum("count").over(per_list))
            .withColumn("__rank", F.row_number().over(per_list.orderBy(F.desc("count"), "item")))
            .filter(F.col("__rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams)))
    return Model([tuple(r) for r in kept.select("lang", "n", "item", "count", "total").collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select("doc_id", held_out().alias("held_out"), "text")

    def run(incoming: Iterator[pa.RecordBatch]):
        scorer = Scorer(shared.value)
        for batch in incoming:
            found = [scorer.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return map_rows(base, run, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))

"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of its terms, words and pairs of neighbouring words counted in
hashed buckets, and of its looks: counts of byte-class trigrams (letters by case, digits, each
common symbol, white space, ...) plus a few repetition ratios.  Term counts are logarithmic, weighted by
inverse document frequency and of unit length together; looks are scaled by their spread.  A bounded sample of
labelled texts gives the frequencies, the space (truncated SVD of the centred vectors)
and the labelled vectors; all are broadcast, their size fixed by
``max_labelled`` and ``dims``.  Every document is then projected and compared
with all labelled vectors, exact cosine products block by block, and its
``neighbours`` nearest vote with their similarity as weight.

Learned from: rows with a non-null label outside the held-out fold
(``common.held_out``), one row per text, at most about ``max_labelled`` of them,
taken by a hash of the id so that every part of the table is represented.
Inputs of a score: the text only.

Defined cases: null text is the empty text; an empty text is scored like any
other; without labelled rows every score is 0.5; with one class only, its
label; repeated rows get equal scores; a null doc_id is held out; ties between
neighbours go to the smaller position in the sample ordered by id; extra
columns are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, freed, held_out, map_rows, ship, strings, table, written

MAX_LABELLED = 4000  # labelled vectors broadcast: 4000 x 48 floats are under 1 MB
DIMS = 48
NEIGHBOURS = 24
THRESHOLD = 0.3
RATIO_WEIGHT = 5.0  # the few ratios against the many trigrams
TERM_WEIGHT = 24.0  # length of the terms' part before centring, against spreads of 1 of the looks
IDF_FLOOR = 0.1  # weight of a bucket that every labelled text fills
BLOCK = 64  # documents per cosine product
PIECE = 1 << 16  # bytes whose trigrams are counted at once

# Byte classes: letters by case, digits, white space, end marks and single symbols; other bytes by range.
CLASSES = 24
_SYMBOLS = b"!*$%&#|.,-:@"


def _class_table() -> np.ndarray:
    table_ = np.full(256, 9, np.int64)
    for low, high, k in ((0x61, 0x7A, 0), (0x41, 0x5A, 1), (0x30, 0x39, 2), (0x80, 0xFF, 3), (0x00, 0x1F, 4), (0x09, 0x0D, 6)):
        table_[low:high + 1] = k
    table_[0x20], table_[0x0A] = 5, 7
    for k, symbol in enumerate(_SYMBOLS):
        table_[symbol] = 10 + k
    return table_


CLASS_OF = _class_table()
N_TRIGRAMS = CLASSES ** 3
N_EXTRA = 8
TERMS = 2048  # buckets of words and word pairs
N_LOOKS = N_TRIGRAMS + N_EXTRA
N_FEATURES = N_LOOKS + TERMS
# Bytes of words: ASCII letters in lower case, digits, and all of other scripts; the rest separates words.
WORD_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> np.ndarray:
    """Logarithmic counts of the text's words and pairs of neighbouring words by bucket."""
    words = text.translate(WORD_BYTES).split()
    code = {w: zlib.crc32(w) for w in set(words)}
    one = np.fromiter((code[w] for w in words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(20)
    at = np.concatenate([one, two]) % np.uint64(TERMS)
    return np.log1p(np.bincount(at.astype(np.int64), minlength=TERMS))


def features(text: bytes | None) -> np.ndarray:
    """Square roots of trigram shares, repetition and length ratios, and terms, of the whole text."""
    out = np.zeros(N_FEATURES, np.float32)
    text = text or b""
    out[N_LOOKS:] = terms(text)
    if len(text) >= 3:
        counts = np.zeros(N_TRIGRAMS, np.int64)
        for at in range(0, len(text) - 2, PIECE):
            codes = CLASS_OF[np.frombuffer(text, np.uint8, min(PIECE + 2, len(text) - at), at)]
            counts += np.bincount(codes[:-2] * CLASSES ** 2 + codes[1:-1] * CLASSES + codes[2:], minlength=N_TRIGRAMS)
        out[:N_TRIGRAMS] = np.sqrt(counts / (len(text) - 2))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    extra = out[N_TRIGRAMS:N_LOOKS]
    extra[0] = len(set(words)) / n
    extra[1] = len(set(lines)) / len(lines)
    extra[2] = min(1.0, sum(map(len, words)) / n / 20)
    extra[3] = min(1.0, np.log1p(len(words)) / 12)
    extra[4] = sum(a == b for a, b in zip(words, words[1:])) / n
    extra[5] = min(1.0, len(lines) / n)
    extra[6] = float(not words)
    extra[7] = len(set(words[1::2])) / max(1, len(words) // 2)
    return out


def leading(gram: np.ndarray, dims: int, rounds: int = 12) -> np.ndarray:
    """The ``dims`` leading eigenvectors of a symmetric matrix, as columns, largest first.

    A large matrix is projected to its block Krylov space of ``rounds`` products (orthogonal throughout): beside it, this holds
    a few thin matrices, where the whole decomposition holds four more of its size.
    """
    width = 2 * dims
    if len(gram) <= width * (rounds + 1):
        return np.linalg.eigh(gram)[1][:, ::-1][:, :dims]
    space = np.empty((len(gram), width * (rounds + 1)))
    space[:, :width] = np.linalg.qr(np.random.default_rng(0).standard_normal((len(gram), width)))[0]
    for at in range(width, space.shape[1], width):
        block, known = gram @ space[:, at - width:at], space[:, :at]
        for _ in range(2):
            block -= known @ (known.T @ block)
        space[:, at:at + width] = np.linalg.qr(block)[0]
    _, found = np.linalg.eigh(space.T @ (gram @ space))
    return space @ found[:, ::-1][:, :dims]


class Space:
    """Frequencies, centre, scale and basis of the latent space with the labelled vectors in it.

    ``sample`` holds the columns of the features that are listed in ``columns``; no other occurs in it.
    """

    def __init__(self, sample: np.ndarray, columns: np.ndarray, labels: np.ndarray, dims: int) -> None:
        self.columns, self.looks = columns, int(np.searchsorted(columns, N_LOOKS))
        seen = sample[:, self.looks:] > 0
        self.idf = (np.log((1.0 + len(sample)) / (1.0 + seen.sum(axis=0))) + IDF_FLOOR).astype(np.float32)
        block = self._weighed(sample.copy())
        self.mean = block.mean(axis=0)
        self.scale = np.full(len(columns), TERM_WEIGHT, np.float32)
        self.scale[:self.looks] = 1.0 / np.sqrt(block[:, :self.looks].var(axis=0) + 1e-4)
        self.scale[:self.looks][columns[:self.looks] >= N_TRIGRAMS] *= RATIO_WEIGHT
        block -= self.mean
        block *= self.scale
        self.basis = np.ascontiguousarray(leading((block.T @ block).astype(np.float64), dims), np.float32)
        self.vectors = self._placed(block)
        self.labels = labels.astype(np.float32)

    def _weighed(self, block: np.ndarray) -> np.ndarray:
        """In place: terms weighted by inverse document frequency and scaled to unit length."""
        found = block[:, self.looks:]
        found *= self.idf
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-6)
        return block

    def _placed(self, block: np.ndarray) -> np.ndarray:
        at = block @ self.basis
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)

    def place(self, block: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows of ``block`` (all features) in the latent space."""
        return self._placed((self._weighed(block[:, self.columns]) - self.mean) * self.scale)

    def scores(self, block: np.ndarray, neighbours: int) -> np.ndarray:
        cosines = self.place(block) @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        order = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, order, axis=1), 1e-6) ** 4
        return np.clip((weight * self.labels[order]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> list:
    """At most about ``max_labelled`` distinct labelled texts as feature vectors (collected: the bound is the parameter)."""
    known = (labels.filter(F.col("quality").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max("quality").alias("__label")))
    total = known.count()
    share = min(1.0, max_labelled / max(1, total))
    picked = known.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = picked.select(F.col("doc_id").alias("__labelled"), "__label")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    ship(docs.sparkSession)
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("__labelled")).select("doc_id", "__text", "__label")

    def vectors(incoming):
        for batch in incoming:
            found = map(features, strings(batch.column(1)))  # a full vector has 64 kB: one at a time
            sparse = [pickle.dumps((at.astype(np.uint16), v[at])) for v in found for at in [np.flatnonzero(v)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), pa.array(sparse, pa.binary())], names=["doc_id", "label", "vector"])

    one = (rows.groupBy(F.xxhash64("__text")).agg(F.min(F.struct("doc_id", "__label", "__text")).alias("r"))
           .select("r.doc_id", "r.__text", "r.__label"))
    return one.mapInArrow(freed(vectors), "doc_id long, label int, vector binary").orderBy("doc_id").collect()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, dims: int = DIMS) -> Space | None:
    rows = _sample(docs, labels, max_labelled)
    if not rows:
        return None
    seen = np.zeros(N_FEATURES, bool)
    for row in rows:
        seen[pickle.loads(row.vector)[0]] = True
    columns = np.flatnonzero(seen)
    sample = np.zeros((len(rows), len(columns)), np.float32)
    for k, row in enumerate(rows):
        at, values = pickle.loads(row.vector)
        sample[k, np.searchsorted(columns, at)] = values
    return Space(sample, columns, np.array([row.label for row in rows]), dims)


def score(docs: DataFrame, space: Space | None, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    base = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text").alias("__text"))
    if space is None:
        return base.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(incoming: Iterator[pa.RecordBatch]):
        model = shared.value
        for batch in incoming:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = model.scores(np.stack([features(t) for t in strings(part.column(2))]), neighbours).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found)], names=["doc_id", "held_out", "score"])

    return (map_rows(base, freed(run), "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns unchanged.

    Rejection goes by doc_id: rows that repeat an id go if any of them is rejected; a row without an id stays.
    """
    scored = score(docs, fit(docs, labels))
    return drop_ids(docs, written(scored.filter("predicted = 0").select("doc_id").distinct(), "quality-dropped"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))

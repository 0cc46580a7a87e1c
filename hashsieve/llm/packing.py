"""Packing documents into sequences of bounded length by order-preserving dynamic programming.

The documents of a task, one after the other, are a stream of tokens.  It is cut
into windows of at most ``window`` tokens; each window is a sequence.  Cuts lie
at document ends (free), at sentence ends (``SENTENCE``), or, where neither is near,
inside a sentence (``BROKEN``): in stretches of more than window / 64 tokens without a
sentence end, and anywhere in the last window of the stream.  A sequence is padded to
``window``; at the end of the stream (where it ends in the last window) one whose length is a power
of two is left as it is.  The cuts chosen minimise

    padding + penalties of the cuts + SEQUENCE per sequence,

all in tokens.  With ``best(p)`` the least cost of the stream up to candidate p,

    best(p) = penalty(p) + SEQUENCE + min over p - window <= q < p of best(q) + window - (p - q)

which is the minimum of ``best(q) + q`` over a sliding range.  A block of candidates, all in reach of the last one decided, is
decided at once, by the suffix minima of the decided ones, up to the first candidate for which one of the block itself is as good:
about one block per window.  At the end of the stream best(p - s) for every power of two s is compared with it.  Decisions are made while the stream is read: windows up to the last
point that the best cuts of all open candidates share are final and leave; memory holds what
lies behind it.  Streams in which they share none (equal documents, one after the other) are decided
along the best cuts so far when ``OPEN_WINDOWS`` windows are open.

Tokens are those of the public tokenizer for the whole text.  It never joins what white space
separates, nor ASCII punctuation (but the apostrophe) with the letter or digit beside it.  So pieces between white space
are cut into the punctuation before, the core, and the punctuation behind; these parts are encoded once and remembered
(bounded by ``MEMO_TOKENS``).  A text is then one lookup per piece in the distinct pieces of its chunk.

Tasks are independent: a scan with enough splits is packed in place, in the order of its
files, and nothing is shuffled.  Tables with too few splits are dealt by ranges of the id
and sorted by it.  Each task pads its own last sequence.

Defined cases: null and empty texts are the end token alone; strings of special tokens inside texts are
ordinary text; a null id stays null; repeated rows are documents each; texts longer than a window
span sequences; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, ship, strings, table

WINDOW = 4096
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
SENTENCE, BROKEN, SEQUENCE = 4, 16, 8  # costs of a cut at a sentence end, of one inside a sentence, and of a sequence
DECIDE_WINDOWS = 64  # windows open before it is tried to settle them
OPEN_WINDOWS = 256  # windows open at most
MEMO_TOKENS = 4_000_000
CHUNK_BYTES = 8 << 20  # bytes of texts split into pieces at a time
_NEVER = 1 << 62  # more than any cost

_SPACE = re.compile(r"[ \t\n]")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]}]*\Z")
# Full stops of unspaced scripts followed by kana or ideographs: the tokenizer always cuts there.
_STOPS = ["。".encode(), "！".encode(), "？".encode()]
_UNSPACED = "([。！？])([\u3040-\u30ff\u4e00-\u9fff])"
# First bytes of U+0300..U+036F; capital i with dot; capital sigma.
_KEEP_CASE = [b"\xcc", b"\xcd", "\u0130".encode(), "\u03a3".encode()]
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe: it begins endings such as 's
# Small letters that every normalisation leaves as they are; what punctuation may be cut from begins and ends with one or a digit.
_SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = f"^[{_SMALL}]+$"
_CORE = f"^[0-9{_SMALL}](.*[0-9{_SMALL}])?$"


def _byte_symbols() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in printable)
    return {b: 256 + n for n, b in enumerate(rest)}


_SYMBOL_OF_BYTE = np.arange(256, dtype="<u4")
for _byte, _symbol in _byte_symbols().items():
    _SYMBOL_OF_BYTE[_byte] = _symbol
_SYMBOL_OF_BYTE[ord("\n")] = ord("\n")  # stands between words


def _symbols(words: list[str]) -> list[str]:
    """The words, none of which holds a line feed, in the byte-level alphabet."""
    joined = "\n".join(words)
    if joined.isascii():
        return words
    return _SYMBOL_OF_BYTE[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le").split("\n")


def _listed(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat``, one after the other, and the number of elements before each and at the end."""
    behind = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=behind[1:])
    kind = np.int32 if max(int(behind[-1]), len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - behind[:-1]).astype(kind), sizes)
    at += np.arange(behind[-1], dtype=kind)
    return flat[at], behind


class Encoder:
    """Token ids and sentence ends of whole texts, with a memo of the parts of pieces between white space."""

    def __init__(self, serialised: str, end_id: int = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.sizes, self.ends = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(1, bool)

    def rows_of(self, parts: list[str], plain: np.ndarray) -> np.ndarray:
        """Numbers of distinct parts in the memo; new ones are encoded.  ``plain`` words go to the merges directly."""
        rows = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        for direct in (True, False):
            at = np.flatnonzero((rows < 0) & (plain == direct))
            if not len(at):
                continue
            new, ids, sizes = [parts[i] for i in at.tolist()], [], []
            if direct:
                tokenize = self.model.tokenize
                for word in _symbols(new):
                    made = tokenize(word)
                    sizes.append(len(made))
                    ids += [t.id for t in made]
            else:
                for part in new:
                    made = self.tokenizer.encode(part, add_special_tokens=False).ids
                    sizes.append(len(made))
                    ids += made
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            self.flat[self.used:self.used + len(ids)] = ids
            sizes = np.array(sizes, np.int32)
            ends = np.zeros(len(new), bool) if direct else np.array([_SENTENCE_END.search(p) is not None for p in new], bool)
            rows[at] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.starts = np.concatenate([self.starts, (self.used + np.cumsum(sizes) - sizes).astype(np.int32)])
            self.sizes, self.ends = np.concatenate([self.sizes, sizes]), np.concatenate([self.ends, ends])
            self.used += len(ids)
        return rows

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, the number of each, and whether it ends a sentence."""
        if self.used > MEMO_TOKENS:
            self.forget()
        headless = pc.utf8_ltrim(pieces, _PUNCTUATION)
        core = pc.utf8_rtrim(headless, _PUNCTUATION)
        cut = pc.match_substring_regex(core, _CORE).to_numpy(zero_copy_only=False)
        size = [pc.binary_length(a).to_numpy(zero_copy_only=False) for a in (pieces, headless, core)]
        heads, tails = np.where(cut, size[0] - size[1], 0), np.where(cut, size[1] - size[2], 0)  # ASCII: bytes are characters
        core = pc.if_else(pa.array(cut), core, pieces).dictionary_encode()
        with_head, with_tail = np.flatnonzero(heads), np.flatnonzero(tails)
        edges = [p[:n] for p, n in zip(_listed(pieces.take(pa.array(with_head))), heads[with_head].tolist())]
        edges += [p[-n:] for p, n in zip(_listed(pieces.take(pa.array(with_tail))), tails[with_tail].tolist())]
        distinct = list(dict.fromkeys(edges))
        row_of = dict(zip(distinct, self.rows_of(distinct, np.zeros(len(distinct), bool)).tolist()))
        edges = np.array([row_of[e] for e in edges], np.int64)
        made = self.rows_of(_listed(core.dictionary), pc.match_substring_regex(core.dictionary, _PLAIN).to_numpy(zero_copy_only=False))
        rows = np.zeros((len(pieces), 3), np.int64)  # row 0 is the empty part
        rows[with_head, 0], rows[:, 1], rows[with_tail, 2] = edges[:len(with_head)], made[core.indices.to_numpy()], edges[len(with_head):]
        flat, behind = _gather(self.flat, self.starts[rows.ravel()], self.sizes[rows.ravel()])
        return flat, behind[::3], self.ends[rows[:, 1]] | self.ends[rows[:, 2]]

    def _chunk(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the numbers of ids before its sentence ends."""
        raw = b"".join(strings(texts))
        # Lower-casing first only makes the memo smaller; it is left out where the order of normalisation matters
        # (marks that compose with small letters alone) or lower case is more than one code point or depends on context.
        if not any(mark in raw for mark in _KEEP_CASE):
            texts = pc.utf8_lower(texts)
        if any(stop in raw for stop in _STOPS):
            texts = pc.replace_substring_regex(texts, _UNSPACED, replacement=r"\1 \2")
        lines = pc.split_pattern(texts, "\n")
        words = pc.ascii_split_whitespace(lines.flatten())
        coded = words.flatten().dictionary_encode()
        rows, (flat, behind, ends) = coded.indices.to_numpy(), self._pieces(coded.dictionary)
        line_at = words.offsets.to_numpy().astype(np.int64)
        line_at -= line_at[0]
        text_at = lines.offsets.to_numpy().astype(np.int64)
        text_at = line_at[text_at - text_at[0]]
        ends = ends[rows]
        ends[line_at[1:][line_at[1:] > 0] - 1] = True
        ids, behind = _gather(flat, behind[:-1][rows], np.diff(behind)[rows])
        cuts, bounds = behind[1:][ends], behind[text_at]
        cuts = cuts[np.diff(cuts, prepend=-1) > 0]
        first, last = np.searchsorted(cuts, bounds[:-1], "right"), np.searchsorted(cuts, bounds[1:], "left")
        for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            yield ids[low:high], cuts[first[i]:last[i]] - low

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text the ids of the whole of it and the end id, and the sentence ends inside, as numbers of ids before them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        total, at, end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0, np.array([self.end_id], np.int32)
        while at < len(texts):
            before = total[at - 1] if at else 0
            to = int(np.searchsorted(total, before + CHUNK_BYTES, "right"))
            if to > at:
                for ids, cuts in self._chunk(texts.slice(at, to - at)):
                    yield np.concatenate([ids, end]), cuts
                at = to
                continue
            text, parts, cuts, n, low = texts[at].as_py(), [], [], 0, 0  # a very long text: in pieces cut at white space
            while low < len(text):
                space = _SPACE.search(text, low + CHUNK_BYTES // 4)
                high = space.start() if space else len(text)
                ids, ends = next(self._chunk(pa.array([text[low:high]], pa.large_string())))
                parts.append(ids)
                cuts.append(ends + n)
                n, low = n + len(ids), high
            yield np.concatenate([*parts, end]), np.concatenate(cuts)
            at += 1


class Packer:
    """Cuts a stream of documents, as it comes, into windows of least cost (see the module's text)."""

    def __init__(self, window: int = WINDOW, sentence: int = SENTENCE, broken: int = BROKEN, sequence: int = SEQUENCE,
                 decide_windows: int = DECIDE_WINDOWS, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.sentence, self.broken, self.sequence = window, sentence, broken, sequence
        self.gap, self.step = max(1, window // 64), max(1, window // 256)
        self.decide, self.most = decide_windows * window, open_windows * window
        self.ask = self.decide  # position at which it is next tried to settle windows
        self.end = 0
        self.documents: deque = deque()  # key, first token, ids
        self.edges: list[np.ndarray] = []  # of documents whose candidates are still to be made: sentence ends, the document's end
        self.waiting = np.empty(0, np.int64), np.empty(0, np.int64)  # candidates not yet decided, their penalties
        # the candidates decided: state 0 is where everything before has left; value is the least cost plus the position
        self.pos, self.value, self.parent = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1, np.int64)

    def add(self, key, ids: np.ndarray, ends: np.ndarray) -> Iterator[list[tuple]]:
        """Take a document; give the sequences that are final."""
        begin, self.end = self.end, self.end + len(ids)
        self.documents.append((key, begin, ids))
        self.edges.append(np.append(ends, len(ids)) + begin)
        if self.end - self.window >= self.ask:
            self._advance(self.end - self.window)
            if self.pos[-1] >= self.ask:
                yield from self._settle()
                self.ask = int(self.pos[-1]) + self.decide

    def finish(self) -> Iterator[list[tuple]]:
        if not self.end:
            return
        self._advance(self.end - self.window)
        self._last()
        yield from self._leave(len(self.pos) - 1)

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and penalties of the candidates behind those decided."""
        if self.edges:
            high = np.concatenate(self.edges)
            low = np.concatenate([[self.documents[-len(self.edges)][1]], high[:-1]])
            inner = np.where(high - low > self.gap, (high - low - 1) // self.step, 0)
            last = np.cumsum(inner + 1) - 1  # where each stretch's own end stands
            pos = np.repeat(low + self.step * (1 - last + inner), inner + 1) + self.step * np.arange(last[-1] + 1)
            penalty = np.full(len(pos), self.broken, np.int64)
            pos[last], penalty[last] = high, self.sentence
            penalty[last[np.cumsum([len(e) for e in self.edges]) - 1]] = 0
            self.edges = []
            self.waiting = np.concatenate([self.waiting[0], pos]), np.concatenate([self.waiting[1], penalty])
        return self.waiting

    def _advance(self, to: int) -> None:
        """Decide the candidates up to a position."""
        pos, penalty = self._candidates()
        taken = int(np.searchsorted(pos, to, "right"))
        self.waiting = pos[taken:], penalty[taken:]
        penalty, at, window = penalty[:taken] + self.sequence + self.window, len(self.pos), self.window
        pos, done = np.concatenate([self.pos, pos[:taken]]), at
        value = np.concatenate([self.value, np.empty(taken, np.int64)])
        parent = np.concatenate([self.parent, np.empty(taken, np.int64)])
        while at < len(pos):
            high = int(np.searchsorted(pos, pos[at - 1] + window, "right"))  # all these reach the last state
            first = int(np.searchsorted(pos, pos[at] - window))
            behind = value[first:at][::-1]  # from the last state backwards; of equal ones the last is taken
            least = np.minimum.accumulate(behind)
            where = np.zeros(len(least), np.int64)
            where[1:] = np.maximum.accumulate(np.where(least[1:] < least[:-1], np.arange(1, len(least)), 0))
            reach = at - 1 - np.searchsorted(pos[:at], pos[at:high] - window)
            best = least[reach]
            made = best + penalty[at - done:high - done]
            rival = np.minimum.accumulate(made[:-1]) <= best[1:]  # a state of the block itself is as good
            n = int(rival.argmax()) + 1 if rival.any() else len(made)
            value[at:at + n], parent[at:at + n] = made[:n], at - 1 - where[reach[:n]]
            at += n
        self.pos, self.value, self.parent = pos, value, parent

    def _last(self) -> None:
        """Decide every position of the last window, where sequences whose length is a power of two need no padding."""
        window, n = self.window, len(self.pos)
        begin = max(int(self.pos[-1]) + 1, self.end - window + 1)
        penalties = np.full(self.end + 1 - begin, self.broken, np.int64)
        penalties[self.waiting[0] - begin] = self.waiting[1]
        powers = [1 << i for i in range(window.bit_length()) if 1 << i < window]
        first = int(np.searchsorted(self.pos, begin - window))
        value = dict(zip(self.pos[first:].tolist(), self.value[first:].tolist()))  # by position
        parents, queue = [], deque()
        for p, v in value.items():
            while queue and value[queue[-1]] >= v:
                queue.pop()
            queue.append(p)
        for p, penalty in enumerate(penalties.tolist(), begin):
            while queue[0] < p - window:
                queue.popleft()
            came = queue[0]
            best = value[came] + window
            for s in powers:
                v = value.get(p - s)
                if v is not None and v + s < best:
                    best, came = v + s, p - s
            best += penalty + self.sequence
            while queue and value[queue[-1]] >= best:
                queue.pop()
            queue.append(p)
            value[p] = best
            parents.append(came)
        self.pos = np.concatenate([self.pos, np.arange(begin, self.end + 1)])
        self.value = np.concatenate([self.value, np.array([value[p] for p in range(begin, self.end + 1)], np.int64)])
        self.parent = np.concatenate([self.parent, np.searchsorted(self.pos, np.array(parents, np.int64))])
        self.waiting = self.waiting[0][:0], self.waiting[1][:0]

    def _settle(self) -> Iterator[list[tuple]]:
        pos, parent = self.pos, self.parent
        shared = np.arange(np.searchsorted(pos, pos[-1] - self.window, "right"), len(pos))
        while len(shared) > 1:
            shared = np.unique(np.append(parent[shared[1:]], shared[0]))
        point = int(shared[0])
        if point == 0:
            if pos[-1] - pos[0] < self.most:
                return
            point = len(pos) - 1
            while pos[point] - pos[0] > self.most // 2:
                point = int(parent[point])
        yield from self._leave(point)

    def _leave(self, point: int) -> Iterator[list[tuple]]:
        """Give the windows up to state ``point``; only what descends from it goes on."""
        cuts, i = [], point
        while i > 0:
            cuts.append(int(self.pos[i]))
            i = int(self.parent[i])
        low = int(self.pos[0])
        for high in reversed(cuts):
            yield self._pieces(low, high)
            low = high
        self.pos, self.value = self.pos[point:].copy(), self.value[point:].copy()
        self.parent = np.maximum(self.parent[point:] - point, -1)
        self.parent[0] = -1
        first = int(np.searchsorted(self.pos, self.pos[-1] - self.window, "right"))  # only these are reached from now on
        root = np.arange(first, len(self.pos))
        while (root > 0).any():
            root = np.where(root > 0, self.parent[root], root)
        self.value[first:][root < 0] = _NEVER

    def _pieces(self, low: int, high: int) -> list[tuple]:
        """``key, start, ids, document's tokens, offset`` of the documents between two positions."""
        found, offset = [], 0
        while low < high:
            key, begin, ids = self.documents[0]
            cut = ids[low - begin:high - begin]
            found.append((key, low - begin, cut, len(ids), offset))
            low, offset = low + len(cut), offset + len(cut)
            if low == begin + len(ids):
                self.documents.popleft()
        return found


def padded(length: int, window: int = WINDOW) -> int:
    """The length of a sequence with its padding."""
    return length if length & (length - 1) == 0 else window


_ENCODERS: dict[int, Encoder] = {}
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


def packed(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence; ``ids`` are little-endian unsigned 32-bit integers.

    ``docs`` is a table: its rows come in a fixed order.  ``sequence_id`` is the task's number
    times 2^32 plus the sequence's number in the task.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(vocabulary, encoding="utf-8") as f:
        serialised = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < wanted:
        rows = (rows.withColumn("nth", F.monotonically_increasing_id())  # spreads rows that share an id
                .repartitionByRange(wanted, "doc_id", "nth").sortWithinPartitions("doc_id", "nth").drop("nth"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("padded_tokens", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        if end_id not in _ENCODERS:
            _ENCODERS[end_id] = Encoder(serialised.value, end_id)
        encoder, packer = _ENCODERS[end_id], Packer(window)

        def sequences():
            for batch in incoming:
                for key, (ids, ends) in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                    yield from packer.add(key, ids, ends)
            yield from packer.finish()

        def pieces():
            task = TaskContext.get().partitionId() << 32
            for number, sequence in enumerate(sequences()):
                total = sum(len(ids) for _, _, ids, _, _ in sequence)
                for key, start, ids, tokens, offset in sequence:
                    yield (key, start, len(ids), ids.astype("<u4").tobytes(), tokens, task + number, offset, total, padded(total, window))

        yield from batches(pieces(), schema, weigh=lambda r: len(r[3]) + 64)

    return rows.mapInArrow(run, PIECE)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                       "sequence_tokens", "padded_tokens")

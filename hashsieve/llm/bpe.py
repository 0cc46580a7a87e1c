"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

Encoding.  A token sequence is the encoding of its bytes exactly when every
adjacent pair of tokens is the encoding of that pair's bytes.  That makes the
encoder a finite-state transducer: a state of the nondeterministic machine is
"token ``prev`` is complete, and the bytes since then lead to this node of the
token trie"; a token may be completed when it is compatible with ``prev``.  At
each byte exactly one completed token is compatible, so the paths that are
alive differ in their pending tokens only.  The determinised machine keeps the
alive paths with those pending tokens, emits what all of them share, and so
waits at most for the longest token.  Its states and transitions are built when
a text first needs them (``State.__missing__``) and dropped together when there
are too many, as lazy automata do.

Decoding.  Token ids drive an incremental UTF-8 state machine whose state is
the unfinished character (continuation bytes still due and the allowed range of
the next one).  Transitions of whole tokens are composed from the byte machine
when first needed.  Text is released up to the last finished character.

Defined cases: null text encodes as the empty text (no tokens); malformed bytes
decode to U+FFFD; rows are independent, so repeated rows, ties and extra columns
need no rule and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, freed, kept, map_rows, table

MAX_STATES = 400_000  # lazily built states kept per worker before they are dropped together
MAX_LOOKS = 24  # tokens tried before a path counts as alive
VOCABULARY = "byte_bpe_50k.tiktoken"
ROWS = 256  # rows of a batch that are Python objects at a time


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a ``.tiktoken`` file."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


def packed(paths: Iterable[tuple]) -> bytes:
    """Alive paths as 32-bit integers: each the number of its pending tokens, ``prev``, node and these tokens."""
    flat = array("i")
    for prev, node, pending in paths:
        flat.extend((len(pending), prev, node, *pending))
    return flat.tobytes()


def unpacked(data: bytes) -> list[tuple]:
    flat, at, paths = array("i", data).tolist(), 0, []
    while at < len(flat):
        end = at + 3 + flat[at]
        paths.append((flat[at + 1], flat[at + 2], tuple(flat[at + 3:end])))
        at = end
    return paths


class State(dict):
    """A state of the determinised transducer: byte -> (next state, tokens emitted).

    The paths are needed for new transitions only and kept packed.
    """

    __slots__ = ("machine", "paths", "final")

    def __init__(self, machine: "Transducer", paths: bytes, final: tuple) -> None:
        self.machine, self.paths, self.final = machine, paths, final

    def __missing__(self, byte: int) -> tuple:
        self[byte] = made = self.machine.step(unpacked(self.paths), byte)
        return made


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                child = self.trie[node].get(byte)
                if child is None:
                    child = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = child
            self.token_at[node] = rank
        self.compatible: dict[int, bool] = {}
        self.live: dict[int, bool] = {}
        self.parts = self._last_merges()
        self.reset()

    def reset(self) -> None:
        self.states: dict[bytes, State] = {}
        self.runs: dict[tuple, tuple] = {}  # one object for equal runs of tokens
        self.start = self.state([(-1, 0, ())])

    def run(self, tokens: tuple) -> tuple:
        return self.runs.setdefault(tokens, tokens)

    def state(self, paths: list[tuple]) -> State:
        key = packed(paths)
        found = self.states.get(key)
        if found is None:
            final = next((pending for _, node, pending in paths if node == 0), ())
            found = self.states[key] = State(self, key, self.run(final))
        return found

    def fits(self, prev: int, token: int) -> bool:
        """Whether the bytes of ``prev`` and ``token`` together encode as just these two tokens.

        Merging keeps them apart unless, on the way, some part at the end of
        ``prev`` merges with some part at the start of ``token``.  Both tokens
        are unmade merge by merge, the later merge first, and at each stage the
        two parts that touch must not form a token that would have come first.
        """
        if prev < 0:
            return True
        pair = prev << 32 | token
        known = self.compatible.get(pair)
        if known is None:
            if len(self.compatible) > MAX_STATES // 4:
                self.compatible.clear()
            known = self.compatible[pair] = self._apart(prev, token)
        return known

    def _apart(self, left: int, right: int) -> bool:
        ranks, data, parts = self.ranks, self.bytes, self.parts
        undone = 1 << 60  # the merge undone last; what touches now existed until then
        ties_first = False  # whether a merge of the same rank further left comes first
        while True:
            joined = ranks.get(data[left] + data[right])
            if joined is not None and (joined < undone or (joined == undone and ties_first)):
                return False
            last_left, last_right = parts[left] is not None, parts[right] is not None
            if not last_left and not last_right:
                return True
            # single bytes are never unmade; of two merges the one of higher rank (at equal ranks the right one) came later
            if last_left and (not last_right or left > right):
                undone, ties_first, left = left, False, parts[left][1]
            else:
                undone, ties_first, right = right, True, parts[right][0]

    def _last_merges(self) -> dict[int, tuple[int, int] | None]:
        """For each token the two tokens of its last merge; None for single bytes."""
        made: dict[int, tuple[int, int] | None] = {}
        for token, rank in self.ranks.items():
            pieces = [token[i:i + 1] for i in range(len(token))]
            while len(pieces) > 2:
                best, at = min((self.ranks.get(pieces[i] + pieces[i + 1], 1 << 40), i) for i in range(len(pieces) - 1))
                if best == 1 << 40:
                    raise ValueError(f"token {rank} is not made of merges of other tokens")
                pieces[at:at + 2] = [pieces[at] + pieces[at + 1]]
            made[rank] = None if len(pieces) < 2 else (self.ranks[pieces[0]], self.ranks[pieces[1]])
        return made

    def leads(self, prev: int, node: int) -> bool:
        """Whether some token that goes on from ``node`` can follow ``prev``; paths that lead nowhere are dropped.

        Only the first tokens are looked at: a path kept in vain costs a state, never a wrong token.
        """
        pair = prev + 1 << 32 | node  # prev is -1 at the start
        known = self.live.get(pair)
        if known is None:
            stack, known, looks = list(self.trie[node].values()), False, 0
            while stack and not known:
                child = stack.pop()
                if self.token_at[child] >= 0:
                    looks += 1
                    known = looks > MAX_LOOKS or self.fits(prev, self.token_at[child])
                stack.extend(self.trie[child].values())
            if len(self.live) > MAX_STATES // 4:
                self.live.clear()
            self.live[pair] = known
        return known

    def step(self, paths: list[tuple], byte: int) -> tuple:
        alive, done = [], None
        for prev, node, pending in paths:
            child = self.trie[node].get(byte)
            if child is None:
                continue
            token = self.token_at[child]
            if token >= 0 and done is None and self.fits(prev, token):
                done = (token, 0, (*pending, token))
            if self.trie[child] and self.leads(prev, child):
                alive.append((prev, child, pending))
        if done is None:
            raise ValueError(f"byte {byte} is in no token of the vocabulary")
        alive.append(done)
        shared = 0
        first = alive[0][2]
        while all(len(p[2]) > shared and p[2][shared] == first[shared] for p in alive) and shared < len(first):
            shared += 1
        emitted = first[:shared]
        return self.state([(prev, node, pending[shared:]) for prev, node, pending in alive]), self.run(emitted)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        start = self.start
        for piece in self.pieces(text):
            at = start
            for byte in piece.encode():
                at, emitted = at[byte]
                if emitted:
                    out += emitted
            out += at.final
            if len(self.states) > MAX_STATES:
                self.reset()
                start = self.start
        return out


# The well-formed UTF-8 byte sequences of the Unicode standard (table 3-7),
# as first byte range -> range of the second byte and number of continuation bytes.
UTF8_LEADS = (
    (0x00, 0x7F, None, None, 0), (0xC2, 0xDF, 0x80, 0xBF, 1), (0xE0, 0xE0, 0xA0, 0xBF, 2), (0xE1, 0xEC, 0x80, 0xBF, 2),
    (0xED, 0xED, 0x80, 0x9F, 2), (0xEE, 0xEF, 0x80, 0xBF, 2), (0xF0, 0xF0, 0x90, 0xBF, 3), (0xF1, 0xF3, 0x80, 0xBF, 3),
    (0xF4, 0xF4, 0x80, 0x8F, 3),
)
READY = (0, 0, 0)  # (continuation bytes due, lowest and highest next byte)


def utf8_step(state: tuple, byte: int) -> tuple | None:
    """The next state, or None where ``byte`` cannot follow."""
    due, low, high = state
    if due:
        return ((due - 1, 0x80, 0xBF) if due > 1 else READY) if low <= byte <= high else None
    for first, last, lo, hi, n in UTF8_LEADS:
        if first <= byte <= last:
            return (n, lo, hi) if n else READY
    return None


class Utf8State(dict):
    """token -> (next state, bytes of the token that stay unfinished), or None if it breaks the text."""

    __slots__ = ("decoder", "at")

    def __init__(self, decoder: "Decoder", at: tuple) -> None:
        self.decoder, self.at = decoder, at

    def __missing__(self, token: int):
        at, held = self.at, 0
        for byte in self.decoder.bytes[token]:
            at = utf8_step(at, byte)
            if at is None:
                break
            held = held + 1 if at[0] else 0
        self[token] = made = None if at is None else (self.decoder.state(at), held)
        return made


class Decoder:
    def __init__(self, token_bytes: dict[int, bytes]) -> None:
        self.bytes = token_bytes
        self.states: dict[tuple, Utf8State] = {}
        self.ready = self.state(READY)

    def state(self, at: tuple) -> Utf8State:
        return self.states.setdefault(at, Utf8State(self, at))

    def stream(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """Text of each chunk of ids, up to its last finished character; the rest waits for more."""
        kept = b""
        for ids in chunks:
            data = kept + b"".join(map(self.bytes.__getitem__, ids))
            state = self._replay(kept)
            clean = state is not None
            if clean:
                for token in ids:
                    move = state[token]
                    if move is None:
                        clean = False
                        break
                    state = move[0]
            if clean and not state.at[0]:
                kept = b""
                yield data.decode("utf-8")
            else:
                cut = len(data) - self._unfinished(data)
                kept = data[cut:]
                yield data[:cut].decode("utf-8", "replace")
        if kept:
            yield kept.decode("utf-8", "replace")

    def _replay(self, data: bytes) -> Utf8State | None:
        at = READY
        for byte in data:
            at = utf8_step(at, byte)
            if at is None:
                return None
        return self.state(at)

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of a proper beginning of a character at the end of ``data``."""
        for n in range(1, min(3, len(data)) + 1):
            at = READY
            for byte in data[-n:]:
                at = utf8_step(at, byte) if at is not None else None
            if at is not None and at[0] and utf8_step(READY, data[-n]) not in (None, READY):
                return n
        return 0

    def decode(self, ids: list[int], chunk: int = 65_536) -> str:
        return "".join(self.stream(ids[i:i + chunk] for i in range(0, len(ids), chunk)))


def compiled(vocabulary: bytes, pattern: str) -> tuple[Transducer, Decoder, dict[int, str]]:
    """Built once per worker process and vocabulary, and kept until the worker turns to another operator."""

    def build() -> tuple[Transducer, Decoder, dict[int, str]]:
        machine = Transducer(read_ranks(vocabulary), pattern)
        return machine, Decoder(machine.bytes), {i: str(i) for i in machine.bytes}

    return kept("bpe " + hashlib.sha256(vocabulary + pattern.encode()).hexdigest(), build)


def rows_of(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The first two columns row by row; only ``ROWS`` rows are Python objects at a time."""
    for batch in incoming:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file (about 1 MB whatever the corpus) read once on the driver and sent to the workers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``token_ids`` (array<int>) of every whole text."""
    data = shared_vocabulary(docs.sparkSession, path)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))

    def run(incoming):
        machine = compiled(data.value, pattern)[0]
        schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32()))])
        rows = ((i, machine.encode(t) if t else []) for i, t in rows_of(incoming))
        yield from batches(rows, schema, weigh=lambda r: 4 * len(r[1]))

    return map_rows(base, freed(run, keeps=True), "doc_id long, token_ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, token_ids``; a null list is the empty text."""
    data = shared_vocabulary(encoded.sparkSession, path)

    def run(incoming):
        decoder = compiled(data.value, pattern)[1]
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
        rows = ((i, decoder.decode(t or [])) for i, t in rows_of(incoming))
        yield from batches(rows, schema, weigh=lambda r: len(r[1]))

    return encoded.select("doc_id", "token_ids").mapInArrow(freed(run, keeps=True), "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and report ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Both steps run in one pass, so that ids of all texts are not written out just to be hashed.
    """
    data = shared_vocabulary(docs.sparkSession, path)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))

    def run(incoming):
        machine, decoder, names = compiled(data.value, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

        def digests(doc_id, text):
            ids = machine.encode(text) if text else []
            spelled = " ".join(map(names.__getitem__, ids)).encode()
            return doc_id, len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(decoder.decode(ids).encode()).hexdigest()

        yield from batches((digests(i, t) for i, t in rows_of(incoming)), schema)

    return map_rows(base, freed(run, keeps=True), DIGESTS)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, turn by turn:

    <|im_start|>role<|im_sep|>text<|im_end|>

Control strings inside roles and texts are escaped reversibly: one backslash
goes behind their first character, and behind the backslashes that may already
stand there.  The rendered string is encoded once, with offsets; the marks are
special tokens of the encoder, so no token crosses the border of a turn.  The
assistant texts are sorted character spans, tokens are sorted character spans,
and binary search finds for each turn the tokens inside it: these are the
tokens under the loss.

Turns of a conversation meet by one shuffle on ``conv_id``, sorted by turn within
the partition, and are read as a stream: memory holds ``SEGMENT_CHARS`` of one
conversation at a time.  A longer conversation leaves as several rows
(``segment`` 0, 1, ...) cut between turns, where special tokens separate the
pieces anyway, so ids and masks are those of the whole.  One conversation is
still read by one task, since its digest is a chain over its turns.

Defined cases: null text and null role are empty; turns go in the order of
(turn, role, text), nulls first; repeated rows are repeated turns; rows with
a null conv_id form one conversation of that id; a conversation without
assistant turns has an empty mask; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, ship, table

# Control strings of common chat templates, escaped wherever they stand in a text.
# First character and rest of each.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\(?={_TAILS})")
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END), re.S)
SEGMENT_CHARS = 4_000_000
TOKENIZER = "byte_bpe_50k.json"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] + m[2], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the character spans of the assistant texts, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        at += len(head)
        if role == "assistant":
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), spans


def masked_tokens(spans: list[tuple[int, int]], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """For each non-empty span its range of tokens, by binary search in the sorted token spans."""
    found = []
    for low, high in spans:
        first, last = bisect_left(starts, low), bisect_left(starts, high)
        if first < last:
            if starts[first] != low or max(ends[first:last]) != high:
                raise ValueError("a token crosses the border of a turn")
            found.append((first, last))
    return found


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def loss_texts(formatted: str, offsets: list[tuple[int, int]], ranges: list[tuple[int, int]]) -> list[str]:
    """The unescaped text under each masked range of tokens."""
    return [unescape(formatted[offsets[a][0]:max(e for _, e in offsets[a:b])]) for a, b in ranges]


class Encoder:
    """A public tokenizer that also knows the three marks as special tokens."""

    def __init__(self, serialised: str) -> None:
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        self.tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, SEP, END)])

    def encode(self, formatted: str) -> tuple[list[int], list[tuple[int, int]]]:
        made = self.tokenizer.encode(formatted, add_special_tokens=False)
        return made.ids, made.offsets


_ENCODERS: dict[str, Encoder] = {}


def encoder(serialised: str) -> Encoder:
    key = hashlib.sha256(serialised.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(serialised)
    return _ENCODERS[key]


def _segments(incoming: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """(conv_id, segment number, turns, whether it is the last) from rows sorted by conversation and turn."""
    current, number, turns, size, begun = None, 0, [], 0, False
    for batch in incoming:
        for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
            if begun and conv != current:
                yield current, number, turns
                number, turns, size = 0, [], 0
            elif begun and size >= limit:
                yield current, number, turns
                number, turns, size = number + 1, [], 0
            current, begun = conv, True
            turns.append((role or "", text or ""))
            size += len(text or "")
    if begun:
        yield current, number, turns


FORMATTED = "conv_id long, segment int, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, masked array<struct<first:int,last:int>>"


def format_conversations(rows: DataFrame, tokenizer_path: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per conversation (per segment of a very long one): the formatted string, its token
    ids with character offsets, and the ranges of tokens under the loss."""
    spark = rows.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        serialised = spark.sparkContext.broadcast(f.read())
    schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("token_ids", pa.list_(pa.int32())),
                        ("token_starts", pa.list_(pa.int32())), ("token_ends", pa.list_(pa.int32())),
                        ("masked", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(incoming):
        encode = encoder(serialised.value).encode

        def formatted(conv, number, turns):
            text, spans = render(turns)
            ids, offsets = encode(text)
            starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
            ranges = masked_tokens(spans, starts, ends)
            return conv, number, text, ids, starts, ends, [{"first": a, "last": b} for a, b in ranges]

        yield from batches((formatted(*s) for s in _segments(incoming, segment_chars)), schema, weigh=lambda r: 20 * len(r[2]))

    return (rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the formatted rows hold, by parsing them and following their masks.

    Expects the partitioning of ``format_conversations``: segments of a conversation in order in one partition.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(incoming):
        def digests():
            state = None
            for batch in incoming:
                columns = [batch.column(n).to_pylist() for n in ("conv_id", "segment", "formatted", "token_starts", "token_ends", "masked")]
                for conv, segment, text, starts, ends, masked in zip(*columns):
                    if segment == 0:
                        if state is not None:
                            yield close(state)
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, body in read_turns(text):
                        state[1] += 1
                        state[2].update(f"{role}\n{body}\n".encode())
                    for body in loss_texts(text, list(zip(starts, ends)), [(m["first"], m["last"]) for m in masked]):
                        state[3] += len(body)
                        state[4].update(body.encode())
                    state[5] += len(text)
            if state is not None:
                yield close(state)

        def close(state):
            conv, turns, turn_hash, chars, loss_hash, total = state
            return conv, turns, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), total

        yield from batches(digests(), schema)

    return formatted.select("conv_id", "segment", "formatted", "token_starts", "token_ends", "masked").mapInArrow(run, DIGESTS)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    text = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return read_back(format_conversations(rows, public_tokenizers.path(TOKENIZER)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(\||/s>|s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*)(\||/s>|s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g')) AS text_chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 32) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting: reversible escapes, masks against a plain rendering, long and odd conversations."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hashsieve.llm import chat as C

P = pytest.importorskip("public_tokenizers")
ROWS = "conv_id long, turn long, role string, text string, segment string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[|\\/sINST]>SY_imendrt \n", max_size=40))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in C.CONTROL)


def digests(turns):
    h, loss = hashlib.sha256(), [t for r, t in turns if r == "assistant"]
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode())
    return len(turns), h.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(C.render(turns)[0])


def conversations(seed):
    rng = random.Random(seed)
    parts = ["hello ", "é", "🙂", "\n", "  ", "</s>", "[INST]", "<|im_end|>", "<\\|", "\\", "<|endoftext|>", "x" * 50, "漢字", "́", "'s", "<", "["]
    for conv in range(60):
        yield conv, [(rng.choice(["user", "assistant", "system", "odd<|im_sep|>role"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))))
                     for _ in range(rng.randint(1, 9))]


@pytest.mark.parametrize("segment_chars", [20, C.SEGMENT_CHARS])
def test_read_back_equals_input(spark, segment_chars):
    wanted = dict(conversations(4))
    rows = [(conv, k, role, text, "clash") for conv, turns in wanted.items() for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    made = C.format_conversations(spark.createDataFrame(rows, ROWS).repartition(4), P.path(C.TOKENIZER), segment_chars)
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(made).collect()}
    assert got == {conv: digests(turns) for conv, turns in wanted.items()}


def test_segments_have_the_ids_of_the_whole(spark):
    turns = [("user" if k % 2 == 0 else "assistant", f"some text {k} " * 9) for k in range(40)]
    df = spark.createDataFrame([(1, k, *t, None) for k, t in enumerate(turns)], ROWS)
    whole = C.format_conversations(df, P.path(C.TOKENIZER)).collect()
    parts = sorted(C.format_conversations(df, P.path(C.TOKENIZER), 300).collect(), key=lambda r: r.segment)
    assert len(whole) == 1 and len(parts) > 3
    assert sum((p.token_ids for p in parts), []) == whole[0].token_ids
    assert "".join(p.formatted for p in parts) == whole[0].formatted


def test_masked_tokens_by_binary_search():
    assert C.masked_tokens([(2, 6), (8, 8), (9, 11)], [0, 2, 4, 6, 9], [2, 4, 6, 9, 11]) == [(1, 3), (4, 5)]
    with pytest.raises(ValueError):
        C.masked_tokens([(3, 6)], [0, 2, 4], [2, 4, 6])


def test_edges(spark):
    rows = [(1, None, None, None, None), (1, 2, "assistant", "b", None), (1, 2, "assistant", "b", None), (1, 1, "assistant", None, None),
            (None, 0, "user", "x", None), (2, 0, "assistant", "very long " * 100_000, None)]
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(C.format_conversations(spark.createDataFrame(rows, ROWS), P.path(C.TOKENIZER))).collect()}
    assert got == {1: digests([("", ""), ("assistant", ""), ("assistant", "b"), ("assistant", "b")]), None: digests([("user", "x")]),
                   2: digests([("assistant", "very long " * 100_000)])}
    empty = spark.createDataFrame([], ROWS)
    assert C.read_back(C.format_conversations(empty, P.path(C.TOKENIZER))).count() == 0

"""The transducer against the tiktoken library; the decoder against Python's."""

import gc
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashsieve.llm import bpe
from hashsieve.llm.common import freed

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def tools(request):
    with open(P.path(request.param), "rb") as f:
        machine, decoder, _ = bpe.compiled(f.read(), P.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    return machine, decoder, reference


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "the", "é", "ñ", "漢字", "🙂", "!!", "***", "  ", "\n", "\t", "ing", "tion", "0", "99", " ", "'s", "\x00", "<|endoftext|>", "ß"]
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        else:
            yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 40)))


def test_equals_tiktoken_and_round_trips(tools):
    machine, decoder, reference = tools
    for text in texts(3000, 1):
        ids = machine.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert decoder.decode(ids, chunk=3) == text


def test_very_long_pieces(tools):
    machine, decoder, reference = tools
    for text in ("a" * 100_000, " " * 5000 + "x", "é" * 20_000, "ab" * 30_000):
        assert machine.encode(text) == reference.encode_ordinary(text)


def test_same_after_states_are_dropped(tools, monkeypatch):
    machine, _, reference = tools
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    for text in texts(200, 2):
        assert machine.encode(text) == reference.encode_ordinary(text)
    machine.reset()


def test_decoder_holds_back_unfinished_characters(tools):
    _, decoder, _ = tools
    ids = [decoder_id for b in "a🙂é".encode() for decoder_id, t in decoder.bytes.items() if t == bytes([b])]
    out = list(decoder.stream([[i] for i in ids]))
    assert "".join(out) == "a🙂é" and out[:3] == ["a", "", ""]
    broken = [i for b in b"a\xf0\x9fb" for i, t in decoder.bytes.items() if t == bytes([b])]
    assert decoder.decode(broken) == b"a\xf0\x9fb".decode("utf-8", "replace")
    assert decoder.decode(broken[:3]) == b"a\xf0\x9f".decode("utf-8", "replace")


def test_query_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "same", 3), (3, "same", 3), (None, "long " * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    path = P.path(bpe.VOCABULARY)
    got = bpe.round_trip(df, path, P.PATTERN).collect()
    assert len(got) == 5 and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert len({(r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id == 3}) == 1
    back = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(df, path, P.PATTERN), path, P.PATTERN).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}
    assert bpe.round_trip(df.limit(0), path, P.PATTERN).count() == 0


def test_paths_are_packed_and_unpacked():
    for paths in ([(-1, 0, ())], [(7, 3, ()), (50_000, 0, (1, 2, 3)), (0, 70_000, (49_999,))]):
        assert bpe.unpacked(bpe.packed(paths)) == paths


def test_states_are_small(tools):
    machine, _, _ = tools
    machine.reset()
    machine.compatible.clear()
    machine.live.clear()
    tracemalloc.start()
    try:
        for text in texts(600, 4):
            machine.encode(text)
        machine.compatible.clear()
        machine.live.clear()
        taken = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(machine.states) > 3000 and taken / len(machine.states) < 580  # bytes; 624 and 753 with paths as nested tuples


def test_workers_let_go_of_the_vocabulary_for_other_operators(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).repartition(8)

    def machines(incoming):
        for _ in incoming:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(o).__name__ == "Transducer" for o in gc.get_objects())])], names=["n"])

    def left(**how):
        assert bpe.round_trip(docs, P.path(bpe.VOCABULARY), P.PATTERN).count() == 64
        return sum(r.n for r in docs.mapInArrow(freed(machines, **how), "n long").collect())

    assert left(keeps=True) > 0 and left() == 0

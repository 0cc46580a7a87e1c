import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hashsieve.llm import packing as P
from tests.conftest import SF001

VOCABULARY = public_tokenizers.path(P.VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture()
def encoder():
    return P.Encoder(open(VOCABULARY, encoding="utf-8").read())


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def test_encoder_equals_the_tokenizer_on_whole_texts(tokenizer, encoder, monkeypatch):
    rnd = random.Random(3)
    alphabet = "aAbzéÉß .,!?'\"\n\t\r\x1c\x1f  　。！日本か̱́̈ÅtT12_İΣςσ<|endoftext|>😀٣ﬁ가​\u0000"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += [None, "", " ", "don't. It's 3.14!", "日本。日本」。「か。", "ΟΔΟΣ ΟΔΟΣ", "Ṯ ṯ"]
    assert [i.tolist() for i, _ in encoder.encode(pa.array(texts))] == [whole(tokenizer, t) for t in texts]
    one = [next(encoder.encode(pa.array([t], pa.string())))[0].tolist() for t in texts[:300]]
    assert one == [whole(tokenizer, t) for t in texts[:300]]
    monkeypatch.setattr(P, "CHUNK_BYTES", 64)  # long texts are read in pieces
    monkeypatch.setattr(P, "MEMO_TOKENS", 50)  # and the memo is emptied again and again
    long = [" ".join(texts[7:40]), "x" * 500, "y " * 300, None]
    assert [i.tolist() for i, _ in encoder.encode(pa.array(long))] == [whole(tokenizer, t) for t in long]


def test_sentence_ends(tokenizer, encoder):
    text = 'One two. "Three!" four 3.14 five\nHead line\nlast one.'
    ids, ends = next(encoder.encode(pa.array([text])))
    parts = ["One two.", 'One two. "Three!"', 'One two. "Three!" four 3.14 five', 'One two. "Three!" four 3.14 five\nHead line']
    assert ends.tolist() == [len(whole(tokenizer, p)) - 1 for p in parts]


def brute(documents, window, sentence, broken, sequence):
    """Least cost over all candidates, each compared with every earlier one in reach; the penalties by position."""
    gap, step, at, penalty = max(1, window // 64), max(1, window // 256), 0, {}
    end = sum(len(ids) for ids, _ in documents)
    for ids, ends in documents:
        edges = [0, *ends.tolist(), len(ids)]
        for low, high in zip(edges, edges[1:]):
            if high - low > gap:
                penalty |= {at + p: broken for p in range(low + step, high, step)}
            penalty[at + high] = sentence if high < len(ids) else 0
        at += len(ids)
    for p in range(max(1, end - window + 1), end + 1):
        penalty.setdefault(p, broken)
    best = {0: 0}
    for p in sorted(penalty):
        best[p] = penalty[p] + sequence + min(
            c + (0 if p > end - window and (p - q) & (p - q - 1) == 0 else window - (p - q)) for q, c in best.items() if p - window <= q)
    return best[end], penalty


def pack(packer, documents):
    return [s for i, d in enumerate(documents) for s in packer.add(i, *d)] + list(packer.finish())


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_optimal(seed):
    rnd = random.Random(seed)
    window, documents = rnd.choice([8, 16, 64, 256]), []
    for _ in range(rnd.randint(1, 60)):
        n = rnd.randint(1, 2 * window)
        documents.append((np.arange(n, dtype=np.int32), np.array(sorted(rnd.sample(range(1, n), min(n - 1, rnd.randint(0, 6)))), np.int64)))
    least, penalty = brute(documents, window, 4, 16, 8)
    found = pack(P.Packer(window, decide_windows=2, open_windows=1 << 30), documents)
    end, at, cost, read = sum(len(d[0]) for d in documents), 0, 0, {}
    for sequence in found:
        size = sum(len(p[2]) for p in sequence)
        at += size
        cost += penalty[at] + 8 + (P.padded(size, window) if at > end - window else window) - size
        assert size <= window and [p[4] for p in sequence] == np.cumsum([0, *(len(p[2]) for p in sequence[:-1])]).tolist()
        for key, start, ids, tokens, _ in sequence:
            assert start == read.get(key, 0) and tokens == len(documents[key][0]) and ids.tolist() == documents[key][0][start:start + len(ids)].tolist()
            read[key] = start + len(ids)
    assert cost == least and read == {i: len(d[0]) for i, d in enumerate(documents)}


def test_open_windows_are_bounded_where_no_cut_is_shared():
    packer, same = P.Packer(64, decide_windows=2, open_windows=4), (np.arange(33, dtype=np.int32), np.empty(0, np.int64))
    sizes = []
    for i in range(500):
        sizes += [sum(len(p[2]) for p in s) for s in packer.add(i, *same)]
        assert packer.pos[-1] - packer.pos[0] <= 8 * 64
    sizes += [sum(len(p[2]) for p in s) for s in packer.finish()]
    assert sum(sizes) == 500 * 33 and max(sizes) <= 64


def test_query_against_the_tokenizer(spark, tokenizer):
    rows = P.op11_packing(spark, SF001).collect()
    docs = {r.doc_id: whole(tokenizer, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    sequences, read = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = docs[r.doc_id]
        assert r.start == read.get(r.doc_id, 0) and r.length > 0 and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start:r.start + r.length]))
        read[r.doc_id] = r.start + r.length
    assert read == {i: len(ids) for i, ids in docs.items()}
    assert max(sequences.values()) <= P.WINDOW
    tokens = sum(sequences.values())
    assert sum(P.padded(n) for n in sequences.values()) <= 1.03 * tokens  # few windows per task here
    # order is kept: going through the sequences, the documents come in the order of their ids
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_edges(spark, tokenizer):
    schema = "doc_id long, text string, sequence_id string, ids int"
    long = "word " * 30_000
    data = [(1, None, "a", 1), (2, "", "a", 1), (2, "", "a", 1), (None, "Null id.", None, None), (3, long, "b", 2), (4, "tie", "", 0), (4, "tie", "", 0)]
    rows = P.packed(spark.createDataFrame(data, schema), VOCABULARY).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in by_id[3]) == len(whole(tokenizer, long)) and len(by_id[3]) > 5
    assert [r.length for r in by_id[2]] == [1, 1] and len(by_id[4]) == 2 and len(by_id[None]) == 1 and [r.length for r in by_id[1]] == [1]
    assert all(r.ids == struct.pack("<I", P.END_ID) for r in by_id[2])
    assert P.packed(spark.createDataFrame([], schema), VOCABULARY).count() == 0


def test_parts_are_encoded_once_whatever_punctuation_stands_beside(tokenizer, encoder, monkeypatch):
    texts = ["abc abc, (abc) \"abc.\" abc$$$ abc%%%", "[abc] abc... don't don't! (don't) 'tis ('tis ≠ (≠ ...", "ABC; über, (über)"]
    asked, encode = [], encoder.tokenizer.encode
    monkeypatch.setattr(encoder, "tokenizer", type("Counting", (), {"encode": staticmethod(lambda t, **k: asked.append(t) or encode(t, **k))}))
    assert [i.tolist() for i, _ in encoder.encode(pa.array(texts))] == [whole(tokenizer, t) for t in texts]
    assert len(asked) == len(set(asked)) and not any("abc" in t or "über" in t for t in asked)
    assert [p for p in encoder.known if "abc" in p] == ["abc"] and [p for p in encoder.known if "don" in p] == ["don't"]
    assert {"'tis", "('tis", "(≠", "$$$"} <= set(encoder.known)  # an apostrophe or a mark may belong to what stands before it


@pytest.mark.parametrize("seed", range(4))
def test_parts_equal_the_tokenizer(tokenizer, encoder, seed):
    rnd = random.Random(seed)
    alphabet = ["ab.,'\"(≠̸́) \n", "aB'sé-_$ 1٣\t", "sS'.:Σσ ab,", "ßÿ×÷à!? \n'"][seed]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    assert [i.tolist() for i, _ in encoder.encode(pa.array(texts))] == [whole(tokenizer, t) for t in texts]


def test_candidates_are_decided_in_blocks(monkeypatch):
    calls, advance = [], P.Packer._advance
    monkeypatch.setattr(P.Packer, "_advance", lambda self, to: calls.append(to) or advance(self, to))
    documents = [(np.arange(50, dtype=np.int32), np.arange(10, 50, 10))] * 2000
    found = pack(P.Packer(256, decide_windows=8), documents)
    assert sum(len(p[2]) for s in found for p in s) == 100_000
    assert len(calls) <= 100_000 // (8 * 256) * 2 + 2  # not one a document


@pytest.mark.parametrize("seed", range(20))
def test_of_equal_cuts_the_last_is_taken(seed):
    rnd = random.Random(seed)
    window, documents, at, penalty = 64, [], 0, []
    for _ in range(200):
        n = rnd.choice([1, 2, 16, 32, 33, rnd.randint(1, 128)])
        documents.append((np.arange(n, dtype=np.int32), np.arange(1, n)))
        penalty += [(at + p, 4 if p < n else 0) for p in range(1, n + 1)]
        at += n
    packer = P.Packer(window, decide_windows=1 << 20)
    for i, d in enumerate(documents):
        list(packer.add(i, *d))
    packer._advance(at - window)
    value, parent = {0: 0}, {}
    for p, cost in penalty:
        came = min((q for q in range(max(0, p - window), p)), key=lambda q: (value[q], -q))
        value[p], parent[p] = value[came] + window + cost + 8, came
    assert packer.pos[0] == 0 and packer.pos.tolist() == list(range(at - window + 1))
    assert packer.pos[packer.parent[1:]].tolist() == [parent[p] for p in packer.pos.tolist()[1:]]

"""Near-duplicate classes against all pairs on full sets."""

import random

import numpy as np
import pytest

from hashsieve.llm import minhash as M

TEXT = "doc_id long, text string, component_id string, rep int"


def brute(rows, similarity=85):
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= similarity * len(x | y):
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        smallest[find(k)] = min(i, smallest.get(find(k), i))
    return {i: (len(s), smallest[find(k)]) for k, (i, s) in enumerate(sets)}


def corpus(seed, n_base=40, dense=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(n_base):
        base = [word() for _ in range(rng.randint(1, 150))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else " \t".join(copy))
    base = [word() for _ in range(200)]  # a dense group around the threshold: some pairs above, many below
    for _ in range(dense):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [rows[-1]] * 50 + ["", None, "one two", "One  two", "one two three four five"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 16)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(M, "BLOCK", block)  # small blocks: groups are dealt over many cells
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], TEXT).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want
    kept = M.representatives(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 850, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 75, dtype=np.uint64)])) for _ in range(2))
    agree = (M.signatures([a])[0] == M.signatures([b])[0]).mean()
    assert 0.7 < agree <= 1.0
    assert M.collections_of(M.signatures([a, b])).shape == (2, M.COLLECTIONS)


def test_missed_pairs_are_rare():
    p, c = 0.85 ** M.WIDTH, M.COLLECTIONS
    assert (1 - p) ** c + c * p * (1 - p) ** (c - 1) < 1e-5


def at_similarity(seed, low, high, n):
    """``n`` pairs (a, b) of sets of words with ``low`` <= similarity < ``high`` per cent, one changed word at a time."""
    rng = random.Random(seed)
    made = []
    while len(made) < n:
        size, k = rng.randint(150, 300), rng.randint(2, 8)
        a = [f"w{rng.randrange(10 ** 9)}" for _ in range(size)]
        b = list(a)
        for at in rng.sample(range(size), k):
            b[at] = f"v{rng.randrange(10 ** 9)}"
        x, y = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        if low * len(x | y) <= 100 * len(x & y) < high * len(x | y):
            made.append((" ".join(a), " ".join(b)))
    return made


def test_pairs_between_80_and_85(spark):
    """Pairs in random order, and a class of such pairs, against brute force at 80; none is linked at 85."""
    pairs = at_similarity(5, 80, 85, 300)
    rows = list(enumerate(t for pair in pairs for t in pair)) + [(10_000 + k, t) for k, (_, t) in enumerate(at_similarity(6, 70, 80, 50))]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], TEXT).repartition(5)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df, similarity=80).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(len(pairs)))
    assert M.representatives(df).count() == len(rows)


def test_stage_links_at_80(spark):
    import corpus_pipeline

    rows = list(enumerate(t for pair in at_similarity(7, 80, 85, 20) for t in pair))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], TEXT)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == list(range(0, 40, 2))


@pytest.mark.parametrize("similarity", [100, 90, 85, 80, 70, 60])
def test_layout_follows_similarity(similarity):
    s, (c, agree) = similarity / 100, M.layout(similarity)
    p, n = s ** M.WIDTH, M.layout(similarity)[0] * M.WIDTH
    assert (1 - p) ** c + c * p * (1 - p) ** (c - 1) <= 1e-5
    assert sum(M.math.comb(n, k) * s ** k * (1 - s) ** (n - k) for k in range(agree)) <= 2.5e-6
    assert M.layout(85) == (16, 28)


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 99), (200, 201), (5, 5)], "a long, b long")
    got = {r.rep: r.label for r in M.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 99: 99, 100: 99, 200: 200, 201: 200}


def test_edges(spark):
    assert M.near_duplicates(spark.createDataFrame([], TEXT)).count() == 0
    text = "a b c d e f g h"
    df = spark.createDataFrame([(None, text, None, None), (1, text, None, 1), (1, text, None, 1), (2, "", None, 2), (3, None, None, 3), (4, " \n", None, 3)], TEXT)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True)], key=str)
    long = " ".join(f"w{i}" for i in range(40_000))
    pair = spark.createDataFrame([(8, long, None, 0), (5, long + " x", None, 0)], TEXT)
    assert {(r.doc_id, r.component_id, r.kept) for r in M.near_duplicates(pair).collect()} == {(8, 5, False), (5, 5, True)}


def test_rows_of_one_id_with_different_texts_are_one_document(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(30)) for w in "abc")
    for rows, want in (([(5, a), (7, a), (7, b), (9, b)], 5), ([(7, a), (7, b), (9, b)], 7), ([(7, c), (5, a), (7, a), (7, b), (9, b), (11, c)], 5)):
        got = M.near_duplicates(spark.createDataFrame([(i, t, None, 0) for i, t in rows], TEXT)).collect()
        assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
        assert {r.component_id for r in got} == {want} and all(r.kept == (r.doc_id == want) for r in got)


def test_blocks_bounded_in_bytes_give_the_same(spark, monkeypatch):
    rows = corpus(4, n_base=10, dense=40)
    want = brute(rows)
    frame = spark.createDataFrame([(i, t, None, 0) for i, t in rows], TEXT)
    for name, bound in (("BLOCK_BYTES", 500), ("HELD_SHINGLES", 300), ("ASKING_BYTES", 2000), ("MEMO_WORDS", 20)):
        monkeypatch.setattr(M, name, bound)
    held = [(i, M.shingle_set((t or "").encode(), M.Words()).tobytes()) for i, t in rows if (t or "").split()]
    links, parent = M.linked(held, held, 85), {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for x, y in links:
        parent[max(top(x), top(y))] = min(top(x), top(y)) if top(x) != top(y) else parent.get(max(top(x), top(y)), max(top(x), top(y)))
    assert {i: top(i) for i, _ in held} == {i: want[i][1] for i, _ in held}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame).collect()} == want

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hashsieve.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """``rows``: (lang, source, text).  Every kept term for every group, in Python integers."""
    groups, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(SMALL) for t in TERM.findall(text or "")]
        groups[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        whole = Counter()
        for (other, _), counts in groups.items():
            if other == lang:
                whole.update(counts)

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = shares(own)
        gap = lambda q, t: (p[t] - q[t]) ** 2 // (p[t] + q[t])
        pairs = [(sum(gap(q, t) for t in kept), s) for (other, s), counts in groups.items() if other == lang and s != source for q in [shares(counts)]]
        q = shares(whole)
        terms = [(gap(q, t), t) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found[:limit], 1)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    return sorted(tuple(r) for r in D.audit(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_brute_force(spark):
    words = ["the", "The", "naïve", "supercalifragil", "exactlysixteenby", "seventeenletterss", "x" * 40, "ÄÖÜ", "日本語", "a1b", "e-mail", "ok"]
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        lang, source = [("en", "a"), ("en", "b"), ("en", "c"), ("de", "a"), ("de", None), (None, "a"), (None, "b"), ("fr", "z")][i % 8]
        weights = rng.dirichlet(np.ones(len(words)) * (0.4 if source == "b" else 2))
        rows.append((lang, source, " ".join(rng.choice(words, size=rng.integers(0, 30), p=weights)) if i % 13 else None))
    rows += [("en", "empty", None), ("en", "empty", ""), ("xx", "only", "hapax legomenon"), ("xx", "other", "1 2 3")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_documents=3, top_terms=2) == brute(rows, 3, 2)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)] * 3) == []
    same = [("en", s, "Same same TEXT") for s in "ab" for _ in range(12)]  # ties and repeated rows
    assert run(spark, same) == brute(same)
    assert run(spark, [("en", "a", "é" * 100_000 + " b")] * 12 + [("en", "b", "b")]) == brute([("en", "a", "é" * 100_000 + " b")] * 12 + [("en", "b", "b")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aZ é日x1_", max_size=40), st.integers(0, 2)), min_size=1, max_size=8))
def test_block_counts(rows):
    texts, groups = [t.encode() for t, _ in rows], np.array([g for _, g in rows])
    occurrences, documents = Counter(), Counter()
    for text, group in rows:
        terms = [t.translate(SMALL).encode() for t in TERM.findall(text)]
        occurrences.update((group, t) for t in terms)
        documents.update((group, t) for t in set(terms))
    n, d = Counter(), Counter()
    for group, terms, counts, docs in D.count_block(texts, groups):
        for key, a, b in zip(zip(group.tolist(), terms), counts.tolist(), docs.tolist()):
            assert key not in n
            n[key], d[key] = a, b
    assert n == occurrences and d == documents


@pytest.mark.parametrize("words", [1, 2])
def test_radix_order(words):
    rng = np.random.default_rng(words)
    keys = [rng.integers(0, 1 << 62, 500, dtype=np.uint64) >> np.uint64(rng.integers(0, 60)) for _ in range(words)]
    keys = [np.concatenate([k, k[:100]]) for k in keys]
    assert D.radix_order(keys).tolist() == np.lexsort(keys[::-1]).tolist()

"""Quality, language and mixing: held-out accuracy, brute-force scores, exact fits, edges."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashsieve.llm import langid as L
from hashsieve.llm import mixing as X
from hashsieve.llm import quality as Q
from hashsieve.llm.common import held_out
from tests.conftest import SF01


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF01}/labels.parquet")


def test_quality_held_out(spark, docs, labels):
    got = Q.score(docs, Q.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.98 and np.mean([s < 0.3 for s in bad]) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_votes_equal_brute_force(docs, labels):
    space = Q.fit(docs, labels)
    block = np.stack([Q.features(t.text.encode()) for t in docs.limit(20).collect()])
    placed = space.place(block)
    for at, score in zip(placed, space.scores(block, 7)):
        sims = sorted(((-float(np.float32(at @ v)), k) for k, v in enumerate(space.vectors)))[:7]
        weight = [max(-s, 1e-6) ** 4 for s, _ in sims]
        assert abs(score - sum(w * space.labels[k] for w, (_, k) in zip(weight, sims)) / sum(weight)) < 0.02


def test_quality_terms():
    text = "The cat, the CAT; the dog é1!".encode()
    words = ["the", "cat", "the", "cat", "the", "dog", "é1"]
    bucket = [zlib.crc32(w.encode()) for w in words]
    want = np.zeros(Q.TERMS)
    for k, b in enumerate(bucket):
        want[b % Q.TERMS] += 1
        if k:
            want[((bucket[k - 1] * 0x9E3779B1 + b * 0x85EBCA77) % 2**64 >> 20) % Q.TERMS] += 1
    np.testing.assert_allclose(Q.features(text)[Q.N_LOOKS:], np.log1p(want), rtol=1e-6)
    assert not Q.features(None)[Q.N_LOOKS:].any() and not Q.features(b" ,;")[Q.N_LOOKS:].any()


def test_quality_vectors_follow_terms(docs, labels):
    """Texts that look alike but share no words lie apart; the basis is orthonormal."""
    space = Q.fit(docs, labels)
    text = docs.filter("lang = 'en' and n_chars > 2000").first().text
    other = text.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm"))
    a, b = space.place(np.stack([Q.features(t.encode()) for t in (text, other)]))
    assert a @ a == pytest.approx(1, abs=1e-5) and a @ b < 0.9
    np.testing.assert_allclose(space.basis.T @ space.basis, np.eye(space.basis.shape[1]), atol=1e-4)


def test_quality_edges(spark, docs, labels):
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 2_000_000, 3)], "doc_id long, text string, score int")
    space = Q.fit(docs, labels)
    got = Q.score(odd, space).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]
    assert Q.score(odd.limit(0), space).count() == 0
    assert Q.fit(docs, labels.limit(0)) is None and {r.score for r in Q.score(odd, None).collect()} == {0.5}
    one = labels.filter("quality = 1")
    assert {r.predicted for r in Q.score(odd, Q.fit(docs, one)).collect()} == {1}
    assert Q.accepted(docs, labels).schema == docs.schema


def test_learning_never_sees_the_held_out_fold(docs, labels):
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, flipped)
    assert (a.labels == b.labels).all() and np.array_equal(a.vectors, b.vectors)
    other = docs.withColumn("lang", F.when(held_out(), "xx").otherwise(F.col("lang")))
    assert L.fit(other).langs == L.fit(docs).langs


def test_language_held_out_and_edges(spark, docs):
    model = L.fit(docs)
    assert model.langs == ["de", "en", "es", "fr"]
    got = L.predict(docs, model).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!! ²"), (4, "漢字"), (4, "漢字"), (None, "the and of")], "doc_id long, text string")
    rows = L.predict(odd, model).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2, 3)] == ["und"] * 3 and len({r.lang_pred for r in rows if r.doc_id == 4}) == 1
    assert [(r.lang_pred, r.held_out) for r in rows if r.doc_id is None] == [("en", True)]
    none = L.fit(docs.limit(0))
    assert {r.lang_pred for r in L.predict(odd, none).collect()} == {"und"} and L.predict(odd.limit(0), model).count() == 0


def test_language_backs_off_to_shorter_grams():
    rows = [("a", 0, "known", 9, 10), ("b", 0, "known", 1, 10), ("a", 3, "xyz", 5, 10), ("b", 2, "qq", 5, 10), ("a", 1, "m", 1, 10)]
    model = L.Model(rows)
    np.testing.assert_allclose(model.word("known"), [-np.log10(0.9), 1.0], rtol=1e-5)
    assert model.word("xyz")[0] < model.word("xyz")[1] == L.PENALTY  # trigram
    assert model.word("qq")[1] < model.word("qq")[0]  # bigram
    assert model.word("m")[0] == pytest.approx(1.0) and (model.word("zz") == L.PENALTY).all()


def reference_rates(p, n, targets, steps):
    """Projected gradient in the norm of G^-1, written with numpy."""
    gram = (p * n[:, None]).T @ p
    r = np.ones(len(n))
    for _ in range(steps):
        r = np.clip(r - p @ (np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (p.T @ (n * r) - targets)), 0, 1)
    return r


def test_mixing_matches_targets_and_reference(spark, docs):
    plan = X.solve(docs, X.language_labels(docs))
    total = sum(plan.targets.values())
    assert all(abs(plan.totals[d] - t) <= 2e-3 * total for d, t in plan.targets.items())
    rows = X.rates(docs, plan).collect()
    assert len(rows) == docs.count() and all(0 <= r.rate <= 1 and r.copies in (0, 1) for r in rows)
    placed = plan.classifier.place(docs.select("doc_id", "text")).select("doc_id", "__mix_n", "__mix_p").collect()
    p, n = np.array([r["__mix_p"] for r in placed]), np.array([r["__mix_n"] for r in placed], float)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    targets = np.array([plan.targets[d] for d in plan.classifier.domains])
    by_id = {r.doc_id: r.rate for r in rows}
    np.testing.assert_allclose([by_id[r.doc_id] for r in placed], reference_rates(p, n, targets, len(plan.steps)), atol=1e-6)
    lang = dict(docs.select("doc_id", "lang").collect())
    assert np.mean([r.domain == lang[r.doc_id] for r in rows]) > 0.95
    kept = X.mixed(docs, plan)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.copies)


def test_mixing_runs_no_python(docs):
    plan = X.solve(docs, X.language_labels(docs))
    text = X.rates(docs, plan)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_mixing_repeats_where_asked(spark, docs):
    plan = X.solve(docs, X.language_labels(docs), {"es": 1.0}, budget=1_000_000.0, max_rate=50.0)
    assert abs(plan.totals["es"] - 1_000_000) < 2000 and abs(plan.totals["en"]) < 10_000
    counts = {r.doc_id: r["count"] for r in X.mixed(docs, plan).groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in X.rates(docs, plan).collect() if r.copies}
    assert max(counts.values()) > 1


def test_targets():
    totals, domains = np.array([600.0, 300.0, 90.0, 10.0, 0.0]), list("abcde")
    got = X.targets_for(totals, domains, None, 850.0, 1.0)
    share = (totals[:4] / 1000) ** X.TEMPER
    assert got[1] / got[0] == pytest.approx(share[1] / share[0]) and got.tolist()[2:] == [90.0, 10.0, 0.0] and got.sum() == pytest.approx(850)
    np.testing.assert_allclose(X.targets_for(totals, domains, None, 800.0, 50.0)[:4], 800 * share / share.sum())
    assert X.targets_for(totals, domains, {"a": 1, "e": 5}, 500.0, 1.0).tolist() == [500, 0, 0, 0, 0]
    assert X.targets_for(totals, domains, {"c": 1.0}, 1e6, 2.0).tolist() == [0, 0, 180, 0, 0]


def test_a_scarce_domain_does_not_shrink_the_corpus(spark, docs):
    few = docs.filter((F.col("lang") != "es") | (F.xxhash64("doc_id") % 10 == 0))
    plan = X.solve(few, X.language_labels(few))
    assert X.mixed(few, plan).count() > 0.75 * few.count()
    spanish = X.rates(few, plan).filter("domain = 'es'").collect()
    assert spanish and np.mean([r.rate for r in spanish]) > 0.95
    repeated = X.solve(few, X.language_labels(few), max_rate=X.MAX_RATE)
    assert repeated.missed == [] and np.mean([r.rate for r in X.rates(few, repeated).filter("domain = 'es'").collect()]) > 1.3


def test_a_fifth_language_has_a_target(spark, docs):
    made = F.transform(F.sequence(F.lit(0), F.lit(150)), lambda k: F.concat(F.lit("zw"), F.pmod(F.xxhash64("id", k), F.lit(40)).cast("string"),
                                                                           F.element_at(F.array(*[F.lit(w) for w in ("oraz", "jest", "nie", "tego")]), (k % 4 + 1).cast("int"))))
    text = F.translate(F.array_join(made, " "), "0123456789", "abcdefghij")
    fifth = spark.range(80).select((F.col("id") + 10_000_000).alias("doc_id"), text.alias("text"), F.lit("pl").alias("lang"))
    both = docs.select("doc_id", "text", "lang").unionByName(fifth)
    plan = X.solve(both, X.language_labels(both), max_rate=X.MAX_RATE)
    rows = X.rates(both, plan).filter("doc_id >= 10000000").collect()
    assert plan.targets["pl"] > 0 and plan.missed == [] and all(r.domain == "pl" and r.rate > 0.8 and r.target_met for r in rows)


def test_what_cannot_be_reached_is_said(docs):
    plan = X.solve(docs, X.language_labels(docs), {"es": 1.0}, budget=1e9)
    assert "budget" in plan.missed and plan.budget == 1e9 and sum(plan.targets.values()) < 1e6
    digits = docs.sparkSession.createDataFrame([(1, "12345678"), (2, None), (3, "é" * 3)], "doc_id long, text string")
    assert [r.n_tokens for r in X.rates(digits, plan).orderBy("doc_id").collect()] == [2, 0, 2]


def test_mixing_edges(spark, docs):
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", "en", 2), (None, "the and of", "en", 3), (3, "der die das", "de", 4), (3, "der die das", "de", 4),
                                 (6, "the of " * 50_000, "en", 1)], "doc_id long, text string, lang string, rate int")
    plan = X.solve(docs, X.language_labels(docs))
    got = X.rates(odd, plan).collect()
    assert len(got) == 6 and all(0 <= r.rate <= 1 for r in got) and len({(r.rate, r.copies) for r in got if r.doc_id == 3}) == 1
    assert X.mixed(odd, plan).dtypes == odd.dtypes
    own = X.solve(odd, X.language_labels(odd))
    assert X.rates(odd, own).count() == 6
    assert {r.rate for r in X.rates(odd, X.solve(odd, X.language_labels(odd.limit(0)))).collect()} == {1.0}
    assert X.rates(odd.limit(0), plan).count() == 0
    assert X.solve(odd.limit(0), X.language_labels(odd.limit(0))).classifier is None


def slow_language(learned, text):
    """(language, score) counted anew for every text: a plain form of the model, without its lists, memo and matrix."""
    langs = sorted(learned)
    words = [w for w in L.WORD.findall((text or "").lower())]
    if not any(c.isalpha() for w in words for c in w) or not langs:
        return "und", 0.0

    def entries(lang, n):
        return learned[lang] if n == 0 else Counter({g: 0 for w in learned[lang] for g in L.grams_of(w, n)})

    tables = {}
    for lang in langs:
        for n in range(L.MAX_N + 1):
            table = entries(lang, n)
            if n:
                for w, c in learned[lang].items():
                    for g in L.grams_of(w, n):
                        table[g] += c
            tables[lang, n] = table, sum(table.values())

    def cost(lang, n, item):
        table, total = tables[lang, n]
        return min(L.PENALTY, -math.log10(table[item] / total)) if item in table else L.PENALTY

    def word_cost(lang, word):
        if any(word in tables[other, 0][0] for other in langs):
            return cost(lang, 0, word)
        for n in range(L.MAX_N, 0, -1):
            grams = L.grams_of(word, n)
            if any(g in tables[other, n][0] for g in grams for other in langs):
                return sum(cost(lang, n, g) for g in grams) / len(grams)
        return L.PENALTY

    means = {lang: sum(word_cost(lang, w) for w in words) / len(words) for lang in langs}
    best = min(langs, key=lambda lang: (round(means[lang], 6), lang))
    return best, 1 / sum(10 ** -((means[lang] - means[best]) * min(len(words), 20)) for lang in langs)


def test_language_equals_a_slow_version(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "er", "un", "ta"], "cc": ["é", "ou", "lo", "que"]}
    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(0, 30)), lang) for i, lang in enumerate(rng.choice(sorted(syllables)) for _ in range(150))]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 .. !", "cc"), (203, "ЖЖ zzz", None), (204, "Kalo xq 7", None), (205, "kalo kalo schun", "aa")]
    learned = {}
    for i, body, lang in rows:
        if lang is not None and body is not None and zlib.crc32(str(i).encode()) % 5:
            learned.setdefault(lang, Counter()).update(L.WORD.findall(body.lower()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict(docs, L.fit(docs)).collect()}
    assert len(got) == len(rows)
    for i, body, _ in rows:
        lang, score = slow_language(learned, body)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, (i, body)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_leading_eigenvectors_equal_the_whole_decomposition():
    import numpy as np

    from hashsieve.llm import quality
    rows = np.random.default_rng(1).standard_normal((700, 300)) * np.linspace(3, 1, 300)
    gram = rows.T @ rows
    want, got = np.linalg.eigh(gram)[1][:, ::-1][:, :8], quality.leading(gram, 8)
    assert len(gram) > 16 * 13  # the projected form
    assert np.allclose(np.abs((want * got).sum(axis=0)), 1, atol=1e-6)

"""Mixing to target weights with soft domain membership.  DataFrame and SQL functions only.

1. A classifier is learned from a labelled table (``doc_id, domain``): naive
   Bayes over the presence of the ``vocabulary`` words that tell most about the
   domain (mutual information), counted by Spark on a bounded sample.  It
   gives every document the posterior ``p`` of each domain, from its whole text.
2. Rates ``r`` are sought, one per document and between 0 and ``max_rate``, whose
   expected token totals ``s_k = sum n p_k r`` match ``t_k = weight_k * budget``.  This is least
   squares in the norm of ``G^-1``, ``G_kl = sum n p_k p_l``: with it the objective is
   well scaled however unequal or alike the domains are, its gradient is
   Lipschitz with constant 1, and projected gradient steps of length 1
   ``r <- project(r - p . G^-1 (s - t))`` descend from r = 1.  A step needs one aggregation
   of K sums; the K numbers it yields are all that reaches the driver.
3. The steps taken are a list of K-vectors, and a document's rate is the fold of
   that list over its posteriors.  So rates are never joined to documents.
4. ``copies`` is the rate rounded down, plus one with the probability of the rest,
   decided by a hash of the id.

A document's tokens are estimated as a quarter of its bytes, so digits, symbols and code weigh as letters do.

Weights, unless given, are the measured shares of all learned domains to the power of ``temper``: below 1 it lifts
scarce domains, 0 makes all equal.  ``budget`` is the total asked for, by default ``budget_share`` of what there is.
No domain can yield more than ``max_rate`` times its tokens; what a scarce domain cannot yield goes to the others by
their weights, so a scarce domain never shrinks the corpus.  The plan says what was asked (``budget``), aimed at (``targets``) and
reached (``totals``), ``missed`` lists the domains whose total is off by more than the tolerance, and
every row of ``rates`` says so of its own domain (``target_met``).

Defined cases: a null text has no tokens, a text without known words gets the prior;
domains with a weight but no tokens are left out and the other weights
scaled up; where weights are given, domains without one get 0; null labels are ignored;
without labels every rate is 1; repeated rows get equal rates (and, having one id, equal
copies); a null doc_id is allowed; extra columns pass through ``mixed``; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from .common import held_out, table, written

MAX_LABELLED = 6000  # documents the classifier is learned from
VOCABULARY = 256  # words in the classifier
TEMPERATURE = 2.0  # naive Bayes counts related words as if independent; its log odds are divided by this
MAX_STEPS = 40
TOLERANCE = 1e-3  # of the budget, per domain
BYTES_PER_TOKEN = 4
TEMPER = 0.7
BUDGET_SHARE = 0.85  # of the tokens there are
MAX_RATE = 3.0  # how often op4 repeats a document of a scarce domain at most


def words(text: Column) -> Column:
    """Lower-cased runs of letters of the whole text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), "")


def n_tokens(text: Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(BYTES_PER_TOKEN)).cast("int")


def _literal(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


class Classifier:
    """Domains, words, and the log weight of each word and the prior in each domain."""

    def __init__(self, domains: list[str], vocabulary: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.domains, self.vocabulary, self.weights, self.bias = domains, vocabulary, weights, bias

    def logit(self, at: Column, k: int) -> Column:
        weights = F.lit(self.weights[:, k].astype(float))
        total = F.aggregate(at, F.lit(float(self.bias[k])), lambda s, i: s + F.element_at(weights, i))
        return total / F.lit(TEMPERATURE)

    def place(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``__mix_n``, its tokens, and ``__mix_p``, the domains' probabilities in order.

        One projection per step, so that no step's result is computed twice.
        """
        known = F.lit(self.vocabulary) if self.vocabulary else F.array().cast("array<string>")
        return (docs.withColumn("__mix_words", words(F.col("text")))
                .withColumns({"__mix_n": n_tokens(F.col("text")), "__mix_hits": F.array_intersect("__mix_words", known)}).drop("__mix_words")
                .withColumn("__mix_at", F.transform("__mix_hits", lambda w: F.array_position(known, w).cast("int"))).drop("__mix_hits")
                .withColumn("__mix_logits", F.array(*[self.logit(F.col("__mix_at"), k) for k in range(len(self.domains))])).drop("__mix_at")
                .withColumn("__mix_odds", F.transform("__mix_logits", lambda x: F.exp(x - F.array_max("__mix_logits")))).drop("__mix_logits")
                .withColumn("__mix_p", F.transform("__mix_odds", lambda x: x / F.aggregate("__mix_odds", F.lit(0.0), lambda s, y: s + y)))
                .drop("__mix_odds"))


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> Classifier | None:
    """Learn from ``labelled`` (``doc_id, domain``) joined to the texts of ``docs``."""
    known = (labelled.filter(F.col("domain").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").alias("__labelled")).agg(F.max("domain").alias("__domain")))
    total = known.count()
    if not total:
        return None
    share = F.pmod(F.xxhash64("__labelled", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.filter(share < F.lit(max_labelled / total))
    sample = (docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__labelled"))
              .select("doc_id", "__domain", F.array_distinct(words(F.col("__text"))).alias("__words")))
    sample = written(sample, "mixing-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("__domain").count().collect()}
    if not sizes:
        return None
    domains, n = sorted(sizes), float(sum(sizes.values()))
    found = sample.select("__domain", F.explode("__words").alias("word")).groupBy("word").agg(
        F.count("*").alias("df"), *[F.count_if(F.col("__domain") == d).alias(f"df{k}") for k, d in enumerate(domains)])

    def information(k: int) -> Column:
        """The part of domain k in the mutual information of the word's presence and the domain."""
        def part(both: Column, margin: Column) -> Column:
            return F.when(both > 0, both / n * F.log(both * n / (margin * float(sizes[domains[k]])))).otherwise(0.0)
        own = F.col(f"df{k}").cast("double")
        return part(own, F.col("df").cast("double")) + part(F.lit(float(sizes[domains[k]])) - own, F.lit(n) - F.col("df"))

    top = (found.withColumn("mi", sum((information(k) for k in range(1, len(domains))), information(0)))
           .orderBy(F.desc("mi"), F.desc("df"), "word").limit(vocabulary).collect())
    size = np.array([sizes[d] for d in domains], float)
    theta = np.array([[(r[f"df{k}"] + 0.5) / (size[k] + 1.0) for k in range(len(domains))] for r in top]).reshape(len(top), len(domains))
    bias = np.log(size / n) + np.log1p(-theta).sum(axis=0)
    return Classifier(domains, [r["word"] for r in top], np.log(theta) - np.log1p(-theta), bias)


def _projected(p: Column, step: Column, r: Column, domains: int, max_rate: float) -> Column:
    moved = r - sum((p[k] * step[k] for k in range(1, domains)), p[0] * step[0])
    return F.greatest(F.lit(0.0), F.least(F.lit(max_rate), moved))


def rate(p: Column, steps: list[list[float]], domains: int, max_rate: float) -> Column:
    """The rate that the steps taken so far give a document with posteriors ``p``."""
    if not steps:
        return F.lit(1.0)
    return F.aggregate(F.array(*[_literal(s) for s in steps]), F.lit(1.0), lambda r, step: _projected(p, step, r, domains, max_rate))


class Plan:
    """What mixing needs per document: the classifier, the steps, and how well the totals are met."""

    def __init__(self, classifier: Classifier | None, steps: list[list[float]], max_rate: float, totals: dict, targets: dict,
                 budget: float = 0.0, tolerance: float = TOLERANCE) -> None:
        self.classifier, self.steps, self.max_rate, self.totals, self.targets = classifier, steps, max_rate, totals, targets
        self.budget, self.tolerance = budget, tolerance

    @property
    def missed(self) -> list[str]:
        """Domains whose expected total is further from the target than the tolerance; "budget" if the targets cannot add up to it."""
        limit = self.tolerance * max(1.0, sum(self.targets.values()))
        off = [d for d, t in self.targets.items() if abs(self.totals[d] - t) > limit]
        return off + (["budget"] if self.budget - sum(self.targets.values()) > self.tolerance * self.budget else [])


def targets_for(totals: np.ndarray, domains: list[str], weights: dict[str, float] | None, budget: float, max_rate: float,
                temper: float = TEMPER) -> np.ndarray:
    """Totals in proportion to the weights that add up to ``budget``, none above ``max_rate`` times what there is."""
    if weights is None:
        own = np.where(totals > 0, (totals / max(1.0, totals.sum())) ** temper, 0.0)
    else:
        own = np.array([max(0.0, float(weights.get(d, 0.0))) if t > 0 else 0.0 for d, t in zip(domains, totals)])
    if not own.sum():
        return totals.copy()
    targets, most = np.zeros(len(totals)), max_rate * totals
    open_ = own > 0
    while open_.any():
        left = budget - targets[~open_].sum()
        targets[open_] = left * own[open_] / own[open_].sum()
        full = open_ & (targets >= most)
        if not full.any():
            break
        targets[full] = most[full]
        open_ &= ~full
    return targets


def solve(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, max_rate: float = 1.0,
          max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE, temper: float = TEMPER, budget_share: float = BUDGET_SHARE) -> Plan:
    classifier = fit(docs, labelled)
    if classifier is None:
        return Plan(None, [], max_rate, {}, {})
    domains = len(classifier.domains)
    state = written(classifier.place(spread(docs.select("text"))).select(F.col("__mix_n").cast("double").alias("n"), F.col("__mix_p").alias("p")), "mixing-state")
    p, n = F.col("p"), F.col("n")
    sums = state.agg(*[F.sum(n * p[k]).alias(f"s{k}") for k in range(domains)],
                     *[F.sum(n * p[k] * p[m]).alias(f"g{k}_{m}") for k in range(domains) for m in range(k, domains)]).first()
    totals = np.array([sums[f"s{k}"] or 0.0 for k in range(domains)])
    gram = np.array([[sums[f"g{min(k, m)}_{max(k, m)}"] or 0.0 for m in range(domains)] for k in range(domains)])
    budget = float(totals.sum()) * budget_share if budget is None else budget
    targets = targets_for(totals, classifier.domains, weights, budget, max_rate, temper)
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    steps: list[list[float]] = []
    reached = totals
    for _ in range(max_steps):
        short = reached - targets
        if np.abs(short).max() <= tolerance * max(1.0, float(targets.sum())):
            break
        steps.append([float(f"{x:.12g}") for x in inverse @ short])
        r = rate(p, steps, domains, max_rate)
        row = state.agg(*[F.sum(n * p[k] * r).alias(f"s{k}") for k in range(domains)]).first()
        before, reached = reached, np.array([x or 0.0 for x in row])
        if np.abs(reached - before).max() <= 1e-9 * max(1.0, float(targets.sum())):
            break  # the bounds allow no closer match
    named = lambda values: dict(zip(classifier.domains, map(float, values)))
    return Plan(classifier, steps, max_rate, named(reached), named(targets), budget, tolerance)


def _decided(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with the columns ``__mix_n``, ``__mix_p``, ``__mix_rate`` and ``__mix_copies``."""
    if plan.classifier is None:
        out = docs.withColumns({"__mix_n": n_tokens(F.col("text")), "__mix_p": F.array().cast("array<double>"), "__mix_rate": F.lit(1.0)})
    else:
        r = rate(F.col("__mix_p"), plan.steps, len(plan.classifier.domains), plan.max_rate)
        out = plan.classifier.place(docs).withColumn("__mix_rate", r)
    return out.withColumn("__mix_copies", copies(F.col("doc_id"), F.col("__mix_rate")))


def copies(doc_id: Column, r: Column) -> Column:
    draw = F.pmod(F.xxhash64(doc_id, F.lit(44)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(r) + F.when(draw < r - F.floor(r), 1).otherwise(0)).cast("int")


def rates(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, n_tokens, domain`` (the likeliest), ``posterior`` (its probability), ``rate, copies`` for every row, and ``target_met``, whether the domain's expected total is its target."""
    named = F.lit(plan.classifier.domains) if plan.classifier else F.array().cast("array<string>")
    met = F.lit([d not in plan.missed for d in plan.classifier.domains]) if plan.classifier else F.array().cast("array<boolean>")
    best = F.array_max("__mix_p")
    at = (F.array_position("__mix_p", best) - 1).cast("int")
    return _decided(spread(docs.select("doc_id", "text")), plan).select(
        "doc_id", F.col("__mix_n").cast("long").alias("n_tokens"), F.get(named, at).alias("domain"),
        best.alias("posterior"), F.col("__mix_rate").alias("rate"), F.col("__mix_copies").alias("copies"),
        F.coalesce(F.get(met, at), F.lit(True)).alias("target_met"))


def mixed(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` with every row as often as ``copies`` says, all columns unchanged; no shuffle.

    The random column, always below 1, only keeps the optimizer from moving the filter below the
    projections of ``place``, where each of them would be computed many times over.
    """
    out = _decided(spread(docs), plan).withColumn("__mix_draw", F.rand(0)).filter((F.col("__mix_copies") > 0) & (F.col("__mix_draw") < 1))
    if plan.max_rate > 1:
        out = out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return out.select(docs.columns)


def language_labels(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("lang").alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rates(docs, solve(docs, language_labels(docs), max_rate=MAX_RATE))

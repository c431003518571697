"""Mixing sources to target weights, by soft memberships and projected-gradient least squares.

A classifier learned from a labelled table gives each document a posterior over the domains, so mixed or unlabelled
documents belong to several in part: naive Bayes over the document's distinct words and characters, hashed to
BUCKETS features, whose evidence counts as at most EVIDENCE features so that posteriors stay soft. It knows no
language or script beforehand; characters tell apart texts that are not written in words. Each document then gets a
nonnegative rate such that the expected tokens of domain k, the sum of rate * tokens * posterior[k], match its target:
the least-squares problem is solved by projected gradient from the rate 1, so rates stay near 1 where the targets allow.
In the metric that weighs a document by its tokens and a domain by its present tokens, the step 1 is stable, and every
document of one posterior has one rate, which is a function of that posterior alone.

Posteriors are rounded to steps of 1 / GRID, so that the solver sums documents of one posterior first; each gradient step is one
aggregation over that table, and what comes to the driver is one residual a domain. The model is BUCKETS numbers a
domain. All of it is DataFrame functions.

Defined results: null and empty texts have 0 tokens and the prior as posterior. Domains without a target keep their
present share; where no domain with tokens has a positive target, all rates are 1. Rows with a null domain or id teach nothing; with
nothing to learn from all rates are 1. Repeated rows are mixed each. Rates are at most MAX_RATE; targets beyond that are missed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BUCKETS = 4096
#: Features that count as evidence at most, however many a document has.
EVIDENCE = 32.0
#: Pseudo-count of a feature in a domain.
PSEUDO = 0.5
#: Steps from 0 to 1 of a rounded posterior.
GRID = 32
#: The classifier is fitted on about so many labelled rows at most, those with the smallest hashed ids.
LABELLED_ROWS = 20_000
STEPS = 40
TOLERANCE = 1e-6
#: A document counts, or is repeated, at most so many times.
MAX_RATE = 50.0
#: Target weights of the domains in the registered query.
TARGETS = {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    """Words of a text, without capitals."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def tokens(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(_words(F.coalesce(text.cast("string"), F.lit("")))).cast("long")


def described(text: Column) -> Column:
    """(tokens, features): the number of words, and the buckets of the distinct words and characters."""
    low = F.lower(F.coalesce(text.cast("string"), F.lit("")))

    def features(distinct: Column) -> Column:
        characters = F.transform(F.array_distinct(F.split(F.array_join(distinct, ""), "")), lambda c: F.concat(F.lit(" "), c))
        found = F.transform(F.concat(distinct, characters), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
        return F.when(F.size(distinct) > 0, found).otherwise(F.array().cast("array<int>"))

    return _let(_words(low), lambda words: F.struct(F.size(words).cast("long").alias("tokens"), _let(F.array_distinct(words), features).alias("features")))


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    prior: list[float]
    #: Log-likelihood of a feature in each domain, bucket by bucket.
    weights: list[float]

    def posterior(self, features: Column) -> Column:
        """Rounded probabilities of the domains, which sum to about 1."""
        k = len(self.domains)
        if not k:
            return F.array().cast("array<double>")
        numbers = lambda xs: F.split(F.lit(",".join(f"{x:.5g}" for x in xs)), ",").cast("array<double>")
        by_domain = F.array(*[numbers(self.weights[i::k]) for i in range(k)])  # one constant in the plan

        def joint(found: Column) -> Column:
            share = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.size(found), F.lit(1)))
            summed = F.transform(by_domain, lambda w: F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(w, b)))
            return _let(share, lambda s: F.zip_with(summed, numbers(self.prior), lambda x, p: x * s + p))

        odds = _let(_let(features, joint), lambda j: F.transform(j, lambda x: F.exp(x - F.array_max(j))))
        return _let(odds, lambda o: F.transform(o, lambda x: F.round(x / F.aggregate(o, F.lit(0.0), lambda a, y: a + y) * GRID) / GRID))

    def best(self, post: Column) -> Column:
        """The likeliest domain, of equal ones the first."""
        if not self.domains:
            return F.lit(None).cast("string")
        return F.element_at(F.array(*map(F.lit, self.domains)), F.array_position(post, F.array_max(post)).cast("int"))


def learn(docs: DataFrame, labels: DataFrame, domain: str, text: str = "text", doc_id: str = "doc_id") -> Classifier:
    """Count the features of the documents that the labelled table names, by domain."""
    names = labels.select(F.col(doc_id).alias("__id")).dropna().distinct()
    share = min(1.0, LABELLED_ROWS / max(names.count(), 1))
    chosen = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << 20)) < int(share * (1 << 20))
    few = docs.select(F.col(doc_id).alias("__id"), F.col(domain).cast("string").alias("domain"), F.col(text).alias("text")).where(chosen("__id") & F.col("domain").isNotNull())
    rows = few.join(names.where(chosen("__id")).hint("merge"), "__id", "left_semi").select("domain", described(F.col("text")).alias("d"))
    rows = cut(rows.select("domain", "d.features"))
    per = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}  # a row for each domain
    domains = sorted(per)
    got = rows.select("domain", F.explode("features").alias("bucket")).groupBy("domain", "bucket").count().collect()  # domains x BUCKETS rows at most
    n = {(r["domain"], r["bucket"]): r["count"] for r in got}
    total = {d: sum(n.get((d, b), 0) for b in range(BUCKETS)) + PSEUDO * BUCKETS for d in domains}
    weights = [math.log((n.get((d, b), 0) + PSEUDO) / total[d]) for b in range(BUCKETS) for d in domains]
    # only differences between domains matter: the largest of a bucket is 0
    k = len(domains)
    weights = [w - max(weights[i // k * k : i // k * k + k]) for i, w in enumerate(weights)]
    return Classifier(domains, [math.log(per[d] / sum(per.values())) for d in domains], weights)


def _rate(residuals: list[list[float]], most: float) -> Column:
    """The rate after a history of scaled residuals, each step projected onto rates from 0 to ``most``, as a function of ``post``."""
    if not residuals:
        return F.lit(1.0)
    history = F.array(*[F.array(*map(F.lit, r)) for r in residuals])  # one constant in the plan
    dot = lambda g: F.aggregate(F.zip_with("post", g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(history, F.lit(1.0), lambda rate, g: F.least(F.lit(most), F.greatest(F.lit(0.0), rate - dot(g))))


def rates(known: DataFrame, domains: list[str], targets: dict[str, float], keep_all: bool = False, most: float = MAX_RATE) -> Column:
    """The rate of a document as a function of its ``post``, fitted on ``known`` (tokens, post).

    The targets are weights of the present tokens in all; with ``keep_all`` the total is instead the smallest at which no
    domain is thinned, and rates below 1 are raised to it.
    """
    summed = cut(known.groupBy("post").agg(F.sum("tokens").alias("tokens")))
    expected = lambda rate: [F.sum(F.col("tokens") * rate * F.element_at("post", k + 1)).alias(f"k{k}") for k in range(len(domains))]
    present = [float(x or 0) for x in summed.agg(*expected(F.lit(1.0))).first()] if domains else []
    total = sum(present)
    weight = [max(targets.get(d, present[k] / total), 0.0) if total else 0.0 for k, d in enumerate(domains)]
    if not any(w and p for w, p in zip(weight, present, strict=True)):
        return F.lit(1.0)
    weight = [w / sum(weight) for w in weight]
    if keep_all:
        total = max(p / w for p, w in zip(present, weight, strict=True) if w and p)
    goal = [w * total for w in weight]
    residuals: list[list[float]] = []
    now = present
    for _ in range(STEPS):
        scaled = [(x - g) / p if p else 0.0 for x, g, p in zip(now, goal, present, strict=True)]
        if max(map(abs, scaled)) < TOLERANCE:
            break
        residuals.append(scaled)
        now = [float(x or 0) for x in summed.agg(*expected(_rate(residuals, most))).first()]
    rate = _rate(residuals, most)
    return F.greatest(rate, F.lit(1.0)) if keep_all else rate


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], domain: str = "lang", text: str = "text", most: float = MAX_RATE) -> DataFrame:
    """``docs`` repeated by their rates: floor(rate) times, and once more for a share of them drawn by hashed id.

    No document is thinned out, none is repeated more than ``most`` times.
    """
    model = learn(docs, labels, domain, text)
    with_post = lambda df: df.withColumn("__d", described(F.col(text))).withColumn("post", model.posterior(F.col("__d.features")))
    fitted = rates(with_post(docs.select(text)).select("__d.tokens", "post"), model.domains, targets, True, most)
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    own = [F.col(f"__own.`{c}`") for c in docs.columns]
    rated = with_post(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"), F.col(text), F.col("doc_id")))
    copies = F.greatest(F.floor(fitted + draw).cast("int"), F.lit(1))
    return rated.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*own)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), "lang")
    known = docs.select("doc_id", "source", described(F.col("text")).alias("d")).select("doc_id", "source", F.col("d.tokens").alias("n_tokens"), model.posterior(F.col("d.features")).alias("post"))
    known = cut(known)
    rate = rates(known.select(F.col("n_tokens").alias("tokens"), "post"), model.domains, TARGETS)
    return known.select("doc_id", "source", model.best(F.col("post")).alias("domain"), "n_tokens", rate.alias("rate"))

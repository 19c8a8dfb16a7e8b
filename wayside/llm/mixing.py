"""Document rates that mix soft domains to target weights.

A naive Bayes classifier, fitted on a labelled table, gives each document a
posterior over domains.  Projected gradient then fits nonnegative rates r_i that
minimise the weighted least squares of

    sum_i r_i * tokens_i * p_i,domain - target_domain * all tokens,

starting from rate 1.  A document's rate depends only on its posteriors and on
the residuals of all steps, so a step is one aggregate over the stored table of
tokens and posteriors, and the rate is an expression of its columns.

Everything on the data is a DataFrame expression.
"""

from __future__ import annotations

import math
import re
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayside.llm.ridge import labelled_sample
from wayside.llm.storage import stored

#: Labelled documents that are learned from, about (a sample by hash beyond that).
MOST_LABELLED = 20_000
#: Words that mark a domain, at most; each in LEAST_SEEN labelled documents or more.
WORDS_PER_DOMAIN = 300
LEAST_SEEN = 5
STEPS = 24
#: The fit ends when no domain's share is further from its target than this.
CLOSE = 1e-4
#: Ridge that keeps the weighting of the residuals bounded where domains are alike.
RIDGE = 1e-4

_STATISTICS = ["f_words", "f_length", "f_distinct", "f_symbols", "f_capitals"]
#: Characters other than ASCII capitals, and other than those and ``string.punctuation``.
_NO_CAPITALS, _NO_MARKS = "[^A-Z]+", f"[^A-Z{re.escape(string.punctuation)}]+"


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_tokens`` (blank-separated words), distinct lower-case words ``_words`` and statistics of the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.withColumn("_text", text).withColumn("_raw", F.array_remove(F.split("_text", r"\s+"), ""))
    counted = split.withColumn("n_tokens", F.size("_raw").cast("long")).withColumn("_chars", F.length("_text") + 1)
    # one pass over the text for both kinds of characters, a second one over what it leaves
    counted = counted.withColumn("_marks", F.regexp_replace("_text", _NO_MARKS, "")).withColumn("_capitals", F.length(F.regexp_replace("_marks", _NO_CAPITALS, "")))
    left = lambda found: F.length("_text") - found
    return counted.withColumns(
        {
            "_words": F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}\p{N}]+")),
            "f_words": F.log1p("n_tokens"),
            "f_length": F.col("_chars") / (F.col("n_tokens") + 1),
            "f_distinct": F.size(F.array_distinct("_raw")) / (F.col("n_tokens") + 1),
            "f_symbols": 1 - left(F.length("_marks") - F.col("_capitals")) / F.col("_chars"),
            "f_capitals": 1 - left(F.col("_capitals")) / F.col("_chars"),
        }
    ).drop("_text", "_raw", "_chars", "_marks", "_capitals")


class SoftMembership:
    """Gaussian naive Bayes over statistics and over counts of words that mark a domain."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.words: dict[str, list[str]] = {d: [] for d in domains}
        self.prior = dict.fromkeys(domains, 1 / len(domains))
        self.moments: dict[tuple[str, str], tuple[float, float]] = {}

    @property
    def features(self) -> list[str]:
        return [*_STATISTICS, *(f"f_marks{i}" for i in range(len(self.domains)))]

    def with_features(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the counts of the words that mark each domain; every word is looked up once in all of them, the few found ones by domain."""
        every = sorted({w for d in self.domains for w in self.words[d]})
        found = docs.withColumn("_found", F.filter("_words", lambda w: w.isin(every)))
        size_of = lambda words: F.size(F.filter("_found", lambda w: w.isin(words)))
        marks = {f"f_marks{i}": F.log1p(size_of(self.words[d])) for i, d in enumerate(self.domains)}
        return found.withColumns(marks).drop("_words", "_found")

    def posteriors(self, docs: DataFrame, names: list[str]) -> DataFrame:
        """``docs`` with one column per domain; they sum to 1."""
        logs = {}
        for i, d in enumerate(self.domains):
            log: Column = F.lit(math.log(self.prior[d]) if self.prior[d] > 0 else -1e6)
            for f in self.features:
                if (d, f) in self.moments:
                    mean, variance = self.moments[d, f]
                    log = log - (F.col(f) - mean) * (F.col(f) - mean) / (2 * variance) - 0.5 * math.log(variance)
            logs[f"_log{i}"] = log
        shifted = docs.withColumns(logs).withColumn("_top", F.greatest(*logs) if len(logs) > 1 else F.col("_log0"))
        raw = shifted.withColumns({f"_e{i}": F.exp(F.col(f"_log{i}") - F.col("_top")) for i in range(len(logs))})
        total = sum((F.col(f"_e{i}") for i in range(len(logs))), F.lit(0.0))
        return raw.withColumns({n: F.col(f"_e{i}") / total for i, n in enumerate(names)}).drop("_top", *logs, *[f"_e{i}" for i in range(len(logs))], *self.features)


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], most: int = MOST_LABELLED) -> SoftMembership:
    """A classifier from ``labelled (doc_id, domain)`` and the texts of ``docs``.

    About ``most`` labelled documents are read.  Rows with another or no domain
    are left out; of several domains of one id the first by name counts.  A
    domain without labels has posterior 0; without any label all are equal.
    """
    model = SoftMembership(domains)
    one = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    ids = labelled_sample(one.withColumn("_one", F.lit(1.0)), ["_one"], most).select("doc_id").join(one, "doc_id")
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most about ``most`` ids
    rows = stored(with_statistics(picked).drop("text"))
    counts = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return model
    model.prior = {d: counts.get(d, 0) / total for d in domains}
    of = [F.sum(F.when(F.col("domain") == d, 1.0).otherwise(0.0)).alias(f"n{i}") for i, d in enumerate(domains)]
    seen = stored(rows.select("domain", F.explode("_words").alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), *of).where(F.col("n") >= LEAST_SEEN))
    for i, d in enumerate(domains):
        share = model.prior[d]
        if 0 < share < 1:
            surplus = (F.col(f"n{i}") - F.col("n") * share) / F.sqrt(F.col("n") * F.lit(share * (1 - share)))
            model.words[d] = [r["word"] for r in seen.orderBy(surplus.desc(), "word").limit(WORDS_PER_DOMAIN).collect()]
    features = model.with_features(rows)
    sums = features.groupBy("domain").agg(*[f(c).alias(f"{name}_{c}") for c in model.features for name, f in (("m", F.avg), ("v", F.var_pop))]).collect()
    whole = features.agg(*[F.var_pop(c).alias(c) for c in model.features]).first()
    for r in sums:
        for c in model.features:
            model.moments[r["domain"], c] = (r[f"m_{c}"], max(r[f"v_{c}"], 0.05 * whole[c], 1e-6))
    return model


def fit_rates(weighed: DataFrame, names: list[str], targets: list[float], steps: int = STEPS) -> tuple[Column, np.ndarray]:
    """The rate as an expression of ``names`` (posteriors), and the shares that it reaches.

    ``weighed`` has ``n_tokens`` and the posteriors; each step is one aggregate.
    """
    weight, size = np.array(targets, dtype=float) / sum(targets), len(names)
    upper = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rate: Column = F.lit(1.0)
    reached = np.zeros(size)
    for step in range(steps):
        moved = F.when(rate > 0, F.col("n_tokens")).otherwise(0)
        found = weighed.agg(F.sum("n_tokens"), *[F.sum(rate * F.col("n_tokens") * F.col(n)) for n in names], *[F.sum(moved * F.col(a) * F.col(b)) for a, b in upper]).first()
        tokens = float(found[0] or 0)
        if tokens == 0:
            break
        reached = np.array(found[1 : size + 1], dtype=float) / tokens
        residual = reached - weight
        if np.abs(residual).max() < CLOSE or step == steps - 1:
            break
        gram = np.zeros((size, size))
        gram[np.triu_indices(size)] = np.array(found[size + 1 :], dtype=float) / tokens
        gram = gram + gram.T - np.diag(np.diag(gram))
        # residuals weighted by the inverse Gram matrix of the rates above 0: the problem that is left has condition 1
        slope = np.linalg.solve(gram + RIDGE * np.eye(size), residual)
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(float(g)) * F.col(n) for g, n in zip(slope, names, strict=True)), F.lit(0.0)))
    return rate, reached


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` without ``drop`` and with ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies``.

    ``copies`` is the rate rounded up or down at random, by a hash of id and
    text, so that its mean is the rate; equal rows get equal copies.  Null and
    empty texts have no tokens and a posterior like any text.  Columns of these
    names are replaced.  The total of tokens stays about the same.
    """
    domains = list(targets)
    names = [f"p_{d}" for d in domains]
    own = [c for c in docs.columns if c not in {*names, "n_tokens", "rate", "copies", "_words", "_u", *_STATISTICS}]
    docs = docs.select(*own)
    model = learn(docs, labelled, domains)
    u = F.pmod(F.xxhash64(F.lit("copies"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    described = model.with_features(with_statistics(docs).withColumn("_u", u).drop(*drop))
    weighed = stored(model.posteriors(described, names))
    rate, _ = fit_rates(weighed.select("n_tokens", *names), names, [targets[d] for d in domains])
    return weighed.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.col("_u")).cast("int")).drop("_u")


#: Domains of the labels table and the share of tokens that each shall have.
TARGETS = {"good": 0.92, "poor": 0.07, "toxic": 0.01}


def domains_of(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic, else good or poor by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents that bring the domains' expected tokens to TARGETS."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), TARGETS, drop=("text",))

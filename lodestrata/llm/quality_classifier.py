"""Quality classifier: document evidence combined with the posteriors of its site and of its section there.

Evidence is the log-odds of a logistic regression on ten shape features of a text, fitted here to labelled
documents. The probabilities that it gives are summed by site and by section (a path within the site), and each
level is shrunk to the one above by empirical Bayes: the beta prior's strength comes from how much
the groups differ beyond chance, so a sparse site says little and a large one speaks for itself. A
document's score is its evidence moved by how far its section's posterior lies from the global prior.

Features and sums are DataFrame expressions; labelled rows within `SAMPLE_LIMIT` documents (their features,
not their texts) are fitted on the driver. Sites and sections are joined back by broadcast only up to a
counted bound.

Defined cases: null and empty texts have all features 0. Null sites and sections are groups of their
own. Without labels the evidence is 0 for all, and documents are kept. Repeated rows each get a row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, sampled_ids, small_side, words_of

#: Bound of the labelled sample, in documents.
SAMPLE_LIMIT = 20_000
RIDGE, ROUNDS, MOST_EVIDENCE = 1.0, 25, 8.0
MIN_SCORE = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6

FEATURES = ("log_words", "word_length", "symbols", "capitals", "distinct_words", "exclaims", "digits", "line_repeats", "punctuation", "non_ascii")


def _count(text: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(text, outside, ""))


def with_features(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep`, and `x`: the features of `text` as an array of doubles."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(
        *keep,
        words_of(F.col("text")).alias("__words"),
        F.split(text, "\n").alias("__lines"),
        F.length(text).alias("__n"),
        *[
            _count(text, outside).alias(f"__{name}")
            for name, outside in (
                ("symbols", r"[^#*$%&|<>]+"),
                ("capitals", r"[^\p{Lu}]+"),
                ("exclaims", r"[^!]+"),
                ("digits", r"[^0-9]+"),
                ("punctuation", r"[^.,;:?()'\"-]+"),
                ("non_ascii", r"[\x00-\x7F]+"),
            )
        ],
    )
    n_words = F.size("__words")
    per_char = lambda c: F.try_divide(F.col(c), F.col("__n"))
    x = F.array(
        F.log1p(n_words.cast("double")),
        F.try_divide(F.col("__n"), n_words),
        per_char("__symbols"),
        per_char("__capitals"),
        F.try_divide(F.size(F.array_distinct("__words")), n_words),
        per_char("__exclaims"),
        per_char("__digits"),
        F.try_divide(F.size("__lines") - F.size(F.array_distinct("__lines")), F.size("__lines")),
        per_char("__punctuation"),
        per_char("__non_ascii"),
    )
    kept = [c for c in counted.columns if c not in {"__words", "__lines", "__n", *(f"__{f}" for f in FEATURES)}]
    return counted.select(*kept, F.transform(x, lambda v: F.coalesce(v, F.lit(0.0))).alias("x"))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of raw features and intercept: ridge logistic regression by iterated least squares."""
    if not len(y):
        return np.zeros(len(FEATURES)), 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    penalty = np.diag([RIDGE] * (z.shape[1] - 1) + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty @ w
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty
        w = w + np.linalg.solve(hess, grad)
    raw = w[:-1] / scale
    return raw, float(w[-1] - raw @ mean)


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_LIMIT) -> tuple[np.ndarray, float]:
    """Fit to labelled documents, at most `limit` of them."""
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    wanted = known.join(F.broadcast(sampled_ids(known, limit)), "doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = with_features(sample, [F.col("doc_id"), F.col("y")]).orderBy("doc_id").limit(limit).select("x", "y").collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], float))


def evidence(weights: np.ndarray, intercept: float) -> Column:
    """Log-odds of being good, from `x`; bounded, so that one text doesn't outvote its site by any margin."""
    total = F.lit(float(intercept))
    for i, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.col("x")[i]
    return F.greatest(F.lit(-MOST_EVIDENCE), F.least(F.lit(MOST_EVIDENCE), total))


def _sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, prior: Column) -> float:
    """Strength of the beta prior of groups of n documents with s good ones: by the moments of their rates."""
    row = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - prior, 2)).alias("spread"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum(F.col(n) * prior * (1 - prior)).alias("within"),
        F.sum(n).alias("n"),
    ).first()
    if not row.n:
        return LEAST_STRENGTH
    between = (row.spread - row.chance) / row.n
    within = row.within / row.n
    return MOST_STRENGTH if between <= within / MOST_STRENGTH else max(LEAST_STRENGTH, within / between - 1)


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """site, path, site_posterior and path_posterior of each section, and the global prior, from site, path and p."""
    sections = materialize(scored.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-sections")
    sites = materialize(sections.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s")), "quality-sites")
    total = sites.agg(F.sum("site_n").alias("n"), F.sum("site_s").alias("s"), F.count("*").alias("groups")).first()
    prior = min(1 - 1e-6, max(1e-6, total.s / total.n)) if total.n else 0.5
    k = _strength(sites, "site_n", "site_s", F.lit(prior))
    shrunk = sites.withColumn("site_posterior", (F.col("site_s") + k * prior) / (F.col("site_n") + k)).withColumnRenamed("site", "of_site")
    both = sections.join(small_side(shrunk, total.groups), F.col("site").eqNullSafe(F.col("of_site")))
    k = _strength(both, "n", "s", F.col("site_posterior"))
    out = both.select(
        "site", "path", "site_posterior", ((F.col("s") + k * F.col("site_posterior")) / (F.col("n") + k)).alias("path_posterior")
    )
    return materialize(out, "quality-posteriors"), prior


def judge(docs: DataFrame, labels: DataFrame, site: Column, path: Column, keep: list[Column]) -> DataFrame:
    """`keep`, site, path, evidence, both posteriors, score (0 to 1) and kept of each document."""
    weights, intercept = learn(docs, labels)
    scored = with_features(docs, [*keep, site.alias("site"), path.alias("path")]).withColumn("evidence", evidence(weights, intercept)).drop("x")
    groups, prior = posteriors(scored.select("site", "path", _sigmoid(F.col("evidence")).alias("p")))
    groups = groups.withColumnsRenamed({"site": "of_site", "path": "of_path"})
    joined = scored.join(
        small_side(groups, groups.count()), F.col("site").eqNullSafe(F.col("of_site")) & F.col("path").eqNullSafe(F.col("of_path"))
    ).drop("of_site", "of_path")
    score = _sigmoid(F.col("evidence") + _logit(F.col("path_posterior")) - math.log(prior / (1 - prior)))
    return joined.withColumn("score", score).withColumn("kept", F.col("score") >= MIN_SCORE)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of documents, whose site is their source and whose section there is their language."""
    return judge(docs, labels, F.col("source"), F.col("lang"), [F.col("doc_id")])


def classify_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of rows (doc_id, url, text), whose site is the URL's host and whose section its first path segment."""
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*(/[^/?#]*)", 1)
    return judge(pages, labels, site, path, [F.col("doc_id"), F.col("url")])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    verdicts = judge(docs, labels, F.col("source"), F.col("lang"), [row])
    return verdicts.where("kept").select("row.*")

"""Quality rules: base counts of each text, then a hashed n-gram log-likelihood ratio.

A document's words and neighbouring word pairs are hashed to `n_buckets` features. Two multinomials
over the features, one of the trusted target documents and one of the raw corpus (all documents),
give each feature the weight ln p_target - ln p_raw; a document's score is the mean weight of its
features, so long and short texts compare. Every document is held against the same threshold, so the
verdict depends on nothing but the text and the two multinomials.

Only DataFrame functions run here. The weights are one array of n_buckets doubles, the only thing
that passes the driver; its size does not grow with the data.

Defined cases: null and blank texts have no words, all counts are 0 and they fail the base rules.
Without trusted documents all weights are 0 and only the base rules decide. Repeated rows are judged
alike, each gets its row. Extra columns are ignored by `judge` and kept by `keep_good`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import let, sampled_ids, where_here, words_of

N_BUCKETS = 16_384
#: Mean log-likelihood ratio from which a document counts as like the target.
MIN_SCORE = -0.25
#: Bound of the trusted sample, in documents.
TRUSTED_LIMIT = 20_000
MIN_WORDS = 50
SYMBOLS_OUT = r"[^#*$%&|<>]+"
LINE_WITH_WORD = r"[^\x20\x09-\x0D]"


def gram_buckets(words: Column, n_buckets: int) -> Column:
    """Feature numbers of words (first half of the buckets) and of word pairs (second half)."""
    half = n_buckets // 2
    singles = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(half)))
    pairs = F.transform(
        F.when(F.size(words) >= 2, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.pmod(F.xxhash64(words[i], words[i + 1]), F.lit(half)) + half,
    )
    return F.concat(singles, pairs)


def bucket_weights(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS) -> list[float]:
    """ln p_target - ln p_raw of each bucket, both with add-one smoothing. trusted: distinct doc_ids, bounded."""
    flagged = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id").withColumn("is_target", F.lit(1))), "doc_id", "left"
    )
    counts = (
        flagged.select("is_target", words_of(F.col("text")).alias("words"))
        .select("is_target", F.explode(gram_buckets(F.col("words"), n_buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("is_target").alias("target"))
        .collect()
    )
    raw, target = [0] * n_buckets, [0] * n_buckets
    for row in counts:
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not sum(target):
        return [0.0] * n_buckets
    shift = math.log(sum(raw) + n_buckets) - math.log(sum(target) + n_buckets)
    return [math.log(t + 1) - math.log(r + 1) + shift for t, r in zip(target, raw, strict=True)]


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more."""
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))
    )
    hashes = F.transform(windows, lambda x: x["h"])
    ordered = F.array_sort(windows)

    def covered(srt: Column) -> Column:
        last = F.size(srt) - 1
        twice = F.filter(
            srt,
            lambda x, i: ((i > 0) & (F.get(srt, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(srt, i + 1)["h"] == x["h"])),
        )
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    found = let(ordered, covered)
    return F.when(n < 4, F.lit(0)).when(F.size(F.array_distinct(hashes)) == n - 2, F.lit(0)).otherwise(found)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, words and the base counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(LINE_WITH_WORD))
    counted = docs.select(
        "doc_id",
        words_of(F.col("text")).alias("words"),
        F.length(F.regexp_replace(text, SYMBOLS_OUT, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    return counted.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def llr_score(words: Column, weights: list[float]) -> Column:
    """The mean weight of a text's features; null without words."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    grams = gram_buckets(words, len(weights))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table, b.cast("int")))
    return F.when(F.size(words) > 0, total / (2 * F.size(words) - 1))


def judge(docs: DataFrame, weights: list[float], min_score: float = MIN_SCORE) -> DataFrame:
    """Base counts, score and verdict of each document."""
    scored = base_columns(docs).withColumn("score", llr_score(F.col("words"), weights)).drop("words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("score"), F.lit(0.0)) >= min_score)
    )


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    return sampled_ids(labels.where("quality = 1"), limit)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    weights = bucket_weights(docs, trusted_ids(labels))
    holder = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    held = docs.select(holder, F.col("doc_id"), F.col("text"))
    base = base_columns(held.select(F.col("row").alias("doc_id"), "text"))
    scored = base.withColumn("score", llr_score(F.col("words"), weights))
    good = (
        (F.col("n_words") >= MIN_WORDS)
        & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
        & (F.coalesce(F.col("score"), F.lit(0.0)) >= MIN_SCORE)
    )
    return where_here(scored, good).select("doc_id.*")

"""Lexical, vector and fused retrieval.

Postings hold (doc_id, term, weight, positions). An index is postings written in the order of terms, with the
document frequencies beside them: queries are small driver-side term lists, whose filter reaches the scan and
skips all row groups and pages of other terms. Ranking is a grouped aggregate and a top-k, never a sort of the
whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lodestrata.functions.similarity import cosine
from lodestrata.sources.lake import written_or_none

#: Words that are no terms.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
TOKEN = r"[^\p{L}\p{N}]+"
RRF_K = 60


def tokens(c: Column) -> Column:
    """Lower-case tokens in order, stop words kept as empty strings so that positions stand."""
    split = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), TOKEN, " ")), " ")
    return F.transform(split, lambda t: F.when(t.isin(*STOP_WORDS), "").otherwise(t))


def query_terms(q: str) -> list[str]:
    words = re.sub(r"[^\w]+|_", " ", q.lower()).split()
    return list(dict.fromkeys(w for w in words if w not in STOP_WORDS))


#: Positions of a field begin after those of the fields before it; tokens that a task groups at once.
FIELD_ROOM, TOKENS_AT_ONCE = 10_000_000, 500_000


def placed_terms(df: DataFrame, key: str, fields: dict[str, float], stem: bool = False) -> DataFrame:
    """key, term (its stem, if asked for), weight (the heaviest field that has it) and its positions in that order of fields.

    The terms of a row are grouped where the row is read, so what is shuffled later is a row for each term, not for each token.
    """
    lists = df.select(key, *[tokens(F.col(f)).alias(f"__t{k}") for k, f in enumerate(fields)])
    kind, weights, own = df.schema[key].dataType.simpleString(), np.array(list(fields.values()), np.float64), globals()["stem"]

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        words, rows, places = [], [], []
        for k in range(len(weights)):
            column = part.column(k + 1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            words.append(column.flatten().cast(pa.string()))
            rows.append(np.repeat(np.arange(len(sizes)), sizes))
            places.append(np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + k * FIELD_ROOM)
        coded = pa.concat_arrays(words).dictionary_encode()
        codes, row, place = coded.indices.to_numpy(zero_copy_only=False), np.concatenate(rows), np.concatenate(places)
        known = coded.dictionary.to_pylist()
        real = np.array([w != "" for w in known], bool)[codes]
        codes, row, place = codes[real].astype(np.int64), row[real], place[real]
        if stem:
            merged: dict[str, int] = {}
            codes = np.array([merged.setdefault(own(w), len(merged)) for w in known], np.int64)[codes]
            known = list(merged)
        order = np.lexsort((place, codes, row))
        codes, row, place = codes[order], row[order], place[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (np.diff(row) != 0) | (np.diff(codes) != 0)]))
        heaviest = np.maximum.reduceat(weights[place // FIELD_ROOM], first) if len(first) else np.zeros(0)
        ends = pa.array(np.append(first, len(place)).astype(np.int32))
        columns = [part.column(0).take(pa.array(row[first])), pa.array(known, pa.string()).take(pa.array(codes[first])), pa.array(heaviest), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, [key, "term", "weight", "positions"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(sum(batch.column(k + 1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(weights))))
            at = 0
            while at < len(batch):
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, "right")))
                yield of(batch.slice(at, until - at))
                at = until

    return lists.mapInArrow(group, f"`{key}` {kind}, term string, weight double, positions array<int>")


def postings(df: DataFrame, key: str, fields: dict[str, float], stem: bool = False) -> DataFrame:
    """placed_terms with the rows of a repeated key as one."""
    parts = placed_terms(df, key, fields, stem)
    if df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return parts
    return parts.groupBy(key, "term").agg(F.max("weight").alias("weight"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def by_term(posts: DataFrame, key: str, term: str = "term") -> DataFrame:
    """By hash of term and a part of the key: rows of a very frequent term lie in several files, each sorted by term. Unlike ranges, hashes need no first pass."""
    return posts.repartition(F.xxhash64(term), F.pmod(F.xxhash64(key), F.lit(4))).sortWithinPartitions(term, key)


class Index(NamedTuple):
    """Written postings, and terms (term, df): in how many documents each is."""

    posts: DataFrame
    terms: DataFrame

    def common(self, terms: list[str], n_docs: int, share: float = 0.02) -> set[str]:
        """Those of a query's terms that are in more than a share of the documents: too common to search for alone."""
        return {r.term for r in self.terms.where(F.col("term").isin(*terms) & (F.col("df") > share * n_docs)).collect()} if terms else set()


def index(posts: DataFrame, key: str, path: str) -> Index:
    """The index at path, built from postings where there is none yet.

    The terms are written last: an index without them was not finished, and is built anew.
    """
    spark = posts.sparkSession
    terms = written_or_none(spark, f"{path}/terms")
    if terms is None:
        by_term(posts, key).write.mode("overwrite").parquet(f"{path}/posts")
        counted = spark.read.parquet(f"{path}/posts").groupBy("term").agg(F.count("*").alias("df"))
        counted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        terms = spark.read.parquet(f"{path}/terms")
    return Index(spark.read.parquet(f"{path}/posts"), terms)


def match(posts: DataFrame, key: str, terms: list[str], all_of_them: bool) -> DataFrame:
    """key, how many of the terms it has, and its score: weights by term frequency, damped, closer terms counting more."""
    hits = posts.where(F.col("term").isin(*terms)) if terms else posts.limit(0)
    damped = F.col("weight") * (1 + F.log(F.size("positions").cast("double")))
    found = hits.groupBy(key).agg(
        F.count("*").alias("n_terms"), F.sum(damped).alias("damped"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("all")
    )
    # Cover density: the mean of 1 / gap between neighbouring hits.
    gaps = F.transform(F.sequence(F.lit(1), F.size("all") - 1), lambda i: 1.0 / F.greatest(F.lit(1), F.col("all")[i] - F.col("all")[i - 1]))
    near = F.when(F.size("all") > 1, F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / (F.size("all") - 1)).otherwise(0.0)
    scored = found.select(key, "n_terms", (F.col("damped") + near).alias("score"))
    return scored.where(F.col("n_terms") == len(terms)) if all_of_them else scored


def phrase(posts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Documents in which the terms follow each other."""
    found = None
    for i, t in enumerate(terms):
        one = posts.where(F.col("term") == t).select(key, F.explode("positions").alias("pos")).select(key, (F.col("pos") - i).alias("pos"))
        found = one if found is None else found.join(one, [key, "pos"], "left_semi")
    return found.select(key).distinct()


def knn(vectors: DataFrame, key: str, column: str, probe: list[float], limit: int, where: Column | None = None) -> DataFrame:
    """The nearest by cosine, exactly, among the rows that a filter leaves. Bounded output: a top-k."""
    held = vectors if where is None else vectors.where(where)
    target = F.array(*[F.lit(float(v)) for v in probe])
    return held.select(key, cosine(F.col(column), target).alias("score")).where("score is not null").orderBy(F.col("score").desc(), key).limit(limit)


def rrf(arms: dict[str, DataFrame], key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked arms (key, score): key, rrf, and the arm, or `both`."""
    by_score = W.orderBy(F.col("score").desc(), key)
    parts = [a.select(key, F.row_number().over(by_score).alias("rank"), F.lit(name).alias("arm")) for name, a in arms.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("rank").alias("best_rank"), F.when(F.count("*") > 1, "both").otherwise(F.min("arm")).alias("arm")
    )
    return fused.orderBy(F.col("rrf").desc(), "best_rank", key).limit(limit)


def _shape(word: str) -> str:
    """v for each vowel of a word and c for each consonant; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def porter_step1(word: str) -> str:
    """Plural, -ed, -ing and -y endings by the first step of Porter's stemmer (1980)."""
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + put
            break
    if word.endswith("eed"):
        return word[:-1] if "vc" in _shape(word[:-3]) else word
    for end in ("ed", "ing"):
        stem = word.removesuffix(end)
        shape = _shape(stem)
        if stem != word and "v" in shape:
            short = shape.count("vc") == 1 and shape.endswith("cvc") and stem[-1] not in "wxy"
            if stem.endswith(("at", "bl", "iz")) or short:
                word = stem + "e"
            elif shape.endswith("cc") and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                word = stem[:-1]
            else:
                word = stem
            break
    return word[:-1] + "i" if word.endswith("y") and "v" in _shape(word[:-1]) else word


def stem(word: str) -> str:
    """The first step, and the last one's final e: taxes, taxing and tax are one term."""
    word = porter_step1(word)
    shape = _shape(word[:-1])
    short = shape.endswith("cvc") and word[-2] not in "wxy"
    many = shape.count("vc")
    return word[:-1] if word.endswith("e") and (many > 1 or (many == 1 and not short)) else word


@F.pandas_udf(T.StringType())
def stemmed(words: pd.Series) -> pd.Series:
    """English analyzer: Arrow batches, each distinct word once."""
    known = {w: stem(w) for w in words.dropna().unique()}
    return words.map(known)

"""Written indexes: weighted stemmed postings with a query grammar, a dictionary for typos and prefixes, trigrams for substrings, cells for vectors.

An index is written under a name of its own and published by a small pointer beside it, so a builder that fails
publishes nothing, two builders don't meet, and no reader sees files go. Its folder is named by the version of the
table and by what the index is made of.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.similarity import cosine
from lodestrata.operators.search import FIELD_ROOM, STOP_WORDS, by_term, postings, query_terms, stem
from lodestrata.sources import lake



class Built(NamedTuple):
    """A published index: where its tables are, and how many rows of the table it was built from."""

    path: str
    rows: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def published(spark: SparkSession, table: str, recipe: object, build: Callable[[str], int]) -> Built:
    """The index of a table's current files by a recipe, built if there is none. build(path) writes its tables and returns how many rows it has read."""
    name = hashlib.sha1(repr(recipe).encode()).hexdigest()[:12]
    place = f"{lake.shared_dir(spark)}/index-{name}-{lake.version(spark, table)}"
    schema = "path string, rows long"

    def first() -> Built | None:
        pointers = lake.written_or_none(spark, f"{place}/pointer-*", schema)
        row = None if pointers is None else pointers.orderBy("path").first()
        return None if row is None else Built(row.path, row.rows)

    found = first()
    if found is None:
        own = f"{place}/data-{uuid.uuid4().hex}"
        rows = build(own)
        spark.range(1).select(F.lit(own).alias("path"), F.lit(rows).cast("long").alias("rows")).coalesce(1).write.parquet(f"{place}/pointer-{uuid.uuid4().hex}")
        found = first()
    return found


# ---- words ---------------------------------------------------------------------------------------------------------


class Words(NamedTuple):
    """Weighted fields, in order, and whether terms are stemmed: what postings are made of."""

    fields: tuple[tuple[str, float], ...]
    stem: bool = True

    def term(self, word: str) -> str:
        return stem(word) if self.stem else word


def word_index(df: DataFrame, key: str, words: Words, table: str) -> Built:
    """Postings in the order of terms (key, term and hits: position and weight, in order of position), and terms with their document counts."""

    def build(path: str) -> int:
        weights = F.array(*[F.lit(float(w)) for _, w in words.fields])
        hit = lambda p: F.struct(p.alias("pos"), F.get(weights, F.floor(p / FIELD_ROOM).cast("int")).alias("weight"))
        # Positions alone are shuffled; what they weigh is told by their field.
        posts = by_term(postings(df, key, dict(words.fields), words.stem), key)
        posts.select(key, "term", F.transform("positions", hit).alias("hits")).write.parquet(f"{path}/posts")
        spark = df.sparkSession
        spark.read.parquet(f"{path}/posts").groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")
        return df.count()

    return published(df.sparkSession, table, (key, *words), build)


class Leaf(NamedTuple):
    """One term, or several that follow each other; negated or not."""

    terms: tuple[str, ...]
    negated: bool


def parsed(q: str, words: Words) -> list[list[Leaf]]:
    """A query as alternatives of leaves that must all hold. Quotes make phrases, `or` alternatives, a minus negates what follows it.

    A quotation mark without its partner quotes the rest. Words of several parts are phrases. What has no term (stop words, punctuation) is left out,
    and so is an `or` that has nothing on one side.
    """
    ways: list[list[Leaf]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)(?:"|$)|(\S+)', q):
        word = m[3]
        if word is not None and word.lower() == "or":
            ways.append([])
            continue
        negated = bool(m[1]) if word is None else word.startswith("-")
        raw = m[2] if word is None else word
        terms = tuple(words.term(t) for t in re.sub(r"[^\w]+|_", " ", raw.lower()).split() if t not in STOP_WORDS)
        if terms:
            ways[-1].append(Leaf(terms, negated))
    return [w for w in ways if w]


def _back(k: int) -> Callable[[Column], Column]:
    return lambda place: place - k


def _follow(hits: Column, terms: tuple[str, ...]) -> Column:
    """Whether the terms stand one after another. hits: map of terms to their hits."""
    places = [F.transform(F.try_element_at(hits, F.lit(t)), lambda h: h["pos"]) for t in terms]
    here = places[0]
    for k, other in enumerate(places[1:], 1):
        here = F.array_intersect(here, F.transform(other, _back(k)))
    return F.coalesce(F.size(here) > 0, F.lit(False))


def grammar_search(posts: DataFrame, keys: DataFrame, key: str, ways: list[list[Leaf]]) -> DataFrame:
    """The keys that a parsed query matches: one scan of the postings of its terms, one grouping. Alternatives of negated leaves alone start from all keys."""
    terms = sorted({t for way in ways for leaf in way for t in leaf.terms})
    if not terms:
        return keys.select(key).limit(0)
    found = posts.where(F.col("term").isin(*terms)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "hits"))).alias("hits"))
    if any(all(leaf.negated for leaf in way) for way in ways):
        found = keys.select(key).join(found, key, "left").withColumn("hits", F.coalesce("hits", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<struct<pos:int,weight:double>>>"))))
    hits, matches = F.col("hits"), F.lit(False)
    for way in ways:
        holds = F.lit(True)
        for leaf in way:
            has = F.map_contains_key(hits, leaf.terms[0]) if len(leaf.terms) == 1 else _follow(hits, leaf.terms)
            holds = holds & (~has if leaf.negated else has)
        matches = matches | holds
    return found.where(matches).select(key)


def cover_density(hits: Column, n_terms: int) -> Column:
    """Sum over the minimal covers (shortest stretches that hold all terms) of their harmonic mean weight over one plus the other words in between.

    hits: (pos, term number, weight) in order of position. One fold: of each term the last place is kept; a stretch ends where the earliest of them moves on.
    """
    state = F.struct(
        F.array_repeat(F.lit(-1), n_terms).alias("last"), F.array_repeat(F.lit(0.0), n_terms).alias("inverse"), F.lit(-1).alias("left"), F.lit(0.0).alias("sum")
    )

    def step(s: Column, h: Column) -> Column:
        last = F.transform(s["last"], lambda x, i: F.when(i == h["term"], h["pos"]).otherwise(x))
        inverse = F.transform(s["inverse"], lambda x, i: F.when(i == h["term"], 1.0 / h["weight"]).otherwise(x))
        left = F.array_min(last)
        mean = n_terms / F.aggregate(inverse, F.lit(0.0), lambda a, b: a + b)
        covers = left > s["left"]
        found = F.when(covers, mean / (1.0 + (h["pos"] - left) - (n_terms - 1))).otherwise(0.0)
        return F.struct(last.alias("last"), inverse.alias("inverse"), F.greatest(left, s["left"]).alias("left"), (s["sum"] + found).alias("sum"))

    return F.aggregate(hits, state, step, lambda s: s["sum"])


def ranked(posts: DataFrame, key: str, terms: list[str], all_of_them: bool) -> DataFrame:
    """key, n_terms and score, at most 0.99: a quarter of the cover density of all terms, or where any will do, of each hit alone."""
    if not terms:
        return posts.select(key, F.lit(0).cast("long").alias("n_terms"), F.lit(0.0).alias("score")).limit(0)
    numbers = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*map(F.lit, range(len(terms)))))
    numbered = F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), F.element_at(numbers, F.col("term")).alias("term"), h["weight"].alias("weight")))
    found = posts.where(F.col("term").isin(*terms)).select(key, numbered.alias("hits")).groupBy(key)
    found = found.agg(F.count("*").alias("n_terms"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    if all_of_them:
        score = cover_density(F.col("hits"), len(terms))
        found = found.where(F.col("n_terms") == len(terms))
    else:
        score = F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["weight"])
    return found.select(key, "n_terms", F.least(score / 4, F.lit(0.99)).alias("score"))


def keyword_search(built: Built, spark: SparkSession, key: str, q: str, words: Words, share: float = 0.02) -> DataFrame:
    """Any of the query's terms that are in no more than a share of the rows; all of its terms where none is left."""
    terms = list(dict.fromkeys(words.term(w) for w in query_terms(q)))
    kept = terms
    if terms:
        common = built.table(spark, "terms").where(F.col("term").isin(*terms) & (F.col("df") > share * built.rows)).select("term").collect()  # a query's terms at most
        kept = [t for t in terms if t not in {r.term for r in common}]
    posts = built.table(spark, "posts")
    return ranked(posts, key, kept, False) if kept else ranked(posts, key, terms, True)


# ---- typos and prefixes --------------------------------------------------------------------------------------------

TYPO_LENGTH = 4


def shortened(word: Column) -> Column:
    """A word and what is left of it without one letter: two words one edit apart have one of these in common."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.array_append(cut, word))


def fuzzy_index(df: DataFrame, key: str, fields: dict[str, int], recency: str, table: str) -> Built:
    """hits (term, key, weight of its heaviest field, recency) in the order of terms; and near (form, term): each distinct term by what is left of it."""

    def build(path: str) -> int:
        parts = None
        for field, weight in fields.items():
            one = df.select(key, F.col(recency).alias("recency"), F.explode(F.split(F.lower(field), "[^a-z0-9]+")).alias("term"), F.lit(weight).alias("weight")).where("term <> ''")
            parts = one if parts is None else parts.unionByName(one)
        hits = parts.groupBy("term", key).agg(F.max("weight").alias("weight"), F.max("recency").alias("recency"))
        hits.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/hits")
        spark = df.sparkSession
        terms = spark.read.parquet(f"{path}/hits").select("term").distinct()
        near = terms.select(F.explode(shortened(F.col("term"))).alias("form"), "term")
        near.repartitionByRange("form").sortWithinPartitions("form").write.parquet(f"{path}/near")
        return df.count()

    return published(df.sparkSession, table, ("fuzzy", key, tuple(fields.items()), recency), build)


def _shortened(word: str) -> list[str]:
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def fuzzy_search(built: Built, spark: SparkSession, key: str, q: str) -> DataFrame:
    """key, score and recency of the rows that have all words of a query, best first: each word counts by its heaviest field, twice if it is there as asked.

    Words of four letters and more may be one edit off; the last word may be the beginning of one. Candidates come by equal forms and by a range of
    terms, so only the dictionary's few candidates are compared letter by letter.
    """
    hits, near = built.table(spark, "hits"), built.table(spark, "near")
    words = re.findall(r"[a-z0-9]+", q.lower())
    found = None
    for i, w in enumerate(words):
        exact = hits.where(F.col("term") == w).select(key, "recency", (2 * F.col("weight")).alias("m"))
        ways = [exact]
        if len(w) >= TYPO_LENGTH:
            close = near.where(F.col("form").isin(*_shortened(w))).where((F.levenshtein("term", F.lit(w), 1) >= 0) & (F.col("term") != w)).select("term").distinct()
            ways.append(hits.join(close, "term").select(key, "recency", F.col("weight").alias("m")))
        if i == len(words) - 1:
            begun = (F.col("term") > w) & (F.col("term") < w + "\U0010ffff")
            ways.append(hits.where(begun).select(key, "recency", F.col("weight").alias("m")))
        one = ways[0]
        for way in ways[1:]:
            one = one.unionByName(way)
        one = one.groupBy(key).agg(F.max("m").alias(f"m{i}"), F.max("recency").alias("recency"))
        found = one if found is None else found.join(one.drop("recency"), key)
    if found is None:
        return hits.select(key, F.lit(0).cast("long").alias("score"), "recency").limit(0)
    total = sum((F.col(f"m{i}") for i in range(len(words))), F.lit(0))
    return found.select(key, total.cast("long").alias("score"), "recency").orderBy(F.col("score").desc(), F.col("recency").desc(), key)


# ---- substrings ----------------------------------------------------------------------------------------------------


#: Characters of text that a task takes apart at once.
CHARACTERS_AT_ONCE = 500_000


def trigram_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """gram and keys: the distinct runs of three characters of texts in lower case, each with those of a few hundred neighbouring rows that have it."""
    kind = df.schema[key].dataType.simpleString()

    def block(keys: list[int], texts: list[str], column: pa.Array) -> pa.RecordBatch:
        found = [{s[i : i + 3] for i in range(len(s) - 2)} for s in texts]
        coded = pa.array([g for grams in found for g in grams], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]).astype(np.int32)
        rows = np.repeat(np.array(keys, np.int64), [len(grams) for grams in found])[order]
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(ends), column.take(pa.array(rows)))], ["gram", "keys"])

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for i, s in enumerate(batch.column(1)):
                text = s.as_py() or ""
                if size + len(text) > CHARACTERS_AT_ONCE and texts:
                    yield block(keys, texts, batch.column(0))
                    keys, texts, size = [], [], 0
                keys.append(i)
                texts.append(text)
                size += len(text)
            if texts:
                yield block(keys, texts, batch.column(0))

    return df.select(key, F.lower(column).alias("text")).mapInArrow(take_apart, f"gram string, keys array<{kind}>")


def trigram_index(df: DataFrame, key: str, column: str, table: str) -> Built:
    """grams (gram, keys) in the order of grams, a gram in several rows."""

    def build(path: str) -> int:
        by_term(trigram_blocks(df, key, column), "keys", "gram").write.parquet(f"{path}/grams")
        return df.count()

    return published(df.sparkSession, table, ("trigram blocks", key, column), build)


def substring_search(built: Built, df: DataFrame, key: str, column: str, wanted: str) -> DataFrame:
    """The keys of the rows whose text has `wanted` in it, whatever its case. Rows that lack one of its trigrams aren't looked at; under three letters all are."""
    low = wanted.lower()
    has = F.contains(F.lower(column), F.lit(low))
    if len(low) < 3:
        return df.where(has).select(key)
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    own = built.table(df.sparkSession, "grams").where(F.col("gram").isin(*grams)).select("gram", F.explode("keys").alias("__key")).distinct()
    held = own.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return df.join(held, F.col(key).eqNullSafe(F.col("__key")), "left_semi").where(has).select(key)


# ---- vectors -------------------------------------------------------------------------------------------------------

#: Vectors that cells are learned from at most, rounds of learning, cells at most.
LEARNED_FROM, LEARNING_ROUNDS, MOST_CELLS = 20_000, 8, 1_024


def _units(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def learned_cells(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Unit centres of n cells by k-means on the sphere."""
    rng, units = np.random.default_rng(seed), _units(sample)
    centres = units[rng.choice(len(units), n, replace=False)]
    for _ in range(LEARNING_ROUNDS):
        cell = (units @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, units)
        held = np.bincount(cell, minlength=n) > 0
        centres = np.where(held[:, None], _units(sums), centres)
    return centres


def vector_index(df: DataFrame, key: str, column: str, table: str, cells: int | None = None) -> Built:
    """vectors, a folder for each cell, and cells (cell, centre, radius: the widest distance of a unit vector in it from its centre).

    Centres are learned on a sample of at most LEARNED_FROM rows, chosen by hash; every row that has a vector is indexed.
    """

    def build(path: str) -> int:
        spark = df.sparkSession
        held = df.where(F.col(column).isNotNull() & (F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x) > 0))
        rows = held.count()
        sample = held.select(F.col(column).alias("v"), F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(LEARNED_FROM).select("v").toPandas()
        if not len(sample):
            held.withColumn("cell", F.lit(0)).write.parquet(f"{path}/vectors")
            spark.createDataFrame([], "cell int, centre array<double>, radius double").write.parquet(f"{path}/cells")
            return rows
        centres = learned_cells(np.stack(sample["v"].to_list()).astype(np.float64), min(len(sample), cells or MOST_CELLS, max(1, round(math.sqrt(rows)))))

        @F.pandas_udf("cell int, away double")
        def placed(vectors: pd.Series) -> pd.DataFrame:
            units = _units(np.stack(vectors.to_list()).astype(np.float64))
            cell = (units @ centres.T).argmax(1)
            return pd.DataFrame({"cell": cell.astype("int32"), "away": np.linalg.norm(units - centres[cell], axis=1)})

        dealt = held.withColumn("p", placed(column)).select(*df.columns, "p.cell", "p.away")
        dealt.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        widest = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(F.max("away").alias("radius"))
        known = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        widest.join(known, "cell").select("cell", "centre", "radius").coalesce(1).write.parquet(f"{path}/cells")
        return rows

    return published(df.sparkSession, table, ("vectors", key, column, cells), build)


def nearest(built: Built, spark: SparkSession, key: str, column: str, probe: list[float], limit: int, probes: int | None = None) -> DataFrame:
    """key and score (cosine) of the nearest rows. With `probes`, the nearest so many cells are read; else as many as it takes to be exact.

    No vector of a cell is nearer than its centre's distance less its radius: cells beyond the last one found so far are not read. The
    cells' table has MOST_CELLS rows at most.
    """
    cells = built.table(spark, "cells").toPandas()
    if not len(cells):
        return built.table(spark, "vectors").select(key, F.lit(0.0).alias("score")).limit(0)
    unit = _units(np.asarray(probe, np.float64)[None])[0]
    centres = np.stack(cells["centre"].to_list())
    away = np.linalg.norm(centres - unit, axis=1)
    order = np.argsort(away, kind="stable")
    vectors, target = built.table(spark, "vectors"), F.array(*[F.lit(float(v)) for v in probe])

    def best(chosen: np.ndarray) -> DataFrame:
        held = vectors.where(F.col("cell").isin(*cells["cell"].to_numpy()[chosen].tolist()))
        return held.select(key, cosine(F.col(column), target).alias("score")).orderBy(F.col("score").desc(), key).limit(limit)

    if probes is not None:
        return best(order[:probes])
    least = away - cells["radius"].to_numpy() - 1e-6
    n = max(1, len(order) // 16)
    while True:
        found = best(order[:n]).collect()  # at most `limit` rows
        if len(found) == limit:
            last = math.sqrt(max(0.0, 2 - 2 * found[-1].score)) + 1e-6
            wanted = np.union1d(order[:n], np.flatnonzero(least <= last))
            return best(wanted)
        if n >= len(order):
            return best(order)
        n = min(len(order), 4 * n)

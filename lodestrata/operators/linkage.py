"""Linking records to their published versions: candidates by sets of shared authors and rare terms, then a gate on authors and a weighted score."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.sources import lake

#: Share of a record's authors that a candidate must have, weights of authors and content, and the least score of a match.
GATE, AUTHORS, CONTENT, LEAST = 0.6, 0.6, 0.4, 0.62
#: A set of authors of more works of like sizes than this is compared in cells, unless it is asked for nearly all terms.
FREQUENT = 1_000
#: Authors of a set at most, and of a record of more than WIDE authors; a work of more than MANY authors meets by single ones.
TOGETHER, WIDE_TOGETHER, WIDE, MANY = 5, 3, 8, 12
#: Records, and works, of a cell.
BLOCK = 512


def _jaccard(a: str, b: str) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def score(authors: str, title: str, their_authors: str, their_title: str, their_abstract: str) -> Column:
    """0.6 of the shared authors and 0.4 of the shared terms; 0 where too few authors are shared, whatever the terms. All are arrays of distinct values."""
    shared = F.size(F.array_intersect(authors, their_authors)) / F.size(authors)
    content = F.least(0.5 * _jaccard(title, their_title) + _jaccard(title, their_abstract), F.lit(1.0))
    return F.when((F.size(authors) > 0) & (shared >= GATE), AUTHORS * shared + CONTENT * content).otherwise(0.0)


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = f"{lake.shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sets(authors: Column, size: int, space: int) -> Column:
    """key and last (the highest rank in it) of each set of so many authors. authors: (h, rank) in the order of h."""

    def below(held: Column, taken: tuple[Column, ...]) -> Column:
        if len(taken) + 1 == size:
            key = lambda x: F.xxhash64(F.lit(space), *[y["h"] for y in (x, *taken)])
            last = lambda x: F.greatest(x["rank"], *[y["rank"] for y in taken]) if taken else x["rank"]
            return F.transform(held, lambda x: F.struct(key(x).alias("key"), last(x).alias("last")))
        return F.flatten(F.transform(held, lambda x, i: below(F.slice(held, F.lit(1), i), (x, *taken))))

    return below(authors, ())


def _ranked(own: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """rid, the name's hash h, df and rank, the rarest first."""
    counted = own.join(counts, name, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    return counted.select("rid", F.xxhash64(name).alias("h"), "df", F.row_number().over(W.partitionBy("rid").orderBy("df", name)).alias("rank"))


def _like(n: Column) -> Column:
    """1, 2, 3, 4, 6, 8, 12, 16 and so on: the greatest that is not above n."""
    p = F.pow(F.lit(2), F.length(F.bin(n)) - 1).cast("long")
    return F.when(n < 2, n.cast("long")).otherwise(p + F.when(2 * n >= 3 * p, (p / 2).cast("long")).otherwise(F.lit(0)))


def _at_most(o: Column, n: Column, least: str, most: str) -> Column:
    """The greatest Jaccard index of a set of n terms and one of least to most terms that share up to o."""
    m = F.least(o, F.col(most))
    return F.when(n + F.greatest(F.col(least) - m, F.lit(0)) > 0, m / (n + F.greatest(F.col(least) - m, F.lit(0)))).otherwise(0.0)


def _ones(texts: pd.Series, known: pd.Index) -> np.ndarray:
    """A row for each set, a column for each known term."""
    sizes = texts.map(len).to_numpy()
    at = known.get_indexer(np.concatenate([*texts, []]).astype(object))
    rows = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros((len(texts), len(known)), np.float32)
    out[rows[at >= 0], at[at >= 0]] = 1
    return out


def _best_of_cell(records: pd.DataFrame, works: pd.DataFrame) -> pd.DataFrame:
    """score() of all records of a cell with all its works; each record's best, the least work of equal ones."""
    if not len(records) or not len(works):
        return pd.DataFrame({"rid": [], "score": [], "work": []})
    works = works.sort_values("work")
    size = lambda texts: texts.map(len).to_numpy().astype(np.float64)

    def shared(ours: str, *theirs: str) -> list[np.ndarray]:
        known = pd.Index(np.concatenate([*records[ours], []]).astype(object)).unique()
        held = _ones(records[ours], known)
        return [(held @ _ones(works[c], known).T).astype(np.float64) for c in theirs]

    in_title, in_abstract = shared("title", "w_title", "w_abstract")
    n, asked = size(records["authors"])[:, None], size(records["title"])[:, None]
    share = shared("authors", "w_authors")[0] / n
    jaccard = lambda both, theirs: both / np.maximum(asked + theirs - both, 1.0)
    content = np.minimum(0.5 * jaccard(in_title, size(works["w_title"])) + jaccard(in_abstract, size(works["w_abstract"])), 1.0)
    scores = np.where(share >= GATE, AUTHORS * share + CONTENT * content, 0.0)
    first = scores.argmax(1)
    best = pd.DataFrame({"rid": records["rid"].to_numpy(), "score": scores[np.arange(len(scores)), first], "work": works["work"].to_numpy()[first]})
    return best[best["score"] >= LEAST]


def _in_cells(ours: DataFrame, theirs: DataFrame, mine: DataFrame, works: DataFrame) -> DataFrame:
    """rid, score and work: the best of each cell. ours (rid, key) and theirs (wid, key) meet by key, in blocks of both, so that no task grows with a key."""
    blocks = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias(name))
    n_blocks = blocks(ours, "n_r").join(blocks(theirs, "n_w"), "key")
    block = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).alias
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias
    left = ours.join(n_blocks, "key").select("rid", "key", block("rid", "n_r")("rb"), every("n_w")("wb")).join(mine, "rid")
    right = theirs.join(n_blocks, "key").select("wid", "key", block("wid", "n_w")("wb"), every("n_r")("rb")).join(works, "wid").drop("wid")
    cell = ["key", "rb", "wb"]
    kind = works.schema["work"].dataType.simpleString()
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(_best_of_cell, f"rid long, score double, work {kind}")


def published_versions(records: DataFrame, works: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """id, work and score of each record's best work that reaches LEAST; of equal ones the least work.

    records: id, authors, title. works: work, authors, title, abstract. authors, title and abstract are arrays of distinct terms; no column may be null.

    Equal records, and equal works, are compared once. Records and works meet by sets of authors: a pair that shares s of a record's n authors meets by those s, or by the
    rarest TOGETHER of them, which are among the record's n - s + TOGETHER rarest. What s authors lack to LEAST the terms must give: for works of like sizes that asks
    for o of the title's terms in the work's title or abstract, and for some in its title. So one of the title's rarest but o - 1 is among them, and they meet
    by set and term together. Where few terms are enough and many works have the set, all that have it are compared, in cells. Every pair that can match does meet.
    """
    sets = [F.array_sort(c).alias(c) for c in ("authors", "title")]
    # Authors alone don't reach LEAST.
    asked = records.where((F.size("authors") > 0) & (F.size("title") > 0)).select("id", *sets)
    mine = _written(asked.select("authors", "title").distinct().select(F.monotonically_increasing_id().alias("rid"), "authors", "title"), "link-records")
    held = works.where(F.size("authors") > 0).groupBy(*sets, F.array_sort("abstract").alias("abstract")).agg(F.min("work").alias("work"))
    theirs = _written(held.select(F.monotonically_increasing_id().alias("wid"), "work", "authors", "title", "abstract"), "link-works")
    in_works = theirs.select("wid", F.explode(F.array_union("title", "abstract")).alias("term"))
    count = lambda df, name: df.groupBy(name).agg(F.count("*").alias("df"))
    names = _ranked(mine.select("rid", F.explode("authors").alias("author")), "author", count(theirs.select(F.explode("authors").alias("author")), "author"))
    terms = _written(_ranked(mine.select("rid", F.explode("title").alias("term")), "term", count(in_works, "term")).where("df > 0").drop("df"), "link-terms")

    n, last, n_terms = F.size("authors"), F.col("k.last"), F.col("n_terms")
    gate, wide = F.ceil(F.lit(GATE) * n - 1e-9), n > WIDE
    dealt = names.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("h", "rank"))).alias("authors")).join(mine.select("rid", F.size("title").alias("n_terms")), "rid")
    dealt = _written(dealt, "link-authors")

    def keyed(own: DataFrame, size: int, space: int, least: Column, exactly: bool) -> DataFrame:
        """The sets of so many authors by which works meet that share at least so many; and how many those share at most."""
        most = F.lit(size) if exactly else n + size - last
        one = own.select("rid", "authors", "n_terms", F.explode(_sets(F.col("authors"), size, space)).alias("k")).where(last <= n - least + size)
        return one.select("rid", "k.key", "n_terms", n.alias("n_authors"), most.alias("most"))

    keys = keyed(dealt, 1, 0, gate, False)  # for works of many
    for size in range(1, TOGETHER):
        keys = keys.unionByName(keyed(dealt.where(~wide & (gate <= size) & (n >= size)), size, size, F.lit(size), True))
    keys = keys.unionByName(keyed(dealt.where(~wide & (n >= TOGETHER)), TOGETHER, TOGETHER, F.greatest(gate, F.lit(TOGETHER)), False))
    keys = _written(keys.unionByName(keyed(dealt.where(wide), WIDE_TOGETHER, WIDE_TOGETHER, gate, False)), "link-keys")

    hashed = F.array_sort(F.transform("authors", lambda a: F.struct(F.xxhash64(a).alias("h"), F.lit(0).alias("rank"))))
    few = F.concat(*[_sets(hashed, size, size) for size in range(1, TOGETHER + 1)])
    sizes = [F.size("title").alias("n_t"), F.size("abstract").alias("n_a")]
    sets_of = theirs.select("wid", *sizes, F.explode(F.when(n > MANY, _sets(hashed, 1, 0)).otherwise(few)).alias("k")).select("wid", "n_t", "n_a", "k.key")
    like = F.struct(_like(F.col("n_t")).alias("t"), _like(F.col("n_a")).alias("a"))
    meet = _written(sets_of.join(keys.select("key").distinct(), "key", "left_semi").withColumn("like", like), "link-meet")
    groups = meet.groupBy("key", "like").agg(F.count("*").alias("n"))
    # What is asked depends on few numbers, so it is found once for each of them.
    likes = meet.groupBy("like").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("n_t", "n_a")])
    lack = (LEAST - AUTHORS * F.col("most") / F.col("n_authors")) / CONTENT - 1e-9
    in_title, in_abstract = lambda o: _at_most(o, n_terms, "min_n_t", "max_n_t"), lambda o: _at_most(o, n_terms, "min_n_a", "max_n_a")
    first = lambda given: F.get(F.filter(F.sequence(F.lit(1), n_terms), given), F.lit(0))
    shared = first(lambda o: 0.5 * in_title(o) + in_abstract(o) >= lack)
    titled = F.when(in_abstract(n_terms) >= lack, 0).otherwise(first(lambda o: 0.5 * in_title(o) + in_abstract(n_terms) >= lack))
    needs = keys.select("most", "n_authors", "n_terms").distinct().crossJoin(likes)
    needs = needs.select("most", "n_authors", "n_terms", "like", shared.alias("shared"), titled.alias("titled")).where("shared is not null and titled is not null")
    asks = keys.join(groups, "key").join(needs, ["most", "n_authors", "n_terms", "like"])
    asks = _written(asks.select("rid", "key", "like", "n", "n_terms", "shared", "titled"), "link-asks")

    few_works, one_term = F.col("n") <= frequent, F.col("shared") <= 1
    seldom = asks.where(few_works & one_term).select("rid", "key", "like").join(meet, ["key", "like"]).select("rid", "wid")
    # A work has fewer terms in its title than in all, but the title may ask for fewer of them.
    by_title = F.when(few_works, F.col("titled") > 0).otherwise(F.col("titled") >= F.col("shared"))
    ranked = asks.withColumn("by_title", by_title).withColumn("asked", F.when(F.col("by_title"), F.col("titled")).otherwise(F.col("shared")))
    # Where a quarter of the terms would be tried, near copies meet by each that they share: cells compare them once.
    in_cells = ~few_works & (4 * F.col("asked") <= 3 * n_terms) | ~few_works & one_term
    ours = _written(ranked.where(in_cells).select("rid", "key", "like"), "link-cells")
    ranked = ranked.where(~in_cells & ~one_term)
    ranked = ranked.join(terms, "rid").where(F.col("rank") <= n_terms - F.col("asked") + 1).select("rid", "key", "like", "by_title", "h")

    def met(by_title: bool) -> DataFrame:
        own = ranked.where(F.col("by_title") == by_title)
        their_terms = theirs.select("wid", F.explode("title").alias("term")) if by_title else in_works
        there = meet.join(own.select("key", "like").distinct(), ["key", "like"], "left_semi").select("wid", "key", "like")
        return own.join(there.join(their_terms.select("wid", F.xxhash64("term").alias("h")), "wid"), ["key", "like", "h"]).select("rid", "wid")

    pairs = _written(seldom.unionByName(met(True)).unionByName(met(False)).distinct(), "link-pairs")
    full = theirs.select("wid", "work", *[F.col(c).alias(f"w_{c}") for c in ("authors", "title", "abstract")])
    both = pairs.join(mine, "rid").join(full, "wid")
    scored = both.select("rid", score("authors", "title", "w_authors", "w_title", "w_abstract").alias("score"), "work").where(F.col("score") >= LEAST)
    compared = meet.join(ours.select("key", "like").distinct(), ["key", "like"], "left_semi").select("wid", "key")
    scored = scored.unionByName(_in_cells(ours.select("rid", "key").distinct(), compared, mine, full))
    best = scored.groupBy("rid").agg(F.min(F.struct((-F.col("score")).alias("s"), "work")).alias("best"))
    found = asked.join(mine.join(best, "rid").select("authors", "title", "best"), ["authors", "title"])
    return found.groupBy("id").agg(F.min("best").alias("best")).select("id", F.col("best.work").alias("work"), (-F.col("best.s")).alias("score"))

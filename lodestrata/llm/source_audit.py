"""Divergence between the sources of a language, over a cube of (group block, group block, term block) cells.

A group is a source within a language; its share of a term is p = 1 + floor(1e9 (count + 1) / (N + V)), N the group's
occurrences of the V terms that the language keeps. How far a group is from another one (or from its language), whose shares
are q, is the sum over terms of floor((p - q) (p - q) / q).

The sum over all terms of all pairs of groups is cut along three axes. Groups of a language are dealt into blocks of about
`GROUP_BLOCK`, its kept terms into blocks of about `TERM_BLOCK`. A slice is the counts of a group block in a term block; it is
sent to the cells that need it, one for each other group block. A cell's task lays both slices out as matrices of bounded
size, computes the partial divergences of all its pairs both ways, and Spark adds them up along the term axis. So neither a language with
very many sources, nor one with very many terms, nor a source that holds most of the text makes a large task.

All arithmetic is in whole numbers. Shares are divided in three steps of a thousand, so that counts up to 9e15 are exact.

Defined cases: null text, language and source are empty. Groups without terms have counts of 0, and a language that keeps no terms
has divergences of 0. Repeated rows are documents of their own. Extra columns are ignored; an empty table gives no
rows. A long text is read in spans and stays one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.llm.common import materialize, small_side
from lodestrata.llm.packing import portions

#: Documents of a language that a kept term is in at least, and terms that are told of each group.
LEAST_DOCS, TOP = 3, 200
#: Groups and terms of a block, about.
GROUP_BLOCK, TERM_BLOCK = 32, 4_096
#: Bytes of text that a task works on at once.
TEXT_BYTES = 8_000_000

#: Bytes of UTF-8 as parts of terms: A-Z lower-cased, other ASCII but letters is space between terms, the rest stays.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the code of each occurrence in order, and the text that it is in."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    plain = _BYTES[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
    same = pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(plain)], offset=texts.offset)
    split = pc.ascii_split_whitespace(same)
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy(zero_copy_only=False)))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return pa.array([], pa.string()), codes, owner
    filled = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]  # a text's ends leave empty strings
    return coded.dictionary, codes[filled], owner[filled]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences there) and docs (how many documents there have it). docs: lang, source, text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                groups = pa.Table.from_batches([part.select(["lang", "source"])])
                keys = groups.group_by(["lang", "source"], use_threads=False).aggregate([])
                lookup = {(r["lang"], r["source"]): i for i, r in enumerate(keys.to_pylist())}
                group = np.array([lookup[r["lang"], r["source"]] for r in groups.to_pylist()], np.int64)
                held: list[pa.Array] = []
                for texts in spans:
                    words, codes, owner = terms_of(texts)
                    size = max(1, len(words))
                    in_doc, often = np.unique(owner * size + codes, return_counts=True)
                    who, code = np.divmod(in_doc, size)
                    cell, inverse = np.unique(group[who] * size + code, return_inverse=True)
                    n = np.bincount(inverse, weights=often, minlength=len(cell)).astype(np.int64)
                    docs = np.bincount(inverse, minlength=len(cell)).astype(np.int64)
                    yield _counted(keys, words, *np.divmod(cell, size), n, docs if len(spans) == 1 else docs * 0)
                    if len(spans) > 1:
                        held.append(words.take(pa.array(np.unique(code))))
                if held:  # a long text: a term of several spans is in one document
                    own = pa.concat_arrays(held).unique()
                    one = np.ones(len(own), np.int64)
                    yield _counted(keys, own, one * group[0], np.arange(len(own)), one * 0, one)

    schema = "lang string, source string, term string, n long, docs long"
    return docs.mapInArrow(count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(keys: pa.Table, words: pa.Array, group: np.ndarray, code: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    at = pa.array(group)
    columns = [keys.column(c).combine_chunks().take(at) for c in ("lang", "source")]
    return pa.RecordBatch.from_arrays([*columns, words.take(pa.array(code)), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def share(count: str, total: str) -> Column:
    """1 + floor(1e9 (count + 1) / total) of two columns, in whole numbers; count < total."""
    whole, rest = "0L", f"({count} + 1)"
    for _ in range(3):
        whole, rest = f"({whole} * 1000 + {rest} * 1000 div {total})", f"({rest} * 1000 % {total})"
    return F.expr(f"{whole} + 1")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """share() of a matrix of counts, a row for each group."""
    whole, rest = np.zeros(counts.shape, np.int64), counts + 1
    for _ in range(3):
        part, rest = np.divmod(rest * 1000, totals[:, None])
        whole = whole * 1000 + part
    return whole + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row: the sum over the terms of floor((p - q)^2 / q), for each row of p against each row of q."""
    return np.stack([((row - q) ** 2 // q).sum(1) for row in p]) if len(p) else np.zeros((0, len(q)), np.int64)


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences, both ways, of all pairs of groups of one cell; rows: its one or two slices."""
    slices, cross = [], rows["low"].iloc[0] != rows["high"].iloc[0]
    for r in rows.itertuples():
        totals = np.asarray(r.totals, np.int64)
        counts = np.zeros((len(totals), r.width), np.int64)
        if r.n is not None:
            counts[np.asarray(r.who, np.int64) - 1, np.asarray(r.slot, np.int64) - 1] = np.asarray(r.n, np.int64)
        slices.append((r.gb, shares(counts, totals)))
    out = []
    for a, p in slices:
        for b, q in slices:
            if (a != b) == cross:
                found = divergences(p, q)
                g, h = np.indices(found.shape)
                out.append(pd.DataFrame({"gb": a, "who": g.ravel() + 1, "other_gb": b, "other": h.ravel() + 1, "value": found.ravel()}))
    if not out:  # a block without groups
        return pd.DataFrame({"lang": pd.Series(dtype=object), **{c: pd.Series(dtype="int64") for c in ("gb", "who", "other_gb", "other", "value")}})
    made = pd.concat(out)
    made.insert(0, "lang", rows["lang"].iloc[0])
    return made


def pair_values(counts: DataFrame, groups: DataFrame, n_groups: int, terms: DataFrame) -> DataFrame:
    """lang, gb, who, other_gb, other and value of all pairs of groups of each language that keeps terms.

    counts: lang, source, term, n. groups: lang, source, gb, gbs, who, total. terms: lang, term, tb, slot.
    """
    blocks = groups.groupBy("lang", "gb").agg(
        F.first("gbs").alias("gbs"), F.transform(F.array_sort(F.collect_list(F.struct("who", "total"))), lambda g: g["total"]).alias("totals")
    )
    widths = terms.groupBy("lang", "tb").agg(F.max("slot").alias("width"))
    own = groups.select("lang", "source", "gb", "who")
    filled = (
        counts.join(terms, ["lang", "term"])
        .join(small_side(own, n_groups), ["lang", "source"])
        .groupBy("lang", "gb", "tb")
        .agg(F.collect_list(F.struct("who", "slot", "n")).alias("held"))
    )
    slices = blocks.join(widths, "lang").join(filled, ["lang", "gb", "tb"], "left")
    sent = slices.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gbs") - 1)).alias("with"))
    columns = ["lang", "gb", "tb", "totals", F.col("width").cast("int").alias("width")]
    sent = sent.select(*columns, F.least("gb", "with").alias("low"), F.greatest("gb", "with").alias("high"), *[F.col(f"held.{c}").alias(c) for c in ("who", "slot", "n")])
    schema = "lang string, gb long, who int, other_gb long, other int, value long"
    partial = sent.groupBy("lang", "low", "high", "tb").applyInPandas(_cell, schema)
    return partial.groupBy("lang", "gb", "who", "other_gb", "other").agg(F.sum("value").alias("value"))


def _numbered(df: DataFrame, key: str, block: int, names: tuple[str, str, str]) -> DataFrame:
    """df's rows of each lang dealt by hash into blocks of about `block`: the block, how many the language has, and the place there."""
    at, n, slot = names
    dealt = df.withColumn(n, F.ceil(F.col("size") / block).cast("long")).withColumn(at, F.pmod(F.xxhash64(key), n))
    return dealt.withColumn(slot, F.row_number().over(W.partitionBy("lang", at).orderBy(key)))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank: how far each source is from the others of its language, and by which terms from all of it."""
    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = materialize(term_counts(slim), "audit-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "lang_n"), "audit-kept")
    langs = materialize(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "audit-langs")
    own = counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    there = slim.select("lang", "source").distinct()
    per_lang = there.groupBy("lang").agg(F.count("*").alias("size"))
    groups = (
        there.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(per_lang, "lang")
        .withColumn("total", F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0)))
    )
    groups = materialize(_numbered(groups, "source", group_block, ("gb", "gbs", "who")), "audit-groups")
    n_groups = groups.count()
    # Not dealt by language: the window below deals a language's terms by block.
    sized = kept.join(small_side(langs.select("lang", F.col("v").alias("size")), langs.count()), "lang")
    terms = _numbered(sized, "term", term_block, ("tb", "tbs", "slot"))
    terms = materialize(terms.select("lang", "term", "lang_n", "tb", "slot"), "audit-terms")

    values = pair_values(counts, groups.where("v > 0"), n_groups, terms.select("lang", "term", "tb", "slot"))
    mine = groups.select("lang", "source", "gb", "who")
    other = groups.select("lang", F.col("source").alias("item"), F.col("gb").alias("other_gb"), F.col("who").alias("other"))
    pairs = mine.join(other, "lang").where("source <> item").join(values, ["lang", "gb", "who", "other_gb", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    totals = groups.where("v > 0").select("lang", "source", "total", (F.col("lang_total") + F.col("v")).alias("lang_total"))
    held = counts.where("n > 0").join(terms, ["lang", "term"]).join(small_side(totals, n_groups), ["lang", "source"])
    p, q = share("n", "total"), share("lang_n", "lang_total")
    over = held.select("lang", "source", "tb", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    told = over.select("lang", "source", "tb", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    # The first of each term block, then of those: no task sorts all terms of a large group.
    in_block = W.partitionBy("lang", "source", "tb").orderBy(F.col("value").desc(), "item")
    told = told.withColumn("rank", F.row_number().over(in_block)).where(F.col("rank") <= top).drop("rank", "tb")
    told = told.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    return pairs.unionByName(told)

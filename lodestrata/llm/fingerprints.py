"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

A text's shingles (five words; a shorter text is one shingle) are hashed once. The top bits of a hash
name one of 128 bins, and each bin keeps its smallest hash. An empty bin copies a bin that hashing
(bin, attempt) hits, attempt after attempt, until one is not empty; so each empty bin chooses freely
among all full ones. Of every bin the 4 lowest bits are kept, one hex digit each: 64 bytes per text.
Two unlike bins still agree by chance once in 16 times, which `likeness` takes off again.

Only DataFrame functions run here. Each text is shuffled once, to stand beside its successor.

Defined cases: null is the empty text. Texts without words have the fingerprint of `EMPTY` digits,
are alike (1.0) to each other and unlike (0.0) to all others. Documents come in descending doc_id,
null last; rows with one doc_id by their text's hash. The successor of the last row is the first; a
single row is its own. Repeated rows get a row each.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.llm.common import let, materialize, small_side, words_of

BINS, LOW_BITS, SHINGLE = 128, 4, 5
#: Hashed attempts of a bin before all full bins are ranked for it.
ATTEMPTS = 12
EMPTY = "-" * BINS
#: Cells of ids at most, how many of their starts are looked through at once, and the room for the parts of one.
CELLS, BLOCK, PARTS = 1024, 32, 1 << 40
LARGEST = (1 << 63) - 1
_BIN_SHIFT = 63 - int(math.log2(BINS))


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """Non-negative 63-bit hashes of all shingles."""
    mask = F.lit(0x7FFFFFFFFFFFFFFF)
    many = F.transform(
        F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[words[i + j] for j in range(width)]).bitwiseAND(mask)
    )
    one = F.array(F.xxhash64(F.array_join(words, " ")).bitwiseAND(mask))
    return F.when(F.size(words) >= width, many).when(F.size(words) > 0, one).otherwise(F.array().cast("array<bigint>"))


def bin_of(h: Column) -> Column:
    return F.shiftright(h, _BIN_SHIFT).cast("int")


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of each bin that has any, in the order of the bins."""
    def firsts(srt: Column) -> Column:
        return F.filter(srt, lambda h, i: (i == 0) | (bin_of(F.get(srt, i - 1)) != bin_of(h)))

    return let(F.sort_array(hashes), firsts)


def densified(minima: Column) -> Column:
    """All bins' values, the empty ones filled from full ones. minima: a non-empty array."""
    def fill(bins: Column) -> Column:
        def value(own: Column, i: Column) -> Column:
            hits = [F.get(bins, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
            last = F.array_min(F.transform(minima, lambda h: F.struct(F.xxhash64(i, bin_of(h)).alias("order"), h.alias("h"))))["h"]
            return F.coalesce(own, *hits, last)

        return F.transform(bins, value)

    by_bin = F.map_from_entries(F.transform(minima, lambda h: F.struct(bin_of(h), h)))
    sparse = let(by_bin, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: m[b]))
    return let(sparse, fill)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, a string of one digit per bin."""
    low = (1 << LOW_BITS) - 1

    def packed(kept: Column) -> Column:
        digits = F.transform(densified(kept), lambda v: F.hex(v.bitwiseAND(F.lit(low))))
        return F.when(F.size(kept) == 0, F.lit(EMPTY)).otherwise(F.lower(F.array_join(digits, "")))

    return let(words_of(text), lambda words: let(bin_minima(shingle_hashes(words)), packed))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints, 0 to 1, without the share of bins that agree by chance."""
    chance = 1.0 / (1 << LOW_BITS)
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    estimate = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    neither = (a == EMPTY) & (b == EMPTY)
    return F.when(neither, 1.0).when((a == EMPTY) | (b == EMPTY), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def _cells(points: list[int]) -> tuple[list[int], dict[int, int]]:
    """The first ids of the cells above the lowest, in order, and how many points each id that holds several has.

    points are quantiles of the ids. An id that is several of them holds a large share of the rows: it
    gets a cell of its own.
    """
    repeats = {x: k for x, k in Counter(points).items() if k > 1}
    return sorted({*points, *(x + 1 for x in repeats if x < LARGEST)}), repeats


def _bucketed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) with `tie` and `bucket`, a range in descending (doc_id, tie), and one row (bucket, next_bucket) per bucket that has rows.

    Rows per bucket grow with the square root of all rows. Cells come from quantiles of the ids, at most CELLS,
    so an outlying id or ids that crowd together leave each of them a like share of the rows; inside a cell
    buckets are of equal width. An id that holds many rows, and null, are split by the hash of the text.
    Rows that are equal in both stay in one bucket: the window over it spills.
    """
    tied = docs.withColumn("tie", F.xxhash64("text"))
    facts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("n_ids"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    per_bucket = max(256, min(50_000, 2 * math.isqrt(facts.n)))
    n_cells = max(1, min(CELLS, facts.n_ids // per_bucket))
    shares = [i / n_cells for i in range(1, n_cells)]
    points = docs.agg(F.percentile_approx("doc_id", shares, 10 * CELLS).alias("points")).first().points if shares else []
    starts, repeats = _cells(points or [])
    lows = [facts.lo or 0, *starts]
    highs = [*(x - 1 for x in starts), facts.hi or 0]
    parts = [max(1, -(-repeats.get(low, 1) * facts.n_ids // (n_cells * per_bucket))) for low in lows]
    widths = [max(1.0, (high - low + 1) / n) for low, high, n in zip(lows, highs, parts, strict=True)]

    def at_most(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= F.col("doc_id")))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("long") for x in values]) if values else F.array().cast("array<long>")

    block = at_most(longs(starts[::BLOCK]))
    inside = let(block, lambda k: F.when(k == 0, 0).otherwise((k - 1) * BLOCK + at_most(F.slice(longs(starts), (k - 1) * BLOCK + 1, F.lit(BLOCK)))))
    hashed = (F.col("tie").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)

    def by_tie(n: Column) -> Column:
        """Of n parts by the text's hash; the least hash, which comes first, has the highest."""
        return n - 1 - F.least(F.floor(hashed * n), n - 1)

    def part(cell: Column) -> Column:
        n = F.get(longs(parts), cell)
        low, width = F.get(longs(lows), cell), F.get(F.array(*map(F.lit, widths)), cell)
        within = F.floor((F.col("doc_id").cast("double") - low.cast("double")) / width)
        whole = F.when(F.array_contains(longs(sorted(repeats)), low), by_tie(n)).otherwise(F.least(F.greatest(within, F.lit(0)), n - 1))
        return cell.cast("long") * PARTS + whole

    nulls = F.lit(max(1, -(-(facts.n - facts.n_ids) // per_bucket))).cast("long")
    held = tied.withColumn("bucket", F.when(F.col("doc_id").isNull(), by_tie(nulls) - nulls).otherwise(let(inside, part)))
    # A row per bucket; the window over all of them has some square root of the rows.
    down = W.orderBy(F.col("bucket").desc())
    names = held.select("bucket").distinct()
    follow = names.select("bucket", F.lead("bucket").over(down).alias("lower"), F.max("bucket").over(W.partitionBy()).alias("top"))
    return held, follow.select("bucket", F.coalesce("lower", "top").alias("next_bucket"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp and next_text, next_fp: those of the next document in descending doc_id."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held, follow = _bucketed(slim)
    follow = materialize(follow, "fp-buckets")
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    inner = W.partitionBy("bucket").orderBy(*order)
    lined = held.withColumn("fp", fingerprint(F.col("text"))).select(
        "bucket", "doc_id", "text", "fp", F.lead(F.struct("text", "fp")).over(inner).alias("after")
    )
    # The first row of each bucket, for the last row of the bucket above it.
    tops = held.groupBy("bucket").agg(F.max("doc_id").alias("top_id"))
    n_tops = follow.count()
    top_ids = small_side(tops.select("bucket", F.col("top_id")), n_tops)
    firsts = (
        held.join(top_ids, "bucket")
        .where(F.col("doc_id").eqNullSafe(F.col("top_id")))
        .groupBy("bucket")
        .agg(F.min(F.struct("tie", "text")).alias("first"))
        .select(F.col("bucket").alias("next_bucket"), F.struct(F.col("first.text").alias("text"), fingerprint(F.col("first.text")).alias("fp")).alias("first"))
    )
    edges = follow.join(firsts, "next_bucket").select("bucket", "first")
    return lined.join(edges, "bucket").select(
        "doc_id", "text", "fp", F.coalesce("after", "first").alias("next")
    ).select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third is the next document's beginning."""
    n = F.length("text")
    cut = F.expr("length(text) div 3")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    made = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("fp").alias("fingerprint"), "next_fp"
    )
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fp",
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )

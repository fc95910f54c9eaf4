"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order and laid end to end; the stream is cut into blocks of
equally many words. The mix is a list of slots: slot k has the point frac(k * golden ratio), which
falls into one source's share of the cumulative weights, so every stretch of the mix holds the sources
in nearly their target proportions. A slot's rank among those of its source says which block fills it;
after the last block the stream starts again. The last slot of a source is filled only as far as its
target, and the few slots that the points leave short close the list, so a source gives floor(target)
words.

Only DataFrame functions run here. Texts are read once, for their sizes; all else moves rows of a few
numbers. A source may hold any share of the rows: running sums go by chunks of its order, and blocks
are joined on (source, block).

Defined cases: null texts have size 0 and are never taken; a null source is a source of its own, the
last one. Repeated rows are documents of their own. Sources of size 0 have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.llm.common import chunk_bits, materialize, running_total, small_side, unused, words_of

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all words.
TOTAL_SHARE = 1.5
#: No source is taken more than this many times over.
MAX_PASSES = 2
MAX_BLOCK, LEAST_SLOTS = 1024, 65_536
#: Cells of the unit interval through which points find their source by an equi-join.
CELLS = 4096
SEED = 20_240_607


def sized(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source and size in words of each document."""
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        "source",
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source_idx, source, source_size, weight, target.

    Targets are min(cap, level * weight) with the one level at which they sum to the total: sources are
    put in the order in which they would hit their cap, and the first that does not gives the level.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("source_idx") % len(WEIGHTS) + 1)
    ranked = (
        per_source.withColumn("source_idx", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.lit(float(MAX_PASSES)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    before = W.orderBy("ratio", "source_idx").rowsBetween(W.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("words", F.sum("source_size").over(everything))
        .withColumn("left", F.col("words") * TOTAL_SHARE - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn(
            "level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        )
        .withColumn("found", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "source_idx", "level"))).over(everything))
    )
    return levels.select(
        "source_idx",
        "source",
        "source_size",
        "weight",
        F.least("cap", F.coalesce(F.col("found.level"), F.col("ratio")) * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, size, source_size, target and taken of each document."""
    spark = docs.sparkSession
    sizes = materialize(sized(docs), "mix-sizes")
    sources = materialize(source_targets(sizes), "mix-sources")
    facts = sources.agg(
        F.count("*").alias("n"), F.sum(F.floor("target")).alias("words"), F.sum("source_size").alias("corpus")
    ).first()
    rows, block = sizes.count(), max(1, min(MAX_BLOCK, (facts.words or 0) // LEAST_SLOTS))
    plan = sources.select(
        "*",
        F.floor("target").alias("take"),
        F.ceil(F.col("source_size") / block).alias("n_blocks"),
    ).withColumn(
        "n_slots",
        F.when(F.col("source_size") == 0, 0).otherwise(
            (F.expr("take div source_size")) * F.col("n_blocks") + F.ceil((F.expr("take % source_size")) / block)
        ),
    )
    n_slots = plan.agg(F.sum("n_slots")).first()[0] or 0

    # Documents in hashed order, and where each begins in its source's stream.
    order = F.xxhash64(F.lit(SEED), "doc_id")
    bits = chunk_bits(rows)
    placed = running_total(
        sizes.join(small_side(plan, facts.n), sizes.source.eqNullSafe(plan.source)).select(
            "row_id", "doc_id", "size", "source_idx", order.alias("h"), F.shiftrightunsigned(order, 64 - bits).alias("chunk")
        ),
        "source_idx",
        "chunk",
        [F.col("h"), F.col("size"), F.col("row_id")],
        F.col("size"),
        "start",
    )
    pieces = placed.where("size > 0").select(
        "row_id",
        "source_idx",
        "start",
        "size",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"),
    )

    # The schedule: points, their sources, and the rank of each slot within its source.
    upto = W.orderBy("source_idx").rowsBetween(W.unboundedPreceding, 0)
    shares = plan.select("source_idx", "n_slots", F.sum("n_slots").over(upto).alias("upto")).select(
        "source_idx", ((F.col("upto") - F.col("n_slots")) / max(1, n_slots)).alias("lo"), (F.col("upto") / max(1, n_slots)).alias("hi")
    )
    cells = shares.where("hi > lo").select(
        "*",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"),
    )
    side = 1 << chunk_bits(n_slots)
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % 1.0).alias("point"), F.expr(f"id div {side}").alias("chunk")
    )
    located = (
        points.withColumn("cell", F.floor(F.col("point") * CELLS))
        .join(small_side(cells, facts.n + CELLS), "cell")
        .where("point >= lo and point < hi")
        .select("slot", "source_idx", "chunk")
    )
    ranked = running_total(located, "source_idx", "chunk", [F.col("slot")], F.lit(1), "rank").select("source_idx", "rank")
    ranked = materialize(ranked, "mix-slots")
    held = ranked.groupBy("source_idx").agg(F.count("*").alias("held"))
    closing = (
        plan.join(held, "source_idx", "left")
        .where("n_slots > coalesce(held, 0)")
        .select("source_idx", F.explode(F.sequence(F.coalesce("held", F.lit(0).cast("long")), F.col("n_slots") - 1)).alias("rank"))
    )
    schedule = (
        ranked.unionByName(closing)
        .join(small_side(plan.select("source_idx", "n_slots", "n_blocks", "source_size", "take"), facts.n), "source_idx")
        .where("rank < n_slots")
        .select(
            "source_idx",
            (F.col("rank") % F.col("n_blocks")).alias("block"),
            # Words of the block that this slot takes: all of it, but at the source's target.
            (F.col("take") - F.expr("rank div n_blocks") * F.col("source_size")).alias("upto"),
        )
    )
    taken = (
        pieces.join(schedule, ["source_idx", "block"])
        .select(
            "row_id",
            F.greatest(
                F.lit(0),
                F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, F.col("upto"))
                - F.greatest(F.col("start"), F.col("block") * block),
            ).alias("words"),
        )
        .groupBy("row_id")
        .agg(F.sum("words").alias("words"))
    )
    return (
        sizes.join(small_side(plan.withColumnRenamed("source", "plan_source"), facts.n), F.expr("source <=> plan_source"))
        .join(taken, "row_id", "left")
        .select("row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))
    )


def repeated(docs: DataFrame) -> DataFrame:
    """The mix as whole documents: each row of docs as often (0, 1 or 2 times) as the mix takes its words, rounded."""
    copies, copy, their_id, their_source = unused(docs, "copies", "copy", "their_id", "their_source")
    share = (
        mix(docs)
        .groupBy("doc_id", "source")
        .agg(F.floor(F.try_divide(F.sum("taken"), F.sum("size")) + 0.5).cast("int").alias(copies))
        .where(F.col(copies) > 0)
        .withColumnsRenamed({"doc_id": their_id, "source": their_source})
    )
    share = materialize(share, "mix-copies")
    match = docs["doc_id"].eqNullSafe(F.col(their_id)) & docs["source"].eqNullSafe(F.col(their_source))
    return (
        docs.join(small_side(share, share.count()), match)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
        .select(*[docs[c] for c in docs.columns])
    )

"""Entity resolution ladders and two-source reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import relational as rel


def ladder(left: DataFrame, right: DataFrame, key: str, found: str, passes: list[tuple[list[Column], list[Column], bool]]) -> DataFrame:
    """key, the id that the first successful pass found, and the pass (from 1).

    A pass is (expressions of left, expressions of right, unique): rows join where all are equal. Of several
    candidates the smallest id is taken, or none if the pass must be unique. Each pass is one inner equi-join of aggregated
    candidates with left, so a frequent key doesn't multiply rows, and rows with a null in a pass's expressions, which would all
    meet in one task, stay out of it. Of different rows with one key the first resolved, else the smallest id, is the answer.
    """
    kind = right.schema[found].dataType
    at = [f"__at_{i}" for i in range(len(passes))]
    none = {c: F.lit(None).cast(kind) for c in at}
    parts = [left.select(F.col(key).alias("__key"), *[v.alias(c) for c, v in none.items()])]
    for i, (mine, theirs, unique) in enumerate(passes):
        names, terms = [f"__k{j}" for j in range(len(mine))], [f"__t{j}" for j in range(len(mine))]
        side = right.select(*[e.alias(n) for e, n in zip(theirs, names, strict=True)], F.col(found).alias("__id"))
        side = side.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
        side = rel.dealt(side, *names).groupBy(*names).agg(F.min("__id").alias("__id"), F.count("*").alias("__n"))
        side = side.where("__n = 1") if unique else side
        equal = reduce(lambda a, b: a & b, [F.col(t) == F.col(n) for t, n in zip(terms, names, strict=True)])
        got = left.select(F.col(key).alias("__key"), *[e.alias(t) for e, t in zip(mine, terms, strict=True)]).join(side, equal)
        parts.append(got.select("__key", *[(F.col("__id") if c == at[i] else v).alias(c) for c, v in none.items()]))
    rows = rel.dealt(reduce(DataFrame.unionByName, parts), "__key")
    one = rows.groupBy("__key").agg(*[F.min(c).alias(c) for c in at])
    turn = reduce(lambda rest, i: F.when(F.col(at[i]).isNotNull(), i + 1).otherwise(rest), reversed(range(len(passes))), F.lit(None).cast("int"))
    return one.select(F.col("__key").alias(key), F.coalesce(*at).alias(found), turn.alias("pass"))


def pct(a: Column, b: Column) -> Column:
    """a of b in percent, two digits; null where b is 0."""
    return F.round(F.try_divide(100.0 * a, F.nullif(b.cast("double"), F.lit(0.0))), 2)


def verdict(bills: Column, actions: Column, votes: Column) -> Column:
    """parity, close, gap or failed. No bills on a side is a failure; a percentage of nothing matched counts as 100."""
    b, a, v = F.coalesce(bills, F.lit(0.0)), *(F.coalesce(c, F.lit(100.0)) for c in (actions, votes))
    return (
        F.when(b == 0, "failed")
        .when((b >= 99) & (a >= 97) & (v >= 97), "parity")
        .when((b >= 95) & (a >= 90) & (v >= 90), "close")
        .otherwise("gap")
    )


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], members: str) -> DataFrame:
    """One row: how many keys match both ways and in how many matched ones the sets of members agree.

    Both sides are aggregated to a row per key before the one full join.
    """
    side = lambda df, n: df.groupBy(*keys).agg(F.sort_array(F.collect_set(members)).alias(f"set_{n}"), F.count("*").alias(f"n_{n}"))
    both = side(ours, "o").join(side(theirs, "t"), keys, "full")
    matched = F.col("n_o").isNotNull() & F.col("n_t").isNotNull()
    row = both.agg(
        F.count("n_o").alias("ours"),
        F.count("n_t").alias("theirs"),
        F.count_if(matched).alias("matched"),
        F.count_if(matched & (F.col("n_o") == F.col("n_t"))).alias("same_count"),
        F.count_if(matched & (F.col("set_o") == F.col("set_t"))).alias("same_set"),
    )
    m = F.col("matched")
    return row.select(
        "ours",
        "theirs",
        "matched",
        F.least(pct(m, F.col("ours")), pct(m, F.col("theirs"))).alias("bills_pct"),
        pct(F.col("same_count"), m).alias("actions_pct"),
        pct(F.col("same_set"), m).alias("sponsors_pct"),
    ).withColumn("verdict", verdict(F.col("bills_pct"), F.col("actions_pct"), F.col("sponsors_pct")))

"""Keyed merges, exports and small set operations over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import parse
from lodestrata.operators import merge
from lodestrata.plans.registry import Tables, query
from lodestrata.sources import lake


@query("select doc_id, lang as best from documents")
def backfill_null(t: Tables) -> DataFrame:
    """Every second language taken away is filled in again from the source of truth; what is there stays."""
    held = t.documents.select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("best"))
    return merge.backfill(held, "best", F.col("lang")).select("doc_id", "best")


@query("""
    with gone as (select o_orderkey from orders where o_orderstatus = 'F')
    select 'lines' as child, count(*) as rows from lineitem where l_orderkey not in (select * from gone)
    union all select 'orders', count(*) from orders where o_orderkey not in (select * from gone)
""")
def cascade_delete(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F'")
    left = merge.cascade_delete(gone, "o_orderkey", {"lines": (t.lineitem, "l_orderkey"), "orders": (t.orders.select(F.col("o_orderkey").alias("k")), "k")})
    counts = [df.agg(F.lit(name).alias("child"), F.count("*").alias("rows")) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


@query("""
    select o_orderkey as k, case when o_orderkey % 2 = 0 then 'listed' else o_orderpriority end as title,
           case when o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 then 'thin' else 'full ' || o_orderkey end as payload from orders
    union all select -1, 'listed', 'thin'
""")
def upsert_fuller(t: Tables) -> DataFrame:
    """A list pass over orders, a third of which a detail pass has filled; its rows come twice, and one is new."""
    k = F.col("o_orderkey").alias("k")
    base = t.orders.select(k, F.col("o_orderpriority").alias("title"), F.concat(F.lit("full "), F.col("o_orderkey").cast("string")).alias("payload"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("detailed"))
    thin = t.orders.where("o_orderkey % 2 = 0").select(k, F.lit("listed").alias("title"), F.lit("thin").alias("payload"))
    delta = thin.unionByName(thin).unionByName(t.spark.sql("select -1L as k, 'listed' as title, 'thin' as payload"))
    return merge.upsert_fuller(base, delta, ["k"], ["title"], "payload", "detailed").select("k", "title", "payload")


@query("select o_orderkey as k, o_orderpriority as p from orders union all select distinct -o_custkey, 'z' from orders where -o_custkey not in (select o_orderkey from orders) union all select null, 'z'")
def insert_ignore_repeats(t: Tables) -> DataFrame:
    """New keys that come many times are inserted once, a null key too."""
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    twice = t.orders.select((-F.col("o_custkey")).alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("z").alias("p"))
    always = t.orders.select((-F.col("o_custkey")).alias("k"), F.lit("z").alias("p"))
    nothing = t.spark.sql("select cast(null as bigint) as k, 'z' as p union all select null, 'z'")
    return merge.insert_ignore(base, twice.unionByName(always).unionByName(nothing), ["k"])


@query("select event_id, props is not null and (props->'k') is not null as has_k, (props->'zz') is not null as has_zz from events")
def json_key_exists(t: Tables) -> DataFrame:
    keys = F.json_object_keys("props")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return t.events.select("event_id", has("k").alias("has_k"), has("zz").alias("has_zz"))


@query("""
    with old as (select c_custkey, c_mktsegment as a, 'kept' as b from customer)
    select c_custkey, 'a=' || case when c_custkey % 2 = 0 then 'new' else a end || ';b=kept' || case when c_custkey % 2 = 0 then '' else ';c=more' end as answers from old
""")
def merge_answers(t: Tables) -> DataFrame:
    old = F.create_map(F.lit("a"), F.col("c_mktsegment"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("more")))
    entries = F.sort_array(F.map_entries(parse.merged_answers(old, new)))
    return t.customer.select("c_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("answers"))


@query("""
    with asked as (select c_custkey, list_distinct(list_transform(range(4), lambda i: (c_custkey + i) % 7)) as pages, [0, 3, 6] as consent from customer)
    select c_custkey, list_sort(list_filter(consent, lambda p: not list_contains(pages, p)))::varchar as missing from asked
""")
def page_difference(t: Tables) -> DataFrame:
    """Consent pages that were not asked."""
    pages = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("c_custkey") + i) % 7)
    missing = F.sort_array(F.array_except(F.array(*[F.lit(x).cast("bigint") for x in (0, 3, 6)]), pages.cast("array<bigint>")))
    return t.customer.select("c_custkey", F.concat(F.lit("["), F.array_join(missing.cast("array<string>"), ", "), F.lit("]")).alias("missing"))


@query("select lang, count(*) as rows, count(*) as held from documents group by 1")
def lake_export(t: Tables) -> DataFrame:
    """Documents written by language and counted again."""
    return lake.export_checked(t.documents, f"{lake.shared_dir(t.spark)}/export-{uuid.uuid4().hex}", ["lang"])


@query("select c_mktsegment, count(*) as rows, round(sum(c_acctbal), 2) as balance from customer group by 1")
def grouped_json(t: Tables) -> DataFrame:
    """Customers as gzipped JSON lines by segment, read back."""
    path = f"{lake.shared_dir(t.spark)}/json-{uuid.uuid4().hex}"
    lake.write_grouped_json(t.customer, path, "c_mktsegment")
    back = lake.read_grouped_json(t.spark, path, t.customer.schema)
    return back.groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("select case when o_orderstatus = 'F' then 'closed' else 'open' end as domain, count(*) as orders from orders group by 1")
def domain_counts(t: Tables) -> DataFrame:
    domain = lake.domain_of(F.col("o_orderstatus"), {"closed": ["F"], "open": ["O", "P"]})
    return t.orders.groupBy(domain.alias("domain")).agg(F.count("*").alias("orders"))


@query("""
    select c_custkey, tier from (select c_custkey, tier, row_number() over (partition by tier order by c_acctbal desc, c_custkey) as r
      from (select *, case when c_nationkey = 3 then 0 else 1 end as tier from customer) x) y where r <= 20
""")
def scope_tiers(t: Tables) -> DataFrame:
    """The best 20 of one's own nation, then the best 20 of all others."""
    best = [
        t.customer.where(own).orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(20).select("c_custkey", F.lit(tier).alias("tier"))
        for tier, own in enumerate((F.col("c_nationkey").eqNullSafe(F.lit(3)), ~F.col("c_nationkey").eqNullSafe(F.lit(3))))
    ]
    return best[0].unionByName(best[1])

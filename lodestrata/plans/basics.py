"""Scans, filters, joins, aggregates, windows and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.functions import normalize
from lodestrata.operators import relational as rel
from lodestrata.plans.registry import Tables, query

def year() -> Column:
    return F.year("o_orderdate").cast("long")


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def scan_project(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 42")
def point_lookup(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey") == 42).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, o_orderpriority from orders where o_orderkey in (1, 5, 9, 100, 777)")
def key_list_lookup(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey").isin(1, 5, 9, 100, 777)).select("o_orderkey", "o_orderpriority")


@query("select year(o_orderdate) as y, count(*) as n from orders where year(o_orderdate) >= 1995 group by 1")
def lake_scan(t: Tables) -> DataFrame:
    return t.orders.where(year() >= 1995).groupBy(year().alias("y")).agg(F.count("*").alias("n"))


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 50")
def feed_latest(t: Tables) -> DataFrame:
    return t.events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(50).select("event_id", "ts", "event_type")


@query("select o_orderkey, o_orderdate, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice > 1000 order by year(o_orderdate) desc nulls last, o_orderkey desc limit 50 offset 100")
def browse_page(t: Tables) -> DataFrame:
    conditions = [F.col("o_orderstatus") == "O", None, F.col("o_totalprice") > 1000]
    page = rel.browse_page(t.orders, conditions, [year().desc_nulls_last(), F.col("o_orderkey").desc()], 50, 100)
    return page.select("o_orderkey", "o_orderdate", "o_totalprice")


@query("select p_partkey, p_name from part where list_has_any(string_split(p_name, ' '), ['red', 'steel', 'small'])")
def array_overlap(t: Tables) -> DataFrame:
    wanted = F.array(F.lit("red"), F.lit("steel"), F.lit("small"))
    return t.part.where(F.arrays_overlap(F.split("p_name", " "), wanted)).select("p_partkey", "p_name")


@query("""
    with s as (select l_orderkey, list_sort(list_distinct(list(l_suppkey))) as supps, list_sort(list_distinct(list(l_partkey % 7))) as parts from lineitem group by 1)
    select a.l_orderkey as left_key, b.l_orderkey as right_key from s a join s b on a.l_orderkey = b.l_orderkey - 1 and a.parts = b.parts
""")
def set_equality(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_partkey") % 7)).alias("parts"))
    a, b = sets.alias("a"), sets.alias("b")
    both = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey") - 1) & (F.col("a.parts") == F.col("b.parts")))
    return both.select(F.col("a.l_orderkey").alias("left_key"), F.col("b.l_orderkey").alias("right_key"))


@query("select c_custkey, c_name from customer where starts_with(c_name, 'Customer#00000001')")
def key_prefix(t: Tables) -> DataFrame:
    prefix = "Customer#%00000001_".replace("%", "").replace("_", "")
    return t.customer.where(F.col("c_name").startswith(prefix)).select("c_custkey", "c_name")


@query("select s_suppkey, s_name from supplier where s_name ilike '%SUPPLIER#%1%'")
def author_ilike(t: Tables) -> DataFrame:
    return t.supplier.where(F.col("s_name").ilike("%SUPPLIER#%1%")).select("s_suppkey", "s_name")


@query("select p_partkey from part where p_name ilike '%red%' or p_type ilike '%red%' or p_name ilike '%blue%' or p_type ilike '%blue%' or p_name ilike '%brass%' or p_type ilike '%brass%'")
def subject_set(t: Tables) -> DataFrame:
    return t.part.where("p_name ilike any ('%red%', '%blue%', '%brass%') or p_type ilike any ('%red%', '%blue%', '%brass%')").select("p_partkey")


@query("select event_id, user_id from events where regexp_matches(event_type, '(?i)err') and not regexp_matches(props, '\"k\": [0-4]')")
def error_requeue(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").rlike("(?i)err") & ~F.col("props").rlike('"k": [0-4]')).select("event_id", "user_id")


@query("select c_custkey, c_mktsegment from customer where lower(c_mktsegment) in ('building', 'machinery')")
def structured_search(t: Tables) -> DataFrame:
    return t.customer.where(F.lower("c_mktsegment").isin("building", "machinery")).select("c_custkey", "c_mktsegment")


@query("""
    with a as (select o_orderkey as k, case when o_orderkey % 5 = 0 then null else o_orderpriority end as p from orders),
         b as (select o_orderkey as k, case when o_orderkey % 10 = 0 then null else o_orderpriority end as p from orders)
    select a.k, a.p from a join b on a.k = b.k and a.p is not distinct from b.p
""")
def null_safe_join(t: Tables) -> DataFrame:
    priority = lambda m: F.when(F.col("o_orderkey") % m != 0, F.col("o_orderpriority"))
    a = t.orders.select(F.col("o_orderkey").alias("k"), priority(5).alias("p"))
    b = t.orders.select(F.col("o_orderkey").alias("k2"), priority(10).alias("p2"))
    return a.join(b, (F.col("k") == F.col("k2")) & F.col("p").eqNullSafe(F.col("p2"))).select("k", "p")


@query("select doc_id from documents where doc_id % 4 = 1")
def mod_shard(t: Tables) -> DataFrame:
    return t.documents.where(F.pmod("doc_id", F.lit(4)) == 1).select("doc_id")


@query("select p_partkey, p_brand, p_size from part where list_has_any(string_split(p_name, ' '), ['red', 'green']) and p_brand in ('Brand#11', 'Brand#22', 'Brand#33')")
def facet_filter(t: Tables) -> DataFrame:
    within = F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("green")))
    return t.part.where(within & F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")).select("p_partkey", "p_brand", "p_size")


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def inner_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select doc_id, quality, coalesce(toxic, -1) as toxic from documents left join labels using (doc_id)")
def left_join_fulltext(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("select doc_id from documents left join labels using (doc_id) where labels.quality is null")
def outstanding_work(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("select c_custkey % 10 as shard, count(*) as orphans from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') group by 1")
def orphan_rows(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(done, "c_custkey", "left_anti").groupBy((F.col("c_custkey") % 10).alias("shard")).agg(F.count("*").alias("orphans"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def semi_join(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey")


@query("select p_partkey from part where p_brand not in (select p_brand from part where p_partkey < 20 and p_brand is not null)")
def stoplist_prune(t: Tables) -> DataFrame:
    stop = t.part.where("p_partkey < 20 and p_brand is not null").select("p_brand").distinct()
    return t.part.where("p_brand is not null").join(stop, "p_brand", "left_anti").select("p_partkey")


@query("select a.o_orderkey as kept, b.o_orderkey as minted from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderdate = b.o_orderdate and a.o_orderkey < b.o_orderkey")
def minted_duplicates(t: Tables) -> DataFrame:
    b = t.orders.select(F.col("o_orderkey").alias("minted"), "o_custkey", "o_orderdate")
    return t.orders.join(b, ["o_custkey", "o_orderdate"]).where("o_orderkey < minted").select(F.col("o_orderkey").alias("kept"), "minted")


@query("select l_orderkey, l_linenumber, n_name from lineitem left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey")
def derived_jurisdiction(t: Tables) -> DataFrame:
    # Nations are 25 rows by definition; suppliers are left to the optimizer's own size check.
    named = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")
    return t.lineitem.join(named, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "n_name")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def dict_broadcast(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return t.customer.join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("""
    with ranked as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as r from lineitem)
    select o_orderkey, l_partkey from orders left join ranked on l_orderkey = o_orderkey and r = 1
""")
def primary_sponsor(t: Tables) -> DataFrame:
    first = t.lineitem.groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", -F.col("l_linenumber"), "l_partkey")).alias("best"))
    named = first.select(F.col("l_orderkey").alias("o_orderkey"), F.col("best.l_partkey").alias("l_partkey"))
    return t.orders.select("o_orderkey").join(named, "o_orderkey", "left")


@query("""
    select c_custkey, c_name, coalesce(n, 0) as n_orders, last_order, n_name from customer
    left join (select o_custkey, count(*) as n, max(o_orderdate) as last_order from orders group by 1) on o_custkey = c_custkey
    left join nation on n_nationkey = c_nationkey
""")
def search_document(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"))
    wide = t.customer.join(per, "c_custkey", "left").join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return wide.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order", "n_name")


@query("select c_custkey, round(coalesce(d.bal, c_acctbal), 2) as c_acctbal from customer left join (select c_custkey as k, c_acctbal + 1 as bal from customer where c_custkey % 4 = 0) d on d.k = c_custkey")
def update_from(t: Tables) -> DataFrame:
    delta = t.customer.where("c_custkey % 4 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("bal"))
    return t.customer.join(delta, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("bal", "c_acctbal"), 2).alias("c_acctbal"))


@query("""
    with bands(lo, hi, band) as (values (0, 9, 'small'), (10, 24, 'middle'), (25, 39, 'large'), (40, 1000, 'bulk'))
    select band, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem join bands on l_quantity >= lo and l_quantity <= hi group by 1
""")
def range_join(t: Tables) -> DataFrame:
    bands = t.spark.createDataFrame([(0, 9, "small"), (10, 24, "middle"), (25, 39, "large"), (40, 1000, "bulk")], "lo int, hi int, band string")
    fits = (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") <= F.col("hi"))
    return t.lineitem.select("l_quantity").join(F.broadcast(bands), fits).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select count(*) as n, count(*) filter (o_orderstatus = 'F') as n_done from orders")
def count_total(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))


@query("select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1 order by n desc, word")
def category_counts(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word")


@query("select count(distinct (l_returnflag, l_linestatus, case when l_linenumber > 3 then null else l_linenumber end)) as n_tuples, count(distinct l_returnflag) as n_flags from lineitem")
def distinct_tuple(t: Tables) -> DataFrame:
    tuple_of = F.struct("l_returnflag", "l_linestatus", F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")))
    return t.lineitem.agg(F.countDistinct(tuple_of).alias("n_tuples"), F.countDistinct("l_returnflag").alias("n_flags"))


@query("""
    select lang, count(*) as n, count(*) filter (n_chars > 1000) as n_long, coalesce(sum(n_chars) filter (n_chars > 5000), 0)::bigint as chars_long,
           min(n_chars) as least, max(n_chars) as most from documents group by 1
""")
def census(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("n_chars") > 1000).alias("n_long"),
        F.coalesce(F.sum(F.when(F.col("n_chars") > 5000, F.col("n_chars"))), F.lit(0)).cast("long").alias("chars_long"),
        F.min("n_chars").alias("least"),
        F.max("n_chars").alias("most"),
    )


@query("""
    with c as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by 1, 2)
    select l_orderkey, string_agg(l_returnflag || ':' || n, ',' order by l_returnflag) as casts, sum(n)::bigint as total from c group by 1
""")
def vote_tally(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    casts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_returnflag", "n"))), lambda x: F.concat(x["l_returnflag"], F.lit(":"), x["n"].cast("string"))), ",")
    return c.groupBy("l_orderkey").agg(casts.alias("casts"), F.sum("n").alias("total"))


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1")
def latest_version(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""
    select 'lang' as facet, lang as value, count(*) as n from documents where lang is not null group by 2
    union all select 'source', source, count(*) from documents where source is not null group by 2
""")
def facet_counts(t: Tables) -> DataFrame:
    d = t.documents.select("lang", "source")
    # One scan: the facets become rows, and one aggregate counts them all.
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).alias("value")) for f in ("lang", "source")])).alias("f")
    return d.select(facets).select("f.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("select year(o_orderdate) as y, count(*) as n from orders group by 1 order by y")
def year_histogram(t: Tables) -> DataFrame:
    return t.orders.groupBy(year().alias("y")).agg(F.count("*").alias("n")).orderBy("y")


@query("select n_name, count(c_custkey) as n from nation left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by 1")
def zero_fill(t: Tables) -> DataFrame:
    counts = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
    with top as (select o_orderpriority from orders group by 1 order by count(*) desc, o_orderpriority limit 3)
    select year(o_orderdate) // 10 * 10 as decade, o_orderpriority, count(*) as n from orders where o_orderpriority in (select * from top) group by 1, 2
""")
def decade_pivot(t: Tables) -> DataFrame:
    top = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "o_orderpriority").limit(3)
    held = t.orders.join(F.broadcast(top.select("o_orderpriority")), "o_orderpriority", "left_semi")
    return held.groupBy(F.expr("cast(year(o_orderdate) div 10 * 10 as bigint)").alias("decade"), "o_orderpriority").agg(F.count("*").alias("n"))


@query("""
    with top as (select source, count(*) as n from documents group by 1 order by n desc, source limit 6)
    select source, n, round(100.0 * n / sum(n) over (), 2) as share from top
""")
def share_topk(t: Tables) -> DataFrame:
    top = t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source").limit(6)
    return top.select("source", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2).alias("share"))


@query("""
    select event_type, count(*) as n from events where ts > (select max(ts) from events) - interval 24 hour group by 1 order by n desc, event_type limit 5
""")
def trending(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 24 hours")).alias("since"))
    recent = t.events.join(F.broadcast(last), F.col("ts") > F.col("since"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type").limit(5)


@query("""
    select left(c_name, 1) || '. ' || string_split(c_name, '#')[2] as author, count(o_orderkey) as n from customer join orders on o_custkey = c_custkey
    group by c_custkey, c_name having count(o_orderkey) > 12
""")
def author_counts(t: Tables) -> DataFrame:
    # Counted before the join: the shuffle carries one row per customer.
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")).where("n > 12")
    author = F.concat(F.left("c_name", F.lit(1)), F.lit(". "), F.split_part("c_name", F.lit("#"), F.lit(2)))
    return t.customer.join(per, "c_custkey").select(author.alias("author"), "n")


@query("select string_split(string_split(url, '/')[3], ':')[1] as host, count(*) as n from pages group by 1")
def host_census(t: Tables) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    return t.pages.groupBy(host.alias("host")).agg(F.count("*").alias("n"))


@query("""
    with q as (select page_id, string_split(string_split(url, '/')[3], ':')[1] as host from pages)
    select host, page_id, row_number() over (partition by host order by page_id) as place, (row_number() over (partition by host order by page_id) - 1) // 20 as batch from q
""")
def host_queues(t: Tables) -> DataFrame:
    """Work by host: each host's pages in order, in batches that are drained one after another; hosts go side by side."""
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    place = F.row_number().over(W.partitionBy("host").orderBy("page_id")).cast("long")
    return t.pages.select(host.alias("host"), "page_id").withColumn("place", place).withColumn("batch", F.expr("(place - 1) div 20"))


@query("""
    select s_suppkey, round(sum(case when c_nationkey = s_nationkey then l_extendedprice else 0 end), 2) as home,
           round(sum(case when c_nationkey <> s_nationkey then l_extendedprice else 0 end), 2) as away
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1
""")
def money_split(t: Tables) -> DataFrame:
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    both = lines.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    split = lambda c: F.round(F.sum(F.when(c, F.col("l_extendedprice")).otherwise(0)), 2)
    home = F.col("c_nationkey") == F.col("s_nationkey")
    return both.groupBy("s_suppkey").agg(split(home).alias("home"), split(~home).alias("away"))


@query("""
    select c_custkey, coalesce(f, 0) as n_done, coalesce(o, 0) as n_open from customer
    left join (select o_custkey, count(*) as f from orders where o_orderstatus = 'F' group by 1) a on a.o_custkey = c_custkey
    left join (select o_custkey, count(*) as o from orders where o_orderstatus = 'O' group by 1) b on b.o_custkey = c_custkey
    where f is not null or o is not null
""")
def whip_count(t: Tables) -> DataFrame:
    # Both sides come from one aggregate of the orders.
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    sides = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(n("F").alias("n_done"), n("O").alias("n_open"))
    return t.customer.select("c_custkey").join(sides.where("n_done > 0 or n_open > 0"), "c_custkey")


@query("select o_custkey, o_orderkey from orders join (select o_custkey as k, max(year(o_orderdate)) as y from orders group by 1) on k = o_custkey and y = year(o_orderdate)")
def still_sitting(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(year().desc())
    return t.orders.withColumn("r", F.rank().over(w)).where("r = 1").select("o_custkey", "o_orderkey")


@query("""
    select doc_id, source from (select *, row_number() over (partition by coalesce(source, ''), md5(text) order by doc_id) as rn from documents) where rn = 1
""")
def dedup_rownum(t: Tables) -> DataFrame:
    keyed = t.documents.select("doc_id", "source", F.coalesce("source", F.lit("")).alias("s"), F.md5("text").alias("h"))
    return rel.distinct_on(keyed, ["s", "h"], [F.col("doc_id")]).select("doc_id", "source")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by (l_returnflag = 'R') desc, l_extendedprice desc, l_linenumber) = 1")
def distinct_on(t: Tables) -> DataFrame:
    order = [(F.col("l_returnflag") == "R").desc(), F.col("l_extendedprice").desc(), F.col("l_linenumber")]
    return rel.distinct_on(t.lineitem, ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select n_regionkey, c_custkey, rank from (select n_regionkey, c_custkey, row_number() over (partition by n_regionkey order by c_acctbal desc, c_custkey) as rank from customer join nation on c_nationkey = n_nationkey) where rank <= 10")
def per_group_cap(t: Tables) -> DataFrame:
    placed = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    top = rel.top_per_group(placed, ["n_regionkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 10)
    return top.select("n_regionkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("select y, sum(n) over (order by y)::bigint as total from (select year(o_orderdate) as y, count(*) as n from orders group by 1)")
def cumulative_years(t: Tables) -> DataFrame:
    per = t.orders.groupBy(year().alias("y")).agg(F.count("*").alias("n"))
    return per.select("y", F.sum("n").over(W.orderBy("y").rowsBetween(W.unboundedPreceding, 0)).alias("total"))


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place, round(100 * o_totalprice / (select max(o_totalprice) from orders)) as score from orders order by o_totalprice desc, o_orderkey limit 25")
def relevance_by_rank(t: Tables) -> DataFrame:
    top = t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)
    order = W.orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    most = F.max("o_totalprice").over(W.partitionBy())
    return top.select("o_orderkey", F.row_number().over(order).cast("long").alias("place"), F.round(100 * F.col("o_totalprice") / most).alias("score"))


@query("select c_custkey, rank from (select o_custkey as c_custkey, row_number() over (order by sum(o_totalprice) desc, o_custkey) as rank from orders group by 1) where rank <= 20")
def top_contributors(t: Tables) -> DataFrame:
    top = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("paid")).orderBy(F.col("paid").desc(), "c_custkey").limit(20)
    return top.select("c_custkey", F.row_number().over(W.orderBy(F.col("paid").desc(), "c_custkey")).cast("long").alias("rank"))


@query("select o_orderkey, o_custkey from orders where o_orderkey > 500 order by o_orderkey limit 100")
def keyset_page(t: Tables) -> DataFrame:
    return rel.keyset_page(t.orders, "o_orderkey", 500, 100).select("o_orderkey", "o_custkey")


@query("select c_custkey from customer left join (select o_custkey, max(o_orderdate) as seen from orders group by 1) on o_custkey = c_custkey where seen is null or seen < timestamp '1998-01-01' order by (c_acctbal < 0), seen nulls first, c_custkey limit 200")
def refresh_queue(t: Tables) -> DataFrame:
    seen = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    stale = F.col("seen").isNull() | (F.col("seen") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return t.customer.join(seen, "c_custkey", "left").where(stale).orderBy(F.col("c_acctbal") < 0, F.col("seen").asc_nulls_first(), "c_custkey").limit(200).select("c_custkey")


@query("select source, ((row_number() over (order by sum(n_chars) desc, source)) - 1) % 4 as shard from documents group by 1")
def round_robin_shard(t: Tables) -> DataFrame:
    sizes = t.documents.groupBy("source").agg(F.sum("n_chars").alias("size"))
    return sizes.select("source", F.pmod(F.row_number().over(W.orderBy(F.col("size").desc(), "source")) - 1, F.lit(4)).cast("long").alias("shard"))


@query("""
    with a as (select o_orderkey as k, row_number() over (order by o_totalprice desc, o_orderkey) as r from orders order by r limit 30),
         b as (select o_orderkey as k, row_number() over (order by o_orderdate desc, o_orderkey) as r from orders order by r limit 30),
         u as (select k, r * 2 as place, 0 as arm from a union all select k, r * 2 + 1, 1 from b)
    select k, min(place) as place from u group by 1 order by place limit 40
""")
def interleave_merge(t: Tables) -> DataFrame:
    def arm(order: list) -> DataFrame:
        top = t.orders.orderBy(*order).limit(30)
        return top.select(F.col("o_orderkey").alias("k"), F.row_number().over(W.orderBy(*order)).cast("long").alias("r"))

    arms = [arm([F.col("o_totalprice").desc(), F.col("o_orderkey")]), arm([F.col("o_orderdate").desc(), F.col("o_orderkey")])]
    return rel.interleaved(arms, "k", "r", 40).select("k", "place")


@query("select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def traffic_daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("select date_trunc('hour', ts) as hour, count(*) as n from events where ts > (select max(ts) from events) - interval 3 day group by 1")
def traffic_hourly(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 3 days")).alias("since"))
    recent = t.events.join(F.broadcast(last), F.col("ts") > F.col("since"))
    return recent.groupBy(F.window("ts", "1 hour")["start"].alias("hour")).agg(F.count("*").alias("n"))


@query("""
    with c as (select user_id % 20 as zone, event_type, count(*) as n from events group by 1, 2)
    select zone, string_agg(event_type || '=' || n, ';' order by event_type) as by_type from c group by 1
""")
def traffic_dim(t: Tables) -> DataFrame:
    c = t.events.groupBy((F.col("user_id") % 20).alias("zone"), "event_type").agg(F.count("*").alias("n"))
    by = F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))
    text = F.array_join(F.transform(F.map_entries(by), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return c.groupBy("zone").agg(text.alias("by_type"))


@query("""
    with a as (select l_orderkey as k, list_distinct(list(l_partkey % 11)) as s from lineitem group by 1),
         b as (select l_orderkey as k, list_distinct(list(l_partkey % 11)) as s from lineitem where l_linenumber <> 2 group by 1)
    select round(avg(len(list_intersect(a.s, b.s)) / greatest(len(a.s), len(b.s), 1)), 4) as mean_overlap, count(*) as n from a join b using (k)
""")
def sponsor_overlap(t: Tables) -> DataFrame:
    # Both sets in one pass: the second is a conditional aggregate of the first's rows.
    part = F.col("l_partkey") % 11
    sets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(part).alias("a"), F.collect_set(F.when(F.col("l_linenumber") != 2, part)).alias("b"))
    share = F.size(F.array_intersect("a", "b")) / F.greatest(F.size("a"), F.size("b"), F.lit(1))
    return sets.where(F.size("b") > 0).agg(F.round(F.avg(share), 4).alias("mean_overlap"), F.count("*").alias("n"))


@query("select l_orderkey, l_linenumber from lineitem qualify row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) = 1")
def last_write_wins(t: Tables) -> DataFrame:
    from lodestrata.operators.merge import last_write_wins as latest

    return latest(t.lineitem, ["l_partkey"], F.struct("l_shipdate", "l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber")


@query("""
    with ordered as (select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
    select o_custkey, count(*) = 2 and bool_and(o_orderstatus = 'O') as ready from ordered where r <= 2 group by 1
""")
def promote_gate(t: Tables) -> DataFrame:
    last = rel.top_per_group(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 2)
    return last.groupBy("o_custkey").agg(((F.count("*") == 2) & F.bool_and(F.col("o_orderstatus") == "O")).alias("ready"))


@query("select c_custkey, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) as raw, regexp_replace(upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), '^([A-Z]+)0+([0-9])', '\\1\\2') as bill_key from customer")
def norm_key(t: Tables) -> DataFrame:
    raw = F.upper(F.regexp_replace("c_name", "[^A-Za-z0-9]", ""))
    return t.customer.select("c_custkey", raw.alias("raw"), normalize.bill_key(F.col("c_name")).alias("bill_key"))

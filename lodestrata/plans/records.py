"""Normalisers, parsers, merges, change capture, reconciliation and the lake, on stand-in keys of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.functions import normalize, parse, text
from lodestrata.operators import merge, resolve
from lodestrata.operators import relational as rel
from lodestrata.plans.registry import Tables, query
from lodestrata.sources import lake

# ---- normalisers -------------------------------------------------------------------------------------------


@query("select o_orderkey, 2025 * 1000000 + case when o_orderkey % 2 = 0 then 500000 else 0 end + o_orderkey as minted from orders")
def mint_id(t: Tables) -> DataFrame:
    number = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("S"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))
    return t.orders.select("o_orderkey", normalize.minted_id(number, F.lit(2025)).alias("minted"))


@query("""
    select event_type, case upper(left(event_type, 1)) when 'A' then 'H' when 'H' then 'H' when 'L' then 'H' when 'S' then 'S' when 'U' then 'S' when 'J' then 'J' end as chamber,
           count(*) as n from (select event_type from events union all select n_name from nation) group by 1, 2
""")
def norm_chamber(t: Tables) -> DataFrame:
    names = t.events.select("event_type").union(t.nation.select("n_name"))
    return names.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", normalize.chamber(F.col("event_type")).alias("chamber"), "n")


@query("""
    select s_suppkey, coalesce(nullif(regexp_replace(regexp_replace(upper('sd-0' || s_suppkey), '^[A-Z]+-', ''), '^0+([0-9A-Z])', '\\1'), ''), '?') as district,
           case when s_suppkey <> 0 then case when s_suppkey % 2 = 0 then 'SD-' else 'HD-' end || case when s_suppkey < 100 then lpad(s_suppkey::varchar, 3, '0') else s_suppkey::varchar end end as code
    from supplier
""")
def norm_district(t: Tables) -> DataFrame:
    house = F.when(F.col("s_suppkey") % 2 == 0, "SENATE").otherwise("ASSEMBLY")
    return t.supplier.select(
        "s_suppkey",
        normalize.district(F.concat(F.lit("sd-0"), F.col("s_suppkey").cast("string"))).alias("district"),
        normalize.district_code(F.col("s_suppkey").cast("string"), house).alias("code"),
    )


@query("""
    select l_returnflag, l_linestatus, case when upper(l_returnflag) in ('YEA', 'AYE', 'AYEWR', 'Y', 'YES') then 'Y' when upper(l_returnflag) in ('NAY', 'NO', 'N') then 'N'
           when upper(l_returnflag) in ('NV', 'ABD', 'ABSTAIN', 'NOT VOTING') then 'X' when upper(l_returnflag) in ('ABSENT', 'ABS', 'EXC', 'EXCUSED') then 'A' else 'O' end as vote, count(*) as n
    from lineitem group by 1, 2, 3
""")
def norm_vote(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return per.select("l_returnflag", "l_linestatus", normalize.vote(F.col("l_returnflag")).alias("vote"), "n")


@query("""
    select n_nationkey, upper(regexp_replace(case when n_nationkey % 3 = 0 then n_name else regexp_replace(n_name, '^.*\\s', '') end, '[^A-Za-z-]', '', 'g')) as surname
    from nation
""")
def surname(t: Tables) -> DataFrame:
    k = F.col("n_nationkey") % 3
    name = (
        F.when(k == 0, F.concat("n_name", F.lit(", Al")))
        .when(k == 1, F.concat(F.lit("Joseph P. "), F.col("n_name"), F.lit(" Jr.")))
        .otherwise(F.col("n_name"))
    )
    return t.nation.select("n_nationkey", normalize.surname(name).alias("surname"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 'US' else upper(left(c_mktsegment, 2)) end as state from customer")
def normalise_state(t: Tables) -> DataFrame:
    label = F.when(F.col("c_custkey") % 8 == 0, "U.S. House").when(F.col("c_custkey") % 4 == 0, " us senate").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", normalize.state_code(label).alias("state"))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from part")
def slug(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", normalize.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("select p_brand, lower(regexp_replace(regexp_replace(regexp_replace('My' || p_brand || ' Table', '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g')) as lake_name from (select distinct p_brand from part)")
def lake_name(t: Tables) -> DataFrame:
    return t.part.select("p_brand").distinct().select("p_brand", normalize.lake_name(F.concat(F.lit("My"), F.col("p_brand"), F.lit(" Table"))).alias("lake_name"))


@query("select doc_id, md5(trim(strip_accents(lower(text)))) as plain from documents")
def strip_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(normalize.strip_accents(F.col("text"))).alias("plain"))


@query("""
    select o_orderkey, left(strftime(o_orderdate, '%Y-%m-%d'), 10) as day, epoch(o_orderdate)::bigint as seconds,
           date_trunc('month', o_orderdate)::timestamp as month, strftime(o_orderdate - interval 7 day, '%Y-%m-%d') as week_before from orders
""")
def date_funcs(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.substring(d.cast("string"), 1, 10).alias("day"),
        F.unix_timestamp(d).alias("seconds"),
        F.date_trunc("month", d).alias("month"),
        F.date_format(F.date_sub(d, 7), "yyyy-MM-dd").alias("week_before"),
    )


@query("select distinct year(o_orderdate)::bigint as y, ((year(o_orderdate) - 1787) // 2)::bigint as congress, (year(o_orderdate) - (1 - year(o_orderdate) % 2))::bigint as session from orders")
def session_math(t: Tables) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    return t.orders.select(y.alias("y")).distinct().select("y", F.expr("(y - 1787) div 2").alias("congress"), (F.col("y") - (1 - F.col("y") % 2)).alias("session"))


@query("select doc_id, sha256(text) as sha256, substr(sha1(text), 1, 10) as action_key, md5(text) as md5 from documents")
def hash_keys(t: Tables) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", F.sha2(data, 256).alias("sha256"), F.substring(F.sha1(data), 1, 10).alias("action_key"), F.md5(data).alias("md5"))


@query("select md5('space:' || lower(trim(text))) as text_hash, count(*) as hits from conversations group by 1")
def md5_cache_key(t: Tables) -> DataFrame:
    key = F.md5(F.concat(F.lit("space:"), F.lower(F.trim("text"))))
    return t.conversations.groupBy(key.alias("text_hash")).agg(F.count("*").alias("hits"))


@query("select s_suppkey, string_split(s_name, '#')[2] as number, left(s_name, 4) as head, position('#' in s_name)::int as at, trim('  ' || s_name || ' ') as bare, upper(left(lower(s_name), 1)) || substr(lower(s_name), 2) as title from supplier")
def string_funcs(t: Tables) -> DataFrame:
    return t.supplier.select(
        "s_suppkey",
        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("number"),
        F.left("s_name", F.lit(4)).alias("head"),
        F.instr("s_name", "#").alias("at"),
        F.trim(F.concat(F.lit("  "), F.col("s_name"), F.lit(" "))).alias("bare"),
        normalize.title_case(F.col("s_name")).alias("title"),
    )


@query("select event_id, (props->>'k')::int as k, '{\"k\":' || (props->>'k') || ',\"type\":\"' || event_type || '\"}' as payload from events")
def json_ops(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("payload"))


# ---- parsers -----------------------------------------------------------------------------------------------


@query("""
    with m as (select o_orderkey, 'see H.R. ' || (o_orderkey % 900 + 1) || ' and S. ' || (o_orderkey % 70 + 1) || ', H.J.Res. 7; again S. ' || (o_orderkey % 70 + 1) as t from orders)
    select o_orderkey, 'HB' || (o_orderkey % 900 + 1) || ',SB' || (o_orderkey % 70 + 1) || ',HJR7' as mentions from m
""")
def extract_mentions(t: Tables) -> DataFrame:
    n = lambda m: (F.col("o_orderkey") % m + 1).cast("string")
    prose = F.concat(F.lit("see H.R. "), n(900), F.lit(" and S. "), n(70), F.lit(", H.J.Res. 7; again S. "), n(70))
    return t.orders.select("o_orderkey", F.array_join(parse.bill_mentions(prose), ",").alias("mentions"))


@query("select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') as lang, try_cast(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') as int) as number from pages")
def parse_ids(t: Tables) -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return t.pages.select("page_id", F.regexp_extract("url", "^(https?)://", 1).alias("scheme"), part("/([a-z]{2})/").alias("lang"), part("/[a-z]{2}/([0-9]+)").try_cast("int").alias("number"))


@query("select c_custkey, 'John_' || c_custkey as ballotpedia, (c_custkey % 1000)::varchar as votesmart, 'N' || lpad(c_custkey::varchar, 8, '0') as opensecrets from customer")
def external_ids(t: Tables) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    links = F.concat_ws(
        "\n",
        F.concat(F.lit("- url: https://ballotpedia.org/John_"), k),
        F.concat(F.lit("- url: https://votesmart.org/candidate/"), (F.col("c_custkey") % 1000).cast("string")),
        F.concat(F.lit("- url: https://www.opensecrets.org/members/x?cid="), F.lit("N"), F.lpad(k, 8, "0")),
    )
    ids = parse.external_ids(links)
    return t.customer.select("c_custkey", ids["ballotpedia"], ids["votesmart"], ids["opensecrets"])


@query("""
    select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) <> '' as has_text,
           regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title from pages
""")
def page_metadata(t: Tables) -> DataFrame:
    body = F.trim(F.regexp_replace(text.html_markup_out(F.col("html")), r"\s+", " "))
    return t.pages.select("page_id", (body != "").alias("has_text"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query("select o_orderpriority || ' Rev. C' as journal, count(*) as n from orders group by 1")
def journal_counts(t: Tables) -> DataFrame:
    reference = F.concat(F.col("o_orderpriority"), F.lit(" Rev. C 100, 064319 (2019)"))
    per = t.orders.groupBy(reference.alias("r")).agg(F.count("*").alias("n"))
    return per.select(text.journal_of(F.col("r")).alias("journal"), "n").where("journal is not null").groupBy("journal").agg(F.sum("n").alias("n"))


@query("select doc_id, length(text) > 0 and length(text) < 400 and contains(lower(text), 'enable javascript to run this app') as is_shell from documents")
def low_content(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.coalesce(text.is_shell(F.col("text")), F.lit(False)).alias("is_shell"))


@query("select event_type, (case when event_id % 3 = 0 then 'gs://bucket/' || (event_id % 600) end) as uri, count(*) as n, string_agg(event_id, ',' order by event_id) as ids from events where event_id % 3 = 0 group by 1, 2")
def stub_groups(t: Tables) -> DataFrame:
    error = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("deferred: gs://bucket/"), (F.col("event_id") % 600).cast("string"), F.lit(" later")))
    stubs = t.events.select("event_id", "event_type", F.nullif(F.regexp_extract(error, r"(gs://\S+)", 1), F.lit("")).alias("uri")).where("uri is not null")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",")
    return stubs.groupBy("event_type", "uri").agg(F.count("*").alias("n"), ids.alias("ids"))


@query("select event_id, try_cast((props->>'k') as int) as k, case when event_id % 5 = 0 then null else round(value, 2) end as v, event_type = 'view' as flag from events")
def coerce_types(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    v = F.when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("value").cast("string"))
    flag = F.when(F.col("event_type") == "view", "t").otherwise("f")
    return t.events.select("event_id", lake.coerced(k, "int4").alias("k"), F.round(lake.coerced(v, "numeric"), 2).alias("v"), lake.coerced(flag, "bool").alias("flag"))


# ---- merges and change capture -----------------------------------------------------------------------------

_DELTA = "select o_orderkey + case when o_orderkey % 8 = 0 then 10000000 else 0 end as k, case when o_orderkey % 6 = 0 then o_orderpriority else 'changed' end as p from orders where o_orderkey % 2 = 0"
_BASE = "select o_orderkey as k, o_orderpriority as p from orders"


def _base_and_delta(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    new_key = F.col("k") + F.when(F.col("k") % 8 == 0, 10_000_000).otherwise(0)
    delta = base.where("k % 2 = 0").select(new_key.alias("k"), F.when(F.col("k") % 6 == 0, F.col("p")).otherwise("changed").alias("p"))
    return base, delta


@query(f"with d as ({_DELTA}), b as ({_BASE}) select coalesce(d.k, b.k) as k, case when d.k is not null then d.p else b.p end as p from b full join d on b.k = d.k")
def upsert_merge(t: Tables) -> DataFrame:
    return merge.upsert(*_base_and_delta(t), ["k"])


@query(f"with d as ({_DELTA}), b as ({_BASE}) select case when b.k is null then 'inserted' when b.p is not distinct from d.p then 'unchanged' else 'updated' end as verdict, count(*) as n from d left join b on b.k = d.k group by 1")
def upsert_hash_guard(t: Tables) -> DataFrame:
    hashed = [df.withColumn("h", F.md5("p")) for df in _base_and_delta(t)]
    return merge.upsert_verdicts(*hashed, ["k"], "h").groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"with d as (select k, nullif(p, 'changed') as p from ({_DELTA})), b as ({_BASE}) select coalesce(d.k, b.k) as k, coalesce(d.p, b.p) as p from b full join d on b.k = d.k")
def upsert_coalesce(t: Tables) -> DataFrame:
    base, delta = _base_and_delta(t)
    return merge.upsert_coalesce(base, delta.withColumn("p", F.nullif("p", F.lit("changed"))), ["k"], ["p"])


@query("""
    with d as (select o_orderkey as k, o_orderdate + case when o_orderkey % 4 = 0 then interval 1 day else interval '-1' day end as d, 'new' as p from orders where o_orderkey % 2 = 0)
    select o_orderkey as k, case when d.d >= o_orderdate then d.d else o_orderdate end as d, case when d.d >= o_orderdate then d.p else o_orderpriority end as p from orders left join d on d.k = o_orderkey
""")
def upsert_monotone(t: Tables) -> DataFrame:
    base = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("d"), F.col("o_orderpriority").alias("p"))
    shift = F.when(F.col("k") % 4 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))
    delta = base.where("k % 2 = 0").select("k", (F.col("d") + shift).alias("d"), F.lit("new").alias("p"))
    return merge.upsert_monotone(base, delta, ["k"], "d", ["p"])


@query(f"with d as ({_DELTA}), b as ({_BASE}) select * from b union all select * from d where k not in (select k from b)")
def insert_ignore(t: Tables) -> DataFrame:
    return merge.insert_ignore(*_base_and_delta(t), ["k"])


@query("""
    with d as (select l_orderkey, l_linenumber + 100 as l_linenumber from lineitem where l_orderkey % 3 = 0 and l_linenumber <= 2)
    select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select l_orderkey from d) union all select * from d
""")
def replace_children(t: Tables) -> DataFrame:
    base = t.lineitem.select("l_orderkey", "l_linenumber")
    delta = base.where("l_orderkey % 3 = 0 and l_linenumber <= 2").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    return merge.replace_children(base, delta, ["l_orderkey"])


@query("select event_id, event_type from events where ts >= timestamp '2024-01-15'")
def mark_sweep(t: Tables) -> DataFrame:
    return merge.sweep(t.events.select("event_id", "event_type", "ts"), "ts", "2024-01-15 00:00:00").select("event_id", "event_type")


@query("select c_custkey, nullif(coalesce(m, 0), 0) as most from customer left join (select o_custkey, max(o_totalprice) as m from orders where o_orderstatus = 'F' group by 1) on o_custkey = c_custkey")
def restamp(t: Tables) -> DataFrame:
    most = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    return t.customer.join(most, "c_custkey", "left").select("c_custkey", F.nullif(F.coalesce("m", F.lit(0.0)), F.lit(0.0)).alias("most"))


@query("""
    select k, src from (select o_custkey as k, o_orderpriority as src, row_number() over (partition by o_custkey order by case left(o_orderpriority, 1) when '1' then 0 when '2' then 1 else 2 end, o_orderkey) as r from orders) where r = 1
""")
def source_priority(t: Tables) -> DataFrame:
    first = F.left("o_orderpriority", F.lit(1))
    rank = F.when(first == "1", 0).when(first == "2", 1).otherwise(2)
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("src"), "o_orderkey")
    held = rows.withColumn("rank", F.when(F.left("src", F.lit(1)) == "1", 0).when(F.left("src", F.lit(1)) == "2", 1).otherwise(2))
    return merge.source_priority(held, ["k"], F.col("rank"), F.col("o_orderkey")).select("k", "src")


@query("select event_id from events where ts > (select max(ts) from events) - interval 7 day and event_type <> 'error'")
def incremental_window(t: Tables) -> DataFrame:
    last = t.events.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    return t.events.join(F.broadcast(last), F.col("ts") > F.col("since")).where("event_type <> 'error'").select("event_id")


@query("select strftime(least(max(o_orderdate) - interval 1 day, timestamp '1998-08-01' - interval 1 day), '%Y-%m-%d') as since from orders where o_orderdate <= timestamp '1998-08-01'")
def high_water(t: Tables) -> DataFrame:
    today = F.lit("1998-08-01").cast("timestamp_ntz")
    past = t.orders.where(F.col("o_orderdate") <= today)
    return past.agg(F.date_format(F.least(F.max("o_orderdate"), today) - F.expr("interval 1 day"), "yyyy-MM-dd").alias("since"))


@query("""
    with known as (select o_orderkey as k, md5(o_orderpriority) as h from orders where o_orderkey % 7 <> 0)
    select o_orderkey, case when k is null then 'new' else 'changed' end as why from orders left join known on k = o_orderkey
    where k is null or h is distinct from md5(case when o_orderkey % 5 = 0 then 'x' else o_orderpriority end)
""")
def change_hash_delta(t: Tables) -> DataFrame:
    known = t.orders.where("o_orderkey % 7 <> 0").select("o_orderkey", F.md5("o_orderpriority").alias("h"), F.lit(True).alias("held"))
    remote = t.orders.select("o_orderkey", F.md5(F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_orderpriority"))).alias("r"))
    both = remote.join(known, "o_orderkey", "left").where(~F.col("h").eqNullSafe(F.col("r")))
    return both.select("o_orderkey", F.when(F.col("held").isNull(), "new").otherwise("changed").alias("why"))


_LEDGER_SETS = "select lang, source, count(*) as docs, sum(coalesce(n_chars, 0))::bigint || '-' || count(*) as h from documents {} group by 1, 2"


@query(f"""
    with remote as ({_LEDGER_SETS.format("")}), led as (select lang, source, case when lang <> 'es' then h end as h, true as held from ({_LEDGER_SETS.format("where lang <> 'fr' and (lang <> 'de' or doc_id % 10 <> 0)")}) x),
    planned as (select r.lang, r.source, r.docs, case when l.held is null then 'new' when l.h is null then 'seeded' when l.h = r.h then 'unchanged' else 'changed' end as plan
      from remote r left join led l on l.lang is not distinct from r.lang and l.source is not distinct from r.source),
    queued as (select coalesce(sum(docs) filter (plan in ('new', 'changed')), 0) as n, sum(docs) as of from planned)
    select lang, source, plan, n * 4 > of as refused from planned, queued
""")
def ledger_plan(t: Tables) -> DataFrame:
    """Datasets against the ledger of what was loaded: new, seeded (known without a hash), changed or unchanged; refused as a whole where more than a quarter would be fetched again."""
    h = F.concat_ws("-", F.sum(F.coalesce("n_chars", F.lit(0))).cast("string"), F.count("*").cast("string")).alias("h")
    remote = t.documents.groupBy("lang", "source").agg(F.count("*").alias("docs"), h)
    loaded = t.documents.where((F.col("lang") != "fr") & ((F.col("lang") != "de") | (F.col("doc_id") % 10 != 0))).groupBy("lang", "source").agg(h)
    ledger = loaded.withColumn("h", F.when(F.col("lang") != "es", F.col("h")))
    return merge.ledger_decisions(remote, ledger, ["lang", "source"], "h", "docs", 0.25).select("lang", "source", "plan", "refused")


@query("select count(*) filter (l.doc_id is not null) as keep, count(*) filter (l.doc_id is null) as mint, -max(d.doc_id) filter (l.doc_id is null) as lowest from documents d left join labels l using (doc_id)")
def promote_plan(t: Tables) -> DataFrame:
    held = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("held")), "doc_id", "left")
    new = F.col("held").isNull()
    return held.agg(F.count("held").alias("keep"), F.count_if(new).alias("mint"), (-F.max(F.when(new, F.col("doc_id")))).alias("lowest"))


# ---- entity resolution and reconciliation ------------------------------------------------------------------


@query("""
    with q as (select o_orderkey as qid, case o_orderkey % 4 when 0 then 'HB' || lpad((o_orderkey % 1500 + 1)::varchar, 9, '0') when 1 then 'HB' || (o_orderkey % 1500 + 1) when 2 then 'H' || (o_orderkey % 1500 + 1) else 'ZZ' || (o_orderkey % 1500 + 1) end as num from orders),
         b as (select c_custkey as id, 'HB' || lpad(c_custkey::varchar, 9, '0') as num from customer)
    select qid, b.id, case when b.id is null then null when qid % 4 = 0 then 1 when qid % 4 = 1 then 2 when qid % 4 = 2 then 3 else 4 end as pass from q left join b on b.id = qid % 1500 + 1
""")
def resolve_ladder(t: Tables) -> DataFrame:
    n = F.col("o_orderkey") % 1500 + 1
    k = F.col("o_orderkey") % 4
    num = F.concat(F.when(k < 2, "HB").when(k == 2, "H").otherwise("ZZ"), F.when(k == 0, F.lpad(n.cast("string"), 9, "0")).otherwise(n.cast("string")))
    asked = t.orders.select(F.col("o_orderkey").alias("qid"), num.alias("num"))
    bills = t.customer.select(F.col("c_custkey").alias("id"), F.concat(F.lit("HB"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("num"))
    c = F.col("num")
    unpadded = F.regexp_replace(F.upper(c), "^([A-Z]*)0+", "$1")
    initial = F.regexp_replace(F.upper(c), "^([A-Z])[A-Z]*0*", "$1")
    digits = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+", "")
    passes = [([c], [c], False), ([unpadded], [unpadded], False), ([initial], [initial], False), ([digits], [digits], True)]
    return resolve.ladder(asked, bills, "qid", "id", passes)


@query("""
    with m as (select c_custkey as mid, c_nationkey as district, c_name as full_name, c_custkey % 3 as k from customer)
    select mid, mid as person_id, case when k = 0 then 1 when k = 1 then 2 else 3 end as pass from m
""")
def person_match(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 3
    number = F.split_part("c_name", F.lit("#"), F.lit(2))
    people = t.customer.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("district"), number.alias("last"), F.lower("c_name").alias("full"), F.lit("customer").alias("first"))
    members = t.customer.select(
        F.col("c_custkey").alias("mid"),
        F.when(k == 0, F.col("c_nationkey")).alias("district"),
        number.alias("last"),
        F.when(k == 1, F.lower("c_name")).otherwise("?").alias("full"),
        F.lit("customer").alias("first"),
    )
    col = F.col
    passes = [([col("district"), col("last")],) * 2 + (False,), ([col("full")],) * 2 + (False,), ([col("first"), col("last")],) * 2 + (False,)]
    return resolve.ladder(members, people, "mid", "person_id", passes)


@query("""
    with ours as (select c_nationkey as d, c_mktsegment || floor(c_acctbal)::bigint as s, c_custkey as id from customer),
         theirs as (select d, s, id as nid, id % 5 = 0 as strict from ours),
         uniq as (select d, s from ours group by 1, 2 having count(*) = 1)
    select nid, case when strict then nid when u.d is not null then nid end as id, case when strict then 'strict' when u.d is not null then 'loose' end as how from theirs t left join uniq u on u.d = t.d and u.s = t.s
""")
def xref_strict_loose(t: Tables) -> DataFrame:
    segment = F.concat("c_mktsegment", F.floor("c_acctbal").cast("string"))
    rows = t.customer.select(F.col("c_nationkey").alias("d"), segment.alias("s"), F.col("c_custkey").alias("id"))
    theirs = rows.select("d", "s", F.col("id").alias("nid"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("exact"))
    passes = [([F.col("exact")], [F.col("id")], False), ([F.col("d"), F.col("s")], [F.col("d"), F.col("s")], True)]
    found = resolve.ladder(theirs, rows, "nid", "id", passes)
    return found.select("nid", "id", F.when(F.col("pass") == 1, "strict").when(F.col("pass") == 2, "loose").alias("how"))


_OURS = "select l_orderkey as k, l_partkey % 50 as m from lineitem where l_orderkey % 37 <> 0"
_THEIRS = "select l_orderkey as k, case when l_orderkey % 29 = 0 then l_partkey % 49 else l_partkey % 50 end as m from lineitem where l_orderkey % 41 <> 0"


@query(f"""
    with o as (select k, count(*) as n, list_sort(list_distinct(list(m))) as s from ({_OURS}) group by 1), t as (select k, count(*) as n, list_sort(list_distinct(list(m))) as s from ({_THEIRS}) group by 1),
         c as (select count(o.k) as ours, count(t.k) as theirs, count(*) filter (o.k is not null and t.k is not null) as matched, count(*) filter (o.n = t.n) as same_count, count(*) filter (o.s = t.s) as same_set from o full join t on o.k = t.k),
         p as (select ours, theirs, matched, least(round(100.0 * matched / ours, 2), round(100.0 * matched / theirs, 2)) as bills_pct, round(100.0 * same_count / matched, 2) as actions_pct, round(100.0 * same_set / matched, 2) as sponsors_pct from c)
    select *, case when bills_pct = 0 then 'failed' when bills_pct >= 99 and actions_pct >= 97 and sponsors_pct >= 97 then 'parity' when bills_pct >= 95 and actions_pct >= 90 and sponsors_pct >= 90 then 'close' else 'gap' end as verdict from p
""")
def reconcile(t: Tables) -> DataFrame:
    k, m = F.col("l_orderkey").alias("k"), F.col("l_partkey")
    ours = t.lineitem.where("l_orderkey % 37 <> 0").select(k, (m % 50).alias("m"))
    theirs = t.lineitem.where("l_orderkey % 41 <> 0").select(k, F.when(F.col("l_orderkey") % 29 == 0, m % 49).otherwise(m % 50).alias("m"))
    return resolve.reconcile(ours, theirs, ["k"], "m")


@query(f"with o as (select distinct k from ({_OURS})), t as (select distinct k from ({_THEIRS})) select 'ours' as side, k from o where k not in (select k from t) union all select 'theirs', k from t where k not in (select k from o)")
def two_way_diff(t: Tables) -> DataFrame:
    keys = lambda m: t.lineitem.where(f"l_orderkey % {m} <> 0").select(F.col("l_orderkey").alias("k")).distinct()
    ours, theirs = keys(37), keys(41)
    mine = ours.join(theirs, "k", "left_anti").select(F.lit("ours").alias("side"), "k")
    return mine.unionByName(theirs.join(ours, "k", "left_anti").select(F.lit("theirs").alias("side"), "k"))


@query("""
    with a as (select distinct l_orderkey as r, l_suppkey % 100 as p, l_returnflag as v from lineitem), b as (select distinct l_orderkey as r, l_suppkey % 100 as p, case when l_orderkey % 17 = 0 then 'X' else l_returnflag end as v from lineitem),
         a1 as (select r, p, min(v) as v from a group by 1, 2), b1 as (select r, p, min(v) as v from b group by 1, 2)
    select count(*) as pairs, count(*) filter (a1.v = b1.v) as agree, round(100.0 * count(*) filter (a1.v = b1.v) / count(*), 2) as pct from a1 join b1 using (r, p)
""")
def vote_agreement(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("r"), (F.col("l_suppkey") % 100).alias("p"), F.col("l_returnflag").alias("v"))
    other = F.when(F.col("r") % 17 == 0, "X").otherwise(F.col("v"))
    both = lines.groupBy("r", "p").agg(F.min("v").alias("a"), F.min(other).alias("b"))
    agree = F.count_if(F.col("a") == F.col("b"))
    return both.agg(F.count("*").alias("pairs"), agree.alias("agree"), F.round(100.0 * agree / F.count("*"), 2).alias("pct"))


@query("""
    select o.o_orderkey, l_linenumber from orders o join lineitem l on l.l_orderkey = o.o_orderkey and upper(left(o_orderstatus, 1)) = upper(left(l_linestatus, 1))
      and (case when l_linenumber % 2 = 0 then null else l_returnflag end) is not distinct from (case when o_orderkey % 2 = 0 then null else 'N' end)
""")
def rollcall_match(t: Tables) -> DataFrame:
    mine = t.orders.select("o_orderkey", F.upper(F.left("o_orderstatus", F.lit(1))).alias("s"), F.when(F.col("o_orderkey") % 2 != 0, "N").alias("f"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.upper(F.left("l_linestatus", F.lit(1))).alias("s2"), F.when(F.col("l_linenumber") % 2 != 0, F.col("l_returnflag")).alias("f2"))
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("s") == F.col("s2")) & F.col("f").eqNullSafe(F.col("f2"))
    return mine.join(lines, on).select("o_orderkey", "l_linenumber")


@query("""
    with pairs as (select l_suppkey % 20 as theirs, l_partkey % 15 as ours, count(distinct l_orderkey) as shared from lineitem group by 1, 2), tot as (select l_suppkey % 20 as theirs, count(distinct l_orderkey) as n from lineitem group by 1),
         r as (select *, row_number() over (partition by theirs order by shared desc, ours desc) as rn from pairs)
    select r.theirs, r.ours, r.shared, round(100.0 * r.shared / n, 2) as overlap_pct from r join tot using (theirs) where rn = 1
""")
def session_map(t: Tables) -> DataFrame:
    lines = t.lineitem.select((F.col("l_suppkey") % 20).alias("theirs"), (F.col("l_partkey") % 15).alias("ours"), "l_orderkey")
    pairs = lines.groupBy("theirs", "ours").agg(F.countDistinct("l_orderkey").alias("shared"))
    totals = lines.groupBy("theirs").agg(F.countDistinct("l_orderkey").alias("n"))
    best = rel.distinct_on(pairs, ["theirs"], [F.col("shared").desc(), F.col("ours").desc()])
    share = F.round(100.0 * F.col("shared") / F.col("n"), 2)
    checked = F.when(share <= 100, share).otherwise(F.raise_error(F.lit("an overlap of more than 100 % is an error in the keys")))
    return best.join(totals, "theirs").select("theirs", "ours", "shared", checked.alias("overlap_pct"))


@query("select count(*) as rows, count(distinct (o_custkey, o_orderdate)) as keys, count(*) = count(distinct (o_custkey, o_orderdate)) as covered from orders")
def coverage_check(t: Tables) -> DataFrame:
    keys = F.countDistinct(F.struct("o_custkey", "o_orderdate"))
    return t.orders.agg(F.count("*").alias("rows"), keys.alias("keys"), (F.count("*") == keys).alias("covered"))


@query("select o_orderkey, o_orderkey as doc_id, 'number' as how from orders where o_orderkey % 3 = 0 union all select o_orderkey, o_orderkey, 'kind' from orders where o_orderkey % 3 = 1 union all select o_orderkey, null, null from orders where o_orderkey % 3 = 2")
def version_match(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    versions = t.orders.select("o_orderkey", F.when(k % 3 == 0, k).alias("number"), F.when(k % 3 == 1, F.concat(F.lit("kind-"), k.cast("string"))).alias("kind"))
    docs = t.orders.where("o_orderkey % 3 < 2").select(k.alias("doc_id"), k.alias("number"), F.concat(F.lit("kind-"), k.cast("string")).alias("kind"))
    found = resolve.ladder(versions, docs, "o_orderkey", "doc_id", [([F.col("number")],) * 2 + (False,), ([F.col("kind")],) * 2 + (True,)])
    return found.select("o_orderkey", "doc_id", F.when(F.col("pass") == 1, "number").when(F.col("pass") == 2, "kind").alias("how"))


@query("""
    select o_orderkey, case when regexp_matches(a, 'signed chap|signed by|approved by governor|chapter \\d+') then 6 when regexp_matches(a, 'veto') then 7 when regexp_matches(a, 'delivered to governor') then 5
        when regexp_matches(a, 'adopted') then 6 when regexp_matches(a, 'stricken') then 9 when regexp_matches(a, 'substituted') then 8 when regexp_matches(a, 'passed (senate|assembly)') then 4
        when regexp_matches(a, 'third reading|calendar|floor') then 3 when regexp_matches(a, 'referred to|committee|reported') then 2 else 1 end as status
    from (select o_orderkey, lower(case o_orderkey % 9 when 0 then 'Signed Chap. 12' when 1 then 'VETOED memo 3' when 2 then 'Delivered to Governor' when 3 then 'ADOPTED' when 4 then 'enacting clause stricken' when 5 then 'SUBSTITUTED by A1'
        when 6 then 'Passed Senate' when 7 then 'Referred to rules' else 'filed' end) as a from orders)
""")
def bill_status(t: Tables) -> DataFrame:
    actions = ["Signed Chap. 12", "VETOED memo 3", "Delivered to Governor", "ADOPTED", "enacting clause stricken", "SUBSTITUTED by A1", "Passed Senate", "Referred to rules", "filed"]
    history = F.array(F.lit("introduced"), F.get(F.array(*map(F.lit, actions)), (F.col("o_orderkey") % 9).cast("int")))
    return t.orders.select("o_orderkey", status_code(F.element_at(history, -1)).alias("status"))


#: What the last action of a bill says about its status, first match first.
STATUS_LADDER = [
    (r"signed chap|signed by|approved by governor|chapter \d+", 6),
    (r"veto", 7),
    (r"delivered to governor", 5),
    (r"adopted", 6),
    (r"stricken", 9),
    (r"substituted", 8),
    (r"passed (senate|assembly)", 4),
    (r"third reading|calendar|floor", 3),
    (r"referred to|committee|reported", 2),
]


def status_code(action: Column) -> Column:
    low, out = F.lower(action), F.lit(1)
    for pattern, code in reversed(STATUS_LADDER):
        out = F.when(low.rlike(pattern), code).otherwise(out)
    return out


@query("""
    with said as (select conv_id, turn, role = 'assistant' as done, max(turn) filter (role = 'assistant') over (partition by conv_id) as furthest, count(*) over (partition by conv_id) as total from conversations)
    select conv_id, count(*) filter (done or turn <= furthest) as done, max(total) as total, max(furthest) as furthest from said group by 1
""")
def progress(t: Tables) -> DataFrame:
    """Steps done: those that are said to be (answered turns), and all before the furthest of them."""
    answered = F.col("role") == "assistant"
    per = t.conversations.groupBy("conv_id").agg(
        F.collect_set(F.when(answered, F.col("turn"))).alias("said"), F.max(F.when(answered, F.col("turn"))).alias("furthest"), F.collect_list("turn").alias("steps"), F.count("*").alias("total")
    )
    implied = F.filter("steps", lambda s: s <= F.col("furthest"))
    return per.select("conv_id", F.size(F.array_union("said", implied)).cast("long").alias("done"), "total", "furthest")


# ---- lake --------------------------------------------------------------------------------------------------


@query("""
    with a as (select year(o_orderdate) as y, count(*) as n, sum(length(o_orderpriority) + 8) as b from orders group by 1), c as (select year(o_orderdate) as y, o_orderstatus, count(*) as n, sum(length(o_orderpriority) + 8) as b from orders group by 1, 2)
    select 1 as depth, count(*) as partitions, max(n) as most_rows, max(b)::bigint as most_bytes, median(n) as median_rows from a union all select 2, count(*), max(n), max(b)::bigint, median(n) from c
""")
def partition_plan(t: Tables) -> DataFrame:
    rows = t.orders.select(F.year("o_orderdate").alias("y"), "o_orderstatus", "o_orderpriority")
    return lake.partition_plan(rows, ["y", "o_orderstatus"], F.length("o_orderpriority") + 8)


@query("select 'orders' as table_name, count(*) as rows, count(distinct o_orderstatus) as partitions, min(o_orderstatus) as first_partition, max(o_orderstatus) as last_partition, 'o_orderkey:bigint,o_orderstatus:string' as columns from orders")
def table_manifest(t: Tables) -> DataFrame:
    return lake.manifest(t.orders.select("o_orderkey", "o_orderstatus"), "orders", "o_orderstatus")


_DOMAINS = {
    "sales": ["customer", "supplier", "part", "orders", "lineitem", "nation", "region"], "text": ["documents", "pages", "benchmark", "labels", "conversations"], "traffic": ["events"], "vectors": ["embeddings"],
}
_PARTED = {"orders": "o_orderstatus", "lineitem": "l_returnflag", "documents": "lang", "customer": "c_mktsegment", "events": "event_type", "conversations": "role"}
_OMITTED = {"documents": ["n_chars"], "events": ["props"]}


@query(
    "with counted as ("
    + " union all ".join(f"select '{d}' as domain, '{n}' as name, (select count(*) from {n}) as rows, (select count(distinct coalesce({_PARTED[n]}::varchar, chr(0))) from {n}) as parts, {len(_OMITTED.get(n, []))} as omitted" if n in _PARTED
                         else f"select '{d}', '{n}', (select count(*) from {n}), 1, {len(_OMITTED.get(n, []))}" for d, names in _DOMAINS.items() for n in names)
    + ") select domain, count(*) as tables, sum(rows)::bigint as rows, sum(parts)::bigint as partitions, sum(omitted)::bigint as omitted from counted group by 1"
)
def manifest_rollup(t: Tables) -> DataFrame:
    """Every table's manifest, written with its partitions, and what all manifests of a domain say together."""
    path = f"{lake.shared_dir(t.spark)}/manifests-{uuid.uuid4().hex}"
    for names in _DOMAINS.values():
        for name in names:
            lake.manifest_rows(getattr(t, name), name, lake.domain_of(F.lit(name), _DOMAINS), _PARTED.get(name), _OMITTED.get(name, [])).write.mode("append").parquet(path)
    held = t.spark.read.parquet(path)
    tables = held.groupBy("domain", "table_name").agg(F.sum("rows").alias("rows"), F.count("*").alias("parts"), F.first(F.size("omitted")).alias("omitted"))
    return tables.groupBy("domain").agg(F.count("*").alias("tables"), F.sum("rows").alias("rows"), F.sum("parts").alias("partitions"), F.sum("omitted").alias("omitted"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" union all ".join(f"select '{n}' as table_name, (select count(*) from {n}) as rows, (select count(*) from (describe {n}))::int as n_columns" for n in _TABLES))
def inventory(t: Tables) -> DataFrame:
    """All tables of the folder."""
    out = None
    for name in _TABLES:
        df = getattr(t, name)
        one = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select c as column_name, (select least(50, count(*)) from documents) as checked, (select least(50, count(*)) from documents) as agreeing from (values ('text'), ('lang'), ('source'), ('n_chars')) v(c)")
def verify_roundtrip(t: Tables) -> DataFrame:
    """Documents written to the lake by language and read back, held against the originals in a sample of keys, field by field."""
    path = f"{lake.shared_dir(t.spark)}/verified-{uuid.uuid4().hex}"
    lake.write_partitioned(t.documents, path, ["lang"])
    return lake.round_trip(t.documents, t.spark.read.schema(t.documents.schema).parquet(path), "doc_id", 50)


# ---- derivations -------------------------------------------------------------------------------------------


@query("""
    with m as (select l_suppkey, count(*) filter (l_returnflag = 'R') as r, count(*) as n from lineitem group by 1) select l_suppkey, round(100.0 * r / n, 2) as loyalty from m
""")
def party_loyalty(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 2).alias("loyalty"))


@query("select o_custkey, o_orderkey, date_diff('day', lag(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey), o_orderdate) as days from orders")
def lifecycle_days(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("days"))


@query("select a.l_suppkey as a, b.l_suppkey as b, count(*) as together from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2 having count(*) >= 20")
def cosponsor_pairs(t: Tables) -> DataFrame:
    # Pairs within one order, which has a handful of lines: no group grows with the data.
    lines = rel.dealt(t.lineitem.select("l_orderkey", "l_suppkey"), "l_orderkey")
    other = lines.select("l_orderkey", F.col("l_suppkey").alias("b"))
    both = lines.withColumnRenamed("l_suppkey", "a").join(other, "l_orderkey").where("a < b")
    return both.groupBy("a", "b").agg(F.count("*").alias("together")).where("together >= 20")


@query("select doc_id, len(regexp_extract_all(text, '\\$([0-9][0-9,]*(?:\\.[0-9]+)?)')) as n_amounts from documents")
def cited_amounts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(parse.dollar_amounts(F.col("text"))).cast("long").alias("n_amounts"))

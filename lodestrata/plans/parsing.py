"""Markup, identifiers and files: parsers over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import normalize, parse, text
from lodestrata.plans.registry import Tables, query
from lodestrata.sources import lake

__all__ = [
    "html_to_text", "xml_to_text", "tidy_text", "plain_prose", "jats_sections", "sniff_format", "entity_round_trip", "robots_blocked", "div_of_class", "version_kinds",
    "version_slots", "author_lists", "nuclides", "chamber_names", "csv_parse", "fec_typed_load", "parse_kv_blocks", "link_ids",
]


def _names(names: tuple[str, ...], before: str = "") -> str:
    return ", ".join(f"'{before}{n}'" for n in names)


def _decoded(c: str) -> str:
    """Each entity of an expression decoded once, in the other engine: heads of the pieces between ampersands are looked up."""
    known = ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in text.ENTITIES.items())
    head = "regexp_extract(x, '^([a-zA-Z]+);', 1)"
    put = f"case when i = 1 then x when map {{{known}}}[lower({head})] is not null then map {{{known}}}[lower({head})] || x[length({head}) + 2:] else '&' || x end"
    return f"array_to_string(list_transform(string_split({c}, '&'), lambda x, i: {put}), '')"


def _tidied(c: str) -> str:
    lines = f"list_transform(string_split(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(rtrim(x, ' ' || chr(9)), '(\\S)[ \\t]{{9,}}', '\\1  ', 'g'))"
    kept = "list_filter(l, lambda x, i: x <> '' or (i > 1 and l[i - 1] <> ''))"
    return f"(select regexp_replace(array_to_string({kept}, chr(10)), '\\s+$', '') from (select {lines} as l))"


_HIDDEN = "html"
for _e in ("<!--.*?-->", *(rf"<{e}\b[^>]*>.*?</{e}>" for e in text.HTML_HIDDEN)):
    _HIDDEN = f"regexp_replace({_HIDDEN}, '(?is){_e}', '', 'g')"
_TAG = "lower(regexp_extract(x, '^/?[a-zA-Z][a-zA-Z0-9]*'))"
_PUT = f"case when {_TAG} in ('br', {_names(text.HTML_BLOCKS)}, {_names(text.HTML_BLOCKS, '/')}) then chr(10) when {_TAG} in ('/td', '/th') then chr(9) else '' end"
_BARE = f"array_to_string(list_transform(string_split({_HIDDEN}, '<'), lambda x, i: case when i = 1 then x when not contains(x, '>') then '<' || x else {_PUT} || x[instr(x, '>') + 1:] end), '')"


@query(f"with bare as (select page_id, {_BARE} as c from pages), told as (select page_id, {_decoded('c')} as c from bare) select page_id, md5({_tidied('c')}) as prose from told")
def html_to_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.html_to_text(F.col("html"))).alias("prose"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))


_SPACES = r"[ \t\n\r\f\x0b]+"


@query(f"select doc_id, md5(trim(regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '{_SPACES}', ' ', 'g'))) as body from documents")
def xml_to_text(t: Tables) -> DataFrame:
    """Documents as XML with escapes, comments and nested elements, read back as text."""
    given = [_escaped(F.coalesce(F.col(c), F.lit(""))) for c in ("source", "text")]
    xml = F.concat(F.lit("<?xml version='1.0'?><!DOCTYPE bill><bill><header>"), given[0], F.lit("</header><!-- x --><section><text style='a'>"), given[1], F.lit("</text></section></bill>"))
    squeezed = F.trim(F.regexp_replace(text.xml_to_text(xml), _SPACES, " "))
    return t.documents.select("doc_id", F.md5(squeezed).alias("body"))


@query(f"with padded as (select conv_id, turn, replace(text, '. ', '.' || chr(9) || ' ' || chr(13) || chr(10) || chr(10) || chr(10) || '    ') as c from conversations) select conv_id, turn, md5({_tidied('c')}) as tidy from padded")
def tidy_text(t: Tables) -> DataFrame:
    padded = F.replace(F.col("text"), F.lit(". "), F.lit(".\t \r\n\n\n    "))
    return t.conversations.select("conv_id", "turn", F.md5(text.tidy(padded)).alias("tidy"))


@query("select conv_id, turn, md5(trim(regexp_replace(role || ' said' || chr(10) || text, '\\n+', chr(10), 'g'), ' ' || chr(10))) as prose from conversations")
def plain_prose(t: Tables) -> DataFrame:
    """Turns of conversations put into Markdown with headings, marks, lists, rules and fenced code, and taken out again."""
    lines = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n---\n* "))
    md = F.concat(F.lit("## Turn\n- **"), F.col("role"), F.lit("** `said`[1]\n```\ncode = 1\n```\n1. "), lines)
    return t.conversations.select("conv_id", "turn", F.md5(text.plain_prose(md)).alias("prose"))


@query("select conv_id, first(role || ' ' || turn order by turn) as first_title, count(*)::int as n_sections, md5(string_agg(role || ' ' || turn, ',' order by turn)) as titles from conversations group by 1")
def jats_sections(t: Tables) -> DataFrame:
    """Conversations as articles with a section for each turn and one inside it; only the outer ones are told."""
    title = F.concat_ws(" ", "role", F.col("turn").cast("string"))
    one = F.concat(F.lit("<sec id='x'><title>"), title, F.lit("</title><p>"), _escaped(F.col("text")), F.lit("</p><sec><title>inner</title></sec></sec>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("s")))), lambda x: x["s"]), "\n")
    found = t.conversations.groupBy("conv_id").agg(body.alias("body")).select("conv_id", text.top_sections(F.col("body")).alias("s"))
    titles = F.array_join(F.transform("s", lambda x: x["title"]), ",")
    return found.select("conv_id", F.col("s")[0]["title"].alias("first_title"), F.size("s").alias("n_sections"), F.md5(titles).alias("titles"))


@query("""
    with heads as (select 'pages' as kind, trim(substr(html, 1, 512)) as h from pages union all select 'events', trim(substr(props, 1, 512)) from events union all select 'documents', trim(substr(text, 1, 512)) from documents)
    select kind, case when starts_with(lower(h), '<!doctype html') or starts_with(lower(h), '<html') then 'html' when starts_with(h, '{') or starts_with(h, '[') then 'json' when starts_with(h, '<') then 'xml'
        when contains(string_split(h, chr(10))[1], ',') then 'csv' else 'text' end as format, count(*) as n from heads group by 1, 2
""")
def sniff_format(t: Tables) -> DataFrame:
    heads = [t.pages.select(F.lit("pages").alias("kind"), F.col("html").alias("h")), t.events.select(F.lit("events"), "props"), t.documents.select(F.lit("documents"), "text")]
    both = heads[0].union(heads[1]).union(heads[2])
    return both.groupBy("kind", text.format_of(F.col("h")).alias("format")).agg(F.count("*").alias("n"))


@query("select doc_id, coalesce(text, '') as text, '&#65;' as once from documents")
def entity_round_trip(t: Tables) -> DataFrame:
    """Whole texts whose code points are written as padded hexadecimal, decimal or named entities by turns, decoded. What has no name is hexadecimal in the third turn too."""
    # The entities of the first code points are written once; NUL has none and stays.
    names = {ord(v): f"&{k};" for k, v in text.ENTITIES.items()}
    forms = (lambda k: f"&#x0000{k:X};", lambda k: f"&#{k};", lambda k: names.get(k, f"&#x0000{k:X};"))
    tables = [F.array(F.lit(None).cast("string"), *[F.lit(form(k)) for k in range(1, 256)]) for form in forms]
    code = F.ascii
    by_turns = lambda i, hexadecimal, decimal, named: F.when(i % 3 == 0, hexadecimal).when(i % 3 == 1, decimal).otherwise(named)
    known = lambda x, i: by_turns(i, *[F.get(table, code(x)) for table in tables])
    hexed = lambda x: F.concat(F.lit("&#x0000"), F.hex(code(x)), F.lit(";"))
    named = lambda x: F.coalesce(*[F.when(code(x) == k, F.lit(name)) for k, name in names.items() if k > 255], hexed(x))
    rare = lambda x, i: by_turns(i, hexed(x), F.concat(F.lit("&#"), code(x).cast("string"), F.lit(";")), named(x))
    point = lambda x, i: F.coalesce(known(x, i), F.when(code(x) == 0, x), rare(x, i))
    written = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), ""), point)
    return t.documents.select("doc_id", text.decode_entities(F.array_join(written, "")).alias("text"), text.decode_entities(F.concat(F.lit("&&#35;65;"), F.left(F.coalesce(F.col("text"), F.lit("")), F.lit(0)))).alias("once"))


_RULES = ["/en/1", "/*.html$", "/fr/*page=", "/es*"]


@query("""
    with paths as (select page_id, '/' || array_to_string(string_split(url, '/')[4:], '/') as path from pages)
    select page_id, starts_with(path, '/en/1') or contains(path, '.html') or (starts_with(path, '/fr/') and contains(path, 'page=')) or starts_with(path, '/es') as blocked from paths
""")
def robots_blocked(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/"), F.array_join(F.slice(F.split("url", "/"), F.lit(4), F.lit(1_000)), "/"))
    return t.pages.select("page_id", parse.disallowed(F.array(*map(F.lit, _RULES)), path).alias("blocked"))


@query("""
    select page_id, case when not contains(html, '<div class="ad">') then null when contains(html, '</div>') then regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) else regexp_extract(html, '(?s)<div class="ad">(.*)$', 1) end as ad from pages
""")
def div_of_class(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.div_by_class(F.col("html"), "ad").alias("ad"))


@query("""
    select o_orderkey, case o_orderstatus when 'O' then 'Introduced' when 'F' then 'Enrolled' else 'Read by ' || o_orderpriority end as kind from orders
""")
def version_kinds(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("INTRODUCED by "), F.col("o_orderpriority"))).when(F.col("o_orderstatus") == "F", F.concat(F.lit("enrolled, "), F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", parse.version_kind(F.coalesce(said, F.concat(F.lit("Read by "), F.col("o_orderpriority")))).alias("kind"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then '' else lower(o_orderstatus) || 'h' end as code, o_custkey::varchar || case when o_orderkey % 5 = 0 then '' else ':' || lower(o_orderstatus) || 'h' end as slot from orders")
def version_slots(t: Tables) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.col("o_orderstatus"), F.lit("h")))
    url = F.concat(F.lit("https://files.example.gov/a.b/BILLS-118hr"), F.col("o_custkey").cast("string"), code, F.lit(".xml"))
    return t.orders.select("o_orderkey", parse.version_code(url).alias("code"), parse.version_slot(url, F.col("o_custkey")).alias("slot"))


@query("""
    select conv_id, turn, len(n) as n_authors, array_to_string(n, '|') as authors
    from (select conv_id, turn, list_filter(list_transform(string_split(replace(text, ',', ';'), ';'), lambda x: trim(x)), lambda x: x <> '') as n from conversations)
""")
def author_lists(t: Tables) -> DataFrame:
    names = parse.authors(F.replace(F.col("text"), F.lit(","), F.lit(";")))
    return t.conversations.select("conv_id", "turn", F.size(names).cast("long").alias("n_authors"), F.array_join(names, "|").alias("authors"))


_ELEMENTS = ", ".join(f"'{s}'" for s in normalize.ELEMENTS)


@query(f"""
    with codes as (select p_partkey, p_partkey % 300 as mass, upper(substr(p_name, 1, 1)) as symbol from part), known as (select *, list_position([{_ELEMENTS}], symbol) - 1 as z from codes)
    select p_partkey, z::int as z, (mass - z)::int as n, mass::int as a, symbol from known where z >= 0 and mass >= z
""")
def nuclides(t: Tables) -> DataFrame:
    code = F.concat((F.col("p_partkey") % 300).cast("string"), F.left("p_name", F.lit(1)))
    return t.part.select("p_partkey", parse.nuclide(code, F.array(*map(F.lit, normalize.ELEMENTS))).alias("x")).where("x is not null").select("p_partkey", "x.z", "x.n", "x.a", "x.symbol")


@query(f"""
    select n_nationkey, case upper(n_name[1]) {' '.join(f"when '{k}' then '{v}'" for k, v in normalize.CHAMBERS.items())} else upper(n_name) end as chamber,
           case upper(n_name[1:2]) {' '.join(f"when '{k}' then '{v}'" for k, v in normalize.LOWER_HOUSES.items())} else 'House' end as lower_house from nation
""")
def chamber_names(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", normalize.chamber_name(F.lower("n_name")).alias("chamber"), normalize.lower_house(F.upper(F.left("n_name", F.lit(2)))).alias("lower_house"))


def _written(t: Tables, tag: str) -> str:
    return f"{lake.shared_dir(t.spark)}/{tag}-{uuid.uuid4().hex}"


@query("select doc_id, md5(text) as text, source from documents")
def csv_parse(t: Tables) -> DataFrame:
    """Documents written as quoted CSV, with commas, quotation marks and line ends inside fields, and read back."""
    path = _written(t, "csv")
    held = t.documents.select("doc_id", F.concat(F.lit('say "a", '), "text").alias("text"), "source")
    held.write.options(quote='"', escape='"', header=True, emptyValue="").csv(path)
    back = lake.read_quoted_csv(t.spark, path, "doc_id long, text string, source string")
    return back.select("doc_id", F.md5(F.substring("text", F.length(F.lit('say "a", ')) + 1, F.length("text"))).alias("text"), "source")


@query("select l_orderkey, l_linenumber, l_returnflag as mode, l_extendedprice as price, l_shipdate::date as shipped, 'é' as mark, null::int as district from lineitem")
def fec_typed_load(t: Tables) -> DataFrame:
    """Line items written as the headerless, Latin-1, pipe-separated files of typed columns, and read back."""
    path = _written(t, "delimited")
    fields = ["l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("string"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("é"), F.lit("")]
    lines = t.lineitem.select(F.concat_ws("|", *[F.col(f).cast("string") if isinstance(f, str) else f for f in fields]).alias("value"))
    lines.write.option("encoding", "ISO-8859-1").csv(path, sep="\x01", quote="")
    schema = "l_orderkey long, l_linenumber int, mode string, price double, shipped date, mark string, district int"
    return lake.read_delimited(t.spark, path, schema)


@query("select conv_id, turn, role as name, length(text)::varchar as income, 'intro' as done from conversations")
def parse_kv_blocks(t: Tables) -> DataFrame:
    """Turns as answers of `key: value` lines in fenced blocks inside their own prose; a later block wins."""
    k = [F.col("role"), F.length("text").cast("string")]
    block = F.concat(F.col("text"), F.lit("\n```answers\nname: x\nincome: 0\n#done intro\n```\n"), F.col("text"), F.lit("\n```answers\nname: "), k[0], F.lit("\nincome: "), k[1], F.lit("\n```"))
    fields = parse.answer_fields(block)
    return t.conversations.select("conv_id", "turn", fields["name"].alias("name"), fields["income"].alias("income"), F.array_join(parse.answers_done(block), ",").alias("done"))


@query("""
    select page_id, 'P_' || page_id as ballotpedia, (page_id % 1000)::varchar as votesmart, 'A' || lpad(page_id::varchar, 6, '0') as bioguide, 'N' || lpad(page_id::varchar, 8, '0') as opensecrets,
           'w' || page_id as wikipedia, 'h' || page_id as twitter from pages
""")
def link_ids(t: Tables) -> DataFrame:
    """Identifiers of people in links that stand among a page's own, each in another form of place."""
    k = F.col("page_id").cast("string")
    lines = [
        F.col("url"), F.concat(F.lit("see https://ballotpedia.org/P_"), k), F.concat(F.lit("http://www.votesmart.org/candidate/biography/"), (F.col("page_id") % 1000).cast("string"), F.lit("/x")),
        F.concat(F.lit("bioguide.congress.gov/search/bio/A"), F.lpad(k, 6, "0")), F.concat(F.lit("https://www.opensecrets.org/members-of-congress/x/summary?cid=N"), F.lpad(k, 8, "0")),
        F.concat(F.lit("https://en.wikipedia.org/wiki/w"), k), F.lit("id:"), F.concat(F.lit("  twitter: h"), k),
    ]
    ids = parse.external_ids(F.concat_ws("\n", *lines))
    return t.pages.select("page_id", *[ids[n] for n in ("ballotpedia", "votesmart", "bioguide", "opensecrets", "wikipedia", "twitter")])

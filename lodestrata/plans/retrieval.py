"""Lexical, vector, fused and faceted retrieval, and the context that answers are given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.functions import similarity, text
from lodestrata.operators import search
from lodestrata.plans.registry import Tables, query
from lodestrata.sources import lake
from lodestrata.streaming.feeds import rate_limited_batch

QUESTION = "worthless idiot of the clown pathetic"
PROBE = 0

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_TOKENS = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
_POSTS = f"""tok as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from (select doc_id, {_TOKENS.format("text")} as t from documents)),
    posts as (select doc_id, term, count(*) as tf, list(pos order by pos) as positions from tok where term <> '' and term not in ({_STOP}) group by 1, 2)"""


def _ranked(terms: str, every: str = "") -> str:
    """hits and scores of the documents that have the terms, as common table expressions."""
    return f"""hits as (select doc_id, term, tf, positions from posts where term in ({terms})),
    places as (select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from (select doc_id, unnest(positions) as pos from hits)),
    near as (select doc_id, coalesce(avg(1.0 / greatest(1, pos - before)) filter (before is not null), 0) as near from places group by 1),
    scored as (select doc_id, n_terms, damped + near as score from (select doc_id, count(*) as n_terms, sum(1 + ln(tf)) as damped from hits group by 1 {every}) join near using (doc_id))"""


_TERMS = ", ".join(f"'{w}'" for w in search.query_terms(QUESTION))
_KEPT = f"""common as (select term from posts where term in ({_TERMS}) group by 1 having count(*) > 0.05 * (select count(*) from documents)),
    wanted as (select unnest([{_TERMS}]) as term except select term from common)"""
_LEXICAL = f"with {_POSTS}, {_KEPT}, {_ranked('select term from wanted')}"
_COSINE = "round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 9)"


def _index(t: Tables) -> search.Index:
    """The index of the documents as they lie there now, in the shared folder; new files make a new index."""
    place = f"{t.sf_dir}/documents.parquet"
    path = f"{lake.shared_dir(t.spark)}/postings-{lake.version(t.spark, place)}"
    return search.index(search.postings(t.documents.select("doc_id", "text"), "doc_id", {"text": 1.0}), "doc_id", path)


def _postings(t: Tables) -> DataFrame:
    return _index(t).posts


def _lexical_hits(t: Tables, every: bool = False) -> DataFrame:
    """Documents that have a term of the question: any term, or one that is not too common."""
    found, terms = _index(t), search.query_terms(QUESTION)
    # The share is higher than the usual 0.02: the tables are small.
    common = set() if every else found.common(terms, t.documents.count(), 0.05)
    hits = search.match(found.posts, "doc_id", [w for w in terms if w not in common], False)
    return hits.select("doc_id", "n_terms", F.round("score", 6).alias("score"))


def _lexical(t: Tables, limit: int, every: bool = False) -> DataFrame:
    return _lexical_hits(t, every).orderBy(F.col("score").desc(), "doc_id").limit(limit)


def _probe(t: Tables) -> list[float]:
    return t.embeddings.where(F.col("vec_id") == PROBE).first().embedding


@query(f"with {_POSTS} select doc_id, term, tf, positions[1]::bigint as first_pos from posts")
def build_postings(t: Tables) -> DataFrame:
    return _postings(t).select("doc_id", "term", F.size("positions").cast("long").alias("tf"), F.col("positions")[0].cast("long").alias("first_pos"))


@query(f"with {_POSTS}, {_ranked(chr(39) + 'idiot' + chr(39) + ', ' + chr(39) + 'clown' + chr(39), 'having count(*) = 2')} select doc_id, round(score, 6) as score from scored")
def fts_and(t: Tables) -> DataFrame:
    return search.match(_postings(t), "doc_id", ["idiot", "clown"], True).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_LEXICAL} select doc_id, n_terms, round(score, 6) as score from scored order by round(score, 6) desc, doc_id limit 20")
def keyword_search(t: Tables) -> DataFrame:
    return _lexical(t, 20)


@query(f"with {_POSTS} select distinct a.doc_id from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 where a.term = 'rights' and b.term = 'reserved'")
def phrase_search(t: Tables) -> DataFrame:
    return search.phrase(_postings(t), "doc_id", ["rights", "reserved"])


@query(f"select vec_id, round({_COSINE}, 6) as score from embeddings where label = 3 order by {_COSINE} desc, vec_id limit 10")
def knn_exact_filtered(t: Tables) -> DataFrame:
    found = search.knn(t.embeddings, "vec_id", "embedding", _probe(t), 10, F.col("label") == 3)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id, round({_COSINE}, 6) as score from embeddings order by {_COSINE} desc, vec_id limit 25")
def knn_topk(t: Tables) -> DataFrame:
    return search.knn(t.embeddings, "vec_id", "embedding", _probe(t), 25).select("vec_id", F.round("score", 6).alias("score"))


@query(f"select vec_id, round({_COSINE}, 6) as score from embeddings where vec_id <> 0 order by {_COSINE} desc, vec_id limit 10")
def similar_docs(t: Tables) -> DataFrame:
    found = search.knn(t.embeddings, "vec_id", "embedding", _probe(t), 10, F.col("vec_id") != PROBE)
    return found.select("vec_id", F.round("score", 6).alias("score"))


_ARMS = f"""fts as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as r from scored order by r limit 60),
    dense as (select vec_id as doc_id, row_number() over (order by {_COSINE} desc, vec_id) as r from embeddings order by r limit 60),
    fused as (select doc_id, sum(1.0 / (60 + r)) as rrf, min(r) as best, case when count(*) > 1 then 'both' else min(arm) end as arm from (select *, 'fts' as arm from fts union all select *, 'dense' from dense) group by 1)"""
_FUSED = f"{_LEXICAL}, {_ARMS}"


def _fused(t: Tables, limit: int, every: bool = False) -> DataFrame:
    dense = search.knn(t.embeddings, "vec_id", "embedding", _probe(t), 60).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))
    return search.rrf({"fts": _lexical(t, 60, every).select("doc_id", "score"), "dense": dense}, "doc_id", limit)


@query(f"{_FUSED} select doc_id, round(rrf, 9) as rrf, arm from fused order by fused.rrf desc, best, doc_id limit 50")
def rrf_hybrid(t: Tables) -> DataFrame:
    return _fused(t, 50).select("doc_id", F.round("rrf", 9).alias("rrf"), "arm")


@query(f"""{_LEXICAL}, room as (select s.* from scored s join documents using (doc_id) where lang = 'de'),
    wide as (select doc_id, true as widened from scored where doc_id not in (select doc_id from room) order by round(score, 6) desc, doc_id limit 20)
    select doc_id, false as widened from room union all select * from wide where (select count(*) from room) < 5""")
def widen_search(t: Tables) -> DataFrame:
    """What a room has, and where that is too little, what the whole corpus has besides."""
    found = _lexical_hits(t)
    room = found.join(t.documents.where("lang = 'de'").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(False).alias("widened"))
    if room.limit(5).count() >= 5:
        return room
    wide = found.join(room.select("doc_id"), "doc_id", "left_anti").orderBy(F.col("score").desc(), "doc_id").limit(20)
    return room.unionByName(wide.select("doc_id", F.lit(True).alias("widened")))


@query(f"""with {_POSTS}, {_ranked(_TERMS)}, {_ARMS}, keyed as (select 7 as doc_id, 0 as arm_no, 1 as r), named as (select doc_id, 1 as arm_no, row_number() over (order by doc_id) as r from documents where source = 'src3' order by doc_id limit 5),
    text_arm as (select doc_id, 2 as arm_no, row_number() over (order by rrf desc, best, doc_id) as r from fused order by r limit 20),
    every as (select * from keyed union all select * from named union all select * from text_arm)
    select doc_id, min(arm_no)::int as arm from every group by 1""")
def chat_retrieval(t: Tables) -> DataFrame:
    """A key that the question names, a source that it names, then fused retrieval by every term, however common: each document by its first arm."""
    keyed = t.documents.where("doc_id = 7").select("doc_id", F.lit(0).alias("arm"))
    named = t.documents.where("source = 'src3'").orderBy("doc_id").limit(5).select("doc_id", F.lit(1).alias("arm"))
    fused = _fused(t, 20, True).select("doc_id", F.lit(2).alias("arm"))
    return keyed.unionByName(named).unionByName(fused).groupBy("doc_id").agg(F.min("arm").alias("arm"))


@query("""
    select conv_id, turn, nullif(regexp_extract(text, '(?i)\\bby ([A-Z][a-z]+)', 1), '') as author, nullif(regexp_extract(text, '\\b(10\\.[0-9]{4}/\\S+)', 1), '') as doi,
           list_aggregate(list_filter(['anstre', 'ering', 'tionen'], lambda w: contains(lower(text), w)), 'string_agg', ',') as categories from conversations
""")
def extract_entities(t: Tables) -> DataFrame:
    dictionary = F.array(*[F.lit(w) for w in ("anstre", "ering", "tionen")])
    found = F.filter(dictionary, lambda w: F.contains(F.lower("text"), w))
    part = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    return t.conversations.select(
        "conv_id", "turn", part(r"(?i)\bby ([A-Z][a-z]+)").alias("author"), part(r"\b(10\.[0-9]{4}/\S+)").alias("doi"), F.when(F.size(found) > 0, F.array_join(found, ",")).alias("categories")
    )


@query("select doc_id, i as chunk, substr(text, i * 800 + 1, 800) as piece from documents, lateral (select unnest(range(0, ((length(text) + 799) // 800)::bigint)) as i)")
def chunk_text(t: Tables) -> DataFrame:
    held = t.documents.select("doc_id", "text", F.expr("(length(text) + 799) div 800").alias("n")).where("n > 0")
    return held.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("chunk")).select("doc_id", "chunk", F.col("text").substr(F.col("chunk") * 800 + 1, F.lit(800)).alias("piece"))


@query("""
    with r as (select conv_id, turn, text, contains(text, 'the') as cited, count(*) over (partition by conv_id) as n, count(*) filter (contains(text, 'the')) over (partition by conv_id) as n_cited from conversations)
    select conv_id, turn, length(substr(text, 1, greatest(120, case when n_cited = 0 or n_cited = n then 1000 // n when cited then 800 // n_cited else 200 // (n - n_cited) end)))::int as given from r
""")
def context_budget(t: Tables) -> DataFrame:
    """1,000 characters over the records of a conversation: 80 % to the cited ones, shares even, none under 120."""
    w = W.partitionBy("conv_id")
    cited = F.contains("text", F.lit("the"))
    r = t.conversations.select("conv_id", "turn", "text", cited.alias("cited"), F.count("*").over(w).alias("n"), F.count_if(cited).over(w).alias("n_cited"))
    share = F.expr("case when n_cited = 0 or n_cited = n then 1000 div n when cited then 800 div n_cited else 200 div (n - n_cited) end")
    return r.select("conv_id", "turn", F.length(F.substring("text", F.lit(1), F.greatest(F.lit(120).cast("long"), share).cast("int"))).alias("given"))


@query("select c_custkey, c_name || chr(10) || 'Segment: ' || c_mktsegment || case when c_acctbal > 0 then chr(10) || 'Nation: ' || c_nationkey else '' end as context from customer")
def concat_context(t: Tables) -> DataFrame:
    nation = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Nation: "), F.col("c_nationkey").cast("string")))
    return t.customer.select("c_custkey", F.concat_ws("\n", "c_name", F.concat(F.lit("Segment: "), F.col("c_mktsegment")), nation).alias("context"))


def _one_letter_off(w: str):
    return lambda x: F.levenshtein(x, F.lit(w), 1) >= 0


#: Weight of each field, and of a token that is one letter off.
FIELDS = {"p_name": 10, "p_brand": 4, "p_type": 1}


@query("""
    with q as (select unnest(['widgt', 'red']) as w), fields as (
      select p_partkey, 10 as weight, unnest(string_split(lower(p_name), ' ')) as tok from part union all select p_partkey, 4, lower(p_brand) from part union all select p_partkey, 1, unnest(string_split(lower(p_type), ' ')) from part)
    select p_partkey, sum(m)::bigint as score from (select p_partkey, w, max(case when tok = w then 2 * weight when length(w) >= 4 and levenshtein(tok, w) <= 1 then weight end) as m from fields, q where tok = w or (length(w) >= 4 and levenshtein(tok, w) <= 1) group by 1, 2) group by 1
""")
def bills_search(t: Tables) -> DataFrame:
    """Weighted fields, one typo in words of four letters and more; each query word counts by its best field."""
    total = F.lit(0)
    for w in ("widgt", "red"):
        best = F.lit(0)
        for field, weight in FIELDS.items():
            toks = F.split(F.lower(field), " ")
            near = F.lit(False) if len(w) < 4 else F.exists(toks, _one_letter_off(w))
            best = F.greatest(best, F.when(F.array_contains(toks, w), 2 * weight).when(near, weight).otherwise(0))
        total = total + best
    return t.part.select("p_partkey", total.cast("long").alias("score")).where("score > 0")


@query("select p_type as value, count(*) as n from part where p_type ilike '%ar%' group by 1 order by n desc, value limit 60")
def facet_query(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_type").ilike("%ar%")).groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(60)


@query("""
    select doc_id, regexp_replace(substr(text, greatest(p - 40, 1), 85), '(?i)(idiot)', '«\\1»', 'g') as snippet from (select doc_id, text, strpos(lower(text), 'idiot') as p from documents) where p > 0
""")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.snippet(F.col("text"), "idiot").alias("snippet")).where("snippet is not null")


@query("select c_custkey from customer where (contains(lower(c_name), 'customer') or contains(lower(c_mktsegment), 'customer')) and (contains(lower(c_name), 'build') or contains(lower(c_mktsegment), 'build'))")
def alias_search(t: Tables) -> DataFrame:
    words = F.array(F.lit("customer"), F.lit("build"))
    either = F.forall(words, lambda w: F.contains(F.lower("c_name"), w) | F.contains(F.lower("c_mktsegment"), w))
    return t.customer.where(either).select("c_custkey")


@query("""
    with s as (select item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 4)) as s from benchmark)
    select a.item_id as a, b.item_id as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 4) as j from s a join s b on b.item_id = a.item_id + 1 where len(a.s) + len(b.s) > 0
""")
def jaccard(t: Tables) -> DataFrame:
    sets = t.benchmark.select("item_id", similarity.terms(F.col("text")).alias("s"))
    other = sets.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("s").alias("s2"))
    both = sets.join(other, "item_id").where(F.size("s") + F.size("s2") > 0)
    return both.select(F.col("item_id").alias("a"), "b", F.round(similarity.jaccard(F.col("s"), F.col("s2")), 4).alias("j"))


@query("select p_partkey, p_name as prose from part")
def inverted_index_to_text(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word"))
    index = words.groupBy("p_partkey", "word").agg(F.collect_list("pos").alias("places")).groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("p_partkey", similarity.text_of_inverted_index(F.col("index")).alias("prose"))


@query("""
    with recursive e as (select event_type, event_id, ts, row_number() over (partition by event_type order by ts, event_id) as n from events where ts is not null),
    after as (select event_type, n, min(n) over (partition by event_type order by ts range between interval 30 minute following and unbounded following) as m from e),
    let(event_type, n) as (select distinct event_type, 1::bigint from e union all select a.event_type, a.m from let l join after a on a.event_type = l.event_type and a.n = l.n where a.m is not null)
    select e.event_type, e.event_id from e join let l on l.event_type = e.event_type and l.n = e.n
""")
def rate_limit(t: Tables) -> DataFrame:
    """Each event that is let through points to the next one that may be; the SQL follows these pointers, the query runs in blocks of time."""
    return rate_limited_batch(t.events, "event_type", "ts", 30 * 60)

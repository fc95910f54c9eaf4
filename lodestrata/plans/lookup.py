"""Search through written indexes: query grammar, cover density, pruned keywords, routing, typos and prefixes, substrings, cells of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import indexes, search
from lodestrata.plans.registry import Tables, query

__all__ = ["grammar_search", "cover_rank", "weighted_keywords", "routed_search", "weak_widening", "fuzzy_parts", "substring_docs", "knn_cells"]

WORDS = indexes.Words((("head", 1.0), ("source", 0.4), ("text", 0.1)))

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_SPLIT = r"string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"


def _shape(x: str) -> str:
    letter = "case when c in ('a', 'e', 'i', 'o', 'u') or (c = 'y' and acc like '%c') then 'v' else 'c' end"
    return f"(case when {x} = '' then '' else list_reduce(list_prepend('', string_split({x}, '')), lambda acc, c: acc || {letter}) end)"


_FIELDS = " union all ".join(
    f"select doc_id, {w} as weight, unnest(t) as raw, generate_subscripts(t, 1) - 1 + {k * indexes.FIELD_ROOM} as pos from (select doc_id, {_SPLIT.format(c)} as t from documents)"
    for k, (c, w) in enumerate((("string_split(text, chr(10))[1]", 1.0), ("source", 0.4), ("text", 0.1)))
)
_STEMS = f"""tok as materialized (select * from ({_FIELDS}) f where raw <> '' and raw not in ({_STOP})),
    s0 as (select distinct raw as w from tok),
    s1 as (select w, case when ends_with(w, 'sses') then left(w, length(w) - 2) when ends_with(w, 'ies') then left(w, length(w) - 2) when ends_with(w, 'ss') then w when ends_with(w, 's') then left(w, length(w) - 1) else w end as a from s0),
    s2 as (select w, a, case when ends_with(a, 'eed') then left(a, length(a) - 3) when ends_with(a, 'ed') then left(a, length(a) - 2) when ends_with(a, 'ing') then left(a, length(a) - 3) end as base from s1),
    s3 as (select *, {_shape("base")} as shape from s2),
    s4 as (select w, case when base is null then a
        when ends_with(a, 'eed') then case when contains(shape, 'vc') then left(a, length(a) - 1) else a end
        when not contains(shape, 'v') then a
        when ends_with(base, 'at') or ends_with(base, 'bl') or ends_with(base, 'iz') or (len(regexp_extract_all(shape, 'vc')) = 1 and ends_with(shape, 'cvc') and right(base, 1) not in ('w', 'x', 'y')) then base || 'e'
        when ends_with(shape, 'cc') and right(base, 1) = left(right(base, 2), 1) and right(base, 1) not in ('l', 's', 'z') then left(base, length(base) - 1)
        else base end as b from s3),
    s5 as (select w, case when ends_with(b, 'y') and contains({_shape("left(b, length(b) - 1)")}, 'v') then left(b, length(b) - 1) || 'i' else b end as y from s4),
    s6 as (select w, y, {_shape("left(y, length(y) - 1)")} as shape from s5),
    stems as (select w, case when ends_with(y, 'e') and (len(regexp_extract_all(shape, 'vc')) > 1
        or (len(regexp_extract_all(shape, 'vc')) = 1 and not (ends_with(shape, 'cvc') and right(left(y, length(y) - 1), 1) not in ('w', 'x', 'y')))) then left(y, length(y) - 1) else y end as term from s6),
    hits as materialized (select doc_id, term, pos, weight from tok join stems on raw = w)"""


def _index(t: Tables) -> indexes.Built:
    docs = t.documents.select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"), "source", "text")
    return indexes.word_index(docs, "doc_id", WORDS, f"{t.sf_dir}/documents.parquet")


FORMS = ["idiot clown", '"rights reserved"', 'clowns or "rights reserved"', "idiots -clown", '-"rights reserved" -idiot', 'clown or "all rights', "the or", "idiot-clown or src3 clown"]


def _has(term: str) -> str:
    return f"exists (select 1 from hits h where h.doc_id = d.doc_id and h.term = '{term}')"


def _pair(a: str, b: str) -> str:
    return f"exists (select 1 from hits h join hits g on g.doc_id = h.doc_id and g.pos = h.pos + 1 where h.doc_id = d.doc_id and h.term = '{a}' and g.term = '{b}')"


_HOLDS = [
    f"{_has('idiot')} and {_has('clown')}", _pair("right", "reserv"), f"{_has('clown')} or {_pair('right', 'reserv')}", f"{_has('idiot')} and not {_has('clown')}",
    f"not {_pair('right', 'reserv')} and not {_has('idiot')}", f"{_has('clown')} or {_pair('all', 'right')}", "false", f"{_pair('idiot', 'clown')} or ({_has('src3')} and {_has('clown')})",
]


@query(f"with {_STEMS} " + " union all ".join(f"select {k} as form, doc_id from documents d where {h}" for k, h in enumerate(_HOLDS)))
def grammar_search(t: Tables) -> DataFrame:
    """Every form of the query grammar: and, phrase, or, minus, minus alone, a quotation mark without its partner, nothing, a word of two parts."""
    posts = _index(t).table(t.spark, "posts")
    found = [indexes.grammar_search(posts, t.documents, "doc_id", indexes.parsed(q, WORDS)).select(F.lit(k).alias("form"), "doc_id") for k, q in enumerate(FORMS)]
    both = found[0]
    for one in found[1:]:
        both = both.unionByName(one)
    return both


@query(f"""with {_STEMS}, merged as (select doc_id, pos, term, weight, lag(pos) over w as before, lag(term) over w as other, lag(weight) over w as beside from hits where term in ('right', 'reserv') window w as (partition by doc_id order by pos)),
    covers as (select doc_id, sum((2 / (1 / weight + 1 / beside)) / (1 + (pos - before) - 1)) as r from merged where other <> term group by 1)
    select doc_id, round(least(r / 4, 0.99), 6) as score from covers""")
def cover_rank(t: Tables) -> DataFrame:
    """Documents that have both words, by how close they stand and in which fields."""
    found = indexes.ranked(_index(t).table(t.spark, "posts"), "doc_id", ["right", "reserv"], True)
    return found.select("doc_id", F.round("score", 6).alias("score"))


_ASKED = {"rare": ("worthless idiots and src3", 0.1), "common": ("src3 src4", 0.0)}


def _keywords(label: str, terms: list[str], share: float) -> str:
    names = ", ".join(f"'{x}'" for x in terms)
    return f"""select '{label}' as asked, doc_id, round(least(sum(weight) / 4, 0.99), 6) as score from hits
        where term in (select term from hits where term in ({names}) group by 1 having count(distinct doc_id) <= {share} * (select count(*) from documents)) group by doc_id"""


@query(f"with {_STEMS} {_keywords('rare', ['worthless', 'idiot', 'src3'], 0.1)} union all select 'common', doc_id, 0.0 from hits where false")
def weighted_keywords(t: Tables) -> DataFrame:
    """Any of the words that aren't too common; where all are, documents with all of them (there is none of two sources)."""
    built = _index(t)
    found = [indexes.keyword_search(built, t.spark, "doc_id", q, WORDS, share).select(F.lit(label).alias("asked"), "doc_id", F.round("score", 6).alias("score")) for label, (q, share) in _ASKED.items()]
    return found[0].unionByName(found[1])


_SEMANTIC_ROWS = 20


def routed(t: Tables, q: str, mode: str, probe: list[float] | None, limit: int = _SEMANTIC_ROWS) -> DataFrame:
    """mode (the one that answered), degraded (whether it isn't the one asked for), doc_id and rank.

    `#` and digits look up keys by their beginning. `structured` filters by sources. Without a vector for the question, `semantic` and `hybrid` answer by keywords.
    """
    degraded, built = False, _index(t)
    if q.startswith("#"):
        mode, key = "key", q[1:].strip().translate({ord("%"): None, ord("_"): None})
        found = t.documents.where(F.startswith(F.col("doc_id").cast("string"), F.lit(key)) & F.lit(key != "")).select("doc_id", F.col("doc_id").cast("string").alias("by"))
        ordered = found.orderBy("by").limit(limit).select("doc_id", F.struct("by").alias("by"))
    elif mode == "structured":
        wanted = [s.strip().lower() for s in q.split(",") if s.strip()]
        found = t.documents.where(F.lower("source").isin(*wanted)).orderBy(F.col("n_chars").desc(), "doc_id").limit(limit)
        ordered = found.select("doc_id", F.struct(-F.col("n_chars"), "doc_id").alias("by"))
    else:
        lexical = indexes.keyword_search(built, t.spark, "doc_id", q, WORDS, 0.1).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(limit)
        if probe is None and mode != "keyword":
            mode, degraded = "keyword", True
        if mode == "keyword":
            ordered = lexical.select("doc_id", F.struct((-F.col("score")).alias("s"), "doc_id").alias("by"))
        else:
            dense = search.knn(t.embeddings, "vec_id", "embedding", probe, limit).select(F.col("vec_id").alias("doc_id"), F.round("score", 9).alias("score"))
            arms = {"dense": dense} if mode == "semantic" else {"fts": lexical, "dense": dense}
            ordered = search.rrf(arms, "doc_id", limit).select("doc_id", F.struct((-F.col("rrf")).alias("r"), "best_rank", "doc_id").alias("by"))
    rows = ordered.agg(F.array_sort(F.collect_list(F.struct("by", "doc_id"))).alias("rows"))  # at most `limit` rows
    return rows.select(F.lit(mode).alias("mode"), F.lit(degraded).alias("degraded"), F.posexplode("rows").alias("p", "r")).select("mode", "degraded", F.col("r.doc_id").alias("doc_id"), (F.col("p") + 1).alias("rank"))


_LEXICAL = f"select doc_id, score, row_number() over (order by score desc, doc_id) as r from ({_keywords('q', ['worthless', 'idiot'], 0.1)}) x order by r limit 20"
_DENSE = "select vec_id as doc_id, row_number() over (order by round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 9) desc, vec_id) as r from embeddings order by r limit 20"


@query(f"""with {_STEMS}, lexical as ({_LEXICAL}), dense as ({_DENSE}),
    fused as (select doc_id, sum(1.0 / (60 + r)) as s, min(r) as best from (select doc_id, r from lexical union all select doc_id, r from dense) group by 1),
    answers as (
      select 'key' as mode, false as degraded, doc_id, row_number() over (order by doc_id::varchar) as rank from documents where starts_with(doc_id::varchar, '1')
      union all select 'structured', false, doc_id, row_number() over (order by n_chars desc, doc_id) from documents where source in ('src3', 'src4')
      union all select 'keyword', false, doc_id, r from lexical union all select 'keyword', true, doc_id, r from lexical
      union all select 'semantic', false, doc_id, r from dense
      union all select 'hybrid', false, doc_id, row_number() over (order by s desc, best, doc_id) from fused)
    select mode, degraded, doc_id, rank::int as rank from answers where rank <= 20""")
def routed_search(t: Tables) -> DataFrame:
    """A question for each mode, and one for vectors without a vector."""
    probe = [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]
    words = "worthless idiots"
    asked = [("#1%", "hybrid", probe), ("src3, SRC4", "structured", None), (words, "keyword", None), (words, "hybrid", None), (words, "semantic", probe), (words, "hybrid", probe)]
    both = routed(t, *asked[0])
    for one in asked[1:]:
        both = both.unionByName(routed(t, *one))
    return both


@query("""
    with near as (select vec_id, label, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 9) as score from embeddings),
    rooms as (select label, max(score) < 0.5 as weak from near group by 1), best as (select vec_id from near order by score desc, vec_id limit 5)
    select n.label, n.vec_id, false as widened from near n where score >= 0.5 union all select r.label, b.vec_id, true from rooms r, best b where r.weak
""")
def weak_widening(t: Tables) -> DataFrame:
    """Each room (label) answers with what is near the question; a room whose nearest is weak is given the nearest of all rooms."""
    probe = [float(x) for x in t.embeddings.where("vec_id = 0").first().embedding]
    scores = search.knn(t.embeddings, "vec_id", "embedding", probe, 5).select(F.col("vec_id").alias("best"))
    target = F.array(*[F.lit(v) for v in probe])
    near = t.embeddings.select("vec_id", "label", F.round(search.cosine(F.col("embedding"), target), 9).alias("score"))
    weak = near.groupBy("label").agg(F.max("score").alias("most")).where(F.col("most") < 0.5)
    best = scores.agg(F.array_sort(F.collect_list("best")).alias("ids"))  # five
    wide = weak.join(F.broadcast(best)).select("label", F.explode("ids").alias("vec_id"), F.lit(True).alias("widened"))
    return near.where(F.col("score") >= 0.5).select("label", "vec_id", F.lit(False).alias("widened")).unionByName(wide)


_ASKED_PARTS = "blu ste"
_TERMS = " union all ".join(f"select p_partkey, {w} as weight, unnest(string_split_regex(lower({f}), '[^a-z0-9]+')) as tok from part" for f, w in (("p_name", 10), ("p_brand", 4), ("p_type", 1)))


def _asked(i: int, w: str, last: bool) -> str:
    close = f"length('{w}') >= 4 and tok <> '{w}' and levenshtein(tok, '{w}') <= 1"
    begun = f"starts_with(tok, '{w}') and tok <> '{w}'" if last else "false"
    return f"w{i} as (select p_partkey, max(case when tok = '{w}' then 2 * weight else weight end) as m from fields where tok = '{w}' or ({close}) or ({begun}) group by 1)"


@query(f"""with fields as ({_TERMS}), {_asked(0, "widgt", False)}, {_asked(1, "re", True)}
    select p_partkey, (w0.m + w1.m)::bigint as score from w0 join w1 using (p_partkey)""")
def fuzzy_parts(t: Tables) -> DataFrame:
    """A word with a letter missing and the beginning of another, over three weighted fields, the newest parts first among equals."""
    built = indexes.fuzzy_index(t.part, "p_partkey", {"p_name": 10, "p_brand": 4, "p_type": 1}, "p_partkey", f"{t.sf_dir}/part.parquet")
    return indexes.fuzzy_search(built, t.spark, "p_partkey", "widgt re").select("p_partkey", "score")


@query("select 'idiot' as wanted, doc_id from documents where contains(lower(text), 'idiot') union all select 'S RESERVED.', doc_id from documents where contains(lower(text), 's reserved.') union all select 'zz', doc_id from documents where contains(lower(text), 'zz')")
def substring_docs(t: Tables) -> DataFrame:
    built = indexes.trigram_index(t.documents, "doc_id", "text", f"{t.sf_dir}/documents.parquet")
    found = [indexes.substring_search(built, t.documents, "doc_id", "text", w).select(F.lit(w).alias("wanted"), "doc_id") for w in ("idiot", "S RESERVED.", "zz")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 7)) desc, vec_id limit 10")
def knn_cells(t: Tables) -> DataFrame:
    """The nearest, exactly, by the cells that can hold them."""
    probe = [float(x) for x in t.embeddings.where("vec_id = 7").first().embedding]
    built = indexes.vector_index(t.embeddings, "vec_id", "embedding", f"{t.sf_dir}/embeddings.parquet")
    return indexes.nearest(built, t.spark, "vec_id", "embedding", probe, 10).select("vec_id", F.round("score", 6).alias("score"))

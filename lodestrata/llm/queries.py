"""The registered queries of the operators and of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import fingerprints, jaccard_join, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, source_audit, token_alignment, toxicity, url_filter, warc
from lodestrata.llm.common import documents


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("row_id")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return lm_scoring.score(documents(spark, sf_dir), held_out)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=3, percent=85).drop("text_hash")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge(pages, url_filter.default_rules(spark))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judge(docs, quality_rules.bucket_weights(docs, quality_rules.trusted_ids(labels)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = warc.parse_records(warc.record_bytes(warc.read_archive(spark, warc.write_archive(pages), repeated=False)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out)
    return toxicity.judge(docs, toxicity.learn(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(documents(spark, sf_dir).select("doc_id", "text"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir).select("doc_id", "text"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(documents(spark, sf_dir).select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixing_sources": op2_mixing_sources,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_near_dedup": op4_near_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_ngram_join": op12_ngram_join,
    "op13_source_audit": op13_source_audit,
}

ORACLES: dict[str, str] = {
    "op5_url_filters": r"""
        with parts as (
            select page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path,
                   row_number() over () as n
            from pages
        ), rules(rule_host, rule_path, rule_verdict) as (
            values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), fits as (
            select n, rule_host || rule_path as rule, rule_verdict,
                   row_number() over (partition by n order by length(rule_host || rule_path) desc, rule_verdict desc, rule_host || rule_path desc) as r
            from parts join rules
              on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
        )
        select page_id, host, path, rule, coalesce(rule_verdict, 'allow') as verdict
        from parts left join (select * from fits where r = 1) using (n)
    """,
    "op9_warc": r"""
        with bytes as (
            select page_id, encode(coalesce(html, '')) as b, sha1(encode(coalesce(html, ''))) as h, row_number() over (order by page_id nulls last) as n
            from pages
        ), owned as (
            select *, first_value(n) over (partition by h order by n) as owner_n, first_value(page_id) over (partition by h order by n) as owner
            from bytes
        )
        select page_id, octet_length(b) as payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') as payload_digest,
               case when n = owner_n then 'response' else 'revisit' end as record_type,
               case when n <> owner_n then owner end as refers_to
        from owned
    """,
    "op13_source_audit": r"""
        with read as (
            select row_number() over () as n, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents
        ), found as (
            select n, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from read
        ), kept as (
            select lang, term, count(*) as q_count from found group by 1, 2 having count(distinct n) >= 3
        ), langs as (
            select lang, count(*) as v, sum(q_count)::bigint as q_total from kept group by 1
        ), counted as (
            select lang, source, term, count(*) as c from found semi join kept using (lang, term) group by 1, 2, 3
        ), groups as (
            select g.lang, g.source, coalesce(t.total, 0) as total
            from (select distinct lang, source from read) g
            left join (select lang, source, sum(c)::bigint as total from counted group by 1, 2) t using (lang, source)
        ), shares as (
            select g.lang, g.source, k.term, coalesce(c.c, 0) as c,
                   (1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (g.total + l.v))::bigint as p,
                   (1 + (1000000000::hugeint * (k.q_count + 1)) // (l.q_total + l.v))::bigint as q
            from groups g join kept k using (lang) join langs l using (lang) left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term
        ), sums as (
            select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
            from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
        ), pairs as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
        ), told as (
            select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from shares where c > 0 and p > q
        )
        select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank
        from (from pairs union all from told)
        qualify part = 'pair' or rank <= 200
    """,
}


def register_pipeline() -> None:
    import corpus_pipeline

    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


register_pipeline()

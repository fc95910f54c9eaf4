"""A spread of registered queries against their SQL, on the smallest tables. The full set runs at sf0.01 in the driver's gate."""

import math

import duckdb
import pytest

from lodestrata import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "browse_page", "set_equality", "null_safe_join", "primary_sponsor", "range_join", "distinct_tuple", "vote_tally", "decade_pivot", "distinct_on",
    "interleave_merge", "sponsor_overlap", "norm_key", "norm_vote", "extract_mentions", "parse_kv_blocks", "html_to_text", "upsert_merge", "upsert_hash_guard",
    "upsert_monotone", "resolve_ladder", "reconcile", "session_map", "partition_plan", "fts_and", "rrf_hybrid", "bills_search", "context_budget",
    "upsert_fuller", "insert_ignore_repeats", "cascade_delete", "backfill_null", "merge_answers", "page_difference", "json_key_exists", "inventory",
    "lake_export", "grouped_json", "domain_counts", "scope_tiers", "keyword_search", "phrase_search", "xref_strict_loose", "strip_accents", "low_content", *plans.parsing.__all__, *plans.lookup.__all__, *plans.documents.__all__,
]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.sql(plans.ORACLES[name])
    theirs = sorted((tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(found.columns) == columns
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Indexes against brute force: covers over all windows, the grammar's tree, edit distances, recall of cells, two builders at once."""

import random
import threading
import uuid

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import plans
from lodestrata.operators import indexes as I
from lodestrata.operators import search
from lodestrata.sources import lake

WORDS = I.Words((("text", 0.1),))


def place(spark, df):
    path = f"{lake.shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def density(hits, n):
    """Over all windows: those that hold all terms while none inside does."""
    total = 0.0
    for a in range(len(hits)):
        for b in range(a, len(hits)):
            inside = hits[a : b + 1]
            if {t for _, t, _ in inside} == set(range(n)) and all({t for _, t, _ in x} != set(range(n)) for x in (inside[1:], inside[:-1])):
                last = {t: w for _, t, w in inside}
                total += n / sum(1 / w for w in last.values()) / (1 + hits[b][0] - hits[a][0] - (n - 1))
    return total


def test_cover_density_by_all_windows(spark):
    rng, rows = random.Random(4), []
    for k in range(60):
        n = rng.randrange(1, 5)
        places = sorted(rng.sample(range(60), rng.randrange(1, 25)))
        rows.append((k, n, [(p, rng.randrange(n), rng.choice([0.1, 0.4, 1.0])) for p in places]))
    df = spark.createDataFrame(rows, "k int, n int, hits array<struct<pos:int,term:int,weight:double>>")
    for n in range(1, 5):
        got = {r.k: r.d for r in df.where(F.col("n") == n).select("k", I.cover_density(F.col("hits"), n).alias("d")).collect()}
        for k, m, hits in rows:
            if m == n:
                assert got[k] == pytest.approx(density(hits, n))


@pytest.mark.parametrize(
    ("q", "ways"),
    [
        ("taxes tax", [[(("tax",), False), (("tax",), False)]]),
        ('"the house of cards" -"red lines"', [[(("hous", "card"), False), (("red", "line"), True)]]),
        ("a or b or", [[(("b",), False)]]),
        ('x or "open quote', [[(("x",), False)], [(("open", "quot"), False)]]),
        ('-well-known "', [[(("well", "known"), True)]]),
        ('"" - the', []),
        ("", []),
    ],
)
def test_grammar(q, ways):
    assert [[tuple(leaf) for leaf in way] for way in I.parsed(q, WORDS)] == ways


def test_phrases_keep_their_order(spark):
    df, path = place(spark, spark.createDataFrame([(1, "all rights reserved"), (2, "reserved rights all"), (3, None), (4, "rights, all rights; reserved")], "k long, text string"))
    posts = I.word_index(df, "k", WORDS, path).table(spark, "posts")
    ask = lambda q: sorted(r.k for r in I.grammar_search(posts, df, "k", I.parsed(q, WORDS)).collect())
    assert ask('"all rights reserved"') == [1, 4]
    assert ask("-all") == [3]
    assert ask('"rights all" or -reserved') == [2, 3, 4]
    assert ask("the") == []


def test_fuzzy_words_are_those_one_edit_away(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(150)]
    df, path = place(spark, spark.createDataFrame(list(enumerate(words)), "k long, name string"))
    built = I.fuzzy_index(df, "k", {"name": 1}, "k", path)

    def away(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for w in ("abcab", "cab", "bbbb"):
        got = {r.k: r.score for r in I.fuzzy_search(built, spark, "k", w).collect()}
        want = {k: 2 if x == w else 1 for k, x in enumerate(words) if x == w or x.startswith(w) or (len(w) >= 4 and away(x, w) <= 1)}
        assert got == want
    ranked = [(r.score, r.recency) for r in I.fuzzy_search(built, spark, "k", "ab").collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_substrings_are_those_of_a_scan(spark, sf):
    table = f"{sf}/documents.parquet"
    docs = spark.read.parquet(table)
    built = I.trigram_index(docs, "doc_id", "text", table)
    for wanted in ("the", "Reserved", "q%_x", "a", "", "the of"):
        got = sorted(r.doc_id for r in I.substring_search(built, docs, "doc_id", "text", wanted).collect())
        assert got == sorted(r.doc_id for r in docs.where(F.contains(F.lower("text"), F.lit(wanted.lower()))).select("doc_id").collect())


def test_cells_recall_and_exactness(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    rows = [(k, (centres[k % 20] + 0.4 * rng.normal(size=16)).tolist()) for k in range(4_000)] + [(-1, None), (-2, [0.0] * 16)]
    df, path = place(spark, spark.createDataFrame(rows, "k long, v array<float>"))
    built = I.vector_index(df, "k", "v", path, cells=40)
    assert built.rows == 4_000
    units = np.array([v for _, v in rows[:4_000]])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    found, wanted = 0, 0
    for probe in range(0, 4_000, 400):
        best = np.argsort(-(units @ units[probe]), kind="stable")[:10].tolist()
        near = I.nearest(built, spark, "k", "v", rows[probe][1], 10, probes=6)
        found += len({r.k for r in near.collect()} & set(best))
        wanted += 10
        exact = I.nearest(built, spark, "k", "v", rows[probe][1], 10)
        assert {r.k for r in exact.collect()} == set(best)
    assert found >= 0.9 * wanted
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan


def test_an_empty_table_has_an_index(spark):
    df, path = place(spark, spark.createDataFrame([], "k long, v array<float>, text string"))
    assert I.nearest(I.vector_index(df, "k", "v", path), spark, "k", "v", [1.0], 3).count() == 0
    assert I.keyword_search(I.word_index(df, "k", WORDS, path), spark, "k", "tax", WORDS).count() == 0


def test_two_builders_at_once(spark):
    df, path = place(spark, spark.createDataFrame([(k, f"word{k} tax") for k in range(50)], "k long, text string"))
    got = []
    both = [threading.Thread(target=lambda: got.append(I.word_index(df, "k", WORDS, path))) for _ in range(2)]
    for b in both:
        b.start()
    for b in both:
        b.join()
    assert len(got) == 2 and all(g.rows == 50 and g.table(spark, "posts").count() == 100 for g in got)
    again = I.word_index(df, "k", WORDS, path)
    assert again in got
    assert I.word_index(df, "k", I.Words((("text", 0.1),), stem=False), path).path != again.path


def test_terms_are_grouped_where_rows_are_read(spark, monkeypatch):
    """No row a token, stems with it, a repeated key as one, slices of any size; blocks of trigrams hold several keys, repeated and null ones too."""
    monkeypatch.setattr(search, "TOKENS_AT_ONCE", 3)
    rows = [(1, "taxes tax the taxing", "a"), (2, None, "tax"), (3, "", ""), (1, "tax", "b"), (None, "x tax", None)]
    df = spark.createDataFrame(rows, "k long, text string, head string").coalesce(1)
    placed = search.placed_terms(df, "k", {"text": 0.1, "head": 1.0}, stem=True)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    room = search.FIELD_ROOM
    got = sorted((r.k or 0, r.term, r.weight, r.positions) for r in search.postings(df, "k", {"text": 0.1, "head": 1.0}, stem=True).collect())
    assert got == [(0, "tax", 0.1, [1]), (0, "x", 0.1, [0]), (1, "b", 1.0, [room]), (1, "tax", 0.1, [0, 0, 1, 3]), (2, "tax", 1.0, [room])]
    df, path = place(spark, df)
    built = I.trigram_index(df, "k", "text", path)
    assert max(len(r["keys"]) for r in built.table(spark, "grams").collect()) > 1
    assert sorted(r.k or 0 for r in I.substring_search(built, df, "k", "text", "TAX").collect()) == [0, 1, 1]


def test_chat_retrieval_searches_by_common_terms(spark, tmp_path):
    """A term of the question that is in 15 % of the documents finds them; its SQL says the same."""
    words = ["clown" + " mask" * (k % 5) + " clown" * (k % 7) if k >= 170 else "plain words" for k in range(200)]
    vectors = [(k, [1.0, k / 10]) for k in range(0, 400, 4)]
    spark.createDataFrame([(1_000 + k, w, "src1") for k, w in enumerate(words)] + [(7, "key", "src3")], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.doc_id: r.arm for r in plans.QUERIES["chat_retrieval"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == dict(con.sql(plans.ORACLES["chat_retrieval"]).fetchall())
    assert got[7] == 0 and sum(d >= 1_170 for d in got) == 10

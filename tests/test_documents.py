"""Dumps cut at many places, linkage against all pairs, shredded variants, headings in a stack, planned layouts and the batch buffer."""

import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import linkage
from lodestrata.plans import QUERIES
from lodestrata.sources import dump, lake
from lodestrata.sources.shred import Relation, relation, shred
from lodestrata.streaming import buffer


def new(spark, tag):
    return f"{lake.shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@pytest.mark.parametrize("block", [7, 16, 33, 64, 100_000])
def test_dump_is_the_same_wherever_it_is_cut(spark, block):
    rng = random.Random(block)
    rows = [(k, "".join(rng.choice("ab \n`") for _ in range(rng.randrange(0, 40))) if k % 7 else None, "x\n\ny" if k % 3 else "") for k in range(60)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    path = new(spark, "dump")
    df.orderBy("k").coalesce(1).select(dump.written(df, ["k", "a", "b"]).alias("value")).write.text(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = dump.read_dump(spark, path, 3).select("record", "whole", *[dump.field(F.col("line"), i).alias(f"f{i}") for i in range(3)]).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    # A record ends with its last tab's line: what the last field has after a line end begins the next record, as in the dumps themselves.
    lines, want, held = "\n".join("\t".join("NULL" if v is None else f"`{v}`" if isinstance(v, str) else str(v) for v in r) for r in rows).split("\n"), [], []
    for line in lines:
        held.append(line)
        if "\n".join(held).count("\t") >= 2:
            want.append("\n".join(held))
            held = []
    if held:
        want.append("\n".join(held))
    assert [r.record for r in got] == list(range(len(want)))
    parts = [w.split("\t") for w in want]
    plain = lambda v: None if v is None or v == "NULL" else v[1:-1] if len(v) >= 2 and v[0] == v[-1] == "`" else v
    assert [(r.f0, r.f1, r.f2) for r in got] == [tuple(plain(p[i]) if i < len(p) else None for i in range(3)) for p in parts]
    assert [r.whole for r in got] == [len(p) == 3 for p in parts]


def test_linkage_with_a_name_that_all_share(spark):
    rng = random.Random(6)
    def terms(n):
        return sorted({f"term{rng.randrange(60)}" for _ in range(n)})

    def names(n):
        return sorted({"common", *(f"name{rng.randrange(25)}" for _ in range(n))})

    records = [(k, names(rng.randrange(0, 4)), terms(6)) for k in range(120)] + [(900, [], terms(3)), (901, ["common"], [])]
    works = [(k, names(rng.randrange(0, 5)), terms(6), terms(20)) for k in range(150)]
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) if a or b else 0.0

    def score(r, w):
        shared = len({*r[1]} & {*w[1]}) / len(r[1]) if r[1] else 0
        return 0.6 * shared + 0.4 * min(1, 0.5 * jaccard(r[2], w[2]) + jaccard(r[2], w[3])) if r[1] and shared >= 0.6 else 0.0

    want = {}
    for r in records:
        best = max(((round(score(r, w), 9), -w[0]) for w in works), default=(0, 0))
        if best[0] >= linkage.LEAST:
            want[r[0]] = (-best[1], best[0])
    pubs = spark.createDataFrame(works, "work long, authors array<string>, title array<string>, abstract array<string>")
    for frequent in (3, 10_000):
        got = linkage.published_versions(spark.createDataFrame(records, "id long, authors array<string>, title array<string>"), pubs, frequent)
        assert {r.id: (r.work, round(r.score, 9)) for r in got.collect()} == want
    assert len(want) > 30


def test_linkage_compares_equal_texts_once(spark, monkeypatch):
    """Copies are one record and one work; a work of very many authors is met by single ones."""
    crowd = [f"n{k}" for k in range(40)]
    records = [(k, ["a", "b", "c"], ["term"]) for k in range(50)] + [(100, crowd[:5], ["word", "other"])]
    works = [(k, ["c", "b", "a"], ["term"], ["term", "more"]) for k in range(5, 60)] + [(7_000, crowd, ["word"], ["word", "other"])]
    written = {}
    was = linkage._written
    monkeypatch.setattr(linkage, "_written", lambda df, tag: written.setdefault(tag, was(df, tag)))
    pubs = spark.createDataFrame(works, "work long, authors array<string>, title array<string>, abstract array<string>")
    got = {r.id: r.work for r in linkage.published_versions(spark.createDataFrame(records, "id long, authors array<string>, title array<string>"), pubs, 3).collect()}
    assert got == {**dict.fromkeys(range(50), 5), 100: 7_000}
    assert written["link-records"].count() == 2 and written["link-works"].count() == 2


def test_shredding_odd_documents(spark):
    docs = [
        {"id": 1, "a": [{"v": 1, "b": [{"w": "x"}, {"w": None}]}, {"v": "2", "b": None}], "m": {"k1": {"c": [1, 2]}, "k2": {"c": []}}},
        {"id": 2, "a": {"v": 1}, "m": [1]},
        {"id": 3},
    ]
    rows = spark.createDataFrame([(d["id"], json.dumps(d)) for d in docs], "id long, j string").select("id", F.parse_json("j").alias("doc"))
    specs = [Relation("a", ("a",), (("v", "v", "int"),)), Relation("b", ("a", "b"), (("w", "w", "string"),), "w"), Relation("c", ("m*", "c"), (("x", "", "int"),))]
    cut = shred(rows, "id", "doc", specs)
    assert sorted(tuple(r) for r in relation(cut, "id", specs[0]).select("id", "run", "v").collect()) == [(1, 1, 1), (1, 2, 2)]
    assert [tuple(r) for r in relation(cut, "id", specs[1]).select("id", "at", "w").collect()] == [(1, [1, 1], "x")]
    items = cut.where("relation = 'c'").select("id", "key", "run", F.variant_get("item", "$", "int").alias("x"))
    assert sorted(tuple(r) for r in items.collect()) == [(1, "k1", 1, 1), (1, "k1", 2, 2)]


def test_one_relation_is_taken_where_documents_are_read(spark, sf):
    """Nothing of the other relations is made, and nothing is shuffled after the documents have been written."""
    rows = QUERIES["bill_votes"](spark, sf)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "$.sponsors" not in plan and "Repartition" not in plan and "Rebalance" not in plan
    assert rows.count() == spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").count()


def test_sections_keep_what_is_below_them(spark):
    page = "<p>before</p><h2>Results</h2><h3>First <b>finding</b></h3><p>one &amp; two<p>three<h3>Supplementary</h3><p>gone</p><h4>Results too</h4><p>back</p><h2>Methods</h2><h3>Inside</h3><p>no</p><h2></h2><h2>Conclusion<p>end"
    got = spark.createDataFrame([(page,), ("<p>x",), (None,)], "h string").select(text.sections_about(F.col("h"), "result|conclusion", "method|supplementary").alias("s")).collect()
    assert got[0].s == "Results:\nFirst finding:\none & two\nthree\nResults too:\nback\nConclusion:\nend"
    assert got[1].s is None and got[2].s is None


def test_planned_layout_follows_sizes(spark):
    rows = [(k, "hot" if k % 3 else f"v{k % 4}", k) for k in range(3_000)]
    df = spark.createDataFrame(rows, "k long, a string, b long")
    path = new(spark, "planned")
    assert lake.write_planned(df, path, ["a", "b"], F.lit(10), 50, 1_000) == ["a"]
    files = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in files) <= 100 and sum(r["count"] for r in files) == 3_000
    assert lake.write_planned(df, new(spark, "planned"), ["b"], F.lit(10), 50, 1_000) == []


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, was)


def test_buffer_flushes_by_rows_bytes_age_and_alone(spark, rocks):
    source, sink, marks = (new(spark, t) for t in ("in", "out", "marks"))
    schema = "shard long, id string, text string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(until, seconds=60):
        stream = buffer.batches(spark.readStream.schema(schema).parquet(source), rows=5, size=4_000, seconds=4)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).outputMode("append").trigger(processingTime="1 second").start()
        try:
            for _ in range(seconds):
                time.sleep(1)
                if q.exception():
                    raise q.exception()
                got = lake.written_or_none(spark, sink, "shard long, batch long, reason string, n long, rows string")
                if got is not None and got.count() >= until:
                    break
        finally:
            q.stop()
        return sorted((r.shard, r.batch, r.reason, [x["id"] for x in json.loads(r.rows)]) for r in spark.read.parquet(sink).collect())

    put([(1, f"a{k}", "x") for k in range(7)] + [(2, "big", "y" * 5_000)] + [(3, "c0", "z" * 2_700), (3, "c1", "z\0" * 1_000)])
    first = run(3)
    assert (1, 0, "rows", [f"a{k}" for k in range(5)]) in first and (2, 0, "oversize", ["big"]) in first and (3, 0, "bytes", ["c0", "c1"]) in first
    put([(1, "a7", None)])  # the stream starts again with two rows waiting
    again = run(4)
    assert again[1][:3] == (1, 1, "age") and [i for _, _, _, ids in again for i in ids if i.startswith("a")] in ([f"a{k}" for k in range(8)], [f"a{k}" for k in range(7)])
    texts = [x["text"] for r in spark.read.parquet(sink).where("shard = 3").collect() for x in json.loads(r.rows)]
    assert "z" * 1_000 in texts


def test_linkage_of_near_copies_makes_no_row_a_pair(spark, monkeypatch):
    """Records and works with the same names and a common head of the title: compared in cells, over several blocks, with the results of all pairs."""
    rng = random.Random(9)
    head, some = ["head1", "head2", "head3"], lambda n: [f"w{rng.randrange(3_000)}" for _ in range(n)]
    names = lambda: ["lab", "one", "two", "three", f"src{rng.randrange(2)}"]
    distinct = lambda x: list(dict.fromkeys(x))
    records = [(k, names(), distinct(head + some(4))) for k in range(60)]
    works = [(k, names(), t := distinct(head + some(rng.randrange(5))), distinct(t + some(rng.randrange(40)))) for k in range(90)]
    jaccard = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    want = {}
    for r in records:
        share = lambda w: len({*r[1]} & {*w[1]}) / 5
        best, work = max((0.6 * share(w) + 0.4 * min(0.5 * jaccard(r[2], w[2]) + jaccard(r[2], w[3]), 1), -w[0]) for w in works)
        if best >= linkage.LEAST:
            want[r[0]] = (-work, round(best, 9))
    monkeypatch.setattr(linkage, "BLOCK", 16)
    written, was = {}, linkage._written
    monkeypatch.setattr(linkage, "_written", lambda df, tag: written.setdefault(tag, was(df, tag)))
    pubs = spark.createDataFrame(works, "work long, authors array<string>, title array<string>, abstract array<string>")
    got = linkage.published_versions(spark.createDataFrame(records, "id long, authors array<string>, title array<string>"), pubs, 3)
    assert {r.id: (r.work, round(r.score, 9)) for r in got.collect()} == want and len(want) > 30
    assert written["link-pairs"].count() < 60 * 90 / 3

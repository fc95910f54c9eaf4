import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from lodestrata import plans
from lodestrata.operators import merge, relational, resolve, search
from lodestrata.sources import lake
from lodestrata.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserting_twice_changes_nothing(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, h string")
    delta = spark.createDataFrame([(2, "c"), (3, "d")], "k int, h string")
    once = merge.upsert(base, delta, ["k"])
    assert rows(once) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(merge.upsert(once, delta, ["k"])) == rows(once)
    verdicts = merge.upsert_verdicts(once, delta, ["k"], "h").select("verdict").distinct()
    assert rows(verdicts) == [("unchanged",)]


def test_monotone_keeps_the_newer(spark):
    base = spark.createDataFrame([(1, "2024-02-01", "old"), (2, None, "old")], "k int, d string, s string")
    delta = spark.createDataFrame([(1, "2024-01-01", "new"), (2, "2024-01-01", "new")], "k int, d string, s string")
    assert rows(merge.upsert_monotone(base, delta, ["k"], "d", ["s"])) == [(1, "2024-02-01", "old"), (2, "2024-01-01", "new")]


def test_ladder_needs_unique_last_pass(spark):
    left = spark.createDataFrame([(1, "A1"), (2, "B2"), (3, "C9")], "q int, num string")
    right = spark.createDataFrame([(10, "A1"), (11, "X2"), (12, "Y2"), (13, "Z9")], "id int, num string")
    digits = F.regexp_replace("num", "[^0-9]", "")
    passes = [([F.col("num")], [F.col("num")], False), ([digits], [digits], True)]
    assert rows(resolve.ladder(left, right, "q", "id", passes)) == [(1, 10, 1), (2, None, None), (3, 13, 2)]


def test_reconciled_sides_never_exceed_all(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "k int, m string")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (3, "z")], "k int, m string")
    row = resolve.reconcile(a, b, ["k"], "m").first()
    assert (row.ours, row.theirs, row.matched, row.bills_pct, row.sponsors_pct, row.verdict) == (2, 2, 1, 50.0, 100.0, "gap")


def test_page_limits_are_clamped(spark):
    df = spark.range(500)
    assert relational.browse_page(df, [], [F.col("id")], 10_000).count() == 200
    assert relational.browse_page(df, [F.col("id") > 5, None], [F.col("id")], 0).first().id == 6


def test_closer_terms_score_higher(spark):
    df = spark.createDataFrame([(1, "tax cut now"), (2, "tax one two three four five cut"), (3, "tax")], "d int, t string")
    posts = search.postings(df, "d", {"t": 1.0})
    score = {r.d: r.score for r in search.match(posts, "d", ["tax", "cut"], False).collect()}
    assert score[1] > score[2] > score[3]
    assert {r.d for r in search.match(posts, "d", ["tax", "cut"], True).collect()} == {1, 2}
    assert rows(search.phrase(posts, "d", ["tax", "cut"])) == [(1,)]


def test_stemming():
    for word, stem in (("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("plastered", "plaster"), ("sing", "sing"), ("conflated", "conflate")):
        assert search.porter_step1(word) == stem


def test_lake_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, i / 7, None if i % 5 == 0 else str(i)) for i in range(100)], "k int, p int, x double, s string")
    path = str(tmp_path / "t")
    lake.write_partitioned(df, path, ["p"])
    back = spark.read.parquet(path)
    assert back.count() == 100
    for r in lake.round_trip(df, back.select("k", "p", "x", "s"), "k", 20).collect():
        assert (r.checked, r.agreeing) == (20, 20)


def test_unknown_types_are_refused():
    with pytest.raises(ValueError):
        lake.lake_type("tsvector")


def test_rate_limit_against_a_loop(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    last, kept = {}, set()
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.event_type not in last or (r.ts - last[r.event_type]).total_seconds() >= 1800:
            kept.add(r.event_id)
            last[r.event_type] = r.ts
    assert {r.event_id for r in feeds.rate_limited_batch(events, "event_type", "ts", 1800).collect()} == kept


def test_streams(spark, tmp_path, sf):
    source, out, snapshots = (str(tmp_path / n) for n in ("in", "out", "snap"))
    events = spark.read.parquet(f"{sf}/events.parquet").limit(200)
    events.unionByName(events.limit(50)).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(feeds.deduplicated(stream, "event_id", "ts", "60 days"), "dedup").count() == 200
    assert run(feeds.trending(stream, "event_type", "ts"), "trend", "update").count() > 0
    sink = feeds.upsert_sink(lambda n: f"{snapshots}/{n}", ["user_id"], "ts")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    merged = spark.read.parquet(f"{snapshots}/0")
    assert merged.count() == events.select("user_id").distinct().count()


def test_stateful_rate_limit(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    data = [(i, "a" if i % 2 else "b", t0 + timedelta(seconds=10 * i)) for i in range(20)]
    spark.createDataFrame(data, "event_id long, kind string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    q = feeds.rate_limited(stream, "kind", "ts").writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.event_id for r in spark.table("limited").collect())
    assert got == [0, 1, 4, 5, 8, 9, 12, 13, 16, 17]


def test_widen_search_takes_all_of_the_room(spark, sf):
    """Only the widened rows have a limit; the room's are all that match."""
    plan = plans.QUERIES["widen_search"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"(?:Global|Local)Limit (\d+)", plan)) <= {"20"}


def test_ladder_on_repeated_and_null_keys(spark):
    from lodestrata.operators import resolve

    left = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, "y"), (3, "zz", None), (4, "b", "q"), (4, "none", "y")], "k int, p string, q string")
    right = spark.createDataFrame([(10, "a", "m"), (9, "a", "m"), (20, "n", "y"), (30, "b", "y2"), (31, None, None)], "id int, p string, q string")
    passes = [([F.col("p")], [F.col("p")], False), ([F.col("q")], [F.col("q")], True)]
    got = {r.k: (r["id"], r["pass"]) for r in resolve.ladder(left, right, "k", "id", passes).collect()}
    assert got == {1: (9, 1), 2: (20, 2), 3: (None, None), 4: (30, 1)}


def most_rows_of_a_task(spark, df):
    """How many rows the largest task of df reads from shuffles."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    tasks = [q.apply(i) for q in (sc._jsc.sc().statusStore().taskList(s, 0, 10_000) for s in stages) for i in range(q.size())]
    return max(t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in tasks if t.taskMetrics().isDefined())


def test_ladder_deals_rows_without_terms(spark):
    from lodestrata.operators import resolve

    left = spark.range(8_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).alias("p"), F.when(F.col("id") % 100 == 1, F.col("id")).alias("q"))
    right = spark.range(8_000).select((F.col("id") + 10_000).alias("found"), F.col("id").alias("p"), F.col("id").alias("q"))
    passes = [([F.col(c)], [F.col(c)], True) for c in "pq"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = resolve.ladder(left, right, "id", "found", passes)
        got = {r.id: (r.found, r["pass"]) for r in df.collect()}
        most = most_rows_of_a_task(spark, df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: (i + 10_000, i % 100 + 1) if i % 100 < 2 else (None, None) for i in range(8_000)}
    assert most < 4_000  # of 4 tasks


def test_pairs_of_an_order_are_made_in_all_tasks(spark, tmp_path):
    spark.range(6_000).select((F.col("id") / 3).cast("long").alias("l_orderkey"), (F.col("id") % 3).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = plans.QUERIES["cosponsor_pairs"](spark, str(tmp_path))
        assert rows(df) == [(0, 1, 2_000), (0, 2, 2_000), (1, 2, 2_000)]
        assert most_rows_of_a_task(spark, df) < 6_000  # 12,000 rows meet in 4 tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ladder_joins_what_is_not_a_number(spark):
    from lodestrata.operators import resolve

    nan = float("nan")
    left, right = spark.createDataFrame([(1, nan), (2, None)], "k int, p double"), spark.createDataFrame([(10, nan), (11, None)], "id int, p double")
    got = resolve.ladder(left, right, "k", "id", [([F.col("p")], [F.col("p")], True)])
    assert rows(got) == [(1, 10, 1), (2, None, None)]


def test_verdict_of_empty_sides(spark):
    from lodestrata.operators import resolve

    rows = [(None, None, None, "failed"), (0.0, 99.0, 99.0, "failed"), (99.5, None, None, "parity"), (95.0, 91.0, 90.0, "close"), (95.0, 80.0, None, "gap")]
    df = spark.createDataFrame(rows, "b double, a double, v double, want string")
    assert all(r.got == r.want for r in df.select("want", resolve.verdict(F.col("b"), F.col("a"), F.col("v")).alias("got")).collect())


def test_upsert_takes_the_last_of_repeated_rows(spark):
    from lodestrata.operators import merge

    base = spark.createDataFrame([(1, "old", 0), (2, "stays", 0), (None, "null", 0)], "k int, v string, at int")
    delta = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (3, "c", 1), (3, "c", 1), (None, "n", 5)], "k int, v string, at int")
    got = sorted(map(str, ((r.k, r.v) for r in merge.upsert(base, delta, ["k"], F.col("at")).collect())))
    assert got == ["(1, 'a')", "(2, 'stays')", "(3, 'c')", "(None, 'n')", "(None, 'null')"]


def test_index_is_built_once_and_anew_for_new_files(spark, tmp_path):
    place, rows = str(tmp_path / "t"), [(1, "the red fox"), (2, "a red red hen"), (3, None), (4, "")]
    spark.createDataFrame(rows, "d long, t string").write.parquet(place)
    first = lake.version(spark, place)
    assert lake.version(spark, place) == first

    def built():
        return search.index(search.postings(spark.read.parquet(place), "d", {"t": 1.0}), "d", str(tmp_path / lake.version(spark, place)))

    found = built()
    assert {(r.term, r.df) for r in found.terms.collect()} == {("red", 2), ("fox", 1), ("hen", 1)}
    assert found.common(["red", "fox"], 4, 0.25) == {"red"} and found.common([], 4) == set()
    files = found.posts.inputFiles()
    assert built().posts.inputFiles() == files
    plan = found.posts.where("term in ('fox', 'hen')")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [fox,hen])]" in plan
    spark.createDataFrame([(5, "fox")], "d long, t string").write.mode("append").parquet(place)
    assert lake.version(spark, place) != first
    assert {r.d for r in search.match(built().posts, "d", ["fox"], True).collect()} == {1, 5}


def test_stemmed_postings(spark):
    df = spark.createDataFrame([(1, "hopping ponies hoped caresses"), (2, None)], "d long, t string")
    assert {r.term for r in search.postings(df, "d", {"t": 1.0}, stem=True).collect()} == {"hop", "poni", "hope", "caress"}


@pytest.mark.parametrize("spread", [40, 3000, 100_000])
def test_rate_limit_across_blocks(spark, monkeypatch, spread):
    """Dense, middling and sparse times, ties, a null key and null times, in blocks of a few gaps; rows as by one loop."""
    monkeypatch.setattr(feeds, "BLOCK_GAPS", 3)
    draw = random.Random(spread)
    held = [(i, draw.choice(["a", "a", "b", None]), draw.choice([None] + [draw.randrange(-spread, spread)] * 30)) for i in range(1500)]
    df = spark.createDataFrame(held, "event_id long, kind string, s long").selectExpr("event_id", "kind", "timestamp_seconds(s) as ts").repartition(3)
    want, last = set(), {}
    for i, kind, at in sorted((h for h in held if h[2] is not None), key=lambda h: (h[2], h[0])):
        if kind not in last or at - last[kind] >= 30:
            want.add((kind, i))
            last[kind] = at
    got = feeds.rate_limited_batch(df, "kind", "ts", 30).collect()
    assert {(r.kind, r.event_id) for r in got} == want and len(got) == len(want)


def test_exports_keep_null_and_numeric_looking_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "007"), (2, "007"), (3, None), (4, "x")], "k long, p string")
    got = lake.export_checked(df, str(tmp_path / "e"), ["p"])
    assert {tuple(r) for r in got.collect()} == {("007", 2, 2), (None, 1, 1), ("x", 1, 1)}


def test_unknown_domains_are_refused(spark):
    df = spark.createDataFrame([("a",), ("zz",)], "n string").select(lake.domain_of(F.col("n"), {"d": ["a"]}).alias("d"))
    with pytest.raises(Exception, match="no domain for zz"):
        df.collect()

"""N-gram join against all pairs."""

import random
import re

import numpy as np
import pytest

from lodestrata.llm import jaccard_join as J
from lodestrata.llm import near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=5, percent=80):
    """(doc_id, n_shingles, component_id) by all pairs of rows."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                up[top(x)] = top(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(s), i if not s else least.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def versions(seed, families, size, words):
    """Texts of families whose members differ in a few words, at and around the threshold, and share passages across families."""
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(40))
    out = []
    for f in range(families):
        core = [f"f{f}w{rng.randrange(200)}" for _ in range(words)]
        for _ in range(size):
            mine = list(core)
            for _ in range(rng.randrange(0, 6)):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(mine) + (" " + passage if rng.random() < 0.5 else ""))
    return list(enumerate(out))


ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo "), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"),
    (None, "lone text of a row without an id"), (None, None), (10, "lone text of a row without an id"), (11, "x " * 200), (12, "x " * 500), (13, " ".join(f"w{i}" for i in range(3_000))),
    (14, " ".join(f"w{i}" for i in range(2_900))),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ODD], "doc_id long, text string, n int, hi string")
    assert rows_of(J.join(docs)) == brute(ODD)


@pytest.mark.parametrize("seed", [1, 2])
def test_families_around_the_threshold(spark, seed):
    rows = versions(seed, 6, 25, 60)
    assert rows_of(J.join(spark.createDataFrame(rows, "doc_id long, text string"), block=4)) == brute(rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(J.join(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_cells_find_every_link_between_roots(spark):
    """across() alone, with every class its own root: no link of any group is missing, in blocks of three."""
    rng = np.random.default_rng(5)
    sets = []
    for f in range(5):
        core = rng.integers(0, 2**63, 40, dtype=np.uint64)
        for _ in range(12):
            mine = core.copy()
            mine[rng.integers(0, 40, int(rng.integers(0, 5)))] = rng.integers(0, 2**63)
            sets.append(np.unique(mine))
    reach = [J.reach(len(s), 80) for s in sets]
    apart = [(int(t), k, k, len(s), i) for k, s in enumerate(sets) for i, t in enumerate(s[: reach[k]].view(np.int64))]
    held = spark.createDataFrame([(k, near_dedup.bitmap(s)) for k, s in enumerate(sets)], "class_no long, map binary")
    frame = spark.createDataFrame(apart, "key long, class_no long, root long, n long, i long")
    got = {(min(r), max(r)) for r in J.across(frame, held, 80, block=3).collect()}
    want = {(x, y) for y in range(len(sets)) for x in range(y) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))}
    assert want <= got and len(want) > 50
    assert len(got) < 2 * len(want)  # bitmaps drop nearly all others


def test_trie_finds_what_sets_share():
    rng = random.Random(3)
    for _ in range(200):
        sets = [np.array(sorted(rng.sample(range(30), rng.randrange(1, 20)))) for _ in range(rng.randrange(1, 15))]
        sets += [np.sort(np.append(s[:-1], 30 + k)) for k, s in enumerate(sets)]
        probe = np.array(sorted(rng.sample(range(30), rng.randrange(1, 20))))
        wanted = np.array([rng.random() < 0.7 for _ in sets])
        for percent in (50, 80):
            want = sorted(k for k, s in enumerate(sets) if wanted[k] and 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe)))
            assert sorted(J.Trie(sets).reaching(probe, 100, percent, wanted)) == want


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0

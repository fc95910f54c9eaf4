"""Whole results of native operators against plain Python: fingerprints (6), rule scores (8), words taken by the mix (2)."""

import collections
import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import fingerprints, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(*values):
    """Spark's xxhash64 of strings, ints (int) and longs ((long,)), as a signed number."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def printed(text):
    words = WORD.findall(text or "")
    if not words:
        return fingerprints.EMPTY
    n = len(words)
    hashes = [hashed(*words[i : i + 5]) for i in range(n - 4)] if n >= 5 else [hashed(" ".join(words))]
    least = {}
    for h in hashes:
        h &= (1 << 63) - 1
        b = h >> 56
        least[b] = min(least.get(b, h), h)
    digits = []
    for b in range(fingerprints.BINS):
        tries = [b] if b in least else [hashed(b, t) % fingerprints.BINS for t in range(fingerprints.ATTEMPTS)]
        full = next((x for x in tries if x in least), None)
        digits.append(least[full if full is not None else min(least, key=lambda x: (hashed(b, x), least[x]))] & 15)
    return "".join(f"{d:x}" for d in digits)


def alike(a, b):
    if fingerprints.EMPTY in (a, b):
        return 1.0 if a == b else 0.0
    same = sum(x == y for x, y in zip(a, b, strict=True)) / fingerprints.BINS
    return max(0.0, min(1.0, (same - 1 / 16) / (1 - 1 / 16)))


def test_fingerprints_digit_by_digit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    long = spark.createDataFrame([(10**9, " ".join(f"w{i}" for i in range(20_000))), (10**9 + 1, None), (10**9 + 2, "two words"), (10**9 + 3, "　wide \x1cspace a b c d")], docs.schema)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.union(long).collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs.union(long)).collect()}
    assert len(got) == len(rows)
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        own, edited = printed(text), printed(text[: len(text) - cut] + after[:cut])
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (own, edited)
        assert math.isclose(got[d].near_edited, alike(own, edited), abs_tol=1e-12) and math.isclose(got[d].near_next, alike(own, printed(after)), abs_tol=1e-12)


def test_a_single_row_is_its_own_successor(spark):
    got = fingerprints.edited_pairs(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.near_edited <= 1) for r in got] == [(1.0, True)]


def test_rule_scores(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").select("doc_id").distinct().collect()}
    half = quality_rules.N_BUCKETS // 2
    grams = {}
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        grams[r.doc_id] = [hashed(x) % half for x in w] + [hashed(x, y) % half + half for x, y in zip(w, w[1:], strict=False)]
    raw = collections.Counter(b for g in grams.values() for b in g)
    target = collections.Counter(b for d, g in grams.items() if d in trusted for b in g)
    total = {k: sum(c.values()) + quality_rules.N_BUCKETS for k, c in (("raw", raw), ("target", target))}
    weight = lambda b: math.log((target[b] + 1) / total["target"]) - math.log((raw[b] + 1) / total["raw"])
    weights = quality_rules.bucket_weights(docs, quality_rules.trusted_ids(labels))
    got = quality_rules.judge(docs, weights).collect()
    assert len(got) == len(grams)
    for r in got:
        own = grams[r.doc_id]
        want = sum(map(weight, own)) / len(own) if own else None
        assert r.score is None if want is None else math.isclose(r.score, want, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and (want or 0.0) >= quality_rules.MIN_SCORE)


def schedule(sizes, targets, block):
    """Words taken of each document: (source, doc_id) to a number."""
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    streams, slots = {}, {}
    for s in names:
        mine = sorted(((hashed(mixing.SEED, (d,)) % (1 << 64), n, d) for (src, d), n in sizes.items() if src == s))
        at, placed = 0, []
        for _, n, d in mine:
            placed.append((d, at, n))
            at += n
        take = math.floor(targets[s])
        blocks = -(-at // block)
        streams[s] = (placed, at, take, blocks)
        slots[s] = take // at * blocks + -(-(take % at) // block) if at else 0
    n_slots, rank, taken = sum(slots.values()), collections.Counter(), collections.Counter()
    bounds, upto = [], 0
    for s in names:
        bounds.append((upto / max(1, n_slots), (upto + slots[s]) / max(1, n_slots), s))
        upto += slots[s]
    order = []
    for k in range(n_slots):
        point = (k + 1) * mixing.GOLDEN % 1.0
        s = next(s for lo, hi, s in bounds if lo <= point < hi)
        order.append((s, rank[s]))
        rank[s] += 1
    order += [(s, r) for s in names for r in range(rank[s], slots[s])]
    for s, r in order:
        placed, size, take, blocks = streams[s]
        if r >= slots[s]:
            continue
        b, end = r % blocks, take - r // blocks * size
        for d, start, n in placed:
            taken[s, d] += max(0, min(start + n, (b + 1) * block, end) - max(start, b * block))
    return taken


@pytest.mark.parametrize("least_slots", [mixing.LEAST_SLOTS, 300])
def test_which_documents_the_mix_takes(spark, least_slots, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", least_slots)
    sources = ["a"] * 40 + ["b"] * 5 + ["c"] * 12 + [None] * 3 + ["d"]
    rows = [(k, s, " ".join(["w"] * (k * 7 % 23))) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    targets = {r.source: r.target for r in got}
    block = max(1, min(mixing.MAX_BLOCK, sum(math.floor(t) for t in targets.values()) // least_slots))
    taken = schedule({(s, k): len(t.split()) for k, s, t in rows}, targets, block)
    assert {(r.source, r.doc_id): r.taken for r in got} == {(s, k): taken[s, k] for k, s, _ in rows}
    assert docs.where(F.col("source").isNull()).count() == 3

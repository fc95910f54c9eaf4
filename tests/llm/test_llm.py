"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import fingerprints, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, queries, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"
LABELS = "doc_id long, quality int, toxic int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeats, ties and a column named like an inner one."""
    long = " ".join(f"w{i}" for i in range(3_000))
    rows = [
        (1, None, "en", "a", None, "x"),
        (2, "", "en", None, 0, "x"),
        (3, " \t\n ", None, "b", 4, None),
        (4, "one two", "en", "b", 7, "x"),
        (5, long, "en", "a", len(long), "x"),
        (6, long, "en", "a", len(long), "x"),
        (6, long, "en", "a", len(long), "x"),
        (7, long + " END", "de", "b", None, "x"),
        (None, "three four five six", "fr", None, None, "x"),
        (8, "### $$$ ### $$$ ### $$$\n### $$$ ### $$$ ### $$$", "en", "b", None, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


# 1, 8 ---------------------------------------------------------------------------------------------------------


def test_classifier_agrees_with_labels(docs, labels):
    said = {r.doc_id: r.kept for r in quality_classifier.classify(docs, labels).collect()}
    known = labels.collect()
    assert sum(said[r.doc_id] == bool(r.quality) for r in known) >= 0.97 * len(known)


def test_sparse_sections_shrink_to_their_site(spark):
    rows = [("big", "p", 0.9)] * 500 + [("big", "q", 0.1)] + [("bad", "p", 0.1)] * 400 + [("new", "p", 0.0)]
    scored = spark.createDataFrame(rows, "site string, path string, p double")
    got, prior = quality_classifier.posteriors(scored)
    by = {(r.site, r.path): r for r in got.collect()}
    assert abs(prior - sum(r[2] for r in rows) / len(rows)) < 1e-9
    assert by["big", "p"].path_posterior > 0.85 and by["bad", "p"].path_posterior < 0.15
    assert by["new", "p"].site_posterior > 0.1 and by["big", "q"].path_posterior > 0.1


def test_classifier_edges(odd, nothing, no_labels, labels):
    assert quality_classifier.classify(nothing, no_labels).count() == 0
    assert all(r.kept for r in quality_classifier.classify(odd, no_labels).collect())
    kept = quality_classifier.keep_good(odd, labels)
    assert kept.columns == odd.columns


def base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_rule_counts_by_brute_force(docs, odd, labels):
    for df in (docs, odd):
        weights = quality_rules.bucket_weights(df, quality_rules.trusted_ids(labels))
        known = sorted((base(r.text) for r in df.collect()))
        got = quality_rules.judge(df, weights).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted(map(tuple, got.collect())) == known


def test_rules_keep_good_documents(docs, labels):
    weights = quality_rules.bucket_weights(docs, quality_rules.trusted_ids(labels))
    got = quality_rules.judge(docs, weights).join(labels, "doc_id").collect()
    assert all(r.kept for r in got if r.quality and not r.base_failed)
    bad = [r for r in got if not r.quality]
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


def test_rules_without_target(odd, nothing, no_labels):
    weights = quality_rules.bucket_weights(odd, quality_rules.trusted_ids(no_labels))
    assert not any(weights)
    assert quality_rules.judge(nothing, weights).count() == 0
    assert quality_rules.keep_good(odd, no_labels).count() == 4


# 2 ------------------------------------------------------------------------------------------------------------


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    cap = {s: 2.0 * sizes[s] for s in names}
    left, open_, got = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= cap[s]}
        if not over:
            return got | {s: weight[s] * level for s in open_}
        for s in over:
            got[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return got


def test_mix_reaches_targets(docs, odd):
    for df in (docs, odd):
        got = mixing.mix(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in df.collect())
        size, taken = collections.Counter(), collections.Counter()
        for r in got:
            size[r.source] += r.size
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 2 * r.size
        want = targets(size)
        for r in got:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == size[r.source]
        for s in want:
            assert abs(taken[s] - want[s]) <= 1


def test_mix_reruns_agree(docs):
    first, second = ({r.doc_id: r.taken for r in mixing.mix(docs).collect()} for _ in range(2))
    assert first == second


def test_mix_of_nothing(nothing):
    assert mixing.mix(nothing).count() == 0


# 3 ------------------------------------------------------------------------------------------------------------


def test_scores_by_brute_force(docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    got = {r.doc_id: r for r in lm_scoring.score(docs, held).collect()}
    tokens = {d: [*WORD.findall(lower(t)), None] for d, t in texts(docs).items()}
    counts = collections.Counter(w for d, x in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in x)
    n, v = sum(counts.values()), len(counts)
    for d, x in tokens.items():
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 10 == 0, len(x), sum(counts[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    held_rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in got.values()) > 1.3 * sum(r.base_score for r in got.values()) and held_rows


def test_scores_beat_counts_on_held_out_texts(spark):
    """At a hundredth of the scale: the log10 probability of unseen texts by the model and by word counts."""
    rows = queries.op3_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(rows) > 50 and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def small_vocabulary(n, rng):
    """A vocabulary of n ids with made-up counts and odds."""
    place = np.append(np.arange(n), [n, n + 1])
    vocab = lm_scoring.tree(np.sort(rng.integers(1, 500, n))[::-1].astype(float), n, place)
    odds = lambda shape: rng.standard_normal(shape).astype(np.float32)
    return lm_scoring.replace(vocab, top=odds((n + 2, min(7, n))), rest=odds(vocab.rest.shape))


def test_windows_match_one_long_attention():
    """Windowed, batched scoring gives what attention over each token's own window gives, and sums to 1 over all ids."""
    rng = np.random.default_rng(0)
    vocab = small_vocabulary(30, rng)
    model = lm_scoring.untrained(vocab)
    model.bias = rng.standard_normal(model.bias.shape).astype(np.float32)
    model.nodes = rng.standard_normal(model.nodes.shape).astype(np.float32)
    scorer = lm_scoring.Scorer(vocab, model)
    lengths = np.array([5, 37])
    inputs, goal = rng.integers(0, 30, 42), rng.integers(0, 31, 42)
    laid, targets_, _, begins = lm_scoring.blocks(inputs, goal, lengths, scorer.pad)
    got = scorer.log_probs(laid, targets_, begins)[targets_ >= 0]

    def hidden(first, t):
        seen = inputs[first : t + 1]
        a = np.exp(scorer.k[seen] @ scorer.q[inputs[t]] + model.bias[t - np.arange(first, t + 1)])
        return a / a.sum() @ scorer.v[seen] + scorer.r[inputs[t]]

    def log_p(h, before, g):
        total = vocab.log_other if g == vocab.n else 0.0
        for s in range(vocab.begin[g], vocab.begin[g] + vocab.depth[g]):
            node = vocab.nodes[s]
            odds = vocab.top[before, node] if node < vocab.top.shape[1] else vocab.rest[vocab.group[before], node]
            total -= np.log1p(np.exp(-vocab.turns[s] * (odds + h @ model.nodes[node])))
        return total

    want, at = [], 0
    for n in lengths:
        for t in range(n):
            h = hidden(at + max(0, (t // lm_scoring.BLOCK - 1) * lm_scoring.BLOCK), at + t)
            want.append(log_p(h, inputs[at + t], goal[at + t]))
        at += n
    assert np.allclose(got, want, atol=1e-3)
    every = [log_p(h, 3, g) for g in range(vocab.n + 1)]
    others = math.exp(-vocab.log_other)
    assert math.isclose(sum(np.exp(every[:-1])) + others * math.exp(every[-1]), 1, rel_tol=1e-4)


def test_prior_is_the_smoothed_share_of_turns(spark):
    """Without training, the log odds are those of counted pairs."""
    rng = np.random.default_rng(4)
    texts_ = [rng.integers(0, 12, rng.integers(1, 60)).tolist() for _ in range(40)]
    df = spark.createDataFrame([(bytearray(np.array(t, lm_scoring.id_type(20)).tobytes()),) for t in texts_], "ids binary")
    vocab = lm_scoring.vocabulary(lm_scoring.neighbours(df, 20), 20)
    pairs = collections.Counter(p for t in texts_ for p in zip([21, *t], [*t, 20], strict=True))
    assert vocab.n == 13
    ones, every = np.zeros((vocab.n + 2, vocab.n)), np.zeros((vocab.n + 2, vocab.n))
    for (a, b), c in pairs.items():
        g = vocab.place[b]
        for s in range(vocab.begin[g], vocab.begin[g] + vocab.depth[g]):
            every[vocab.place[a], vocab.nodes[s]] += c
            ones[vocab.place[a], vocab.nodes[s]] += c * (vocab.turns[s] > 0)
    share, lean = (ones.sum(0) + 0.5) / (every.sum(0) + 1), lm_scoring.LEAN
    group = np.array([[x[vocab.group[: vocab.n + 2] == g].sum(0) for g in vocab.group[: vocab.n + 2]] for x in (ones, every)])
    p = (ones + lean * (group[0] + lean * share) / (group[1] + lean)) / (every + lean)
    assert np.allclose(vocab.top, np.log(p / (1 - p)), atol=1e-3)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    vocab = small_vocabulary(22, rng)
    inputs = rng.integers(0, 20, 4_000)
    goal = np.roll(inputs, 1) % 10
    laid, t, _, begins = lm_scoring.blocks(inputs, goal, np.full(40, 100), 24)
    loss = lambda m: -lm_scoring.Scorer(vocab, m).log_probs(laid, t, begins).sum() / (t >= 0).sum()
    trainer = lm_scoring.Trainer(vocab, lm_scoring.untrained(vocab))
    before = loss(trainer.model)
    for _ in range(40):
        trainer.epoch(lm_scoring.windows(laid, begins, 24), t, (0.01, 0.01), rng)
    assert loss(trainer.model) < 0.5 * before


def test_rows_move_by_their_own_moments():
    rng = np.random.default_rng(5)
    vocab = small_vocabulary(14, rng)
    trainer = lm_scoring.Trainer(vocab, lm_scoring.untrained(vocab))
    moments = {n: [np.array(getattr(trainer.model, n), float), 0.0, 0.0] for n in ("nodes", "bias")}
    for step in range(1, 4):
        trainer.steps = step
        for name, (weights, first, second) in moments.items():
            grad = np.zeros(weights.shape, np.float32)
            at = np.arange(len(weights)) if name == "bias" else np.array([0, 3, 5])
            grad[at] = rng.standard_normal(grad[at].shape)
            given = grad[at].copy()
            trainer._move(name, at, given, 0.02)
            assert (given == grad[at]).all()
            first, second = first * 0.9 + 0.1 * grad, second * 0.99 + 0.01 * grad.astype(float) ** 2
            weights = weights - 0.02 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            moments[name] = [weights, first, second]
            assert np.allclose(getattr(trainer.model, name), weights, atol=1e-5)


def test_sums_of_rows_by_owner():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 50, (40, 8))
    found, place = lm_scoring._distinct(values, 60)
    assert found.tolist() == np.unique(values).tolist() and (found[place] == values).all()
    rows = rng.standard_normal((values.size, lm_scoring.DIM)).astype(np.float32)
    want = np.zeros((len(found), lm_scoring.DIM))
    np.add.at(want, place.ravel(), rows)
    assert np.allclose(lm_scoring._summed(rows, place.ravel(), len(found)), want, atol=1e-5)
    assert lm_scoring._summed(rows[:0], place.ravel()[:0], 3).tolist() == np.zeros((3, lm_scoring.DIM)).tolist()


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    vocab = small_vocabulary(14, rng)
    model = lm_scoring.untrained(vocab)
    model.nodes = rng.standard_normal(model.nodes.shape).astype(np.float32)
    laid, t, _, begins = lm_scoring.blocks(rng.integers(0, 14, 60), rng.integers(0, 14, 60), np.array([25, 35]), 16)
    loss = lambda m: -lm_scoring.Scorer(vocab, m).log_probs(laid, t, begins).sum(dtype=np.float64) / (t >= 0).sum()
    trainer, got = lm_scoring.Trainer(vocab, model), {n: np.zeros_like(getattr(model, n)) for n in ("tokens", "nodes", "wq", "wk", "wv", "wr", "bias")}

    def note(name, at, grad, rate):
        got[name][at] += grad

    trainer._move = note
    trainer.step(lm_scoring.windows(laid, begins, 16), t.ravel(), 0.0)
    for name, grad in got.items():
        for at in [np.unravel_index(i, grad.shape) for i in np.argsort(-np.abs(grad).ravel())[:4]]:
            moved = []
            for d in (0.02, -0.02):
                changed = getattr(model, name).copy()
                changed[at] += d
                moved.append(loss(lm_scoring.replace(model, **{name: changed})))
            assert math.isclose((moved[0] - moved[1]) / 0.04, grad[at], rel_tol=0.05, abs_tol=2e-4), name


def test_first_turns_are_the_beginnings_of_paths():
    """A row holds the turns of an index at the first nodes in order; a shorter one repeats its last."""
    vocab = small_vocabulary(30, np.random.default_rng(9))
    nodes, turns = vocab.first_turns()
    for g in range(vocab.n + 1):
        path = [s for s in range(vocab.begin[g], vocab.begin[g] + vocab.depth[g]) if vocab.nodes[s] < vocab.top.shape[1]]
        path += [path[-1]] * (nodes.shape[1] - len(path))
        assert nodes[g].tolist() == vocab.nodes[path].tolist() and turns[g].tolist() == vocab.turns[path].tolist()
    alone = lm_scoring.tree(np.zeros(0), 5, np.zeros(7, int)).first_turns()
    assert [x.tolist() for x in alone] == [[[0]], [[0.0]]]


def test_weights_of_extreme_scores():
    """Weights are those of a softmax where exp would overflow or vanish, too: scores of 90 and 200 don't weigh the same."""
    rng = np.random.default_rng(10)
    shape = (3, lm_scoring.BLOCK, 2 * lm_scoring.BLOCK)
    for scale, shift in ((1, 0), (100, 0), (1, 300), (1, -300), (100, -300)):
        scores = (rng.standard_normal(shape) * scale + shift).astype(np.float32)
        scores[:, ~lm_scoring._CAUSAL] = lm_scoring._NEVER
        want = np.exp(scores.astype(float) - scores.max(-1, keepdims=True))
        got, total = lm_scoring._weights(scores.copy())
        assert np.allclose(got / total[..., None], want / want.sum(-1, keepdims=True), atol=1e-5)


def test_scores_of_windows_with_extreme_attention():
    """A score over 80 is not cut: the window's weights are those of an exact softmax."""
    rng = np.random.default_rng(11)
    vocab = small_vocabulary(20, rng)
    model = lm_scoring.untrained(vocab)
    model.bias[:] = 0
    model.bias[:2] = 85, 120
    model.nodes = rng.standard_normal(model.nodes.shape).astype(np.float32)
    scorer = lm_scoring.Scorer(vocab, model)
    laid, t, _, begins = lm_scoring.blocks(rng.integers(0, 20, 16), rng.integers(0, 20, 16), np.array([16]), scorer.pad)
    shifted = lm_scoring.replace(model, bias=model.bias - 110)
    want = lm_scoring.Scorer(vocab, shifted).log_probs(laid, t, begins)
    assert np.allclose(scorer.log_probs(laid, t, begins), want, atol=1e-3)


def test_score_edges(odd, nothing):
    assert lm_scoring.score(nothing, F.lit(False)).count() == 0
    got = lm_scoring.score(odd, F.coalesce(F.col("doc_id") == 5, F.lit(False))).collect()
    assert len(got) == 10
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    every = lm_scoring.score(odd, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in every)


def test_attention_learns_from_late_tokens(spark):
    """What comes after 512 other tokens, in each document, is learned too."""
    cycle = "tree water stone paper house light".split()
    rows = [(i, " ".join(["filler"] * 520 + cycle * 100)) for i in range(20)]
    rows += [(100, " ".join(cycle * 40)), (101, " ".join(cycle[::-1] * 40))]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert got[100] - got[101] > 0.3 * 240


def test_draws_share_out_all_windows():
    keys = np.random.default_rng(3).integers(0, 500, (8_000, lm_scoring.BLOCK))
    turns = np.bincount((lm_scoring.draws(keys) % np.uint64(4)).astype(int), minlength=4)
    assert turns.sum() == len(keys) and turns.min() > 0.8 * len(keys) / 4
    grows = [n * lm_scoring.ROUNDS / lm_scoring.one_window_in(n) for n in (10**6, 10**8, 10**10, 10**12)]
    assert all(b > 3 * a for a, b in zip(grows, grows[1:], strict=False))


def test_every_window_trains_once_whatever_the_size():
    assert {lm_scoring.one_window_in(n) for n in (0, 10, 10**6, 10**8, 10**10, 10**12)} == {lm_scoring.ROUNDS}


def test_long_texts_in_spans_and_stretches(spark, monkeypatch):
    """Spans of text and stretches of ids change neither counts nor scores; a word of a million characters goes through."""
    rng = np.random.default_rng(8)
    words = ["tree", "water,", "Stone", "paper.", "qzx", "ß", "\u4e16"]
    rows = [(i, " ".join(rng.choice(words, 3_000)), "x") for i in range(6)] + [(7, "ab" * 500_000 + " tree", "x"), (8, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, head_base string")
    want = {r.doc_id: r for r in lm_scoring.score(df, F.col("doc_id") == 3, one_in=1_000_000).collect()}
    monkeypatch.setattr(lm_scoring, "TEXT_BYTES", 999)
    monkeypatch.setattr(lm_scoring, "IDS_AT_ONCE", 320)
    got = {r.doc_id: r for r in lm_scoring.score(df, F.col("doc_id") == 3, one_in=1_000_000).collect()}
    assert want.keys() == got.keys() and got[8].n_tokens == 1
    for d, r in want.items():
        assert got[d][1:5] == r[1:5]
        assert math.isclose(got[d].base_score, r.base_score, rel_tol=1e-9) and math.isclose(got[d].score, r.score, rel_tol=1e-4)


# 4 ------------------------------------------------------------------------------------------------------------


def linked(rows, width, percent):
    sets = {}
    for d, t in rows.items():
        w = WORD.findall(lower(t))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_by_brute_force(docs, width, percent):
    want = linked(texts(docs), width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width, percent).collect()}
    assert got == want


def test_groups_of_near_copies(spark):
    rng = np.random.default_rng(2)
    stem = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = [(0, " ".join(stem))]
    for i in range(1, 60):
        w = list(stem)
        for j in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            w[j] = f"x{rng.integers(0, 99)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == {d: c for d, (_, c) in linked(dict(rows), 3, 85).items()}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.95, 0.85, 0.75):
        union = rng.integers(0, 1 << 63, 1_000).astype(np.uint64)
        cut = int(1_000 * (1 - share) / 2)
        one, two = near_dedup.signature(np.sort(union[cut:]))[1], near_dedup.signature(np.sort(union[: 1_000 - cut]))[1]
        differ = int(np.unpackbits((one ^ two).view(np.uint8)).sum())
        estimate = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.SAMPLES) * math.log(1 - 2 * differ / near_dedup.SKETCH_BITS)
        assert abs(estimate - (1_000 - 2 * cut) / 1_000) < 0.12


def test_bands_miss_seldom():
    assert (near_dedup.band_rows(85), near_dedup.band_rows(80)) == (12, 9)
    for percent in (30, 50, 80, 95):
        assert (1 - (percent / 100) ** near_dedup.band_rows(percent)) ** near_dedup.BANDS <= near_dedup.MISSED


def test_bands_miss_simulated_pairs_seldom():
    """Pairs of resemblance 0.85 (34 of 40 shingles) and 0.8 by the real signatures: bands that share samples would miss one in 2,000."""
    rng = np.random.default_rng(21)
    for percent, shared in ((85, 34), (80, 32)):
        rows, missed = near_dedup.band_rows(percent), 0
        for _ in range(12_000):
            union = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
            own = (40 - shared) // 2
            a, _ = near_dedup.signature(union[: shared + own], rows)
            b, _ = near_dedup.signature(np.concatenate([union[:shared], union[shared + own :]]), rows)
            missed += not (a == b).any()
        assert missed <= 2, (percent, missed)


def test_many_versions_apart(spark):
    """Versions of one text with so many edits that most stay apart: they go through hubs and rare shingles."""
    rng = np.random.default_rng(8)
    stem = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(stem)
        for j in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            w[j] = f"x{rng.integers(0, 400)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()}
    want = {d: c for d, (_, c) in linked(dict(rows), 3, 85).items()}
    assert len(set(want.values())) > 20 and got == want


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_near_dedup_edges(odd, nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and by[7].component_id == 5 and not by[7].kept
    assert all(by[d].kept and by[d].n_shingles == 0 for d in (1, 2, 3))
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "8", "None"]


# 5 ------------------------------------------------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, False, None, "allow"))
    return host, path, best[2], best[3]


URLS = [None, "", "no scheme", "http://Example.ORG/en/153?x#y", "https://a.example.org/es/1", "http://org/", "http://x.org", "ftp://q.com/de/", "http://com/fr/é", "http://notexample.org/en/1", "http://a.b://c.com/de/", "x://" + "a." * 300 + "com/fr/" + "z" * 5_000]


def test_urls_by_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    more = spark.createDataFrame([(i + 10**6, u) for i, u in enumerate(URLS)] + [(10**6, None)], "page_id long, url string")
    both = pages.unionByName(more)
    got = sorted((tuple(r) for r in url_filter.judge(both, url_filter.default_rules(spark)).collect()), key=repr)
    assert got == sorted(((r.page_id, *judged(r.url)) for r in both.collect()), key=repr)


def test_many_rules_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "small_side", lambda df, rows: df)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, url_filter.default_rules(spark)).collect()}
    assert got == {i: judged(u)[3] for i, u in enumerate(URLS)}
    none = url_filter.judge(pages, url_filter.default_rules(spark).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


# 6 ------------------------------------------------------------------------------------------------------------


def test_edited_texts(docs, odd):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
        got = {r.doc_id: r for r in fingerprints.edited_pairs(df).collect()}
        for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
            cut = len(t) // 3
            edited = t[: len(t) - cut] + following[:cut]
            assert got[d].n_chars == len(t)
            assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
            assert got[d].near_edited == 1.0 or edited != t


def test_likeness_estimates_similarity(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for k in range(60):
        w = [f"w{i}" for i in rng.integers(0, 10**6, 300)]
        v = w[: 300 - 5 * k] + [f"v{i}" for i in rng.integers(0, 10**6, 5 * k)]
        sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in (w, v)]
        want.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        rows.append((k, " ".join(w), " ".join(v)))
    df = spark.createDataFrame(rows, "k int, a string, b string").select("k", fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    got = {r.k: r.v for r in df.select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("v")).collect()}
    errors = np.array([got[k] - want[k] for k in range(60)])
    assert abs(errors.mean()) < 0.03 and errors.std() < 0.08


@pytest.mark.parametrize("shape", ["outlier", "crowded", "repeated", "null"])
def test_buckets_stay_small(spark, shape):
    """Ids that lie far apart, crowd together, repeat or are null: successors as by one sort, and no bucket with a large share."""
    n = 6000
    ids = {
        "outlier": [-(2**63), 2**63 - 1, *range(n)],
        "crowded": [*range(n // 2), *(10**12 + 3 * i for i in range(n // 2))],
        "repeated": [7 if i % 3 == 0 else i for i in range(n)],
        "null": [None if i % 3 == 0 else i for i in range(n)],
    }[shape]
    df = spark.createDataFrame([(d, f"text {i}") for i, d in enumerate(ids)], "doc_id long, text string").repartition(4)
    held, _ = fingerprints._bucketed(df)
    rows = held.collect()
    assert max(collections.Counter(r.bucket for r in rows).values()) < 0.12 * len(rows)
    rows.sort(key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    assert [r.bucket for r in rows] == sorted((r.bucket for r in rows), reverse=True)
    want = {(a.doc_id, a.text): b.text for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}
    assert {(r.doc_id, r.text): r.next_text for r in fingerprints.with_next(df).select("doc_id", "text", "next_text").collect()} == want


def test_fingerprint_edges(odd, nothing):
    assert fingerprints.edited_pairs(nothing).count() == 0
    got = fingerprints.edited_pairs(odd).collect()
    assert len(got) == 10
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {fingerprints.EMPTY}
    assert all(len(r.fingerprint) == fingerprints.BINS for r in got)


# 7 ------------------------------------------------------------------------------------------------------------


def check_packing(rows, got):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    pieces, want = collections.Counter(), collections.Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for i, a in enumerate(range(0, len(ids), 2048)):
            want[d, i, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())] += 1
    places = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces == want
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places), -(-sum(k[3] * n for k, n in want.items()) // 2048)


def test_packing(docs, odd, nothing):
    n, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs).collect())
    assert n <= 1.02 * least + 1
    check_packing([(r.doc_id, r.text) for r in odd.collect()], packing.pack(odd).collect())
    assert packing.pack(nothing).count() == 0


def test_word_ids_match_whole_texts(spark):
    tricky = ["don't STOP,now. it's 3.14 ÉTÉ İstanbul naïve—dash ﬁ ½ 漢字 a\u0301b ΣΑΣ x'll|| #$ ß", "tab\tand\x0bfeed\x0c", "<|endoftext|> x", "'s't", "\u00a0nbsp\u2003em"]
    rows = list(enumerate(tricky))
    check_packing(rows, packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_tightest_by_brute_force():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 400)
    sequence, offset = packing.best_fit_decreasing(lengths, 100)
    left, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(c, k) for k, c in enumerate(left) if c >= lengths[i]]
        k = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(100)
        left[k] -= lengths[i]
        want[i] = 1
    assert sequence.max() + 1 == len(left)
    filled = collections.Counter()
    for s, n in zip(sequence, lengths, strict=True):
        filled[s] += n
    assert max(filled.values()) <= 100


# 9 ------------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (4, "http://c/", ""), (5, "u\r\nv", "x" * 100_000), (1, "http://b/", "<p>é</p>"), (None, "n", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    records = warc.read_archive(spark, warc.write_archive(pages)).cache()
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect() if r.page_id)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    size = lambda h: len((h or "").encode())
    page = {p: h for p, _, h in rows}
    want = [(1, "response", None), (1, "revisit", 1), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None)]
    assert [g[:1] + g[3:] for g in got] == want
    assert all(g[1:3] == (size(page[g[0]]), sha(page[g[0]])) for g in got)
    by_seq = {r.seq: r for r in records.collect()}
    for r in warc.record_bytes(records).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        said = by_seq[r.seq]
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + said.record_type.encode())
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        assert length == len(body) - 4 and body.endswith(b"\r\n\r\n")
        http, _, payload = body[:-4].partition(b"\r\n\r\n")
        assert payload == (bytes(said.payload) if said.record_type == "response" else b"")
        if said.record_type == "response":
            assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"sha1:{base64.b32encode(hashlib.sha1(body[:-4]).digest()).decode()}".encode() in head
    parsed = {r.seq: r for r in warc.parse_records(warc.record_bytes(records)).collect()}
    for seq, r in by_seq.items():
        p = parsed[seq]
        assert (p.page_id, p.record_type, p.refers_to, p.payload_bytes, p.payload_digest, p.url) == (r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.url)
        assert p.payload is None if r.record_type == "revisit" else bytes(p.payload) == bytes(r.payload)
    assert sum(r.page_id is None for r in parsed.values()) == 1 and any(r.url == "u%0D%0Av" for r in parsed.values())
    assert warc.parse_records(warc.record_bytes(warc.read_archive(spark, warc.write_archive(pages.limit(0))))).count() == 0
    more = pages.select("*", F.lit("x").alias("seq"), F.lit("y").alias("payload"), F.lit(1).alias("header"))
    assert warc.parse_records(warc.record_bytes(warc.read_archive(spark, warc.write_archive(more)))).count() == len(rows)


def test_payloads_are_shuffled_once(spark):
    """Reading for records moves no payload, and a revisit whose response is gone is refused."""
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same"), (3, "u", None)], "page_id long, url string, html string")
    path = warc.write_archive(pages)
    records = warc.read_archive(spark, path, repeated=False)
    assert sorted((r.page_id, r.record_type, r.payload and bytes(r.payload)) for r in records.collect()) == [(1, "response", b"same"), (2, "revisit", None), (3, "response", b"")]
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "first(payload" not in plan and spark.read.parquet(f"{path}/payloads").where("payload is not null").count() == 2
    spark.read.parquet(f"{path}/payloads").where("payload is null").write.parquet(f"{path}/cut/payloads")
    with pytest.raises(Exception, match="fails verification"):
        warc.read_archive(spark, f"{path}/cut", repeated=False).select("record_type").collect()


def test_damaged_archives_are_refused(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    path = warc.write_archive(pages)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"?")).write.parquet(f"{path}/damaged")
    spark.read.parquet(f"{path}/damaged").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="fails verification"):
        warc.read_archive(spark, path).select("record_type").collect()


# 10 -----------------------------------------------------------------------------------------------------------


def plain_kernel(s, t, order, decay):
    total = 0.0
    for i in itertools.combinations(range(len(s)), order):
        for j in itertools.combinations(range(len(t)), order):
            if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel_by_brute_force():
    left, right = ["idiot", "ixdiot", "abc", "ab"], ["idiot", "cab", "iidot"]
    got = toxicity.subsequence_kernel(left, right)
    want = [[plain_kernel(s, t, toxicity.ORDER, toxicity.DECAY) for t in right] for s in left]
    assert np.allclose(got, want)
    assert np.allclose(toxicity.own_kernel(left), [plain_kernel(s, s, toxicity.ORDER, toxicity.DECAY) for s in left])
    assert np.allclose(toxicity.pair_kernel(left[:3], right), np.diag(np.array(want)[:3]))


def test_evidence_by_brute_force():
    """Sentence by sentence, word by word, piece by piece."""
    landmarks = ["idiot", "clown"]
    norms = np.sqrt(toxicity.own_kernel(landmarks))
    model = toxicity.Model(landmarks, norms, ["zog"], np.array([2.0, 1.5, 0.7]), -1.0)
    text = "An i-d.iot, no.\nThe cl xx clxown and a zog! such an i d i o t\nidxxxiot clo wn"

    def word_value(word, m):
        best = 0.0
        for a in range(len(word)):
            for b in range(a, len(word)):
                piece = word[a : b + 1]
                if re.fullmatch(".{0,2}".join(m), piece):
                    best = max(best, plain_kernel(piece, m, 3, toxicity.DECAY) / math.sqrt(plain_kernel(piece, piece, 3, toxicity.DECAY) * plain_kernel(m, m, 3, toxicity.DECAY)))
        return best

    sentences = [["an", "idiot", "no"], ["the", "cl", "xx", "clxown", "and", "a", "zog"], ["such", "an", "idiot"], ["idxxxiot", "clo", "wn"]]
    want = max(sum(w * max(word_value(x, m) for x in words) for w, m in zip(model.weights, landmarks)) + 0.7 * ("zog" in words) - 1 for words in sentences)
    found = toxicity.Reader(model).sentences(toxicity.pa.array([text, None, "idiot"]))
    got = (found["much"] * model.weights[found["value"]]).groupby([found["text"], found["sentence"]]).sum() - 1
    assert math.isclose(got[0].max(), want, rel_tol=1e-9) and math.isclose(got[2].max(), 1.0, rel_tol=1e-9)
    assert len(got[0]) == 3 and set(found["text"]) == {0, 2}


def test_long_texts_and_words(spark, monkeypatch):
    """A text of 50 MB, a word of a million characters and spans of any size."""
    landmarks = ["idiot", "clown"]
    model = toxicity.Model(landmarks, np.sqrt(toxicity.own_kernel(landmarks)), [], np.array([2.0, 2.0]), -1.0)
    rows = [(1, "plain words here. " * 2_800_000 + "an idiot."), (2, "x" * 1_000_000 + "idiot" + "y" * 1_000_000), (3, "ab" * 500_000), (4, "no clown")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.judge(df, model).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1}
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 500)
    small = spark.createDataFrame([(1, "plain words here. " * 300 + "an idiot."), (4, "no clown"), (5, "none " * 900)], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.judge(small, model).collect()} == {1: 1, 4: 1, 5: 0}


def test_toxicity_on_held_out_documents(spark):
    """Documents whose labels were not seen. About one label in 25 is noise (toxic without any insult), a third of all toxic ones."""
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 100 and sum(toxic) >= 0.65 * len(toxic) and sum(clean) <= 0.005 * len(clean)


def toxic_table(spark):
    rng = np.random.default_rng(6)
    syllables = ["ta", "re", "mo", "li", "su", "nen", "ka", "po", "vi", "dor"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    insults = ["idiot", "worthless", "clown"]
    rows, labels = [], []
    for i in range(400):
        w, bad = [word() for _ in range(40)], i % 5 == 0
        if bad:
            w[rng.integers(0, 40)] = insults[i // 5 % 3]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS), word


def test_toxicity_tolerates_gaps(spark):
    docs, labels, word = toxic_table(spark)
    model = toxicity.learn(docs, labels)
    clean = " ".join(word() for _ in range(60))
    tries = ["you idiot", "an id.i.o.t he said", "such an i d i o t here", "idxiot", "IDIOT!", "worth-less", clean, "", None, "moral studio"]
    df = spark.createDataFrame(list(enumerate(tries)), "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.judge(df, model).collect()}
    assert [got[i] for i in range(len(tries))] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    held = {r.doc_id: r.predicted for r in toxicity.judge(docs, model).collect()}
    assert sum(held[r.doc_id] == r.toxic for r in labels.collect()) >= 395


def test_toxicity_has_no_rank_limit(spark):
    """Ninety insults, and one of three letters, are all found again."""
    rng = np.random.default_rng(12)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    insults = [*(make("bcdfghjkmpqrvwxz", 8) for _ in range(90)), "zog"]
    plain = [make("aeilnost", 7) for _ in range(300)]
    rows = []
    for i in range(900):
        words = list(rng.choice(plain, 30))
        rows.append((i, " ".join([*words, *rng.choice(insults, 5, replace=False)] if i % 2 else words), i % 2))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic"))
    fresh = [(i, " ".join([*rng.choice(plain, 10), w])) for i, w in enumerate(insults)] + [(1_000, " ".join(plain))]
    got = {r.doc_id: r.predicted for r in toxicity.judge(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert sum(got.values()) == len(insults) and got[1_000] == 0


def test_toxicity_without_labels(odd, nothing, no_labels):
    model = toxicity.learn(odd, no_labels)
    got = toxicity.judge(odd, model).collect()
    assert len(got) == 10 and not any(r.predicted for r in got)
    assert toxicity.judge(nothing, model).count() == 0


# pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf, docs, labels):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "near-duplicates", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality classifier"](spark, docs, sf).cache()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_classifier.classify(docs, labels).where("kept").collect()}
    ruled = stage["quality rules"](spark, kept, sf).cache()
    assert not any(base(t)[5] for t in texts(ruled).values())
    single = stage["near-duplicates"](spark, ruled, sf).cache()
    want = linked(texts(ruled), 5, 80)
    assert {r.doc_id for r in single.collect()} == {d for d, (_, c) in want.items() if c == d}
    mixed = stage["mixing"](spark, single, sf).cache()
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    taken = {r.doc_id: r for r in mixing.mix(single).collect()}
    assert mixed.columns == docs.columns
    assert copies == collections.Counter({d: math.floor(r.taken / r.size + 0.5) for d, r in taken.items() if r.size and r.taken / r.size >= 0.5})
    check_packing([(r.doc_id, r.text) for r in mixed.collect()], stage["packing"](spark, mixed, sf).collect())


def test_all_operators_are_registered():
    numbers = {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES if n.startswith("op")}
    assert numbers == {str(n) for n in range(1, 14)} and "pipeline" in queries.QUERIES


def test_columns_with_inner_names_stay(spark, docs):
    """Stages return a caller's columns, whatever they are called."""
    names = ["__text_hash", "__hash", "__id", "__copies", "__copy", "own_hash", "kept_id", "copies", "copy", "their_id", "Their_Source", "row_id", "size", "rank"]
    wide = docs.limit(40).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for stage in (near_dedup.keep_one, mixing.repeated):
        got = stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_shared_folder_is_asked_for_on_a_cluster():
    from lodestrata.llm import common

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

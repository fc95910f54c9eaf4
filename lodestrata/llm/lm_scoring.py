"""LM scoring: causal self-attention on subword ids, trained in numpy, over a prior of exact corpus counts.

A text is the subword ids of its words (A-Z lower-cased), in order, and one end; its score is the log10 probability of
that sequence. Ids are those of a public tokenizer, in which an id tells whether it ends a word.

Ids that occur in training are leaves of a binary tree of the Huffman kind, so the frequent ones are near its root; one leaf more
stands for all other ids, evenly. The probability of an id is the product over its path of the probabilities of the turns, each predicted by
one causal self-attention layer over the ids before. So a token costs about its entropy, not the vocabulary, and every
string has its probability.

The prior stands inside each turn, as the log odds that attention adds to: smoothed counts of the whole training corpus
of how paths turn at a node after the id before (at the `TOP` most passed nodes) or after its group (at the others).
Both tables are bounded by the tokenizer's vocabulary times `TOP` or `GROUPS`, whatever the corpus.

Windows of 2 * `BLOCK` positions overlap by half: each token is scored once, in the later half of its window, with at
least `BLOCK` positions before it (from the text's beginning on). Attention trains in `ROUNDS` data-parallel rounds. In each round
one window in ROUNDS, drawn by a hash of what is in it, takes part, so every window of every training text trains
once; partitions train from the same weights and Spark averages them.

Data flow: count all words (partial counts per slice, one shuffle of distinct words); read every text once more for its ids
and its base terms, written to the shared folder; count pairs of neighbouring ids; train; score. Frequent words' base terms are broadcast (at most
`HEAD` words); the few occurrences of other words join their counts by key.

Defined cases: null and blank texts are the end alone. Repeated rows are scored alike and count as often
as they occur. A null doc_id is training text. Extra columns are ignored. Long texts are read in spans cut at white space
and scored in stretches that overlap by a block, which changes nothing. A word without ids (white space of other kinds) adds
none. Without training text every id is as likely as another, and base terms are log10(1).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize
from lodestrata.llm.near_dedup import mixed
from lodestrata.llm.packing import TOKENIZER, gathered, portions, word_ids

#: Bounds: frequent words whose base terms are broadcast, nodes with counts after each id, groups of ids, width and half window of the attention.
HEAD, TOP, GROUPS, DIM, BLOCK = 262_144, 64, 64, 16, 16
#: Training: rounds, blocks of a step, step size, ids that a partition trains on in all rounds, rows of weights that are averaged together.
ROUNDS, BATCH, RATE, TRAINER_IDS, WEIGHT_ROWS = 2, 64, 0.01, 800_000, 1_024
#: Partitions that train apart at most, so that what is averaged doesn't grow with the corpus.
TRAINERS = 256
#: How many turns of the less specific share the counts of a turn lean on.
LEAN = 4.0
#: Bytes of text and ids that a task works on at once, and blocks that are scored at once.
TEXT_BYTES, IDS_AT_ONCE, SCORED_BLOCKS = 1_500_000, 400_000, 128
BASE_ADD = 0.1
SEED = 7


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, the code of each word in order, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    counts = np.diff(split.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    if blank.any():
        real = ~blank[codes]
        owner = np.repeat(np.arange(len(counts)), counts)
        counts, codes = np.bincount(owner[real], minlength=len(counts)), codes[real]
    return coded.dictionary, codes, counts


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """word and c, its occurrences in training documents, for all words of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                for texts in spans:
                    words, codes, counts = coded_words(texts)
                    train = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), counts)
                    c = np.bincount(codes[train], minlength=len(words)).astype(np.int64)
                    seen = np.bincount(codes, minlength=len(words)) > 0
                    yield pa.RecordBatch.from_arrays([words.filter(pa.array(seen)), pa.array(c[seen])], ["word", "c"])

    rows = docs.select("text", held_out.alias("held_out"))
    return rows.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_threshold(counts: DataFrame) -> int:
    """The least power of two that at most HEAD words' counts reach."""
    steps = [1 << j for j in range(1, 40)]
    row = counts.agg(*[F.count_if(F.col("c") >= s).alias(str(s)) for s in steps]).first()
    return next(s for s in steps if row[str(s)] <= HEAD)


# The vocabulary, its tree and the prior ----------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Ids that occur in training, by falling count; index n is any other id, n + 1 a text's beginning, n + 2 padding.

    place: index of each of the tokenizer's ids (the end comes after the last). begin, depth: where the path of
    each index begins in nodes and turns (-1 or 1), and how long it is; early: how many of its nodes are among the first. Nodes are numbered by falling passes. group: of each index. top: log odds of a turn
    of 1 at the first nodes after each index; rest: at each node after each group.
    """

    end: int
    place: np.ndarray
    begin: np.ndarray
    depth: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray
    group: np.ndarray
    top: np.ndarray
    rest: np.ndarray
    log_other: float

    def __post_init__(self):
        owner = np.repeat(np.arange(len(self.depth)), self.depth)
        self.early = np.bincount(owner[self.nodes < self.top.shape[1]], minlength=len(self.depth)).astype(np.int32)
        self.late_begin, self.late_depth = self.begin + self.early, self.depth - self.early

    @property
    def n(self) -> int:
        return len(self.depth) - 1

    def paths(self, goals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all turns on the paths of goals: which goal, node, turn."""
        depth = self.depth[goals]
        owner = np.repeat(np.arange(len(goals), dtype=np.int32), depth)
        where = np.arange(len(owner), dtype=np.int32) + (self.begin[goals] - (np.cumsum(depth) - depth)).astype(np.int32)[owner]
        return owner, self.nodes[where], self.turns[where]

    def first_turns(self) -> tuple[np.ndarray, np.ndarray]:
        """The turns of each index at the TOP nodes, a row each: nodes and turns. A shorter row repeats its last turn."""
        if not len(self.nodes):
            return np.zeros((len(self.depth), 1), np.int64), np.zeros((len(self.depth), 1), np.float32)
        where = self.begin[:, None] + np.minimum(np.arange(self.early.max()), self.early[:, None] - 1)
        return self.nodes[where].astype(np.int64), self.turns[where]

    def late(self, h: np.ndarray, weights: np.ndarray, before: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, ...]:
        """The turns of goals at the other nodes: which goal, node, turn, the rows of h and of weights that meet there, and the log odds of a turn of 1.

        Nodes' numbers grow along a path, so they are what comes after the turns at the TOP nodes.
        """
        depth = self.late_depth.take(goals)
        owner = np.repeat(np.arange(len(goals)), depth)
        where = np.arange(len(owner), dtype=np.int32)
        where += (self.late_begin.take(goals) - np.cumsum(depth, dtype=np.int32) + depth).take(owner)
        nodes = self.nodes.take(where)
        rows, own = h.take(owner, 0), weights.take(nodes, 0)
        odds = np.einsum("ij,ij->i", rows, own)
        odds += self.rest.ravel().take((self.group.take(before) * np.int32(self.rest.shape[1])).take(owner) + nodes)
        return owner, nodes, self.turns.take(where), rows, own, odds


class FirstNodes:
    """The log odds of the turns at the TOP nodes: one product for all nodes, then the turns of each path are picked as a table."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.width = vocab, vocab.top.shape[1]
        self.nodes, self.turns = vocab.first_turns()
        self.begin = np.zeros((0, 1), np.int64)

    def __call__(self, h: np.ndarray, weights: np.ndarray, before: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each goal: nodes, their places in a flat table of goals by nodes, turns, and the log odds times the turn."""
        if len(goals) > len(self.begin):
            self.begin = np.arange(len(goals))[:, None] * self.width
        every = h @ weights[: self.width].T
        every += self.vocab.top.take(before, 0)
        nodes, turns = self.nodes.take(goals, 0), self.turns.take(goals, 0)
        at = nodes + self.begin[: len(goals)]
        odds = every.ravel().take(at)
        odds *= turns
        return nodes, at, turns, odds


def id_type(end: int) -> np.dtype:
    """Ids are kept as the bytes of two-byte numbers where the tokenizer's ids fit, or else of four-byte ones."""
    return np.dtype("<u2" if end < 2**16 else "<u4")


def neighbours(ids: DataFrame, end: int) -> DataFrame:
    """a, b and n: how often id b follows a, over all texts; the beginning is end + 1 and the end is `end`. ids: bytes."""
    kind = id_type(end)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, before, after, _ in stretches(batch.column("ids"), kind, end + 1, end):
                keys, n = np.unique(before.astype(np.int64) * (end + 2) + after, return_counts=True)
                of = [pa.array(keys // (end + 2), pa.int32()), pa.array(keys % (end + 2), pa.int32()), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(of, ["a", "b", "n"])

    return ids.select("ids").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def huffman(counts: list[float]) -> list[list[tuple[int, int]]]:
    """The path of each leaf as (node, turn), nodes numbered by falling passes; ties go by the order of the leaves."""
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    passes: dict[int, float] = {}
    while len(heap) > 1:
        (c, left), (d, right) = heapq.heappop(heap), heapq.heappop(heap)
        made = len(counts) + len(passes)
        parent[left], parent[right], passes[made] = (made, -1), (made, 1), c + d
        heapq.heappush(heap, (c + d, made))
    number = {v: i for i, v in enumerate(sorted(passes, key=lambda v: (-passes[v], -v)))}
    paths: dict[int, list[tuple[int, int]]] = {v: [] for v in passes if v not in parent}
    for v in sorted(parent, reverse=True):  # parents are made after their children
        up, turn = parent[v]
        paths[v] = [*paths[up], (number[up], turn)]
    return [paths.get(i, []) for i in range(len(counts))]


def tree(count: np.ndarray, end: int, place: np.ndarray) -> Vocabulary:
    """The vocabulary without counts after others. All other ids weigh as much as what was met once."""
    n = len(count)
    paths = huffman([*count.tolist(), max(1.0, float((count == 1).sum()))])
    depth = np.array([len(p) for p in paths], np.int64)
    steps = np.array([x for p in paths for x in p], np.int64).reshape(-1, 2)
    alone = min(n, GROUPS // 2)
    rank = np.arange(n + 3)
    group = np.where(rank < alone, rank, alone + (rank - alone) * (GROUPS - alone - 2) // max(1, n - alone))
    group[n:] = GROUPS - 2
    group[n + 1] = GROUPS - 1
    nodes = max(1, n)
    begin, depth = (np.cumsum(depth) - depth).astype(np.int32), depth.astype(np.int32)
    return Vocabulary(
        end, place.astype(np.int32), begin, depth, steps[:, 0].astype(np.int32), steps[:, 1].astype(np.float32), group.astype(np.int32),
        np.zeros((n + 2, min(TOP, nodes)), np.float32), np.zeros((GROUPS, nodes), np.float32), -math.log(max(1, end + 1 - n)),
    )


def vocabulary(pairs: DataFrame, end: int) -> Vocabulary:
    """From the table of neighbours. What comes to the driver is bounded by the tokenizer's ids times TOP and GROUPS."""
    seen = sorted(((r.n, r.b) for r in pairs.groupBy("b").agg(F.sum("n").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    n, count = len(seen), np.array([c for c, _ in seen], float)
    place = np.full(end + 2, n, np.int64)
    place[[b for _, b in seen]] = np.arange(n)
    place[end + 1] = n + 1
    plain = tree(count, end, place)
    if not n:
        return plain
    width = plain.top.shape[1]

    def turned(group: bool) -> tuple[np.ndarray, np.ndarray]:
        """Turns of 1 and all turns, after each index at the first nodes or after each group at all nodes."""
        shape = plain.rest.shape if group else plain.top.shape

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (place[batch.column(c).to_numpy()] for c in ("a", "b"))
                times = batch.column("n").to_numpy()
                owner, nodes, turns = plain.paths(b)
                kept = slice(None) if group else nodes < width
                owner, nodes, turns = owner[kept], nodes[kept], turns[kept]
                at, where = np.unique(2 * ((plain.group[a] if group else a)[owner] * shape[1] + nodes) + (turns > 0), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.bincount(where, weights=times[owner]))], ["at", "n"])

        rows = pairs.mapInArrow(follow, "at int, n double").groupBy("at").agg(F.sum("n").cast("float").alias("n")).toPandas()
        table = np.zeros(2 * shape[0] * shape[1], np.float32)
        table[rows["at"].to_numpy()] = rows["n"].to_numpy()
        table = table.reshape(*shape, 2)
        return table[..., 1].copy(), table.sum(-1)

    ones, every = turned(True)
    share = (ones.sum(0) + 0.5) / (every.sum(0) + 1)
    in_group = (ones + np.float32(LEAN) * share) / (every + np.float32(LEAN))
    ones, every = turned(False)
    after = (ones + np.float32(LEAN) * in_group[plain.group[: n + 2], :width]) / (every + np.float32(LEAN))
    odds = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))).astype(np.float32)
    return replace(plain, top=odds(after), rest=odds(in_group))


# Windows ---------------------------------------------------------------------------------------------------------


def stretches(ids: pa.Array, kind: np.dtype, begin: int, end: int, place: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts' inputs (the beginning and the ids) and targets (the ids and the end), IDS_AT_ONCE at a time.

    Yields the row of each text, inputs and targets end to end, and lengths. Of a longer text each stretch but the first
    begins with the block before it, whose targets are -1 when `place` is given and left out otherwise.
    """
    bounds = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64)
    flat = np.frombuffer(ids.buffers()[2], kind, (bounds[-1] - bounds[0]) // kind.itemsize, int(bounds[0])) if bounds[-1] > bounds[0] else np.zeros(0, kind)
    offsets = (bounds - bounds[0]) // kind.itemsize
    sizes = np.diff(offsets) + 1
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + IDS_AT_ONCE)))
        lengths = sizes[at:until]
        total, first = int(lengths.sum()), np.cumsum(lengths) - lengths
        inputs, targets = np.full(total, begin, np.int32), np.full(total, end, np.int32)
        is_first, is_last = np.zeros(total, bool), np.zeros(total, bool)
        is_first[first], is_last[first + lengths - 1] = True, True
        own = flat[offsets[at] : offsets[until]]
        own = own.astype(np.int32) if place is None else place[own]
        inputs[~is_first], targets[~is_last] = own, own
        if until - at > 1 or total <= IDS_AT_ONCE:
            yield np.arange(at, until), inputs, targets, lengths
        else:
            step = IDS_AT_ONCE // BLOCK * BLOCK
            for s in range(0, total, step):
                back = BLOCK if s and place is not None else 0
                goal = targets[s - back : s + step].copy()
                goal[:back] = -1
                yield np.array([at]), inputs[s - back : s + step], goal, np.array([len(goal)])
        at = until


def blocks(inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of texts laid out in blocks: inputs, targets (-1: none), the block's text, and whether it begins it."""
    n_blocks = -(-lengths // BLOCK)
    first = np.cumsum(n_blocks) - n_blocks
    owner = np.repeat(np.arange(len(lengths)), n_blocks)
    start = np.cumsum(lengths) - lengths
    where = np.repeat(first * BLOCK - start, lengths) + np.arange(len(inputs))
    laid_in, laid_out = np.full(len(owner) * BLOCK, pad, np.int32), np.full(len(owner) * BLOCK, -1, np.int32)
    laid_in[where], laid_out[where] = inputs, targets
    begins = np.zeros(len(owner), bool)
    begins[first] = True
    return laid_in.reshape(-1, BLOCK), laid_out.reshape(-1, BLOCK), owner, begins


def windows(laid: np.ndarray, begins: np.ndarray, pad: int, last: np.ndarray | None = None) -> np.ndarray:
    """Each block behind the block before it (the first behind `last`); before a text's first block there is padding."""
    before = np.vstack([np.full((1, BLOCK), pad, laid.dtype) if last is None else last, laid[:-1]])
    before[begins] = pad
    return np.hstack([before, laid])


# The layer -------------------------------------------------------------------------------------------------------


@dataclass
class Attention:
    """Weights of the layer. tokens: a row per index that goes in; nodes: a row per node of the tree."""

    tokens: np.ndarray
    nodes: np.ndarray
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    wr: np.ndarray
    bias: np.ndarray


_DENSE, _SPARSE = ("wq", "wk", "wv", "wr", "bias"), ("tokens", "nodes")
_REL = (BLOCK + np.arange(BLOCK)[:, None]) - np.arange(2 * BLOCK)[None, :]
_CAUSAL = _REL >= 0
_BACK = np.where(_CAUSAL, _REL, 0)
_NEVER = np.float32(-1e9)
_SCALE = np.float32(1 / math.sqrt(DIM))
_REL_SEEN = _BACK[_CAUSAL]
_BIAS_AT = np.where(_CAUSAL, _REL, 2 * BLOCK)


def untrained(vocab: Vocabulary) -> Attention:
    """Small random weights, and none at the nodes: what comes out is the prior."""
    rng = np.random.default_rng(SEED)
    square = lambda: (rng.standard_normal((DIM, DIM)) / math.sqrt(DIM)).astype(np.float32)
    tokens = (rng.standard_normal((vocab.n + 3, DIM)) * 0.3).astype(np.float32)
    return Attention(tokens, np.zeros((vocab.rest.shape[1], DIM), np.float32), square(), square(), square(), square(), np.zeros(2 * BLOCK, np.float32))


def _weights(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each place weighs, and their sum in each row; scores are overwritten. The largest is taken off only where exp needs it."""
    kept = scores if scores.max() < 80 else scores - scores.max(-1, keepdims=True)
    low = kept.diagonal(BLOCK, 1, 2).min() < -80 and (kept.max(-1) < -80).any()
    if low:
        kept -= kept.max(-1, keepdims=True)
    np.exp(kept, out=kept)
    return kept, (kept.reshape(-1, kept.shape[-1]) @ np.ones(kept.shape[-1], np.float32)).reshape(kept.shape[:-1])


def _log_odds_lost(z: np.ndarray) -> np.ndarray:
    """log(1 + exp(-z)), which is what a turn with log odds z costs."""
    lost = np.abs(z)
    np.negative(lost, out=lost)
    np.exp(lost, out=lost)
    lost += 1
    np.log(lost, out=lost)
    lost -= np.minimum(z, 0)
    return lost


def _distinct(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of values under n, in order, and which of them each value is."""
    met = np.zeros(n, bool)
    met[values] = True
    found, place = np.flatnonzero(met), np.empty(n, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[values]


_PLACES = [np.zeros((0, DIM), np.int64)]


def _places(n: int) -> np.ndarray:
    """The flat places of so many rows of DIM, or more; the largest table asked for is kept."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = np.arange(2 * n * DIM).reshape(-1, DIM)
    return _PLACES[0]


def _summed(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of each owner's rows."""
    at = _places(n).take(owner, 0)
    return np.bincount(at.ravel(), weights=rows.ravel(), minlength=n * DIM).reshape(n, DIM).astype(np.float32)


class Scorer:
    """The layer ready to score: its projections of every index are made once."""

    def __init__(self, vocab: Vocabulary, model: Attention):
        e = model.tokens.astype(np.float32)
        self.vocab, self.pad = vocab, len(e) - 1
        self.q, self.k, self.v, self.r = (np.ascontiguousarray(e @ w, np.float32) for w in (model.wq * _SCALE, model.wk, model.wv, model.wr))
        self.bias = np.where(_CAUSAL, model.bias[np.maximum(_REL, 0)], _NEVER).astype(np.float32)
        self.nodes, self.first = model.nodes.astype(np.float32), FirstNodes(vocab)
        self.real = (np.arange(self.first.nodes.shape[1]) < vocab.early[:, None]).astype(np.float32)

    def log_probs(self, laid: np.ndarray, targets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, 0 where there is none."""
        result = np.zeros(targets.size, np.float32)
        for at in range(0, len(laid), SCORED_BLOCKS):
            i, t = laid[at : at + SCORED_BLOCKS], targets[at : at + SCORED_BLOCKS].ravel()
            first = begins[at : at + SCORED_BLOCKS]
            k = windows(i, first, self.pad, laid[at - 1 : at] if at else None)
            scores = self.q.take(i, 0) @ self.k.take(k, 0).transpose(0, 2, 1)
            scores += self.bias
            scores[first, :, :BLOCK] = _NEVER  # padding at a text's end comes after all that is scored
            weights, total = _weights(scores)
            h = weights @ self.v.take(k, 0)
            h /= total[..., None]
            h += self.r.take(i, 0)
            real = np.flatnonzero(t >= 0)
            h, before, goals = h.reshape(-1, DIM).take(real, 0), i.ravel()[real], t[real]
            z = self.first(h, self.nodes, before, goals)[-1]
            found = np.einsum("ij,ij->i", _log_odds_lost(z), self.real.take(goals, 0))
            owner, _, turns, _, _, z = self.vocab.late(h, self.nodes, before, goals)
            z *= turns
            found = -found - np.bincount(owner, weights=_log_odds_lost(z), minlength=len(goals))
            found[goals == self.vocab.n] += self.vocab.log_other
            result[at * BLOCK + real] = found
        return result.reshape(targets.shape)


class Trainer:
    """Adam on the cross entropy. The moments of an index's rows move only when it takes part."""

    def __init__(self, vocab: Vocabulary, model: Attention):
        self.vocab = vocab
        self.model = replace(model, **{n: getattr(model, n).astype(np.float32) for n in (*_DENSE, *_SPARSE)})
        self.first, self.second = ({n: np.zeros_like(getattr(self.model, n)) for n in (*_DENSE, *_SPARSE)} for _ in range(2))
        self.first_nodes = FirstNodes(vocab)
        self.steps, self.seen = 0, {n: np.zeros(len(getattr(model, n))) for n in _SPARSE}

    def epoch(self, keys: np.ndarray, targets: np.ndarray, rates: tuple[float, float], rng: np.random.Generator) -> None:
        """All windows in random order; the rate falls from the first to the second of rates."""
        parts = np.array_split(rng.permutation(len(keys)), -(-len(keys) // BATCH)) if len(keys) else []
        for j, pick in enumerate(parts):
            self.step(keys[pick], targets[pick].ravel(), rates[0] + (rates[1] - rates[0]) * (j + 1) / len(parts))

    def step(self, k: np.ndarray, t: np.ndarray, rate: float) -> None:
        model, vocab, pad = self.model, self.vocab, len(self.model.tokens) - 1
        real = np.flatnonzero((t >= 0) & (t < vocab.n))
        if not len(real):
            return
        self.steps += 1
        # Projections are made once for each index that takes part, then dealt to its places.
        used, inverse = _distinct(k, len(model.tokens))
        own = np.ascontiguousarray(inverse[:, BLOCK:])
        e, wq = model.tokens.take(used, 0), model.wq * _SCALE
        q, kk, v = (e @ wq).take(own, 0), (e @ model.wk).take(inverse, 0), (e @ model.wv).take(inverse, 0)
        scores = q @ kk.transpose(0, 2, 1)
        scores += np.append(model.bias, _NEVER).take(_BIAS_AT)
        scores[k[:, 0] == pad, :, :BLOCK] = _NEVER  # padding at a text's end comes after all that has a target
        a, total = _weights(scores)
        a *= (1 / total)[..., None]
        seen = a @ v
        h = (seen + (e @ model.wr).take(own, 0)).reshape(-1, DIM)
        hr, before, goals = h.take(real, 0), k[:, BLOCK:].ravel()[real], t[real]

        def slope(z: np.ndarray, turns: np.ndarray) -> np.ndarray:
            np.exp(np.minimum(z, np.float32(80), out=z), out=z)
            z += 1
            z *= -np.float32(len(goals))
            return np.divide(turns, z, out=z)

        # The first nodes as one table, the others one by one.
        width = self.first_nodes.width
        nodes, at, turns, z = self.first_nodes(hr, model.nodes, before, goals)
        table, met = np.zeros((len(goals), width), np.float32), np.zeros(width, bool)
        table.ravel()[at] = slope(z, turns)
        met[nodes] = True
        met = np.flatnonzero(met)
        dhr, dfirst = table @ model.nodes[:width], table.T @ hr
        owner, nodes, turns, rows, at_nodes, z = vocab.late(hr, model.nodes, before, goals)
        z *= turns
        weight = slope(z, turns)[:, None]
        at_nodes *= weight
        rows *= weight
        dhr += _summed(at_nodes, owner, len(goals))
        passed, place = _distinct(nodes, len(model.nodes))
        changed = np.concatenate([met, passed])
        self.seen["nodes"][changed] += 1
        self._move("nodes", changed, np.concatenate([dfirst[met], _summed(rows, place, len(passed))]), rate)
        if len(real) == len(h):
            dh = dhr
        else:
            dh = np.zeros_like(h)
            dh[real] = dhr
        ds = dh.reshape(seen.shape) @ v.transpose(0, 2, 1)
        ds -= np.einsum("ij,ij->i", dh, seen.reshape(-1, DIM)).reshape(total.shape)[..., None]
        ds *= a
        dq, dk, dv = ds @ kk, ds.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ dh.reshape(seen.shape)
        dq, dk, dv, own, inverse = dq.reshape(-1, DIM), dk.reshape(-1, DIM), dv.reshape(-1, DIM), own.ravel(), inverse.ravel()
        ek, eq = e.take(inverse, 0), e.take(own, 0)
        grad = {"wq": (dq.T @ eq).T * _SCALE, "wk": (dk.T @ ek).T, "wv": (dv.T @ ek).T, "wr": (dh.T @ eq).T}
        grad["bias"] = np.bincount(_REL_SEEN, weights=ds.sum(0)[_CAUSAL], minlength=2 * BLOCK).astype(np.float32)
        dek = dk @ model.wk.T
        dek += dv @ model.wv.T
        late = dek.reshape(-1, 2, BLOCK * DIM)[:, 1]
        late += (dq @ wq.T + dh @ model.wr.T).reshape(late.shape)
        self.seen["tokens"][used] += 1
        self._move("tokens", used, _summed(dek, inverse, len(used)), rate)
        for n in _DENSE:
            self._move(n, slice(None), grad[n], rate)

    def _move(self, name: str, at: np.ndarray | slice, grad: np.ndarray, rate: float) -> None:
        # Each row is read once and written once; what is read by numbers is a copy. Moments are kept as sums, 10 and 100 times the means.
        every = isinstance(at, slice)
        first, second = ((x[name] if every else x[name].take(at, 0)) for x in (self.first, self.second))
        first *= 0.9
        first += grad
        second *= 0.99
        second += grad * grad
        if not every:
            self.first[name][at], self.second[name][at] = first, second
        # rate * mean / (root of the mean of squares + 1e-6), both corrected for their beginning at 0
        scale = math.sqrt((1 - 0.99**self.steps) / 0.01)
        change = np.sqrt(second)
        change += 1e-6 * scale
        np.divide(first, change, out=change)
        change *= rate * scale * 0.1 / (1 - 0.9**self.steps)
        weights = getattr(self.model, name)
        weights[at] = (weights if every else weights.take(at, 0)) - change


def _rates(turn: int) -> tuple[float, float]:
    return RATE * (1 - 0.9 * turn / ROUNDS), RATE * (1 - 0.9 * (turn + 1) / ROUNDS)


def draws(laid: np.ndarray) -> np.ndarray:
    """A hash of what is in each block: it draws the round, if any, that the block's window trains in."""
    odd = mixed(np.arange(1, laid.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(laid), np.uint64)
    for j in range(laid.shape[1]):
        total += laid[:, j].astype(np.uint64) * odd[j]
    return mixed(total)


def _rows(model: Attention) -> np.ndarray:
    """All weights as rows of DIM."""
    return np.vstack([getattr(model, n).reshape(-1, DIM) for n in (*_DENSE, *_SPARSE)])


def _with_rows(model: Attention, rows: np.ndarray) -> Attention:
    made, at = {}, 0
    for n in (*_DENSE, *_SPARSE):
        old = getattr(model, n)
        made[n] = rows[at : at + old.size // DIM].reshape(old.shape).astype(np.float32)
        at += old.size // DIM
    return replace(model, **made)


def one_window_in(n_ids: int) -> int:
    """A round takes one window in so many, whatever the corpus's size: each window of each training text trains in one of the ROUNDS."""
    return ROUNDS


def train_on_all(ids: DataFrame, vocab: Vocabulary, model: Attention, n_ids: int, one_in: int) -> Attention:
    """Training in data-parallel ROUNDS, each on one window in `one_in` of all texts, drawn by hash from any position.

    In a round each partition trains by itself from the same weights. Spark sums the weights, each by the steps that it
    took part in, and their mean begins the next round.
    """
    spark = ids.sparkSession
    trainers = min(TRAINERS, max(1, round(n_ids * ROUNDS / one_in / TRAINER_IDS)))

    def total(frames: pd.DataFrame) -> pd.DataFrame:
        sums, weights = np.zeros((WEIGHT_ROWS, DIM)), np.zeros(WEIGHT_ROWS)
        for at, weight, rows in zip(frames["at"], frames["weight"], frames["rows"], strict=True):
            sums[at] += np.asarray(rows).reshape(-1, DIM) * np.asarray(weight)[:, None]
            weights[at] += weight
        at = np.flatnonzero(weights)
        return pd.DataFrame({"chunk": [frames["chunk"].iloc[0]], "at": [at], "rows": [(sums[at] / weights[at, None]).ravel()]})

    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((vocab, model))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            own, layer = sent.value
            trainer, rng, pad = Trainer(own, layer), np.random.default_rng(SEED), own.n + 2
            # Windows are made where they train: written, all of them would be larger than the texts.
            for batch in batches:
                for _, inputs, targets, lengths in stretches(batch.column("ids"), id_type(own.end), own.n + 1, int(own.place[own.end]), own.place):
                    laid, goal, _, begins = blocks(inputs, targets, lengths, pad)
                    chosen = draws(laid) % np.uint64(one_in) == np.uint64(turn % one_in)
                    if chosen.any():
                        trainer.epoch(windows(laid, begins, pad)[chosen], goal[chosen], _rates(turn), rng)
            rows = _rows(trainer.model)
            sparse = np.concatenate([trainer.seen[n] for n in _SPARSE])
            weight = np.concatenate([np.full(len(rows) - len(sparse), float(trainer.steps)), sparse])
            for chunk in range(-(-len(rows) // WEIGHT_ROWS)):
                at = np.flatnonzero(weight[chunk * WEIGHT_ROWS : (chunk + 1) * WEIGHT_ROWS])
                if len(at):
                    of = at + chunk * WEIGHT_ROWS
                    yield pa.RecordBatch.from_pydict(
                        {
                            "chunk": pa.array([chunk], pa.int32()),
                            "at": pa.array([at.astype(np.int32)], pa.list_(pa.int32())),
                            "weight": pa.array([weight[of].astype(np.float32)], pa.list_(pa.float32())),
                            "rows": pa.array([rows[of].ravel()], pa.list_(pa.float32())),
                        }
                    )

        parts = ids.select("ids").coalesce(trainers).mapInArrow(learn, "chunk int, at array<int>, weight array<float>, rows array<float>")
        rows = _rows(model)
        for r in parts.groupBy("chunk").applyInPandas(total, "chunk int, at array<int>, rows array<double>").toPandas().itertuples():
            rows[np.asarray(r.at) + r.chunk * WEIGHT_ROWS] = np.asarray(r.rows).reshape(-1, DIM)
        model = _with_rows(model, rows)
        sent.unpersist()
    return model


# The operator ----------------------------------------------------------------------------------------------------


@dataclass
class Head:
    """The frequent words, the log10 base term of each and of the end, and all their ids end to end: where each word's begin, and how many."""

    words: pa.Array
    base: np.ndarray
    end_base: float
    ids: np.ndarray
    begin: np.ndarray
    size: np.ndarray


def with_ids(words: DataFrame, tokenizer: str, kind: np.dtype) -> DataFrame:
    """word, c and the word's ids as bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, begin, size = word_ids(tokenizer).lookup(batch.column("word"))
            flat = flat.astype(kind)
            ids = [flat[b : b + n].tobytes() for b, n in zip(begin.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(ids, pa.binary())], ["word", "c", "ids"])

    return words.select("word", "c").mapInArrow(encode, "word string, c long, ids binary")


def head_of(counts: DataFrame, tokenizer: str, kind: np.dtype, floor: float, n_train: int) -> Head:
    """counts: the frequent words, at most HEAD."""
    rows = with_ids(counts, tokenizer, kind).toArrow().combine_chunks()
    ids = [np.frombuffer(b, kind) for b in rows.column("ids").to_pylist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    base = np.log10(rows.column("c").to_numpy().astype(float) + BASE_ADD) - floor
    words = pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in rows.column("word").chunks)])
    flat = np.concatenate([np.zeros(0, kind), *ids])
    return Head(words, base, math.log10(n_train + BASE_ADD) - floor, flat, np.cumsum(size) - size, size)


def read_texts(docs: DataFrame, head: Head, tokenizer: str, kind: np.dtype) -> DataFrame:
    """doc_id, held_out, n_tokens, the known frequent words and their base terms, the other words, and the ids of each text, as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(head)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids_of = sent.value, word_ids(tokenizer)

        def of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            words, codes, counts = coded_words(texts)
            place = pc.fill_null(pc.index_in(words, value_set=own.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            index = place[codes]
            text, known = np.repeat(np.arange(len(texts)), counts), index >= 0
            base = np.bincount(text[known], weights=own.base[index[known]] if len(own.base) else None, minlength=len(texts))
            # Only words that aren't frequent are tokenised here.
            new = place < 0
            more, begin, size = ids_of.lookup(words.filter(pa.array(new)))
            begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            begins[new], sizes[new] = begin + len(own.ids), size
            begins[~new], sizes[~new] = own.begin[place[~new]], own.size[place[~new]]
            flat, upto = gathered(np.concatenate([own.ids, more.astype(kind)]), begins, sizes, codes)
            ends = np.concatenate([[0], upto])[np.cumsum(counts)]
            return (
                counts,
                np.bincount(text[known], minlength=len(texts)),
                base,
                words.take(pa.array(codes[~known])),
                np.bincount(text[~known], minlength=len(texts)),
                flat,
                np.diff(ends, prepend=0),
            )

        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                got = [of(texts) for texts in spans]
                n, known, base, n_rare, n_ids = (sum(g[i] for g in got) for i in (0, 1, 2, 4, 6))
                rare, ids = pa.concat_arrays([g[3] for g in got]), np.concatenate([g[5] for g in got])
                ends = [pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)) for sizes in (n_rare, n_ids * kind.itemsize)]
                lists = [
                    pa.ListArray.from_arrays(ends[0], rare),
                    pa.Array.from_buffers(pa.binary(), len(part), [None, ends[1].buffers()[1], pa.py_buffer(np.ascontiguousarray(ids, kind))]),
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base + own.end_base), *lists],
                    ["doc_id", "held_out", "n_tokens", "head_known", "head_base", "rare", "ids"],
                )

    return docs.mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, head_known long, head_base double, rare array<string>, ids binary")


def log10_probability(read: DataFrame, keep: list[str], vocab: Vocabulary, model: Attention) -> DataFrame:
    """`keep` and score, the log10 probability of the ids and the end, of each row."""
    sent = read.sparkSession.sparkContext.broadcast((vocab, model))
    types = {f.name: f.dataType.simpleString() for f in read.schema}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, layer = sent.value
        scorer = Scorer(own, layer)
        for batch in batches:
            score = np.zeros(len(batch))
            for row, inputs, targets, lengths in stretches(batch.column("ids"), id_type(own.end), own.n + 1, int(own.place[own.end]), own.place):
                laid, goal, owner, begins = blocks(inputs, targets, lengths, scorer.pad)
                per_block = scorer.log_probs(laid, goal, begins).sum(1, dtype=np.float64)
                score[row] += np.bincount(owner, weights=per_block, minlength=len(row)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)], [*keep, "score"])

    return read.select(*keep, "ids").mapInArrow(weigh, ", ".join(f"{c} {types[c]}" for c in keep) + ", score double")


def score(docs: DataFrame, held_out: Column, tokenizer: str = TOKENIZER, one_in: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    slim = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    counts = materialize(word_counts(slim, F.col("held_out")), "lm-counts")
    least = head_threshold(counts)
    n_train = slim.where(~F.col("held_out")).count()
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_all, v_all = facts.n + n_train, facts.v + (1 if n_train else 0)
    floor = math.log10(n_all + BASE_ADD * (v_all + 1))
    end = len(word_ids(tokenizer).ends_word)
    kind = id_type(end)
    head = head_of(counts.where(F.col("c") >= least), tokenizer, kind, floor, n_train)
    read = materialize(read_texts(slim, head, tokenizer, kind).withColumn("row_id", F.monotonically_increasing_id()), "lm-read")
    train = read.where(~F.col("held_out"))
    pairs = materialize(neighbours(train, end), "lm-pairs")
    vocab = vocabulary(pairs, end)
    model = untrained(vocab)
    if n_train:
        n_ids = pairs.agg(F.sum("n")).first()[0]
        model = train_on_all(train, vocab, model, n_ids, one_in or one_window_in(n_ids))
    keep = ["row_id", "doc_id", "held_out", "n_tokens", "head_known", "head_base"]
    scored = log10_probability(read, keep, vocab, model)

    terms = counts.where(F.col("c") < least).select(
        "word", (F.col("c") > 0).cast("long").alias("known"), (F.log10(F.col("c") + BASE_ADD) - floor).alias("base")
    )
    rare = (
        read.select("row_id", F.explode("rare").alias("word"))
        .join(terms, "word")
        .groupBy("row_id")
        .agg(F.sum("known").alias("known"), F.sum("base").alias("base"))
    )
    return scored.join(rare, "row_id", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + F.lit(1 if n_train else 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        "score",
    )

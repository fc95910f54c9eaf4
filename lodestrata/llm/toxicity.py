"""Toxicity: a support vector machine on the gap-weighted subsequence kernel, by Nyström landmarks, trained on labelled sentences.

The kernel of two strings is the sum over their common subsequences of length `ORDER`, each weighted by
`DECAY` to the power of the spans it takes in both, so an insult with letters put between still resembles it. Strings
are words without case and without all that isn't a letter or digit; runs of single characters
("i d i o t") are one string.

A sentence has one value per landmark: the best normalised kernel of a piece of one of its words with the landmark, over
pieces in which the landmark's letters follow each other with at most `GAP` characters between; other pieces have the value 0 by
definition. Toxic words too short for the kernel are values of their own, 1 where the word is there.

Training, on a bounded sample of labelled documents (`SAMPLE` a label, drawn by hash; confirmed copies, by the links of
`near_dedup`, count once):

1. Words and fragments of words are counted by class. Fragments bound to toxic documents are chosen until they
   cover every toxic word that has one; these are the landmarks, as many as it takes.
2. The sentences of the sample get their values. Those of clean documents are clean. Of a toxic document it is not known which
   sentences are: all that have a value begin as toxic, and after each fit only those stay that the machine
   finds toxic, but the worst one always (multiple-instance learning).
3. A linear SVM on the Nyström features of sentences, and of virtual ones: each landmark alone with one
   foreign character put in, at every place, and each short word alone, so disguised insults fall on the right side too. A document's evidence is that of its worst sentence, and a logistic curve
   through the evidence of the sampled documents makes it a score.

Scoring reads whole texts, long ones in spans cut at white space. Each distinct word is weighed once per batch.

Defined cases: null and empty texts are one sentence without values. Repeated rows are scored alike; extra columns are ignored.
Without toxic or without clean labelled documents there is no landmark, and every text has the same low
score. Training rows with a null label or null doc_id are left out. Words longer than `LONG_WORD` characters are searched in overlapping windows of
that length, which finds the same pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize
from lodestrata.llm.near_dedup import near_duplicates
from lodestrata.llm.packing import portions

ORDER, DECAY, GAP = 3, 0.6, 2
#: Bounds of the sample of labelled rows: documents of each label, sentences with a value of each label.
SAMPLE, SENTENCES = 12_000, 30_000
#: Pairs whose kernel is computed at once, landmarks of one regular expression, bytes of text a task works on at once.
KERNEL_PAIRS, PATTERN, TEXT_BYTES = 20_000, 32, 2_000_000
#: A toxic fragment is in this many toxic training documents at least, and in so small a share of the clean ones against its share of the toxic ones.
LEAST_DOCS, MOST_CLEAN_SHARE = 3, 0.005
#: Lengths of fragments, of landmarks and of the longest piece of a word; words are searched in windows of LONG_WORD.
FRAGMENT_LENGTHS, LONGEST, PIECE, LONG_WORD = (4, 5, 6), 12, 36, 256
#: Fits of the SVM, and its ridge.
FITS, RIDGE = 4, 1.0
THRESHOLD, CACHED_WORDS = 0.7, 100_000
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Ends of sentences.
STOPS = r"[.!?]+[^\p{L}\p{N}]*$"


def normal_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All normalised words of the texts, the text number and the sentence number of each. Sentences end at a stop or a line's end."""
    split = pc.utf8_lower(pc.fill_null(texts, ""))
    split = pc.replace_substring(split, "\n", " . ")
    split = pc.ascii_split_whitespace(split)
    offsets = split.offsets.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    bare = pc.replace_substring_regex(coded.dictionary, NOT_WORD, "")
    words = bare.take(coded.indices)
    stops = pc.match_substring_regex(coded.dictionary, STOPS).to_numpy(zero_copy_only=False)[codes] if len(coded) else np.zeros(0, bool)
    ended = np.concatenate([[0], np.cumsum(stops)[:-1]]) if len(stops) else np.zeros(0, np.int64)
    sentence = ended + owner  # a new text begins a sentence
    single = (pc.utf8_length(bare).to_numpy(zero_copy_only=False) == 1)[codes] if len(coded) else np.zeros(0, bool)
    # Runs of three and more single characters, within a text, are one string more.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
    runs, at = [], []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a < 3:
            continue
        cuts = [a, *(np.flatnonzero(np.diff(owner[a:b])) + a + 1).tolist(), b]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo >= 3:
                runs.append("".join(words.slice(lo, hi - lo).to_pylist()))
                at.append(lo)
    if runs:
        words = pa.concat_arrays([words, pa.array(runs, words.type)])
        owner, sentence = np.concatenate([owner, owner[at]]), np.concatenate([sentence, sentence[at]])
    return words, owner, sentence


def _chars(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), np.uint32)
    for i, s in enumerate(strings):
        codes = np.frombuffer(s[:width].encode("utf-32-le"), np.uint32)
        out[i, : len(codes)] = codes
    return out


def _kernel(a: np.ndarray, b: np.ndarray, order: int, decay: float) -> np.ndarray:
    """The kernel of rows of characters that broadcast against each other, by dynamic programming; one row of the table is held at a time."""
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    width_b = b.shape[-1]
    total, twice = np.zeros(shape), decay * decay
    # held[p][j]: weight of common subsequences of length p in the characters so far and the first j, with the decay to their ends.
    held = [[np.ones(shape)] * (width_b + 1)] + [[np.zeros(shape)] * (width_b + 1) for _ in range(order - 1)]
    for i in range(a.shape[-1]):
        ca = a[..., i]
        same = [(ca == b[..., j]) & (ca > 0) for j in range(width_b)]
        for j in range(width_b):
            total += np.where(same[j], twice * held[order - 1][j], 0.0)
        new = [held[0]]
        for p in range(1, order):
            run, row = np.zeros(shape), [held[p][0]]
            for j in range(1, width_b + 1):
                run = decay * run + np.where(same[j - 1], twice * held[p - 1][j - 1], 0.0)
                row.append(decay * held[p][j] + run)
            new.append(row)
        held = new
    return total


def subsequence_kernel(left: list[str], right: list[str], order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """K(s, t) for all s in left, t in right (cut at PIECE characters), KERNEL_PAIRS pairs at once."""
    out, step = np.zeros((len(left), len(right))), max(1, KERNEL_PAIRS // max(1, len(right)))
    if not len(left) or not len(right):
        return out
    b = _chars(right, min(PIECE, max(map(len, right))))
    for i in range(0, len(left), step):
        part = left[i : i + step]
        out[i : i + step] = _kernel(_chars(part, max(1, min(PIECE, max(map(len, part)))))[:, None, :], b[None, :, :], order, decay)
    return out


def own_kernel(strings: list[str]) -> np.ndarray:
    """K(s, s) of each string."""
    out = np.zeros(len(strings))
    for i in range(0, len(strings), KERNEL_PAIRS):
        part = strings[i : i + KERNEL_PAIRS]
        a = _chars(part, max(1, min(PIECE, max(map(len, part)))))
        out[i : i + KERNEL_PAIRS] = _kernel(a, a, ORDER, DECAY)
    return out


def pair_kernel(left: list[str], right: list[str]) -> np.ndarray:
    """K(s, t) of each pair (s, t) of the two lists."""
    out = np.zeros(len(left))
    for i in range(0, len(left), KERNEL_PAIRS):
        a, b = left[i : i + KERNEL_PAIRS], right[i : i + KERNEL_PAIRS]
        out[i : i + KERNEL_PAIRS] = _kernel(*(_chars(x, max(1, min(PIECE, max(map(len, x))))) for x in (a, b)), ORDER, DECAY)
    return out


def gapped(landmark: str) -> str:
    """A regular expression of the landmark with at most GAP characters between its letters."""
    return f".{{0,{GAP}}}?".join(map(re.escape, landmark))


@dataclass
class Model:
    """landmarks and short words, in this order, are the values of a sentence; weights are those of the SVM carried back to them."""

    landmarks: list[str]
    norms: np.ndarray
    short: list[str]
    weights: np.ndarray
    bias: float
    slope: float = 4.0
    shift: float = 0.0
    compiled: list[re.Pattern] = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"compiled": []}

    @property
    def n_values(self) -> int:
        return len(self.landmarks) + len(self.short)

    def near(self, words: pa.Array) -> np.ndarray:
        """Which words may have a value: the gate that the values are defined by, for all landmarks at once."""
        found = pc.is_in(words, value_set=pa.array(self.short, pa.string())).to_numpy(zero_copy_only=False).copy()
        every = [gapped(m).replace("}?", "}") for m in self.landmarks]
        for i in range(0, len(every), PATTERN):
            found |= pc.match_substring_regex(words, "|".join(every[i : i + PATTERN])).to_numpy(zero_copy_only=False)
        return found

    def word_values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words: which word, which value, how much. The value of a landmark is that of the word's best piece that has its letters."""
        if not self.compiled and self.landmarks:
            self.compiled = [re.compile(f"(?=({gapped(m)}))", re.DOTALL) for m in self.landmarks]
        at, which, pieces = [], [], []
        for w, word in enumerate(words):
            parts = [word[i : i + LONG_WORD] for i in range(0, max(1, len(word) - PIECE), LONG_WORD - PIECE)]
            for m, pattern in enumerate(self.compiled):
                for piece in {found[1] for part in parts for found in pattern.finditer(part)}:
                    at.append(w)
                    which.append(m)
                    pieces.append(piece)
        own = np.sqrt(np.maximum(own_kernel(pieces), 1e-12))
        value = pair_kernel(pieces, [self.landmarks[m] for m in which]) / own / self.norms[which] if pieces else np.zeros(0)
        place = {s: len(self.landmarks) + i for i, s in enumerate(self.short)}
        exact = [(w, place[word]) for w, word in enumerate(words) if word in place]
        found = pd.DataFrame(
            {
                "word": np.array([*at, *(w for w, _ in exact)], np.int64),
                "value": np.array([*which, *(v for _, v in exact)], np.int64),
                "much": np.concatenate([value, np.ones(len(exact))]),
            }
        )
        best = found.groupby(["word", "value"], as_index=False)["much"].max()
        return best["word"].to_numpy(), best["value"].to_numpy(), best["much"].to_numpy()

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -30, 30)))


class Reader:
    """Values of the sentences of texts. Words that were met before are not weighed again."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, list[tuple[int, float]]] = {}

    def sentences(self, texts: pa.Array) -> pd.DataFrame:
        """text, sentence, value and much, for each value above 0 of each sentence."""
        words, owner, sentence = normal_words(texts)
        coded = words.dictionary_encode()
        hits = np.flatnonzero(self.model.near(coded.dictionary))
        strings = coded.dictionary.take(pa.array(hits)).to_pylist()
        new = [w for w in strings if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, new = {}, strings
        self.known.update((w, []) for w in new)
        for w, v, much in zip(*self.model.word_values(new), strict=True):
            self.known[new[w]].append((int(v), float(much)))
        flat = [(h, v, much) for h, w in zip(hits.tolist(), strings, strict=True) for v, much in self.known[w]]
        values = pd.DataFrame(flat, columns=["code", "value", "much"]).astype({"code": np.int64, "value": np.int64, "much": float})
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        is_hit = np.zeros(len(coded.dictionary) + 1, bool)
        is_hit[hits] = True
        there = np.flatnonzero(is_hit[codes])
        met = pd.DataFrame({"text": owner[there], "sentence": sentence[there], "code": codes[there]}).drop_duplicates()
        return met.merge(values, on="code").groupby(["text", "sentence", "value"], as_index=False)["much"].max()


def find_landmarks(fragments: dict[str, int], toxic: dict[str, int]) -> list[str]:
    """Fragments chosen greedily by the toxic words that they are in, each then grown to all that its words share.

    So an insult comes whole, and a stem without its many endings. toxic: documents of each word.
    """
    holders: dict[str, set[str]] = {}
    for w in toxic:
        for part in {w[i : i + n] for n in FRAGMENT_LENGTHS for i in range(len(w) - n + 1)}:
            if part in fragments:
                holders.setdefault(part, set()).add(w)
    left, found = set(toxic), []
    weight = {f: sum(toxic[w] for w in own) for f, own in holders.items()}
    while weight:
        best = max(weight, key=lambda f: (weight[f], len(f), f))
        if not weight[best]:
            break
        gone = holders[best] & left
        found.append(_shared(best, sorted(gone)))
        left -= gone
        for w in gone:
            for part in {w[i : i + n] for n in FRAGMENT_LENGTHS for i in range(len(w) - n + 1)} & weight.keys():
                weight[part] -= toxic[w]
    return sorted(set(found))


def _shared(fragment: str, words: list[str]) -> str:
    """The longest string around fragment that all words have, LONGEST characters at most."""
    whole, at = words[0], words[0].index(fragment)
    best = fragment
    for i in range(at + 1):
        for j in range(at + len(fragment), min(len(whole), i + LONGEST) + 1):
            if j - i > len(best) and all(whole[i:j] in w for w in words):
                best = whole[i:j]
    return best


def word_classes(docs: DataFrame) -> DataFrame:
    """word, toxic_docs and clean_docs over all documents of docs (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                # A word in several spans of one long text counts once.
                met = [normal_words(texts)[:2] for texts in spans]
                words, owner = pa.concat_arrays([w for w, _ in met]), np.concatenate([o for _, o in met]).astype(np.int64)
                coded = words.dictionary_encode()
                size = max(1, len(coded.dictionary))
                pairs = np.unique(owner * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False)[pairs // size]
                bad = np.bincount(pairs % size, weights=toxic, minlength=len(coded.dictionary)).astype(np.int64)
                every = np.bincount(pairs % size, minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(bad), pa.array(every - bad)], ["word", "toxic_docs", "clean_docs"])

    rows = docs.select("text", F.col("toxic").cast("long").alias("toxic"))
    return (
        rows.mapInArrow(count, "word string, toxic_docs long, clean_docs long")
        .groupBy("word")
        .agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))
    )


def _machine(fragments: list[str]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for i, f in enumerate(fragments):
        machine.add_word(f, i)
    machine.make_automaton()
    return machine


def fragment_documents(docs: DataFrame, fragments: list[str]) -> DataFrame:
    """fragment, toxic_docs and clean_docs: in how many documents of docs (text, toxic) each fragment is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(fragments)
        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                found = []
                for texts in spans:
                    words, owner, _ = normal_words(texts)
                    coded = words.dictionary_encode()
                    hits = [(w, i) for w, word in enumerate(coded.dictionary.to_pylist()) for i in {i for _, i in machine.iter(word)}]
                    at = pd.DataFrame(hits, columns=["word", "fragment"], dtype=np.int64)
                    has = pd.DataFrame({"word": coded.indices.to_numpy(zero_copy_only=False), "doc": owner})
                    found.append(has[has["word"].isin(at["word"])].drop_duplicates().merge(at, on="word")[["doc", "fragment"]])
                has = pd.concat(found).drop_duplicates()
                bad = part.column("toxic").to_numpy(zero_copy_only=False)[has["doc"].to_numpy(np.int64)] == 1
                every = np.bincount(has["fragment"], minlength=len(fragments))
                toxic = np.bincount(has["fragment"][bad], minlength=len(fragments))
                met = np.flatnonzero(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fragments).take(pa.array(met)), pa.array(toxic[met].astype(np.int64)), pa.array((every - toxic)[met].astype(np.int64))],
                    ["fragment", "toxic_docs", "clean_docs"],
                )

    rows = docs.select("text", F.col("toxic").cast("long").alias("toxic"))
    return (
        rows.mapInArrow(count, "fragment string, toxic_docs long, clean_docs long")
        .groupBy("fragment")
        .agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))
    )


def holding(words: DataFrame, fragments: list[str]) -> DataFrame:
    """word and toxic_docs of the words that have one of the fragments."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(fragments)
        for batch in batches:
            yield batch.filter(pa.array([next(machine.iter(w), None) is not None for w in batch.column("word").to_pylist()], pa.bool_()))

    return words.select("word", "toxic_docs").mapInArrow(keep, "word string, toxic_docs long")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of at most SAMPLE labelled documents a label, drawn by hash; of confirmed copies with one label one counts.

    A document with both labels counts as toxic; of rows with one doc_id the smallest text counts.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for t in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    rows = materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    groups = near_duplicates(rows.select("doc_id", "text"), width=3, percent=85).select("doc_id", "component_id")
    first = rows.join(groups, "doc_id").groupBy("component_id", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return materialize(rows.join(first, "doc_id"), "toxic-once")


def fragments_of(part: Column) -> Column:
    """All runs of FRAGMENT_LENGTHS characters of a string."""
    none = F.array().cast("array<string>")
    runs = [F.when(F.length(part) >= n, F.transform(F.sequence(F.lit(1), F.length(part) - n + 1), _run(part, n))).otherwise(none) for n in FRAGMENT_LENGTHS]
    return F.flatten(F.array(*runs))


def _run(part: Column, n: int):
    return lambda i: F.substring(part, i, n)


def candidates(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Landmarks, and toxic words too short for a fragment, of the sampled documents."""
    held = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(held) < 2:
        return [], []
    words = materialize(word_classes(rows), "toxic-words")
    # Fragments that toxic documents have and clean ones lack: first by words, then by documents. Very long words give theirs in parts that overlap.
    step = LONG_WORD - max(FRAGMENT_LENGTHS) + 1
    parts = F.transform(F.sequence(F.lit(0), (F.greatest(F.length("word") - 1, F.lit(0)) / step).cast("int")), lambda k: F.substring("word", k * step + 1, LONG_WORD))
    pieces = F.array_distinct(F.flatten(F.transform(parts, fragments_of)))
    odds = held[1] / held[0]
    rare_in_clean = F.col("clean_docs") <= F.lit(MOST_CLEAN_SHARE / odds) * F.col("toxic_docs")
    fragments = (
        words.select(F.explode(pieces).alias("fragment"), "toxic_docs", "clean_docs")
        .groupBy("fragment")
        .agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))
    )
    fragments = materialize(fragments.where((F.col("toxic_docs") >= LEAST_DOCS) & rare_in_clean), "toxic-fragments")
    short = words.where((F.length("word") > 0) & (F.length("word") < min(FRAGMENT_LENGTHS)) & (F.col("toxic_docs") >= LEAST_DOCS) & rare_in_clean)
    tried = fragments.count() + short.count()
    share = held[1] / (held[0] + held[1])
    # What chance alone would put into so many toxic documents only, of all that is tried, is no insult.
    significant = F.pow(F.lit(share), F.col("toxic_docs")) * tried < 0.1
    exact = sorted(r.word for r in short.where(significant).collect())
    # Words' documents are no fewer than those of the fragment, so none is lost here.
    first = [r.fragment for r in fragments.where(significant).orderBy("fragment").collect()]
    counted = fragment_documents(rows, first).where(rare_in_clean).collect() if first else []
    good = {r.fragment: r.toxic_docs for r in counted if r.toxic_docs >= LEAST_DOCS and share**r.toxic_docs * tried < 0.1}
    toxic = {r.word: r.toxic_docs for r in holding(words.where(rare_in_clean & (F.col("toxic_docs") > 0)), sorted(good)).collect()} if good else {}
    return find_landmarks(good, toxic), exact


def sentence_values(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep`, sentence (a number), values and much (arrays) of each sentence that has a value; of equal ones of a document one."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in keep}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                for number, texts in enumerate(spans):
                    found = reader.sentences(texts)
                    one = found.groupby(["text", "sentence"], as_index=False).agg({"value": tuple, "much": tuple}).drop_duplicates(["text", "value", "much"])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[part.column(c).take(pa.array(one["text"].to_numpy(np.int64))) for c in keep],
                            pa.array(number * 2**32 + one["sentence"].to_numpy(np.int64)),
                            pa.array(one["value"].map(list).tolist(), pa.list_(pa.int32())),
                            pa.array(one["much"].map(list).tolist(), pa.list_(pa.float64())),
                        ],
                        [*keep, "sentence", "value", "much"],
                    )

    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", sentence long, value array<int>, much array<double>"
    return rows.select(*keep, "text").mapInArrow(read, schema)


def nystrom(model: Model) -> np.ndarray:
    """The map from a sentence's values to features whose products are kernels; short words are features as they are."""
    n = len(model.landmarks)
    root = np.eye(model.n_values)
    if n:
        k = subsequence_kernel(model.landmarks, model.landmarks) / model.norms[:, None] / model.norms[None, :]
        spread, vectors = np.linalg.eigh(k)
        spread = np.where(spread > 1e-3 * spread.max(), spread, np.inf)
        root[:n, :n] = vectors / np.sqrt(spread)
    return root


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A squared-hinge linear SVM by Newton steps: weights and bias. Both classes weigh the same in all."""
    cost = weight * np.where(y > 0, 1 / max(1e-9, weight[y > 0].sum()), 1 / max(1e-9, weight[y < 0].sum())) * len(y)
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (z @ w) < 1
        weighted = z[active] * cost[active][:, None]
        new = np.linalg.solve(ridge + weighted.T @ z[active], weighted.T @ y[active])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def virtual(model: Model) -> pd.DataFrame:
    """Toxic sentences that hold a landmark with one foreign character put in, for each place in each landmark, or a short toxic word."""
    odd = [(m, f"{w[:i]}\uffff{w[i:]}") for m, w in enumerate(model.landmarks) for i in range(1, len(w))]
    pieces = [p for _, p in odd]
    much = pair_kernel(pieces, [model.landmarks[m] for m, _ in odd]) / np.sqrt(own_kernel(pieces)) / model.norms[[m for m, _ in odd]] if odd else []
    which, much = [*(m for m, _ in odd), *range(len(model.landmarks), model.n_values)], [*much, *(1.0 for _ in model.short)]
    return pd.DataFrame({"doc_id": [-1 - i for i in range(len(which))], "toxic": 1, "value": [[m] for m in which], "much": [[x] for x in much]})


def train_svm(model: Model, sentences: pd.DataFrame, plain: int) -> Model:
    """Fits the weights. sentences: doc_id, toxic, value and much of sentences with a value; plain: clean sentences without any."""
    sentences = pd.concat([sentences.assign(doc_id=pd.factorize(sentences["doc_id"])[0]), virtual(model)], ignore_index=True)
    x = np.zeros((len(sentences) + 1, model.n_values))
    for i, (value, much) in enumerate(zip(sentences["value"], sentences["much"], strict=True)):
        x[i, value] = much
    features = x @ nystrom(model)
    toxic = np.append(sentences["toxic"].to_numpy(int), 0) == 1
    weight = np.append(np.ones(len(sentences)), max(1, plain))
    bag = np.append(pd.factorize(sentences["doc_id"])[0], -1)
    positive, w, b = toxic.copy(), np.zeros(features.shape[1]), -1.0
    if not positive.any():
        return model
    for _ in range(FITS):
        used = positive | ~toxic
        w, b = fit(features[used], np.where(positive, 1.0, -1.0)[used], weight[used])
        evidence = features @ w + b
        worst = pd.Series(evidence[toxic]).groupby(bag[toxic]).transform("max").to_numpy()
        now = toxic.copy()
        now[toxic] = (evidence[toxic] > 0) | (evidence[toxic] == worst)
        if (now == positive).all():
            break
        positive = now
    return Model(model.landmarks, model.norms, model.short, nystrom(model) @ w, b)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of labelled documents of labels (doc_id, toxic)."""
    rows = sample(docs, labels)
    landmarks, short = candidates(rows)
    nothing = Model([], np.zeros(0), [], np.zeros(0), -1.0, 4.0, -1.0)
    if not landmarks and not short:
        return nothing
    model = Model(landmarks, np.sqrt(own_kernel(landmarks)), short, np.zeros(len(landmarks) + len(short)), -1.0)
    found = materialize(sentence_values(rows, model, ["doc_id", "toxic"]), "toxic-sentences")
    drawn = [
        found.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id", "sentence"), "doc_id", "sentence").limit(SENTENCES).toPandas() for t in (0, 1)
    ]
    # Clean sentences without a value are all alike: their number is enough.
    stops = F.size(F.split(F.coalesce("text", F.lit("")), r"[.!?\n]+"))
    plain = rows.where("toxic = 0").agg(F.coalesce(F.sum(stops), F.lit(0))).first()[0] - len(drawn[0])
    model = train_svm(model, pd.concat(drawn, ignore_index=True), int(plain))
    judged = document_evidence(rows, model, ["toxic"]).toPandas()
    disguised = virtual(model)
    held = [m @ model.weights[v] + model.bias for v, m in zip(disguised["value"], disguised["much"], strict=True)]
    model.slope, model.shift = calibrate(pd.concat([judged, pd.DataFrame({"toxic": 1, "evidence": held}, dtype=float)]))
    return model


def calibrate(rows: pd.DataFrame) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (evidence, toxic), held by a weak ridge."""
    e, y = rows["evidence"].to_numpy(float), rows["toxic"].to_numpy(float)
    z, w = np.column_stack([e, np.ones(len(e))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = 0.05 * np.eye(2)
        w = w + np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
    return float(max(w[0], 0.1)), float(w[1])


def document_evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """`keep` and evidence, that of the worst sentence, of each document."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in keep}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part, spans in portions(batch, TEXT_BYTES):
                out = np.full(len(part), model.bias)
                for texts in spans:
                    found = reader.sentences(texts)
                    each = (found["much"] * model.weights[found["value"].to_numpy(np.int64)]).groupby([found["text"], found["sentence"]]).sum() + model.bias
                    np.maximum.at(out, each.index.get_level_values(0).to_numpy(np.int64), each.to_numpy(float))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(out)], [*keep, "evidence"])

    return docs.select(*keep, "text").mapInArrow(weigh, ", ".join(f"{c} {types[c]}" for c in keep) + ", evidence double")


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each document."""
    weighed = document_evidence(docs.select(F.col("doc_id").cast("long"), "text"), model, ["doc_id"])
    curve = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("evidence") * model.slope + model.shift))
    scored = weighed.select("doc_id", (1 / (1 + F.exp(-curve))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

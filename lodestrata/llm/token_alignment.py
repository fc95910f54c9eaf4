"""Alignment of two tokenizers' tokens over the bytes of each text, with corpus-wide counts of linked id pairs.

A byte-level BPE tokenizer (A) and a SentencePiece model (B) cut the same bytes. Where tokens of both end, the text falls into
groups; an A token and a B token are linked where their bytes overlap.

1. Segments. No token of either tokenizer crosses a single space between two characters that aren't white space (A's pattern takes
   a space only before what follows it; no piece of B has a space after another character, which is checked). So texts are cut there, and
   each distinct segment of a slice of texts is tokenised and aligned once: what a text has is the sum over its segments.
2. Alignment, in Arrow. Token lists are flattened beside their parent indices; byte ends are cumulative sums within each segment;
   a full outer Acero join on (segment, end) gives the union of the ends. Each end of the union closes one stretch of bytes that
   lies in one A and one B token, so it is one link, and ends of both are ends of groups. Filling backwards gives each stretch its tokens.
3. Counts. The distinct pairs of each text are written once; `Table.group_by` counts texts by pair in each task, and Spark
   merges the counts and finds each A id's highest.
4. What a text's links count. The most frequent pairs, at most `HEAD`, are broadcast and added up on the spot; the others, rare by
   definition, join their counts by key. So no frequent pair is shuffled by its key, and what is broadcast is bounded.

Special tokens' strings inside texts are plain text. Defined cases: texts that are null or empty, or whose joined bytes differ between
the tokenizers (B reads U+2581 as a space), have no tokens: counts of 0 and ''. Repeated rows count as documents of their own; a null
doc_id stays null. Extra columns are ignored; an empty table gives no rows. A long text is read in spans cut at segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize
from lodestrata.llm.packing import gathered, slices

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are broadcast, at most.
HEAD = 262_144
#: Bytes of text that are aligned at once, and of segments that are tokenised in one call.
TEXT_BYTES, JOINED_BYTES = 4_000_000, 200_000
#: B's id is the low part of a pair's code.
PAIR = 1 << 32

#: Lead bytes of white space beyond ASCII (U+0085, U+00A0, U+1680, U+2000 and after, U+3000): characters that begin so are not cut at.
_WHITE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_SAFE_NEXT = np.zeros(256, bool)
_SAFE_NEXT[0x21:0x7F] = True
_SAFE_NEXT[0xC3:0xF5] = True
_SAFE_NEXT[list(_WHITE_LEADS)] = False
_INNER_SPACE = re.compile("[^▁]▁")


class Tokenizers:
    """Both tokenizers of a worker, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        # The printable characters that stand for bytes: a byte that is printable Latin-1 stands for itself, others come after 255 in order.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(_INNER_SPACE.search(p) for p in pieces)
        self.size_a, self.size_b = (np.array([len(t) for t in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(known), np.uint8) for known in (self.bytes_a, self.bytes_b))
        self.begin_a, self.begin_b = (np.cumsum(size) - size for size in (self.size_a, self.size_b))

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """A's and B's ids of each text; a text begins with the space that B adds by itself."""
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch(texts, add_special_tokens=False)] if texts else []
        b = [np.array(x, np.int64) for x in self.b.encode([t[1:] for t in texts], num_threads=1)] if texts else []
        return a, b


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def loaded(name_a: str, name_b: str) -> Tokenizers:
    """This worker's tokenizers: files' paths, or names that public_tokenizers knows."""
    if (name_a, name_b) not in _LOADED:
        import public_tokenizers

        _LOADED[name_a, name_b] = Tokenizers(*(str(n if "/" in n else public_tokenizers.path(n)) for n in (name_a, name_b)))
    return _LOADED[name_a, name_b]


def _plain_end(last: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Whether the last byte, and the one before, end a character that is surely no white space: ASCII, or two bytes from U+00C0 on."""
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))


def segments(texts: pa.Array, cuts: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Space and text of each non-empty text, cut before single spaces that no token crosses; the segments, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    if isinstance(spaced, pa.ChunkedArray):
        spaced = spaced.combine_chunks()
    spaced = pa.concat_arrays([spaced, pa.array([], pa.string())])
    _, offsets, data = spaced.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(spaced) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    begins = np.zeros(len(raw) + 1, bool)
    begins[ends[:-1][np.diff(ends) > 0]] = True
    if cuts and len(raw) > 3:
        at = np.flatnonzero(raw[:-1] == 32)
        at = at[at >= 2]
        before, lead = raw[at - 1], raw[at - 2]
        begins[at[_SAFE_NEXT[raw[at + 1]] & _plain_end(before, lead)]] = True
    starts = np.flatnonzero(begins[:-1])
    bounds = np.append(starts, len(raw)).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.diff(np.searchsorted(starts, ends))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *ids])))


def _split_at(ids: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> list[np.ndarray] | None:
    """ids of texts end to end, told apart at the byte bounds of the texts; None where a token crosses one."""
    ends = np.cumsum(size[ids])
    at = np.searchsorted(ends, bounds)
    if not len(ids) or at[-1] + 1 != len(ids) or not np.array_equal(ends[at], bounds):
        return None
    return np.split(ids, at[:-1] + 1)


def token_lists(pieces: pa.Array, own: Tokenizers) -> tuple[pa.ListArray, pa.ListArray]:
    """A's and B's ids of each segment. Plain segments, without other spaces, are tokenised many at once and told apart by their bytes."""
    texts = pieces.to_pylist()
    plain = np.zeros(len(texts), bool)
    if own.cuts and len(texts):
        # A segment that begins or ends with what may be white space is tokenised by itself.
        plain = pc.and_not(pc.equal(pc.count_substring(pieces, " "), 1), pc.match_substring(pieces, "▁")).to_numpy(zero_copy_only=False)
        _, offsets, data = pieces.buffers()
        ends, raw = np.frombuffer(offsets, np.int32)[: len(texts) + 1], np.frombuffer(data, np.uint8)
        size = np.diff(ends)
        first, last, lead = raw[np.minimum(ends[:-1] + 1, len(raw) - 1)], raw[ends[1:] - 1], raw[np.maximum(ends[1:] - 2, 0)]
        plain = plain & (size > 1) & _SAFE_NEXT[first] & _plain_end(last, lead)
    a: list = [None] * len(texts)
    b: list = [None] * len(texts)
    sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = np.flatnonzero(plain)
    for some in np.split(joined, np.flatnonzero(np.diff(np.cumsum(sizes[joined]) // JOINED_BYTES)) + 1) if len(joined) else []:
        one = "".join(texts[i] for i in some.tolist())
        (all_a,), (all_b,) = own.ids([one])
        bounds = np.cumsum(sizes[some])
        for out, ids, size in ((a, all_a, own.size_a), (b, all_b, own.size_b)):
            for i, x in zip(some.tolist(), _split_at(ids, size, bounds) or (), strict=False):
                out[i] = x
    rest = [i for i in range(len(texts)) if a[i] is None or b[i] is None]
    for i, x, y in zip(rest, *own.ids([texts[i] for i in rest]), strict=True):
        a[i], b[i] = x, y
    return _lists(a), _lists(b)


def _ends(ids: pa.ListArray, size: np.ndarray, name: str) -> tuple[pa.Table, np.ndarray]:
    """segment, end (bytes from the segment's beginning) and the place of each token; and the bytes of each segment."""
    parent = pc.list_parent_indices(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(ids).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size[flat])
    total = np.bincount(parent, weights=size[flat], minlength=len(ids)).astype(np.int64)
    ends = upto - (np.cumsum(total) - total)[parent]
    return pa.table({"segment": parent, "end": ends, name: np.arange(len(flat))}), total


def _joined(strings: pa.Array, owner: np.ndarray, n: int, by: str) -> pa.Array:
    """The strings of each owner (in order, from 0 to n - 1) as one."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), strings), by)


@dataclass
class Aligned:
    """Of each segment: whether both tokenizers give its bytes, numbers of tokens and groups, its groups as text, and where its links (pair codes) begin."""

    same: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text: pa.Array
    pairs: np.ndarray
    begin: np.ndarray
    n_links: np.ndarray


def align(pieces: pa.Array, own: Tokenizers) -> Aligned:
    """The alignment of each segment."""
    n = len(pieces)
    a, b = token_lists(pieces, own)
    flat_a, flat_b = (pc.list_flatten(x).to_numpy(zero_copy_only=False) for x in (a, b))
    (ends_a, total_a), (ends_b, total_b) = _ends(a, own.size_a, "a"), _ends(b, own.size_b, "b")
    # Segments whose bytes differ: by length first, then by content.
    length = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    same = (total_a == length) & (total_b == length)
    raw = np.frombuffer(pieces.buffers()[2], np.uint8)[: int(length.sum())] if n else np.zeros(0, np.uint8)
    for flat, begin, size, ids, total in ((own.flat_a, own.begin_a, own.size_a, flat_a, total_a), (own.flat_b, own.begin_b, own.size_b, flat_b, total_b)):
        made, _ = gathered(flat, begin, size, ids)
        fits = np.repeat(total == length, total)
        wanted = raw[np.repeat(total == length, length)]
        wrong = np.repeat(np.arange(n), total)[fits][made[fits] != wanted]
        same[wrong] = False

    union = ends_a.join(ends_b, ["segment", "end"], join_type="full outer", use_threads=False).sort_by([("segment", "ascending"), ("end", "ascending")])
    segment = union.column("segment").to_numpy()
    kept = same[segment]
    union, segment = union.filter(pa.array(kept)), segment[kept]
    in_a, in_b = (union.column(c).combine_chunks() for c in ("a", "b"))
    both = pc.and_(in_a.is_valid(), in_b.is_valid()).to_numpy(zero_copy_only=False)
    # The token that a stretch lies in is the next one that ends.
    place_a, place_b = (pc.fill_null_backward(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (in_a, in_b))
    pairs = flat_a[place_a] * PAIR + flat_b[place_b]
    n_links = np.bincount(segment, minlength=n)
    group = np.cumsum(both) - both  # of each stretch, over all segments
    n_groups = np.bincount(segment[both], minlength=n)

    def by_group(place: np.ndarray, flat: np.ndarray) -> pa.Array:
        last = np.append(place[1:] != place[:-1], True) if len(place) else np.zeros(0, bool)
        ids = pa.array(flat[place[last]]).cast(pa.string())
        return _joined(ids, group[last], int(both.sum()), ",")

    texts = pc.binary_join_element_wise(by_group(place_a, flat_a), by_group(place_b, flat_b), "|")
    counts = [np.diff(x.offsets.to_numpy(zero_copy_only=False)).astype(np.int64) * same for x in (a, b)]
    return Aligned(same, *counts, n_groups, _joined(texts, segment[both], n, ";"), pairs, np.cumsum(n_links) - n_links, n_links)


def cut_spans(text: str, limit: int) -> Iterator[str]:
    """Parts of about `limit` characters of a long text, each beginning with a space that no token crosses."""
    at = 0
    while at < len(text):
        found = _CUT.search(text, at + limit)
        until = found.start() + 1 if found else len(text)
        yield text[at:until]
        at = until


#: A single space between ASCII characters that aren't white space: what follows the first of them begins a segment.
_CUT = re.compile("[!-~] (?=[!-~])")


def aligned_texts(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B) -> DataFrame:
    """row_id, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the text's distinct pairs with the links of each."""

    def totals(texts: pa.Array, own: Tokenizers, spaced: bool = False) -> tuple:
        pieces, counts = segments(texts, own.cuts)
        coded = pieces.dictionary_encode()
        got = align(coded.dictionary, own)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        bad = np.bincount(owner[~got.same[code]], minlength=len(texts)) > 0
        sums = [np.bincount(owner, weights=x[code], minlength=len(texts)).astype(np.int64) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)]
        # Links of each text: its distinct segments, as often as it has them, times their links.
        cell, often = np.unique(owner * max(1, len(coded.dictionary)) + code, return_counts=True)
        who, what = np.divmod(cell, max(1, len(coded.dictionary)))
        pairs, _ = gathered(got.pairs, got.begin, got.n_links, what)
        of, times = np.repeat(who, got.n_links[what]), np.repeat(often, got.n_links[what])
        known, place = np.unique(pairs, return_inverse=True)
        key, inverse = np.unique(of * max(1, len(known)) + place, return_inverse=True)
        times = np.bincount(inverse, weights=times, minlength=len(key)).astype(np.int64)
        who, what = np.divmod(key, max(1, len(known)))
        told = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), got.text.take(pa.array(code))), ";")
        return bad, sums, who, known[what], times, told

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(name_a, name_b)
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                texts = part.column("text")
                if len(part) == 1 and texts[0].is_valid and texts[0].as_buffer().size > 2 * TEXT_BYTES and own.cuts:
                    yield _of_long(part, texts[0].as_py(), own)
                    continue
                bad, sums, who, pairs, times, told = totals(texts, own)
                digests = ["" if x or not t else hashlib.sha256(t.as_buffer()).hexdigest() for x, t in zip((bad | (sums[0] == 0)).tolist(), told, strict=True)]
                yield _batch(part, bad, sums, who, pairs, times, digests)

    def _of_long(part: pa.RecordBatch, text: str, own: Tokenizers) -> pa.RecordBatch:
        digest, bad, sums, pairs, times, first = hashlib.sha256(), False, [0, 0, 0, 0], [], [], True
        for span in cut_spans(" " + text, TEXT_BYTES):
            wrong, more, _, codes, often, told = totals(pa.array([span[1:]]), own)
            digest.update(b"" if first else b";")
            digest.update(told[0].as_buffer())
            bad, first, sums = bad or bool(wrong[0]), False, [x + int(y[0]) for x, y in zip(sums, more, strict=True)]
            pairs.append(codes)
            times.append(often)
            if len(pairs) > 8:
                pairs, times = ([x] for x in _added(pairs, times))
        codes, often = _added(pairs, times)
        return _batch(part, np.array([bad]), [np.array([x]) for x in sums], np.zeros(len(codes), np.int64), codes, often, ["" if bad else digest.hexdigest()])

    schema = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(read, schema)


def _added(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return known, np.bincount(place, weights=np.concatenate(times), minlength=len(known)).astype(np.int64)


def _batch(part: pa.RecordBatch, bad: np.ndarray, sums: list[np.ndarray], who: np.ndarray, pairs: np.ndarray, times: np.ndarray, digests: list[str]) -> pa.RecordBatch:
    kept = ~bad[who]
    offsets = pa.array(np.searchsorted(who[kept], np.arange(len(part) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept])) for x in (pairs, times)]
    names = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    return pa.RecordBatch.from_arrays([part.column("row_id"), part.column("doc_id"), *[pa.array(np.where(bad, 0, x)) for x in sums], pa.array(digests, pa.string()), *lists], names)


def pair_counts(texts: DataFrame) -> DataFrame:
    """a, b and n: in how many of the texts each pair is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"pair": pc.list_flatten(batch.column("pairs"))})
            yield from table.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]).to_batches()

    found = texts.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.select("pair", F.shiftright("pair", 32).alias("a"), "n")


def head_threshold(counts: DataFrame, head: int) -> int:
    """The least power of two that at most `head` pairs' counts reach."""
    steps = [1 << j for j in range(1, 50)]
    row = counts.agg(*[F.count_if(F.col("n") >= s).alias(str(s)) for s in steps]).first()
    return next(s for s in steps if row[str(s)] <= head)


def alignment(docs: DataFrame, name_a: str = TOKENIZER_A, name_b: str = TOKENIZER_B, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each text."""
    texts = materialize(aligned_texts(docs, name_a, name_b), "align-texts")
    counts = materialize(pair_counts(texts), "align-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = materialize(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-pairs")
    least = head_threshold(counts, head)
    frequent = counts.where(F.col("n") >= least).toArrow().combine_chunks()
    order = np.argsort(frequent.column("pair").to_numpy())
    table = tuple(frequent.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best"))
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists = batch.column("pairs")
            owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            own, times = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            at = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            count_sum, n_best = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(count_sum, owner[known], (n[at] * times)[known] if len(pair) else 0)
            np.add.at(n_best, owner[known], (best[at] * times)[known] if len(pair) else 0)
            rest = pa.array(np.searchsorted(owner[~known], np.arange(len(batch) + 1)).astype(np.int32))
            tails = [pa.ListArray.from_arrays(rest, pa.array(x[~known])) for x in (own, times)]
            columns = ["row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(count_sum), pa.array(n_best), *tails], [*columns, "head_sum", "head_best", "pairs", "times"])

    schema = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, head_sum long, head_best long, pairs array<long>, times array<long>"
    weighed = texts.mapInArrow(weigh, schema)
    tail = (
        weighed.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
        .select("row_id", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
        .join(counts.where(F.col("n") < least), "pair")
        .groupBy("row_id")
        .agg(F.sum(F.col("n") * F.col("times")).alias("tail_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("tail_best"))
    )
    return weighed.join(tail, "row_id", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("head_best") + F.coalesce("tail_best", F.lit(0))).alias("n_best"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )

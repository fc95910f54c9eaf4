"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become token ids (an end id closes each one) and only longer ones are cut, into pieces of the
sequence length. Full pieces are sequences of their own. All others are dealt into shards of bounded
size, and each shard is packed best-fit decreasing: longest piece first, each into the open sequence that
it leaves fullest. A segment tree over the remaining capacities finds that sequence in a
logarithmic number of steps. A shard of 8,000 pieces wastes little: at most about one sequence each.

Tokenising is per document: workers keep the ids of words that they have seen, so a word costs a look-up.
Splitting at ASCII white space first changes no ids, as the tokenizer's own pattern never
joins text across white space (tested against whole texts).

Defined cases: null texts are empty and give the end id alone; repeated rows are packed as documents of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize

SEQUENCE, END_ID, SHARD = 2048, 0, 8_000
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps, and text bytes that it works on at once.
CACHED_WORDS, SLICE_BYTES = 300_000, 6_000_000
PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `limit` bytes of text each; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit)))
        yield batch.slice(at, until - at)
        at = until


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def portions(batch: pa.RecordBatch, limit: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
    """The slices of a batch, each with its texts; a text longer than two limits comes as spans cut at white space, in order."""
    for part in slices(batch, text, limit):
        texts = part.column(text)
        whole = texts[0].as_buffer() if len(part) == 1 and texts[0].is_valid else b""
        if len(whole) <= 2 * limit:
            yield part, [texts]
            continue
        view, spans, at = memoryview(whole), [], 0
        while at < len(view):
            cut = _SPACE.search(view, at + limit)
            until = cut.start() if cut else len(view)
            spans.append(pa.array([view[at:until].tobytes()], pa.binary()).cast(pa.string()))
            at = until
        yield part, spans


#: A word of Latin-1 letters and perhaps punctuation after it: the tokenizer takes each of the two on its own.
PLAIN_WORD = r"^(?P<base>[a-zß-öø-ÿÀ-ÖØ-Þ]+)(?P<tail>[.,!?;:*%$#&|]*)$"
JOINED = 2_000


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that the codes name, end to end, and where each ends."""
    sizes = size[code]
    upto = np.cumsum(sizes)
    where = np.repeat(begin[code] - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)
    return flat[where], upto


class WordIds:
    """Token ids of words. Ids of the first CACHED_WORDS plain words stay; others are made anew for each slice.

    Plain words go to the tokenizer many at once, as one text: each gives exactly one id that ends a word,
    and that tells them apart again.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.slot: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words end to end, and how many each has."""
        ids = [np.array(self.tokenizer.encode(" ".join(words[i : i + JOINED]), add_special_tokens=False).ids, np.uint32) for i in range(0, len(words), JOINED)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != len(words):  # a tokenizer of another kind
            return self._any(words)
        return flat, np.diff(ends, prepend=0)

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for one in ids for i in one), np.uint32, int(sizes.sum())), sizes

    def _bases(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where the ids of each plain word begin in it and how many they are."""
        slots = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        fresh = [words[i] for i in new.tolist()]
        flat, sizes = self._plain(fresh)
        begin = np.cumsum(sizes) - sizes
        if len(new) and len(self.slot) + len(new) <= CACHED_WORDS:
            slots[new] = np.arange(len(self.slot), len(self.slot) + len(new))
            self.slot.update(zip(fresh, slots[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, begin + len(self.flat)])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, flat])
            return self.flat, self.begin[slots], self.size[slots]
        all_begin, all_size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        old = np.flatnonzero(slots >= 0)
        all_begin[old], all_size[old] = self.begin[slots[old]], self.size[slots[old]]
        all_begin[new], all_size[new] = begin + len(self.flat), sizes
        return np.concatenate([self.flat, flat]), all_begin, all_size

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A flat array of ids, and where each word's ids begin in it and how many they are."""
        parts = pc.extract_regex(words, PLAIN_WORD)
        plain = parts.is_valid()
        is_plain = plain.to_numpy(zero_copy_only=False)
        bases, tails = (parts.filter(plain).field(i).dictionary_encode() for i in (0, 1))
        flat, begin, size = self._bases(bases.dictionary.to_pylist())
        rest_flat, rest_size = self._any([*tails.dictionary.to_pylist(), *words.filter(pc.invert(plain)).to_pylist()])
        begin, size = np.concatenate([begin, np.cumsum(rest_size) - rest_size + len(flat)]), np.concatenate([size, rest_size])
        flat = np.concatenate([flat, rest_flat])
        # Two units per plain word, one per other word.
        n_units = np.where(is_plain, 2, 1)
        first = np.cumsum(n_units) - n_units
        code = np.zeros(int(n_units.sum()), np.int64)
        n_bases, n_tails = len(bases.dictionary), len(tails.dictionary)
        code[first[is_plain]] = bases.indices.to_numpy(zero_copy_only=False)
        code[first[is_plain] + 1] = n_bases + tails.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code[first[~is_plain]] = n_bases + n_tails + np.arange(int((~is_plain).sum()))
        ids, upto = gathered(flat, begin, size, code)
        ends = upto[first + n_units - 1]
        return ids, np.concatenate([[0], ends[:-1]]) if len(ends) else ends, np.diff(ends, prepend=0)

    def documents(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents' ids in one array, an end id after each, and the ends of the documents in it."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        flat, begin, size = self.lookup(coded.dictionary)
        n_docs, n_words = len(texts), len(coded)
        # The end id is one more word, after each document's last.
        flat = np.append(flat, np.uint32(end_id))
        begin, size = np.append(begin, len(flat) - 1), np.append(size, 1)
        closing = np.zeros(n_words + n_docs, bool)
        closing[offsets[1:] - offsets[0] + np.arange(n_docs)] = True
        code = np.empty(n_words + n_docs, np.int64)
        code[closing] = len(begin) - 1
        code[~closing] = coded.indices.to_numpy(zero_copy_only=False)
        ids, upto = gathered(flat, begin, size, code)
        return ids, upto[closing]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    """This worker's WordIds of a tokenizer: a file's path, or a name that public_tokenizers knows."""
    if tokenizer not in _WORD_IDS:
        if "/" not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        else:
            path = tokenizer
        _WORD_IDS[tokenizer] = WordIds(str(path))
    return _WORD_IDS[tokenizer]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids, ends = ids_of.documents(part.column("text"), end_id)
                ids = np.ascontiguousarray(ids, "<u4")
                rows: list[tuple[int, int, int, int]] = []
                begin = 0
                for doc, end in enumerate(ends.tolist()):
                    for piece, at in enumerate(range(begin, end, sequence)):
                        upto = min(at + sequence, end)
                        rows.append((doc, piece, at - begin, upto - at, zlib.crc32(ids[at:upto])))
                    begin = end
                doc, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


class OpenSequences:
    """Open sequences by remaining capacity, in a segment tree whose leaves are the capacities."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = bytearray(2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, sequence: int) -> None:
        self.stacks[remaining].append(sequence)
        node = remaining + self.leaves
        while node and not self.filled[node]:
            self.filled[node] = 1
            node //= 2

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out an open sequence with the least capacity of at least length: (capacity, sequence)."""
        node = length + self.leaves
        if not self.filled[node]:
            while node > 1 and (node % 2 or not self.filled[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        sequence = self.stacks[remaining].pop()
        if not self.stacks[remaining]:
            self.filled[node] = 0
            node //= 2
            while node and not (self.filled[2 * node] or self.filled[2 * node + 1]):
                self.filled[node] = 0
                node //= 2
        return remaining, sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to capacity), longest first, ties as they come."""
    held, n = OpenSequences(capacity), 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = held.tightest(length)
        if found is None:
            found, n = (capacity, n), n + 1
        remaining, which = found
        sequence[i], offset[i] = which, capacity - remaining
        if remaining > length:
            held.add(remaining - length, which)
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row per piece, with its sequence_id and its offset there."""
    cut = materialize(
        pieces(docs, tokenizer, sequence, end_id).withColumn("row_id", F.monotonically_increasing_id()), "pack-pieces"
    )
    part = cut.where(F.col("length") < sequence)
    n_shards = max(1, -(-part.count() // SHARD))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id", ignore_index=True)
        which, offset = best_fit_decreasing(rows["length"].to_numpy(), sequence)
        # Odd numbers; full pieces have even ones.
        rows["sequence_id"] = 2 * (which * n_shards + int(rows["shard"].iloc[0])) + 1 if len(rows) else which
        rows["offset"] = offset
        return rows[[*columns, "sequence_id", "offset"]]

    packed = (
        part.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(n_shards)))
        .groupBy("shard")
        .applyInPandas(pack_shard, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )
    full = cut.where(F.col("length") == sequence).select(*columns, (F.col("row_id") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)

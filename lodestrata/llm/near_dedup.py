"""Near-duplicate documents by banded MinHash, odd sketches and an exact check.

1. Signatures. Each text's distinct shingles are hashed to 64 bits. `BANDS` bands of MinHash values give
   one key each. The MinHash samples are folded into an odd sketch: sample i with value v flips bit
   hash(i, v) of a parity bitmap, so what two documents share cancels out, and the population count of the
   XOR of two bitmaps tells how many samples differ, most precisely for very similar pairs.
2. Classes. Documents with equal sets are one class, by a 128-bit digest; only classes go on.
3. Candidates. Classes that share a band key and whose sizes allow the threshold are one group. A group never
   emits all its pairs: each class is held against one pivot of the group; pivots come from a few orders of the classes.
4. Verification. Pairs whose sketches estimate a resemblance clearly below the threshold go; the full
   sets of the others are intersected.
5. Components of the confirmed links, by contraction. In groups that are not one component yet, the classes
   outside the group's largest component are held against its best-linked member. Classes of groups that are
   apart even then meet through their rarest shingles, in cells of two blocks that compare bitmaps: filters that lose no pair that reaches the
   threshold; verified links join in, and components are found again.

Shingles, threshold and sizes are parameters. Nothing of the data passes the driver but counts.

Defined cases: null texts, and texts without words, have no shingles, are linked with nothing and kept.
Fewer words than a shingle has are one shingle, the whole sequence. Equal texts are one class; of repeated
rows all have the same component_id. A null doc_id is never the smallest while its component has others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import materialize, small_side, unused
from lodestrata.llm.packing import slices

#: MinHash samples of the sketch, and bands of so many samples each at most. Each band has its own samples, so that bands miss a pair
#: independently; the sketch takes the first of them. Long bands keep texts apart that only share a passage.
SAMPLES, BANDS, ROWS = 288, 72, 12
#: Bands are so long that a pair at the threshold has none in common with this chance at most.
MISSED = 1 / 25_000
SKETCH_BITS = 512
#: A pair is verified unless its estimate is below the threshold by more than this: five standard errors.
MARGIN = 0.15
#: Texts whose samples are folded into keys and sketches in one step, at most: it bounds memory and changes no result.
SIGNED_AT_ONCE = 64
WORDS, PERCENT = 5, 80
#: Classes of a block: groups that are compared as a whole are cut into these.
BLOCK = 128
#: Digests that a task remembers, so that copies of a text send their shingles once.
REMEMBERED = 200_000
#: Groups choose their pivots by so many orders of all classes, so those that share most members share pivots too.
PIVOT_ORDERS = 4

_RNG = np.random.default_rng(20_140_407)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_SALT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_rows(percent: int) -> int:
    """The longest bands that a pair at the threshold misses seldom enough: 12 samples at 0.85, 9 at 0.8."""
    fit = [r for r in range(1, ROWS + 1) if (1 - (percent / 100) ** r) ** BANDS <= MISSED]
    return max(fit, default=1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashes = pd.util.hash_array(vocabulary, categorize=False) if len(vocabulary) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    filled = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    words = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    odd = mixed(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    base = int(offsets[0])
    for a, b in zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True):
        # Blanks at a text's ends leave empty strings there.
        while a < b and not filled[a]:
            a += 1
        while b > a and not filled[b - 1]:
            b -= 1
        own = words[a:b]
        if not len(own):
            yield own
            continue
        size = min(width, len(own))
        total = np.full(len(own) - size + 1, np.uint64(size))
        for j in range(size):
            total = mixed(total + own[j : len(own) - size + 1 + j] * odd[j])
        yield np.unique(total)


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The first n MinHash samples of a non-empty set: the least of A * x + B over its hashes x."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    # Samples lie side by side in memory, and a block of hashes fits the cache.
    for at in range(0, len(x), 128):
        values = x[at : at + 128] * _A[:n]
        values += _B[:n]
        np.minimum(least, values.min(0), out=least)
    return least


def signed_sets(sets: list[np.ndarray], rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty sets, a row for each."""
    n = max(SAMPLES, BANDS * rows)
    least = np.stack([minima(hashes, n) for hashes in sets])
    samples = mixed(least.astype(np.uint64) + _SALT[:n])
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), 1))
    for r in range(rows):
        keys = mixed(keys * np.uint64(31) + samples[:, r * BANDS : (r + 1) * BANDS])
    bits = (samples[:, :SAMPLES] % np.uint64(SKETCH_BITS)).astype(np.int64) + SKETCH_BITS * np.arange(len(sets))[:, None]
    flips = np.bincount(bits.ravel(), minlength=SKETCH_BITS * len(sets)) & 1
    sketch = np.packbits(flips.astype(np.uint8).reshape(len(sets), SKETCH_BITS), axis=1).view(np.int64)
    return keys.view(np.int64), sketch


def signature(hashes: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of a non-empty set."""
    keys, sketch = signed_sets([hashes], rows)
    return keys[0], sketch[0]


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64)
    return int(d[0]), int(d[1])


def signatures(docs: DataFrame, width: int = WORDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set digest (hi, lo), band keys and sketch; digest and signature null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols: list[list] = [[], [], [], [], []]
                for sets in batched(shingle_sets(part.column("text"), width), SIGNED_AT_ONCE):
                    full = [hashes for hashes in sets if len(hashes)]
                    signed = zip(*signed_sets(full, rows), strict=True) if full else iter(())
                    for hashes in sets:
                        (keys, sketch), (hi, lo) = (next(signed), _digest(hashes)) if len(hashes) else ((None, None), (None, None))
                        for c, v in zip(cols, (len(hashes), hi, lo, keys, sketch), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    ["doc_id", "text_hash", "n_shingles", "hi", "lo", "keys", "sketch"],
                )

    schema = "doc_id long, text_hash long, n_shingles long, hi long, lo long, keys array<long>, sketch array<long>"
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return slim.mapInArrow(sign, schema)


def resemblance(sketch_a: str, sketch_b: str) -> Column:
    """Estimated Jaccard similarity from two odd sketches."""
    differ = F.aggregate(
        F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v
    )
    left = F.greatest(1 - 2 * differ / F.lit(float(SKETCH_BITS)), F.lit(1e-3))
    return 1 + F.log(left) * (SKETCH_BITS / (4.0 * SAMPLES))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """class_no and the shingle hashes of the wanted classes (class_no)."""
    n = wanted.count()
    reps = wanted.join(classes.select("class_no", "min_id", "hi", "lo", "n"), "class_no")
    ids = reps.select("min_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(ids, n), F.col("doc_id").eqNullSafe(F.col("min_id")), "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(*_digest(h), h.view(np.int64)) for h in shingle_sets(part.column("text"), width) if len(h)]
                hi, lo, sets = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["set_hi", "set_lo", "hashes"]
                )

    found = texts.select("text").mapInArrow(hashed, "set_hi long, set_lo long, hashes array<long>")
    return (
        found.join(small_side(reps, n), (F.col("set_hi") == F.col("hi")) & (F.col("set_lo") == F.col("lo")))
        .groupBy("class_no")
        .agg(F.first("hashes").alias("hashes"))
    )


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold. pairs: written, distinct."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class_no")).distinct()
    sets = materialize(_sets(docs, classes, materialize(wanted, "near-wanted"), width), "near-sets")
    both = (
        pairs.join(sets.withColumnsRenamed({"class_no": "b", "hashes": "set_b"}), "b")
        .join(sets.withColumnsRenamed({"class_no": "a", "hashes": "set_a"}), "a")
        .select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("inter"), (F.size("set_a") + F.size("set_b")).alias("total"))
    )
    return materialize(both.where(100 * F.col("inter") >= percent * (F.col("total") - F.col("inter"))).select("a", "b"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in links (a, b).

    Rounds of contraction: each root hooks onto its smallest neighbouring root, chains of hooks are
    shortened to their ends, and links are drawn anew between the ends, until none is left.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "cc-edges")
    roots = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "cc-roots")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        hooks = materialize(hooks, "cc-hooks")
        while True:
            above = hooks.select(F.col("a").alias("mid"), F.col("up").alias("top"))
            jumped = hooks.join(above, hooks.up == above.mid).select("a", "up", "top")
            jumped = materialize(jumped, "cc-hooks")
            moved = not jumped.where("up <> top").isEmpty()
            hooks = jumped.select("a", F.col("top").alias("up"))
            if not moved:
                break
        new = hooks.withColumnRenamed("a", "old")
        roots = materialize(
            roots.join(new, roots.root == new.old, "left").select("node", F.coalesce("up", "root").alias("root")), "cc-roots"
        )
        edges = materialize(
            edges.join(new.select(F.col("old").alias("a"), F.col("up").alias("up_a")), "a")
            .join(new.select(F.col("old").alias("b"), F.col("up").alias("up_b")), "b")
            .where("up_a <> up_b")
            .select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
            .distinct(),
            "cc-edges",
        )
    return roots


def _unfinished(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, class_no, root and main, the group's largest component, of groups of more than two classes that are not one component."""
    known = roots.select(F.col("node").alias("class_no"), "root")
    rooted = members.join(known, "class_no", "left").select("key", "class_no", F.coalesce("root", "class_no").alias("root"))
    rooted = materialize(rooted, "near-rooted")
    shares = rooted.groupBy("key", "root").agg(F.count("*").alias("held"))
    largest = shares.groupBy("key").agg(F.max(F.struct("held", "root")).alias("most"), F.count("*").alias("roots"), F.sum("held").alias("size"))
    largest = materialize(largest.where("roots > 1 and size > 2").select("key", F.col("most.root").alias("main")), "near-largest")
    return rooted.join(largest, "key")


def bitmap(hashes: np.ndarray) -> bytes:
    """Which of 2**k cells (twice the set's size at least) an odd number of its hashes falls in: two sets differ in no more cells than in members."""
    cells = 1 << max(6, int(2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes.view(np.uint64) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of words) of fewer cells."""
    while maps.shape[1] > size:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def set_rows(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n_wanted: int, width: int, maps: bool = False) -> DataFrame:
    """class_no and the shingle hashes (or the bitmap) of the wanted classes (class_no; written), read from the texts; a row that is repeated may come more than once."""
    name, kind, arrow = ("map", "binary", pa.binary()) if maps else ("hashes", "array<long>", pa.list_(pa.int64()))
    reps = classes.join(wanted, "class_no", "left_semi")
    ids = reps.select("min_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small_side(ids, n_wanted), F.col("doc_id").eqNullSafe(F.col("min_id")), "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in slices(batch):
                rows = []
                for h in shingle_sets(part.column("text"), width):
                    digest = _digest(h) if len(h) else None
                    if digest and digest not in seen:
                        rows.append((*digest, bitmap(h) if maps else h.view(np.int64)))
                        if len(seen) < REMEMBERED:
                            seen.add(digest)
                hi, lo, sets = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sets, arrow)], ["hi", "lo", name])

    found = texts.select("text").mapInArrow(hashed, f"hi long, lo long, {name} {kind}")
    return found.join(small_side(reps.select("hi", "lo", "class_no"), n_wanted), ["hi", "lo"]).select("class_no", name)


def across(apart: DataFrame, maps: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of classes of different roots that share a key and may reach the threshold, each once; no pair that reaches it is missing.

    apart: key, class_no, root, n and i (the key's place in the class's order of shingles, from 0). maps: class_no, map.
    Groups are cut into blocks, the largest component's apart from the others', and two blocks make a cell, a task's work.
    """
    # Groups of the same members are one group; the earliest place of each member counts.
    each = (F.xxhash64("class_no"), F.xxhash64(F.lit(1), "class_no"))
    same = apart.groupBy("key").agg(F.struct(F.count("*"), F.bit_xor(each[0]), F.bit_xor(each[1]), F.sum(F.shiftright(each[1], 24))).alias("members"))
    one = materialize(same.select("key", F.xxhash64("members").alias("g"), F.xxhash64(F.lit(1), "members").alias("h")), "near-same")
    apart = apart.join(one, "key").groupBy("g", "h", "class_no").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.min("i").alias("i"))
    apart = materialize(apart.select(F.struct("g", "h").alias("key"), "class_no", "root", "n", "i"), "near-groups")
    shares = apart.groupBy("key", "root").agg(F.count("*").alias("held"))
    largest = shares.groupBy("key").agg(F.max(F.struct("held", "root")).alias("most"), F.sum("held").alias("size"), F.count("*").alias("roots")).where("roots > 1")
    mains, others = F.ceil(F.col("most.held") / block), F.ceil((F.col("size") - F.col("most.held")) / block)
    largest = materialize(largest.select("key", F.col("most.root").alias("main"), mains.cast("long").alias("mains"), others.cast("long").alias("others")), "near-open")
    placed = apart.join(largest, "key").withColumn("is_main", F.col("root") == F.col("main"))
    number = F.pmod(F.xxhash64("class_no"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others")))
    placed = placed.withColumn("own", F.when(F.col("is_main"), -1 - number).otherwise(number))
    # Blocks of the largest component (below 0) meet those of the others; these meet each other.
    against = F.sequence(F.when(F.col("is_main"), F.lit(0)).otherwise(-F.col("mains")).cast("long"), F.col("others") - 1)
    dealt = placed.select("key", "class_no", "root", F.col("n").cast("long").alias("n"), F.col("i").cast("long").alias("i"), "own", F.explode(against).alias("with"))
    cells = dealt.select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "own", "class_no", "root", "n", "i")

    def compare(cell: pa.Table) -> pa.Table:
        own, low, high = (cell.column(c).to_numpy() for c in ("own", "low", "high"))
        number, root, n, i = (cell.column(c).to_numpy() for c in ("class_no", "root", "n", "i"))
        held = [np.frombuffer(m, np.uint64) for m in cell.column("map").to_pylist()]
        first, second = np.flatnonzero(own == low[0]), np.flatnonzero(own == high[0])
        size = np.array([len(m) for m in held])
        out_a, out_b = [], []
        levels = {w: np.flatnonzero(size[first] >= w) for w in np.unique(size).tolist()}
        tables = {w: np.concatenate([_folded(held[first[j]][None], w) for j in at.tolist()]) for w, at in levels.items() if len(at)}
        for k in second.tolist():
            need = -(-percent * (n[first] + n[k]) // (100 + percent))
            wanted = (root[first] != root[k]) & (np.minimum(n[first] - i[first], n[k] - i[k]) >= need) & (n[first] >= need) & (n[k] >= need)
            if low[0] == high[0]:
                wanted &= number[first] < number[k]
            for w in np.unique(np.minimum(size[first[wanted]], size[k])).tolist():
                at = levels[w]
                here = wanted[at] & (np.minimum(size[first[at]], size[k]) == w)
                differ = np.bitwise_count(tables[w][here] ^ _folded(held[k][None], w)).sum(1)
                near = at[here][differ <= (n[first] + n[k] - 2 * need)[at[here]]]
                out_a.extend([int(number[k])] * len(near))
                out_b.extend(number[first[near]].tolist())
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return cells.join(materialize(maps, "near-maps"), "class_no").groupBy("key", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def may_reach(pairs: DataFrame, maps: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow the threshold: none that reaches it is lost. maps: class_no, map. sizes: class_no, n."""
    held = maps.join(sizes, "class_no").groupBy("class_no").agg(F.first("map").alias("map"), F.first("n").alias("n"))
    held = materialize(held, "near-maps")
    a, b = (held.select(*[F.col(c).alias(f"{c}_{k}") for c in ("class_no", "map", "n")]) for k in "ab")
    both = pairs.join(b, F.col("b") == F.col("class_no_b")).join(a, F.col("a") == F.col("class_no_a")).select("a", "b", "n_a", "n_b", "map_a", "map_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            spare = n + m - 2 * (-(-percent * (n + m) // (100 + percent)))
            near = np.zeros(len(batch), bool)
            for k, (x, y) in enumerate(zip(batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist(), strict=True)):
                one, other = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                words = min(one.shape[1], other.shape[1])
                near[k] = np.bitwise_count(_folded(one, words) ^ _folded(other, words)).sum() <= spare[k]
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(compare, "a long, b long")


def _by_rarity(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, class_no, root, n and i: the shingles of each class, in order of rarity, by which it can meet the others.

    Two sets of m and n shingles that reach the threshold share `need` at least, so the first one that they share, in any
    order common to all, is among the m - need + 1 first of one and the n - need + 1 first of the other. Rare
    shingles come first: what the many versions of one text have in common doesn't bring them together.
    """
    tokens = sets.select("class_no", F.explode("hashes").alias("t"))
    held = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ordered = tokens.join(held, "t").groupBy("class_no").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
    n = F.size("ts")
    # A partner has percent of the size at least, and so has what both share.
    reach = n - F.ceil(F.lit(percent) * n / 100).cast("int") + 1
    firsts = ordered.select("class_no", n.alias("n"), F.posexplode(F.transform(F.slice("ts", F.lit(1), reach), lambda x: x["t"])).alias("i", "key"))
    return materialize(firsts.join(apart, "class_no"), "near-firsts")


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    signed = materialize(signatures(docs, width, band_rows(percent)), "near-signatures")
    classes = materialize(
        signed.where("hi is not null")
        .groupBy("hi", "lo")
        .agg(
            F.min("doc_id").alias("min_id"),
            F.first("n_shingles").alias("n"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("class_no", F.monotonically_increasing_id()),
        "near-classes",
    )
    # Sizes in steps a little wider than the threshold: a pair that can reach it shares a step or has neighbouring ones.
    step = F.floor(F.log("n") / F.lit(-1.001 * float(np.log(percent / 100.0))))
    bands = classes.select("class_no", F.explode("keys").alias("band"), step.alias("step"))
    shared = materialize(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band"), "near-bands")
    banded = materialize(
        bands.join(shared, "band").select("class_no", F.explode(F.array(F.xxhash64("band", "step"), F.xxhash64("band", F.col("step") + 1))).alias("key")),
        "near-banded",
    )
    order = F.struct(F.xxhash64(F.pmod("key", F.lit(PIVOT_ORDERS)), "class_no").alias("by"), F.col("class_no"))
    groups = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(order).alias("pivot")).where("size > 1")
    groups = materialize(groups.select("key", F.col("pivot.class_no").alias("pivot")), "near-groups")
    members = materialize(banded.join(groups, "key").select("key", "class_no", "pivot"), "near-members")
    traits = classes.select("class_no", "n", "sketch")

    def promising(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that sizes and sketches allow."""
        a, b = (traits.select(F.col("class_no").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        close = resemblance("sketch_a", "sketch_b") >= percent / 100.0 - MARGIN
        return materialize(pairs.join(b, "b").join(a, "a").where(sizes & close).select("a", "b"), "near-pairs")

    first = members.where("class_no <> pivot").select(F.least("class_no", "pivot").alias("a"), F.greatest("class_no", "pivot").alias("b")).distinct()
    links = _verified(docs, classes, promising(first), width, percent)
    roots = components(links)

    # Groups that are not one component yet: their classes outside the largest component meet its best-linked member.
    first = materialize(first, "near-first")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_no")).groupBy("class_no").agg(F.count("*").alias("degree"))
    still = materialize(_unfinished(members, roots).join(degree, "class_no", "left"), "near-open")
    hub = still.where("root = main and degree is not null").groupBy("key").agg(F.max(F.struct("degree", "class_no")).alias("best"))
    second = (
        still.where("root <> main")
        .join(hub, "key")
        .select(F.least("class_no", "best.class_no").alias("a"), F.greatest("class_no", "best.class_no").alias("b"))
        .distinct()
    )
    left = promising(second.join(first, ["a", "b"], "left_anti"))
    if not left.isEmpty():
        links = materialize(links.unionByName(_verified(docs, classes, left, width, percent)), "near-links")
        roots = components(links)

    # Classes of the groups that are apart even then, by the shingles that are rare among them.
    apart = materialize(_unfinished(members, roots).select("class_no", "root").distinct(), "near-apart")
    if not apart.isEmpty():
        sets = materialize(_sets(docs, classes, apart.select("class_no"), width), "near-sets")
        wanted = materialize(apart.select("class_no").distinct(), "near-wanted")
        maps = set_rows(docs, classes, wanted, wanted.count(), width, maps=True)
        met = across(_by_rarity(apart, sets, percent), maps, percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        left = promising(met.join(first, ["a", "b"], "left_anti"))
        more = _verified(docs, classes, left, width, percent)
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    joined = classes.join(roots.withColumnRenamed("node", "class_no"), "class_no", "left").select(
        "hi", "lo", "min_id", F.coalesce("root", "class_no").alias("root")
    )
    joined = materialize(joined, "near-joined")
    smallest = materialize(joined.groupBy("root").agg(F.min("min_id").alias("component_id")), "near-smallest")
    by_set = materialize(joined.join(smallest, "root").select("hi", "lo", "component_id"), "near-by-set")
    bare = signed.where("hi is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        signed.where("hi is not null")
        .select("doc_id", "text_hash", "n_shingles", "hi", "lo")
        .join(by_set, ["hi", "lo"])
        .select("doc_id", "text_hash", "n_shingles", "component_id")
        .unionByName(bare)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns, whatever they are called."""
    hashed, wanted, wanted_hash = unused(docs, "own_hash", "kept_id", "kept_hash")
    kept = near_duplicates(docs, width, percent).where("kept").select(F.col("doc_id").alias(wanted), F.col("text_hash").alias(wanted_hash)).distinct()
    own = docs.withColumn(hashed, F.xxhash64("text"))
    match = own["doc_id"].cast("long").eqNullSafe(F.col(wanted)) & (F.col(hashed) == F.col(wanted_hash))
    n = kept.count()
    # Repeated rows of the kept document are copies of it.
    return own.join(small_side(kept, n), match, "left_semi").dropDuplicates(["doc_id", hashed]).drop(hashed)

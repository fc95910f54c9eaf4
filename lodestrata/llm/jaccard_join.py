"""Texts whose n-gram sets reach a Jaccard similarity, joined through prefix trees; exact.

1. Order. All shingles have one global order, rare ones first, by counts in a table of `BUCKETS` hashed cells (its size is
   fixed; shingles of one cell go by their hash). Any order gives the same links; this one makes the groups small.
2. Classes. Texts with equal sets are one class, by a 128-bit digest; only classes go on.
3. First shingles. Two sets of n and m shingles that reach the threshold share `need` at least, so the first shingle that they
   share is among the n - need + 1 first of one, and likewise of the other. Classes meet in groups by these.
4. Stars. Each class of a group is held against the group's pivot: first bitmaps, in which two sets differ in no more bits than they
   differ in shingles, so no pair that reaches the threshold is dropped; then full sets. A trie holds the candidates of a pivot, the frequent
   shingles at its top, so that versions of a text share paths; the traversal adds up a path's overlap once for all sets below, and leaves
   a subtree as soon as what remains of its sets, or of the pivot's, can't reach the threshold.
5. Components of the links. In groups that are not one component yet, classes outside the largest one meet its best-linked member.
6. The rest, exactly. Groups that are apart even then are cut into blocks; each pair of blocks whose classes are of different
   components is a cell (near_dedup.across). A cell compares bitmaps; pairs that may reach the threshold are traversed as in 4. A cell has two blocks at most, so no
   group, however large, makes a large task, and pairs of one component are never looked at.

Sets that are sent are read from the texts anew. Nothing of the data passes the driver but counts.

Defined cases: null texts, and texts without words, have no shingles and are linked with nothing. Fewer words than a
shingle has are one shingle, the whole sequence. Equal texts are one class; repeated rows have the same component_id. A
null doc_id is never the smallest while its component has others. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestrata.llm.common import materialize, small_side
from lodestrata.llm.near_dedup import BLOCK, REMEMBERED, _digest, _unfinished, across, components, may_reach, mixed, set_rows, shingle_sets
from lodestrata.llm.packing import slices

WORDS, PERCENT = 5, 80
#: Cells of the table of counts, and cells that are added up together.
BUCKETS, CHUNK = 1 << 20, 1 << 16
#: Tasks whose tables are added up together.
ADDED = 64
#: Shingles that the sets of a task's group have, about.
GROUP_SHINGLES = 1_000_000
#: Groups choose their pivots by so many orders of all classes, so those that share most members share pivots too.
PIVOT_ORDERS = 4


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes.view(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n and digest (hi, lo) of each text, and in other rows a task's counts of the table's cells (chunk, counts, task)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        names, task = ["doc_id", "n", "hi", "lo", "chunk", "counts", "task"], TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                n, hi, lo, cells = [], [], [], []
                for hashes in shingle_sets(part.column("text"), width):
                    cells.append(bucket(hashes))
                    digest = _digest(hashes) if len(hashes) else (None, None)
                    n.append(len(hashes))
                    hi.append(digest[0])
                    lo.append(digest[1])
                np.add.at(table, np.concatenate([np.zeros(0, np.int64), *cells]), 1)
                size = len(part)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64())], names)
        for chunk in range(BUCKETS // CHUNK):
            counts = table[chunk * CHUNK : (chunk + 1) * CHUNK]
            if counts.any():
                nothing = [pa.nulls(1, pa.int64())] * 4
                packed = zlib.compress(counts.astype("<u4").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([chunk], pa.int32()), pa.array([packed], pa.binary()), pa.array([task], pa.int64())], names)

    schema = "doc_id long, n long, hi long, lo long, chunk int, counts binary, task long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, schema)


def rarity(parts: DataFrame) -> np.ndarray:
    """How many texts have a shingle in each cell (at most 2**32 - 1): the whole table, whose size is fixed."""

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64) for c in table.column("counts").to_pylist())
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "task": pa.array([table.column("task")[0].as_py() // ADDED], pa.int64()), "counts": pa.array([packed])})

    rows = parts.where("chunk is not null").select("chunk", "task", "counts")
    n = (rows.agg(F.max("task")).first()[0] or 0) + 1
    while n > 1:  # tables of so many tasks at a time, however many there are
        rows = rows.groupBy("chunk", F.expr(f"task div {ADDED}")).applyInArrow(added, "chunk int, task long, counts binary")
        n = -(-n // ADDED)
    table = np.zeros(BUCKETS, np.uint32)
    for r in rows.collect():
        table[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(r.counts), "<u4")
    return table


def reach(n: int, percent: int) -> int:
    """How many of the first of n shingles may be the first that a linked set shares: a partner has percent of n in common at least."""
    return n - -(-percent * n // 100) + 1


def first_shingles(docs: DataFrame, width: int, percent: int, table: np.ndarray) -> DataFrame:
    """t, hi, lo, n and i: the i-th shingle, in the global order, of the set with that digest, for its first ones."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = sent.value, set()
        for batch in batches:
            for part in slices(batch):
                sets = []
                for hashes in shingle_sets(part.column("text"), width):
                    if not len(hashes):
                        continue
                    digest = _digest(hashes)
                    if digest in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(digest)
                    k = reach(len(hashes), percent)
                    order = np.argsort(held[bucket(hashes)], kind="stable")[:k]  # hashes are sorted: ties go by hash
                    sets.append((hashes[order], digest, len(hashes)))
                size = np.array([len(s) for s, _, _ in sets], np.int64)
                t = np.concatenate([np.zeros(0, np.uint64), *[s for s, _, _ in sets]]).view(np.int64)
                wide = [np.repeat(np.array(v, np.int64), size) for v in ([d[0] for _, d, _ in sets], [d[1] for _, d, _ in sets], [n for _, _, n in sets])]
                i = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t, *wide, i)], ["t", "hi", "lo", "n", "i"])

    return docs.select("text").mapInArrow(firsts, "t long, hi long, lo long, n long, i long")


class Trie:
    """Sets as sequences of ranks in one order, sorted, with the length of the path that each shares with the one before: a trie laid flat."""

    def __init__(self, sets: list[np.ndarray]):
        # Big-endian bytes sort as the sequences do.
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.shared = [0]
        for before, now in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(before), len(now))
            differ = np.flatnonzero(before[:n] != now[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def reaching(self, probe: np.ndarray, n_ranks: int, percent: int, wanted: np.ndarray | None = None) -> list[int]:
        """Numbers of the sets (of those wanted) whose similarity with the probe, sorted ranks, reaches percent."""
        m = len(probe)
        hit = np.zeros(n_ranks, bool)
        hit[probe] = True
        passed = np.cumsum(hit)  # shingles of the probe up to each rank
        largest = min(max((len(s) for s in self.sets), default=0), 100 * m // percent)
        least = -(-percent * m // 100)
        # What a subtree may lack at most: of its own shingles, and of the probe's.
        own_spare, probe_spare = largest - _need(largest, m, percent), m - _need(least, m, percent)
        overlap = np.zeros(max((len(s) for s in self.sets), default=0) + 1, np.int64)
        found, same, cut = [], 0, None
        for k, ranks in enumerate(self.sets):
            same = min(same, self.shared[k]) if k else 0
            n = len(ranks)
            if cut is not None and same > cut:
                continue  # below a node that was left
            if (wanted is not None and not wanted[self.order[k]]) or 100 * min(n, m) < percent * max(n, m):
                continue
            cut = None
            rest = ranks[same:]
            overlap[same + 1 : n + 1] = overlap[same] + np.cumsum(hit[rest])
            common = overlap[same + 1 : n + 1]
            short = (np.arange(same + 1, n + 1) - common > own_spare) | (passed[rest] - common > probe_spare)
            at = int(short.argmax()) if len(short) else 0
            if len(short) and short[at]:
                cut, same = same + at, same + at + 1
                continue
            same = n
            total = int(overlap[n])
            if 100 * total >= percent * (n + m - total):
                found.append(self.order[k])
        return found


def _need(n: int, m: int, percent: int) -> int:
    """What sets of n and m share at least, if they reach percent."""
    return -(-percent * (n + m) // (100 + percent))


def ranked(sets: list[np.ndarray], table: np.ndarray | None) -> tuple[list[np.ndarray], int]:
    """Each set as sorted ranks of its shingles, frequent ones first, and the number of ranks."""
    known, place = np.unique(np.concatenate(sets), return_inverse=True)
    if table is not None:
        rank = np.empty(len(known), np.int64)
        rank[np.argsort(-table[bucket(known)].astype(np.int64), kind="stable")] = np.arange(len(known))
        place = rank[place]
    at = np.cumsum([len(s) for s in sets])[:-1]
    return [np.sort(x) for x in np.split(place, at)], len(known)


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int, table: np.ndarray) -> DataFrame:
    """Those of the pairs (a, b; written, distinct) whose full sets reach the threshold. A group of tries, each of the candidates b of one a, is a task's work."""
    sized = pairs.join(classes.select(F.col("class_no").alias("b"), "n"), "b")
    loads = sized.groupBy("a").agg(F.sum("n").alias("load")).withColumn("parts", F.ceil(F.col("load") / GROUP_SHINGLES).cast("long"))
    loads = materialize(loads, "join-loads")
    n_groups = 1 + (loads.agg(F.sum("load")).first()[0] or 0) // GROUP_SHINGLES
    dealt = pairs.join(loads, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("a", "part"), F.lit(n_groups)).alias("g"))
    probes = dealt.select("g", "a", F.col("a").alias("class_no"), F.lit(True).alias("probe")).distinct()
    roles = materialize(dealt.select("g", "a", F.col("b").alias("class_no"), F.lit(False).alias("probe")).unionByName(probes), "join-roles")
    n_roles, wanted = roles.count(), materialize(roles.select("class_no").distinct(), "join-wanted")
    rows = set_rows(docs, classes, wanted, wanted.count(), width).join(small_side(roles, n_roles), "class_no")
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def walk(group: pa.Table) -> pa.Table:
        a, b, probe = (group.column(c).to_numpy() for c in ("a", "class_no", "probe"))
        hashes = group.column("hashes").combine_chunks()
        out_a, out_b = [], []
        order = np.argsort(a, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            ranks, n_ranks = ranked([np.asarray(hashes[int(k)].values).view(np.uint64) for k in some], sent.value)
            first, others = int(np.flatnonzero(probe[some])[0]), np.flatnonzero(~probe[some])
            for k in Trie([ranks[k] for k in others]).reaching(ranks[first], n_ranks, percent):
                out_a.append(int(a[some[0]]))
                out_b.append(int(b[some[others[k]]]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return materialize(rows.select("g", "a", "class_no", "probe", "hashes").groupBy("g").applyInArrow(walk, "a long, b long").distinct(), "join-links")


def _close(n: str, i: str, m: str, j: str, percent: int) -> Column:
    """Whether sets of n and m shingles, whose first common ones are the i-th and the j-th, may reach percent."""
    return F.expr(f"least({n} - {i}, {m} - {j}) >= ({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}")


def join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    parts = materialize(signed(docs, width), "join-signed")
    own = parts.where("chunk is null").select("doc_id", "n", "hi", "lo")
    table = rarity(parts)
    classes = own.where("hi is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("min_id"), F.first("n").alias("n"))
    # Half of the digest numbers the classes, unless two share it.
    apart_by_half = classes.select("hi").groupBy("hi").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    classes = materialize(classes.withColumn("class_no", F.col("hi") if apart_by_half else F.monotonically_increasing_id()), "join-classes")

    firsts = materialize(first_shingles(docs, width, percent, table), "join-firsts")
    numbered = firsts.withColumn("class_no", F.col("hi")) if apart_by_half else firsts.join(classes.select("hi", "lo", "class_no"), ["hi", "lo"])
    # One shuffle, by shingle: copies out, groups of one out, and the pivot of each group.
    # One shuffle, by shingle: copies and groups of one go out. Then sizes, in steps a little wider than the threshold: a pair that can reach it shares a
    # step or has neighbouring ones, and groups of a shingle and a step lie where the shingle's rows are. Place and size travel in one number.
    both = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("i")).alias("both")
    met = numbered.select("t", "class_no", both).repartition("t").groupBy("t", "class_no").agg(F.min("both").alias("both"))
    met = met.select("*", F.count("*").over(W.partitionBy("t")).alias("size")).where("size > 1").drop("size")
    met = met.select("t", "class_no", F.shiftright("both", 32).cast("int").alias("n"), F.col("both").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("i"))
    step = F.floor(F.log("n") / F.lit(-1.001 * math.log(percent / 100))).cast("int")
    met = met.select("*", F.explode(F.array(step, step + 1)).alias("step"))
    group = W.partitionBy("t", "step")
    met = met.select("*", F.count("*").over(group).alias("size"), F.min("n").over(group).alias("least")).where("size > 1")
    # With a partner of the group's least size, or of the least that can reach the threshold, the first common shingle comes no later than this.
    met = met.where(_close("n", "i", f"greatest(least, ({percent} * n + 99) div 100)", "0", percent)).drop("size")
    order = F.struct(F.xxhash64(F.pmod("t", F.lit(PIVOT_ORDERS)), "class_no").alias("by"), F.col("class_no"), F.col("n"), F.col("i"))
    met = met.select("*", F.count("*").over(group).alias("size"), F.min(order).over(group).alias("p")).where("size > 1")
    members = met.select(F.xxhash64("t", "step").alias("key"), "class_no", "n", "i", F.col("p.class_no").alias("pivot"), F.col("p.n").alias("m"), F.col("p.i").alias("j"))
    members = materialize(members, "join-members")
    first = members.where("class_no <> pivot").where(_close("n", "i", "m", "j", percent))
    first = materialize(first.select(F.col("pivot").alias("a"), F.col("class_no").alias("b")).distinct(), "join-first")
    wanted = materialize(first.select(F.explode(F.array("a", "b")).alias("class_no")).distinct(), "join-wanted")
    maps = set_rows(docs, classes, wanted, wanted.count(), width, maps=True)
    likely = materialize(may_reach(first, maps, classes.select("class_no", "n"), percent), "join-likely")
    links = verified(docs, classes, likely, width, percent, table)
    roots = components(links)

    # Groups that are not one component yet: their classes outside the largest component meet its best-linked member.
    keyed = members.select("key", "class_no")
    degree = links.select(F.explode(F.array("a", "b")).alias("class_no")).groupBy("class_no").agg(F.count("*").alias("degree"))
    still = materialize(_unfinished(keyed, roots).join(degree, "class_no", "left"), "join-open")
    hub = still.where("root = main and degree is not null").groupBy("key").agg(F.max(F.struct("degree", "class_no")).alias("best"))
    second = still.where("root <> main").join(hub, "key").select(F.col("best.class_no").alias("a"), F.col("class_no").alias("b")).distinct()
    size = classes.select("class_no", "n")
    second = second.join(size.withColumnsRenamed({"class_no": "a", "n": "n_a"}), "a").join(size.withColumnsRenamed({"class_no": "b", "n": "n_b"}), "b")
    second = second.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").join(first, ["a", "b"], "left_anti")
    second = materialize(second, "join-second")
    if not second.isEmpty():
        links = materialize(links.unionByName(verified(docs, classes, second, width, percent, table)), "join-links")
        roots = components(links)

    # Groups that are apart even then, in cells of two blocks.
    apart = _unfinished(keyed, roots).select("key", "class_no", "root").join(members.select("key", "class_no", "n", "i"), ["key", "class_no"])
    apart = materialize(apart, "join-apart")
    if not apart.isEmpty():
        wanted = materialize(apart.select("class_no").distinct(), "join-wanted")
        maps = set_rows(docs, classes, wanted, wanted.count(), width, maps=True)
        left = across(apart, maps, percent, block).join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti")
        more = verified(docs, classes, materialize(left, "join-third"), width, percent, table)
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    joined = classes.join(roots.withColumnRenamed("node", "class_no"), "class_no", "left")
    joined = materialize(joined.select("hi", "lo", "min_id", F.coalesce("root", "class_no").alias("root")), "join-joined")
    smallest = materialize(joined.groupBy("root").agg(F.min("min_id").alias("component_id")), "join-smallest")
    by_set = materialize(joined.join(smallest, "root").select("hi", "lo", "component_id"), "join-by-set")
    bare = own.where("hi is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return own.where("hi is not null").join(by_set, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(bare)

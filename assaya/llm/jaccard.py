"""N-gram Jaccard self-join of documents, with links as connected components.

1. A document's set is its distinct word shingles, as 64-bit hashes. Documents with equal sets
   form a class; only the class's smallest doc_id goes on.
2. Two sets whose Jaccard similarity is at least t share k of their first n - ceil(t n) + k
   shingles in any common order (or all that a link needs, if fewer). The order is by rarity, from a
   table of ``SLOTS`` counters over all shingles, so that few documents lead with frequent ones.
   Documents meet at these shingles, and each is paired with the first and with the previous document there: never all pairs of a
   group. Shingles that many sets lead with are left out where fewer than k - 1 of a document's are
   such, since a link then shows at others. A pair has to meet at ``MEET`` shingles; sets that are
   too small for that link with equal ones only. Sizes that can't link are left out.
3. Shingles are hashed into groups. The group counts of a block's documents are points of an
   R-tree; summing the minima of a query's coordinates and those of a node's upper corner bounds
   the overlap with everything below the node, so that nodes and points out of reach are skipped.
4. What is left is verified on the whole sets. The best pair of each document comes first; then
   the pairs whose ends are not in one component yet.
5. No link may be lost to step 2's choice of partners. Where documents of different components
   still meet, all their pairs are tried: at shingles with up to ``HOT`` documents directly; for
   documents that lead with many hot shingles at their first n - ceil(t n) + 1 shingles, through an R-tree where more than ``HOT`` meet. Pairs within a component, such as a large group of copies, are
   never made.

An R-tree alone would have to compare nearly all pairs here, because the counts of unrelated texts
of one length and language are close in every coordinate; so step 2 finds the candidates and the
tree prunes within the blocks.

Defined results: a null text, or one without words, has an empty set and links with nothing; with
fewer words than the shingle width the whole sequence is the one shingle; a null doc_id links with
nothing and has no component; rows that repeat a doc_id count as one document with all their
links; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import remove, shuffled, table, written
from .components import components
from .shingles import mix, shingle_set, word_sequences

#: Groups that shingles are hashed into: the dimensions of a point.
GROUPS = 64
#: A shingle that leads in more sets than HOT is hot. SPARE is the number of shared leading shingles that
#: a link guarantees (or all of its overlap, if that is smaller); MEET is how many of them a pair has to show.
HOT, SPARE, MEET = 50, 16, 2
#: Members of a block, and points of an R-tree leaf.
BLOCK, LEAF = 256, 16
#: Most ids sent to every executor to pick out their texts; beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000
#: A class of over CROWD documents is dealt out over SALTS rows of the joins by class; so at most one row in CROWD names such a class.
SALTS, CROWD = 32, 1000
#: Counters of shingle rarity (8 MB in all, whatever the input) and how many of them travel in a row.
SLOTS, CHUNK = 1 << 20, 1 << 12


def count_vector(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=GROUPS)


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bit for each of twice as many slots as shingles, or more (a power of two): whether an odd number of them falls there."""
    size = 1 << max(9, (2 * len(shingles)).bit_length())
    slots = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((slots & 1).astype(bool), bitorder="little").tobytes()


def apart_bits(query: np.ndarray, others: np.ndarray) -> np.ndarray:
    """In how many bits each row of ``others`` differs from ``query`` (words of 64 bits); the longer side is folded. Sets differ in as many members at least."""
    while len(query) > others.shape[1]:
        query = query[: len(query) // 2] ^ query[len(query) // 2 :]
    while others.shape[1] > len(query):
        half = others.shape[1] // 2
        others = others[:, :half] ^ others[:, half:]
    return np.bitwise_count(query ^ others).sum(1, dtype=np.int64)


class CountTree:
    """An R-tree over count vectors, packed bottom-up from points sorted by size."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.argsort(points.sum(1), kind="stable")
        self.levels = [points[self.order]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), LEAF), axis=0))

    def search(self, point: np.ndarray, need) -> np.ndarray:
        """Indices of the points whose bound reaches ``need`` of their size; a node has to reach the need of its smallest point."""
        at = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            bound = np.minimum(self.levels[level][at], point).sum(1)
            smallest = self.levels[0][at * LEAF**level].sum(1)  # sorted by size
            at = at[bound >= need(smallest)]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < len(self.levels[level - 1])]
        found = self.levels[0][at]
        return self.order[at[np.minimum(found, point).sum(1) >= need(found.sum(1))]]


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a & b| >= num * |a | b| for sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    k = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[k] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _rarity(keys: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """What the shingles are ordered by: the load of each one's slot, then its own hash."""
    return (np.minimum(loads[keys % np.uint64(SLOTS)], (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | keys >> np.uint64(24)


def _described(width: int, num: int, den: int, loads):
    """doc_id, n_shingles, signature and leading shingles of each text, the rarest of the table first. loads: a broadcast of ``table_loads``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, n, sums, xors, keys = zip(*rows, strict=True)
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys).view(np.int64))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "n_shingles", "s1", "s2", "keys"])

        size = 0
        for i, words in word_sequences(batches):
            s = shingle_set(words, width)
            n = len(s)
            lead = n - -(-num * n // den) + SPARE
            keys = s[np.argpartition(_rarity(s, loads.value), lead)[:lead]] if lead < n else s
            sums = mix(s + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)
            xors = np.bitwise_xor.reduce(mix(s + np.uint64(2)), initial=np.uint64(0)).astype(np.int64)
            rows.append((i, n, int(sums), int(xors), keys))
            size += len(keys)
            if len(rows) >= 5000 or size > 500_000:
                yield batch()
                size = 0
        if rows:
            yield batch()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([count_vector(x[1]).astype(np.uint32).tobytes() for x in held], pa.binary()), pa.array([parity_bits(x[1]) for x in held], pa.binary()), pa.array([x[1].tobytes() for x in held], pa.binary())], names=["doc_id", "counts", "bits", "members"])
            held.clear()
            return out

        for i, words in word_sequences(batches):
            held.append((i, shingle_set(words, width)))
            size += len(held[-1][1])
            if size > 500_000:
                yield batch()
                size = 0
        if held:
            yield batch()

    return run


def _in_blocks(links):
    """Rows sorted by block: the block's document first (a null), then its partners. Yields the pairs that ``links`` keeps of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, members = None, None, []

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([y[0] for y in out], pa.int64()), pa.array([y[1] for y in out], pa.int64())], names=["a", "b"])

        def close() -> list[tuple[int, int]]:
            return [(members[k][0], key[0]) for k in links(query, [m for _, m in members])] if members and query is not None else []

        for x in batches:
            out: list[tuple[int, int]] = []
            for b, salt, a, value in zip(*(x.column(k).to_pylist() for k in range(3)), x.column(3), strict=True):
                value = value.as_py()
                if (b, salt) != key or len(members) >= BLOCK:
                    out += close()
                    members = []
                    if (b, salt) != key:
                        key, query = (b, salt), None
                if a is None:
                    query = value
                else:
                    members.append((a, value))
            yield batch(out)
        yield batch(close())

    return run


def _near(num: int, den: int):
    """Which count vectors reach the overlap with the query's that a link would need."""

    def links(query: bytes, members: list[bytes]) -> list[int]:
        point = np.frombuffer(query, np.uint32).astype(np.int64)
        tree = CountTree(np.stack([np.frombuffer(m, np.uint32) for m in members]).astype(np.int64))
        n = int(point.sum())
        # The overlap is at most the smaller size; a pair links only with num / (num + den) of both sizes.
        return tree.search(point, lambda size: num * (n + size) / (num + den) - 1e-6).tolist()

    return links


def _linked(num: int, den: int):
    def links(query: bytes, members: list[bytes]) -> list[int]:
        mine = np.frombuffer(query, np.uint64)
        return [k for k, m in enumerate(members) if similar(mine, np.frombuffer(m, np.uint64), num, den)]

    return links


def _blocked(pairs: DataFrame, values: DataFrame, links) -> DataFrame:
    """The pairs (a, b) that ``links`` keeps. A hot b is dealt out over as many salts as it has blocks of partners."""
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("shares"))
    queries = shares.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("b", "salt")
    queries = queries.join(shuffled(values.select(F.col("doc_id").alias("b"), "value")), "b").select("b", "salt", F.lit(None).cast("long").alias("a"), "value")
    dealt = pairs.join(shares.where("shares > 1"), "b", "left").select("a", "b", F.when(F.col("shares").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("shares"))).cast("int").alias("salt"))
    members = dealt.join(shuffled(values.select(F.col("doc_id").alias("a"), "value")), "a").select("b", "salt", "a", "value")
    rows = queries.unionByName(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return rows.mapInArrow(_in_blocks(links), "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, as edges (u, v): first by count vectors, then the rest on whole sets."""
    near, near_path = written(_blocked(pairs, sets.select("doc_id", F.col("counts").alias("value")), _near(num, den)), "near")
    out, _ = written(_blocked(near, sets.select("doc_id", F.col("members").alias("value")), _linked(num, den)), "links")
    remove(pairs.sparkSession, near_path)
    return out.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _met(keyed: DataFrame, more) -> DataFrame:
    """doc_id, n, key, the first document at the key, the previous one, and one more column."""
    w = Window.partitionBy("key").orderBy("doc_id")
    who = F.struct("doc_id", "n")
    return keyed.select("doc_id", "n", "key", F.first(who).over(w).alias("head"), F.lag(who).over(w).alias("prev"), more)


def _sizes(a: str, b: str, num: int, den: int):
    """Whether sets of sizes ``a`` and ``b`` can link at all."""
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    return (den * F.least(a, b)) >= (num * F.greatest(a, b))


def _across(num: int, den: int):
    """Rows (key, lo, hi, upper, doc_id, label, counts, bits) sorted by block. Yields the pairs (a, b) of different labels in a block, one of the lower and one of the upper part, whose count vectors and parity bits reach the overlap a link needs.

    The count vectors of unrelated long texts reach it as well, so the bits decide: sets that differ in d bits have at most (n_a + n_b - d) / 2 members in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def close() -> pa.RecordBatch:
            ids, labels = (np.array([h[k] for h in held], np.int64) for k in (1, 2))
            points = np.stack([np.frombuffer(h[3], np.uint32) for h in held]).astype(np.int64)
            upper, sizes = np.array([h[0] for h in held]), points.sum(1)
            width = np.array([len(h[4]) for h in held])
            alike = {w: np.flatnonzero(width == w) for w in set(width.tolist())}
            bits = {w: np.stack([np.frombuffer(held[k][4], np.uint64) for k in at]) for w, at in alike.items()}
            place = np.zeros(len(held), np.int64)  # of a document among those with as many bits
            for at in alike.values():
                place[at] = np.arange(len(at))
            within = block[1] == block[2]
            asked, stored = (np.arange(len(held)),) * 2 if within else (np.flatnonzero(upper), np.flatnonzero(~upper))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if len(asked) and len(stored):
                tree = CountTree(points[stored])
                for q in asked:
                    n = int(points[q].sum())
                    found = stored[tree.search(points[q], lambda size: num * (n + size) / (num + den) - 1e-6)]  # noqa: B023
                    found = found[labels[found] != labels[q]]
                    found = found[ids[found] < ids[q]] if within else found
                    differ = np.zeros(len(found), np.int64)
                    for w in set(width[found].tolist()):
                        own = width[found] == w
                        differ[own] = apart_bits(bits[width[q]][place[q]], bits[w][place[found[own]]])
                    both = n + sizes[found]
                    found = found[(both - differ) * (num + den) >= 2 * num * both]
                    left.append(np.full(len(found), ids[q]))
                    right.append(ids[found])
            a, b = np.concatenate(left), np.concatenate(right)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for x in batches:
            for *at, up, i, label, counts, bits in zip(*(x.column(k).to_pylist() for k in range(8)), strict=True):
                if at != block:
                    if held:
                        yield close()
                    block, held = at, []
                held.append((up, i, label, counts, bits))
        if held:
            yield close()

    return run


def _trees(rows: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ``rows`` (key, doc_id, label, n_docs) that an R-tree over each key's count vectors, and then their parity bits, keep.

    A key's documents are dealt into parts of about ``BLOCK``; a task has two parts at a time, and only what the tree keeps leaves it.
    """
    shares = F.ceil(F.col("n_docs") / BLOCK).cast("int")
    dealt = rows.join(shuffled(counts), "doc_id").withColumn("mine", F.pmod(F.xxhash64("doc_id"), shares).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), shares - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") >= F.col("other")).alias("upper"), "doc_id", "label", "counts", "bits")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_across(num, den), "a long, b long")


def _apart(keyed: DataFrame, labels: DataFrame, meet: int, num: int, den: int, counts: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of ``keyed`` (doc_id, n, key) in different components that meet at ``meet`` keys and whose sizes can link.

    With ``counts`` (doc_id, counts, bits), pairs at keys of more than ``HOT`` documents come from R-trees, which leave out those whose vectors exclude a link; ``meet`` has to be 1 then.
    """
    rows = keyed.join(shuffled(labels.select(F.col("node").alias("doc_id"), "label")), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n_docs")).where("low <> high").select("key", "n_docs")
    rows, path = written(rows.join(mixed, "key"), "mixed")
    few = rows if counts is None else rows.where(F.col("n_docs") <= HOT)
    a, b = (few.select("key", F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("label").alias(f"of_{x}")) for x in "ab")
    met = a.join(b, (a["key"] == b["key"]) & (F.col("a") > F.col("b")) & (F.col("of_a") != F.col("of_b")) & _sizes("n_a", "n_b", num, den))
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= meet).select("a", "b")
    if counts is not None:
        met = met.unionByName(_trees(rows.where(F.col("n_docs") > HOT), counts, num, den)).distinct()
    out, _ = written(met, "apart")
    remove(keyed.sparkSession, path)
    return out


def _loads(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(chunk, counts): how many of a task's shingles fall into each slot, up to 65,535 for each task."""
        loads = np.zeros(SLOTS, np.uint32)
        for _, words in word_sequences(batches):
            np.add.at(loads, (shingle_set(words, width) % np.uint64(SLOTS)).astype(np.int64), 1)
        found = np.minimum(loads, 65_535).astype(np.uint16).reshape(-1, CHUNK)
        used = np.flatnonzero(found.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([found[k].tobytes() for k in used], pa.binary())], names=["chunk", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, counts) with the counts of each chunk of a partition added up."""
    sums: dict[int, np.ndarray] = {}
    for x in batches:
        for chunk, counts in zip(x.column("chunk").to_pylist(), x.column("counts"), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_py(), np.uint16).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])


def table_loads(rows: DataFrame, width: int) -> np.ndarray:
    """How many shingles of the whole table fall into each of ``SLOTS`` slots; a task sends one vector of fixed size.

    Any order that all sets have in common keeps every link; a fuller table only orders less sharply.
    """
    loads = np.zeros((SLOTS // CHUNK, CHUNK), np.int64)
    for r in rows.mapInArrow(_loads(width), "chunk int, counts binary").repartition("chunk").mapInArrow(_summed, "chunk int, counts binary").toLocalIterator():
        loads[r.chunk] = np.frombuffer(r.counts, np.int64)
    return loads.ravel()


def _rarest(sets: DataFrame, num: int, den: int, loads) -> DataFrame:
    """doc_id, n, key: the first n - ceil(t n) + 1 shingles of each set, the rarest of the table first."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i, m in zip(x.column("doc_id").to_pylist(), x.column("members"), strict=True):
                keys = np.frombuffer(m.as_py(), np.uint64)
                n = len(keys)
                keys = keys[np.argsort(_rarity(keys, loads.value), kind="stable")[: n - -(-num * n // den) + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int64)), pa.array(np.full(len(keys), n, np.int32)), pa.array(keys)], names=["doc_id", "n", "key"])

    return sets.mapInArrow(first, "doc_id long, n int, key long")


def _sets_of(rows: DataFrame, pairs: DataFrame, width: int) -> tuple[DataFrame, list[str]]:
    """doc_id, counts, members of the documents in ``pairs`` (a, b), and the paths to remove."""
    ids, ids_path = written(pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("_id")), "pair-ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = rows.join(F.broadcast(ids) if few else ids, rows["doc_id"] == ids["_id"], "left_semi")
    sets, sets_path = written(wanted.mapInArrow(_sets(width), "doc_id long, counts binary, bits binary, members binary"), "sets")
    return sets, [ids_path, sets_path]


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not an _id of ``ids``, which is broadcast if it is small enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, rows["doc_id"].cast("long") == ids["_id"], "left_anti")


def _dealt(rows: DataFrame, crowds: DataFrame) -> DataFrame:
    """``rows`` (doc_id, s1, s2) with the salt that they find their class by; rows without a doc_id find none."""
    return rows.join(F.broadcast(crowds), ["s1", "s2"], "left").withColumn("salt", F.pmod("doc_id", F.when(F.col("crowd"), SALTS).otherwise(1)).cast("int")).drop("crowd")


def _salted(classes: DataFrame) -> DataFrame:
    """``classes`` (s1, s2, members) with a row for each salt that ``_dealt`` gives their documents."""
    return shuffled(classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("members") > CROWD, SALTS - 1).otherwise(0)))).drop("members"))


def cluster(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text): documents link when den * |a & b| >= num * |a | b|."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    loads = spark.sparkContext.broadcast(table_loads(rows, width))
    base, base_path = written(rows.mapInArrow(_described(width, num, den, loads), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "shingles")
    lean, _ = written(base.drop("keys"), "signatures")
    able = base.where("n_shingles > 0 and doc_id is not null")
    classes, classes_path = written(able.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    crowds, crowds_path = written(classes.where(F.col("members") > CROWD).select("s1", "s2", F.lit(True).alias("crowd")), "crowds")
    copies = _dealt(able.select("doc_id", "s1", "s2"), crowds).join(_salted(classes.where("members > 1").select("s1", "s2", "rep", "members")), ["s1", "s2", "salt"])
    copies, copies_path = written(copies.where("rep <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "copies")
    n = F.col("n_shingles").cast("int").alias("n")
    keyed = _without(able.select("doc_id", n, "keys"), copies).select("doc_id", "n", F.explode("keys").alias("key"))

    w = Window.partitionBy("key")
    met = _met(keyed, F.count(F.lit(1)).over(w).alias("n_docs")).where("n_docs > 1")
    met, met_path = written(met.withColumn("hot", F.col("n_docs") > HOT).drop("n_docs"), "met")
    # Documents with many hot shingles in front meet at these as well; for the others MEET shingles that are not hot remain.
    hot = met.where("hot").groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("n_hot"))
    hot = hot.where(F.col("n_hot") > F.least(F.lit(SPARE), F.ceil(F.col("n") * num / den)) - MEET).select("doc_id")
    hot, hot_path = written(hot, "hot")
    led, led_path = written(met.where("hot").join(hot, "doc_id", "left_semi").select("doc_id", "n", "key"), "led")
    remove(spark, hot_path)
    again = _met(led, F.lit(True).alias("hot"))
    pairs = met.where("not hot").unionByName(again).where("prev is not null")
    pairs = pairs.select(F.col("doc_id").alias("a"), "n", F.explode(F.array_distinct(F.array("head", "prev"))).alias("to")).select("a", "n", F.col("to.doc_id").alias("b"), F.col("to.n").alias("n_b"))
    pairs = pairs.where(F.col("a") != F.col("b")).where(_sizes("n", "n_b", num, den)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    pairs, pairs_path = written(pairs.where(F.col("shared") >= MEET), "pairs")
    remove(spark, base_path, copies_path)

    sets, used = _sets_of(rows, pairs, width)
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    edges = verify(best, sets, num, den)
    labels = components(edges)
    apart = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        apart = apart.join(shuffled(labels.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))), end, "left")
    apart = apart.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    rest = verify(apart, sets, num, den)
    if not rest.isEmpty():
        edges = edges.unionByName(rest)
        labels = components(edges)
    remove(spark, *used)

    # Pairs that the choice of partners left out: first where few documents meet, then among those with many hot shingles.
    tried = pairs.select("a", "b")
    apart = _apart(met.where("not hot").select("doc_id", "n", "key"), labels, MEET, num, den).join(tried, ["a", "b"], "left_anti")
    if not apart.isEmpty():
        sets, used = _sets_of(rows, apart, width)
        rest = verify(apart, sets, num, den)
        remove(spark, *used)
        if not rest.isEmpty():
            edges = edges.unionByName(rest)
            labels = components(edges)
    keyed = led.join(shuffled(labels.select(F.col("node").alias("doc_id"), "label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = keyed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    mixed = keyed.join(mixed, "key", "left_semi").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    if not mixed.isEmpty():
        sets, used = _sets_of(rows, mixed, width)
        rarest, rarest_path = written(_rarest(sets, num, den, loads), "rarest")
        apart = _apart(rarest, labels, 1, num, den, sets.select("doc_id", "counts", "bits")).join(tried, ["a", "b"], "left_anti")
        rest = verify(apart, sets, num, den)
        remove(spark, rarest_path, *used)
        if not rest.isEmpty():
            labels = components(edges.unionByName(rest))
    remove(spark, met_path, led_path)

    named = classes.join(shuffled(labels), classes["rep"] == labels["node"], "left").where("members > 1 or label is not null")
    named, _ = written(named.select("s1", "s2", F.coalesce("label", "rep").alias("component_id"), "members"), "named")
    remove(spark, pairs_path, classes_path)
    out = _dealt(lean.select("doc_id", "n_shingles", "s1", "s2"), crowds).join(_salted(named), ["s1", "s2", "salt"], "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(linked, F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without those of documents that link with one of a smaller doc_id in their component."""
    gone, _ = written(cluster(docs, width, num, den).where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "copies")
    return _without(docs, gone)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, hash(array_to_string(ws[p : p + least(3, len(ws)) - 1], ' ')) as g from (select doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) as p from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
rare as (select s.*, n, row_number() over (partition by s.doc_id order by f, s.g) as k from s join n using (doc_id) join (select g, count(*) as f from s group by g) using (g)),
c as (select distinct a.doc_id as a, b.doc_id as b from rare a join rare b on a.g = b.g and a.doc_id < b.doc_id
  where a.k <= a.n - ceil(0.9 * a.n) + 2 and b.k <= b.n - ceil(0.9 * b.n) + 2 and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n),
i as (select c.a, c.b, count(*) as m from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and y.g = x.g group by c.a, c.b),
e as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * m >= 90 * (na.n + nb.n - m)),
b as (select a as u, b as v from e union all select b, a from e),
r(u, v) as (select u, v from b union select r.u, b.v from r join b on r.v = b.u)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select u, min(v) as v from r group by u) as m on m.u = d.doc_id
"""

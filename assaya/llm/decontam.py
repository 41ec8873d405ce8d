"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each shard (a run of documents) stores the postings of every
term that occurs in it, as delta-coded word positions, so that one index serves any test set. Terms
are 64-bit hashes of words; nothing is shuffled to build it. Counts of the test terms are summed
over the shards; the search starts from the list of a window's rarest term and intersects the other
terms' lists, shifted by their offsets, for all windows of a shard at once.

Terms are ASCII-lower-cased runs of ``[0-9a-z]`` and non-ASCII characters. The test side is worked
off in blocks of about ``BLOCK_BYTES`` of text, each sent to the executors, searched and let go
before the next one is read; a longer item is split so that no window is lost. So neither the
driver nor a task holds more than one block, whatever the size of the test set.

Defined results: null texts have no words and are never hit; null doc_ids are carried along;
repeated rows are judged one by one; null or wordless items give no query; items that repeat
an item_id are reported once under that id; null item_ids count as hits but are never reported; an
empty table on either side gives rows without hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, without, written
from .shingles import word_hashes

WINDOW = 10
#: Text bytes of one block of the test side.
BLOCK_BYTES = 4_000_000
#: Text bytes and documents of one shard of the index; a longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 2_000_000, 20_000
#: Candidate positions that are intersected at a time.
_AT_ONCE = 1_000_000

#: Bytes between words.
_BREAK = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_INDEX = "shard string, doc_ids binary, doc_null binary, doc_keys binary, n_words binary, terms binary, counts binary, postings binary"


def term_hashes(text: str | None) -> np.ndarray:
    return word_hashes([(text or "").encode("utf-8", "replace")], _BREAK)[0]


# ---- the test side


class Block:
    """Some test items: their distinct windows by length, and the items that hold each of them."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.ids = list(dict.fromkeys(i for i, _ in items))
        number = {i: k for k, i in enumerate(self.ids)}
        self.whole = [(number[i], terms) for i, terms in items]
        rows: dict[int, tuple[list, list]] = {}
        for k, terms in self.whole:
            n = min(window, len(terms))
            if n:
                found, who = rows.setdefault(n, ([], []))
                found.append(np.lib.stride_tricks.sliding_window_view(terms, n))
                who.append(np.full(len(terms) - n + 1, k))
        self.windows: list[list] = []  # terms, order of offsets, first of the items, items
        for found, who in rows.values():
            terms, where = np.unique(np.concatenate(found), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([where.ravel(), np.concatenate(who)], 1), axis=0)
            self.windows.append([terms, None, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]])
        self.terms = np.unique(np.concatenate([t for _, t in self.whole])) if self.whole else np.zeros(0, np.uint64)
        self.counts = np.zeros(len(self.terms), np.int64)

    def rarest_first(self, counts: np.ndarray) -> None:
        """Take the term counts of the whole index and order each window's offsets by them."""
        self.counts = counts
        for w in self.windows:
            w[1] = self.order(w[0])

    def order(self, terms: np.ndarray) -> np.ndarray:
        return np.argsort(self.counts[np.searchsorted(self.terms, terms)], axis=-1, kind="stable")

    def items_of(self, group: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``found``, item) for each window of ``found`` and each item that holds it."""
        _, _, first, items = self.windows[group]
        n = first[found + 1] - first[found]
        at = np.repeat(np.arange(len(found)), n)
        return at, items[np.arange(len(at)) - np.repeat(np.cumsum(n) - n - first[found], n)]


def blocks(benchmark: DataFrame, window: int, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The test items in blocks; item by item from the cluster, never all of them on the driver."""
    held, size = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        terms, step = term_hashes(text), max(window, most // 8)
        for k in range(0, max(1, len(terms) - window + 1), step):  # neighbours overlap, so that no window is lost
            held.append((item_id, terms[k : k + step + window - 1]))
            size += 8 * len(held[-1][1])
            if size >= most:
                yield Block(held, window)
                held, size = [], 0
    if held:
        yield Block(held, window)


# ---- the index


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list, list]]:
    ids, keys, texts, size = [], [], [], 0
    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            ids.append(i)
            keys.append(h)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= most or len(ids) >= SHARD_DOCS:
                yield ids, keys, texts
                ids, keys, texts, size = [], [], [], 0
    if ids:
        yield ids, keys, texts


def build_shard(ids: list, keys: list[int], texts: list[bytes]) -> dict:
    """Postings of one shard: a term's positions count the words of the whole shard."""
    hashed, lengths = word_hashes(texts, _BREAK)
    at = np.argsort(hashed, kind="stable")
    held = hashed[at]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    step = np.diff(at, prepend=0)
    step[first] = at[first]  # each list is delta-coded on its own
    if len(at) >= 1 << 32:
        raise ValueError("a shard's positions must fit 32 bits")
    planes = np.ascontiguousarray(step.astype("<u4").view(np.uint8).reshape(-1, 4).T)  # the high bytes are mostly zero
    null = np.array([i is None for i in ids], bool)
    return {"doc_ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "doc_null": null.tobytes(), "doc_keys": np.array(keys, np.int64).tobytes(), "n_words": lengths.astype(np.int64).tobytes(), "terms": held[first].tobytes(), "counts": np.diff(np.append(first, len(at))).astype(np.int64).tobytes(), "postings": planes.tobytes()}


def build_index(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the index of ``docs`` (doc_id, text), a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, shard in enumerate(_shards(batches, shard_bytes)):
            row = build_shard(*shard)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([f"{part}-{k}"])} | {c: pa.array([v], pa.binary()) for c, v in row.items()})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("binary").alias("text"))
    rows.mapInArrow(run, _INDEX).write.option("compression", "zstd").parquet(path)


def term_counts(spark: SparkSession, path: str, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``terms`` occurs in the whole index; only those of one block travel."""
    sent = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            for t, c in zip(b.column(0), b.column(1), strict=True):
                mine = np.frombuffer(t.as_py(), np.uint64)
                if len(mine) and len(total):
                    at = np.minimum(np.searchsorted(mine, sent.value), len(mine) - 1)
                    total += np.where(mine[at] == sent.value, np.frombuffer(c.as_py(), np.int64)[at], 0)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for term, n in spark.read.parquet(path).select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


class Shard:
    """One shard, decoded: ``keys`` holds (ordinal of the term, position) of all postings, sorted."""

    def __init__(self, doc_ids, doc_null, doc_keys, n_words, terms, counts, postings, shard=""):
        self.name = shard
        self.ids, self.null, self.doc_keys = np.frombuffer(doc_ids, np.int64), np.frombuffer(doc_null, bool), np.frombuffer(doc_keys, np.int64)
        self.lengths = np.frombuffer(n_words, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.terms, self.counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        step = np.ascontiguousarray(np.frombuffer(postings, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        total = np.cumsum(step)
        before = np.concatenate([[0], total])[self.first]
        self.postings = total - np.repeat(before, self.counts)
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.postings

    def ordinals(self, terms: np.ndarray) -> np.ndarray:
        """Where each term is among the shard's, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def at(self, term: int) -> np.ndarray:
        k = int(self.ordinals(np.array([term], np.uint64))[0])
        return self.postings[self.first[k] : self.first[k] + self.counts[k]] if k >= 0 else np.zeros(0, np.int64)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def phrases(self, terms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``terms``, start) of each exact occurrence within a document; ``order`` has each row's offsets, rarest first."""
        n = terms.shape[1]
        at = self.ordinals(terms)
        row = np.flatnonzero((at >= 0).all(1))
        some = self.counts[at[row, order[row, 0]]]
        out_row, out_pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(some)
        cuts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, _AT_ONCE), "left").tolist() + [len(row)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            w = np.repeat(row[a:b], some[a:b])
            within = np.arange(len(w)) - np.repeat(np.cumsum(some[a:b]) - some[a:b], some[a:b])
            pos = self.postings[self.first[at[w, order[w, 0]]] + within] - order[w, 0]
            ok = pos >= 0
            w, pos = w[ok], pos[ok]
            for k in range(1, n):
                off = order[w, k]
                key = at[w, off] << 32 | (pos + off)
                found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
                w, pos = w[found], pos[found]
            ok = self.doc_of(pos) == self.doc_of(pos + n - 1)
            out_row.append(w[ok])
            out_pos.append(pos[ok])
        return np.concatenate(out_row), np.concatenate(out_pos)

    def near(self, terms: np.ndarray, order: np.ndarray, slop: int) -> np.ndarray:
        """(first, last) positions of the places in a document where all ``terms`` lie within ``slop`` positions of one of the rarest."""
        lists = [self.at(terms[k]) for k in order]
        pivot, low, high = lists[0], lists[0], lists[0]
        doc = self.doc_of(pivot)
        for other in lists[1:]:
            if not len(other) or not len(pivot):
                return np.zeros((0, 2), np.int64)
            after = np.searchsorted(other, pivot)
            left, right = other[np.maximum(after - 1, 0)], other[np.minimum(after, len(other) - 1)]
            away = [np.where(self.doc_of(x) == doc, np.abs(x - pivot), slop + 1) for x in (left, right)]
            best, ok = np.where(away[0] <= away[1], left, right), np.minimum(*away) <= slop
            pivot, low, high, doc = pivot[ok], np.minimum(low, best)[ok], np.maximum(high, best)[ok], doc[ok]
        return np.stack([low, high], 1)


def occurrences(shard: Shard, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(window, start, length, group) of the exact occurrences of a block's windows, by window length."""
    for group, (terms, order, _, _) in enumerate(block.windows):
        yield *shard.phrases(terms, order), terms.shape[1], group


def _each(docs: DataFrame, benchmark: DataFrame, window: int, emit, schema: str, shard_bytes: int, block_bytes: int) -> tuple[list[DataFrame], list[str]]:
    """What ``emit`` makes of each shard and each block, a table for each block, and the paths to remove."""
    spark, out, paths = docs.sparkSession, [], []
    index = scratch(spark, "postings")
    build_index(docs, index, shard_bytes)

    def result(block: Block, first: bool) -> DataFrame:
        block.rarest_first(term_counts(spark, index, block.terms))
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield emit(Shard(**row), sent.value, first)

        return spark.read.parquet(index).mapInArrow(run, schema)

    todo = blocks(benchmark, window, block_bytes)
    held = next(todo, None) or Block([], window)
    for nxt in todo:
        df, path = written(result(held, not out), "matches")
        out.append(df)
        paths.append(path)
        held = nxt
    return [*out, result(held, not out)], [index, *paths]


def _union(tables: Iterable[DataFrame]) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, first_word, end_word of every exact occurrence of a window (``slop`` None) or every proximity match of an item's terms.

    With ``slop`` an item longer than an eighth of ``block_bytes`` is matched in parts.
    """

    def emit(shard: Shard, block: Block, _: bool) -> pa.RecordBatch:
        items, starts, ends = [], [], []
        if slop is None:
            for w, s, n, group in occurrences(shard, block):
                at, item = block.items_of(group, w)
                items.append(item)
                starts.append(s[at])
                ends.append(s[at] + n)
        else:
            for k, terms in block.whole:
                if len(terms):
                    distinct = np.array(list(dict.fromkeys(terms.tolist())), np.uint64)
                    found = shard.near(distinct, block.order(distinct), slop)
                    items.append(np.full(len(found), k))
                    starts.append(found[:, 0])
                    ends.append(found[:, 1] + 1)
        item, s, e = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (items, starts, ends))
        d = shard.doc_of(s)
        return pa.RecordBatch.from_arrays([pa.array(shard.ids[d], pa.int64(), mask=shard.null[d]), pa.array([block.ids[k] for k in item], pa.string()), pa.array(s - shard.starts[d]), pa.array(e - shard.starts[d])], names=["doc_id", "item_id", "first_word", "end_word"])

    return _union(_each(docs, benchmark, window, emit, "doc_id long, item_id string, first_word long, end_word long", shard_bytes, block_bytes)[0])


_JUDGED = "shard string, row long, doc_id long, key long, n_words long, spans array<struct<s:long,e:long>>, items array<string>"


def _judged(shard: Shard, block: Block, first: bool) -> pa.RecordBatch:
    """A row for each document (after the first block: for each that is hit) with its hit words as spans and its items."""
    edge = np.zeros(int(shard.lengths.sum()) + 1, np.int64)
    n_items, pairs = max(1, len(block.ids)), [np.zeros(0, np.int64)]
    for w, s, n, group in occurrences(shard, block):
        np.add.at(edge, s, 1)
        np.add.at(edge, s + n, -1)
        at, item = block.items_of(group, w)
        pairs.append(np.unique(shard.doc_of(s[at]) * n_items + item))
    hit = np.cumsum(edge) > 0
    turn = np.diff(np.concatenate([[False], hit]).astype(np.int8))
    s, e = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # A span that runs on into the next document is cut at the documents' edges.
    if len(s):
        d0, d1 = shard.doc_of(s), shard.doc_of(e - 1)
        cut = [x for a, b in zip(d0[d0 < d1].tolist(), d1[d0 < d1].tolist(), strict=True) for x in range(a + 1, b + 1)]
        inner = np.unique(shard.starts[cut]) if cut else np.zeros(0, np.int64)
        s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
    d = shard.doc_of(s)
    pairs = np.unique(np.concatenate(pairs))
    p_doc, p_item = pairs // n_items, pairs % n_items
    rows = np.arange(len(shard.ids)) if first else np.unique(d)
    to_list = lambda docs, values: pa.ListArray.from_arrays(np.append(np.searchsorted(docs, rows), len(docs)).astype(np.int32), values)
    named = [block.ids[k] for k in p_item.tolist()]
    spans = pa.StructArray.from_arrays([pa.array(s - shard.starts[d]), pa.array(e - shard.starts[d])], ["s", "e"])
    return pa.RecordBatch.from_arrays([pa.array([shard.name] * len(rows), pa.string()), pa.array(rows), pa.array(shard.ids[rows], mask=shard.null[rows]), pa.array(shard.doc_keys[rows]), pa.array(shard.lengths[rows]), to_list(d, spans), to_list(p_doc, pa.array(named, pa.string()))], names=["shard", "row", "doc_id", "key", "n_words", "spans", "items"])


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: doc_id, key (xxhash64 of the text), n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found, _ = _each(docs, benchmark, window, _judged, _JUDGED, shard_bytes, block_bytes)
    if len(found) == 1:
        rows = found[0]
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    else:  # the blocks' spans of a document may overlap
        rows = _union(found).groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
        n_hit = F.aggregate("spans", start, lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["upto"]))).alias("n")))["n"]
    items = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull())))
    out = rows.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), items.alias("items"))
    return out.select("doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window, with their columns unchanged. Ids and text hashes of hit rows are joined."""
    hit, _ = written(judge(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col("key").alias("_hit_key")).distinct(), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"].cast("string")) == hit["_hit_key"])
    return without(docs, hit, same)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "key")


ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from benchmark),
q as (select item_id, len(ws) as n, ws, least({WINDOW}, len(ws)) as k from i where len(ws) > 0),
w as (select item_id, k, array_to_string(ws[s : s + k - 1], ' ') as phrase from (select *, unnest(generate_series(1, n - k + 1)) as s from q)),
dw as (select r, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from d where len(ws) > 0),
ln as (select distinct k from q),
dg as (select r, ln.k, unnest(generate_series(1, len(ws) - ln.k + 1)) as p, ws from d, ln where len(ws) >= ln.k),
m as (select dg.r, dg.p, dg.k, w.item_id from dg join w on dg.k = w.k and array_to_string(dg.ws[dg.p : dg.p + dg.k - 1], ' ') = w.phrase),
h as (select r, count(distinct p + o) as n_hit from (select distinct r, p, k from m) as mm, range({WINDOW}) as t(o) where o < k group by r),
it as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, cast(item_id as varchar) as item_id from m) as mi group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (r) left join it using (r)
"""

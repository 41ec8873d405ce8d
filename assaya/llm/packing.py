"""Best-fit packing of tokenized documents into sequences, after Martello and Toth's dominance reduction.

How pieces share sequences depends only on how many there are of each length, and there are no
more lengths than the capacity. So the plan is made of counts: a set of lengths that provably
dominates every alternative (whatever else may go with its first piece fits, part by part, into
the places of its others) is fixed as often as the counts allow; that shrinks the instance, and
the next set is looked for in what is left. Sets of up to three pieces are tried. The remainder is
packed best fit, longest first, all pieces of a length at once: a run of like sequences is split
only where a length ends in it.

The plan gives each piece a place by its rank among those of its length. Ranks are never sorted
for: each task numbers its own pieces of a length while it encodes them, and a table of counts by
task and length gives what comes before. So the corpus is encoded once, written once, and joined
with a small table; driver and plan see counts only. A plan has at most one row for each length
and each run of sequences that it goes to, and a length adds four runs at most, so it has under
8 * capacity ** 2 rows (a few thousand on real lengths).

Texts are cut at ASCII white space for encoding, which no token of the vocabulary crosses, after A-Z
are lower-cased, as the tokenizer does with all letters. The ids of a word are remembered, up to
``REMEMBER_BYTES``; a text that holds the string of a special token, in either case, goes to the library whole.

Defined results: a null or empty text is a document of the end id alone; only documents longer
than a sequence are cut; repeated rows are packed one by one; null doc_ids are carried along; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters, in_slices
from .common import table, written

CAPACITY, END_ID = 2048, 0
#: About the bytes that remembered words may take in a worker, and the longest word that is remembered.
REMEMBER_BYTES, LONGEST = 240_000_000, 200
#: Marks that are cut from a word's end.
MARKS = ".,;:!?"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Texts (UTF-8) to their ids as the library gives them, little-endian and of ``dtype``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"].encode().lower() for t in json.load(f)["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.tokenize, code = self.tokenizer.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        letters = byte_letters()
        letters[32] = " "  # what words are joined by
        self.letters = "".join(letters)
        self.pack = lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)
        self.marks = dict(zip(MARKS, self._library(list(MARKS)), strict=True)) | {"": b""}
        self.known: dict[bytes, bytes] = {}
        self.size = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters: each is one pretoken, in lower case and in the letters that stand for its bytes."""
        if not words:
            return []
        out: list[bytes] = []
        low = " ".join(words).lower().split(" ")
        data = " ".join(low).encode().decode("latin-1").translate(self.letters).split(" ")
        for w, s in zip(low, data, strict=True):
            # A letter that is lower-cased to more than letters makes more than one pretoken.
            out.append(self.pack([t.id for t in self.tokenize(s)]) if w.isalpha() else self._library([w])[0])
        return out

    def _learned(self, new: list[bytes]) -> dict[bytes, bytes]:
        found, cores = {}, {}
        for w in new:
            s = w.decode("utf-8", "replace")
            mark = s[-1] if s[-1] in self.marks else ""
            core = s[:-1] if mark else s
            if core.isalpha() and max(core) < "\u0250":
                cores[w] = core, mark
            else:
                found[w] = s
        found = dict(zip(found, self._library(list(found.values())), strict=True))
        each = list({c for c, _ in cores.values()})
        known = dict(zip(each, self._of_words(each), strict=True))
        found.update((w, known[c] + self.marks[m]) for w, (c, m) in cores.items())
        return found

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        low = [t.lower() for t in texts]
        if whole := [k for k, t in enumerate(low) if any(s in t for s in self.special)]:
            out = dict(zip(whole, self._library([texts[k].decode("utf-8", "replace") for k in whole]), strict=True))
            rest = iter(self.encode_all([t for k, t in enumerate(texts) if k not in out]))
            return [out[k] if k in out else next(rest) for k in range(len(texts))]
        cut = [t.split() for t in low]
        if self.size > REMEMBER_BYTES:
            self.known, self.size = {}, 0
        found = self._learned(list(set().union(*cut).difference(self.known)))
        known = self.known
        known.update(found)
        out = [b"".join(map(known.__getitem__, c)) for c in cut]
        self.size += 200 * len(found)
        for w in [w for w in found if len(w) > LONGEST]:
            del known[w]
        return out


_LOADED: dict[str, Words] = {}


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary), ids_crc32 of ``docs``, with the task that made it and its number among the task's pieces of that length."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Words(path)
        words = _LOADED[path]
        end, width, task, seen = np.array([end_id], words.dtype).tobytes(), words.dtype.itemsize, TaskContext.get().partitionId(), Counter()
        for b in batches:
            at = 0
            for texts in in_slices(b.column(1).to_pylist()):
                which, rows = [], []
                for k, ids in enumerate(words.encode_all([t or b"" for t in texts])):
                    ids += end
                    for n, place in enumerate(range(0, len(ids), capacity * width)):
                        part = ids[place : place + capacity * width]
                        length = len(part) // width
                        which.append(at + k)
                        rows.append((n, n * capacity, length, part, zlib.crc32(np.frombuffer(part, words.dtype).astype("<u4").tobytes()), task, seen[length]))
                        seen[length] += 1
                at += len(texts)
                if rows:
                    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64())
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *columns], names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, task int, nth long")


class Plan:
    """Where the pieces of each length go. ``count``: pieces by length; afterwards ``bins`` sequences, of which ``fixed`` by dominance."""

    def __init__(self, count: dict[int, int], capacity: int):
        self.capacity, self.count = capacity, {k: n for k, n in count.items() if n}
        if any(not 0 < k <= capacity for k in self.count):
            raise ValueError("lengths must be from 1 to the capacity")
        self.least = -(-sum(k * n for k, n in self.count.items()) // capacity)
        self.alive, self.used, self.rows, self.bins = sorted(self.count), Counter(), [], 0
        self._reduce()
        self.fixed = self.bins
        self._best_fit()

    def _put(self, length: int, bins: int, first: int, each: int, offset: int) -> None:
        """``each`` pieces of that length at ``offset`` of each of the ``bins`` sequences from ``first`` on."""
        self.rows.append((length, self.used[length], first, each, offset))
        self.used[length] += bins * each

    def _take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length], self.alive[bisect_left(self.alive, length)]

    def _give(self, length: int) -> None:
        if length not in self.count:
            self.count[length] = 0
            self.alive.insert(bisect_left(self.alive, length), length)
        self.count[length] += 1

    def _largest(self, room: int) -> int | None:
        at = bisect_right(self.alive, room)
        return self.alive[at - 1] if at else None

    def _smallest(self, n: int) -> int:
        """The sum of the ``n`` smallest pieces; beyond any room if there are fewer."""
        total = 0
        for length in self.alive:
            k = min(n, self.count[length])
            total, n = total + k * length, n - k
            if not n:
                return total
        return self.capacity + 1

    def _others(self, room: int) -> tuple[int, ...] | None:
        """The lengths that go with a piece (taken out already) with ``room`` beside it, at least as good as any others."""
        k = self._largest(room)
        if k is None:
            return ()
        if k == room or self._smallest(2) > room:
            return (k,)
        if self._smallest(3) <= room:
            return None
        pairs, inner = 0, 0  # the largest sum of two that fit, and the largest smaller piece of such two
        for x in self.alive[: bisect_right(self.alive, room)]:
            self._take(x, 1)
            y = self._largest(room - x)
            self._give(x)
            if y is not None:
                pairs, inner = max(pairs, x + y), max(inner, min(x, y))
        if k >= pairs:
            return (k,)
        self._take(k, 1)
        b = self._largest(room - k)
        self._give(k)
        return (k, b) if b is not None and inner <= b else None

    def _dominating(self, length: int) -> tuple[int, ...] | None:
        self._take(length, 1)
        found = self._others(self.capacity - length)
        self._give(length)
        return None if found is None else (length, *found)

    def _reduce(self) -> None:
        again = True
        while again:
            again = False
            for length in reversed(self.alive.copy()):
                while length in self.count and (chosen := self._dominating(length)):
                    again, each = True, Counter(chosen)
                    # Counts near zero change what is possible, so the last pieces are looked at one by one.
                    times, offset = max(1, min((self.count[x] - 2) // m for x, m in each.items())), 0
                    for x, m in each.items():
                        self._put(x, times, self.bins, m, offset)
                        self._take(x, times * m)
                        offset += m * x
                    self.bins += times

    def _best_fit(self) -> None:
        """The rest, longest first, each piece into the fullest sequence that has room for it."""
        rooms: list[int] = []
        runs: dict[int, list[tuple[int, int]]] = {}

        def push(room: int, first: int, bins: int) -> None:
            if bins and room:
                if room not in runs:
                    rooms.insert(bisect_left(rooms, room), room)
                runs.setdefault(room, []).append((first, bins))

        for length in reversed(self.alive):
            n = self.count[length]
            while n:
                at = bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, bins = runs[room].pop()
                    if not runs[room]:
                        del runs[room], rooms[at]
                else:
                    room, first = self.capacity, self.bins
                    bins = -(-n // (room // length))
                    self.bins += bins
                each = room // length
                full = min(bins, n // each)
                if full:
                    self._put(length, full, first, each, self.capacity - room)
                    push(room - each * length, first, full)
                    n -= full * each
                if n and full < bins:
                    self._put(length, 1, first + full, n, self.capacity - room)
                    push(room - n * length, first + full, 1)
                    full, n = full + 1, 0
                push(room, first + full, bins - full)

    def arrays(self) -> list[np.ndarray]:
        return [np.array(c, np.int64) for c in zip(*sorted(self.rows), strict=True)]


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 44) | rank  # lengths under 2 ** 19, ranks under 2 ** 44


def placed(rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """``rows`` (written pieces) with sequence_id and offset in place of task and nth, and the plan."""
    plan = Plan({r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    kept = [c for c in rows.columns if c not in ("task", "nth")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    if not plan.rows:
        return rows.sparkSession.createDataFrame([], schema), plan
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")).select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = rows.join(before, ["task", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))
    sent = rows.sparkSession.sparkContext.broadcast(plan.arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, firsts, each, offsets = sent.value
        keys = _key(lengths, ranks)
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, _key(length, rank), side="right") - 1
            bins, inside = np.divmod(rank - ranks[at], each[at])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(firsts[at] + bins), pa.array(offsets[at] + inside * length)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema), plan


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, Plan]:
    """The pieces of ``docs`` with their ids and places, and the plan."""
    return placed(written(pieces(docs, capacity, vocabulary, end_id), "pieces")[0], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces and the ids of each whole sequence (binary); a sequence holds at most its capacity in pieces."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(held.alias("held"))
    return rows.select("sequence_id", F.size("held").alias("n_pieces"), F.aggregate("held", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = written(pieces(table(spark, sf_dir, "documents")), "pieces")
    return placed(rows.drop("ids"))[0].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

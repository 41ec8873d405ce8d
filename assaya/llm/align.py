"""Cross-tokenizer alignment: an event sweep over where the tokens of two tokenizers end.

Each text becomes two streams of tokens over the same bytes. A token's end is an event; a row holds
up to ``EVENTS`` successive ones of one stream as ids, whose byte lengths follow from the
vocabulary. The events of both streams are united, dealt out by document, sorted by offset within
their partition and read by a machine that keeps, of one document at a time, the tokens after the
last offset at which both streams end one (and two rows at most beyond those). An offset where
both end closes a group; every offset where any ends closes one link, between the two tokens that
cover the bytes before it: those are all pairs of tokens that overlap.

Linked id pairs are counted over all documents. The frequent ones, ``BROADCAST_PAIRS`` at most,
are broadcast and summed by document where the links lie; the rest are joined by shuffle, and
since each is rare none is a hot key. Counts decide which is which, so the result is the same
wherever the line is.

Both encoders read a text in units that neither tokenizer's tokens cross (before a space that
follows a letter, digit or mark) and remember what a unit gives, up to ``REMEMBER_BYTES``.

Defined results: a null or empty text, and one that either tokenizer does not give back byte by
byte, has no tokens, and zeros; repeated rows are aligned one by one, and each counts; null doc_ids
are carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import MARKS, byte_letters, in_slices
from .common import table, written
from .tokenfile import library_encoder

#: Tokens in a row of events, and link rows that a document's machine holds back.
EVENTS, LINKS_AT_ONCE = 8192, 100_000
#: Pairs that are broadcast (17 bytes each); about the bytes of remembered units in a worker; the longest unit that is remembered.
BROADCAST_PAIRS, REMEMBER_BYTES, LONGEST = 2_000_000, 130_000_000, 100
#: Pairs that a task counts before it passes them on.
COUNT_AT_ONCE = 2_000_000
_UNIT = re.compile(r" +[^ ]*(?:(?<![!-~\w]) +[^ ]*)*")


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each entry of a byte-level vocabulary file."""
    letters = {c: b for b, c in enumerate(byte_letters())}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    entries = whole["model"]["vocab"] | {t["content"]: t["id"] for t in whole["added_tokens"]}
    out = [b""] * (max(entries.values()) + 1)
    for entry, k in entries.items():
        out[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


def bytes_of_b(processor) -> list[bytes]:
    """The bytes of each piece: its UTF-8 with a space for U+2581, or the one byte that it names."""
    out = []
    for k in range(processor.get_piece_size()):
        piece = processor.id_to_piece(k)
        out.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(k) else piece.replace("▁", " ").encode())
    return out


class Encoders:
    """Both tokenizers over units of a text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = bytes_of_a(a_path), bytes_of_b(self.b)
        self.words, _ = library_encoder(a_path)  # for its pretokens only; it remembers nothing here
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.size = 0

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """Ids of units, whose first space is the one that the library puts before a text; of spaces alone those after a letter."""
        texts = [u[1:] for u in units]
        blank = [k for k, u in enumerate(units) if not u.strip(" ")]
        for k in blank:
            texts[k] = "a" + units[k]
        found = self.b.encode(texts, num_threads=1)
        for k in blank:
            found[k] = found[k][1:]
        return found

    def _a_ids(self, units: list[str]) -> list[bytes]:
        """Ids of units: words, and marks behind them, are pretokens that go to the library's model together; others are cut by the pattern."""
        groups: list[str | list[str]] = []
        whole = []
        for k, u in enumerate(units):
            w = u[1:]
            if w.isalpha():
                groups.append(u)
            elif (core := w.rstrip(MARKS)).isalpha():
                groups.append([" " + core, w[len(core) :]])
            elif any(s in u for s in self.words.special):  # they are text here
                whole.append(k)
                groups.append([])
            else:
                groups.append(self.words.find(u))
        each = list({g for g in groups if isinstance(g, str)}.union(*(g for g in groups if not isinstance(g, str))))
        known = dict(zip(each, map(self.words.pack, self.words.many(each)), strict=True))
        out = [known[g] if isinstance(g, str) else b"".join([known[p] for p in g]) for g in groups]
        for k, e in zip(whole, self.a.encode_batch([units[k] for k in whole], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u2").tobytes()
        return out

    def _both(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of each unit under both, or None if either does not give its bytes back."""
        if not units:
            return []
        data, a_ids, b_ids = [u.encode() for u in units], self._a_ids(units), self._b_ids(units)
        flat = np.fromiter(chain.from_iterable(b_ids), "<u2")
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, b_ids), np.int64, len(b_ids)))])
        raw, at = flat.tobytes(), (2 * edges).tolist()
        out: list[tuple[bytes, bytes] | None] = list(zip(a_ids, [raw[i:j] for i, j in zip(at, at[1:])], strict=True))
        for side, found in ((self.a_bytes, b"".join(a_ids)), (self.b_bytes, raw)):
            lengths = np.array([len(x) for x in side])
            ids = np.frombuffer(found, "<u2")
            ends = np.cumsum(np.fromiter(map(len, a_ids), np.int64, len(a_ids))) // 2 if side is self.a_bytes else edges[1:]
            sizes = np.diff(np.concatenate([[0], np.cumsum(lengths[ids])])[ends], prepend=0)
            # Of equal sizes one by one and equal bytes together, each gives its own back.
            if sizes.tolist() == list(map(len, data)) and b"".join(map(side.__getitem__, ids.tolist())) == b"".join(data):
                continue
            for k, x in enumerate(data):
                one = ids[ends[k - 1] if k else 0 : ends[k]].tolist()
                if b"".join(map(side.__getitem__, one)) != x:
                    out[k] = None
        return out

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        """The same of a text with the space before it, by the libraries alone."""
        data, a, b = text.encode(), self.a.encode(text, add_special_tokens=False).ids, self._b_ids([text])[0]
        same = b"".join(map(self.a_bytes.__getitem__, a)) == data and b"".join(map(self.b_bytes.__getitem__, b)) == data
        return (np.array(a, "<u2").tobytes(), np.array(b, "<u2").tobytes()) if same else None

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of a space and each text under both (16 bits each), or None."""
        cut = [_UNIT.findall(" " + t) if t else [] for t in texts]
        if self.size > REMEMBER_BYTES:
            self.known, self.size = {}, 0
        known, units = self.known, list(chain.from_iterable(cut))
        values = list(map(known.get, units))  # None: not known, or not given back
        missing = [k for k, v in enumerate(values) if v is None]
        new = list({units[k] for k in missing}.difference(known))
        known.update(zip(new, self._both(new), strict=True))
        self.size += 350 * len(new)
        for k in missing:
            values[k] = known[units[k]]
        out: list[tuple[bytes, bytes] | None] = []
        at = 0
        for t, c in zip(texts, cut, strict=True):
            found = values[at : at + len(c)]
            at += len(c)
            if None in found:  # the bytes of the whole text decide, not those of a unit
                out.append(self._whole(" " + t))
            else:
                out.append((b"".join([x[0] for x in found]), b"".join([x[1] for x in found])) if found else None)
        for u in new:
            if len(u) > LONGEST:
                del known[u]
        return out


_LOADED: dict[tuple[str, str], Encoders] = {}


def _encoders(paths: tuple[str, str]) -> Encoders:
    if paths not in _LOADED:
        _LOADED[paths] = Encoders(*paths)
    return _LOADED[paths]


def _lengths(paths: tuple[str, str]) -> list[np.ndarray]:
    e = _encoders(paths)
    return [np.array([len(x) for x in side], np.int64) for side in (e.a_bytes, e.b_bytes)]


def events(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """row (a number for each document row), doc_id, side (0: A, 1: B), first (byte offset of the first token), ids; a document without tokens has one row without ids."""
    paths = vocabularies or default_vocabularies()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders, lengths, row = _encoders(paths), _lengths(paths), TaskContext.get().partitionId() << 36
        for b in batches:
            at = 0
            for texts in in_slices(b.column(1).to_pylist()):
                which, out = [], []
                for k, found in enumerate(encoders.encode_all([t or "" for t in texts])):
                    for side, ids in enumerate(found or [b""]):
                        first = 0
                        for place in range(0, max(1, len(ids)), 2 * EVENTS):
                            part = ids[place : place + 2 * EVENTS]
                            which.append(at + k)
                            out.append((row, side, first, part))
                            first += int(lengths[side][np.frombuffer(part, "<u2")].sum()) if len(part) == 2 * EVENTS else 0
                    row += 1
                at += len(texts)
                if out:
                    rows, sides, firsts, ids = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0).take(pa.array(which)), pa.array(sides, pa.int8()), pa.array(firsts, pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "side", "first", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"row long, doc_id {kind}, side byte, first long, ids binary")


class Side:
    """The tokens of one stream that no closed group holds yet, in order of their ends."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        if len(ids):
            self.ids.append(ids)
            self.ends.append(ends)

    def reach(self) -> int:
        return int(self.ends[-1][-1]) if self.ends else 0

    def after(self, seen: int) -> np.ndarray:
        """Ends beyond ``seen``, from the youngest rows only."""
        k = len(self.ends)
        while k and self.ends[k - 1][-1] > seen:
            k -= 1
        found = np.concatenate(self.ends[k:]) if k < len(self.ends) else np.zeros(0, np.int64)
        return found[np.searchsorted(found, seen, side="right") :]

    def take(self, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Remove and return the tokens that end by ``until``."""
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        n = np.searchsorted(ends, until, side="right")
        self.ids, self.ends = ([ids[n:]], [ends[n:]]) if n < len(ids) else ([], [])
        return ids[:n], ends[:n]


class Sweep:
    """The machine of one document. ``feed`` it rows of events by offset; it adds up groups and links and hands on linked pairs."""

    def __init__(self, names: np.ndarray):
        self.names = names  # three strings for each id: with ',', '|' and ';' behind it
        self.sides, self.seen = (Side(), Side()), 0
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.digest, self.held = hashlib.sha256(), b""
        self.codes: list[np.ndarray] = []
        self.waiting = 0

    def feed(self, side: int, ids: np.ndarray, ends: np.ndarray) -> None:
        self.sides[side].add(ids, ends)
        a, b = self.sides
        limit = min(a.reach(), b.reach())
        if limit > self.seen:
            common = np.intersect1d(*(s.after(self.seen) for s in self.sides), assume_unique=True)
            self.seen = limit
            if len(common):
                self._close(common)

    def _close(self, common: np.ndarray) -> None:
        """Groups end at ``common`` offsets; everything up to the last one is done with."""
        (a, a_ends), (b, b_ends) = (s.take(int(common[-1])) for s in self.sides)
        offsets = np.union1d(a_ends, b_ends)
        code = (a[np.searchsorted(a_ends, offsets)].astype(np.int64) << 32) | b[np.searchsorted(b_ends, offsets)]
        self.codes.append(code)
        self.waiting += len(code)
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + len(a), self.n_b + len(b), self.n_groups + len(common), self.n_links + len(offsets)
        a_done, b_done = (np.concatenate([[0], np.searchsorted(ends, common, side="right")]) for ends in (a_ends, b_ends))
        text = np.empty(len(a) + len(b), np.int64)
        for ids, ends, mine, other, mark in ((a, a_ends, a_done, b_done[:-1], 1), (b, b_ends, b_done, a_done[1:], 2)):
            group = np.searchsorted(common, ends)
            place = np.arange(len(ids))
            text[place + other[group]] = 3 * ids.astype(np.int64) + np.where(place + 1 == mine[group + 1], mark, 0)
        self.digest.update(self.held)
        part = b"".join(self.names[text].tolist())
        self.digest.update(part[:-1])
        self.held = part[-1:]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs since the last call, and how often."""
        found = np.unique(np.concatenate(self.codes), return_counts=True) if self.codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.codes, self.waiting = [], 0
        return found


_SWEPT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, counts binary"


def sweep(streams: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes and counts (binary: linked pairs) of events; a long document gives further rows with pairs only."""
    paths = vocabularies or default_vocabularies()
    kind = streams.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(paths)
        names = np.array([f"{k}{mark}".encode() for k in range(max(map(len, lengths))) for mark in ",|;"], dtype=object)
        machine, now, doc, out = None, None, None, []

        def pairs() -> tuple[bytes, bytes]:
            codes, counts = machine.pairs()
            return codes.tobytes(), counts.astype("<u4").tobytes()

        def last() -> tuple:
            machine_ = machine
            return (now, doc, machine_.n_a, machine_.n_b, machine_.n_groups, machine_.n_links, machine_.digest.hexdigest() if machine_.n_a else "", *pairs())

        def packed() -> pa.RecordBatch:
            types = (pa.int64(), doc_type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "counts"])
            out.clear()
            return batch

        doc_type = pa.int64()
        for b in batches:
            doc_type = b.column(1).type
            rows, docs, sides, firsts = (b.column(k).to_pylist() for k in range(4))
            for row, doc_id, side, first, ids in zip(rows, docs, sides, firsts, b.column(4), strict=True):
                if row != now:
                    if machine:
                        out.append(last())
                    machine, now, doc = Sweep(names), row, doc_id
                tokens = np.frombuffer(ids.as_buffer(), "<u2")
                machine.feed(side, tokens, first + np.cumsum(lengths[side][tokens]))
                if machine.waiting > LINKS_AT_ONCE:
                    out.append((now, doc, 0, 0, 0, 0, None, *pairs()))
            if out:
                yield packed()
        if machine:
            out.append(last())
            yield packed()

    rows = streams.repartition("row").sortWithinPartitions("row", "first", "side")
    return rows.select("row", "doc_id", "side", "first", "ids").mapInArrow(run, f"row long, doc_id {kind}, {_SWEPT}")


def pair_counts(swept: DataFrame) -> DataFrame:
    """code (A's id, then B's in the low 32 bits), n and best (n is its B id's highest) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, size = [], [], 0

        def summed() -> pa.RecordBatch:
            found, back = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)  # sums under 2 ** 53
            codes[:], counts[:] = [found], [total]
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], names=["code", "n"])

        for b in batches:
            for c, n in zip(b.column(0), b.column(1), strict=True):
                codes.append(np.frombuffer(c.as_buffer(), np.int64))
                counts.append(np.frombuffer(n.as_buffer(), "<u4").astype(np.int64))
                size += len(codes[-1])
                if size > COUNT_AT_ONCE:
                    batch = summed()
                    size = batch.num_rows
                    if size > COUNT_AT_ONCE // 2:
                        yield batch
                        codes, counts, size = [], [], 0
        if codes:
            yield summed()

    total = swept.select("codes", "counts").where("octet_length(codes) > 0").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    total, _ = written(total, "pairs")
    b_id = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = total.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("highest"))
    return total.join(highest, b_id == F.col("b_id")).select("code", "n", (F.col("n") == F.col("highest")).alias("best"))


def _frequent(pairs: DataFrame, most: int) -> tuple[int, int]:
    """The smallest power of two such that at most ``most`` pairs have a count of it or more, and the number of the others."""
    bits = F.floor(F.log2("n") + F.lit(1e-9)).cast("int")
    sizes = {r["bits"]: r["n"] for r in pairs.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 63 rows at most
    least, taken = 64, 0
    while least and taken + sizes.get(least - 1, 0) <= most:
        least -= 1
        taken += sizes.get(least, 0)
    return least, sum(sizes.values()) - taken


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None, most_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    swept, _ = written(sweep(events(docs, vocabularies), vocabularies), "swept")
    pairs, _ = written(pair_counts(swept), "pair-counts")
    least, others = _frequent(pairs, most_pairs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = pairs.where(F.col("n") >= 2**least if least < 63 else F.lit(False)).toArrow().sort_by("code")  # most_pairs rows at most
    sent = docs.sparkSession.sparkContext.broadcast([known.column(c).to_numpy() for c in ("code", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            codes = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(7)]
            sizes = np.array([len(x) for x in codes])
            every, row = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
            count = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in b.column(8)]).astype(np.int64)
            at = np.minimum(np.searchsorted(code, every), max(0, len(code) - 1))
            hit = code[at] == every if len(code) else np.zeros(len(every), bool)
            sums = np.zeros((2, len(codes)), np.int64)
            np.add.at(sums[0], row[hit], count[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], count[hit] * n[at[hit]])
            left = ~hit
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=len(codes)))]), pa.int32()), pa.array(x[left])) for x in (every, count)]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(sums[0]), pa.array(sums[1]), *lists], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "codes", "counts"])

    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    rows = swept.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, codes array<long>, counts array<long>")
    parts = rows.select("row", "doc_id", *sums, "groups_sha256")
    if others:
        links = rows.select("row", F.explode(F.arrays_zip("codes", "counts")).alias("l")).select("row", F.col("l.codes").alias("code"), F.col("l.counts").alias("k"))
        rare = links.join(pairs.where(F.col("n") < 2**least) if least < 63 else pairs, "code")
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(rare.select("row", F.lit(None).cast(kind).alias("doc_id"), *(zero.alias(c) for c in sums[:4]), F.when(F.col("best"), F.col("k")).otherwise(zero).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum"), F.lit(None).cast("string").alias("groups_sha256")))
    return parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in sums), F.max("groups_sha256").alias("groups_sha256")).drop("row")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))

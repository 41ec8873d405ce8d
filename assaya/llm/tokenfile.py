"""Token-id files: independent zstandard frames, one per document, with a trailing seek table.

A file is, in this order: a frame for each document (its ids, little-endian, 16 bits each if the
vocabulary allows, else 32); a skippable frame with the document index (doc_ids, null flags,
token counts); and the seek table of the public zstandard seekable format, which holds each
frame's compressed and decompressed size and the low 32 bits of its XXH64. A reader opens the
seek table, and then decompresses the requested documents only.

Documents are dealt out by ranges of doc_id, each range is one file, and the files in order hold
the documents in ascending doc_id order (nulls first; rows that share a doc_id by text). Files
are written through pyarrow's filesystems under a temporary name and then renamed, so a task that
runs again replaces its own file by the same bytes.

Defined results: a null text is empty and has the end id only; repeated rows are kept; an empty
table gives no files and an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, byte_letters, default_vocabulary, in_slices
from .common import parts, scratch, table, written

END_ID = 2
#: About the bytes that each of two generations of remembered pieces may take in a worker (estimated at twice what they take).
REMEMBER_BYTES = 320_000_000
#: Pretokens that go to the library in one call.
TOGETHER = 64
#: Fixed values of the zstandard seekable format.
_SEEK_MAGIC, _FOOTER_MAGIC, _INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_LEVEL = 3


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "file:///", path)
    return pyarrow.fs.FileSystem.from_uri(path)


class Writer:
    """One token file; ``add`` documents in order, then ``close``."""

    def __init__(self, sink, width: int = 2):
        self.sink, self.dtype = sink, np.dtype(f"<u{width}")
        self.zip = zstandard.ZstdCompressor(level=_LEVEL)
        self.table, self.index = bytearray(), []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(self.dtype).tobytes()
        frame = self.zip.compress(data)
        self.sink.write(frame)
        self.table += struct.pack("<III", len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
        self.index.append((doc_id or 0, doc_id is None, len(ids)))

    def close(self) -> None:
        i = self.index
        body = struct.pack("<BQ", self.dtype.itemsize, len(i)) + np.array([x[0] for x in i], "<i8").tobytes() + np.array([x[1] for x in i], "u1").tobytes() + np.array([x[2] for x in i], "<u8").tobytes()
        self.sink.write(struct.pack("<II", _INDEX_MAGIC, len(body)) + body)
        self.table += struct.pack("<III", len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        n = len(self.table) // 12
        self.sink.write(struct.pack("<II", _SEEK_MAGIC, len(self.table) + 9) + bytes(self.table) + struct.pack("<IBI", n, 0x80, _FOOTER_MAGIC))


class Reader:
    """Random access to one token file (anything with read, seek and size)."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != _FOOTER_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.plain, self.sums = table[:-1, 0], table[:-1, 1], table[:-1, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        body = self._at(int(self.offsets[-2]) + 8, int(table[-1, 0]) - 8)
        width, docs = struct.unpack("<BQ", body[:9])
        self.dtype = np.dtype(f"<u{width}")
        self.ids = np.frombuffer(body, "<i8", docs, 9)
        self.null = np.frombuffer(body, "u1", docs, 9 + 8 * docs).astype(bool)
        self.counts = np.frombuffer(body, "<u8", docs, 9 + 9 * docs).astype(np.int64)
        self.unzip = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file; only its frame is read."""
        data = self.unzip.decompress(self._at(int(self.offsets[k]), int(self.sizes[k])), max_output_size=max(1, int(self.plain[k])))
        if len(data) != self.plain[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum mismatch in frame {k}")
        return np.frombuffer(data, self.dtype)

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.ids == doc_id) & ~self.null).tolist()


_LOADED: dict = {}


def library_encoder(path: str) -> tuple[Encoder, int]:
    """The tokenizers library's model behind the cutting and remembering of pieces, and the bytes an id takes."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model, letters, vocabulary = tokenizer.model, "".join(byte_letters()), tokenizer.get_vocab()
        bare, gap = Tokenizer(model), letters[255]  # a byte that UTF-8 never has
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        width = 2 if tokenizer.get_vocab_size() <= 65536 else 4
        code, dtype = ("H" if width == 2 else "I"), f"<u{width}"
        # If no merge has that byte, the ids of pretokens with it between them are those of each, with its id between them.
        apart = vocabulary.get(gap) if not model.ignore_merges and sum(gap in v for v in vocabulary) == 1 else None

        def many(pretokens: list[str]) -> list:
            if not pretokens:
                return []
            data = b"\xff".join([p.encode("utf-8", "replace") for p in pretokens]).decode("latin-1").translate(letters).split(gap)
            if apart is None:
                return [[t.id for t in model.tokenize(p)] for p in data]
            out: list[bytes] = []
            for e in bare.encode_batch_fast([gap.join(data[k : k + TOGETHER]) for k in range(0, len(data), TOGETHER)], add_special_tokens=False):
                ids = np.array(e.ids, dtype)
                raw, at = ids.tobytes(), (np.flatnonzero(ids == apart) * width).tolist()
                out += [raw[i:j] for i, j in zip([0, *(k + width for k in at)], [*at, len(raw)], strict=True)]
            return out

        def pack(ids: list[int] | bytes) -> bytes:
            return ids if isinstance(ids, bytes) else struct.pack(f"<{len(ids)}{code}", *ids)

        _LOADED[path] = Encoder(many, special, pack, b"".join, REMEMBER_BYTES), width
    return _LOADED[path]


def _bucketed(docs: DataFrame, n: int) -> DataFrame:
    """A ``bucket`` from 0 to n - 1 that ascends with doc_id, from quantiles of the doc_ids (a scan of one column)."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    if not cuts:
        return docs.withColumn("bucket", F.lit(0))
    marks = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    return docs.withColumn("bucket", F.coalesce(F.size(F.filter(marks, lambda c: c < F.col("doc_id"))), F.lit(0)))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files below ``path``; returns the manifest: bucket, file, n_docs, n_tokens."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    n = files or parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _bucketed(rows, n).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = library_encoder(vocabulary)
        dtype = np.dtype(f"<u{width}")
        end = np.array([end_id], dtype)
        fs, base = open_fs(path)
        fs.create_dir(base, recursive=True)
        bucket, out, done = None, None, []

        def close() -> None:
            writer, sink, part, name = out
            writer.close()
            sink.close()
            fs.move(part, f"{base}/{name}")
            done.append((bucket, name, len(writer.index), sum(x[2] for x in writer.index)))

        for b in batches:
            at = 0
            for texts in in_slices(b.column(1).to_pylist()):
                ids, buckets = b.column(0).slice(at, len(texts)).to_pylist(), b.column(2).slice(at, len(texts)).to_pylist()
                at += len(texts)
                for doc_id, k, found in zip(ids, buckets, encoder.encode_all(texts), strict=True):
                    if k != bucket:
                        if out:
                            close()
                        bucket, name = k, f"tokens-{k:06d}.zst"
                        part = f"{base}/_{name}.{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(part)
                        out = Writer(sink, width), sink, part, name
                    out[0].add(doc_id, np.concatenate([np.frombuffer(b"".join(found), dtype), end]))
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["bucket", "file", "n_docs", "n_tokens"])

    return written(rows.mapInArrow(run, "bucket long, file string, n_docs long, n_tokens long"), "token-manifest")[0]


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    listed, start = [], 0
    for r in sorted(manifest.collect()):  # a row for each file
        listed.append((r["file"], start))
        start += r["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(path)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as source:
                    r = Reader(source)
                    sums = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in range(len(r.ids))]
                yield pa.RecordBatch.from_arrays([pa.array(r.ids, pa.int64(), mask=r.null), pa.array(first + np.cumsum(r.counts) - r.counts, pa.int64()), pa.array(r.counts, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(listed, "file string, start long").repartition(len(listed)).mapInArrow(run, schema)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    return read_tokens(spark, path, write_tokens(table(spark, sf_dir, "documents"), path))

"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of two rows of a hashed table, one for the word and one for its
first four letters. Filters of widths 1, 2 and 3 run over the words; each keeps its maximum over
the whole text; a logistic layer follows. Since filters are linear in the embeddings, scoring
adds up rows of a precomputed table and never multiplies matrices.

The score is calibrated (Platt) on documents that were left out of the fit, so that 0.7 is a fair
threshold for all; ``thresholds`` holds thresholds by language besides, calibrated on the same
documents. Language, source, doc_id and labels are never inputs of the score.

The model is fitted on at most ``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other labelled
documents of at most ``MAX_TRAIN_BYTES`` bytes each, those with the smallest hash of doc_id.

Defined results: a null or empty text has no words and gets the score of an empty text; rows
without a label are scored alike; repeated rows are scored one by one; a doc_id labelled more than
once counts as toxic if any label says so; null labels are ignored; without both classes among the
labels every score is the share of toxic labels (0 without labels); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_POSITIVE, MAX_NEGATIVE, MAX_TRAIN_BYTES = 1500, 3000, 200_000
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 4, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.02
THRESHOLD = 0.7
#: Columns of the table of responses: each filter takes one for each word of its width.
_COLUMNS = FILTERS * sum(WIDTHS)
_PAD = max(WIDTHS) - 1
_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_SPACES).split()


def hashes(word: bytes) -> tuple[int, int]:
    head = word.decode("utf-8", "replace")[:4].encode()
    return zlib.crc32(word) % BUCKETS, zlib.crc32(head, 7) % BUCKETS


class Model:
    """Parameters; ``constant`` is set instead where there was nothing to learn."""

    def __init__(self, embedding=None, filters=None, bias=None, weight=None, offset=0.0, constant: float | None = None):
        self.embedding, self.filters, self.bias, self.weight, self.offset, self.constant = embedding, filters, bias, weight, offset, constant
        self.slope, self.shift, self.thresholds = 1.0, 0.0, {}

    def responses(self) -> np.ndarray:
        """What each bucket adds to each place of each filter."""
        return np.concatenate([self.embedding @ f for width in self.filters for f in width], axis=1).astype(np.float32)


def _columns(width_at: int, place: int) -> slice:
    first = FILTERS * (sum(WIDTHS[:width_at]) + place)
    return slice(first, first + FILTERS)


def pooled(rows: np.ndarray, starts: np.ndarray, bias: list[np.ndarray], positions: bool = False):
    """The maximum of each filter over each text, and where it was. ``rows``: responses of all words, each text followed by a padding of zeros."""
    values, places = [], []
    for k, width in enumerate(WIDTHS):
        n = len(rows) - width + 1
        z = rows[:n, _columns(k, 0)].copy()
        for place in range(1, width):
            z += rows[place : place + n, _columns(k, place)]
        best = np.maximum.reduceat(z, starts, axis=0)
        values.append(best + bias[k])
        if positions:
            ends = np.append(starts[1:], n)
            places.append(np.stack([s + z[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)]))
    return np.concatenate(values, 1), places


def _fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss; gradients flow through the maxima only, so an update touches few rows of the table."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for (a, b), label in zip(docs, y, strict=True):
        np.add.at(seen[int(label)], np.unique(np.concatenate([a, b])), 1)
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    embedding = rng.normal(0, 0.05, (BUCKETS, SIZE)).astype(np.float32)
    embedding[:, 0] = np.where(seen.sum(0) >= 2, odds, 0) / 4  # start from each bucket's log odds
    filters = [[rng.normal(0, 0.3, (SIZE, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
    for width in filters:
        width[0][0, :] += 0.5
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weight, offset = np.full(FILTERS * len(WIDTHS), 0.3, np.float32), np.float32(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)) - 1)
    model = Model(embedding, filters, bias, weight, offset)
    moments: dict = {}
    step = 0

    def adam(key, value, grad):
        m, v = moments.get(key, (0.0, 0.0))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        moments[key] = m, v
        return value - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    second = np.zeros(BUCKETS, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            part = order[at : at + BATCH]
            step += 1
            a, b, starts = _joined([docs[k] for k in part])
            e = embedding[a] + embedding[b]
            e[a < 0] = 0
            rows = np.concatenate([e @ f for width in filters for f in width], axis=1)
            h, places = pooled(rows, starts, bias, True)
            on = h > 0
            score = _sigmoid((h * on) @ model.weight + model.offset)
            d = (score - y[part]) / len(part)
            dh = d[:, None] * model.weight * on
            d_rows, at_rows = [], []
            for k, width in enumerate(WIDTHS):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                for place in range(width):
                    where = np.minimum(places[k] + place, len(a) - 1)
                    x = e[where]  # documents, filters, embedding
                    filters[k][place] = adam((k, place), filters[k][place], np.einsum("df,dfs->sf", g, x))
                    d_rows.append((g[:, :, None] * filters[k][place].T[None]).reshape(-1, SIZE))
                    at_rows.append(where.reshape(-1))
                bias[k] = adam(("b", k), bias[k], g.sum(0))
            model.weight = adam("w", model.weight, ((h * on) * d[:, None]).sum(0))
            model.offset = adam("o", model.offset, d.sum())
            grads, where = np.concatenate(d_rows), np.concatenate(at_rows)
            for hashed in (a, b):
                k = hashed[where]
                ok = (k >= 0) & (np.abs(grads).max(1) > 0)
                if not ok.any():
                    continue
                used, back = np.unique(k[ok], return_inverse=True)
                total = np.zeros((len(used), SIZE), np.float32)
                np.add.at(total, back, grads[ok])
                second[used] += (total * total).mean(1)
                embedding[used] -= 0.1 * total / (np.sqrt(second[used])[:, None] + 1e-6)
    return model


def _joined(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one behind the other, each followed by padding (-1), and where each starts."""
    pad = np.full(_PAD, -1, np.int64)
    starts = np.cumsum([0, *(len(a) + _PAD for a, _ in docs[:-1])])
    return np.concatenate([x for a, _ in docs for x in (a, pad)]), np.concatenate([x for _, b in docs for x in (b, pad)]), starts


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], y: list[int], langs: list[str | None]) -> Model:
    """Fit on four fifths of the documents, calibrate score and thresholds on the rest."""
    if not texts or min(y) == max(y):
        return Model(constant=float(np.mean(y)) if y else 0.0)
    y = np.array(y, float)
    docs = []
    for t in texts:
        pairs = np.array([hashes(w) for w in words_of(t)], np.int64).reshape(-1, 2)
        docs.append((pairs[:, 0], pairs[:, 1]))
    rest = np.arange(len(y)) % 5 == 4
    if len(set(y[rest])) < 2 or len(set(y[~rest])) < 2:
        rest = np.zeros(len(y), bool)
    model = _fit([d for d, r in zip(docs, rest, strict=True) if not r], y[~rest])
    held = np.flatnonzero(rest) if rest.any() else np.arange(len(y))
    a, b, starts = _joined([docs[k] for k in held])
    table_ = np.vstack([model.responses(), np.zeros((1, _COLUMNS), np.float32)])
    h, _ = pooled(table_[a] + table_[b], starts, model.bias)
    raw, t = np.maximum(h, 0) @ model.weight + model.offset, y[held]
    for _ in range(200):  # Platt's two parameters, pulled a little towards the identity
        p = _sigmoid(model.slope * raw + model.shift)
        model.slope -= 0.05 * (((p - t) * raw).mean() + 0.001 * (model.slope - 1))
        model.shift -= 0.05 * (p - t).mean()
    model.slope = max(model.slope, 0.1)
    p = _sigmoid(model.slope * raw + model.shift)
    for lang in {langs[k] for k in held} - {None}:
        mine = np.array([langs[k] == lang for k in held])
        cuts = np.unique(np.append(p[mine], THRESHOLD))
        f1 = [2 * ((p[mine] >= c) & (t[mine] == 1)).sum() / max(1, (p[mine] >= c).sum() + t[mine].sum()) for c in cuts]
        best = np.flatnonzero(np.array(f1) == max(f1))
        model.thresholds[lang] = float(min(cuts[best], key=lambda c: abs(c - THRESHOLD))) if t[mine].any() else THRESHOLD
    return model


def training_sample(docs: DataFrame, labels: DataFrame, allowed: Column) -> list:
    """(text, toxic, lang) of a bounded sample of the labelled rows for which ``allowed`` (of doc_id) holds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.where("toxic >= 1").orderBy(*order).limit(MAX_POSITIVE).unionByName(known.where("toxic < 1").orderBy(*order).limit(MAX_NEGATIVE)).collect()
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame([(r[0], int(r[1] >= 1)) for r in ids], "doc_id long, toxic int")  # at most MAX_POSITIVE + MAX_NEGATIVE rows
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("lang").cast("string").alias("lang")).where(F.octet_length("text") <= MAX_TRAIN_BYTES)
    return sorted(tuple(r) for r in rows.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id"), "doc_id", "text", "toxic", "lang").dropDuplicates(["doc_id"]).collect())


_MEMO: dict = {}
#: Most words a worker remembers.
REMEMBER = 400_000


class Scorer:
    """Scores texts; remembers the row of each word's summed responses."""

    def __init__(self, model: Model):
        self.model, self.base, self.known = model, model.responses(), {}
        self.rows = np.zeros((REMEMBER + 1, _COLUMNS), np.float32)  # row 0: padding

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Of texts with REMEMBER words together at most, unless it is one text."""
        m = self.model
        if m.constant is not None:
            return np.full(len(texts), m.constant)
        split = [words_of(t) for t in texts]
        distinct = set().union(*split)
        if len(self.known) + len(distinct) >= REMEMBER:
            self.known.clear()
            if len(distinct) >= len(self.rows):
                self.rows = np.zeros((len(distinct) + 1, _COLUMNS), np.float32)
        if new := [w for w in distinct if w not in self.known]:
            pairs = np.array([hashes(w) for w in new])
            first = len(self.known) + 1
            self.rows[first : first + len(new)] = self.base[pairs[:, 0]] + self.base[pairs[:, 1]]
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        get, ids, lengths = self.known.__getitem__, [], []
        for w in split:
            ids += map(get, w)
            ids += (0,) * _PAD
            lengths.append(len(w) + _PAD)
        ids = np.array(ids)
        starts = np.cumsum([0, *lengths[:-1]])
        h, _ = pooled(self.rows[ids], starts, m.bias)
        return _sigmoid(m.slope * (np.maximum(h, 0) @ m.weight + m.offset) + m.shift)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score and toxic (score against the language's threshold) of each row of ``docs``; a map, without any shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            scores, held, size = [], [], 0
            for t in b.column(1):
                held.append(t.as_py() or b"")
                size += len(held[-1])
                if size > 1_000_000:
                    scores.append(scorer.score(held))
                    held, size = [], 0
            if held:
                scores.append(scorer.score(held))
            score = np.concatenate(scores) if scores else np.zeros(0)
            langs = b.column(2).to_pylist()
            toxic = [bool(s >= sent.value.thresholds.get(x, THRESHOLD)) for s, x in zip(score, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array(toxic, pa.bool_())], names=["doc_id", "lang", "score", "toxic"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, score double, toxic boolean")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = training_sample(docs, labels, ~held_out(F.col("doc_id")))
    model = fit([r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows])
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxic").alias("toxic_by_language"))

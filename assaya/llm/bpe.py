"""Byte-level BPE: an encoder that works as a bounded-lookahead transducer, and an incremental decoder.

A text is fed to a ``Stream`` in pieces of ``PIECE`` characters. What can no longer change leaves it
at once: everything before a space between two other characters, since no pretoken spans such a
place; in a stretch without one, every pretoken that ends well before what has been fed; and inside
a pretoken that does not end, every token that ends a lookahead before it (``Transducer``). So a
stream holds a constant number of characters, whatever the text.

``Merges`` is a merge list. Its sufficient lookahead is computed once: a merge may be undone by
what follows only through a chain of merges of ever higher priority, each of which takes one of
the pieces of the merge before it as its left half; the longest such chain bounds the bytes that
can matter. Pretokens that have left a stream are merged in batches, and frequent ones are
remembered up to ``REMEMBER_BYTES``.

Defined results: a null text is empty and has no ids; repeated rows are encoded one by one; null
doc_ids are carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The pretoken pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: About the bytes that each of two generations of remembered pieces may take in a worker.
REMEMBER_BYTES = 64_000_000
#: About the bytes that a worker keeps of them from one task to the next; workers stay while other stages run.
KEEP_BYTES = 16_000_000
#: Characters fed to a stream at a time; a stretch of as many without a safe cut is cut at pretokens.
PIECE = 1 << 14
#: Characters that have left the streams of a worker and are merged together.
AT_ONCE = 1_000_000
#: Marks that are cut from a word's end without a look at the pattern.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NEVER = 1 << 60
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself if printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list over bytes: ``ranks`` has (left id, right id) -> (rank, merged id), ``bytes_of`` the bytes of each id."""

    def __init__(self, byte_ids: list[int], pairs: list[tuple[int, int, int]], bytes_of: dict[int, bytes], special: dict[str, int] | None = None):
        self.byte_ids, self.bytes_of, self.special = byte_ids, bytes_of, special or {}
        self.ranks = {}
        for rank, (a, b, to) in enumerate(pairs):
            self.ranks.setdefault((a, b), (rank, to))
        self._keys = None
        self.lookahead = self._lookahead(pairs)
        self.longest = max(map(len, bytes_of.values()))

    @classmethod
    def from_file(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        vocab = found["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        pairs = []
        for m in found["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.append((vocab[a], vocab[b], vocab[a + b]))
        special = {t["content"]: t["id"] for t in found["added_tokens"]}
        bytes_of.update({i: t.encode() for t, i in special.items()})
        return cls([vocab[c] for c in letters], pairs, bytes_of, special)

    def _lookahead(self, pairs) -> int:
        best: dict[int, int] = {}  # left half -> longest chain that starts with such a merge
        halves: dict[int, list[int]] = {}  # id -> the ids that it is merged from
        most = max(map(len, self.bytes_of.values()))
        for a, b, to in pairs:
            within, todo = {a, b}, [a, b]  # every id in its derivation
            while todo:
                new = [x for x in halves.get(todo.pop(), ()) if x not in within]
                within.update(new)
                todo += new
            chain = len(self.bytes_of[to]) + max(best.get(x, 0) for x in within)
            best[a] = max(best.get(a, 0), chain)
            halves.setdefault(to, []).extend((a, b))
            most = max(most, chain)
        return most

    def encode(self, data: bytes) -> list[int]:
        """BPE of one pretoken: the leftmost pair of the highest priority merges first."""
        return self._encode_long([self.byte_ids[b] for b in data])

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """BPE of many short pretokens at once: each round merges the best pair of every word that still has one."""
        out: list[list[int]] = [[]] * len(words)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            by.setdefault(n if n < 4 else -(-n // 4) * 4, []).append(k)
        if self._keys is None:
            keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
            order = np.argsort(keys)
            self._keys = keys[order]
            self._rank = np.array([r for r, _ in self.ranks.values()], np.int64)[order]
            self._to = np.array([t for _, t in self.ranks.values()], np.int64)[order]
        byte_ids = np.array(self.byte_ids, np.int64)
        for width, at in by.items():
            if not width:
                continue
            rows = np.array(at)
            length = np.array([len(words[k]) for k in at])
            raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in at]), np.uint8).reshape(-1, width)
            ids = byte_ids[raw]
            ids[np.arange(width) >= length[:, None]] = -1
            slot = self._find(ids[:, :-1], ids[:, 1:])
            while len(rows):
                if width > 1:
                    rank = np.where(slot >= 0, self._rank[slot], _NEVER)
                    best = rank.argmin(1)
                    each = np.arange(len(rows))
                    live = rank[each, best] < _NEVER
                else:
                    live = np.zeros(len(rows), bool)
                for k, n, w in zip(rows[~live].tolist(), length[~live].tolist(), ids[~live].tolist(), strict=True):
                    out[k] = w[:n]
                if not live.any():
                    break
                rows, ids, slot, length, best = rows[live], ids[live], slot[live], length[live] - 1, best[live]
                each, column = np.arange(len(rows)), np.arange(width)
                ids[each, best] = self._to[slot[each, best]]
                ids[:, :-1] = np.where(column[:-1] > best[:, None], ids[:, 1:], ids[:, :-1])
                ids[:, -1] = -1
                slot[:, :-1] = np.where(column[: width - 2] > best[:, None], slot[:, 1:], slot[:, :-1])
                slot[:, -1] = -1
                for k in (best - 1, best):
                    ok = (k >= 0) & (k < width - 1)
                    slot[each[ok], k[ok]] = self._find(ids[each[ok], k[ok]], ids[each[ok], k[ok] + 1])
        return out

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair is among the merges, or -1."""
        key = np.where((left < 0) | (right < 0), -1, left << 32 | right)
        k = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[k] == key, k, -1)

    def _encode_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := self.ranks.get((ids[k], ids[k + 1])))]
        heap = [(rank, k, to, a, b) for rank, to, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, k, to, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = to, -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if r := self.ranks.get((to, ids[after[k]])):
                    heapq.heappush(heap, (r[0], k, r[1], to, ids[after[k]]))
            if (p := before[k]) >= 0 and (r := self.ranks.get((ids[p], to))):
                heapq.heappush(heap, (r[0], p, r[1], ids[p], to))
        return [x for x in ids if x >= 0]


def in_slices(texts: list, most: int = 1_500_000) -> Iterator[list[str]]:
    """Runs of texts (null: empty) of about ``most`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Transducer:
    """Feed the bytes of one pretoken in pieces; ids come out once no later byte can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.most = 3 * merges.lookahead + merges.longest

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(data), self.most):
            self.held += data[k : k + self.most]
            if len(self.held) >= self.most:
                end, stable = 0, len(self.held) - self.merges.lookahead
                for i in self.merges.encode(self.held):
                    if end + len(self.merges.bytes_of[i]) > stable:
                        break
                    end += len(self.merges.bytes_of[i])
                    out.append(i)
                self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.encode(self.held), b""
        return out


class Decoder:
    """Ids to text, one at a time or in batches: bytes of an unfinished character wait for the next call."""

    def __init__(self, merges: Merges):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def segments(text: str, special: dict[str, int]) -> list[str]:
    """``text`` cut around special tokens (kept), as the tokenizers library does before all else."""
    if not any(s in text for s in special):
        return [text]
    return [x for x in re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if x]


def _odd(piece: str) -> bool:
    """Whether a piece has to be cut with care: nothing, or space at its ends."""
    return not piece or piece.strip() != piece


def _careful(piece: str) -> bool:
    """The same of a piece that may have the end of a line before it in place of a space."""
    return _odd(piece[1:] if piece[:1] == "\n" else piece)


def _key(pretoken: str) -> str:
    """A pretoken as a key: a word after a space is remembered as the piece that it is, others apart from all pieces, none of which has a NUL."""
    return pretoken[1:] if pretoken[0] == " " and not _odd(pretoken[1:]) and pretoken[1] != "\0" else "\0" + pretoken


class Encoder:
    """Whole texts to a list of what ``pack`` makes of the ids of each piece. Pieces and pretokens are remembered in two generations."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], special: dict[str, int], pack: Callable[[list[int]], object], join: Callable[[list], object], most: int = REMEMBER_BYTES):
        self.find = regex.compile(PATTERN).findall
        self.many, self.special, self.pack, self.join, self.most = encode_many, special, pack, join, most
        self.young: dict = {}
        self.old: dict = {}
        self.bytes = 0

    def _known(self, keys: set[str]) -> list[str]:
        """Bring what is remembered of ``keys`` into the young generation; the keys that are not known."""
        new, old = keys.difference(self.young), self.old
        if old:
            found = [k for k in new if k in old]
            self._learn(found, map(old.__getitem__, found))
            new.difference_update(found)
        return list(new)

    def _learn(self, keys: list, values) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.bytes += 300 * len(keys) + 8 * sum(map(len, keys))

    def _packed(self, groups: list[list[str]]) -> list:
        """What the ids of each group of pretokens pack to."""
        keys = {_key(t): t for g in groups for t in g}
        new = self._known(set(keys))
        self._learn(new, map(self.pack, self.many([keys[k] for k in new])))
        known = self.young
        return [known[_key(g[0])] if len(g) == 1 else self.join([known[_key(t)] for t in g]) for g in groups]

    def rest(self, keep: int = KEEP_BYTES) -> None:
        """A task is over: what is remembered goes if it is more than ``keep`` bytes."""
        if self.old or self.bytes > keep:
            self.young, self.old, self.bytes = {}, {}, 0

    def _learn_pieces(self, new: list[str]) -> None:
        """Learn pieces that are not known: words at once, words with marks behind them from the two, others by their pretokens."""
        words, marked, rest, groups = [], [], [], []
        for p in new:
            if p.isalpha():
                words.append(p)
            elif (core := p.rstrip(MARKS)).isalpha():
                marked.append((p, core, p[len(core) :]))
            elif not _careful(p):
                rest.append(p)
                if p[0] != "\n":
                    groups.append(self.find(" " + p))
                elif (core := p[1:].rstrip(MARKS)).isalpha():
                    groups.append(["\n", core, p[len(core) + 1 :]] if len(core) + 1 < len(p) else ["\n", core])
                else:
                    groups.append(["\n", *self.find(p[1:])])
        more = self._known({c for _, c, _ in marked}.difference(words))
        self._learn(words, map(self.pack, self.many([" " + w for w in words])))
        self._learn(more, map(self.pack, self.many([" " + w for w in more])))
        known, join = self.young, self.join
        tails = list({t for _, _, t in marked})
        marks = dict(zip(tails, self._packed([[t] for t in tails]), strict=True))
        self._learn([p for p, _, _ in marked], [join([known[c], marks[t]]) for _, c, t in marked])
        packed = self._packed(groups)
        several = [k for k, g in enumerate(groups) if len(g) > 1]
        self._learn([rest[k] for k in several], [packed[k] for k in several])

    def _pretokens(self, piece: str) -> list[str]:
        """The pretokens of a space and ``piece``; most pieces are a word, or one with a mark behind it."""
        if piece.isalpha():
            return [" " + piece]
        if (core := piece.rstrip(MARKS)).isalpha():
            return [" " + core, piece[len(core) :]]
        return self.find(" " + piece)

    def encode_all(self, texts: list[str]) -> list[list]:
        """What the ids of each text pack to, in a list; texts start and end at edges of pretokens."""
        if self.bytes > self.most:  # a new generation; never within a call, so that all of its pieces are in the young one
            self.young, self.old, self.bytes = {}, self.young, 0
        cut = [[] if "\0" in t else [s if s in self.special else self._split(s) for s in segments(t, self.special) if s] for t in texts]
        parts = [p for c in cut for p in c if not isinstance(p, str)]
        # A piece next to other space is never remembered: the text must be cut with care.
        firsts = [p[0] for p in parts if p[0] is not None]
        plain = iter(self._packed([self.find(p) for p in firsts if not _odd(p)]))
        heads = iter([None if _odd(p) else next(plain) for p in firsts])
        pieces = list(chain.from_iterable(p[1:] for p in parts))
        values = list(map(self.young.get, pieces))
        missing = [k for k, v in enumerate(values) if v is None]
        self._learn_pieces(self._known({pieces[k] for k in missing}))
        known = self.young
        for k in missing:
            values[k] = known.get(pieces[k])
        out: list[list] = []
        at = 0
        for text, c in zip(texts, cut, strict=True):
            got: list = []
            for p in c:
                if isinstance(p, str):
                    got.append(self.pack([self.special[p]]))
                else:
                    if p[0] is not None:
                        got.append(next(heads))
                    got += values[at : at + len(p) - 1]
                    at += len(p) - 1
            out.append(self._with_care(text) if None in got or "\0" in text else got)
        return out

    def _split(self, text: str) -> list:
        """``text`` cut at spaces and before ends of lines; the first piece is None if a space and another character come first.

        A piece that starts with the end of a line has no space before it. Where a space or nothing stands beside one, the text must be
        cut with care, and where lines are empty it is cut at spaces only.
        """
        if "\n" in text and "\n\n" not in text and text[0] != "\n":
            if text[-1] == "\n" or " \n" in text or "\n " in text:
                return [None, ""]
            text = text.replace("\n", " \n")
        elif " \n" in text:
            return [None, ""]
        pieces: list = text.split(" ")
        if not pieces[0] and len(pieces) > 1 and not _odd(pieces[1]):
            pieces[0] = None
        return pieces

    def _with_care(self, text: str) -> list:
        """A text with runs of white space: cut only at spaces between two other characters."""
        groups = []
        for s in segments(text, self.special):
            if s in self.special:
                groups.append([s])
            else:
                head, *tail = _CUT.split(s)
                groups += [self.find(head), *map(self._pretokens, tail)]
        fixed = {s: self.pack([i]) for s, i in self.special.items()}
        packed = iter(self._packed([g for g in groups if g[0] not in fixed]))
        return [fixed[g[0]] if g[0] in fixed else next(packed) for g in groups]


def transducing(merges: Merges) -> Callable[[list[str]], list[list[int]]]:
    """Encode pretokens: short ones together, those that a Transducer can emit before their end by one."""
    most = 3 * merges.lookahead + merges.longest

    def many(pretokens: list[str]) -> list[list[int]]:
        data = [p.encode("utf-8", "replace") for p in pretokens]
        short = [k for k, d in enumerate(data) if len(d) <= 40]
        out: list[list[int]] = [[]] * len(data)
        for k, ids in zip(short, merges.encode_many([data[k] for k in short]), strict=True):
            out[k] = ids
        for k, d in enumerate(data):
            if len(d) >= most:
                t = Transducer(merges)
                out[k] = t.feed(d)
                out[k] += t.finish()
            elif len(d) > 40:  # nothing is stable before the end
                out[k] = merges.encode(d)
        return out

    return many


_CLASSES = tuple(map(regex.compile, (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")))
_SPACES = _CLASSES[2]
_PRETOKEN = regex.compile(PATTERN)


class Stream:
    """The transducer of one text: ``feed`` its pieces; text that can no longer change comes out, or ids inside a pretoken that goes on."""

    def __init__(self, merges: Merges, special: dict[str, int], piece: int = PIECE):
        self.merges, self.special, self.piece = merges, special, max(piece, 8)
        self.margin = max([3, *map(len, special)])  # what a pretoken or a special token may need to see behind it
        self.spaced = [s for s in special if " " in s]
        self.held, self.open, self.run = "", None, None

    def _cut(self, text: str, limit: int) -> int:
        """The last place up to ``limit`` that no pretoken or special token spans, or 0."""
        k = limit + 1
        while (k := text.rfind(" ", 1, k)) > 0:
            if not text[k - 1].isspace() and not text[k + 1].isspace() and not any(s in text[max(0, k - len(s) + 1) : k + len(s) - 1] for s in self.spaced):
                return k
        return 0

    def _special(self, text: str) -> tuple[int, int]:
        """(start, end) of the first special token of ``text``; its length twice if there is none."""
        return min(((k, k + len(s)) for s in sorted(self.special, key=len, reverse=True) if (k := text.find(s)) >= 0), default=(len(text), len(text)), key=lambda x: x[0])

    def feed(self, piece: str, last: bool = False) -> list[str | list[int]]:
        out: list[str | list[int]] = []
        text, self.held = self.held + piece, ""
        fresh = False  # whether the open pretoken starts with ``text``
        while text:
            limit = len(text) - self.margin
            if self.run is None:
                if last:
                    out.append(text)
                    break
                if limit > 0 and (k := self._cut(text, limit)):
                    out.append(text[:k])
                    text = text[k:]
                if len(text) < self.piece + self.margin:
                    self.held = text
                    break
                limit, (stop, end) = len(text) - self.margin, self._special(text)
                if stop == 0:
                    out.append(text[:end])
                    text = text[end:]
                    continue
                upto = stop if stop < len(text) else limit
                ends = [m.end() for m in _PRETOKEN.finditer(text, 0, stop) if m.end() <= upto]
                closed = max((k for k in ends if k == stop < len(text) or not text[k - 1].isspace()), default=0)
                if closed:
                    out.append(text[:closed])
                    text = text[closed:]
                    continue
                if ends:  # space by itself would be cut in another way
                    out.append(self.merges.encode(text[: ends[0]].encode("utf-8", "replace")))
                    text = text[ends[0] :]
                    continue
                self.run, self.open = next(c for c in _CLASSES if c.fullmatch(text[limit - 1])), Transducer(self.merges)
                fresh = True
            stop, _ = self._special(text)
            found = self.run.match(text, int(fresh and text[0] == " " and self.run is not _SPACES), stop)
            end = found.end() if found else 0
            if stop == len(text) and not last and end > limit:
                limit = max(0, limit)
                out.append(self.open.feed(text[:limit].encode("utf-8", "replace")))
                self.held = text[limit:]
                break
            if self.run is _SPACES and end < stop:
                end -= 1  # the last space belongs to what follows
            out.append(self.open.feed(text[:end].encode("utf-8", "replace")) + self.open.finish())
            text, self.run, self.open = text[end:], None, None
        return out

    def finish(self) -> list[str | list[int]]:
        return self.feed("", True)


_LOADED: dict = {}


def _worker(path: str) -> tuple[Merges, Encoder]:
    """A Python worker keeps its vocabulary and remembered pieces from task to task."""
    if path not in _LOADED:
        merges = Merges.from_file(path)

        def pack(ids: list[int]) -> tuple[bytes, bytes]:
            return struct.pack(f"<{len(ids)}I", *ids), ",".join(map(str, ids)).encode()

        def join(packed: list) -> tuple[bytes, bytes]:
            return b"".join([x[0] for x in packed]), b",".join([x[1] for x in packed])

        _LOADED[path] = merges, Encoder(transducing(merges), merges.special, pack, join)
    return _LOADED[path]


def transduce(texts: Iterator[tuple[object, str]], path: str, piece: int = PIECE, at_once: int = AT_ONCE) -> Iterator[tuple[object, list]]:
    """(key, packed ids) of (key, text), in order; a long text's ids come in many turns and its key as often."""
    merges, encoder = _worker(path)
    queue: list[tuple[object, str | list[int]]] = []
    size = 0

    def flush() -> Iterator[tuple[object, list]]:
        found = iter(encoder.encode_all([x for _, x in queue if isinstance(x, str)]))
        for key, x in queue:
            yield key, next(found) if isinstance(x, str) else [encoder.pack(x)]
        queue.clear()

    for key, text in texts:
        stream = Stream(merges, merges.special, piece)
        queue.append((key, []))
        for k in range(0, len(text), piece):
            got = stream.feed(text[k : k + piece], k + piece >= len(text))
            queue += [(key, x) for x in got]
            size += min(piece, len(text) - k)
            if size >= at_once:
                yield from flush()
                size = 0
    yield from flush()


def encode_text(text: str, path: str | None = None, piece: int = PIECE) -> list[int]:
    return np.frombuffer(b"".join([x[0] for _, found in transduce(iter([(0, text)]), path or default_vocabulary(), piece) for x in found]), np.uint32).tolist()


class _Trip:
    """Counts, digests and decodes the ids of one text as they come."""

    def __init__(self, merges: Merges):
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)

    def take(self, packed: list) -> None:
        ids = np.frombuffer(b"".join([x[0] for x in packed]), np.uint32)
        if len(ids):
            self.ids.update(b"," * (self.n > 0) + b",".join([x[1] for x in packed if x[1]]))
            self.text.update(self.decoder.feed(ids.tolist()).encode())
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.finish().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def _round_trips(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, encoder = _worker(path)
        for b in batches:
            rows, trip, at = [], None, -1
            for k, packed in transduce(((k, t.as_py() or "") for k, t in enumerate(b.column(1))), path):
                if k != at:
                    rows += [trip.row()] if trip else []
                    trip, at = _Trip(merges), k
                trip.take(packed)
            rows += [trip.row()] if trip else []
            n, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.rest()

    return run


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``; a map, without any shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_round_trips(path or default_vocabulary()), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each row of ``docs``."""
    kind, path = docs.schema["doc_id"].dataType.simpleString(), path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode_text(t or "", path) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of ``rows`` (doc_id, ids)."""
    kind, path = rows.schema["doc_id"].dataType.simpleString(), path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = _worker(path)
        for b in batches:
            out = []
            for ids in b.column(1).to_pylist():
                d = Decoder(merges)
                steps = [d.feed(ids[k : k + PIECE]) for k in range(0, len(ids or ()), PIECE)]
                out.append("".join([*steps, d.finish()]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))

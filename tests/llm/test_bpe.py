import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from assaya.llm import bpe

LETTERS = ["a", " \0a", "\0", "b", "don't", "'re", "12", "é", "日本", "😀", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "!", "...", "<|endoftext|>", "<|endof"]


def random_text(rng):
    w = [rng.choice(LETTERS) for _ in range(rng.randrange(0, 40))]
    if rng.randrange(3) == 0:
        w[5:5] = [rng.choice(["a", " ", "7", "!", "\n", "é"])] * rng.randrange(20, 120)
    return "".join(w)


def test_streams_give_the_librarys_ids():
    library, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(5)
    for _ in range(800):
        text = random_text(rng)
        assert bpe.encode_text(text, piece=rng.choice([8, 13, 40, 1 << 14])) == library.encode(text, add_special_tokens=False).ids, text


def test_streams_hold_little_and_enter_the_transducer(monkeypatch):
    merges, encoder = bpe._worker(bpe.default_vocabulary())
    fed, plain = [], bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, data: fed.append(len(data)) or plain(self, data))
    for text in ("word " * 50_000, "x" * 300_000, "1a" * 100_000, " " * 200_000 + "a", "<|endoftext|>" * 20_000):
        stream, out = bpe.Stream(merges, merges.special), []
        for k in range(0, len(text), bpe.PIECE):
            out += stream.feed(text[k : k + bpe.PIECE], k + bpe.PIECE >= len(text))
            assert len(stream.held) <= 2 * bpe.PIECE and all(len(x) <= 2 * bpe.PIECE for x in out)
            assert stream.open is None or len(stream.open.held) <= 2 * stream.open.most
        assert sum(len(x) for x in out if isinstance(x, str)) + sum(len(b"".join(merges.bytes_of[i] for i in x)) for x in out if not isinstance(x, str)) == len(text)
    assert sum(fed) > 490_000


def test_remembered_bytes_are_bounded():
    encoder = bpe.Encoder(lambda words: [[len(w)] for w in words], {}, lambda ids: ids, lambda x: x, most=20_000)
    for k in range(200):
        encoder.encode_all([" ".join(f"w{k}x{j}" for j in range(50))])
        assert encoder.bytes <= 20_000 + 50 * 400
    assert len(encoder.young) + len(encoder.old) < 300


def test_pieces_are_learned_together_in_any_generation():
    """Words, words with a mark and others are learned in few calls, however little may be remembered."""
    library, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(7)
    calls = []
    many = bpe.transducing(bpe.Merges.from_file(bpe.default_vocabulary()))
    encoder = bpe.Encoder(lambda words: calls.append(len(words)) or many(words), {}, list, lambda x: sum(x, []), most=2_000)
    words = ["tree", "Haus", "niño.", "niño", "a,", "'re", "x1", "don't", "été!", "tab\tbed", "%%%", "end..", "\x1ca", "b\x1c", "ﬁ", "²."]
    for _ in range(60):
        texts = [rng.choice([" ", "  ", ""]) + rng.choice([" ", " ", "  "]).join(rng.choice(words) + rng.choice(["", "q" * rng.randrange(9)]) for _ in range(rng.randrange(30))) for _ in range(8)]
        calls.clear()
        for text, found in zip(texts, encoder.encode_all(texts), strict=True):
            assert sum(found, []) == library.encode(text, add_special_tokens=False).ids, text
        assert len(calls) <= 5 + len(texts)


def test_workers_keep_little_from_one_task_to_the_next(monkeypatch):
    monkeypatch.setattr(bpe, "_LOADED", {})
    batch = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    encoder = bpe._worker(bpe.default_vocabulary())[1]
    for words, held in ((100, True), (60_000, False)):
        list(bpe._round_trips(bpe.default_vocabulary())(iter([batch([" ".join(f"{words}w{k}" for k in range(words))])])))
        assert bool(encoder.young) == held and encoder.bytes <= bpe.KEEP_BYTES


def test_few_calls_for_a_new_word():
    """Each new word took several Python functions of its own, the most part of the CPU time."""
    from assaya.llm import tokenfile

    encoder, _ = tokenfile.library_encoder(bpe.default_vocabulary())
    text = " ".join("".join(chr(97 + int(c)) for c in str(10**6 + k)) + ["", ","][k % 2] for k in range(20_000))
    encoder.encode_all(["a, b"])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        encoder.encode_all([text])
    finally:
        sys.setprofile(None)
    assert calls < 3 * 20_000


def test_words_at_ends_of_lines_need_no_pattern():
    """A word, marks, the end of a line and the next word were one piece, which the pattern had to cut; words went to the library one by one."""
    from assaya.llm import tokenfile

    library, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(8)
    encoder, _ = tokenfile.library_encoder(bpe.default_vocabulary())
    ids = lambda found: np.frombuffer(b"".join(found), "<u2").tolist()
    parts = ["\n", " ", ".\n", "***", "é", "\n\n", " \n", "\n ", "x", "Été", "'s", "' ", "\r\n", "\t", "12", "ÿ", "<|endoftext|>", "\0", "\u2028", "word "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for text, found in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids(found) == library.encode(text, add_special_tokens=False).ids, repr(text)
    calls, find, many = [], encoder.find, encoder.many
    word = lambda k: "".join(chr(97 + int(c)) for c in str(10**6 + k))
    text = " ".join(f"{word(2 * k)}.\n{word(2 * k + 1)}***" for k in range(500))
    try:
        encoder.find = lambda t: calls.append(t) or find(t)
        assert ids(encoder.encode_all([text])[0]) == library.encode(text, add_special_tokens=False).ids
    finally:
        encoder.find = find
    assert len(calls) == 1  # the first piece
    assert all(isinstance(x, bytes) for x in many([" tree", "\n", "ÿ"])) and b"".join(many([" tree", "\n", "ÿ"])) == np.array(library.encode(" tree\nÿ").ids, "<u2").tobytes()


def test_round_trips_of_random_texts(spark):
    library, rng = Tokenizer.from_file(bpe.default_vocabulary()), random.Random(6)
    texts = [None, "", *(random_text(rng) for _ in range(60)), "ab " * 30_000 + "c" * 30_000]
    rows = [(k // 2, t) for k, t in enumerate(texts)] + [(None, "null id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.round_trips(docs).collect()), key=repr) == sorted(want, key=repr)

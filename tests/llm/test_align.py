import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assaya.llm import align

PIECES = ["a", "the", "ing", " ", "  ", "\n", "\t", "\r\n", "\x1c", "　", " ", "é", "é", "ß", "中文", "'s", "12", "<|endoftext|>", "<s>", "<0x41>", "!?", "😀", "\0", "ﬁ", "Z.", "—"]


def texts_of(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def plain(texts):
    """Tokens of whole texts by the libraries, all pairs of tokens tried for overlap."""
    paths = align.default_vocabularies()
    e = align.Encoders(*paths)
    docs = []
    for t in texts:
        spans = []
        if t:
            for ids, names in ((e.a.encode(" " + t, add_special_tokens=False).ids, e.a_bytes), (e.b.encode(t), e.b_bytes)):
                at, side = 0, []
                for k in ids:
                    side.append((k, at, at + len(names[k])))
                    at += len(names[k])
                spans.append(side if b"".join(names[k] for k in ids) == (" " + t).encode() else None)
        docs.append(spans if spans and None not in spans else ([], []))
    links = [[(a, b) for a, s, t in x for b, u, v in y if s < v and u < t] for x, y in docs]
    counts = Counter(p for d in links for p in d)
    highest = {b: max(n for (_, c), n in counts.items() if c == b) for _, b in counts}
    out = []
    for (x, y), mine in zip(docs, links, strict=True):
        common = sorted({t for _, _, t in x} & {v for _, _, v in y})
        groups, start = [], 0
        for end in common:
            groups.append("|".join(",".join(str(k) for k, s, t in side if start <= s and t <= end) for side in (x, y)))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((len(x), len(y), len(common), len(mine), sum(counts[p] == highest[p[1]] for p in mine), sum(counts[p] for p in mine), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("most", "events"), [(1_000_000, 8192), (40, 3), (0, 1)])
def test_against_all_pairs_of_tokens(spark, monkeypatch, most, events):
    monkeypatch.setattr(align, "EVENTS", events)
    monkeypatch.setattr(align, "LINKS_AT_ONCE", 5 * events)
    monkeypatch.setattr(align, "COUNT_AT_ONCE", 20 * events)
    texts = [*texts_of(150), None, "", " ", "  ", "a ", "the ▁ x", "xy" * 200, *texts_of(20)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, code int").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(df, most_pairs=most).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_units_give_the_libraries_ids():
    e = align.Encoders(*align.default_vocabularies())
    texts = texts_of(6000, seed=9)
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, found in zip(part, e.encode_all(part), strict=True):
            assert (found is None) == (e._both([" " + t])[0] is None), repr(t)
            if found:
                assert np.frombuffer(found[0], "<u2").tolist() == e.a.encode(" " + t, add_special_tokens=False).ids, repr(t)
                assert np.frombuffer(found[1], "<u2").tolist() == e.b.encode(t), repr(t)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), *(r[c] for c in COLUMNS)) for r in align.align(df).collect())
    want = plain(["one two"] * 3)[0]
    assert got == [(0, *want), (1, *want), (1, *want), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align.align(df.where("false")).collect() == []


def test_words_go_to_the_model_together(monkeypatch):
    """Each new unit went through the whole library and had its bytes compared by itself."""
    e = align.Encoders(*align.default_vocabularies())
    texts = ["tree. Haus, niño*** été été  x1 don't  ", "a<|endoftext|>b <s> \n12", "x" * 300, "the\nend.\nEnd ▁ it", "日本 語。 😀 ÿ ", "   "]
    want = [e._whole(" " + t) for t in texts]
    assert want[3] is None and want[0]
    calls, plain = [], e.a
    e.a = type("Counted", (), {"encode_batch": lambda self, units, **k: calls.extend(units) or plain.encode_batch(units, **k), "encode": lambda self, *x, **k: plain.encode(*x, **k)})()
    assert e.encode_all(texts) == want == e.encode_all(texts)
    assert calls == [" a<|endoftext|>b"]

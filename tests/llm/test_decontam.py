import hashlib
import random
import re

import pytest

from assaya.llm import decontam

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, window):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item_id, text in items:
            q = words(text)
            n = min(window, len(q))
            for s in range(len(q) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == q[s : s + n]:
                        hit |= set(range(k, k + n))
                        found.add(item_id)
        ids = sorted(i for i in found if i is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def frames(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    return docs, spark.createDataFrame(items, "item_id string, text string")


def judged(rows):
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize(("shard_bytes", "block_bytes"), [(2_000_000, 4_000_000), (200, 120), (1, 1)])
def test_against_brute_force(spark, shard_bytes, block_bytes):
    rng = random.Random(shard_bytes)
    some = lambda n: " ".join(rng.choice(["a", "B", "c,", "é", "d1"]) for _ in range(rng.randrange(n)))
    texts = [None, "", " ,. ", *(some(60) for _ in range(30))]
    texts += [texts[9], texts[9]]
    items = [(None if k == 3 else str(k % 9), some(9)) for k in range(12)] + [("n", None), ("e", ""), ("7", "a B c")]
    docs, bench = frames(spark, texts, items)
    got = judged(decontam.judge(docs, bench, 4, shard_bytes, block_bytes))
    assert got == brute(texts, items, 4)
    spans = {(r.doc_id, r.item_id, r.first_word, r.end_word) for r in decontam.matches(docs, bench, 4, None, shard_bytes, block_bytes).collect()}
    assert {s[0] for s in spans} == {k for k, x in enumerate(got) if x[4]}


def test_many_short_documents_in_a_shard(spark):
    item = "one two three four five six seven eight nine ten"
    texts = [None if k % 3 == 0 else "" if k % 3 == 1 else "a word" for k in range(70_000)] + [item]
    docs, bench = frames(spark, texts, [("q", item)])
    got = [r for r in decontam.judge(docs, bench).where("contaminated or n_items > 0").collect()]
    assert [(r.doc_id, r.n_hit, r.n_items) for r in got] == [(70_000, 10, 1)]


def test_neighbours_in_a_shard_are_apart(spark):
    docs, bench = frames(spark, ["x a b", "c d y", "", "a b c d", "a b c d"], [("q", "a b c d")])
    assert [x[1] for x in judged(decontam.judge(docs, bench, 4))] == [0, 0, 0, 4, 4]
    near = decontam.matches(docs, bench, 4, slop=3).collect()
    assert {(r.doc_id, r.first_word, r.end_word) for r in near} == {(3, 0, 4), (4, 0, 4)}


def test_clean_documents_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", 7), (1, "other", 7), (None, "a b c", 7), (None, None, 7), (2, "x", 7)], "doc_id long, text string, key int")
    bench = spark.createDataFrame([("q", "a b c")], "item_id string, text string")
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (1, "other"), (2, "x")]
    assert decontam.clean(docs.where("false"), bench).count() == 0 and decontam.clean(docs, bench.where("false")).count() == 5

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest

from assaya.llm import packing


def best(lengths, capacity):
    """The fewest sequences, by trying all."""

    @cache
    def of(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        found = []
        for mask in range(1 << len(others)):
            mine = [x for k, x in enumerate(others) if mask >> k & 1]
            if first + sum(mine) <= capacity:
                found.append(1 + of(tuple(x for k, x in enumerate(others) if not mask >> k & 1)))
        return min(found)

    return of(tuple(sorted(lengths, reverse=True)))


def bins_of(plan, counts, capacity):
    """What the plan puts where; every piece has a place, without gap or overlap."""
    lengths, ranks, firsts, each, offsets = plan.arrays()
    keys, bins = packing._key(lengths, ranks), {}
    for length, n in counts.items():
        rank = np.arange(n)
        at = np.searchsorted(keys, packing._key(np.full(n, length), rank), side="right") - 1
        assert (lengths[at] == length).all()
        for k, place, size in zip(firsts[at] + (rank - ranks[at]) // each[at], offsets[at] + (rank - ranks[at]) % each[at] * length, [length] * n, strict=True):
            bins.setdefault(int(k), []).append((int(place), size))
    for held in bins.values():
        at = 0
        for place, size in sorted(held):
            assert place == at
            at += size
        assert at <= capacity
    assert sorted(bins) == list(range(plan.bins))
    return bins


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(5)
    fixed = 0
    for _ in range(400):
        capacity = rng.choice((10, 17, 30))
        low = rng.choice((1, 2, capacity // 4))
        lengths = [rng.randint(low, capacity) for _ in range(rng.randint(1, 9))]
        plan = packing.Plan(Counter(lengths), capacity)
        bins = bins_of(plan, Counter(lengths), capacity)
        rest = [size for k, held in bins.items() if k >= plan.fixed for _, size in held]
        assert plan.fixed + best(rest, capacity) == best(lengths, capacity)
        fixed += plan.fixed
    assert fixed > 600


@pytest.mark.parametrize("capacity", [64, 2048])
def test_many_pieces_by_counts(capacity):
    rng = random.Random(capacity)
    for _ in range(5):
        lengths = [min(capacity, int(rng.lognormvariate(3, 1.3)) + 1) for _ in range(20_000)]
        counts = Counter(lengths)
        plan = packing.Plan(counts, capacity)
        bins_of(plan, counts, capacity)
        assert plan.least <= plan.bins <= plan.least + 1 + sum(n for k, n in counts.items() if 2 * k > capacity)
        assert len(plan.rows) < 8 * capacity
    assert packing.Plan({}, capacity).bins == 0
    hot = packing.Plan({5: 10**12, capacity: 10**9}, capacity)
    assert hot.bins == 10**9 + -(-(10**12) // (capacity // 5))


def odd_texts():
    rng = random.Random(8)
    marks = ["a", "B", " ", "\n", "\t", "\x1c", " ", " ", "é", "é", "Σ", "İ", "ß", "中", "'s", "'S", "1", "<|endoftext|>", "<|ENDOFTEXT|>", "!?", "😀", "\0", "ﬁ"]
    return ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "x" * 3000, "one two " * 700, "n" * 150 + " m" * 60]


def test_latin_words_go_straight_to_the_model():
    """Whole calls of the library for each few words were the most part of the CPU time."""
    words = packing.Words(packing.default_vocabulary())
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    each = [w for c in letters for w in (c, f"x{c}", f"{c}B{c}", f"{c}y.")]
    want = [np.array(e.ids, words.dtype).tobytes() for e in words.tokenizer.encode_batch(each, add_special_tokens=False)]
    assert words.encode_all([w.encode() for w in each]) == want
    plain, words.tokenizer = [w.encode() for w in each if "\u0130" not in w], None
    words.known = {}
    assert words.encode_all(plain) == [x for w, x in zip(each, want, strict=True) if "\u0130" not in w]


def test_pieces_are_the_library_s_ids(spark):
    from tokenizers import Tokenizer

    texts = odd_texts()
    df = spark.createDataFrame([(k % 400, t, "x", 1) for k, t in enumerate(texts)] + [(None, "no id", "x", 1)], "doc_id long, text string, ids string, task int").repartition(6)
    packed, plan = packing.pack(df, capacity=64)
    got = [r.asDict() for r in packed.collect()]
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for k, t in [*((k % 400, t) for k, t in enumerate(texts)), (None, "no id")]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for n in range(0, len(ids), 64):
            part = np.array(ids[n : n + 64], "<u4").tobytes()
            want[k, n // 64, n, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sorted(whole) == list(range(plan.bins)) and plan.bins <= plan.least + 1
    for r in got:
        ids = np.frombuffer(whole[r["sequence_id"]].ids, "<u2")
        assert len(ids) <= 64 and zlib.crc32(ids[r["offset"] : r["offset"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
    assert sum(len(r.ids) // 2 for r in whole.values()) == sum(r["length"] for r in got)
    assert packing.pack(df.where("false"))[0].collect() == []

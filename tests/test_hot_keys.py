import random
import time

import pytest

from assaya.operators import behavior, wording

from .test_core import slots
from .test_whole import edits

EVENT = "id string, actor string, t_us long, content_hash string, semantic_hash string, template_key string, domain string"


@pytest.mark.parametrize("actors", [2, 7, 40])
def test_edges_of_hot_keys_against_a_scan(spark, actors):
    rng = random.Random(actors)
    rows = [(f"{k:05d}", str(rng.randrange(actors)), rng.randrange(900), rng.choice("aaab")) for k in range(700)]
    df = spark.createDataFrame([(i, a, t, k, None, None, "d") for i, a, t, k in rows], EVENT).repartition(6)
    for window in (3, 25, 400):
        got = {(r.left_id, r.right_id) for r in behavior.edges(df, window).collect()}
        assert got == slots(rows, window)


def test_only_accepted_events_link(spark):
    rows = [("a", "x", 1, "k"), ("a", "y", 2, "k"), (None, "z", 3, "k"), ("", "z", 3, "k"), ("b", "", 4, "k"), ("b", "w", 5, "k"), ("c", "w", 6, "k"), ("d", "v", None, "k")]
    df = spark.createDataFrame([(i, a, t, k, None, None, "d", n) for n, (i, a, t, k) in enumerate(rows)], EVENT + ", pos int")
    assert [tuple(r) for r in behavior.edges(df, 100).collect()] == [("a", "c", "content-hash")]
    assert [tuple(r)[:3] for r in behavior.clusters(df, 100).collect()] == [("a", "a,c", "w,x")]
    assert behavior.edges(df.drop("pos").where("id = 'a'"), 100).collect() == []


def test_one_key_takes_time_in_proportion(spark):
    def seconds(n):
        df = spark.createDataFrame([(f"{k:06d}", str(k % 5000), k, "k", None, None, "d") for k in range(n)], EVENT)
        began = time.perf_counter()
        assert behavior.edges(df, 10 * n).count() == n - 1
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(20_000) < 60
    names = spark.createDataFrame([(f"@scope/pkg{k:05d}x",) for k in range(4000)], "name string")
    began = time.perf_counter()
    assert wording.nearest_declared(names, names).where("distance = 0 and name = declared").count() == 4000
    assert time.perf_counter() - began < 60


def test_short_and_long_names_against_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcd") for _ in range(62))
    names = {base[: rng.randrange(0, 4)] for _ in range(9)}
    for n in (62, 64, 65, 67, 70):
        whole = base + "wxyzwxyz"[: n - 62]
        for _ in range(8):
            at = list(whole)
            for _ in range(rng.randrange(4)):
                at[rng.randrange(len(at))] = rng.choice(("", "q", "qq"))
            names.add("".join(at))
    names = sorted(names)
    seen, declared = names[::2], names[1::2]
    want = {s: (b[1], b[0]) for s in seen if (b := min((edits(s, d), d) for d in declared))[0] <= 2}
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "name string")
    assert {r.name: (r.declared, r.distance) for r in wording.nearest_declared(frame(seen), frame(declared)).collect()} == want
    one = {s: (b[1], b[0]) for s in seen if (b := min((edits(s, d), d) for d in declared))[0] <= 1}
    assert {r.name: (r.declared, r.distance) for r in wording.nearest_declared(frame(seen), frame(declared), 1).collect()} == one

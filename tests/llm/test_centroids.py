import hashlib
import random

import numpy as np
import pytest

from assaya.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, point int"


def plain(rows, k, rounds, seed=3):
    """Lloyd's rounds over all centroids in Python integers."""
    pts = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    mark = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    c = [p for _, p in sorted(pts, key=lambda r: (mark(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [min((gap(p, q), j) for j, q in enumerate(c)) for _, p in pts]
    for _ in range(rounds):
        own = nearest()
        for j in range(len(c)):
            mine = [p for (_, p), (_, a) in zip(pts, own, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((i, j, d) for (i, _), (d, j) in zip(pts, nearest(), strict=True)), c


@pytest.mark.parametrize(("k", "dims", "scale"), [(8, 5, 1.0), (13, 2, 1.0), (5, 3, 60_000.0), (1, 4, 1.0), (40, 3, 0.01)])
def test_against_all_distances(spark, k, dims, scale):
    rng = random.Random(k)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [scale * (x + rng.choice((0, 0.25, rng.gauss(0, 0.2)))) for x in rng.choice(middle)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 330)] + rows[5:8]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    found, places = centroids.cluster(centroids.points(df, dims), k, 4)
    want, c = plain(rows, k, 4)
    assert sorted(map(tuple, found.collect())) == want
    assert places.tolist() == c


def test_balls_are_smaller_than_the_whole(spark):
    rng = np.random.default_rng(2)
    middle = rng.integers(-4000, 4000, (60, 8))
    x = middle[rng.integers(0, 60, 5000)] + rng.integers(-90, 90, (5000, 8))
    before, after = middle + rng.integers(-20, 20, middle.shape), middle
    first = centroids.Search(before)
    state = first.assign(x, np.zeros(5000, np.int64), np.full(5000, np.inf), np.zeros(5000))
    second = centroids.Search(after, before)
    got = second.assign(x, *state)[0]
    assert (got == centroids.squared(x, after).argmin(1)).all()
    assert first.measured == 5000 * 60 and second.measured < 5000 * 3


def test_rows_that_are_left_out(spark):
    good, nan, inf = [0.5, -0.5], float("nan"), float("inf")
    rows = [(1, good), (1, good), (None, [0.1, 0.2]), (2, None), (3, []), (4, [0.5]), (5, [0.5, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [1e300, -1e300]), (9, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    out = centroids.summed(*centroids.cluster(centroids.points(df, 2), 3, 4)).collect()
    assert sorted(r.vec_id or 0 for r in out) == [0, 1, 1, 8, 9]
    assert len({(r.cluster, r.distance) for r in out if r.vec_id == 1}) == 1
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    assert centroids.summed(*centroids.cluster(centroids.points(df.where("false"), 2))).collect() == []
    alone = centroids.summed(*centroids.cluster(centroids.points(df.where("vec_id is null"), 2))).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in alone] == [(None, 0, 0)]

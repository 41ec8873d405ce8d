import random

import pytest

from assaya.operators import behavior
from assaya.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_against_sql(spark, against, name):
    against(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def slots(rows, window):
    """The edge rule as a sequential scan over one signal."""
    out, by = set(), {}
    for i, actor, t, key in sorted(rows, key=lambda r: (r[2], r[0])):
        held = by.setdefault(key, {})
        for a in [a for a, (_, at) in held.items() if at < t - window]:
            del held[a]
        other = next((v[0] for a, v in held.items() if a != actor), None)
        if other is not None:
            out.add((other, i))
        held[actor] = (i, t)
    return out


def test_edges_follow_the_slot_rule(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [(f"{k:03d}", str(rng.randrange(4)), rng.randrange(200), rng.choice("ab")) for k in range(60)]
        df = spark.createDataFrame([(i, a, t, k, None, None, "d") for i, a, t, k in rows], "id string, actor string, t_us long, content_hash string, semantic_hash string, template_key string, domain string")
        got = {(r.left_id, r.right_id) for r in behavior.edges(df, 20).collect()}
        assert got == slots(rows, 20)


def test_diagnostics(spark):
    df = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "x", 1), (None, 2, "x", 1), ("b", 3, "", 1), ("c", 4, "x", None)], "id string, pos int, actor string, t_us long")
    assert [r.reason for r in behavior.diagnostics(df).orderBy("pos").collect()] == [None, "duplicate-id", "missing-id", "missing-actor", "invalid-time"]

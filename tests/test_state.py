import os

import pytest

from assaya.operators import provenance
from assaya.sources import state


def ids(df):
    return sorted(r.id for r in df.collect())


def test_revisions_share_tables_and_refuse_late_writers(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/state")
    assert store.load() == (0, {})
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    assert store.save(0, {"a": frame(1, 2), "b": frame(3)}) == 1
    revision, tables = store.load()
    assert (revision, sorted(tables), ids(tables["a"])) == (1, ["a", "b"], [1, 2])
    assert store.save(1, {"a": tables["a"].unionByName(frame(9))}) == 2
    assert len(os.listdir(tmp_path / "state" / "b")) == 1 and ids(store.load()[1]["a"]) == [1, 2, 9]
    assert ids(store.load(1)[1]["a"]) == [1, 2] and ids(tables["a"]) == [1, 2]
    with pytest.raises(state.Conflict):
        store.save(1, {"b": frame(4)})
    assert len(os.listdir(tmp_path / "state" / "b")) == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/state")
    frame = spark.createDataFrame([(1,)], "id long")
    store.save(0, {"a": frame})
    other = state.Store(spark, f"file://{tmp_path}/state")
    ask = store._expect

    def late(revision):  # the other writer saves after the last look
        ask(revision)
        if len(os.listdir(tmp_path / "state" / "a")) == 2:
            store._expect = ask
            other.save(1, {"b": frame})

    store._expect = late
    with pytest.raises(state.Conflict):
        store.save(1, {"a": frame})
    revision, tables = store.load()
    assert revision == 2 and sorted(tables) == ["a", "b"] and len(os.listdir(tmp_path / "state" / "a")) == 1
    assert not [n for n in os.listdir(tmp_path / "state" / "_revisions") if n.startswith("_")]


def test_vacuum_keeps_what_revisions_name(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/state")
    frame = spark.createDataFrame([(1,)], "id long")
    for k in range(4):
        store.save(k, {"a": frame} if k else {"a": frame, "b": frame})
    store.save(4, {}, drop=("b",))
    assert len(store.vacuum(kept=1)) == 3 and store.revisions() == [4, 5]
    assert sorted(store.load()[1]) == ["a"] and sorted(store.load(4)[1]) == ["a", "b"] and ids(store.load(4)[1]["b"]) == [1]


def test_upsert_and_retention(spark):
    held = spark.createDataFrame([(f"s{k}", f"2024-01-{k:02d}", "old") for k in range(1, 10)], "id string, updated_at string, payload string")
    incoming = spark.createDataFrame([("s1", "2023-01-01", "new"), ("x", "2024-01-09", "a"), ("x", "2024-01-05", "b"), (None, "2030-01-01", "c")], "id string, updated_at string, payload string")
    got = [tuple(r) for r in state.upsert(held, incoming, most=4).collect()]
    assert sorted(got) == [("s7", "2024-01-07", "old"), ("s8", "2024-01-08", "old"), ("s9", "2024-01-09", "old"), ("x", "2024-01-09", "a")]
    assert ("s1", "2023-01-01", "new") in [tuple(r) for r in state.upsert(held, incoming).collect()]
    rows = spark.range(1500).withColumnRenamed("id", "pos")
    kept = state.retained({"feedback": rows, "other": rows})
    assert kept["other"].count() == 1500 and sorted(r.pos for r in kept["feedback"].collect()) == list(range(500, 1500))


DESCRIPTOR = "pos long, id string, sha256 string, source_id string, created_at string, caption string"


def test_descriptors(spark):
    good = "a" * 64
    rows = [
        (0, "a", good, None, "2024-01-01", "a red fox"), (1, "b", good.upper(), "a", "2024-06-01", "the red house"), (2, "c", "xyz", "c", "soon", None), (3, "d", good, "none", None, None),
        (4, "e", good, "a", "2026-01-01", "blue sky"), (5, "a", good, "", "2024-02-01", "red foxes run"), (6, "f", good, "b", None, ""), (7, "g", None, None, "", "x"),
    ]
    got = sorted((r.pos, r.code, r.severity, *r.artifact_ids) for r in provenance.issues(spark.createDataFrame(rows, DESCRIPTOR)).collect())
    assert got == [
        (2, "invalid-hash", "error", "c"), (2, "invalid-timestamp", "warning", "c"), (2, "self-link", "error", "c"), (3, "missing-link", "warning", "d", "none"), (4, "caption-mismatch", "warning", "a", "e"),
        (4, "timestamp-mismatch", "warning", "a", "e"), (5, "duplicate-id", "error", "a"), (7, "invalid-hash", "error", "g"), (7, "invalid-timestamp", "warning", "g"),
    ]
    status = lambda part: provenance.report(spark.createDataFrame(part, DESCRIPTOR)).first().status
    assert [status(rows), status(rows[:2]), status([*rows[:2], rows[3]]), status([])] == ["inconsistent", "consistent", "unverifiable", "unverifiable"]


def test_origins_of_chains_and_cycles(spark):
    links = {"a": None, **{f"n{k}": f"n{k - 1}" if k else "a" for k in range(37)}, "x": "y", "y": "z", "z": "x", "t": "x", "s": "s", "m": "gone"}
    df = spark.createDataFrame([(k, i, "h", s, None, None) for k, (i, s) in enumerate(links.items())], DESCRIPTOR)
    got = {r.id: (r.origin, r.steps, r.cyclic) for r in provenance.origins(df).collect()}
    want = {"a": ("a", 0, False), **{f"n{k}": ("a", k + 1, False) for k in range(37)}, **dict.fromkeys("xyzts", (None, None, True)), "m": ("m", 0, False)}
    assert got == want

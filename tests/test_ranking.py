import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from assaya.operators import coherence, digest, impact, ranking


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def test_places_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(f"f{k:04d}", rng.choice((1, 1, 1, 2)), rng.choice((None, "a", "b"))) for k in range(900)]
    df = ranking.placed(frame(spark, rows, "finding_id string, score int, file_path string"), F.desc("score"), F.col("file_path"), F.col("finding_id"))
    want = sorted(rows, key=lambda r: (-r[1], r[2] is not None, r[2] or "", r[0]))
    assert [r.finding_id for r in df.orderBy("place").collect()] == [r[0] for r in want]
    assert sorted(r.place for r in df.collect()) == list(range(1, 901))
    assert "SinglePartition" not in df._jdf.queryExecution().toString()
    assert ranking.placed(df.drop("place").where("false"), F.col("finding_id")).collect() == []


def test_findings_and_evidence_within_limits(spark):
    findings = frame(spark, [(1, ["e3", "x"], ["e1"]), (2, ["e3", "e5"], None), (3, None, ["e9"])], "place long, evidence_ids array<string>, counter_ids array<string>")
    evidence = frame(spark, [(f"e{k}", k, f"s{k}") for k in range(12)] + [("e3", 99, "last"), ("e0", 98, "again")], "evidence_id string, pos long, summary string")
    kept, left = ranking.bounded_evidence(findings, evidence, 7)
    assert [(r.evidence_id, r.summary) for r in kept.orderBy("place").collect()] == [("e3", "last"), ("e1", "s1"), ("e5", "s5"), ("e9", "s9"), ("e0", "s0"), ("e2", "s2"), ("e4", "s4")]
    assert [tuple(r) for r in left.collect()] == [("<evidence>", "6 of evidence beyond the limit of 7")]
    first, lost = ranking.capped(findings, 2)
    assert sorted(r.place for r in first.collect()) == [1, 2] and [r.file_path for r in lost.collect()] == ["<findings>"]
    assert ranking.capped(findings, 3)[1].collect() == []
    assert [ranking.evidence_limit(n) for n in (1, 100, 9000)] == [100, 400, 5000]


def halved(findings, evidence, skipped, decisions, frame_bytes, notice, most):
    """The rule on lists that are cut and measured anew each time."""

    def size(*lists):
        return frame_bytes + sum(sum(x) + max(0, len(x) - 1) for x in lists)

    e, f, s, d, reduced = list(evidence), list(findings), list(skipped), list(decisions), False
    for _ in range(12):
        if size(e, [b for _, b in f], s, [b for _, b in d]) <= most:
            break
        reduced = True
        if e:
            e = e[: len(e) // 2]
        elif f:
            f = f[: len(f) // 2]
        elif len(s) > 1:
            s = s[: max(1, len(s) // 2)]
        else:
            break
    if not reduced:
        return len(e), len(f), s, size(e, [b for _, b in f], s, [b for _, b in d])
    known = {i for i, _ in f}
    d, s = [x for x in d if x[0] in known], [*s, notice]
    for _ in range(12):
        if size(e, [b for _, b in f], s, [b for _, b in d]) <= most:
            break
        if e:
            e = e[: len(e) // 2]
        elif f:
            f = f[: len(f) // 2]
        elif len(s) > 1:
            s = s[-max(1, len(s) // 2) :]
        else:
            break
    known = {i for i, _ in f}
    return len(e), len(f), s, size(e, [b for _, b in f], s, [b for i, b in d if i in known])


@pytest.mark.parametrize("seed", range(6))
def test_halving_against_cut_lists(spark, seed):
    rng = random.Random(seed)
    sizes = lambda n: [rng.randrange(5, 90) for _ in range(n)]
    findings, evidence, skipped = [(f"f{k}", b) for k, b in enumerate(sizes(rng.choice((0, 7, 40))))], sizes(rng.choice((0, 30))), sizes(rng.choice((0, 1, 9, 50)))
    decisions = [(i, rng.randrange(5, 50)) for i, _ in findings] + [("gone", 33)]
    rows = lambda v: frame(spark, list(enumerate(v, 1)), "place long, bytes long")
    held = frame(spark, [(i, k, b) for k, (i, b) in enumerate(findings, 1)], "finding_id string, place long, bytes long")
    said = frame(spark, decisions, "finding_id string, bytes long")
    for most in (50, 200, 500, 1500, 4000, 100_000):
        got = ranking.fit(held, rows(evidence), rows(skipped), said, 40, 25, most)
        kept = skipped[got.skipped_from - 1 : got.skipped_to] + ([25] if got.reduced else [])
        assert (got.evidence, got.findings, kept, got.size) == halved(findings, evidence, skipped, decisions, 40, 25, most)


def searched(edges, start, depth, most):
    """A search one node at a time."""
    into = {}
    for e in sorted(edges):
        into.setdefault(e[2], []).append(e)
    found, frontier = [], [start]
    for _ in range(depth):
        following = []
        for target in frontier:
            for _, source, _ in into.get(target, [])[:most]:
                if source not in found and len(found) < most:
                    found.append(source)
                    following.append(source)
        frontier = following
    return found


@pytest.mark.parametrize(("depth", "most"), [(3, 10_000), (5, 9), (1, 3)])
def test_search_against_one_by_one(spark, depth, most):
    rng = random.Random(depth)
    edges = [(f"e{k:03d}", f"n{rng.randrange(40)}", f"n{rng.choice((0, 1, rng.randrange(40)))}") for k in range(120)]
    df = frame(spark, [*edges, ("x", None, "n1"), ("y", "n1", None)], "edge_id string, from_id string, to_id string")
    starts = [f"n{k}" for k in range(12)]
    got = impact.impact(df, frame(spark, [(s,) for s in [*starts, None, "n0", "none"]], "start_id string"), depth, most)
    by = {}
    for r in got.orderBy("start_id", "place").collect():
        by.setdefault(r.start_id, []).append(r.node_id)
    assert by == {s: v for s in starts if (v := searched(edges, s, depth, most))}


def test_context_of_names_and_files(spark):
    nodes = [("a1", "run", "A.run", "src/a.py", True, 5), ("a2", "run", "run", "src/a.py", False, 1), ("b", "B.run", "B.run", "src/b.py", True, 0), ("c", None, "run", "src/0.py", True, 0)]
    df = frame(spark, nodes, "node_id string, name string, qualified_name string, file_path string, exported boolean, start int")
    edges = frame(spark, [("e1", "b", "a1"), ("e2", "c", "b"), ("e3", "a1", "c")], "edge_id string, from_id string, to_id string")
    asked = frame(spark, [(" run ",), ("src/a.py",), ("src/none",), ("none",), ("  ",), (None,)], "query string")
    got = {}
    for r in impact.context(df, edges, asked).orderBy("place").collect():
        got.setdefault(r.query, []).append((r.node_id, r.impacted, r.incoming, r.outgoing))
    a1 = ("a1", ["b", "c", "a1"], ["e1"], ["e3"])
    assert got == {"run": [("c", ["a1", "b", "c"], ["e3"], ["e2"]), a1, ("a2", [], [], [])], "src/a.py": [("a2", [], [], []), a1]}


def test_interchangeability(spark):
    assert [coherence.permutation(n) for n in (0, 1, 2, 4)] == [[], [0], [1, 0], [1, 2, 3, 0]]
    text = "alpha beta\n\nbeta gamma\n\ngamma delta\n\ndelta alpha omega"
    df = frame(spark, [(1, text), (2, "one part"), (3, None), (4, "alpha\n\nomega")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in coherence.interchangeability(df).collect()}
    assert got == {1: (4, 0.5, 0.5, 1.0), 2: (1, 0.0, 0.0, None), 3: (0, 0.0, 0.0, None), 4: (2, 0.0, 0.0, None)}


def test_canonical_json_and_hashes(spark):
    df = spark.createDataFrame([(1, ("z", None, [("q", {"B": 1, "a": 2})]))], "n int, Rec struct<b: string, A: string, list: array<struct<z: string, m: map<string, int>>>>")
    got = df.select(digest.canonical_json(F.struct("n", "Rec"), df.schema)).first()[0]
    assert got == '{"n":1,"Rec":{"b":"z","list":[{"m":{"a":2,"B":1},"z":"q"}]}}' and list(json.loads(got)) == ["n", "Rec"]
    rng = random.Random(2)
    rows = [(rng.randrange(30), rng.choice("abc"), [rng.choice("xy")]) for _ in range(300)]
    schema = "id long, name string, tags array<string>"
    hashes = set()
    for parts in (1, 3, 8):
        rng.shuffle(rows)
        hashes.add(tuple(digest.table_hash(spark.createDataFrame(rows, schema).repartition(parts), "id", fan=7).first()))
    assert len(hashes) == 1 and hashes.pop()[0] == 300
    whole = digest.table_hash(spark.createDataFrame(rows, schema), "id", fan=7).first().hash
    assert digest.table_hash(spark.createDataFrame(rows[1:], schema), "id", fan=7).first().hash != whole
    assert digest.table_hash(spark.createDataFrame([*rows[1:], (rows[0][0], "d", rows[0][2])], schema), "id", fan=7).first().hash != whole
    assert digest.table_hash(spark.createDataFrame([], schema), "id").first().n == 0
    one = spark.createDataFrame(rows[:1], schema)
    ids = {r.name: r for r in digest.scan_id({"b": (one, ["id"]), "a": (one.where("false"), ["id"])}).collect()}
    assert sorted(ids) == ["a", "b", "scan"] and ids["scan"].n == 1 and ids["scan"].hash.startswith("scan:") and len(ids["scan"].hash) == 29


@pytest.mark.parametrize("n", [3, 9, 10, 40])
def test_tree_of_two_levels_is_that_of_the_sql(spark, n):
    """Nodes of three: past nine rows the largest hash of the second level stands, as in the SQL past FAN * FAN rows."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    up = lambda level: [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    nodes = up([sha(f'{{"id":{k}}}') for k in range(n)])
    got = digest.table_hash(spark.range(n), "id", fan=3, levels=2).first()
    assert (got.n, got.hash) == (n, max(up(nodes)) if len(nodes) > 1 else nodes[0])


def test_scan_hash_goes_to_one_root(spark, monkeypatch):
    """With nodes of 16, the 6,000 findings take four levels: a change of one line item shows in the query, whose SQL has no limit of levels either."""
    real = digest.scan_id
    monkeypatch.setattr(digest, "scan_id", lambda tables, **more: real(tables, fan=16, **more))
    source, keys, found = digest._source(spark, "/root/testdata/sf0.001"), (0, 1500, 3000, 4500, 5900), set()
    ids = [r[0] for r in source["findings"].select("finding_id").orderBy("finding_id").collect()]
    for k in keys:
        changed = source["findings"].withColumn("line", F.when(F.col("finding_id") == ids[k], 0).otherwise(F.col("line")))
        monkeypatch.setattr(digest, "_source", lambda *_, c=changed: {**source, "findings": c})
        found.add(digest.scan_hash(spark, "").where("name = 'findings'").first().hash)
    assert len(found) == len(keys) and "max(h)" not in digest.ORACLE_SQL["scan_hash"]


def test_tables_are_summed_once_for_all_limits(spark, monkeypatch):
    calls, real = [], ranking._sums
    monkeypatch.setattr(ranking, "_sums", lambda rows, cuts: calls.append(1) or real(rows, cuts))
    sized = spark.range(1, 41).select(F.col("id").cast("string").alias("finding_id"), F.col("id").alias("place"), F.lit(10).cast("long").alias("bytes"))
    limits = [10_000, 9_000, 8_000]
    got = ranking.fits(sized, sized, sized, sized.drop("place"), 5, 3, limits)
    assert len(calls) == 4 and not any(x.reduced for x in got)
    assert got == [ranking.fit(sized, sized, sized, sized.drop("place"), 5, 3, n) for n in limits]

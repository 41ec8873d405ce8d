import random

import pyarrow.parquet as pq

from assaya.operators import behavior, ledger, wording


def test_components_of_long_chains(spark):
    rng = random.Random(4)
    shuffled = [f"b{k:04d}" for k in range(400)]
    rng.shuffle(shuffled)
    chains = [["a0000", *(f"a{k:04d}" for k in range(120, 0, -1))], shuffled]
    links = spark.createDataFrame([x for c in chains for x in zip(c, c[1:])], "left_id string, right_id string")
    got = {r.node: r.label for r in behavior.components(links).collect()}
    assert got == {n: min(c) for c in chains for n in c}


def rows_of(name):
    return pq.read_table(f"/root/testdata/sf0.001/{name}.parquet").to_pylist()


def test_evidence_of_all_orders(spark):
    spans = {}
    for x in rows_of("lineitem"):
        at, key = x["l_orderkey"] % 5000, f"{x['l_orderkey']:08d}-{x['l_linenumber']}-{x['l_partkey']}"
        spans.setdefault(key, []).append((x["l_suppkey"] % 50, at, int(at + x["l_quantity"])))
    evidence = {}
    for x in rows_of("orders"):
        evidence.setdefault(x["o_custkey"] % 50, []).append(x["o_orderkey"] % 5000)
    want = {}
    for key, found in spans.items():
        place = min(found, key=lambda v: f"src/f{v[0]}.py")[0]
        start, end = min(v[1] for v in found), max(v[2] for v in found)
        n = sum(s + 40 >= start and s <= end for s in evidence.get(place, []))
        if n:
            want[key] = n
    got = {r.finding_id: r.evidence_count for r in ledger.QUERIES["finding_evidence_overlap"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for k, x in enumerate(a, 1):
        row, old = [k], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_nearest_declared_names_against_brute_force(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abAc") for _ in range(rng.randrange(0, 11)))
    seen, declared = {name() for _ in range(150)}, {name() for _ in range(60)}
    frame = lambda names: spark.createDataFrame([(n, 1) for n in [*names, None]], "name string, key int")
    want = {}
    for s in seen:
        distance, nearest = min((edits(s.lower(), d.lower()), d) for d in declared)
        if distance <= 2:
            want[s] = (nearest, distance)
    got = {r.name: (r.declared, r.distance) for r in wording.nearest_declared(frame(seen), frame(declared)).collect()}
    assert got == want and len(want) > 20
    assert wording.nearest_declared(frame([]), frame(declared)).collect() == []


def test_lines_and_cells(spark):
    rows = [("  Say 'a b' 12 x1 3.5\tEND", "a|b  <c> & `d`_"), (None, None)]
    lines = spark.createDataFrame(rows, "line string, cell string")
    got = lines.select(wording.normalized_line(lines["line"]), wording.markdown_text(lines["cell"])).collect()
    assert tuple(got[0]) == ("say <literal> <number> x1 <number> end", "a\\\\|b &lt;c&gt; &amp; \\`d\\`\\_")
    assert tuple(got[1]) == (None, None)

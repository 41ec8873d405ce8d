import random

import pytest

from assaya.operators import intent

FINDING = "finding_id string, rule_id string, message string, classification string, file_path string, source_hash string, start_off long, end_off long, confidence string, risk string, action string, counter_evidence array<string>, counter_ids array<string>, evidence_ids array<string>, unknown array<string>"
EVIDENCE = "evidence_id string, provider_id string, kind string, summary string, file_path string, source_hash string, start_off long, end_off long, callers array<string>, tests array<string>, specifications array<string>, marked_generated boolean, marked_dynamic boolean"
BASE = ("f", "structure.pass-through-wrapper", "forwards", "waste_candidate", "input.ts", "hash", 0, 51, "C2", "R2", "propose", [], [], ["own"], [])
OWN = ("own", "scanner", "reference", "identity mapping", "input.ts", "hash", 0, 51, None, None, None, None, None)
CALLED = ("reg", "repository-graph", "reference", "framework/runtime registration for wrapper", "input.ts", "hash", 0, 51, ["caller", "caller"], ["test"], ["spec"], None, None)


@pytest.fixture
def assess(spark):
    names = [c.split()[0] for c in FINDING.split(", ")]

    def run(evidence=(OWN, CALLED), scanned=("repo/input.ts", "vendor/input.ts"), skipped=(), completeness="complete", **changed):
        row = tuple({**dict(zip(names, BASE, strict=True)), **changed}[n] for n in names)
        paths = lambda v: spark.createDataFrame([(p,) for p in v], "path string")
        return intent.assess(spark.createDataFrame([row], FINDING), spark.createDataFrame(list(evidence), EVIDENCE), paths(scanned), paths(skipped), completeness).first()

    return run


def kinds(r):
    return [h.kind for h in r.hypotheses]


def test_context_supports_intent(assess):
    r = assess()
    assert (r.status, r.action_limit, kinds(r)) == ("supported", "propose", ["framework-required", "likely-intentional"])
    assert (r.callers, r.tests, r.specifications, r.registrations, r.providers, r.relevant) == (1, 1, 1, 1, ["repository-graph", "scanner"], "complete")
    steps = {s.step: s.result for s in r.trace}
    assert steps["behavioral-contract"] == steps["evidence-diversity"] == steps["action-authority"] == "pass" and "generated-origin" not in steps
    assert {k for k, v in r.dimensions.items() if v == "observed"} == {"relevance", "density", "repetition", "templatedness"}
    assert assess(skipped=["./input.ts"]).relevant == assess(scanned=["put.ts"]).relevant == "partial"


def test_what_holds_an_action_back(assess):
    r = assess(completeness="partial")
    assert (r.status, r.action_limit) == ("unknown", "observe")
    r = assess(counter_evidence=["local convention"])
    assert (r.status, r.action_limit, r.dimensions["factuality"]) == ("contested", "observe", "conflict") and ("deterministic-defect", "conflict") in [tuple(s) for s in r.trace]
    r = assess(file_path="vendor/input.ts")
    assert r.generated == 1 and "generated-or-vendored" in kinds(r) and r.action_limit == "observe"
    r = assess(unknown=["dynamic runtime registration"])
    assert (r.dynamic, r.status, r.action_limit) == (1, "contested", "observe") and "external-or-dynamic-context" in kinds(r)
    assert assess(risk="R3").action_limit == "observe"


def test_without_context(assess):
    r = assess(evidence=[])
    assert (r.status, kinds(r), r.providers, r.dimensions["relevance"]) == ("unknown", ["duplicate-contract", "suspicious-structure"], [], "unknown")
    r = assess(evidence=[("own", "scanner", "type", "s", "input.ts", "hash", 0, 5, None, None, None, None, None)], classification="defect", confidence="C3")
    assert (r.status, kinds(r), r.hypotheses[0].confidence, r.dimensions["factuality"]) == ("supported", ["likely-defect"], "C3", "observed")
    r = assess(counter_evidence=None, counter_ids=None, evidence_ids=None, unknown=None, classification=None, confidence=None, risk=None, action=None, message=None)
    assert r.action_limit == "ignore" and r.status == "supported"


def test_paths_that_are_the_same(spark):
    frame = lambda *v: spark.createDataFrame([(p,) for p in v], "path string")
    got = intent.same_path(frame("a/b.py", "./c.py", "x\\y.py", "b.py", "q.py", None), frame("b.py", "src/c.py", "y.py", "aq.py", None))
    assert sorted(r.path for r in got.collect()) == ["./c.py", "a/b.py", "b.py", "x\\y.py"]


def test_counts_without_pairs_equal_brute_force(spark):
    """Turned and missing ranges, own evidence that overlaps or doesn't, and names that several records share."""
    rng = random.Random(5)
    offsets = lambda: (None, 3) if rng.random() < 0.1 else (a := rng.randrange(60), a + rng.randrange(-4, 12))
    names = lambda k: rng.choice([None, [], [f"{k}{rng.randrange(4)}", f"{k}{rng.randrange(4)}"], [None, k]])
    place = lambda: rng.choice([("a", "1"), ("a", "2"), ("b", "1"), (None, "1")])
    evidence = [(f"e{k}", rng.choice(["scanner", intent.GRAPH_PROVIDER, None]), rng.choice(["coverage", "policy", "provenance", "type", "data-flow", None]), rng.choice(["registration", "an export", "runtime-only", "vendor", None]), *place(), *offsets(), names("c"), names("t"), names("s"), rng.choice([None, True, False]), rng.choice([None, True])) for k in range(120)]
    findings = [("f%d" % k, "r", "m", None, *place(), *offsets(), "C1", "R1", "observe", [], [f"e{rng.randrange(130)}"], [f"e{rng.randrange(130)}", f"e{rng.randrange(130)}"], []) for k in range(80)]
    f, e = spark.createDataFrame(findings, FINDING), spark.createDataFrame(evidence, EVIDENCE)
    got = {r.finding_id: r for r in intent.contexts(f, e).collect()}
    shown = {r.finding_id: r for r in intent.supporting(f, e).collect()}
    by_id = {x[0]: x for x in evidence}
    for x in findings:
        own = {i for i in x[12] + x[13] if i in by_id}
        near = {v[0] for v in evidence if None not in (*x[4:8], *v[4:8]) and v[4:6] == x[4:6] and v[7] >= x[6] and v[6] <= x[7]} - own
        both, r = [by_id[i] for i in own | near], got[x[0]]
        assert [r.callers, r.tests, r.specifications] == [len({n for v in both for n in v[k] or []}) for k in (8, 9, 10)]
        assert r.providers == sorted({v[1] for v in both} - {None})
        assert (r.coverage, r.analyzed, r.dynamic) == (sum(v[2] == "coverage" for v in both), sum(v[2] in intent.ANALYZER_KINDS for v in both), sum(v[3] == "runtime-only" or v[12] is True for v in both))
        assert r.registrations == sum(v[1] == intent.GRAPH_PROVIDER and v[3] == "registration" for v in both)
        origins = sorted(i for i in near if by_id[i][2] == "provenance")
        assert r.origins == len(origins) and (not near or shown[x[0]].origin_ids == origins)
        assert (r.flows, r.behaviours) == tuple(sum(by_id[i][2] in kinds for i in near) for kinds in (intent.FLOW_KINDS, intent.BEHAVIOUR_KINDS))


def test_no_pair_of_a_finding_and_evidence_is_made(spark):
    """200 findings over 200 records of one place: nothing of the plan makes as many rows as there are overlaps."""
    f = spark.createDataFrame([(f"f{k}", *BASE[1:6], k, 900 + k, *BASE[8:13], None, []) for k in range(200)], FINDING)
    e = spark.createDataFrame([(f"e{k}", *OWN[1:6], k, 900 + k, *OWN[8:]) for k in range(200)], EVIDENCE)
    out = intent.assess(f, e, f.selectExpr("file_path path"), f.selectExpr("file_path path").limit(0), listed=False)
    assert {h.n_support for r in out.collect() for h in r.hypotheses if h.kind == "suspicious-structure"} <= {0}
    assert {h.n_against for r in out.collect() for h in r.hypotheses if h.kind == "suspicious-structure"} == {200}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bin#" not in plan


def test_findings_are_dealt_out_once(spark):
    """No join by the findings' ids: what is counted for a finding meets it where its place is swept."""
    f = spark.createDataFrame([(f"f{k}", *BASE[1:6], k, 9 + k, *BASE[8:13], [f"e{k}", "e3", None], []) for k in range(20)], FINDING)
    e = spark.createDataFrame([(f"e{k}", *OWN[1:6], k, 9 + k, ["caller", f"c{k}"], *OWN[9:]) for k in range(20)], EVIDENCE)
    out = intent.assess(f, e, f.selectExpr("file_path path"), f.selectExpr("file_path path").limit(0), listed=False)
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if "finding_id" in line]
    got = {r.finding_id: (r.callers, r.providers, r.relevant) for r in out.collect()}
    assert got == {f"f{k}": (1 + len({3, *range(max(0, k - 9), min(20, k + 10))}), ["scanner"], "complete") for k in range(20)}

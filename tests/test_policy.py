import random

import pytest
from pyspark.sql import functions as F

from assaya.operators import policy

FINDING = "finding_id string, rule_id string, file_path string, source_hash string, anchor string, line int, start_off long, end_off long, confidence string, risk string, action string, counter_evidence array<string>, counter_ids array<string>"
SUPPRESSION = "pos long, rule_id string, file_path string, anchor string, source_hash string, expires_at string, reason string"
FEEDBACK = "pos long, finding_id string, rule_id string, source_hash string, outcome string, unsafe boolean, evidence_score double"
EVIDENCE = "evidence_id string, provider_id string, kind string, summary string, file_path string, source_hash string, start_off long, end_off long, missing_lines array<int>, surface_names array<string>"
WRAPPER = ("w", policy.WRAPPER_RULE, "input.ts", "hash", "function:wrapper", 1, 0, 58, "C2", "R2", "propose", [], None)


def finding(**changed):
    names = [c.split()[0] for c in FINDING.split(", ")]
    return tuple({**dict(zip(names, WRAPPER, strict=True)), **changed}[n] for n in names)


@pytest.fixture
def decide(spark):
    def run(findings, suppressions=(), feedback=(), evidence=(), available=True):
        frame = spark.createDataFrame
        rules = frame(list(policy.RULES), "rule_id string, risk string, confidence_cap string, maximum_action string")
        held = frame(list(suppressions), SUPPRESSION).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
        out = policy.decide(frame(list(findings), FINDING), rules, held, frame(list(feedback), FEEDBACK), frame(list(evidence), EVIDENCE), F.lit("2024-01-01").cast("timestamp"), available)
        return {r.finding_id: r for r in out.collect()}

    return run


def test_caps_scores_and_unregistered_rules(decide):
    got = decide([
        WRAPPER, finding(finding_id="u", rule_id="experimental.x", confidence="C3"), finding(finding_id="r3", risk="R3"), finding(finding_id="c", counter_evidence=["a", "a", "b"]),
        finding(finding_id="d", action="delegate-safe-fix"), finding(finding_id="cap", rule_id="structure.duplicate-capability"), finding(finding_id="n", confidence=None, risk=None, action=None, rule_id=None),
    ])
    assert (got["w"].final_action, got["w"].evidence_score, got["w"].reasons) == ("propose", 0.7, [])
    assert (got["u"].final_action, got["u"].final_confidence, got["u"].reasons) == ("observe", "C2", ["unregistered rule"])
    assert got["r3"].final_action == "observe" and got["r3"].reasons == ["risk differs from the rule's R2", "R3 needs manual review"]
    assert got["c"].final_action == "observe" and round(got["c"].evidence_score, 9) == 0.3 and got["c"].final_confidence == "C1" and got["c"].counter_evidence == ["a", "b"]
    assert got["d"].final_action == "propose"  # the rule's own cap
    assert (got["cap"].final_action, got["cap"].final_confidence) == ("observe", "C1")
    assert (got["n"].final_action, got["n"].final_confidence) == ("ignore", "C1")


def test_suppressions_expire_and_match_their_scope(decide):
    rule = policy.WRAPPER_RULE
    held = [(1, rule, "input.ts", "function:wrapper", None, "2020-01-01", "old"), (2, "other", None, None, None, None, "other rule"), (3, rule, "input.ts", "", "x", None, "hash"), (4, rule, None, "function:wrapper", None, None, "anchor"), (5, rule, "input.ts", None, "", "2030-01-01", "file")]
    got = decide([WRAPPER, finding(finding_id="b", anchor="function:b"), finding(finding_id="c", file_path="c.ts", anchor=None), finding(finding_id="x", source_hash="x")], held)
    assert {k: (r.suppressed, r.reasons) for k, r in got.items()} == {"w": (True, ["suppressed: anchor"]), "b": (True, ["suppressed: file"]), "c": (False, []), "x": (True, ["suppressed: hash"])}
    assert (got["w"].final_action, got["w"].evidence_score) == ("ignore", 0.0)
    assert not decide([WRAPPER], held, available=False)["w"].suppressed


def test_feedback_on_this_very_source(decide):
    fallback = finding(rule_id="data.hidden-catch-fallback", risk="R3", action="observe")
    said = lambda pos, outcome, unsafe=False, source="hash": (pos, "w", "q", source, outcome, unsafe, 0.5)
    assert decide([fallback], feedback=[said(1, "accepted")])["w"].final_action == "propose"
    closed = decide([fallback], feedback=[said(2, "intentional"), said(1, "accepted")])["w"]
    assert closed.final_action == "ignore" and closed.reasons[-1] == "closed in review: intentional"
    assert decide([fallback], feedback=[said(1, "accepted", True)])["w"].final_action == "observe"
    assert decide([fallback], feedback=[said(1, "accepted", source="changed")])["w"].final_action == "observe"
    assert decide([finding(rule_id="experimental.x")], feedback=[said(1, "accepted")])["w"].final_action == "observe"
    assert decide([fallback], feedback=[said(1, "accepted")], available=False)["w"].reasons[-1] == "no policy state"


def test_health_of_a_rule(decide, spark):
    records = [(k, f"x{k}", policy.WRAPPER_RULE, "hash", "accepted", None, 0.7) for k in range(40)]
    health = policy.rule_health(spark.createDataFrame(records, FEEDBACK)).first()
    assert (health.status, health.selective_threshold, round(health.conformal_threshold, 9)) == ("healthy", 0.7, 0.7)
    assert decide([WRAPPER], feedback=records)["w"].final_action == "propose"
    got = decide([WRAPPER], feedback=[*records, (41, "x", policy.WRAPPER_RULE, "hash", "unsafe-proposal", True, 0.7)])["w"]
    assert got.final_action == "observe" and got.reasons == ["rule disabled"]
    high = [(*r[:6], 0.9) for r in records]
    low = decide([WRAPPER], feedback=high)["w"]
    assert low.final_action == "observe" and low.reasons == ["score 0.70 under threshold 0.90"]
    assert policy.rule_health(spark.createDataFrame([(1, "a", "r", "h", "accepted", False, float("nan"))], FEEDBACK)).first().status == "insufficient-data"


def test_evidence_against_a_finding(decide):
    record = lambda key, provider="repository-graph", kind="reference", summary="runtime registration 'route'", path="input.ts", source="hash", s=0, e=58, missing=None, names=None: (key, provider, kind, summary, path, source, s, e, missing, names)
    got = decide([WRAPPER], evidence=[record("r"), record("q", summary="route"), record("z", summary="elsewhere")])["w"]
    assert got.final_action == "observe" and got.counter_ids == ["q", "r"] and got.counter_evidence == ["registered in the repository graph: runtime registration 'route'"]
    for other in (record("r", provider="x"), record("r", source="old"), record("r", s=59, e=70), record("r", path="a"), record("r", summary="none"), record("r", s=None)):
        assert decide([WRAPPER], evidence=[other])["w"].final_action == "propose"
    assert decide([WRAPPER], evidence=[record("r", s=58, e=9000)])["w"].final_action == "observe"
    assert decide([WRAPPER], evidence=[record("p", kind="policy", summary="s", names=["a.b", "pkg.wrapper"])])["w"].counter_evidence == [policy.EXPORTED]
    untested = finding(rule_id=policy.UNTESTED_RULE, line=70)
    missed = record("a", provider="coverage-lcov", summary="s", missing=[1, 2, *range(60, 200), 70])
    assert decide([untested], evidence=[missed])["w"].counter_evidence == []
    assert decide([untested], evidence=[missed, record("b", provider="coverage-py", summary="s", missing=[69, 71])])["w"].counter_evidence == [policy.COVERED]
    assert decide([untested], evidence=[record("b", provider="coverage-py", summary="s")])["w"].counter_evidence == [policy.COVERED]


def test_joins_against_all_pairs(spark):
    rng = random.Random(6)
    findings = [finding(finding_id=f"f{k}", file_path=rng.choice("ab"), start_off=(s := rng.randrange(4000)), end_off=s + rng.choice((0, 5, 1500)), line=rng.randrange(300), rule_id=policy.UNTESTED_RULE) for k in range(80)]
    evidence = [(f"e{k}", "coverage-x", "k", "s", rng.choice("ab"), "hash", s := rng.randrange(4000), s + rng.choice((0, 9, 3000)), rng.sample(range(300), 280), None) for k in range(4)]
    a, b = spark.createDataFrame(findings, FINDING), spark.createDataFrame(evidence, EVIDENCE)
    assert sorted(map(tuple, policy.overlapping(a, b).collect())) == sorted((f[0], e[0]) for f in findings for e in evidence if f[2] == e[4] and e[7] >= f[6] and e[6] <= f[7])
    assert {r[0] for r in policy.executed(a, b).collect()} == {f[0] for f in findings if any(e[4] == f[2] and f[5] not in e[8] for e in evidence)}
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(60)]
    parts = ["".join(rng.choice("abc") for _ in range(rng.randrange(4))) for _ in range(30)]
    got = policy.contained(spark.createDataFrame([(t,) for t in texts], "message string"), spark.createDataFrame([(p,) for p in parts], "summary string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, p) for t in set(texts) for p in set(parts) if p in t)


def test_one_place_of_many_overlaps_is_many_tasks(spark, monkeypatch):
    a = spark.createDataFrame([finding(finding_id=f"f{k}", start_off=k % 40, end_off=k % 40 + 300) for k in range(300)], FINDING)
    b = spark.createDataFrame([(f"e{k}", "p", "k", "s", a.first().file_path, a.first().source_hash, k % 50, k % 50 + 400, None, None) for k in range(250)], EVIDENCE)
    monkeypatch.setattr(policy, "MEETING", 20)
    out = policy.overlapping(a, b)
    assert out.distinct().count() == out.count() == 300 * 250
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300 * 250 / 2


def test_evidence_is_not_read_for_suppressed_findings(decide, monkeypatch):
    asked, real = [], policy.counterevidence
    monkeypatch.setattr(policy, "counterevidence", lambda findings, evidence: asked.extend(r.finding_id for r in findings.collect()) or real(findings, evidence))
    said = [(f"e{k}", policy.GRAPH_PROVIDER, "reference", "registration 1", "input.ts", "hash", 0, 9, None, None) for k in range(3)]
    got = decide([WRAPPER, finding(finding_id="b", anchor="function:b")], [(1, policy.WRAPPER_RULE, None, "function:b", None, None, "why")], evidence=said)
    assert asked == ["w"]
    assert (got["w"].counter_evidence, got["w"].counter_ids) == ([policy.REGISTERED + "registration 1"], ["e0", "e1", "e2"])
    assert got["b"].suppressed and got["b"].counter_ids == []


def test_records_behind_messages_are_not_dealt_out(spark, monkeypatch):
    """Findings and records of one place over several tasks: each row is made whole where it leaves, as from all pairs."""
    monkeypatch.setattr(policy, "TASK_PAIRS", 300)
    monkeypatch.setattr(policy, "HELD_BYTES", 500)
    rng = random.Random(8)
    evidence = [(f"e{k}", policy.GRAPH_PROVIDER, "reference", f"registration {rng.randrange(12)}", "input.ts", "hash", u := rng.randrange(90), u + rng.randrange(-3, 30), None, None) for k in range(50)]
    findings = [finding(finding_id=f"f{k}", start_off=(s := rng.randrange(100)), end_off=s + rng.randrange(-3, 9), counter_ids=rng.choice([None, [], ["e7", "own"]])) for k in range(40)]
    frame = spark.createDataFrame
    held = frame([], SUPPRESSION).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    rules = frame(list(policy.RULES), "rule_id string, risk string, confidence_cap string, maximum_action string")
    out = policy.decide(frame(findings, FINDING), rules, held, frame([], FEEDBACK), frame(evidence, EVIDENCE), F.lit("2024-01-01").cast("timestamp"), joined=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    for r in out.collect():
        f = findings[int(r.finding_id[1:])]
        said = {policy.REGISTERED + e[3] for e in evidence if e[7] >= f[6] and e[6] <= f[7]}
        ids = {e[0] for e in evidence for m in said if e[3] in m} | set(f[12] or [])
        assert (sorted(r.counter_evidence), r.counter_ids) == (sorted(said), ",".join(sorted(ids)))


def test_places_are_looked_up_once_for_all_their_findings(spark):
    held = spark.createDataFrame([(1, "r", "a", None, None, None, "x"), (2, "r", None, None, "h", None, "y")], SUPPRESSION).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    rows = [finding(finding_id=str(k), rule_id="r", file_path="ab"[k % 2], source_hash="h" if k % 3 else None) for k in range(12)] + [finding(finding_id="none", rule_id=None)]
    out = policy.active_suppressions(spark.createDataFrame(rows, FINDING), held, F.lit("2024-01-01").cast("timestamp"))
    assert {r.finding_id: r.reason for r in out.collect()} == {str(k): "x" if k % 2 == 0 else "y" for k in range(12) if k % 2 == 0 or k % 3}
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)[1].split("LogicalRDD", 1)[0]
    assert "Aggregate" in below  # the places are made distinct before they are multiplied

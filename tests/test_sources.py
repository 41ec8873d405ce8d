import json
import os

from assaya.sources import corpus, repository


def test_files_to_scan(spark, tmp_path):
    root = tmp_path / "a repo+%41"
    for path, size in {"b.ts": 3, "a.PY": 1, "__init__.py": 1, "z/q.md": 2, "z/big.md": 2000, "x.txt": 1, "package.json": 2, "z/deep/pyproject.toml": 1, "node_modules/m.js": 1, "z/dist/m.js": 1, ".cache/worktrees/w.ts": 1, ".cache/k.ts": 1, "ü &.mjs": 1, ".ts": 1, "distant/m.js": 1}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x" * size)
    os.symlink(root / "b.ts", root / "link.ts")
    os.symlink(root / "z", root / "y")
    want = ["__init__.py", "a.PY", "b.ts", "package.json", "ü &.mjs", ".cache/k.ts", "distant/m.js", "z/q.md", "z/deep/pyproject.toml"]
    found, more = repository.discovered(str(root), max_bytes=1000)
    assert [path for path, _ in found] == want and not more and found == repository.discovered(f"file://{root}", max_bytes=1000)[0]
    assert repository.discovered(str(root), 3, 1000) == ([("__init__.py", 1), ("a.PY", 1), ("b.ts", 3)], True)
    assert repository.discovered(f"{root}/none") == ([], False)
    files = repository.listing(spark, str(root), max_bytes=1000)
    before = repository.snapshot(files, str(root)).select("path", "hash").toPandas()
    assert sorted(before["path"]) == sorted(want)
    (root / "b.ts").write_text("new")
    (root / "a.PY").unlink()
    (root / "n.cjs").write_text("n")
    after = repository.snapshot(repository.listing(spark, str(root), max_bytes=1000), str(root))
    assert {r.path: r.text for r in after.collect()}["b.ts"] == "new"
    assert sorted(r.path for r in repository.snapshot(files, str(root), 2).collect()) == sorted(set(want) - {"a.PY", "b.ts"})
    got = {r.path: r.status for r in repository.changed(spark.createDataFrame(before), after).collect()}
    assert got == {"b.ts": "changed", "a.PY": "removed", "n.cjs": "added"}


def test_paths_that_may_not_be_read(spark):
    asked = spark.createDataFrame([(p,) for p in ("@a/b.py", "a/./x/../b.py", "../a/b.py", "/a/b.py", "a/../../a", "no.py", "big.py", None)], "path string")
    files = spark.createDataFrame([("a/b.py", 5), ("big.py", 5000), ("a", 1)], "path string, size long")
    got = {r.path: r.reason for r in repository.refused(asked, files, 1000).collect()}
    assert got == {"@a/b.py": None, "a/./x/../b.py": None, "../a/b.py": "outside-root", "/a/b.py": "outside-root", "a/../../a": "outside-root", "no.py": "not-a-file", "big.py": "too-large"}


CASE = {"id": "1", "repository": "r", "split": "train", "rule_id": "q", "anchor": "a", "language": "python", "label": "defect", "source": "s", "expected_action": "observe"}


def test_lines_of_a_corpus(spark):
    lines = [
        json.dumps(CASE), "", "  ", "{", "[1]", "3", json.dumps(CASE | {"id": 5}), json.dumps(CASE | {"split": "test"}), json.dumps(CASE | {"id": "2", "expected_confidence": "C4"}), json.dumps(CASE | {"id": "3", "veto": "  "}),
        json.dumps(CASE | {"source": "again"}), json.dumps({k: v for k, v in CASE.items() if k != "label"}), json.dumps(CASE | {"id": "4", "veto": "overload", "extra": [1]}), json.dumps(CASE | {"id": "5", "split": "holdout"}), json.dumps(CASE | {"source": {"a": 1}}),
    ]
    got = corpus.parsed(spark.createDataFrame(list(enumerate(lines)), "pos long, line string"))
    assert {r.pos: r.reason for r in got.collect()} == {0: None, 3: "malformed", 4: "not-an-object", 5: "not-an-object", 6: "field:id", 7: "field:split", 8: "field:expected_confidence", 9: "field:veto", 10: "duplicate-id", 11: "field:label", 12: None, 13: None, 14: "field:source"}
    assert [r.repository for r in corpus.leaking(got.where("reason is null")).collect()] == ["r"]


def test_cases_and_their_findings(spark):
    cases = [
        CASE, CASE | {"id": "2", "label": "hard_negative", "expected_action": "ignore"}, CASE | {"id": "3", "expected_confidence": "C2", "veto": "public-api"}, CASE | {"id": "4", "expected_action": "ignore", "veto": "overload", "language": "typescript", "split": "holdout"},
        CASE | {"id": "5", "expected_action": "propose", "veto": "Dynamic-Call"},
    ]
    found = [
        ("1", 1, "q", "a", "ignore", "C3", None), ("1", 2, "q", "a", "observe", "C1", []), ("2", 1, "q", "a", "propose", "C3", None), ("3", 1, "q", "a", "observe", "C1", ["x"]), ("3", 2, "q", "a", "observe", "C2", ["Exported symbol"]),
        ("3", 3, "q", "a", "observe", "C2", []), ("3", 4, "q", "other", "propose", "C3", []), ("4", 1, "other", "a", "propose", "C3", []), ("5", 1, "q", "a", "propose", "C1", ["a dynamic call here"]),
    ]
    rows = corpus.parsed(spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)], "pos long, line string"))
    results = corpus.judged(rows, spark.createDataFrame(found, "case_id string, pos long, rule_id string, anchor string, action string, confidence string, counter_evidence array<string>"))
    got = {r.id: (r.passed, r.actual_action, r.actual_confidence, r.veto_matched, r.diagnostic) for r in results.collect()}
    assert got == {
        "1": (True, "observe", "C1", None, None), "2": (False, "propose", "C3", None, "action propose for ignore; unsafe action on a hard negative"), "3": (True, "observe", "C2", True, None),
        "4": (False, "ignore", None, False, "veto not seen: overload"), "5": (True, "propose", "C1", True, None),
    }
    by = {r.scope: tuple(r)[1:] for r in corpus.metrics(results).collect()}
    assert by["all"] == (5, 3, 1, 1, 0.5, 0.6) and by["validation"] == (0, 0, 0, 0, None, None) and by["holdout"] == (1, 0, 0, 0, None, 1.0) and len(by) == 7

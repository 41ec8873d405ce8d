import json

from assaya.sources import reports


def of(spark, *bodies):
    return spark.createDataFrame([(f"r{k}", b if b is None or isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "path string, body string")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_sarif(spark):
    place = [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3, "startColumn": 2}}}]
    good = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "Some Tool"}}, "results": [{"ruleId": "R", "level": "error", "message": {"text": "m"}, "locations": place, "suppressions": [{"kind": "x"}]}, {"message": {"text": "no place"}}]}]}
    got = reports.sarif(of(spark, good, good | {"version": "2.0"}, "{", None))
    assert rows(got, "path", "file_path", "rule_id", "severity", "line", "col", "end_line", "end_col", "suppressed") == [("r0", "a.py", "sarif.Some-Tool.R", "error", 3, 2, 3, 2, True)]


def test_linters(spark):
    es = [{"filePath": "a.ts", "messages": [{"ruleId": "q", "severity": 2, "message": "m", "line": 1, "column": 5}, {"ruleId": "w", "severity": 1, "message": "m", "line": 0, "column": 5}]}]
    assert rows(reports.eslint(of(spark, es, None)), "file_path", "rule_id", "severity", "line", "end_col") == [("a.ts", "q", "error", 1, 5)]
    ru = [{"filename": "a.py", "code": "F401", "message": "m", "location": {"row": 2, "column": 1}, "end_location": {"row": 2, "column": 9}}]
    assert rows(reports.ruff(of(spark, ru)), "rule_id", "severity", "line", "end_col") == [("F401", "warning", 2, 9)]
    py = {"generalDiagnostics": [{"file": "a.py", "severity": "error", "message": "m", "rule": "x", "range": {"start": {"line": 0, "character": 4}, "end": {"line": 0, "character": 6}}}]}
    assert rows(reports.pyright(of(spark, py)), "severity", "line", "col", "end_col") == [("error", 1, 5, 7)]


def test_coverage(spark):
    files = {"a.py": {"executed_lines": [2, 1], "missing_lines": [3, 4]}, "b.py": {"executed_lines": [1], "missing_lines": [1]}}
    got = reports.coverage_evidence(reports.coverage_json(of(spark, {"files": files})))
    assert rows(got, "file_path", "percent", "missing") == [("a.py", 50.0, [3, 4])]
    text = "TN:\nSF:a.c\nDA:1,1\nDA:2,0\nend_of_record\nSF:b.c\nDA:7,0\nend_of_record\nSF:a.c\nDA:2,3\nDA:3,0\nend_of_record\n"
    got = reports.lcov(of(spark, text)).orderBy("file_path")
    assert rows(got, "file_path", "covered", "missing") == [("a.c", [1, 2], [3]), ("b.c", [], [7])]


def test_a_file_ends_an_open_lcov_record(spark):
    got = reports.lcov(of(spark, "SF:a.c\nDA:1,1\nSF:b.c\nDA:7,0\nend_of_record\n")).orderBy("file_path")
    assert rows(got, "file_path", "covered", "missing") == [("a.c", [1], []), ("b.c", [], [7])]


def test_pyright_notes(spark):
    item = {"file": "a.py", "message": "m", "rule": "x", "range": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 1}}}
    got = reports.pyright(of(spark, {"generalDiagnostics": [item | {"severity": s} for s in ("error", "warning", "information")]}))
    assert [r[0] for r in rows(got, "severity")] == ["error", "warning", "note"]


def test_unreadable_and_export(spark):
    assert rows(reports.unreadable(of(spark, [], "{", None)), "path") == [("r1",), ("r2",)]
    found = spark.createDataFrame([("r", "defect", "C2", "m", "a.py", 1, 2, 5, 9, True), ("r", "defect", "C1", "m", "a.py", 1, 2, 5, 3, False)], "rule_id string, classification string, confidence string, message string, file_path string, line int, col int, start int, end int, suppressed boolean")
    a, b = (json.loads(r.result) for r in reports.to_sarif(found, "t", "1").collect())
    assert (a["level"], b["level"]) == ("error", "note") and "suppressions" in a and "suppressions" not in b
    assert (a["locations"][0]["physicalLocation"]["region"]["charLength"], b["locations"][0]["physicalLocation"]["region"]["charLength"]) == (4, 0)

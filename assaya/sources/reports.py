"""Analyzer and coverage reports as tables. Each reader takes rows (path, body) of whole report files.

Everything is JVM-side JSON and string work, a row per report in and a row per result out; nothing
is shuffled but the lines of LCOV records, and those within their report. A null body, one that is no
JSON and one of another form give no diagnostics; ``unreadable`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of every diagnostics table.
DIAGNOSTIC = ("path", "tool", "file_path", "rule_id", "severity", "line", "col", "end_line", "end_col", "message", "suppressed")
# Names of a tool and a rule that a SARIF log leaves out.
NO_TOOL, NO_RULE = "unknown-tool", "unidentified"

_REGION = "struct<startLine:int,startColumn:int,endLine:int,endColumn:int>"
_SARIF = f"""struct<version:string,runs:array<struct<tool:struct<driver:struct<name:string,version:string,semanticVersion:string>>,
  results:array<struct<ruleId:string,level:string,message:struct<text:string,markdown:string>,suppressions:array<struct<kind:string>>,
  locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:{_REGION}>>>>>>>>"""
_ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int,endLine:int,endColumn:int>>>>"
_RUFF = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>,end_location:struct<row:int,column:int>>>"
_POSITION = "struct<line:int,character:int>"
_PYRIGHT = f"struct<generalDiagnostics:array<struct<file:string,severity:string,message:string,rule:string,range:struct<start:{_POSITION},`end`:{_POSITION}>>>>"
_COVERAGE = "struct<files:map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>>"


def _diagnostics(df: DataFrame, tool: str | Column, **columns: Column) -> DataFrame:
    columns = {"suppressed": F.lit(False)} | columns | {"path": F.col("path"), "tool": F.lit(tool) if isinstance(tool, str) else tool}
    return df.select(*(columns[c].alias(c) for c in DIAGNOSTIC)).where("file_path is not null and (line is null or line > 0)")


def _each(reports: DataFrame, schema: str, items) -> DataFrame:
    return reports.select("path", F.from_json("body", schema).alias("d")).select("path", F.explode(items(F.col("d"))).alias("x"))


def sarif(reports: DataFrame) -> DataFrame:
    """Results of SARIF 2.1.0 runs at their first location; other versions give nothing."""
    runs = reports.select("path", F.from_json("body", _SARIF).alias("d")).where("d.version = '2.1.0'").select("path", F.explode("d.runs").alias("run"))
    x = runs.select("path", F.coalesce("run.tool.driver.name", F.lit(NO_TOOL)).alias("name"), F.explode("run.results").alias("x"))
    at = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    region = at["region"]
    line, col = F.coalesce(region["startLine"], F.lit(1)), F.coalesce(region["startColumn"], F.lit(1))
    rule = F.concat(F.lit("sarif."), F.regexp_replace("name", r"[^A-Za-z0-9_.-]+", "-"), F.lit("."), F.coalesce("x.ruleId", F.lit(NO_RULE)))
    return _diagnostics(
        x, F.col("name"), file_path=at["artifactLocation"]["uri"], rule_id=rule, severity=F.coalesce("x.level", F.lit("none")), line=line, col=col,
        end_line=F.coalesce(region["endLine"], line), end_col=F.coalesce(region["endColumn"], col),
        message=F.coalesce("x.message.text", "x.message.markdown", F.lit("(no message)")), suppressed=F.coalesce(F.size("x.suppressions") > 0, F.lit(False)),
    )


def eslint(reports: DataFrame) -> DataFrame:
    """Messages of severity 2 or more are errors, others warnings."""
    x = _each(reports, _ESLINT, lambda d: d).select("path", F.col("x.filePath").alias("file"), F.explode("x.messages").alias("m"))
    return _diagnostics(x, "eslint", file_path=F.col("file"), rule_id=F.col("m.ruleId"), severity=F.when(F.col("m.severity") >= 2, "error").otherwise("warning"), line=F.col("m.line"), col=F.col("m.column"), end_line=F.coalesce("m.endLine", "m.line"), end_col=F.coalesce("m.endColumn", "m.column"), message=F.col("m.message"))


def ruff(reports: DataFrame) -> DataFrame:
    """All results are warnings."""
    x = _each(reports, _RUFF, lambda d: d)
    return _diagnostics(x, "ruff", file_path=F.col("x.filename"), rule_id=F.col("x.code"), severity=F.lit("warning"), line=F.col("x.location.row"), col=F.col("x.location.column"), end_line=F.coalesce("x.end_location.row", "x.location.row"), end_col=F.coalesce("x.end_location.column", "x.location.column"), message=F.col("x.message"))


def pyright(reports: DataFrame) -> DataFrame:
    """Positions count from 0 in the report and from 1 in the table; severities other than error and warning are notes."""
    x = _each(reports, _PYRIGHT, lambda d: d["generalDiagnostics"])
    start, end = F.col("x.range.start"), F.col("x.range.end")
    return _diagnostics(x, "pyright", file_path=F.col("x.file"), rule_id=F.col("x.rule"), severity=F.when(F.col("x.severity").isin("error", "warning"), F.col("x.severity")).otherwise("note"), line=start["line"] + 1, col=start["character"] + 1, end_line=end["line"] + 1, end_col=end["character"] + 1, message=F.col("x.message"))


def coverage_json(reports: DataFrame) -> DataFrame:
    """path, file_path, covered, missing (sorted lines) of coverage.py reports; files whose lines are both executed and missing, or not positive, go."""
    x = reports.select("path", F.from_json("body", _COVERAGE).alias("d")).select("path", F.explode("d.files").alias("file_path", "f"))
    lines = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<int>"))))
    x = x.select("path", "file_path", lines(F.col("f.executed_lines")).alias("covered"), lines(F.col("f.missing_lines")).alias("missing"))
    return x.where(~F.arrays_overlap("covered", "missing") & F.forall(F.concat("covered", "missing"), lambda n: n > 0))


def lcov(reports: DataFrame) -> DataFrame:
    """path, file_path, covered, missing (sorted lines) of LCOV records; a line's hits add up over the records of its file.

    A record ends at its end mark or where the next file starts.
    """
    record = F.explode(F.split("body", r"(?m)^end_of_record\s*$|^(?=SF:)")).alias("record")
    x = reports.select("path", record).select("path", F.regexp_extract("record", r"(?m)^SF:(.*?)\s*$", 1).alias("file_path"), F.explode(F.regexp_extract_all("record", F.lit(r"(?m)^DA:(\d+,\d+)"), F.lit(1))).alias("da")).where("file_path <> ''")
    x = x.select("path", "file_path", F.split("da", ",")[0].cast("int").alias("line"), F.split("da", ",")[1].cast("long").alias("hits")).where("line > 0")
    lines = x.groupBy("path", "file_path", "line").agg(F.sum("hits").alias("hits"))
    some = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("line"))))
    return lines.groupBy("path", "file_path").agg(some(F.col("hits") > 0).alias("covered"), some(F.col("hits") == 0).alias("missing"))


def coverage_evidence(coverage: DataFrame) -> DataFrame:
    """percent of covered lines (null without lines) with the missing ones."""
    n = F.size("covered") + F.size("missing")
    return coverage.select("path", "file_path", F.when(n > 0, F.round(100 * F.size("covered") / n, 2)).alias("percent"), "missing")


def unreadable(reports: DataFrame) -> DataFrame:
    """path of the reports that are no JSON."""
    return reports.where(F.col("body").isNull() | F.try_parse_json("body").isNull()).select("path")


def to_sarif(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """One SARIF result as JSON per row of ``findings`` (rule_id, classification, confidence, message, file_path, line, col, start, end, suppressed).

    Results stay distributed: a run of any size is written as JSON lines of results under one header.
    """
    level = F.when((F.col("classification") == "defect") & (F.col("confidence") != "C1"), "error").when(F.col("confidence") == "C1", "note").otherwise("warning")
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"), F.col("start").alias("charOffset"), F.greatest(F.lit(0), F.col("end") - F.col("start")).alias("charLength"))
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    held = F.when(F.col("suppressed"), F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"))))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), held.alias("suppressions"))
    return findings.select(F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.to_json(result).alias("result"))

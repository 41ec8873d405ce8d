"""Review operators on the caller's DataFrames: forensic rates of texts, claims, verdict lines, redaction, paths, merges, families and graph look-ups.

Null texts count as empty; rows with a null key (id, rule or name) are left out of joins and groups; empty tables give
empty results; other columns than those named are kept where rows pass through, and are not read elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import TOKENS, WORDS
from .text import FUNCTION_WORDS
from .wording import STOP_WORDS, content_words, overlap

# Word lists, patterns and marks that results depend on.
CONTROL_WORDS = ("case", "catch", "else", "finally", "for", "if", "return", "switch", "throw", "try", "while", "yield")
DECLARATIONS = "class|const|def|enum|export|function|interface|let|struct|type|var"
OPERATORS = r"===|!==|=>|==|!=|<=|>=|&&|\|\||\+\+|--|[+*/%<>=!?-]"
JARGON_WORDS = ("actionable", "alignment", "best-practice", "cutting-edge", "ecosystem", "enable", "holistic", "innovative", "leverage", "next-generation", "optimize", "paradigm", "robust", "scalable", "seamless", "solution", "synergy", "transformative", "utilize", "world-class")
ASSERTION_WORDS = ("always", "causes", "can", "demonstrates", "ensures", "must", "never", "proves", "requires", "should", "will")
FALSIFIABLE = r"(?i)\d|[A-Za-z_][A-Za-z0-9_]*\(|https?://|must|requires|increases|decreases|greater|less|equal|test|verify|reproduc"
CLAIMS = {
    "tests-passed": r"(?:all\s+)?tests?\s+(?:have\s+)?passed",
    "checks-passed": r"(?:all\s+)?(?:checks|validation|ci)\s+(?:have\s+)?passed",
    "no-api-change": r"(?:no|without)\s+(?:public\s+)?api\s+changes?",
    "no-dependency-change": r"(?:no|without)\s+dependenc(?:y|ies)\s+changes?",
    "scope-only": r"(?:only|just)\s+(?:the\s+)?(?:requested|specified|scoped)\s+(?:files?|changes?)",
    "behavior-preserved": r"(?:behavior|behaviour|semantics?)\s+(?:is|are|was|were)?\s*(?:preserved|unchanged|equivalent)",
}
GENERATED_PATH = r"(?i)(?:^|/)(?:dist|build|coverage|node_modules|vendor|generated|\.next)(?:/|$)"
GENERATED_TEXT = r"(?i)@generated|generated file|do not edit"
VERDICT_LINE = r"^finding:([0-9a-f]+) \| ([a-z0-9.-]+) \| ([^:]+):(\d+)(?::\d+)? — (.*)$"
SECRET = "(?:(?:aws[-_])?(?:api[-_]?key|auth(?:entication)?|authorization|proxy[-_]?authorization|credential|password|passwd|secretaccesskey|accesskeyid|clientsecret|privatekey|secret|token|access[-_]?key|accesskey|secret[-_]?key|client[-_]?secret|private[-_]?key|signature|x-amz-[a-z-]+))"
HARMLESS = "(?:absent|disabled|false|none|null|undefined)"
CARRIED = 0.15
ACTIONS = ("delegate-safe-fix", "propose", "observe", "ignore")

_STRING = r"""\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"""
#: Java patterns and what replaces them, in order. A harmless value is passed by: quoted whole, or up to the value's end.
_SECRETS = (
    (r"(?i)([a-z][a-z0-9+.-]*://)([^/\s:@]+):([^/\s@]+)@", "$1<redacted>@"),
    (r"(?im)((?:^|[\r\n])\s*(?:authorization|proxy-authorization)\s*:\s*)[^\r\n]*", "$1<redacted>"),
    (rf"(?i)([?&]{SECRET}=)[^&#\s]+", "$1<redacted>"),
    (rf"""(?i)((?:^|[\s\"'(\[{{,_])(?:--?|/)?{SECRET}(?:[-_][a-z]+)*(?:=|\s++))(?!\"{HARMLESS}\"|'{HARMLESS}'|[\"']?{HARMLESS}[\"']?(?:[\s,;}}]|\z))(?:{_STRING}|[^\s,;}}]*)""", "$1<redacted>"),
    (rf"""(?i)((?:^|[\s\"'(\[{{,])[\"']{SECRET}(?:[-_][a-z]+)*[\"']\s*:\s*)(?:{_STRING}|[^,}}\]\s]+)""", '$1"<redacted>"'),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", "<redacted>"),
)


def _text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 6))


def logic_density(texts: DataFrame) -> DataFrame:
    """doc_id, tokens and the rates of control words, operators and declarations a token; 0 for texts without tokens."""
    tokens = texts.select("doc_id", _text().alias("text")).withColumn("found", _all(F.col("text"), TOKENS))
    n = F.size("found")
    control = F.size(F.filter("found", lambda t: F.lower(t).isin(*CONTROL_WORDS)))
    declared = F.size(_all(F.col("text"), rf"(?<![A-Za-z0-9_])(?:{DECLARATIONS})(?![A-Za-z0-9_])"))
    rates = {"control_rate": control, "operator_rate": F.size(_all(F.col("text"), OPERATORS)), "declaration_rate": declared}
    return tokens.select("doc_id", n.cast("long").alias("tokens"), *(_rate(v, n).alias(k) for k, v in rates.items()))


def sections(text: Column) -> Column:
    """The parts between blank lines that are not white space alone."""
    return F.filter(F.split(text, r"\r?\n(?:\s*\r?\n)+", -1), lambda s: s.rlike(r"\S"))


def mean_rate(rates: Column) -> Column:
    """The mean of an array of rates of six digits, to five digits, halves up: summed as integers, so that neither order nor binary fractions decide a half."""
    total = F.aggregate(rates, F.lit(0).cast("long"), lambda x, y: x + F.round(y * 1000000).cast("long"))
    n = F.size(rates)
    return F.when(n == 0, 0.0).otherwise(F.floor((2 * total + 10 * n).cast("decimal(20,0)") / (20 * n).cast("decimal(20,0)")).cast("double") / 100000)


def argument_dependency(texts: DataFrame) -> DataFrame:
    """doc_id, sections, dependency_rate (later sections that take up CARRIED of the words before) and mean_carryover; 0 for fewer than two.

    All within the row: time grows with a text's sections times its distinct words, no word becomes a row.
    """
    sets = texts.select("doc_id", F.transform(sections(_text()), content_words).alias("sets"))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<double>").alias("carried"))
    step = lambda acc, ws: F.struct(F.array_union(acc["held"], ws).alias("held"), F.array_append(acc["carried"], overlap(ws, acc["held"])).alias("carried"))
    carried = sets.select("doc_id", F.size("sets").cast("long").alias("sections"), F.aggregate("sets", start, step)["carried"].alias("c")).withColumn("c", F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))))
    n = F.size("c")
    return carried.select("doc_id", "sections", _rate(F.size(F.filter("c", lambda x: x >= CARRIED)), n).alias("dependency_rate"), mean_rate(F.col("c")).alias("mean_carryover"))


def claim_density(texts: DataFrame) -> DataFrame:
    """doc_id, sentences, asserted, falsifiable (asserted sentences that could be tested), their rate, and the rate of jargon a word."""
    parts = texts.select("doc_id", F.filter(F.split(_text(), r"[.!?]+(?:\s+|\z)", -1), lambda s: s.rlike(r"\S")).alias("s"), _all(F.lower(_text()), WORDS).alias("w"))
    asserted = F.filter("s", lambda s: F.exists(_all(F.lower(s), WORDS), lambda w: w.isin(*ASSERTION_WORDS)))
    found = parts.select("doc_id", "w", F.size("s").alias("n"), asserted.alias("a")).withColumn("f", F.size(F.filter("a", lambda s: s.rlike(FALSIFIABLE))))
    jargon = F.size(F.filter("w", lambda w: w.isin(*JARGON_WORDS)))
    return found.select("doc_id", F.col("n").cast("long").alias("sentences"), F.size("a").cast("long").alias("asserted"), F.col("f").cast("long").alias("falsifiable"), _rate(F.col("f"), F.col("n")).alias("falsifiable_rate"), _rate(jargon, F.size("w")).alias("jargon_rate"))


def claims(texts: DataFrame) -> DataFrame:
    """doc_id, claim, matched: the first match of each kind of claim in ``texts`` (doc_id, text)."""
    edge = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
    kinds = F.array(*(F.struct(F.lit(k).alias("claim"), F.regexp_extract("text", f"(?i){edge[0]}({p}){edge[1]}", 1).alias("matched")) for k, p in CLAIMS.items()))
    return texts.select("doc_id", F.explode(kinds).alias("c")).select("doc_id", "c.claim", "c.matched").where("matched <> ''")


def verdict_lines(lines: DataFrame) -> DataFrame:
    """pos, finding_id, rule_id, file_path, line_no, text, violation of ``lines`` (pos, line): null, 'unparseable', or 'duplicate' for all but an id's first line.

    Blank lines give no row.
    """
    t = lines.select("pos", F.regexp_replace("line", r"^\s+|\s+\z", "").alias("line")).where("line <> ''")
    part = lambda k: F.regexp_extract("line", VERDICT_LINE, k)
    ok = F.col("line").rlike(VERDICT_LINE)
    rows = t.select("pos", *(F.when(ok, c).alias(n) for n, c in (("finding_id", F.concat(F.lit("finding:"), part(1))), ("rule_id", part(2)), ("file_path", part(3)), ("line_no", part(4).cast("long")), ("text", part(5)))))
    first = rows.where("finding_id is not null").groupBy(F.col("finding_id").alias("_id")).agg(F.min("pos").alias("_first"))
    violation = F.when(F.col("finding_id").isNull(), "unparseable").when(F.col("pos") > F.col("_first"), "duplicate")
    return rows.join(first, rows["finding_id"] == first["_id"], "left").select(*rows.columns, violation.alias("violation"))


def redacted(text: Column) -> Column:
    """``text`` without credentials: in URLs, headers, queries, assignments, JSON and access key ids; harmless assigned values stay."""
    for pattern, by in _SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def generated(path: Column, text: Column) -> Column:
    """True for generated or vendored files, by a folder of the path or a mark in the first 500 characters."""
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike(GENERATED_PATH), F.lit(False)) | F.coalesce(F.substring(text, 1, 500).rlike(GENERATED_TEXT), F.lit(False))


def glob_pattern(glob: str) -> str:
    """The regular expression of a path glob: ``**`` crosses folders, ``*`` and ``?`` stay within one."""
    out = ""
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.escape(piece)
    return rf"^{out}\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)


def merged(findings: DataFrame, key: str, pos: str, lists: list[str]) -> DataFrame:
    """One row an id: the other columns of its first row (at one position the smallest values); ``lists`` are sorted unions, or as they are if the id has one row.

    Sets of lists are combined before the shuffle, so a hot id costs its different lists only. Null lists are empty.
    """
    one = [pos, *(c for c in findings.columns if c not in (key, pos, *lists))]
    # Singles keep their list's order: an id of one row has one (untouched) list in the set.
    sets = [F.collect_set(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in lists]
    rows = findings.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*one)).alias("_one"), F.count(F.lit(1)).alias("_n"), *sets)
    return rows.select(key, *(F.col(f"_one.{c}").alias(c) for c in one), *(F.when(F.col("_n") == 1, F.col(c)[0]).otherwise(F.array_sort(F.array_distinct(F.flatten(c)))).alias(c) for c in lists))


def last_values(records: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row a key: the values of its last row (at one position the largest values), with ``place``, the position of its first."""
    rest = [c for c in records.columns if c not in (*keys, pos)]
    rows = records.groupBy(*keys).agg(F.max(F.struct(pos, *rest)).alias("_last"), F.min(pos).alias("place"))
    return rows.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest), "place")


def families(ranked: DataFrame) -> DataFrame:
    """rule_id, finding_id, disposition, score and a count for each action, of ``ranked`` (rule_id, finding_id, action, score, place).

    The representative is the first in rank order among the strongest actions, whichever score follows.
    """
    weight = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    best = F.min_by(F.struct("finding_id", "action", "score"), F.struct(weight, F.col("place"))).alias("best")
    counts = [F.count_if(F.col("action") == a).alias(a.replace("-", "_")) for a in ACTIONS]
    rows = ranked.where(F.col("rule_id").isNotNull() & F.col("action").isin(*ACTIONS)).groupBy("rule_id").agg(best, *counts)
    return rows.select("rule_id", "best.finding_id", F.col("best.action").alias("disposition"), "best.score", *(a.replace("-", "_") for a in ACTIONS))


def eligible(files: DataFrame, most_bytes: int, most_files: int) -> DataFrame:
    """path, pos, reason of ``files`` (path, pos, is_file, size): null for those to scan; each path once, at its first position.

    Files over the limit of files are named, not lost: the first ``most_files`` come from a top-k, the others by a join.
    """
    rows = files.where("path is not null").groupBy("path").agg(F.min("pos").alias("pos"), F.min_by(F.struct("is_file", "size"), "pos").alias("f"))
    bad = F.when(~F.col("f.is_file"), "not-a-file").when(F.col("f.size") > most_bytes, "too-large")
    judged = rows.select("path", "pos", bad.alias("bad"))
    first = judged.where("bad is null").orderBy("pos", "path").limit(most_files).select(F.col("path").alias("_path"))
    return judged.join(first, judged["path"] == first["_path"], "left").select("path", "pos", F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("_path").isNull(), "file-limit").alias("reason"))


def removed_files(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (node_id, file_path) and ``edges`` (from_id, to_id) without the files of ``gone`` (file_path), edges into them included."""
    dead = nodes.join(gone.select("file_path").distinct(), "file_path", "left_semi").select(F.col("node_id").alias("_id")).distinct()
    kept = edges.join(dead, edges["from_id"] == dead["_id"], "left_anti")
    return nodes.join(dead, nodes["node_id"] == dead["_id"], "left_anti"), kept.join(dead, kept["to_id"] == dead["_id"], "left_anti")


def named(nodes: DataFrame, name: str, most: int = 50) -> DataFrame:
    """The first ``most`` nodes of that name or qualified name, exported ones first, then by path."""
    return nodes.where((F.col("name") == name) | (F.col("qualified_name") == name)).orderBy(F.col("exported").desc(), "file_path", "node_id").limit(most)


def calibration(samples: DataFrame) -> DataFrame:
    """samples, the means of both rates and last minus first in input order, of ``samples`` (pos, source_hash, committed_at, logic, boilerplate); unfit rows are left out."""
    fit = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = samples.where(F.col("source_hash").isNotNull() & F.col("committed_at").isNotNull() & fit("logic") & fit("boilerplate"))
    drift = [F.round(F.max_by(c, "pos") - F.min_by(c, "pos"), 6).alias(f"{c}_drift") for c in ("logic", "boilerplate")]
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in ("logic", "boilerplate")]
    return rows.agg(F.count(F.lit(1)).alias("samples"), *means, *drift)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sentence that makes a claim put behind two in three."""
    said = F.when(F.col("doc_id") % 3 == 0, " All  tests have passed without API change.").when(F.col("doc_id") % 3 == 1, " CI passed; behaviour was unchanged").otherwise("")
    return claims(_table(spark, sf_dir, "documents").select("doc_id", F.concat(_text(), said).alias("text")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    line = F.concat(F.lit("finding:"), F.lower(F.hex(F.col("o_custkey"))), F.when(o % 5 == 0, " / ").otherwise(" | "), F.lit("rule.a | src/f.py:"), (o % 90).cast("string"), F.lit(" — "), F.col("o_orderpriority"))
    return verdict_lines(_table(spark, sf_dir, "orders").select(o.alias("pos"), line.alias("line")))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), F.array("l_linestatus", "l_returnflag").alias("evidence"))
    return merged(rows, "finding_id", "pos", ["evidence"]).select("finding_id", "part", F.array_join("evidence", ",").alias("evidence"))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_id"), key.alias("finding_id"), F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("o_custkey") % 3 + 2).cast("int")).alias("action"), (key % 100).alias("score"), key.alias("place"))
    return families(rows)


QUERIES = {
    "logic_density": lambda spark, sf: logic_density(_table(spark, sf, "documents")),
    "argument_dependency": lambda spark, sf: argument_dependency(_table(spark, sf, "documents")),
    "claim_density": lambda spark, sf: claim_density(_table(spark, sf, "documents")),
    "claim_detection": _claims,
    "verdict_lines": _lines,
    "finding_unions": _merged,
    "family_summary": _families,
    "generated_files": lambda spark, sf: _table(spark, sf, "pages").select("page_id", generated(F.col("url"), F.col("html")).alias("generated"), F.coalesce(matches_any(F.col("url"), ["**/*1*"]), F.lit(False)).alias("matched")),
}
_IN = {k: ", ".join(f"'{w}'" for w in v) for k, v in (("control", CONTROL_WORDS), ("jargon", JARGON_WORDS), ("assertion", ASSERTION_WORDS), ("stop", (*FUNCTION_WORDS, *STOP_WORDS)))}
_W = WORDS.replace("'", "''")
_CLAIM = " union all ".join(f"select doc_id, '{k}' as claim, regexp_extract(text, '(?i)\\b({p})\\b', 1) as matched from d" for k, p in CLAIMS.items())
ORACLE_SQL = {
    "logic_density": f"""with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{TOKENS.replace("'", "''")}') as ws from documents), n as (select doc_id, len(ws) as tokens,
len(list_filter(ws, lambda w: lower(w) in ({_IN["control"]}))) as c, len(regexp_extract_all(text, '{OPERATORS}')) as o, len(regexp_extract_all(text, '\\b(?:{DECLARATIONS})\\b')) as d from t)
select doc_id, tokens, case when tokens = 0 then 0e0 else round(1e0 * c / tokens, 6) end as control_rate, case when tokens = 0 then 0e0 else round(1e0 * o / tokens, 6) end as operator_rate, case when tokens = 0 then 0e0 else round(1e0 * d / tokens, 6) end as declaration_rate from n""",
    "argument_dependency": f"""with p as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n(?:\\s*\\r?\\n)+'), lambda s: regexp_matches(s, '\\S')) as parts from documents),
u as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as k from p),
w as (select doc_id, k, list_distinct(list_filter(regexp_extract_all(lower(part), '{_W}'), lambda x: length(x) > 2 and x not in ({_IN["stop"]}))) as ws from u),
h as (select a.doc_id, a.k, any_value(a.ws) as ws, list_distinct(flatten(list(b.ws))) as held from w a join w b on a.doc_id = b.doc_id and b.k < a.k group by a.doc_id, a.k),
c as (select doc_id, case when len(ws) = 0 or len(held) = 0 then 0e0 else round(1e0 * len(list_intersect(ws, held)) / least(len(ws), len(held)), 6) end as carried from h),
g as (select doc_id, count(*) as n, count(*) filter (where carried >= 15e-2) as hits, avg(carried) as m from c group by doc_id)
select p.doc_id, cast(len(parts) as bigint) as sections, coalesce(round(1e0 * hits / n, 6), 0e0) as dependency_rate, coalesce(round(m, 5), 0e0) as mean_carryover from p left join g on g.doc_id = p.doc_id""",
    "claim_density": f"""with s as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[.!?]+(?:\\s+|\\z)'), lambda s: regexp_matches(s, '\\S')) as s, regexp_extract_all(lower(coalesce(text, '')), '{_W}') as w from documents),
a as (select *, list_filter(s, lambda x: len(list_filter(regexp_extract_all(lower(x), '{_W}'), lambda y: y in ({_IN["assertion"]}))) > 0) as a from s), f as (select *, len(list_filter(a, lambda x: regexp_matches(x, '{FALSIFIABLE}'))) as f from a)
select doc_id, len(s) as sentences, len(a) as asserted, f as falsifiable, case when len(s) = 0 then 0e0 else round(1e0 * f / len(s), 6) end as falsifiable_rate,
case when len(w) = 0 then 0e0 else round(1e0 * len(list_filter(w, lambda x: x in ({_IN["jargon"]}))) / len(w), 6) end as jargon_rate from f""",
    "claim_detection": f"""with d as (select doc_id, concat(text, case doc_id % 3 when 0 then ' All  tests have passed without API change.' when 1 then ' CI passed; behaviour was unchanged' else '' end) as text from documents) select * from ({_CLAIM}) as x where matched <> ''""",
    "verdict_lines": """with n as (select *, o_orderkey % 5 <> 0 as ok, min(o_orderkey) filter (where o_orderkey % 5 <> 0) over (partition by o_custkey) as first_key from orders)
select o_orderkey as pos, case when ok then concat('finding:', lower(to_hex(o_custkey))) end as finding_id, case when ok then 'rule.a' end as rule_id, case when ok then 'src/f.py' end as file_path, case when ok then o_orderkey % 90 end as line_no,
case when ok then o_orderpriority end as text, case when not ok then 'unparseable' when o_orderkey > first_key then 'duplicate' end as violation from n""",
    "finding_unions": """with e as (select l_orderkey, l_linenumber, l_partkey, unnest([l_linestatus, l_returnflag]) as e from lineitem), n as (select *, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as k from lineitem),
u as (select l_orderkey, string_agg(distinct e, ',' order by e) as es from e group by l_orderkey)
select n.l_orderkey as finding_id, l_partkey as part, case when n.n = 1 then concat(l_linestatus, ',', l_returnflag) else es end as evidence from n join u on u.l_orderkey = n.l_orderkey where k = 1""",
    "family_summary": """with r as (select o_orderpriority as rule_id, o_orderkey as k, o_custkey % 3 as w from orders), f as (select *, row_number() over (partition by rule_id order by w, k) as place from r)
select rule_id, max(k) filter (where place = 1) as finding_id, max(case w when 0 then 'propose' when 1 then 'observe' else 'ignore' end) filter (where place = 1) as disposition, max(k % 100) filter (where place = 1) as score,
0::bigint as delegate_safe_fix, count(*) filter (where w = 0) as propose, count(*) filter (where w = 1) as observe, count(*) filter (where w = 2) as ignore from f group by rule_id""",
    "generated_files": f"""select page_id, coalesce(regexp_matches(url, '{GENERATED_PATH}'), false) or coalesce(regexp_matches(substr(html, 1, 500), '{GENERATED_TEXT}'), false) as generated, coalesce(regexp_matches(regexp_extract(url, '[^/]*$'), '1'), false) as matched from pages""",
}

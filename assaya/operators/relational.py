"""Evidence, calibration, history and graph operators as SQL that Catalyst plans.

Each text is Spark SQL over the tables named in braces; ``duck`` gives the same text for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Words, and pieces of text, by the forensic operators' fixed patterns.
TOKENS, WORDS = r"[A-Za-z][A-Za-z0-9_']*|\d+(?:\.\d+)?|[^\s]", r"[A-Za-z][A-Za-z0-9_']*"

FINDINGS = """findings as (select concat(lpad(cast(l_orderkey as varchar(20)), 8, '0'), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20))) as finding_id,
  concat('rule.', l_returnflag, l_linestatus) as rule_id, concat('src/f', cast(l_suppkey % 50 as varchar(20)), '.py') as file_path,
  concat('h', cast(l_suppkey % 50 as varchar(20))) as source_hash, cast(l_orderkey % 5000 as bigint) as start_off,
  cast(l_orderkey % 5000 + l_quantity as bigint) as end_off, l_linenumber % 3 + 1 as c, l_partkey % 3 + 1 as r,
  case when l_partkey % 4 = 0 then 'propose' when l_partkey % 4 = 1 then 'ignore' else 'observe' end as maximum_action,
  cast(l_linenumber % 4 as int) as n_counter, l_shipdate from {lineitem})"""
UNIQUE = "one as (select finding_id, min(rule_id) as rule_id, min(file_path) as file_path, min(source_hash) as source_hash, min(start_off) as start_off, max(end_off) as end_off, max(c) as c, max(r) as r, min(maximum_action) as maximum_action, max(n_counter) as n_counter, min(l_shipdate) as l_shipdate from findings group by finding_id)"
SCORED = """scored as (select *, cast(floor(1e2 * (6e-1 * (r / 3e0) + 25e-2 * (c / 3e0) + 15e-2 * case c when 1 then 4e-1 when 2 then 7e-1 else 95e-2 end) + 5e-1) as int) as score from one)"""
RANKED = f"with {FINDINGS}, {UNIQUE}, {SCORED}"
EDGES = """edges as (select concat('o', cast(o_orderkey as varchar(20))) as from_id, concat('c', cast(o_custkey as varchar(20))) as to_id, 'calls' as kind from {orders}
  union all select concat('c', cast(c_custkey as varchar(20))), concat('n', cast(c_nationkey as varchar(20))), 'imports' from {customer}
  union all select concat('s', cast(s_suppkey as varchar(20))), concat('n', cast(s_nationkey as varchar(20))), 'imports' from {supplier}
  union all select concat('n', cast(n_nationkey as varchar(20))), concat('r', cast(n_regionkey as varchar(20))), 'imports' from {nation})"""
FEEDBACK = """feedback as (select d.source as rule_id, case when l.quality = 1 then 'accepted' else 'intentional' end as outcome, l.quality = 0 and l.toxic = 1 as unsafe, cast(d.n_chars % 20 as double) / 20 as evidence_score
  from {labels} l join {documents} d on l.doc_id = d.doc_id)"""
FEEDBACK_BIG = """feedback as (select concat('rule.', l_returnflag, l_linestatus) as rule_id, cast(l_partkey % 20 as double) / 20 as evidence_score,
  case when l_partkey % 20 >= 8 or l_linenumber > 2 then 'accepted' else 'intentional' end as outcome, false as unsafe from {lineitem})"""


def _wilson(k: str, n: str, sign: str) -> str:
    p = f"(1e0 * {k} / {n})"
    return f"(({p} + 38416e-4 / (2 * {n})) {sign} 196e-2 * sqrt(({p} * (1 - {p}) + 38416e-4 / (4 * {n})) / {n})) / (1 + 38416e-4 / {n})"


SQL = {
    "exact_clones": "select sha2(text, 256) as body_hash, count(*) as members, min(doc_id) as first_id from {documents} where text is not null group by 1 having count(*) > 1",
    "finding_rank": f"{RANKED} select finding_id, score, case when score >= 85 then 'Critical' when score >= 65 then 'High' when score >= 40 then 'Medium' else 'Low' end as severity, cast(row_number() over (order by score desc, file_path, start_off, rule_id, finding_id) as bigint) as place from scored",
    "finding_representatives": f"{RANKED} select rule_id, finding_id, score from (select *, row_number() over (partition by rule_id order by score desc, file_path, start_off, finding_id) as k from scored) as x where k = 1",
    "finding_merge": f"with {FINDINGS}, {UNIQUE} select f.finding_id, cast(count(*) as bigint) as n, min(o.file_path) as file_path, count(distinct f.n_counter) as counters from findings f join one o on f.finding_id = o.finding_id group by f.finding_id having count(*) > 1",
    "hotspots": f"{RANKED} select file_path, count(*) as findings, count(distinct rule_id) as rules, max(score) as top_score from scored group by file_path order by findings desc, file_path limit 10",
    "action_counts": f"{RANKED} select maximum_action as action, count(*) as n from scored group by maximum_action",
    "priority_bands": f"{RANKED} select case when score >= 85 then 'Critical' when score >= 65 then 'High' when score >= 40 then 'Medium' else 'Low' end as band, count(*) as n from scored group by 1",
    "policy_apply": f"with {FINDINGS}, {UNIQUE}, capped as (select finding_id, rule_id, least(c, case when rule_id = 'rule.AF' then 1 else 2 end) as c, r, n_counter, case maximum_action when 'ignore' then 0 when 'observe' then 1 else 2 end as a from one), lowered as (select *, case when n_counter > 0 or r = 3 then least(a, 1) else a end as b, greatest(0e0, least(1e0, case c when 1 then 4e-1 when 2 then 7e-1 else 95e-2 end - least(6e-1, 2e-1 * n_counter))) as score from capped) select finding_id, case when score < 5e-1 then 'C1' else concat('C', cast(c as varchar(20))) end as final_confidence, case case when b = 2 and score < case r when 1 then 55e-2 when 2 then 7e-1 else 9e-1 end then 1 else b end when 0 then 'ignore' when 1 then 'observe' else 'propose' end as final_action, round(score, 6) as score from lowered",
    "scan_diff": f"with {FINDINGS}, {UNIQUE}, a as (select finding_id, start_off, end_off from one where l_shipdate < date '1996-01-01' or start_off % 3 = 0), b as (select finding_id, case when start_off % 5 = 0 then start_off + 1 else start_off end as start_off, end_off from one where l_shipdate >= date '1994-01-01') select case when a.finding_id is null then 'added' when b.finding_id is null then 'resolved' when a.start_off = b.start_off and a.end_off = b.end_off then 'unchanged' else 'changed' end as status, count(*) as n from a full outer join b on a.finding_id = b.finding_id group by 1",
    "verdict_classify": f"with {FINDINGS}, {UNIQUE}, ledger as (select finding_id, case when start_off % 4 = 0 then 'old' else source_hash end as source_hash from one where start_off % 3 = 0) select o.finding_id, case when l.finding_id is null then 'new' when l.source_hash = o.source_hash then 'same' else 'stale' end as status from one o left join ledger l on o.finding_id = l.finding_id where o.start_off % 2 = 0 union all select l.finding_id, 'resolved' as status from ledger l left join (select finding_id from one where start_off % 2 = 0) o on o.finding_id = l.finding_id where o.finding_id is null",
    "rule_health": f"with {FEEDBACK}, g as (select rule_id, count(*) as samples, sum(case when outcome = 'accepted' then 1 else 0 end) as accepted, sum(case when unsafe then 1 else 0 end) as unsafe from feedback group by rule_id) select rule_id, samples, cast(accepted as bigint) as accepted, cast(samples - accepted as bigint) as rejected, round(1e0 * accepted / samples, 6) as rule_precision, cast(unsafe as bigint) as unsafe, round({_wilson('accepted', 'samples', '-')}, 6) as lower_bound, case when unsafe > 0 then 'disabled' when samples < 20 then 'insufficient-data' when {_wilson('accepted', 'samples', '-')} >= 9e-1 then 'healthy' else 'observe-only' end as status from g",
    "selective_threshold": f"with {FEEDBACK_BIG}, s as (select rule_id, evidence_score, count(*) as n, sum(case when outcome <> 'accepted' or unsafe then 1 else 0 end) as bad from feedback group by rule_id, evidence_score), t as (select rule_id, evidence_score, sum(n) over w as n, sum(bad) over w as bad from s window w as (partition by rule_id order by evidence_score desc rows between unbounded preceding and current row)) select rule_id, min(evidence_score) as threshold from t where n >= 20 and {_wilson('bad', 'n', '+')} <= 1e-1 group by rule_id",
    "conformal_threshold": f"with {FEEDBACK_BIG}, a as (select rule_id, 1 - evidence_score as miss, row_number() over (partition by rule_id order by 1 - evidence_score) as k, count(*) over (partition by rule_id) as n from feedback where outcome = 'accepted') select rule_id, round(greatest(0e0, least(1e0, 1 - miss)), 6) as threshold from a where n >= 20 and k = least(n, cast(ceil((n + 1) * 9e-1) as bigint))",
    "graph_degree": f"with {EDGES} select to_id as node_id, count(*) as in_degree from edges group by to_id",
    "graph_unlinked": f"with {EDGES} select concat('c', cast(c_custkey as varchar(20))) as node_id from {{customer}} c left join edges e on e.to_id = concat('c', cast(c_custkey as varchar(20))) and e.kind = 'calls' where c.c_acctbal > 0 and e.to_id is null",
    "graph_impact": f"with {EDGES}, d1 as (select distinct from_id from edges where to_id = 'r0'), d2 as (select distinct e.from_id from edges e join d1 on e.to_id = d1.from_id), d3 as (select distinct e.from_id from edges e join d2 on e.to_id = d2.from_id) select node_id, cast(min(depth) as int) as depth from (select 'r0' as node_id, 0 as depth union all select from_id, 1 from d1 union all select from_id, 2 from d2 union all select from_id, 3 from d3) as x group by node_id",
    "graph_layers": f"with {EDGES}, layer as (select * from (values ('c', 'app'), ('s', 'app'), ('n', 'core'), ('r', 'base'), ('o', 'app')) as t(prefix, name)), allowed as (select * from (values ('app', 'core')) as t(a, b)) select f.name as from_layer, t.name as to_layer, count(*) as breaches from edges e join layer f on substr(e.from_id, 1, 1) = f.prefix join layer t on substr(e.to_id, 1, 1) = t.prefix left join allowed w on w.a = f.name and w.b = t.name where e.kind = 'imports' and f.name <> t.name and w.a is null group by f.name, t.name",
    "verdict_stats": f"with {FEEDBACK} select rule_id, count(*) as total, cast(sum(case when outcome = 'accepted' then 1 else 0 end) as bigint) as accepted, cast(sum(case when outcome <> 'accepted' then 1 else 0 end) as bigint) as intentional from feedback group by rule_id",
}
_TABLE = re.compile(r"\{(\w+)\}")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    names = set(_TABLE.findall(text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def duck(text: str) -> str:
    return _TABLE.sub(r"\1", text).replace("sha2(text, 256)", "sha256(text)")


QUERIES = {k: (lambda spark, sf, text=v: run(spark, sf, text)) for k, v in SQL.items()}
ORACLE_SQL = {k: duck(v) for k, v in SQL.items()}

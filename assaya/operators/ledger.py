"""Ledger, retention, lookup, corpus and graph-store operators as SQL that Catalyst plans.

Each text is Spark SQL over the tables named in braces. Capital words in it stand for the few
functions whose names differ between Spark and DuckDB (``DIALECT``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import relational
from .relational import EDGES, FINDINGS, RANKED, UNIQUE

#: Spark's and DuckDB's form of each stand-in.
DIALECT = {
    "EXPLODE": ("explode", "unnest"),
    "LINES": (r"split(\1, chr(10), -1)", r"string_split(\1, chr(10))"),
    "REPLACE_ALL": (r"regexp_replace(\1)", r"regexp_replace(\1, 'g')"),
    "SIZE": ("size", "len"),
    "SERIES": ("sequence", "generate_series"),
    "DISTINCT_OF": ("array_distinct", "list_distinct"),
    "COMMON": ("array_intersect", "list_intersect"),
    "PREFIXES": (r"array(substr(\1, 1, 4), substr(\1, 1, 10))", r"[substr(\1, 1, 4), substr(\1, 1, 10)]"),
    "WORDS_OF": (r"regexp_extract_all(lower(\1), '[a-z][a-z0-9_]*', 0)", r"regexp_extract_all(lower(\1), '[a-z][a-z0-9_]*')"),
}

#: Verification events of commands over paths, from orders: kind, command, path, hash at that time and outcome.
EVENTS = """ev as (select o_orderkey as event_id, concat('cmd', cast(o_custkey % 40 as varchar(20))) as command, concat('src/f', cast(o_custkey % 60 as varchar(20)), '.py') as path,
  concat('h', cast(o_orderkey % 3 as varchar(20))) as content_hash, o_orderstatus <> 'P' as succeeded, case when o_orderkey % 4 = 0 then 'mutation' else 'verification' end as kind from {orders})"""
#: Labelled cases of a corpus.
CASES = """cases as (select d.doc_id as case_id, d.source as repository, d.lang as language, case when d.doc_id % 5 = 0 then 'holdout' when d.doc_id % 5 = 1 then 'validation' else 'train' end as split,
  l.quality = 1 as positive, case when d.n_chars % 3 = 0 then 'propose' when d.n_chars % 3 = 1 then 'observe' else 'ignore' end as action, l.toxic = 1 as unsafe from {labels} l join {documents} d on l.doc_id = d.doc_id)"""
_METRICS = "count(*) as cases, count(*) filter (where action = 'propose') as actions, count(*) filter (where action = 'propose' and positive) as correct, count(*) filter (where action = 'propose' and unsafe) as unsafe_actions, count(*) filter (where action = 'ignore') as abstained"
_PRECISION = "case when actions > 0 then round(1e0 * correct / actions, 6) end as action_precision"

SQL = {
    # scans, filters and functions
    "language_routing": "select page_id, case when ext in ('py', 'pyi') then 'python' when ext in ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs') then 'typescript' when ext in ('md', 'json', 'toml') then 'graph-only' else 'unsupported' end as route from (select page_id, case page_id % 6 when 0 then 'py' when 1 then 'ts' when 2 then 'md' when 3 then 'jsx' when 4 then 'rs' else 'toml' end as ext from {pages}) as x",
    "evidence_kind": f"with {FINDINGS}, k as (select case when rule_id like 'dependency.%' then 'resolution' when rule_id like 'errors.%' or rule_id like 'data.%' then 'control-flow' when rule_id like 'structure.%' then 'reference' else 'diagnostic' end as kind from (select case c when 1 then 'dependency.unresolved' when 2 then 'errors.suppressed' else case r when 1 then 'structure.duplicate-capability' else rule_id end end as rule_id from findings) as x) select kind, count(*) as n from k group by kind",
    "sarif_level": f"with {FINDINGS}, {UNIQUE} select finding_id, case when c > 1 and rule_id like 'rule.R%' then 'error' when c = 1 then 'note' else 'warning' end as level from one",
    "utf16_length": "select doc_id, cast(length(coalesce(text, '')) + length(REPLACE_ALL(coalesce(text, ''), '[^\U00010000-\U0010FFFF]', '')) as bigint) as utf16_units from {documents}",
    "offset_to_position": "select doc_id, cast(length(head) - length(replace(head, chr(10), '')) + 1 as bigint) as line, cast(length(REPLACE_ALL(head, '(?s).*[\n]', '')) + 1 as bigint) as col from (select doc_id, substr(text, 1, cast(floor(n_chars / 2) as int)) as head from {documents} where text is not null) as x",
    "retrieval_tokens": "select item_id, count(distinct t) as n from (select item_id, EXPLODE(WORDS_OF(coalesce(text, ''))) as t from {benchmark}) as x where length(t) > 1 group by item_id",
    "finding_evidence_overlap": f"with {FINDINGS}, {UNIQUE}, evidence as (select concat('src/f', cast(o_custkey % 50 as varchar(20)), '.py') as file_path, concat('h', cast(o_custkey % 50 as varchar(20))) as source_hash, cast(o_orderkey % 5000 as bigint) as s, cast(o_orderkey % 5000 + 40 as bigint) as e, count(*) as n from {{orders}} group by 1, 2, 3, 4), f as (select finding_id, file_path, source_hash, start_off, end_off, EXPLODE(SERIES(cast(floor((start_off - 40) / 1e2) as bigint), cast(floor(end_off / 1e2) as bigint))) as bin from one), x as (select *, cast(floor(s / 1e2) as bigint) as bin from evidence) select f.finding_id, cast(sum(x.n) as bigint) as evidence_count from f join x on f.file_path = x.file_path and f.source_hash = x.source_hash and f.bin = x.bin and x.e >= f.start_off and x.s <= f.end_off group by f.finding_id",
    "completeness": f"with {FINDINGS}, s as (select file_path, count(*) as scanned, count(*) filter (where n_counter = 3 and c = 3) as reasons from findings group by file_path) select file_path, case when scanned = 0 then 'abstained' when reasons > 0 then 'partial' else 'complete' end as status from s",
    # ledger
    "touched_paths": f"with {EVENTS} select distinct path from ev where kind = 'mutation' and succeeded",
    "verification_freshness": f"with {EVENTS}, now as (select path, max_by(content_hash, event_id) as content_hash from ev where kind = 'mutation' group by path), last as (select command, path, max(event_id) as event_id from ev where kind = 'verification' group by command, path) select e.command, e.path, e.succeeded and (n.path is null or n.content_hash = e.content_hash) as fresh from last l join ev e on e.event_id = l.event_id left join now n on n.path = e.path",
    "claim_rollup": f"with {EVENTS}, last as (select command, path, max_by(succeeded, event_id) as ok from ev where kind = 'verification' group by command, path) select path, count(*) as commands, case when not bool_and(ok) then 'refuted' else 'supported' end as status from last group by path",
    "retention": f"with {EVENTS} select kind, event_id from (select kind, event_id, row_number() over (partition by kind order by event_id desc) as k from ev) as x where k <= 1000",
    "record_verdicts": f"with {FINDINGS}, {UNIQUE}, held as (select finding_id, source_hash, 'intentional' as verdict, 1 as recorded from one where start_off % 3 = 0), new as (select finding_id, case when start_off % 2 = 0 then 'moved' else source_hash end as source_hash, case when r = 1 then 'accepted' else 'intentional' end as verdict, 2 as recorded from one where start_off % 4 = 0), changed as (select n.* from new n left join held h on h.finding_id = n.finding_id and h.source_hash = n.source_hash and h.verdict = n.verdict where h.finding_id is null) select finding_id, source_hash, verdict, recorded from changed union all select h.finding_id, h.source_hash, h.verdict, h.recorded from held h left join changed c on c.finding_id = h.finding_id where c.finding_id is null",
    "active_suppression": f"with {FINDINGS}, {UNIQUE}, rules as (select * from (values (1, 'rule.AF', cast(null as varchar(20)), date '1999-01-01'), (2, 'rule.NO', 'src/f3.py', cast(null as date)), (3, 'rule.RF', cast(null as varchar(20)), date '1990-01-01'), (4, 'rule.NO', 'src/f3.py', date '1999-01-01')) as t(suppression_id, rule_id, file_path, expires)) select o.finding_id, min(s.suppression_id) as suppression_id from one o join rules s on s.rule_id = o.rule_id and coalesce(s.file_path, o.file_path) = o.file_path and coalesce(s.expires, date '9999-01-01') > o.l_shipdate group by o.finding_id",
    "latest_feedback": f"with {FINDINGS} select file_path, max_by(finding_id, concat(cast(l_shipdate as varchar(30)), finding_id)) as latest from findings group by file_path",
    # lookups and validation
    "finding_page": f"{RANKED}, first as (select finding_id, score, file_path, start_off, rule_id from scored order by score desc, file_path, start_off, rule_id, finding_id limit 60) select finding_id, place from (select finding_id, row_number() over (order by score desc, file_path, start_off, rule_id, finding_id) as place from first) as x where place > 40",
    "unique_prefix": f"with {FINDINGS}, {UNIQUE}, asked as (select distinct substr(finding_id, 1, 10) as prefix from one union select 'none' as prefix), keyed as (select finding_id, EXPLODE(PREFIXES(finding_id)) as prefix from one) select a.prefix, count(k.finding_id) as matches, case count(k.finding_id) when 0 then 'not-found' when 1 then 'found' else 'ambiguous' end as status from asked a left join keyed k on k.prefix = a.prefix group by a.prefix",
    "helper_accounting": "with asked as (select o_orderkey as k from {orders} where o_orderkey % 3 = 0), got as (select distinct l_orderkey as k from {lineitem} where l_orderkey % 6 = 0 or l_orderkey % 10 = 1) select coalesce(a.k, g.k) as k, case when g.k is null then 'missing' when a.k is null then 'unknown' else 'ok' end as status from asked a full outer join got g on a.k = g.k",
    "verdict_verification": f"with {FINDINGS}, {UNIQUE}, line as (select concat(finding_id, case when start_off % 7 = 0 then 'x' else '' end) as finding_id, case when start_off % 5 = 0 then 'rule.XX' else rule_id end as rule_id, start_off + case when start_off % 11 = 0 then 1 else 0 end as start_off from one where start_off % 2 = 0) select l.finding_id, case when o.finding_id is null then 'unknown-finding' when o.rule_id <> l.rule_id then 'rule-mismatch' when o.start_off <> l.start_off then 'location-mismatch' else 'ok' end as outcome from line l left join one o on o.finding_id = l.finding_id",
    "risk_escalation": f"with {FINDINGS}, {UNIQUE}, b as (select finding_id, case when start_off % 4 = 0 then least(3, r + 1) else r end as r from one) select case when b.r > o.r then 'regression-candidate' else 'other' end as label, count(*) as n from one o join b on b.finding_id = o.finding_id group by 1",
    "skipped_rollup": f"with {FINDINGS}, s as (select file_path, coalesce(case when n_counter = 1 then 'graph' end, 'native') as provider, case c when 1 then 'too-large' when 2 then 'not-a-file' else 'limit' end as reason from findings where r = 3) select provider, reason, count(*) as n, min(file_path) as example from s group by provider, reason",
    # corpus
    "corpus_metrics": f"with {CASES}, m as (select 'split' as by_what, split as value, {_METRICS} from cases group by split union all select 'language', language, {_METRICS} from cases group by language union all select 'all', 'all', {_METRICS} from cases) select *, {_PRECISION} from m",
    "repository_leakage": f"with {CASES} select repository, count(distinct split) as splits from cases group by repository having count(distinct split) > 1",
    "nearest_rank_percentile": "select event_type, value as p95 from (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from {events} where value is not null) as x where k = cast(ceil(n * 0.95e0) as bigint)",
    # graph store
    "graph_statistics": f"with {EDGES} select count(*) as edges, count(distinct from_id) as sources, count(distinct to_id) as targets, count(distinct kind) as kinds from edges",
    "graph_incoming": f"with {EDGES} select to_id, from_id from (select *, row_number() over (partition by to_id order by from_id) as k from edges where kind = 'calls') as x where k <= 100",
    "graph_upsert": f"with {EDGES}, gone as (select distinct from_id as node_id from edges where from_id like 's%' and length(from_id) = 2), kept as (select e.* from edges e left join gone g on g.node_id = e.from_id left join gone h on h.node_id = e.to_id where g.node_id is null and h.node_id is null), fresh as (select node_id as from_id, 'n0' as to_id, 'imports' as kind from gone) select from_id, to_id, kind from kept union all select from_id, to_id, kind from fresh",
    "surface_diff": "with a as (select p_partkey as id, p_type as signature from {part} where p_partkey % 5 <> 0), b as (select p_partkey as id, case when p_partkey % 7 = 0 then 'changed' else p_type end as signature from {part} where p_partkey % 3 <> 0) select case when a.id is null then 'added' when b.id is null then 'removed' when a.signature is distinct from b.signature then 'changed' else 'same' end as status, count(*) as n from a full outer join b on a.id = b.id group by 1",
    "retrieval_score": f"with {EDGES}, deg as (select to_id, least(count(*), 100) as n from edges group by to_id), q as (select DISTINCT_OF(WORDS_OF('furiously special packages customer asia deposits')) as ws), node as (select concat('n', cast(n_nationkey as varchar(20))) as id, DISTINCT_OF(WORDS_OF(n_name)) as ws, n_nationkey % 2 = 0 as exported from {{nation}} union all select concat('r', cast(r_regionkey as varchar(20))), DISTINCT_OF(WORDS_OF(r_name)), true from {{region}} union all select concat('p', cast(p_partkey as varchar(20))), DISTINCT_OF(WORDS_OF(concat(p_name, ' ', p_type))), p_partkey % 2 = 0 from {{part}}), s as (select id, round(1e0 * SIZE(COMMON(node.ws, q.ws)) / SIZE(q.ws) + case when exported then 1e-1 else 0e0 end + least(2e-1, 1e-2 * coalesce(n, 0)), 6) as score from node cross join q left join deg on deg.to_id = node.id) select id, score from s order by score desc, id limit 10",
}


def _in(text: str, which: int) -> str:
    """``text`` with the stand-ins of one dialect; arguments in parentheses are matched by depth."""
    for name, forms in DIALECT.items():
        form = forms[which]
        while (m := re.search(rf"\b{name}\(", text)) is not None:
            depth, end = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0) if not _quoted(text, m.end(), end) else 0
                end += 1
            inner = text[m.end() : end - 1]
            text = text[: m.start()] + (form.replace(r"\1", inner) if r"\1" in form else f"{form}({inner})") + text[end:]
    return text


def _quoted(text: str, start: int, at: int) -> bool:
    return text.count("'", start, at) % 2 == 1


def _query(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relational.run(spark, sf_dir, text)

    return query


QUERIES = {k: _query(_in(v, 0)) for k, v in SQL.items()}
ORACLE_SQL = {k: relational.duck(_in(v, 1)) for k, v in SQL.items()}

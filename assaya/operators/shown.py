"""Queries that show review operators on tables with something to show: repeated paths, sections, generated files, removed files, ranked families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import coherence, policy, ranking, review
from .relational import EDGES, run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def eligible_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, some under one path, some no files, some too large."""
    d = F.col("doc_id")
    files = _documents(spark, sf_dir).select(F.concat(F.lit("d"), (d % 700).cast("string")).alias("path"), d.alias("pos"), (d % 13 != 0).alias("is_file"), F.col("n_chars").alias("size"))
    return review.eligible(files, 2000, 300)


def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("pos"), "event_type", F.col("props").alias("details"))
    return review.last_values(events, ["user_id"], "pos")


def project_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = _documents(spark, sf_dir).select(d.alias("pos"), F.when(d % 5 != 0, "h").alias("source_hash"), F.when(d % 7 != 0, "2024-01-01").alias("committed_at"), (F.col("n_chars") / 1000).alias("logic"), ((d % 100) / 100).alias("boilerplate"))
    return review.calibration(rows)


_NODES = "nd as (select concat('c', cast(c_custkey as varchar(20))) as node_id, concat('src/n', cast(c_nationkey as varchar(20))) as file_path from {customer} union all select concat('n', cast(n_nationkey as varchar(20))), concat('src/n', cast(n_nationkey as varchar(20))) from {nation})"


def edges_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that stay when the files of two regions' nations go."""
    table = lambda views, name: run(spark, sf_dir, f"with {views} select * from {name}")
    gone = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_regionkey < 2").select(F.concat(F.lit("src/n"), F.col("n_nationkey").cast("string")).alias("file_path"))
    return review.removed_files(table(_NODES, "nd"), table(EDGES, "edges"), gone)[1].select("from_id", "to_id", "kind")


def family_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of findings as the global ranking places them."""
    return review.families(ranking.ranked(ranking._findings(spark, sf_dir)))


def generated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, ("src/a.py", "vendor/a.py", "x\\dist\\b.js", "lib/generated.py", "distant/c.py", "a/node_modules/b"))), (d % 6 + 1).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", review.generated(folder, F.concat(F.when(d % 5 == 0, "// @generated\n").otherwise(""), F.coalesce("text", F.lit("")))).alias("generated"))


QUERIES = {
    "eligible_files": eligible_files,
    "last_records": last_records,
    "project_calibration": project_calibration,
    "edges_after_removal": edges_after_removal,
    "family_ranked": family_ranked,
    "generated_paths": generated_paths,
    "argument_dependency_turns": lambda spark, sf: review.argument_dependency(coherence._conversations(spark, sf)),
}
_TURNS = "with cv as (select conv_id as doc_id, string_agg(text, '\n\n' order by turn, text) as text from conversations where text is not null group by conv_id), "
ORACLE_SQL = {
    "eligible_files": """with f as (select * from (select concat('d', doc_id % 700) as path, doc_id as pos, doc_id % 13 <> 0 as is_file, n_chars as size from documents) as x qualify row_number() over (partition by path order by pos) = 1),
b as (select *, case when not is_file then 'not-a-file' when size > 2000 then 'too-large' end as bad from f), n as (select path, row_number() over (order by pos, path) as k from b where bad is null)
select b.path, pos, case when bad is not null then bad when k > 300 then 'file-limit' end as reason from b left join n on n.path = b.path""",
    "last_records": "select user_id, max_by(event_type, event_id) as event_type, max_by(props, event_id) as details, min(event_id) as place from events group by user_id",
    "project_calibration": """with r as (select doc_id as pos, n_chars / 1000 as logic, (doc_id % 100) / 100 as boilerplate from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0)
select count(*) as samples, round(avg(logic), 6) as mean_logic, round(avg(boilerplate), 6) as mean_boilerplate, round(max_by(logic, pos) - min_by(logic, pos), 6) as logic_drift, round(max_by(boilerplate, pos) - min_by(boilerplate, pos), 6) as boilerplate_drift from r""",
    "edges_after_removal": f"with {EDGES}, {_NODES}, dead as (select node_id from nd where file_path in (select concat('src/n', n_nationkey) from nation where n_regionkey < 2)) select from_id, to_id, kind from edges where from_id not in (select node_id from dead) and to_id not in (select node_id from dead)".replace("{customer}", "customer").replace("{nation}", "nation").replace("{orders}", "orders").replace("{supplier}", "supplier"),
    "family_ranked": f"""{ranking._RANK}, p as (select *, row_number() over (partition by rule_id order by a desc, place) as k from rk)
select rule_id, max(finding_id) filter (where k = 1) as finding_id, max({list(policy.ACTIONS)}[a]) filter (where k = 1) as disposition, max(score) filter (where k = 1) as score, count(*) filter (where a = 4) as delegate_safe_fix, count(*) filter (where a = 3) as propose, count(*) filter (where a = 2) as observe, count(*) filter (where a = 1) as ignore from p group by rule_id""",
    "generated_paths": "select doc_id, doc_id % 6 in (1, 2, 5) or doc_id % 5 = 0 as generated from documents",
    "argument_dependency_turns": _TURNS + review.ORACLE_SQL["argument_dependency"].removeprefix("with ").replace("from documents", "from cv"),
}

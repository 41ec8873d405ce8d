"""Consistency of artifact descriptors: ids, hashes, times, links to sources and captions.

Descriptors: pos, id, sha256, source_id, created_at (text) and caption; a null or empty source is none.
Each rule is a filter over one pass or over one join with the sources; of several descriptors with
an id, the last one stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import use_checkpoints

# The pattern of a hash, caption words, the least overlap of related captions and days between related times.
HASH, CAPTION_WORD, SHORT_WORD, LEAST_OVERLAP, DAYS_APART = r"^[A-Fa-f0-9]{64}\z", r"[a-z][a-z0-9']+", 2, 0.1, 366
ERRORS = ("invalid-hash", "duplicate-id", "self-link")


def caption_words(text):
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({CAPTION_WORD})"), F.lit(1))), lambda w: F.length(w) > SHORT_WORD)


def issues(descriptors: DataFrame) -> DataFrame:
    """pos, code, severity, artifact_ids (array) of every rule that a descriptor breaks."""
    t = F.try_to_timestamp("created_at")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    rows = descriptors.select("pos", "id", "sha256", F.when(F.col("source_id") != "", F.col("source_id")).alias("source_id"), "created_at", t.alias("t"), "caption", nth.alias("nth"))
    own, pair = F.array("id"), F.array("id", "source_id")
    alone = [
        ("invalid-timestamp", F.col("created_at").isNotNull() & F.col("t").isNull(), own),
        ("invalid-hash", ~F.coalesce(F.col("sha256").rlike(HASH), F.lit(False)), own),
        ("duplicate-id", F.col("nth") > 1, own),
        ("self-link", F.col("source_id") == F.col("id"), own),
    ]
    source = rows.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("t", "caption"), "pos").alias("s"))
    linked = rows.where("source_id is not null").join(source, F.col("source_id") == F.col("_id"), "left")
    a, b = caption_words(F.col("caption")), caption_words(F.col("s.caption"))
    share = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))
    told = (F.col("caption") != "") & (F.col("s.caption") != "")
    joined = [
        ("missing-link", F.col("_id").isNull(), pair),
        ("timestamp-mismatch", F.abs(F.unix_micros("t") - F.unix_micros(F.col("s.t"))) > DAYS_APART * 86_400 * 1_000_000, F.array("source_id", "id")),
        ("caption-mismatch", told & (share < LEAST_OVERLAP), F.array("source_id", "id")),
    ]

    def broken(df: DataFrame, rules: list) -> DataFrame:
        found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), ids.alias("ids"))) for code, test, ids in rules)))
        return df.select("pos", F.explode(found).alias("f")).select("pos", "f.code", F.when(F.col("f.code").isin(*ERRORS), "error").otherwise("warning").alias("severity"), F.col("f.ids").alias("artifact_ids"))

    return broken(rows, alone).unionByName(broken(linked, joined))


def report(descriptors: DataFrame) -> DataFrame:
    """One row: compared, errors, warnings and status; without descriptors nothing can be verified."""
    found = issues(descriptors).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    n = descriptors.agg(F.count(F.lit(1)).alias("compared"))
    status = F.when(F.col("errors") > 0, "inconsistent").when((F.col("warnings") > 0) | (F.col("compared") == 0), "unverifiable").otherwise("consistent")
    return n.join(found).select("compared", "errors", "warnings", status.alias("status"))  # one row each


def origins(descriptors: DataFrame) -> DataFrame:
    """id, origin, steps, cyclic: where the chain of sources of each id ends, by pointer jumping.

    Each round doubles what a pointer skips, so a chain of n steps takes about log2(n) rounds, each
    written to the shared folder. A chain that a missing source ends ends before it. An id on or
    behind a cycle never arrives; it has cyclic true and no origin.
    """
    use_checkpoints(descriptors.sparkSession)
    last = descriptors.where("id is not null").groupBy("id").agg(F.max_by(F.struct("source_id"), "pos").alias("s")).select("id", "s.source_id")
    known = last.select(F.col("id").alias("source_id"), F.lit(True).alias("there"))
    pointers = last.join(known, "source_id", "left").select("id", F.when(F.col("there"), F.col("source_id")).alias("at")).checkpoint()
    steps = pointers.select("id", F.coalesce("at", "id").alias("at"), F.col("at").isNull().alias("done"), F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("steps")).checkpoint()
    most, rounds = steps.count(), 0
    while 1 << rounds <= most and not steps.where("not done").isEmpty():
        up = steps.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("ends"), F.col("steps").alias("more"))
        steps = steps.join(up, "at").select("id", F.col("next").alias("at"), F.col("ends").alias("done"), (F.col("steps") + F.col("more")).alias("steps")).checkpoint()
        rounds += 1
    return steps.select("id", F.when(F.col("done"), F.col("at")).alias("origin"), F.when(F.col("done"), F.col("steps")).alias("steps"), (~F.col("done")).alias("cyclic"))


def _descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts: each names another one as its source; some ids, hashes, times and links are broken."""
    d = F.col("doc_id")
    part = lambda k: F.when(d % k == 0, F.lit(True)).otherwise(F.lit(False))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    source = F.when(part(7), F.concat(F.lit("a"), d.cast("string"))).when(part(11), "gone").when(part(5), "").otherwise(F.concat(F.lit("a"), F.floor(d / 2).cast("string")))
    made = F.when(part(13), "yesterday").when(part(3), F.lit(None)).otherwise(F.concat((F.lit(2000) + d % 3).cast("string"), F.lit("-03-01")))
    return rows.select(d.alias("pos"), F.concat(F.lit("a"), F.when(part(17), d + 1).otherwise(d).cast("string")).alias("id"), F.when(part(19), "none").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"), source.alias("source_id"), made.alias("created_at"), F.substring("text", 1, 80).alias("caption"))


QUERIES = {
    "descriptor_issues": lambda spark, sf: issues(_descriptors(spark, sf)).withColumn("artifact_ids", F.array_join("artifact_ids", ",")),
    "descriptor_report": lambda spark, sf: report(_descriptors(spark, sf)),
    "descriptor_origins": lambda spark, sf: origins(_descriptors(spark, sf)),
}
_D = f"""d as (select doc_id as pos, concat('a', case when doc_id % 17 = 0 then doc_id + 1 else doc_id end) as id, case when doc_id % 19 = 0 then 'none' else sha256(coalesce(text, '')) end as sha256,
  case when doc_id % 7 = 0 then concat('a', doc_id) when doc_id % 11 = 0 then 'gone' when doc_id % 5 = 0 then null else concat('a', doc_id // 2) end as source_id, case when doc_id % 13 = 0 then 'yesterday' when doc_id % 3 = 0 then null else concat(2000 + doc_id % 3, '-03-01') end as created_at,
  case when doc_id % 13 <> 0 and doc_id % 3 <> 0 then make_date(2000 + cast(doc_id % 3 as int), 3, 1) end as t, substr(text, 1, 80) as caption from documents),
w as (select *, list_distinct(list_filter(regexp_extract_all(lower(caption), '{CAPTION_WORD.replace("'", "''")}'), lambda x: length(x) > {SHORT_WORD})) as ws, row_number() over (partition by id order by pos) as nth, row_number() over (partition by id order by pos desc) as back from d),
l as (select a.*, b.id as found, b.t as bt, b.ws as bw, b.caption as bc from w a left join w b on b.id = a.source_id and b.back = 1 where a.source_id is not null),
i as (select pos, 'invalid-timestamp' as code, id as artifact_ids from w where created_at = 'yesterday' union all select pos, 'invalid-hash', id from w where sha256 = 'none' union all select pos, 'duplicate-id', id from w where nth > 1 union all select pos, 'self-link', id from w where source_id = id
  union all select pos, 'missing-link', concat(id, ',', source_id) from l where found is null union all select pos, 'timestamp-mismatch', concat(source_id, ',', id) from l where abs(t - bt) > {DAYS_APART}
  union all select pos, 'caption-mismatch', concat(source_id, ',', id) from l where caption <> '' and bc <> '' and case when len(ws) = 0 or len(bw) = 0 then 0e0 else 1e0 * len(list_intersect(ws, bw)) / least(len(ws), len(bw)) end < {LEAST_OVERLAP}),
s as (select pos, code, case when code in ('invalid-hash', 'duplicate-id', 'self-link') then 'error' else 'warning' end as severity, artifact_ids from i)"""
ORACLE_SQL = {
    "descriptor_issues": f"with {_D} select * from s",
    "descriptor_report": f"with {_D}, c as (select count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings from s), n as (select count(*) as compared from d) select compared, errors, warnings, case when errors > 0 then 'inconsistent' when warnings > 0 or compared = 0 then 'unverifiable' else 'consistent' end as status from c, n",
    "descriptor_origins": f"""with recursive {_D}, p as (select a.id, b.id as up from w a left join w b on b.id = a.source_id and b.back = 1 where a.back = 1),
c as (select id, id as spot, 0 as steps, [id] as seen from p union all select c.id, p.up, c.steps + 1, list_append(c.seen, p.up) from c join p on p.id = c.spot where p.up is not null and not list_contains(c.seen, p.up)),
e as (select c.id, c.spot, c.steps, p.up is null as ends from c join p on p.id = c.spot)
select p.id, max(case when ends then spot end) as origin, cast(max(case when ends then steps end) as bigint) as steps, not bool_or(ends) as cyclic from p join e on e.id = p.id group by p.id""",
}

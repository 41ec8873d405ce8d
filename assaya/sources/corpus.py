"""Labelled corpora: cases read from JSON lines, findings judged against them, and metrics by split and language.

A line that is no case is not lost: it comes back with the reason why it is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.policy import ACTIONS, CONFIDENCES, ordinal

# What fields of a case may hold, and other words for vetoes.
SPLITS = ("train", "validation", "holdout")
LANGUAGES = ("typescript", "javascript", "python")
LABELS = ("defect", "waste_candidate", "context_conflict", "assurance_gap", "ambiguous", "hard_negative")
VETO_ALIASES = {"public-api": ("exported", "public api"), "explicit-return-contract": ("explicit return contract",), "overload": ("overload",)}
REQUIRED = {"id": None, "repository": None, "split": SPLITS, "rule_id": None, "anchor": None, "language": LANGUAGES, "label": LABELS, "source": None, "expected_action": ACTIONS}
OPTIONAL = {"expected_confidence": CONFIDENCES, "veto": None}
UNSAFE_ACTIONS = ("propose", "delegate-safe-fix")


def parsed(lines: DataFrame) -> DataFrame:
    """pos, the fields of a case, and reason of ``lines`` (pos, line); blank lines give no row.

    reason is null for a case, else malformed, not-an-object, the first field that is missing or
    holds something else (as ``field:name``), or duplicate-id for all but the first of an id.
    """
    rows = lines.where(F.col("line").rlike(r"\S")).select("pos", "line", F.try_parse_json("line").alias("v"))
    fields = [*REQUIRED, *OPTIONAL]
    raw = {n: F.to_json(F.try_variant_get("v", f"$.{n}", "variant")) for n in fields}
    rows = rows.select("pos", F.col("v").isNull().alias("bad"), F.coalesce(F.startswith(F.ltrim(F.col("line")), F.lit("{")), F.lit(False)).alias("object"), *(raw[n].alias(f"_{n}") for n in fields), *(F.try_variant_get("v", f"$.{n}", "string").alias(n) for n in fields))

    def unfit(name: str, allowed: tuple[str, ...] | None) -> Column:
        text = F.startswith(F.col(f"_{name}"), F.lit('"'))
        wrong = ~F.coalesce(text, F.lit(False))
        if allowed:
            wrong = wrong | ~F.coalesce(F.col(name).isin(*allowed), F.lit(False))
        elif name == "veto":
            wrong = wrong | ~F.coalesce(F.col(name).rlike(r"\S"), F.lit(False))
        return F.col(f"_{name}").isNotNull() & wrong if name in OPTIONAL else wrong

    reason = F.when(F.col("bad"), "malformed").when(~F.col("object"), "not-an-object")
    for name, allowed in (REQUIRED | OPTIONAL).items():
        reason = reason.when(unfit(name, allowed), f"field:{name}")
    judged = rows.select("pos", reason.alias("reason"), *fields)
    nth = F.row_number().over(Window.partitionBy("id", F.col("reason").isNull()).orderBy("pos"))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate-id").otherwise(F.col("reason")))


def leaking(cases: DataFrame) -> DataFrame:
    """repository: those whose cases are in more than one split."""
    return cases.groupBy("repository").agg(F.count_distinct("split").alias("n")).where("n > 1").select("repository")


def _vetoed(veto: Column, against: Column) -> Column:
    """Whether evidence says what the veto names, with blanks for hyphens, or in another word for it."""
    low = F.lower(veto)
    known = F.coalesce(F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in VETO_ALIASES.items() for x in pair))[low], F.array().cast("array<string>"))
    names = F.concat(F.array(F.replace(low, F.lit("-"), F.lit(" "))), known)
    return F.exists(F.coalesce(against, F.array().cast("array<string>")), lambda e: F.exists(names, lambda n: F.contains(F.lower(e), n)))


def judged(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """How the findings of each case's scan meet it: id, repository, split, language, label, passed, actions, confidences, veto_matched, unsafe_action, diagnostic.

    ``findings``: case_id, pos, rule_id, anchor, action, confidence, counter_evidence. Of those with
    the case's rule and anchor the strongest action counts, then the highest confidence, then the first.
    """
    strength = F.struct(ordinal(F.col("action"), ACTIONS, 1).alias("a"), ordinal(F.col("confidence"), CONFIDENCES, 1).alias("c"), (-F.col("pos")).alias("p"))
    own = findings.select(F.col("case_id").alias("id"), "rule_id", "anchor", strength.alias("s"), F.struct("action", "confidence", "counter_evidence").alias("f"))
    best = own.groupBy("id", "rule_id", "anchor").agg(F.max_by("f", "s").alias("f"))
    x = cases.join(best, ["id", "rule_id", "anchor"], "left")
    action, confidence = F.coalesce("f.action", F.lit("ignore")), F.col("f.confidence")
    veto = F.when(F.col("veto").isNotNull(), F.when(F.col("f").isNotNull(), _vetoed(F.col("veto"), F.col("f.counter_evidence"))).otherwise(F.lit(False)))
    unsafe = (F.col("label") == "hard_negative") & action.isin(*UNSAFE_ACTIONS)
    wrong = [
        F.when(action != F.col("expected_action"), F.concat(F.lit("action "), action, F.lit(" for "), "expected_action")),
        F.when(F.col("expected_confidence").isNotNull() & ~F.col("expected_confidence").eqNullSafe(confidence), F.concat(F.lit("confidence "), F.coalesce(confidence, F.lit("none")), F.lit(" for "), "expected_confidence")),
        F.when(~veto, F.concat(F.lit("veto not seen: "), "veto")),
        F.when(unsafe, "unsafe action on a hard negative"),
    ]
    said = F.concat_ws("; ", *wrong)
    return x.select("id", "repository", "split", "language", "label", (said == "").alias("passed"), "expected_action", action.alias("actual_action"), "expected_confidence", confidence.alias("actual_confidence"), veto.alias("veto_matched"), unsafe.alias("unsafe_action"), F.when(said != "", said).alias("diagnostic"))


def metrics(results: DataFrame) -> DataFrame:
    """scope (all, a split or a language), total, passed, hard_negatives, unsafe, precision of actions (null without any) and abstention rate; every split and language has a row."""
    spark = results.sparkSession
    acted = F.col("actual_action").isin(*UNSAFE_ACTIONS)
    hard = F.col("label") == "hard_negative"
    scoped = results.select("passed", "unsafe_action", hard.alias("hard"), acted.alias("acted"), F.explode(F.array(F.lit("all"), "split", "language")).alias("scope"))
    g = scoped.groupBy("scope").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if("hard").alias("hard_negatives"), F.count_if("unsafe_action").alias("unsafe"), F.count_if("acted").alias("acted"), F.count_if(F.col("acted") & ~F.col("hard")).alias("right"))
    scopes = spark.createDataFrame([(s,) for s in ("all", *SPLITS, *LANGUAGES)], "scope string")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    share = lambda k, m: F.when(F.col(m) > 0, F.round(F.col(k) / F.col(m), 6))
    return scopes.join(g, "scope", "left").withColumn("idle", F.col("total") - F.col("acted")).select("scope", *map(n, ("total", "passed", "hard_negatives", "unsafe")), share("right", "acted").alias("action_precision"), share("idle", "total").alias("abstention_rate"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of a corpus, some of them unfit in one way or another."""
    k = F.col("c_custkey")
    at = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    case = F.struct(
        F.concat(F.lit("c"), F.when(k % 41 == 0, k + 1).otherwise(k).cast("string")).alias("id"), F.concat(F.lit("repo"), (k % 12).cast("string")).alias("repository"), F.when(k % 37 == 0, "test").when(k % 24 == 17, SPLITS[0]).otherwise(at(SPLITS, k % 12)).alias("split"),
        F.concat(F.lit("rule"), (k % 3).cast("string")).alias("rule_id"), F.lit("a").alias("anchor"), at(LANGUAGES, F.floor(k / 5)).alias("language"), at(LABELS, k).alias("label"), F.col("c_name").alias("source"),
        at(ACTIONS, F.floor(k / 7)).alias("expected_action"), F.when(k % 2 == 0, at(CONFIDENCES, k)).alias("expected_confidence"), F.when(k % 8 == 0, "public-api").when(k % 8 == 1, "Known-Caller").when(k % 29 == 0, " ").alias("veto"),
    )
    line = F.when(k % 31 == 0, "").when(k % 43 == 0, "[1]").when(k % 47 == 0, "{no").otherwise(F.to_json(case))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("pos"), line.alias("line"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit cases of the corpus against orders as findings of their customers."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    at = lambda v, i: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    said = F.when(o % 3 == 0, F.array(F.lit("Exported by index"))).when(o % 3 == 1, F.array(F.lit("x"), F.lit("a known caller")))
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("c"), c.cast("string")).alias("case_id"), o.alias("pos"), F.concat(F.lit("rule"), (o % 3).cast("string")).alias("rule_id"), F.lit("a").alias("anchor"), at(ACTIONS, F.floor(o / 3)).alias("action"), at(CONFIDENCES, F.floor(o / 11)).alias("confidence"), said.alias("counter_evidence"))
    return judged(parsed(_lines(spark, sf_dir)).where("reason is null"), found)


QUERIES = {
    "corpus_cases": lambda spark, sf: parsed(_lines(spark, sf)).select("pos", "reason", F.when(F.col("reason").isNull(), F.concat_ws("|", *REQUIRED, *OPTIONAL)).alias("fields")),
    "corpus_leakage": lambda spark, sf: leaking(parsed(_lines(spark, sf)).where("reason is null")),
    "corpus_judgement": _judged,
    "corpus_scores": lambda spark, sf: metrics(_judged(spark, sf)),
}


def _at(values: tuple[str, ...], index: str) -> str:
    return f"{list(values)}[{index} % {len(values)} + 1]"


_CASES = f"""k as (select c_custkey as pos, concat('c', case when c_custkey % 41 = 0 then c_custkey + 1 else c_custkey end) as id, concat('repo', c_custkey % 12) as repository, case when c_custkey % 37 = 0 then 'test' when c_custkey % 24 = 17 then 'train' else {_at(SPLITS, "(c_custkey % 12)")} end as split, concat('rule', c_custkey % 3) as rule_id,
  {_at(LANGUAGES, "(c_custkey // 5)")} as language, {_at(LABELS, "c_custkey")} as label, c_name as source, {_at(ACTIONS, "(c_custkey // 7)")} as expected_action, case when c_custkey % 2 = 0 then {_at(CONFIDENCES, "c_custkey")} end as expected_confidence,
  case when c_custkey % 8 = 0 then 'public-api' when c_custkey % 8 = 1 then 'Known-Caller' when c_custkey % 29 = 0 then ' ' end as veto from customer where c_custkey % 31 <> 0),
r as (select *, case when pos % 43 = 0 then 'not-an-object' when pos % 47 = 0 then 'malformed' when split = 'test' then 'field:split' when veto = ' ' then 'field:veto' end as r0 from k),
cs as (select *, case when r0 is null and row_number() over (partition by id, r0 is null order by pos) > 1 then 'duplicate-id' else r0 end as reason from r), ca as (select * from cs where reason is null)"""
_JUDGED = f"""fo as (select concat('c', o_custkey) as id, o_orderkey as pos, concat('rule', o_orderkey % 3) as rule_id, o_orderkey // 3 % 4 as a, o_orderkey // 11 % 3 as c, o_orderkey % 3 as m from orders),
be as (select * from fo qualify row_number() over (partition by id, rule_id order by a desc, c desc, pos) = 1),
x as (select ca.*, be.id is not null as seen, case when be.id is null then 'ignore' else {list(ACTIONS)}[be.a + 1] end as actual_action, {list(CONFIDENCES)}[be.c + 1] as actual_confidence, case when veto is null then null when be.id is null then false when veto = 'public-api' then be.m = 0 else be.m = 1 end as veto_matched
  from ca left join be on be.id = ca.id and be.rule_id = ca.rule_id),
y as (select *, label = 'hard_negative' and actual_action in ('propose', 'delegate-safe-fix') as unsafe_action from x),
z as (select *, concat_ws('; ', case when actual_action <> expected_action then concat('action ', actual_action, ' for ', expected_action) end, case when expected_confidence is not null and expected_confidence is distinct from actual_confidence then concat('confidence ', coalesce(actual_confidence, 'none'), ' for ', expected_confidence) end,
  case when not veto_matched then concat('veto not seen: ', veto) end, case when unsafe_action then 'unsafe action on a hard negative' end) as said from y)"""
ORACLE_SQL = {
    "corpus_cases": f"with {_CASES} select pos, reason, case when reason is null then concat_ws('|', id, repository, split, rule_id, 'a', language, label, source, expected_action, expected_confidence, veto) end as fields from cs",
    "corpus_leakage": f"with {_CASES} select repository from ca group by repository having count(distinct split) > 1",
    "corpus_judgement": f"with {_CASES}, {_JUDGED} select id, repository, split, language, label, said = '' as passed, expected_action, actual_action, expected_confidence, actual_confidence, veto_matched, unsafe_action, case when said <> '' then said end as diagnostic from z",
    "corpus_scores": f"""with {_CASES}, {_JUDGED}, sc as (select unnest({["all", *SPLITS, *LANGUAGES]}) as scope), e as (select unnest(['all', split, language]) as scope, said = '' as passed, label = 'hard_negative' as hard, unsafe_action, actual_action in ('propose', 'delegate-safe-fix') as acted from z)
select sc.scope, count(e.scope) as total, count(*) filter (where passed) as passed, count(*) filter (where hard) as hard_negatives, count(*) filter (where unsafe_action) as unsafe, case when count(*) filter (where acted) > 0 then round(1e0 * count(*) filter (where acted and not hard) / count(*) filter (where acted), 6) end as action_precision,
case when count(e.scope) > 0 then round(1e0 * count(*) filter (where not acted) / count(e.scope), 6) end as abstention_rate from sc left join e on e.scope = sc.scope group by sc.scope""",
}

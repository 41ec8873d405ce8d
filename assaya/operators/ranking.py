"""Ranking without one task that sorts all, and results held to limits of rows and bytes.

A global rank comes from ranges: rows are dealt out by ranges of the whole sort key, sorted within
their partition, numbered there, and the number of rows in the partitions before is added. Ties of
a leading column don't make a hot range, since the key ends in a unique id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .policy import _VIEWS, CONFIDENCES, RISKS, SCORES, _source, named, ordinal
from .relational import RANKED, run
from .shared import use_checkpoints

# Weights and bands of the priority score, and limits of evidence for a number of findings.
RISK_WEIGHT, CONFIDENCE_WEIGHT, EVIDENCE_WEIGHT = 0.6, 0.25, 0.15
BANDS = ((85, "Critical"), (65, "High"), (40, "Medium"))
LEAST_EVIDENCE, MOST_EVIDENCE, EVIDENCE_EACH = 100, 5000, 4
#: Halvings that each of the two passes over an output makes at most.
HALVINGS = 12
#: Bits of monotonically_increasing_id that number the rows of a partition.
_NTH = 33


def placed(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``order``, which must tell all rows apart."""
    spark = rows.sparkSession
    use_checkpoints(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, nth = F.shiftright("_at", _NTH), F.col("_at").bitwiseAND(F.lit((1 << _NTH) - 1))
    before, listed = 0, []
    for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row for each partition
        listed.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(listed, "_part long, _before long")
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + nth + 1).drop("_part", "_before", "_at")


def weighted(findings: DataFrame) -> DataFrame:
    """``findings`` (risk, confidence, evidence_score or null) with score from 0 to 100 and severity."""
    c, r = ordinal(F.col("confidence"), CONFIDENCES, 1), ordinal(F.col("risk"), RISKS, 3)
    evidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("evidence_score", named(c, SCORES))))
    score = F.floor(100 * (RISK_WEIGHT * (r / 3) + CONFIDENCE_WEIGHT * (c / 3) + EVIDENCE_WEIGHT * evidence) + 0.5).cast("int")
    band = F.lit("Low")
    for least, severity in reversed(BANDS):
        band = F.when(F.col("score") >= least, severity).otherwise(band)
    return findings.withColumn("score", score).withColumn("severity", band)


def ranked(findings: DataFrame) -> DataFrame:
    """Weighted ``findings`` with their place by score, file, line, rule and id."""
    return placed(weighted(findings), F.desc("score"), F.col("file_path"), F.col("line"), F.col("rule_id"), F.col("finding_id"))


def omission(rows: DataFrame, what: str, most: int) -> DataFrame:
    """file_path, reason: one row if ``rows`` has more than ``most`` rows, else none."""
    n = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return n.select(F.lit(f"<{what}>").alias("file_path"), F.concat((F.col("n") - most).cast("string"), F.lit(f" of {what} beyond the limit of {most}")).alias("reason"))


def capped(rows: DataFrame, most: int, what: str = "findings") -> tuple[DataFrame, DataFrame]:
    """The first ``most`` of ranked rows, and what was left out."""
    return rows.where(F.col("place") <= most), omission(rows, what, most)


def evidence_limit(most_findings: int) -> int:
    return min(MOST_EVIDENCE, max(LEAST_EVIDENCE, EVIDENCE_EACH * most_findings))


def bounded_evidence(findings: DataFrame, evidence: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` records of ``evidence`` (evidence_id, pos, ...) with their place, and what was left out.

    First come those that ranked ``findings`` (place, evidence_ids, counter_ids) refer to, as the
    findings list them and of an id's records the last; then all others by pos.
    """
    none = F.array().cast("array<string>")
    listed = findings.select("place", F.posexplode(F.concat(F.coalesce("evidence_ids", none), F.coalesce("counter_ids", none))).alias("k", "evidence_id"))
    refs = listed.groupBy("evidence_id").agg(F.min(F.struct("place", "k")).alias("_ref"))
    rest = [c for c in evidence.columns if c not in ("evidence_id", "pos")]
    known = evidence.join(refs, "evidence_id", "left")
    last = known.where("_ref is not null").groupBy("evidence_id", "_ref").agg(F.max(F.struct("pos", *rest)).alias("_e")).select("evidence_id", "_e.pos", *(F.col(f"_e.{c}").alias(c) for c in rest), "_ref")
    rows = last.unionByName(known.where("_ref is null"))
    order = [F.col("_ref").isNull(), F.col("_ref.place"), F.col("_ref.k"), F.col("pos"), F.col("evidence_id")]
    first = rows.orderBy(*order).limit(most)  # a top-k; its few rows are numbered in one task
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("_ref"), omission(rows, "evidence", most)


@dataclass
class Fit:
    """How much of an output stays: the first ``evidence`` and ``findings``, and the skipped rows from ``skipped_from`` to ``skipped_to``."""

    evidence: int
    findings: int
    skipped_from: int
    skipped_to: int
    reduced: bool
    size: int


def _halved(n: int) -> list[int]:
    return [n >> k for k in range(2 * HALVINGS + 1)]


def _sums(rows: DataFrame, cuts: list[int]) -> dict[int, tuple[int, int]]:
    """The bytes and the number of the rows up to each place, all in one pass; key -1 holds those of all rows."""
    cuts = sorted(set(cuts))
    up_to = [F.col("place") <= c for c in cuts]
    found = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1)), *(F.coalesce(F.sum(F.when(t, F.col("bytes"))), F.lit(0)) for t in up_to), *(F.count_if(t) for t in up_to)).first()
    k = len(cuts)
    return {-1: (found[0], found[1])} | {c: (found[2 + i], found[2 + k + i]) for i, c in enumerate(cuts)}


def fit(findings: DataFrame, evidence: DataFrame, skipped: DataFrame, decisions: DataFrame, frame: int, notice: int, most: int) -> Fit:
    """How an output is halved until its JSON takes at most ``most`` bytes; see ``fits``."""
    return fits(findings, evidence, skipped, decisions, frame, notice, [most])[0]


def fits(findings: DataFrame, evidence: DataFrame, skipped: DataFrame, decisions: DataFrame, frame: int, notice: int, limits: list[int]) -> list[Fit]:
    """How an output is halved until its JSON takes at most so many bytes, for each of ``limits``; the tables are summed once for all of them.

    ``findings`` (finding_id, place, bytes), ``evidence`` and ``skipped`` (place, bytes) are numbered from 1;
    ``decisions`` (finding_id, bytes) go with their findings; ``frame`` bytes surround the lists,
    whose items are parted by commas; a reduced output gets a skipped row of ``notice`` bytes.
    Evidence is halved first, then findings, then skipped rows, twelve times at most; after that
    decisions lose those without a finding, and a second pass of twelve begins (of skipped rows the
    last ones stay there). All sizes at which a pass could stop are summed beforehand, so a halving reads nothing.
    """
    n_e, n_f, n_s = (int(d.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]) for d in (evidence, findings, skipped))
    e_sums, f_sums, s_sums = _sums(evidence, _halved(n_e)), _sums(findings, _halved(n_f)), _sums(skipped, [*_halved(n_s), 1])
    own = decisions.join(findings.select("finding_id", "place"), "finding_id", "left")
    d_sums = _sums(own, _halved(n_f))

    def listed(*parts: tuple[int, int]) -> int:
        size, n = (sum(p[k] for p in parts) for k in (0, 1))
        return size + max(0, n - 1)

    def fitted(most: int) -> Fit:
        e, f, s, reduced = n_e, n_f, n_s, False
        total = lambda: frame + listed(e_sums[e]) + listed(f_sums[f]) + listed(s_sums[s]) + listed(d_sums[-1])
        for _ in range(HALVINGS):
            if total() <= most:
                break
            reduced = True
            if e:
                e //= 2
            elif f:
                f //= 2
            elif s > 1:
                s = max(1, s // 2)
            else:
                break
        if not reduced:
            return Fit(e, f, 1, s, False, total())
        kept, length = f, s + 1  # decisions of the findings so far; skipped rows with the notice
        tails = _sums(skipped, [s, *(s - (m - 1) for m in [length, *(max(1, length >> k) for k in range(1, HALVINGS + 1))])])

        def again() -> int:
            tail = tuple(a - b for a, b in zip(tails[s], tails[s - (length - 1)], strict=True))
            return frame + listed(e_sums[e]) + listed(f_sums[f]) + listed(tail, (notice, 1)) + listed(d_sums[kept])

        for _ in range(HALVINGS):
            if again() <= most:
                break
            if e:
                e //= 2
            elif f:
                f //= 2
            elif length > 1:
                length = max(1, length // 2)
            else:
                break
        kept = f
        return Fit(e, f, s - (length - 1) + 1, s, True, again())

    return [fitted(most) for most in limits]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, sf_dir)["findings"].withColumn("evidence_score", F.when(F.col("line") % 4 == 0, (F.col("line") % 11) / 10))


def finding_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_findings(spark, sf_dir)).select("finding_id", "score", "severity", "place")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked findings that cite evidence of the orders table."""
    start = F.col("start_off")
    cited = F.array(F.concat(F.lit("e"), (start * 3).cast("string")), F.concat(F.lit("e"), (start + 7).cast("string")))
    return ranked(_findings(spark, sf_dir)).withColumn("evidence_ids", cited)


def evidence_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence kept beside the first 1,000 findings, and the omissions of both as rows without a place."""
    kept, left = capped(_cited(spark, sf_dir), 1000)
    evidence = _source(spark, sf_dir)["evidence"].select("evidence_id", F.col("start_off").alias("s"), F.expr("cast(substr(evidence_id, 2) as bigint)").alias("pos"))
    held, more = bounded_evidence(kept, evidence, evidence_limit(250))
    lost = left.unionByName(more).select(F.concat_ws(": ", "file_path", "reason").alias("evidence_id"), F.lit(None).cast("long").alias("place"))
    return held.select("evidence_id", "place").unionByName(lost)


def output_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The halving of three outputs that are allowed a part of what they take."""
    findings = ranked(_findings(spark, sf_dir)).select("finding_id", "place", (60 + F.length("finding_id") + F.col("score")).cast("long").alias("bytes"))
    evidence = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 90 + 100).alias("bytes"), "o_orderkey")
    skipped = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 30 + 50).alias("bytes"), "c_custkey")
    evidence, skipped = placed(evidence, F.col("o_orderkey")), placed(skipped, F.col("c_custkey"))
    decisions = findings.select("finding_id", (F.col("place") % 7 + 40).alias("bytes"))
    limits = [100_000_000, 300_000, 20_000]
    rows = [(n, *vars(x).values()) for n, x in zip(limits, fits(findings, evidence, skipped, decisions, 500, 120, limits), strict=True)]
    return spark.createDataFrame(rows, "allowed long, evidence long, findings long, skipped_from long, skipped_to long, reduced boolean, size long")


def finding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every finding of the line items, with its score and severity."""
    rows = run(spark, sf_dir, f"{RANKED} select finding_id, score, file_path, start_off, rule_id, case when score >= 85 then 'Critical' when score >= 65 then 'High' when score >= 40 then 'Medium' else 'Low' end as severity from scored")
    return placed(rows, F.desc("score"), F.col("file_path"), F.col("start_off"), F.col("rule_id"), F.col("finding_id")).select("finding_id", "score", "severity", "place")


QUERIES = {"finding_rank": finding_rank, "finding_priority": finding_priority, "evidence_bound": evidence_bound, "output_fit": output_fit}
_RANK = f"""with {_VIEWS}, sc as (select *, cast(floor(1e2 * (6e-1 * (r / 3e0) + 25e-2 * (c / 3e0) + 15e-2 * case when line % 4 = 0 then (line % 11) / 10 else [4e-1, 7e-1, 95e-2][c] end) + 5e-1) as int) as score from fi),
rk as (select *, row_number() over (order by score desc, file_path, line, rule_id, finding_id) as place from sc)"""
_SIZES = f"""{_RANK}, fb2 as (select place, 60 + length(finding_id) + score as bytes, place % 7 + 40 as d from rk), eb as (select row_number() over (order by o_orderkey) as place, o_orderkey % 90 + 100 as bytes from orders),
sb as (select row_number() over (order by c_custkey) as place, c_custkey % 30 + 50 as bytes from customer),
pre as (select (select list(x order by place) from (select place, sum(bytes) over (order by place) as x from fb2)) as fl, (select list(x order by place) from (select place, sum(d) over (order by place) as x from fb2)) as dl,
  (select list(x order by place) from (select place, sum(bytes) over (order by place) as x from eb)) as el, (select list(x order by place) from (select place, sum(bytes) over (order by place) as x from sb)) as sl)"""


def _size(e: str, f: str, s: str, d: str) -> str:
    """Bytes of the lists up to these numbers of items; ``s`` is the whole term of the skipped rows."""
    return f"500 + coalesce(el[{e}], 0) + greatest({e} - 1, 0) + coalesce(fl[{f}], 0) + greatest({f} - 1, 0) + {s} + coalesce(dl[{d}], 0) + greatest({d} - 1, 0)"


_STEP = "case when e > 0 then e // 2 else 0 end as e, case when e = 0 then f // 2 else f end as f"
_TAIL = "sl[s] - coalesce(sl[s - m + 1], 0) + 120 + m - 1"
_FIT = f"""with recursive {_SIZES.removeprefix("with ")}, al as (select cast(unnest([100000000, 300000, 20000]) as bigint) as allowed),
p1 as (select allowed, 0 as n, len(el) as e, len(fl) as f, len(sl) as s from al, pre union all
  select allowed, n + 1, {_STEP}, case when e = 0 and f = 0 then greatest(1, s // 2) else s end as s from p1, pre where n < {HALVINGS} and (e > 0 or f > 0 or s > 1) and {_size("e", "f", "sl[s] + s - 1", "len(dl)")} > allowed),
q1 as (select * from p1 qualify row_number() over (partition by allowed order by n desc) = 1),
p2 as (select allowed, 0 as n, e, f, s, f as kept, s + 1 as m from q1 where n > 0 union all
  select allowed, n + 1, {_STEP}, s, kept, case when e = 0 and f = 0 then greatest(1, m // 2) else m end as m from p2, pre where n < {HALVINGS} and (e > 0 or f > 0 or m > 1) and {_size("e", "f", _TAIL, "kept")} > allowed),
q2 as (select * from p2 qualify row_number() over (partition by allowed order by n desc) = 1)
select allowed, e as evidence, f as findings, 1 as skipped_from, s as skipped_to, false as reduced, cast({_size("e", "f", "sl[s] + s - 1", "len(dl)")} as bigint) as size from q1, pre where n = 0
union all select allowed, e, f, s - m + 2, s, true, cast({_size("e", "f", _TAIL, "f")} as bigint) from q2, pre"""
ORACLE_SQL = {
    "finding_priority": f"{_RANK} select finding_id, score, case when score >= 85 then 'Critical' when score >= 65 then 'High' when score >= 40 then 'Medium' else 'Low' end as severity, place from rk",
    "evidence_bound": f"""{_RANK}, ci as (select place, unnest([1, 2]) as k, unnest([concat('e', s * 3), concat('e', s + 7)]) as evidence_id from rk where place <= 1000), re as (select evidence_id, min(place * 10 + k) as at from ci group by 1),
al as (select evidence_id, row_number() over (order by re.at is null, re.at, cast(substr(evidence_id, 2) as bigint)) as place from ev left join re using (evidence_id)), n as (select (select count(*) from rk) as f, (select count(*) from ev) as e)
select evidence_id, place from al where place <= 1000 union all select concat('<findings>: ', f - 1000, ' of findings beyond the limit of 1000'), null from n where f > 1000 union all select concat('<evidence>: ', e - 1000, ' of evidence beyond the limit of 1000'), null from n where e > 1000""",
    "output_fit": _FIT,
}

"""Intent: what a finding's context says for and against it, as counts, dimensions, hypotheses, a trace and a limit of action.

Evidence is counted once, by running sums over its places; everything else is one projection over the
counts. Beside the columns of ``policy``, findings have message, classification, unknown and evidence_ids, and evidence
has callers, tests, specifications (arrays of strings), marked_generated and marked_dynamic.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from .policy import _VIEWS, ACTIONS, CONFIDENCES, GRAPH_PROVIDER, _source, named, ordinal, overlapping
from .shared import written

# Patterns over paths, summaries and rules, and kinds of evidence.
GENERATED_PATH = r"(?i)(?:^|/)(?:dist|build|coverage|node_modules|vendor|generated)(?:/|\z)|(?:^|/)(?:generated|vendor)[^/]*\z"
UNKNOWN_DYNAMIC = r"(?i)dynamic|external|reflection|runtime|framework"
SAID_DYNAMIC = r"(?i)dynamic|external consumer|reflection|runtime-only"
SAID_GENERATED = r"(?i)generated|vendor|vendored|machine-maintained"
SAID_REGISTERED, SAID_PUBLIC = r"(?i)registration", r"(?i)public-surface|export"
BEHAVIOUR_KINDS = ("reference", "test", "coverage", "policy")
ANALYZER_KINDS = ("diagnostic", "syntax", "type", "resolution", "control-flow", "data-flow")
FLOW_KINDS = ("control-flow", "data-flow")
DENSITY_RULE = r"density|verbosity|waste|boilerplate|pass-through|redundant|duplicate"
REPETITION_RULE = r"repeat|duplicate|redund|repetition|pass-through"
TEMPLATE_RULE = r"template|boilerplate|pass-through|wrapper"
COHERENCE_RULE = r"coherence|state|control.flow|data.flow"
TONE_RULE = r"tone|style|comment|naming|documentation|docs"
DIMENSIONS = ("relevance", "factuality", "density", "repetition", "templatedness", "coherence", "tone")
#: Lists of names that evidence may have, by the letter that marks their texts; p marks providers.
NAMED = {"c": "callers", "t": "tests", "s": "specifications"}
#: What is counted, and of that what is counted of related evidence only; LISTED: the ids that belong to a count.
LISTED = {"behaviours": "behaviour_ids", "boundaries": "boundary_ids", "origins": "origin_ids", "said_dynamic": "dynamic_ids"}
RELATED = ("flows", *LISTED)
COUNTED = ("coverage", "registrations", "public_surface", "generated", "dynamic", "analyzed", *RELATED)
BOUNDARIES = ("likely-intentional", "framework-required", "compatibility-boundary")


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./+", "")


def same_path(left: DataFrame, right: DataFrame) -> DataFrame:
    """path: the distinct paths of ``left`` (path) that are one of ``right``'s (path), or end in one after a slash, or the other way round.

    Every path offers its endings, so both ways are equality joins.
    """
    tails = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/", -1))), lambda k: F.array_join(F.slice(F.split(c, "/", -1), k, F.lit(1 << 20)), "/"))
    a = left.select("path", _clean(F.col("path")).alias("a")).where("path is not null").distinct()
    b = right.select(_clean(F.col("path")).alias("b")).where("b is not null").distinct()
    longer = a.select("path", F.explode(tails(F.col("a"))).alias("b")).join(b, "b", "left_semi").select("path")
    return longer.unionByName(a.join(b.select(F.explode(tails(F.col("b"))).alias("a")).distinct(), "a", "left_semi").select("path")).distinct()


def _described(evidence: DataFrame) -> DataFrame:
    """Evidence with a 0 or 1 for each of COUNTED and what it names (names: texts under a letter for their list)."""
    kind, said, no = F.col("kind"), F.coalesce("summary", F.lit("")), F.lit(False)
    registered = F.coalesce((F.col("provider_id") == GRAPH_PROVIDER) & said.rlike(SAID_REGISTERED), no)
    public = F.coalesce((kind == "policy") & said.rlike(SAID_PUBLIC), no)
    tests = {
        "coverage": kind == "coverage",
        "registrations": registered,
        "public_surface": public,
        "generated": (kind == "provenance") & (said.rlike(SAID_GENERATED) | F.coalesce("marked_generated", no)),
        "dynamic": said.rlike(SAID_DYNAMIC) | F.coalesce("marked_dynamic", no),
        "analyzed": kind.isin(*ANALYZER_KINDS),
        "flows": kind.isin(*FLOW_KINDS),
        "behaviours": kind.isin(*BEHAVIOUR_KINDS),
        "boundaries": registered | public,
        "origins": kind == "provenance",
        "said_dynamic": said.rlike(SAID_DYNAMIC),
    }
    under = lambda k, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(k), F.coalesce(F.concat(F.lit("="), x), F.lit(""))))
    names = F.array_distinct(F.concat(*(under(k, F.col(c)) for k, c in NAMED.items()), F.when(F.col("provider_id").isNotNull(), F.array(F.concat(F.lit("p="), "provider_id"))).otherwise(F.array().cast("array<string>"))))
    rows = evidence.where("evidence_id is not null")
    return rows.select("evidence_id", "file_path", "source_hash", "start_off", "end_off", names.alias("names"), *(F.coalesce(tests[c], no).cast("long").alias(c) for c in COUNTED))


def _own(findings: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return findings.select("*", F.explode(F.array_distinct(F.concat(F.coalesce("evidence_ids", none), F.coalesce("counter_ids", none)))).alias("evidence_id"))


#: Kinds of the rows of a place: sums where evidence ends, records that its findings name, its scope; then by offset sums where evidence starts, names, findings.
ENDS, NAMED_IDS, SCOPE, STARTS, NAMES, FINDING = range(6)
_RELATED = np.array([c in RELATED for c in COUNTED], dtype=np.int64)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The findings of a place (file, hash) by where they end, with the sums, the names and the providers of what overlaps them or is their own.

    What overlaps [s, e] is what starts up to e without what ends before s. A name is met by a finding if the last end of
    the evidence so far that has it is not before the finding's start. So a place's distinct offsets are held, the last
    end of each of its names, and the records that its findings name.
    """
    place, none = None, np.zeros(len(COUNTED), dtype=np.int64)
    for b in batches:
        rows = [b.column(c).to_pylist() for c in ("_file", "_hash", "_kind", "_low", "_high", "_id", "_names", "_vec")]
        rows += [b.column("row").field(c).to_pylist() for c in ("evidence_ids", "counter_ids")]
        found: list[tuple] = []
        sums: list[np.ndarray] = []
        for file, source, kind, low, high, id_, names, vec, own, counter in zip(*rows, strict=True):
            if (file, source) != place:
                place, last, ends = (file, source), {k: {} for k in (*NAMED, "p")}, {k: [] for k in (*NAMED, "p")}
                closed, before, started, held, in_scope = [], [none], none, {}, False
            if kind == ENDS:
                closed.append(low)
                before.append(before[-1] + vec)
            elif kind == NAMED_IDS:
                held[id_] = (low, high, np.array(vec, dtype=np.int64), names)
            elif kind == SCOPE:
                in_scope = True
            elif kind == STARTS:
                started = started + vec
            elif kind == NAMES:
                for x in names:
                    known, at = last[x[0]].get(x), ends[x[0]]
                    if known is None or known < high:
                        if known is not None:
                            del at[bisect_left(at, known)]
                        insort(at, high)
                        last[x[0]][x] = high
            else:
                ranged, mine = high is not None, dict.fromkeys(names or ())
                total = started - before[bisect_left(closed, low)] if ranged else none
                if vec is not None:
                    total = total + vec
                for i in dict.fromkeys([*(own or ()), *(counter or ())]):
                    if i in held:
                        u, v, counted, its = held[i]
                        twice = ranged and u is not None and v >= low and u <= high
                        # What is counted in the sums as well is taken out again: from RELATED altogether.
                        total = total - counted * _RELATED if twice else total + counted * (1 - _RELATED)
                        mine.update(dict.fromkeys(its))
                new = [x for x in mine if not ranged or last[x[0]].get(x, low - 1) < low]
                met = [(len(ends[k]) - bisect_left(ends[k], low) if ranged else 0) + sum(x[0] == k for x in new) for k in NAMED]
                providers = [x[2:] for x, end in last["p"].items() if ranged and end >= low] + [x[2:] for x in new if x[0] == "p"]
                sums.append(total)
                found.append((*met, providers, in_scope))
        out = b.column("row").filter(pc.equal(b.column("_kind"), FINDING))
        columns = list(zip(*found, strict=True)) or [()] * (len(NAMED) + 2)
        totals = np.array(sums, dtype=np.int64).reshape(len(found), len(COUNTED))
        arrays = [out, *(pa.array(np.ascontiguousarray(totals[:, k])) for k in range(len(COUNTED))), *(pa.array(c, pa.int64()) for c in columns[:-2]), pa.array(columns[-2], pa.list_(pa.string())), pa.array(columns[-1], pa.bool_())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", *COUNTED, *NAMED.values(), "providers", "in_scope"])


def counted(findings: DataFrame, evidence: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``findings`` (without place and range) with the sums of COUNTED, callers, tests, specifications and providers over their own and all overlapping evidence (evidence_id unique), and in_scope (of ``scope``: file_path).

    Own evidence is what the finding names; related evidence overlaps it and is not its own. Both count, but RELATED
    are counts of related evidence. No pair is made, except for ranges that end before they start. Evidence is summed
    by offset and name, and findings are dealt out once, whole; they are read several times, so they should be a table.
    """
    place = ["file_path", "source_hash"]
    kept = [c for c in findings.columns if c not in (*place, "start_off", "end_off")]  # these travel once, as the row's keys
    e = _described(evidence)
    ranged = F.coalesce(F.col("end_off") >= F.col("start_off"), F.lit(False)) & F.col("file_path").isNotNull() & F.col("source_hash").isNotNull()
    at = [F.col("file_path").alias("_file"), F.col("source_hash").alias("_hash")]
    none, kind = F.array().cast("array<string>"), lambda k: F.lit(k).alias("_kind")
    vector = F.array(*COUNTED).alias("_vec")
    low, high = F.col("start_off").cast("long").alias("_low"), F.col("end_off").cast("long").alias("_high")
    within = e.where(ranged)
    offsets = lambda k, o: within.groupBy(*at, o).agg(*(F.sum(c).alias(c) for c in COUNTED)).select("_file", "_hash", kind(k), "_low", vector)
    names = within.select(*at, low, high, F.explode("names").alias("n")).groupBy("_file", "_hash", "_low", "n").agg(F.max("_high").alias("_high")).select("_file", "_hash", kind(NAMES), "_low", "_high", F.array("n").alias("_names"))
    own_ids = F.array_distinct(F.concat(F.coalesce("evidence_ids", none), F.coalesce("counter_ids", none)))
    asked = findings.select(*at, F.explode(own_ids).alias("evidence_id")).distinct()
    here = (F.col("_file") == F.col("file_path")) & (F.col("_hash") == F.col("source_hash")) & ranged
    held = asked.join(e, "evidence_id").select("_file", "_hash", kind(NAMED_IDS), F.when(here, F.col("start_off").cast("long")).alias("_low"), F.when(here, F.col("end_off").cast("long")).alias("_high"), F.col("evidence_id").alias("_id"), F.col("names").alias("_names"), vector)
    rows = findings.select(*at, kind(FINDING), F.when(ranged, F.col("start_off").cast("long")).alias("_low"), F.when(ranged, F.col("end_off").cast("long")).alias("_high"), F.struct(*kept).alias("row"))
    odd = _odd(findings, e)
    if odd is not None:
        rows = rows.join(odd, F.col("row.finding_id") == F.col("_odd"), "left").drop("_odd")
    for more in (offsets(ENDS, F.col("end_off").cast("long").alias("_low")), offsets(STARTS, low), names, held):
        rows = rows.unionByName(more, allowMissingColumns=True)
    if scope is not None:
        rows = rows.unionByName(findings.select(*place).distinct().join(scope, "file_path").select(*at, kind(SCOPE)), allowMissingColumns=True)
    for c, type_ in (("_names", "array<string>"), ("_vec", "array<bigint>")):
        rows = rows.withColumn(c, F.col(c).cast(type_))
    turn = F.when(F.col("_kind") == FINDING, F.col("_high")).otherwise(F.col("_low"))
    swept = rows.repartition("_file", "_hash").sortWithinPartitions("_file", "_hash", F.col("_kind") >= STARTS, turn, "_kind")
    numbers = [StructField(c, LongType()) for c in (*COUNTED, *NAMED.values())]
    schema = StructType([StructField("row", StructType([findings.schema[c] for c in kept])), *numbers, StructField("providers", ArrayType(StringType())), StructField("in_scope", BooleanType())])
    out = swept.mapInArrow(_swept, schema)
    return out.select("row.*", *COUNTED, *NAMED.values(), F.array_sort("providers").alias("providers"), "in_scope")


def _odd(findings: DataFrame, e: DataFrame) -> DataFrame | None:
    """_odd (finding_id), _names and _vec of related evidence whose own range, or the finding's, ends before it starts: pairs, since sums don't hold for them."""
    turned, ranged = F.col("end_off") < F.col("start_off"), F.col("end_off") >= F.col("start_off")
    pairs = [overlapping(a, b) for a, b, some in ((findings.where(turned), e, findings.where(turned)), (findings.where(ranged), e.where(turned), e.where(turned))) if not some.isEmpty()]
    if not pairs:
        return None
    near = (pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1])).join(_own(findings).select("finding_id", "evidence_id"), ["finding_id", "evidence_id"], "left_anti")
    return near.join(e.select("evidence_id", "names", *COUNTED), "evidence_id").groupBy(F.col("finding_id").alias("_odd")).agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("_names"), F.array(*(F.sum(c) for c in COUNTED)).alias("_vec"))


def contexts(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id and what its own and its overlapping evidence counts to; see ``counted``."""
    x = findings.select("finding_id", "file_path", "source_hash", "start_off", "end_off", "evidence_ids", "counter_ids")
    return counted(x, evidence).select("finding_id", *COUNTED, *NAMED.values(), "providers")


def supporting(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id and the sorted ids of its related evidence of each kind that a hypothesis names; as many as there are overlaps."""
    near = overlapping(findings, evidence).join(_own(findings).select("finding_id", "evidence_id"), ["finding_id", "evidence_id"], "left_anti")
    x = near.join(_described(evidence).select("evidence_id", *LISTED), "evidence_id")
    return x.groupBy("finding_id").agg(*(F.array_sort(F.collect_set(F.when(F.col(c) > 0, F.col("evidence_id")))).alias(ids) for c, ids in LISTED.items()))


def assess(findings: DataFrame, evidence: DataFrame, scanned: DataFrame, skipped: DataFrame, completeness: str = "complete", documentation: bool = False, listed: bool = True) -> DataFrame:
    """One row a finding: its counts, dimensions (map of status), hypotheses (kind, confidence, numbers and ids of support and against), trace (step, result), status and action_limit.

    The ids are as many as the overlaps, which grow with the square of the input; without ``listed`` they are left out.

    ``scanned`` and ``skipped`` are paths (path); ``completeness`` is that of the whole scan
    (complete, partial or abstained). Nothing is certain without a complete scan; counterevidence,
    open unknowns or a contradicted hypothesis contest it; only a supported finding without
    generated or dynamic signals and of no R3 risk keeps its action, others are held at observe.
    """
    none = F.array().cast("array<string>")
    strings = lambda c: F.coalesce(c, none)
    files = findings.select(F.col("file_path").alias("path")).distinct()
    scope = same_path(files, scanned).join(same_path(files, skipped), "path", "left_anti").select(F.col("path").alias("file_path"))
    # Findings are dealt out with what is read of them later: long texts as flags, lists that are only counted as numbers.
    rule = F.lower(F.concat_ws(" ", "rule_id", "message"))
    flags = {
        "density": rule.rlike(DENSITY_RULE), "repetition": rule.rlike(REPETITION_RULE), "template": rule.rlike(TEMPLATE_RULE), "coherence": rule.rlike(COHERENCE_RULE), "tone": rule.rlike(TONE_RULE),
        "generated": F.col("file_path").rlike(GENERATED_PATH), "defect": F.col("classification") == "defect", "waste": F.col("classification") == "waste_candidate",
    }
    bits = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(flags.values())), F.lit(0))
    flag = lambda n: F.col("flags").bitwiseAND(F.lit(1 << list(flags).index(n))) != 0
    size = lambda c: F.size(strings(c)).alias(f"n_{c}")
    said = F.size(F.filter(strings("unknown"), lambda u: u.rlike(UNKNOWN_DYNAMIC))).alias("n_dynamic")
    kept = ("finding_id", "file_path", "source_hash", "start_off", "end_off", "confidence", "risk", "action", "evidence_ids", "counter_ids")
    x = counted(findings.select(*kept, bits.alias("flags"), size("counter_evidence"), size("unknown"), said), evidence, scope)
    x = x.join(supporting(findings, evidence), "finding_id", "left") if listed else x
    for c in (*(LISTED.values() if listed else ()), "evidence_ids", "counter_ids"):
        x = x.withColumn(c, strings(c))
    x = x.withColumn("generated", F.col("generated") + F.when(flag("generated"), 1).otherwise(0))
    x = x.withColumn("dynamic", F.col("dynamic") + F.col("n_dynamic"))
    whole = completeness == "complete"
    relevant = F.lit("abstained") if completeness == "abstained" else F.when(F.col("in_scope"), "complete").otherwise("partial")
    behaves = (F.col("callers") > 0) | (F.col("tests") > 0) | (F.col("specifications") > 0) | (F.col("coverage") > 0)
    countered, defect = F.col("n_counter_evidence") > 0, flag("defect")
    status = lambda test: F.when(test, "observed").otherwise("unknown")
    dimensions = {
        "relevance": status(behaves),
        "factuality": F.when(countered, "conflict").otherwise(status(defect & (F.col("analyzed") > 0))),
        "density": status(flag("density")),
        "repetition": status(flag("repetition")),
        "templatedness": status(flag("template")),
        "coherence": status((F.col("flows") > 0) | flag("coherence")),
        "tone": status(flag("tone") | F.lit(documentation)),
    }
    x = x.withColumn("dimensions", F.create_map(*(v for n in DIMENSIONS for v in (F.lit(n), dimensions[n]))))
    c = ordinal(F.col("confidence"), CONFIDENCES, 1)
    capped = lambda most: named(F.least(c, F.lit(most)).cast("int"), CONFIDENCES)
    boundary = (F.col("registrations") > 0) | (F.col("public_surface") > 0)
    sure = defect & (c > 1) & ~countered & F.lit(whole)
    waste = flag("waste")

    # Related evidence is never a finding's own, so ids of both kinds are counted apart.
    ids = {c: (F.col(n), F.col(c) if listed else None) for n, c in LISTED.items()}
    ids |= {c: (F.size(c), F.col(c)) for c in ("evidence_ids", "counter_ids")}

    def hypothesis(test: Column, kind: Column | str, confidence: Column, support: tuple[str, ...], against: tuple[str, ...] = ()) -> Column:
        def number(names: tuple[str, ...]) -> Column:
            distinct = [F.size(F.array_distinct(c)) if c in ("evidence_ids", "counter_ids") and len(names) > 1 else ids[c][0] for c in names]
            return sum(distinct, F.lit(0)).cast("long")

        def all_of(names: tuple[str, ...]) -> Column:
            return F.array_distinct(F.concat(*(ids[c][1] for c in names))) if len(names) > 1 else ids[names[0]][1] if names else none

        lists = [all_of(support).alias("support"), all_of(against).alias("against")] if listed else []
        return F.when(test, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), confidence.alias("confidence"), number(support).alias("n_support"), number(against).alias("n_against"), *lists))

    col = F.col
    rows = F.array_compact(F.array(
        hypothesis(boundary, F.when(col("registrations") > 0, "framework-required").otherwise("compatibility-boundary"), F.lit("C2"), ("boundary_ids",)),
        hypothesis(behaves, "likely-intentional", capped(2), ("behaviour_ids",), ("counter_ids",)),
        hypothesis(col("generated") > 0, "generated-or-vendored", F.lit("C2"), ("origin_ids", "evidence_ids")),
        hypothesis(col("dynamic") > 0, "external-or-dynamic-context", F.lit("C1"), ("dynamic_ids",)),
        hypothesis(sure, "likely-defect", capped(3), ("evidence_ids",)),
        hypothesis(waste & ~boundary & ~behaves, "duplicate-contract", capped(1), ("evidence_ids",), ("counter_ids",)),
        hypothesis(~boundary & ~behaves & ~sure, "suspicious-structure", capped(1), ("evidence_ids",), ("counter_ids", "behaviour_ids")),
    ))
    x = x.withColumn("hypotheses", rows).withColumn("relevant", relevant)
    contested = countered | (F.col("n_unknown") > 0) | F.exists("hypotheses", lambda h: h["n_against"] > 0)
    x = x.withColumn("status", F.when(F.lit(not whole), "unknown").when(contested, "contested").when(boundary | behaves | sure, "supported").otherwise("unknown"))
    free = (col("status") == "supported") & (col("generated") == 0) & (col("dynamic") == 0) & ~countered & F.coalesce(col("risk") != "R3", F.lit(False))
    a = ordinal(col("action"), ACTIONS, 1)
    x = x.withColumn("action_limit", named(F.when(free, a).otherwise(F.least(a, F.lit(2))).cast("int"), ACTIONS))
    values = F.map_values("dimensions")
    passed = lambda test: F.when(test, "pass").otherwise("unknown")
    steps = {
        "dimension-gate": F.when(F.array_contains(values, "conflict"), "conflict").otherwise(passed(F.array_contains(values, "observed"))),
        "scan-completeness": F.lit("pass" if whole else "unknown"),
        "relevant-scope": passed(col("relevant") == "complete"),
        "public-boundary": passed(boundary),
        "behavioral-contract": passed(behaves),
        "evidence-diversity": passed(F.size("providers") >= 2),
        "generated-origin": F.when(col("generated") > 0, "pass"),
        "dynamic-context": F.when(col("dynamic") > 0, "unknown"),
        "deterministic-defect": F.when(sure, "pass").when(countered, "conflict").otherwise("unknown"),
        "intent-authority": F.when(col("status") == "supported", "pass").when(col("status") == "contested", "conflict").otherwise("unknown"),
        "action-authority": passed(col("action_limit") == named(a, ACTIONS)),
    }
    trace = F.array_compact(F.array(*(F.when(r.isNotNull(), F.struct(F.lit(step).alias("step"), r.alias("result"))) for step, r in steps.items())))
    counts = ("callers", "tests", "specifications", "coverage", "registrations", "public_surface", "generated", "dynamic", "providers", "relevant")
    return x.select("finding_id", *counts, "dimensions", "hypotheses", trace.alias("trace"), "status", "action_limit")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The findings and evidence of the policy chain with what an assessment reads beside."""
    t, line, start = _source(spark, sf_dir), F.col("line"), F.col("start_off")
    t["findings"] = written(t["findings"].drop("anchor", "counter_ids"), "findings")  # read several times
    kinds = F.element_at(F.array(*map(F.lit, ("defect", "waste_candidate", "context_conflict"))), (line % 3 + 1).cast("int"))
    unknown = F.when(line % 6 == 0, F.array(F.lit("dynamic loading"))).when(line % 6 == 1, F.array(F.lit("other")))
    findings = t["findings"].select("*", F.lit("control flow").alias("message"), kinds.alias("classification"), unknown.alias("unknown"), F.array(F.concat(F.lit("e"), (start * 3).cast("string"))).alias("evidence_ids")).withColumn("counter_ids", F.when(F.size("counter_evidence") > 1, F.array(F.lit("none"))))
    key = F.expr("cast(substr(evidence_id, 2) as bigint)")
    e = t["evidence"].withColumn("k", key).withColumn("cover", F.col("missing_lines").isNotNull()).withColumn("open", F.col("surface_names").isNotNull())
    kind = F.when(F.col("open"), "policy").when(F.col("cover"), F.when(F.col("k") % 3 == 0, "coverage").otherwise("diagnostic")).when(F.col("provider_id") == GRAPH_PROVIDER, "reference").when(F.col("k") % 20 == 0, "provenance").otherwise("note")
    text = F.when(F.col("open") & (F.col("k") % 2 == 0), "public-surface delta").when(F.col("k") % 33 == 0, "runtime-only use").otherwise(F.col("summary"))
    listed = lambda p, test: F.when(test, F.array(F.lit(p), F.concat(F.lit(p), (F.col("k") % 4).cast("string"))))
    evidence = e.select("evidence_id", "provider_id", kind.alias("kind"), text.alias("summary"), "file_path", "source_hash", "start_off", "end_off", listed("c", F.col("k") % 14 == 1).alias("callers"), listed("t", F.col("k") % 15 == 2).alias("tests"), listed("s", F.col("k") % 27 == 3).alias("specifications"), (F.col("k") % 40 == 0).alias("marked_generated"), (F.col("k") % 100 == 7).alias("marked_dynamic"))
    number = F.regexp_extract("file_path", r"(\d+)", 1).cast("int")
    paths = t["findings"].select("file_path", number.alias("n")).distinct()
    scanned = paths.where("n % 11 <> 0").select(F.when(F.col("n") % 2 == 0, F.concat(F.lit("f"), "n")).otherwise(F.concat(F.lit("repo/"), "file_path")).alias("path"))
    return findings, evidence, scanned, paths.where("n % 7 = 0").select(F.concat(F.lit("./"), "file_path").alias("path"))


def intent_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(*_inputs(spark, sf_dir), listed=False)
    flat = lambda c, *names: F.array_join(F.transform(c, lambda h: F.concat_ws(":", *(h[n] for n in names))), " ")
    shown = F.transform("hypotheses", lambda h: F.concat_ws(":", h["kind"], h["confidence"], h["n_support"].cast("string"), h["n_against"].cast("string")))
    return out.select("finding_id", *(F.col(c).alias(c) for c in ("callers", "tests", "specifications", "coverage", "registrations", "public_surface", "generated", "dynamic")), F.array_join("providers", ",").alias("providers"), "relevant", F.array_join(F.map_values("dimensions"), ",").alias("dimensions"), F.array_join(shown, " ").alias("hypotheses"), flat("trace", "step", "result").alias("trace"), "status", "action_limit")


QUERIES = {"intent_assessment": intent_assessment}
_ON = "case when {} then 'observed' else 'unknown' end"
_OK = "case when {} then 'pass' else 'unknown' end"
_H = "case when {test} then concat('{kind}:', {confidence}, ':', {support}, ':', {against}) end"
ORACLE_SQL = {
    "intent_assessment": f"""with {_VIEWS}, f0 as (select *, case line % 3 when 0 then 'defect' when 1 then 'waste_candidate' else 'context_conflict' end as class, case line % 6 when 0 then 1 when 1 then 1 else 0 end as open, line % 6 = 0 as dyn, concat('e', s * 3) as own, len(said) as nc from fi),
e0 as (select evidence_id, kind as g, cast(substr(evidence_id, 2) as bigint) as k, summary as old, file_path, s, e, case when kind < 2 then 'repository-graph' when kind < 4 then 'coverage-lcov' else 'other' end as provider from ev),
e1 as (select *, case when g = 0 then 'policy' when g in (2, 3) then case when k % 3 = 0 then 'coverage' else 'diagnostic' end when g = 1 then 'reference' when k % 20 = 0 then 'provenance' else 'note' end as kind, case when g = 0 and k % 2 = 0 then 'public-surface delta' when k % 33 = 0 then 'runtime-only use' else old end as summary from e0),
l as (select finding_id, own as evidence_id, true as mine from f0 union all select f.finding_id, v.evidence_id, false from f0 f join e1 v on v.file_path = f.file_path and v.e >= f.s and v.s <= f.e and v.evidence_id <> f.own),
j as (select l.finding_id, l.mine, e1.*, g < 2 and contains(summary, 'registration') as reg, kind = 'policy' and contains(summary, 'public-surface') as pub, contains(summary, 'runtime-only') as sd from l join e1 on e1.evidence_id = l.evidence_id),
n as (select finding_id, list_distinct(flatten(list(case when k % 14 = 1 then ['c', concat('c', k % 4)] else [] end))) as ca, list_distinct(flatten(list(case when k % 15 = 2 then ['t', concat('t', k % 4)] else [] end))) as te, list_distinct(flatten(list(case when k % 27 = 3 then ['s', concat('s', k % 4)] else [] end))) as sp,
  count(*) filter (where kind = 'coverage') as cov, count(*) filter (where reg) as reg, count(*) filter (where pub) as pub, count(*) filter (where kind = 'provenance' and k % 40 = 0) as gen, count(*) filter (where sd or k % 100 = 7) as dyn, string_agg(distinct provider, ',' order by provider) as prov, count(distinct provider) as np,
  count(*) filter (where kind in ('diagnostic')) as ana, count(*) filter (where not mine and kind in ('reference', 'coverage', 'policy')) as nb, count(*) filter (where not mine and (reg or pub)) as nr, count(*) filter (where not mine and kind = 'provenance') as no_, count(*) filter (where not mine and sd) as nd from j group by finding_id),
x as (select f.*, coalesce(len(ca), 0) as callers, coalesce(len(te), 0) as tests, coalesce(len(sp), 0) as specifications, coalesce(cov, 0) as coverage, coalesce(reg, 0) as registrations, coalesce(pub, 0) as public_surface, coalesce(gen, 0) as generated, coalesce(n.dyn, 0) + case when f.dyn then 1 else 0 end as dynamic, coalesce(prov, '') as providers, coalesce(np, 0) as np,
  coalesce(ana, 0) as ana, coalesce(nb, 0) as nb, coalesce(nr, 0) as nr, coalesce(no_, 0) as no_, coalesce(nd, 0) as nd, cast(regexp_extract(file_path, '[0-9]+') as int) as fn, case when nc > 1 then 1 else 0 end as nk from f0 f left join n on n.finding_id = f.finding_id),
y as (select *, callers > 0 or tests > 0 or specifications > 0 or coverage > 0 as beh, registrations > 0 or public_surface > 0 as bnd, class = 'defect' and c > 1 and nc = 0 as sure, case when fn % 11 <> 0 and fn % 7 <> 0 then 'complete' else 'partial' end as relevant,
  contains(rule_id, 'pass-through') as pt, contains(rule_id, 'duplicate') as du from x),
z as (select *, case when nc > 0 or open > 0 or not (bnd or beh or sure) and nb > 0 then 'contested' when bnd or beh or sure then 'supported' else 'unknown' end as status, {_ON.format("beh")} as d1, case when nc > 0 then 'conflict' when class = 'defect' and ana > 0 then 'observed' else 'unknown' end as d2, {_ON.format("pt or du")} as d3, {_ON.format("pt")} as d5 from y),
w as (select *, case when status = 'supported' and generated = 0 and dynamic = 0 and nc = 0 and r <> 3 then a else least(a, 2) end as lim from z)
select finding_id, callers, tests, specifications, coverage, registrations, public_surface, generated, dynamic, providers, relevant, concat_ws(',', d1, d2, d3, d3, d5, 'observed', 'unknown') as dimensions,
concat_ws(' ', {_H.format(test="bnd", kind="', case when registrations > 0 then 'framework-required' else 'compatibility-boundary' end, '", confidence="'C2'", support="nr", against="0")}, {_H.format(test="beh", kind="likely-intentional", confidence="concat('C', least(c, 2))", support="nb", against="nk")},
  {_H.format(test="generated > 0", kind="generated-or-vendored", confidence="'C2'", support="no_ + 1", against="0")}, {_H.format(test="dynamic > 0", kind="external-or-dynamic-context", confidence="'C1'", support="nd", against="0")}, {_H.format(test="sure", kind="likely-defect", confidence="concat('C', c)", support="1", against="0")},
  {_H.format(test="class = 'waste_candidate' and not bnd and not beh", kind="duplicate-contract", confidence="'C1'", support="1", against="nk")}, {_H.format(test="not bnd and not beh and not sure", kind="suspicious-structure", confidence="'C1'", support="1", against="nk + nb")}) as hypotheses,
concat_ws(' ', concat('dimension-gate:', case when nc > 0 then 'conflict' else 'pass' end), 'scan-completeness:pass', concat('relevant-scope:', {_OK.format("relevant = 'complete'")}), concat('public-boundary:', {_OK.format("bnd")}), concat('behavioral-contract:', {_OK.format("beh")}), concat('evidence-diversity:', {_OK.format("np >= 2")}),
  case when generated > 0 then 'generated-origin:pass' end, case when dynamic > 0 then 'dynamic-context:unknown' end, concat('deterministic-defect:', case when sure then 'pass' when nc > 0 then 'conflict' else 'unknown' end), concat('intent-authority:', case status when 'supported' then 'pass' when 'contested' then 'conflict' else 'unknown' end),
  concat('action-authority:', {_OK.format("lim = a")})) as trace, status, {list(ACTIONS)}[lim] as action_limit from w""",
}

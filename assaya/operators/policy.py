"""Policy: what a finding may lead to, from rules, suppressions, feedback, evidence and calibration.

``decide`` is the whole chain as joins and one projection; the functions above it are its parts and
can be used alone. Columns that the functions expect:

- findings: finding_id (unique), rule_id, file_path, source_hash, anchor, line, start_off, end_off,
  confidence (C1 to C3), risk (R1 to R3), action, counter_evidence and counter_ids (arrays of strings)
- rules: rule_id (unique), risk, confidence_cap, maximum_action
- suppressions: pos (place in the list), rule_id, file_path, anchor, source_hash, expires_at, reason;
  a null or empty field fits anything
- feedback: pos, finding_id, rule_id, source_hash, outcome, unsafe, evidence_score
- evidence: evidence_id, provider_id, kind, summary, file_path, source_hash, start_off, end_off,
  missing_lines (array of int, coverage) and surface_names (array of string, public surface)

Defined results: a finding of unknown confidence, risk or action counts as C1, R3 and ignore; null
arrays are empty; an unsafe of null is false; empty tables on any side simply match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .shared import use_checkpoints, written

# Names and limits of the policy.
CONFIDENCES = ("C1", "C2", "C3")
RISKS = ("R1", "R2", "R3")
ACTIONS = ("ignore", "observe", "propose", "delegate-safe-fix")
SCORES = (0.4, 0.7, 0.95)
THRESHOLDS = (0.55, 0.7, 0.9)
CLOSING = ("intentional", "wrong-location", "duplicate", "insufficient-evidence", "local-convention")
WRAPPER_RULE, UNTESTED_RULE = "structure.pass-through-wrapper", "assurance.no-linked-tests"
GRAPH_PROVIDER, COVERAGE_PROVIDERS, SURFACE_KIND, ANCHOR_PREFIX = "repository-graph", "coverage-", "policy", "function:"
RULES = (
    ("dependency.unresolved", "R2", "C3", "observe"),
    ("structure.pass-through-wrapper", "R2", "C2", "propose"),
    ("errors.suppressed", "R2", "C2", "observe"),
    ("data.hidden-catch-fallback", "R3", "C2", "observe"),
    ("structure.duplicate-capability", "R2", "C1", "observe"),
    ("assurance.no-linked-tests", "R2", "C1", "observe"),
    ("architecture.disallowed-dependency", "R3", "C2", "observe"),
)
LEAST_SAMPLES, Z, ERROR = 20, 1.96, 0.1

#: Offsets that share a bin of an interval join; most rows of either side that meet at once in a bin, and candidate pairs of a task.
OFFSET_BIN, MEETING, TASK_PAIRS = 256, 4096, 16_000_000
#: Bytes of rows that are gathered before they leave a worker.
HELD_BYTES = 16 << 20
#: What discovered counterevidence says; the first is followed by the evidence's summary.
REGISTERED, EXPORTED, COVERED = "registered in the repository graph: ", "part of the public surface", "line run under coverage"


def ordinal(value: Column, names: tuple[str, ...], unknown: int) -> Column:
    at = F.array_position(F.array(*map(F.lit, names)), value).cast("int")
    return F.when(at > 0, at).otherwise(F.lit(unknown))


def named(at: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at)


def _wilson(k: Column, n: Column, sign: int) -> Column:
    p, z2 = k / n, Z * Z
    margin = Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    return ((p + z2 / (2 * n)) + sign * margin) / (1 + z2 / n)


def active_suppressions(findings: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """finding_id, pos, reason of the first suppression in list order that fits and has not expired.

    A suppression is keyed by its rule and by which of its fields are set; a place (rule, file, anchor
    and hash) looks up one key for each such combination in use (eight at most). Places are looked up
    once, whatever the number of their findings, which then meet one row each.
    """
    placed = findings.where("rule_id is not null").select("finding_id", *_at())
    return placed.join(_hits(placed, suppressions, now), list(_AT)).select("finding_id", "s.pos", "s.reason")


_FIELDS = ("file_path", "anchor", "source_hash")
_AT = ("_rule", *(f"_at_{c}" for c in _FIELDS))


def _at() -> list[Column]:
    """The columns of a finding's place, as suppressions are looked up."""
    return [F.col("rule_id").alias("_rule"), *(F.coalesce(c, F.lit("")).alias(f"_at_{c}") for c in _FIELDS)]


def _hits(placed: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """The places of ``placed`` that a suppression fits, with the first one (s: pos, reason)."""
    is_set = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in _FIELDS}
    mask = sum((F.when(is_set[c], 1 << k).otherwise(0) for k, c in enumerate(_FIELDS)), F.lit(0))
    keys = [F.when(is_set[c], F.col(c)).otherwise("").alias(f"_{c}") for c in _FIELDS]
    live = suppressions.where(F.col("rule_id").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    first = live.groupBy(F.col("rule_id").alias("_rule"), mask.alias("_mask"), *keys).agg(F.min(F.struct("pos", "reason")).alias("_s"))
    used = sorted(r[0] for r in first.select("_mask").distinct().collect())  # eight at most
    if not used:
        used = [0]
    looked = placed.select(*_AT).distinct().withColumn("_mask", F.explode(F.array(*map(F.lit, used))))
    own = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << k)) != 0, F.col(f"_at_{c}")).otherwise("").alias(f"_{c}") for k, c in enumerate(_FIELDS)]
    return looked.select(*_AT, "_mask", *own).join(first, ["_rule", "_mask", *(f"_{c}" for c in _FIELDS)]).groupBy(*_AT).agg(F.min("_s").alias("s"))


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last record of each finding by position (at one position the largest values)."""
    rows = feedback.where("finding_id is not null").groupBy("finding_id").agg(F.max(F.struct("pos", "outcome", "source_hash", "unsafe")).alias("f"))
    return rows.select("finding_id", "f.outcome", F.col("f.source_hash").alias("reviewed_hash"), F.coalesce("f.unsafe", F.lit(False)).alias("unsafe"))


def rule_health(feedback: DataFrame) -> DataFrame:
    """rule_id, samples, accepted, rejected, unsafe_actions, rule_precision, lower_bound, selective_threshold, conformal_threshold, status.

    Records are counted by rule and score before any window, so a rule with many records is as many rows as it has scores.
    """
    s = F.col("evidence_score")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    accepted, unsafe = F.col("outcome") == "accepted", F.coalesce("unsafe", F.lit(False))
    counted = feedback.where("rule_id is not null").groupBy("rule_id", F.when(finite, s).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if(accepted).alias("good"), F.count_if(~F.coalesce(accepted, F.lit(False)) | unsafe).alias("bad"), F.count_if(unsafe).alias("unsafe"))
    above = Window.partitionBy("rule_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("rule_id")
    known = counted.where("score is not null")
    rows = known.select("rule_id", "score", "good", F.sum("n").over(above).alias("n"), F.sum("bad").over(above).alias("bad"), F.sum("good").over(above).alias("up_to"), F.sum("good").over(whole).alias("all_good"))
    chosen = (F.col("n") >= LEAST_SAMPLES) & (_wilson(F.col("bad"), F.col("n"), 1) <= ERROR)
    place = F.least(F.col("all_good"), F.ceil((F.col("all_good") + 1) * F.lit(1 - ERROR)))
    kth = (F.col("all_good") >= LEAST_SAMPLES) & (F.col("up_to") >= place)
    limits = rows.groupBy("rule_id").agg(F.min(F.when(chosen, F.col("score"))).alias("selective_threshold"), F.max(F.when(kth, F.col("score"))).alias("k"))
    limits = limits.select("rule_id", "selective_threshold", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (1 - F.col("k")))).alias("conformal_threshold"))
    total = counted.groupBy("rule_id").agg(F.sum("n").alias("samples"), F.sum("good").alias("accepted"), F.sum("unsafe").alias("unsafe_actions"))
    lower = _wilson(F.col("accepted"), F.col("samples"), -1)
    status = F.when(F.col("unsafe_actions") > 0, "disabled").when(F.col("samples") < LEAST_SAMPLES, "insufficient-data").when(lower >= 0.9, "healthy").otherwise("observe-only")
    return total.join(limits, "rule_id", "left").select("rule_id", "samples", "accepted", (F.col("samples") - F.col("accepted")).alias("rejected"), "unsafe_actions", (F.col("accepted") / F.col("samples")).alias("rule_precision"), lower.alias("lower_bound"), F.when(F.col("samples") >= LEAST_SAMPLES, F.col("selective_threshold")).alias("selective_threshold"), "conformal_threshold", status.alias("status"))


def overlapping(findings: DataFrame, evidence: DataFrame, what: str = "evidence_id") -> DataFrame:
    """finding_id and ``what`` of the evidence of the same file and hash whose closed ranges overlap; each pair once, in the first bin that both touch.

    The pairs are the result, so tasks are made as many as the candidates ask for, and a bin of over ``MEETING`` rows of a
    side is split: each part of one side meets each part of the other in a group of its own.
    """
    spark, keys = findings.sparkSession, ["file_path", "source_hash", "bin"]
    use_checkpoints(spark)
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / OFFSET_BIN), F.floor(F.greatest(a, b) / OFFSET_BIN)))
    known = "start_off is not null and end_off is not null and file_path is not null and source_hash is not null"
    left = findings.where(known).select("finding_id", "file_path", "source_hash", F.col("start_off").alias("s"), F.col("end_off").alias("e"), bins("start_off", "end_off").alias("bin")).checkpoint()
    right = evidence.where(known).select(what, "file_path", "source_hash", F.col("start_off").alias("u"), F.col("end_off").alias("v"), bins("start_off", "end_off").alias("bin")).checkpoint()
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("r")), keys)
    large = (F.col("l") > MEETING) | (F.col("r") > MEETING)
    met, split = sizes.agg(F.sum(F.col("l").cast("double") * F.col("r")), F.count_if(large)).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((met or 0) // TASK_PAIRS) + 1)
    if split:
        parts = sizes.where(large).select(*keys, F.ceil(F.col("l") / MEETING).cast("int").alias("m"), F.ceil(F.col("r") / MEETING).cast("int").alias("n"))

        def dealt(rows: DataFrame, mine: str, other: str, *values: str) -> DataFrame:
            own = F.pmod(F.xxhash64(*values), F.coalesce(mine, F.lit(1))).cast("int").alias(f"_{mine}")
            all_others = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(f"_{other}")
            return rows.join(parts, keys, "left").select(*rows.columns, own, all_others)

        left, right = dealt(left, "m", "n", "finding_id", "s", "e"), dealt(right, "n", "m", what, "u", "v")
        keys = [*keys, "_m", "_n"]
    first = F.floor(F.greatest("s", "u") / OFFSET_BIN) == F.col("bin")
    pairs = left.repartition(n, *keys).join(right.repartition(n, *keys), keys)  # by number, so that few bytes are not put into few tasks
    return pairs.where((F.col("v") >= F.col("s")) & (F.col("u") <= F.col("e")) & first).select("finding_id", what)


def exported(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id of wrappers whose name ends the qualified name of a symbol of the public surface."""
    wrappers = findings.where(F.col("rule_id") == WRAPPER_RULE).select("finding_id", F.regexp_replace("anchor", f"^{ANCHOR_PREFIX}", "").alias("name"))
    return wrappers.join(_surface(evidence), "name", "left_semi").select("finding_id")


def _surface(evidence: DataFrame) -> DataFrame:
    """name: the last parts of the names of the public surface."""
    return evidence.where((F.col("provider_id") == GRAPH_PROVIDER) & (F.col("kind") == SURFACE_KIND)).select(F.explode("surface_names").alias("q")).select(F.element_at(F.split("q", r"\.", -1), -1).alias("name")).distinct()


def missing_ranges(evidence: DataFrame) -> DataFrame:
    """evidence_id, file_path, first, last: runs of successive missing lines of each coverage record, found within its row."""
    rows = evidence.select("evidence_id", "file_path", F.array_sort(F.array_distinct(F.array_compact("missing_lines"))).alias("lines"))
    lines = F.col("lines")
    starts = F.filter(lines, lambda x, k: F.coalesce(F.get(lines, k - 1) != x - 1, F.lit(True)))
    ends = F.filter(lines, lambda x, k: F.coalesce(F.get(lines, k + 1) != x + 1, F.lit(True)))
    return rows.select("evidence_id", "file_path", F.explode(F.arrays_zip(starts.alias("first"), ends.alias("last"))).alias("r")).select("evidence_id", "file_path", "r.first", "r.last")


def executed(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id of untested-code findings whose line some coverage record of the file does not miss."""
    asked = findings.where((F.col("rule_id") == UNTESTED_RULE) & F.col("line").isNotNull())
    return executed_lines(asked.select("file_path", "line", "finding_id"), evidence).select("finding_id")


def executed_lines(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rows of ``asked`` (file_path, line, ...) whose line some coverage record of the file does not miss.

    A line is run unless all the file's records miss it. How many miss it is a running sum over the
    file's lines of where ranges of missing lines begin and end, summed by line beforehand, so no
    line meets the records one by one.
    """
    covers = evidence.where(F.startswith(F.col("provider_id"), F.lit(COVERAGE_PROVIDERS)) & F.col("file_path").isNotNull())
    records = covers.groupBy("file_path").agg(F.count_distinct("evidence_id").alias("records"))
    turns = F.explode(F.array(F.struct(F.col("first").alias("line"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("line"), F.lit(-1).alias("d")))).alias("t")
    marks = missing_ranges(covers).select("file_path", turns).groupBy("file_path", F.col("t.line").cast("long").alias("line")).agg(F.sum("t.d").alias("d")).withColumn("asked", F.lit(False))
    rows = asked.where("line is not null").withColumn("line", F.col("line").cast("long")).withColumn("d", F.lit(0).cast("long")).withColumn("asked", F.lit(True))
    so_far = Window.partitionBy("file_path").orderBy("line", "asked").rowsBetween(Window.unboundedPreceding, 0)
    missed = marks.unionByName(rows, allowMissingColumns=True).withColumn("missed", F.sum("d").over(so_far)).where("asked")
    return missed.join(records, "file_path").where(F.col("missed") < F.col("records")).select(*asked.columns)


def contained(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """message, summary: distinct summaries that occur in distinct messages; each message offers its parts of the lengths that summaries have."""
    sizes = [r[0] for r in summaries.select(F.length("summary").alias("n")).distinct().collect() if r[0] is not None]  # different lengths only
    known = summaries.select("summary").distinct()
    none = F.array().cast("array<string>")

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length("message") - n + 1)
        return F.when(F.length("message") >= n, F.transform(places, lambda k: F.substring(F.col("message"), k, F.lit(n)))).otherwise(none)

    parts = [of_length(n) for n in sizes] or [none]
    n = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few messages, but many parts of each
    found = messages.select("message").distinct().repartition(n, "message").select("message", F.explode(F.array_distinct(F.concat(*parts))).alias("summary"))
    return found.join(known, "summary").select("message", "summary")


class Said:
    """For each message the ids of the records whose summary it holds, as places in the sorted list of all such ids."""

    def __init__(self, links: pa.Table, pairs: pa.Table):
        summaries, ids = pairs["summary"].combine_chunks(), pairs["evidence_id"].combine_chunks()
        known, distinct = pc.unique(summaries), pc.unique(ids)
        sorted_ids = distinct.take(pc.sort_indices(distinct)).cast(pa.large_string())
        code, rank = (np.asarray(pc.index_in(v, value_set=w), dtype=np.int32) for v, w in ((summaries, known), (ids.cast(pa.large_string()), sorted_ids)))
        order = np.lexsort((rank, code))
        self.ranks = rank[order]
        self.starts = np.searchsorted(code[order], np.arange(len(known) + 1))
        self.ids = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), sorted_ids, pa.scalar(",", pa.large_string())) if len(sorted_ids) else sorted_ids  # each after a comma
        at = {x: k for k, x in enumerate(known.to_pylist())}
        self.parts: dict[str, list[int]] = {}
        for message, summary in zip(links["message"].to_pylist(), links["summary"].to_pylist(), strict=True):
            if summary in at:
                self.parts.setdefault(message, []).append(at[summary])

    def of(self, messages: list[str]) -> pa.Array:
        """The sorted ids of all of ``messages``, each after a comma."""
        parts = {p for m in messages for p in self.parts.get(m, ())}
        found = np.sort(np.concatenate([self.ranks[:0], *(self.ranks[self.starts[p] : self.starts[p + 1]] for p in parts)]))
        if len(parts) > 1:
            found = found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found
        return self.ids.take(pa.array(found))


def _joined(ids: pa.Array) -> bytes:
    """The text of successive ids without the first comma."""
    _, offsets, data = ids.buffers()
    return memoryview(data)[1 : np.frombuffer(offsets, np.int64)[len(ids)]].tobytes() if len(ids) else b""


def _gathered(batches: Iterator[pa.RecordBatch], said, joined: bool) -> Iterator[pa.RecordBatch]:
    """Findings with their messages and the records behind them; of a place come first what is registered, by start, names that are exported and lines that are run."""
    said, kinds = said.value, (pa.list_(pa.string()), pa.string() if joined else pa.list_(pa.string()))
    place, index, known = None, None, (None, None, None)
    for b in batches:
        rows = [b.column(c).to_pylist() for c in ("_file", "_hash", "_slot", "_kind", "_low", "_high", "_text", "_line")]
        held = b.column("row").filter(pc.equal(b.column("_kind"), 3))
        own = held.field("counter_ids").to_pylist()
        done, out, size = 0, [], 0
        for file, source, slot, kind, low, high, text, line in zip(*rows, strict=True):
            if (file, source, slot) != place:
                place, index, spans, names, lines, known = (file, source, slot), None, [], set(), set(), (None, None, None)
            if kind == 0:
                spans.append((low, high, text))
                continue
            if kind < 3:
                (names if kind == 1 else lines).add(text if kind == 1 else line)
                continue
            if index is None:
                texts = sorted({t for _, _, t in spans})
                code = {t: k for k, t in enumerate(texts)}
                starts, ends, codes = (np.array(v, dtype=np.int64) for v in ([s[0] for s in spans], [s[1] for s in spans], [code[s[2]] for s in spans]))
                index, texts = (starts, ends, codes, np.maximum.accumulate(ends)), [REGISTERED + t for t in texts]
            hit = ()
            if low is not None:
                starts, ends, codes, last = index
                near = slice(int(np.searchsorted(last, low)), int(np.searchsorted(starts, high, "right")))
                hit = np.unique(codes[near][ends[near] >= low])
            key = (hit if low is None else hit.tobytes(), text in names, line in lines)
            if known[0] != key:
                messages = sorted([texts[k] for k in hit] + [EXPORTED] * key[1] + [COVERED] * key[2])
                ids = said.of(messages)
                known = (key, messages or None, _joined(ids).decode() if joined else [x[1:] for x in ids.to_pylist()])
            messages, ids, mine = known[1], known[2], own[done + len(out)]
            if joined and mine and messages:
                ids = ",".join(sorted({*filter(None.__ne__, mine), *filter(None, ids.split(","))}, key=lambda x: x.encode()))
            out.append((messages, ids if messages else None))
            size += sum(map(len, messages or ())) + (len(ids) if joined else 16 * len(ids))
            if size > HELD_BYTES:
                yield _batch(held.slice(done, len(out)), out, kinds)
                done, out, size = done + len(out), [], 0
        if out:
            yield _batch(held.slice(done, len(out)), out, kinds)


def _batch(rows: pa.Array, found: list[tuple], kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows, *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=["row", "messages", "found_ids"])


def counterevidence(findings: DataFrame, evidence: DataFrame, joined: bool = False) -> DataFrame:
    """``findings`` with messages and found_ids: what the evidence says against them, and the records that say it; null if there is nothing.

    A finding's messages and records grow with the evidence, so they are never dealt out: findings and what is said in their
    places are, and each row is made whole where it leaves. The ids of what any message holds (as many as there are such
    records) are sent to all workers. With ``joined``, found_ids is one text, the finding's own counter_ids among them.
    A place whose candidate pairs are over ``TASK_PAIRS`` is dealt over several tasks.
    """
    place = ["file_path", "source_hash"]
    registered = evidence.where((F.col("provider_id") == GRAPH_PROVIDER) & F.contains("summary", F.lit("registration")))
    registered = registered.where("start_off is not null and end_off is not null and file_path is not null and source_hash is not null").select("summary", *place, F.col("start_off").cast("long").alias("low"), F.col("end_off").cast("long").alias("high")).distinct()  # what is said once in a place is enough
    wrapper, untested = F.coalesce(F.col("rule_id") == WRAPPER_RULE, F.lit(False)), F.coalesce(F.col("rule_id") == UNTESTED_RULE, F.lit(False))
    ranged = wrapper & F.col("start_off").isNotNull() & F.col("end_off").isNotNull()
    per_place = findings.where(ranged).groupBy(*place).agg(F.count(F.lit(1)).alias("l"))
    registered = written(registered.join(per_place.select(*place), place, "left_semi"), "registered")
    pairs = F.col("l").cast("double") * F.col("r")
    hot = per_place.join(registered.groupBy(*place).agg(F.count(F.lit(1)).alias("r")), place).where(pairs > TASK_PAIRS).select(*place, F.least(F.col("l"), F.ceil(pairs / TASK_PAIRS)).cast("int").alias("_n"))
    hot = F.broadcast(written(hot, "hot"))
    slots = F.coalesce("_n", F.lit(1))
    name = F.when(wrapper, F.regexp_replace("anchor", f"^{ANCHOR_PREFIX}", ""))
    asked = findings.where(wrapper | untested).join(hot, place, "left").select(
        *(F.col(c).alias(a) for c, a in zip(place, ("_file", "_hash"), strict=True)), F.pmod(F.xxhash64("start_off", "end_off"), slots).cast("int").alias("_slot"), F.lit(3).alias("_kind"),
        F.when(ranged, F.col("start_off").cast("long")).alias("_low"), F.when(ranged, F.col("end_off").cast("long")).alias("_high"), name.alias("_text"), F.when(untested, F.col("line").cast("long")).alias("_line"), F.struct(*findings.columns).alias("row"),
    )
    at = ["_file", "_hash", "_slot"]
    spans = registered.join(hot, place, "left").select(F.col("file_path").alias("_file"), F.col("source_hash").alias("_hash"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("_slot"), F.lit(0).alias("_kind"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("summary").alias("_text"))
    names = asked.where("_text is not null").select(*at, F.lit(1).alias("_kind"), "_text").distinct()
    names = names.join(_surface(evidence).select(F.col("name").alias("_text")), "_text", "left_semi")
    lines = asked.where("_line is not null").select(*at, F.lit(2).alias("_kind"), "_line").distinct()
    run = executed_lines(findings.where(untested).select("file_path", "line").distinct(), evidence).select(F.col("file_path").alias("_file"), F.col("line").alias("_line"))
    lines = lines.join(run, ["_file", "_line"], "left_semi")
    rows = asked
    for more in (spans, names, lines):
        rows = rows.unionByName(more, allowMissingColumns=True)
    dealt = rows.repartition(*at).sortWithinPartitions(*at, "_kind", "_low", "_high")
    # Which records a message names: it holds their summary.
    spark, records = findings.sparkSession, evidence.where("evidence_id is not null and summary is not null").select("evidence_id", "summary")
    messages = registered.select(F.concat(F.lit(REGISTERED), "summary").alias("message")).unionByName(spark.createDataFrame([(EXPORTED,), (COVERED,)], "message string"))
    links = written(contained(messages, records), "links")
    said = spark.sparkContext.broadcast(Said(links.toArrow(), records.join(links.select("summary").distinct(), "summary").select("summary", "evidence_id").distinct().toArrow()))
    ids = StringType() if joined else ArrayType(StringType())
    schema = StructType([StructField("row", StructType(findings.schema.fields)), StructField("messages", ArrayType(StringType())), StructField("found_ids", ids)])
    found = dealt.mapInArrow(partial(_gathered, said=said, joined=joined), schema).select("row.*", "messages", "found_ids")
    return found.unionByName(findings.where(~(wrapper | untested)), allowMissingColumns=True)


def decide(findings: DataFrame, rules: DataFrame, suppressions: DataFrame, feedback: DataFrame, evidence: DataFrame, now: Column, available: bool = True, joined: bool = False) -> DataFrame:
    """One decision for each finding: finding_id, suppressed, confidences and actions before and after, evidence_score, reasons, counter_evidence, counter_ids.

    Steps, in this order: the first fitting suppression ends all else; counterevidence found in the
    evidence is added; the rule's caps (C2 and observe for a rule that is not registered);
    counterevidence, then risk R3, cap the action at observe; the score follows from the capped
    confidence; a proposal needs the largest of the risk's, the selective and the conformal threshold;
    an unhealthy rule caps at observe; a score under 0.5 lowers confidence to C1; and the last feedback
    on this very source accepts (whatever was capped) or closes. Without state (``available`` false)
    suppressions and feedback are not read and nothing goes beyond observe. With ``joined``, counter_ids
    is one text of the sorted ids, parted by commas.
    """
    if not available:
        suppressions, feedback = suppressions.where("false"), feedback.where("false")
    strings = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    per_rule = rules.select("rule_id", F.col("risk").alias("rule_risk"), "confidence_cap", "maximum_action", F.lit(True).alias("registered")).join(rule_health(feedback).select("rule_id", "selective_threshold", "conformal_threshold", "status"), "rule_id", "full_outer")
    x = written(findings, "findings").select("*", *_at())
    x = x.join(_hits(x.where("_rule is not null"), suppressions, now).select(*_AT, F.lit(True).alias("hit"), F.col("s.reason").alias("why")), list(_AT), "left").drop(*_AT)
    x = x.join(latest_feedback(feedback), "finding_id", "left").join(F.broadcast(per_rule), "rule_id", "left")  # a row for each rule
    # A suppressed finding meets no evidence; and what evidence says comes last, since its lists are long and are not dealt out again.
    x = written(x, "known")
    unsuppressed = x.where("hit is null")
    found = counterevidence(unsuppressed, evidence, joined=True) if joined else counterevidence(unsuppressed, evidence)
    x = found.unionByName(x.where("hit is not null"), allowMissingColumns=True)
    x = x.withColumn("suppressed", F.coalesce("hit", F.lit(False))).withColumn("registered", F.coalesce("registered", F.lit(False)))
    x = x.withColumn("said", F.array_distinct(F.concat(strings("counter_evidence"), strings("messages")))).withColumn("said_ids", F.coalesce("found_ids", text(F.array_distinct(strings("counter_ids")))) if joined else F.array_distinct(F.concat(strings("counter_ids"), strings("found_ids"))))
    c, r, a = ordinal(F.col("confidence"), CONFIDENCES, 1), ordinal(F.col("risk"), RISKS, 3), ordinal(F.col("action"), ACTIONS, 1)
    observe, propose = 2, 3
    x = x.withColumn("r", r).withColumn("c", F.least(c, F.when(F.col("registered"), ordinal(F.col("confidence_cap"), CONFIDENCES, 1)).otherwise(2)))
    x = x.withColumn("a1", F.least(a, F.when(F.col("registered"), ordinal(F.col("maximum_action"), ACTIONS, 1)).otherwise(observe)))
    veto, manual = F.size("said") > 0, F.col("r") == 3
    x = x.withColumn("a2", F.when(veto | manual, F.least("a1", F.lit(observe))).otherwise(F.col("a1")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), named(F.col("c"), SCORES) - F.least(F.lit(0.6), F.size("said") * F.lit(0.2))))
    limit = F.greatest(named(F.col("r"), THRESHOLDS), F.coalesce("selective_threshold", F.lit(0.0)), F.coalesce("conformal_threshold", F.lit(0.0)))
    x = x.withColumn("score", score).withColumn("limit", limit)
    low = (F.col("a2") == propose) & (F.col("score") < F.col("limit"))
    unhealthy = F.coalesce(F.col("status").isin("observe-only", "disabled"), F.lit(False))
    a3 = F.when(low, observe).otherwise(F.col("a2"))
    x = x.withColumn("a3", F.when(unhealthy, F.least(a3, F.lit(observe))).otherwise(a3))
    same = F.coalesce(F.col("reviewed_hash") == F.col("source_hash"), F.lit(False))
    approved = same & (F.col("outcome") == "accepted") & F.col("registered") & ~F.col("unsafe")
    closed = same & F.col("outcome").isin(*CLOSING)
    last = F.when(F.coalesce(approved, F.lit(False)), propose).when(F.coalesce(closed, F.lit(False)), 1).otherwise(F.col("a3"))
    last = last if available else F.least(last, F.lit(observe))
    when = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text if isinstance(text, Column) else F.lit(text))
    reasons = [
        when(~F.col("registered"), "unregistered rule"),
        when(F.col("registered") & ~F.col("rule_risk").eqNullSafe(F.col("risk")), F.concat(F.lit("risk differs from the rule's "), F.col("rule_risk"))),
        when(veto, "counterevidence"),
        when(manual, "R3 needs manual review"),
        when(low, F.format_string("score %.2f under threshold %.2f", "score", "limit")),
        when(unhealthy, F.concat(F.lit("rule "), F.col("status"))),
        when(F.col("score") < 0.5, "score under 0.50"),
        when(approved, "accepted in review"),
        when(~F.coalesce(approved, F.lit(False)) & closed, F.concat(F.lit("closed in review: "), F.col("outcome"))),
        F.lit(None if available else "no policy state"),
    ]
    gone, none = F.col("suppressed"), F.lit(None).cast("array<string>")
    reason = F.when(gone, F.array(F.concat(F.lit("suppressed: "), F.coalesce("why", F.lit(""))))).otherwise(F.array_compact(F.array(*reasons)))
    final_c = F.when(gone, c).when(F.col("score") < 0.5, 1).otherwise(F.col("c"))
    return x.select(
        "finding_id", "suppressed", named(c, CONFIDENCES).alias("original_confidence"), named(final_c, CONFIDENCES).alias("final_confidence"), named(a, ACTIONS).alias("original_action"),
        named(F.when(gone, 1).otherwise(last).cast("int"), ACTIONS).alias("final_action"), F.when(gone, 0.0).otherwise(F.col("score")).alias("evidence_score"), reason.alias("reasons"),
        F.when(gone, strings("counter_evidence")).otherwise(F.col("said")).alias("counter_evidence"), F.when(gone, text(strings("counter_ids")) if joined else strings("counter_ids")).otherwise(F.col("said_ids")).alias("counter_ids"),
    ).withColumn("reasons", F.coalesce("reasons", none))


# The chain over the driver's tables: the same views are written in Spark (below) and in SQL (further below).
_RULE_NAMES = (*(r[0] for r in RULES), "experimental.other", "experimental.none")
_NOW = "2000-01-01"


def _source(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text, rule = (lambda p, c: F.concat(F.lit(p), c.cast("string"))), (lambda k: F.element_at(F.array(*map(F.lit, _RULE_NAMES)), (k + 1).cast("int")))
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    lines = read("lineitem").withColumn("f", (F.col("l_suppkey") + 100 * (o % 4)) % 400).withColumn("finding_id", F.concat_ws("-", o, n, p))
    one = lines.groupBy("finding_id", "l_orderkey", "l_linenumber", "l_partkey").agg(F.min("f").alias("f"), F.min("l_quantity").cast("long").alias("q"))
    callers = F.when(n == 6, F.array(F.lit("known caller"))).when(n == 7, F.array(F.lit("known caller"), F.lit("known test"))).otherwise(F.array().cast("array<string>"))
    findings = one.select("finding_id", rule(p % 8).alias("rule_id"), text("src/f", F.col("f")).alias("file_path"), text("h", F.col("f")).alias("source_hash"), text("function:n", p % 30).alias("anchor"), (o % 300 + 1).alias("line"), (o % 5000).alias("start_off"), (o % 5000 + F.col("q")).alias("end_off"), text("C", n % 3 + 1).alias("confidence"), text("R", F.floor(p / 8) % 3 + 1).alias("risk"), F.element_at(F.array(*map(F.lit, (*ACTIONS, "propose"))), (o % 5 + 1).cast("int")).alias("action"), callers.alias("counter_evidence"), F.array().cast("array<string>").alias("counter_ids"))
    k = F.col("c_custkey")
    suppressions = read("customer").select(k.alias("pos"), rule((F.col("c_nationkey") % 9).cast("long")).alias("rule_id"), F.when(k % 7 != 0, text("src/f", k % 400)).alias("file_path"), F.when(k % 5 != 0, text("function:n", k % 30)).otherwise("").alias("anchor"), F.when(k % 35 == 0, text("h", k % 400)).alias("source_hash"), F.when(F.col("c_acctbal") < 0, F.lit("1990-01-01")).when(F.col("c_nationkey") > 12, F.lit("2090-01-01")).cast("timestamp").alias("expires_at"), F.col("c_mktsegment").alias("reason"))
    fine = ~((F.col("l_tax") == 0.08) & (F.col("l_quantity") > 25))
    outcome = F.when((p % 8).isin(0, 1, 3), F.when(fine, "accepted").otherwise("intentional")).when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "intentional").otherwise("uncertain")
    said = lines.where("l_discount >= 5e-2").select(((o * 8 + n) * 2).alias("pos"), "finding_id", rule(p % 8).alias("rule_id"), F.when(F.col("l_tax") < 0.06, text("h", F.col("f"))).otherwise("old").alias("source_hash"), outcome.alias("outcome"), ((p % 8 == 2) & (F.col("l_quantity") == 1)).alias("unsafe"), ((p % 20) / 20).alias("evidence_score"), ((F.col("l_extendedprice") > 50000) & ~(p % 8).isin(0, 1, 3)).alias("again"))
    feedback = said.drop("again").unionByName(said.where("again").drop("again").withColumn("pos", F.col("pos") + 1).withColumn("outcome", F.lit("duplicate")))
    key, kind = F.col("o_orderkey"), F.col("o_custkey") % 5
    summary = F.when(kind == 1, text("runtime registration ", key % 2500)).when((kind == 4) & (key % 50 == 0), "registration 1").when(kind == 4, text("note ", key)).otherwise("seen")
    evidence = read("orders").select(text("e", key).alias("evidence_id"), F.when(kind < 2, GRAPH_PROVIDER).when(kind < 4, "coverage-lcov").otherwise("other").alias("provider_id"), F.when(kind == 0, SURFACE_KIND).otherwise("reference").alias("kind"), summary.alias("summary"), text("src/f", F.col("o_custkey") % 400).alias("file_path"), text("h", F.col("o_custkey") % 400).alias("source_hash"), (key % 5000).alias("start_off"), (key % 5000 + 200).alias("end_off"), F.when(kind.isin(2, 3), F.sequence((key % 50 + 1).cast("int"), (key % 50 + 250).cast("int"))).alias("missing_lines"), F.when(kind == 0, F.array(text("pkg.n", key % 12))).alias("surface_names"))
    rules = spark.createDataFrame(list(RULES), "rule_id string, risk string, confidence_cap string, maximum_action string")
    return {"findings": findings, "suppressions": suppressions, "feedback": feedback, "evidence": evidence, "rules": rules}


def policy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _source(spark, sf_dir)
    out = decide(t["findings"], t["rules"], t["suppressions"], t["feedback"], t["evidence"], F.lit(_NOW).cast("timestamp"), joined=True)
    return out.select("finding_id", "suppressed", "original_confidence", "final_confidence", "original_action", "final_action", F.round("evidence_score", 6).alias("evidence_score"), F.array_join("reasons", "; ").alias("reasons"), F.size("counter_evidence").alias("n_counter"), "counter_ids")


def health_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rule_health(_source(spark, sf_dir)["feedback"])
    return out.select("rule_id", "samples", "accepted", "rejected", "unsafe_actions", *(F.round(c, 6).alias(c) for c in ("rule_precision", "lower_bound", "selective_threshold", "conformal_threshold")), "status")


QUERIES = {
    "policy_chain": policy_chain,
    "policy_health": health_by_rule,
    "policy_suppressions": lambda spark, sf: active_suppressions((t := _source(spark, sf))["findings"], t["suppressions"], F.lit(_NOW).cast("timestamp")),
    "coverage_veto": lambda spark, sf: executed((t := _source(spark, sf))["findings"], t["evidence"]),
    "surface_veto": lambda spark, sf: exported((t := _source(spark, sf))["findings"], t["evidence"]),
    "registration_overlap": lambda spark, sf: overlapping((t := _source(spark, sf))["findings"].where(F.col("rule_id") == WRAPPER_RULE), t["evidence"].where(F.contains("summary", F.lit("registration")))),
}


def _list(values) -> str:
    return f"[{', '.join(repr(v) for v in values)}]"


_VIEWS = f"""li as (select *, (l_suppkey + 100 * (l_orderkey % 4)) % 400 as f, concat(l_orderkey, '-', l_linenumber, '-', l_partkey) as finding_id from lineitem),
fi as (select finding_id, {_list(_RULE_NAMES)}[l_partkey % 8 + 1] as rule_id, concat('src/f', min(f)) as file_path, concat('h', min(f)) as source_hash, concat('function:n', l_partkey % 30) as anchor, l_orderkey % 300 + 1 as line,
  l_orderkey % 5000 as s, l_orderkey % 5000 + cast(min(l_quantity) as bigint) as e, l_linenumber % 3 + 1 as c, l_partkey // 8 % 3 + 1 as r, [1, 2, 3, 4, 3][l_orderkey % 5 + 1] as a,
  case l_linenumber when 6 then ['known caller'] when 7 then ['known caller', 'known test'] else [] end as said from li group by finding_id, l_orderkey, l_linenumber, l_partkey),
su as (select c_custkey as pos, {_list(_RULE_NAMES)}[c_nationkey % 9 + 1] as rule_id, case when c_custkey % 7 <> 0 then concat('src/f', c_custkey % 400) end as file_path, case when c_custkey % 5 <> 0 then concat('function:n', c_custkey % 30) end as anchor,
  case when c_custkey % 35 = 0 then concat('h', c_custkey % 400) end as source_hash, c_mktsegment as reason from customer where c_acctbal >= 0),
f1 as (select (l_orderkey * 8 + l_linenumber) * 2 as pos, finding_id, {_list(_RULE_NAMES)}[l_partkey % 8 + 1] as rule_id, case when l_tax < 6e-2 then concat('h', f) else 'old' end as source_hash,
  case when l_partkey % 8 in (0, 1, 3) then case when l_tax = 8e-2 and l_quantity > 25 then 'intentional' else 'accepted' end when l_returnflag = 'A' then 'accepted' when l_returnflag = 'R' then 'intentional' else 'uncertain' end as outcome,
  l_partkey % 8 = 2 and l_quantity = 1 as unsafe, (l_partkey % 20) / 20 as evidence_score, l_extendedprice > 50000 and l_partkey % 8 not in (0, 1, 3) as again from li where l_discount >= 5e-2),
fb as (select pos, finding_id, rule_id, source_hash, outcome, unsafe, evidence_score from f1 union all select pos + 1, finding_id, rule_id, source_hash, 'duplicate', unsafe, evidence_score from f1 where again),
ev as (select concat('e', o_orderkey) as evidence_id, o_custkey % 5 as kind, case when o_custkey % 5 = 1 then concat('runtime registration ', o_orderkey % 2500) when o_custkey % 5 = 4 and o_orderkey % 50 = 0 then 'registration 1' when o_custkey % 5 = 4 then concat('note ', o_orderkey) else 'seen' end as summary,
  concat('src/f', o_custkey % 400) as file_path, o_orderkey % 5000 as s, o_orderkey % 5000 + 200 as e, o_orderkey % 50 + 1 as miss_from, o_orderkey % 50 + 250 as miss_to, concat('n', o_orderkey % 12) as exported from orders)"""
_HEALTH = f"""u as (select rule_id, evidence_score as s, outcome = 'accepted' as ok, outcome <> 'accepted' or unsafe as bad, unsafe from fb),
cut as (select a.rule_id, a.s, count(*) as n, count(*) filter (where b.bad) as bad from (select distinct rule_id, s from u) a join (select rule_id, s, bad from u) b on a.rule_id = b.rule_id and b.s >= a.s group by a.rule_id, a.s),
sel as (select rule_id, min(s) as selective_threshold from cut where n >= 20 and ((1e0 * bad / n + {Z * Z} / (2e0 * n)) + {Z} * sqrt((1e0 * bad / n * (1 - 1e0 * bad / n) + {Z * Z} / (4e0 * n)) / n)) / (1 + {Z * Z} / (1e0 * n)) <= 1e-1 group by rule_id),
con as (select rule_id, list_sort(list(1 - s)) as miss from u where ok group by rule_id having count(*) >= 20),
g as (select rule_id, count(*) as n, count(*) filter (where ok) as k, count(*) filter (where unsafe) as bad from u group by rule_id),
health as (select g.rule_id, n, k, bad, ((1e0 * k / n + {Z * Z} / (2e0 * n)) - {Z} * sqrt((1e0 * k / n * (1 - 1e0 * k / n) + {Z * Z} / (4e0 * n)) / n)) / (1 + {Z * Z} / (1e0 * n)) as low, case when n >= 20 then selective_threshold end as selective_threshold,
  greatest(0e0, least(1e0, 1 - miss[least(len(miss), cast(ceil((len(miss) + 1) * 9e-1) as bigint))])) as conformal_threshold from g left join sel on sel.rule_id = g.rule_id left join con on con.rule_id = g.rule_id),
stat as (select *, case when bad > 0 then 'disabled' when n < 20 then 'insufficient-data' when low >= 9e-1 then 'healthy' else 'observe-only' end as status from health)"""
_SUPPRESSED = "hit as (select f.finding_id, min_by(s.pos, s.pos) as pos, min_by(s.reason, s.pos) as reason from fi f join su s on s.rule_id = f.rule_id and (s.file_path is null or s.file_path = f.file_path) and (s.anchor is null or s.anchor = f.anchor) and (s.source_hash is null or s.source_hash = f.source_hash) group by f.finding_id)"
_OVER = f"ov as (select f.finding_id, v.evidence_id, v.kind, v.summary from fi f join ev v on f.rule_id = '{WRAPPER_RULE}' and v.file_path = f.file_path and v.e >= f.s and v.s <= f.e and v.summary like '%registration%')"
_SURFACE = f"ex as (select finding_id from fi where rule_id = '{WRAPPER_RULE}' and replace(anchor, 'function:', '') in (select exported from ev where kind = 0))"
_COVERED = f"co as (select distinct f.finding_id from fi f join ev v on f.rule_id = '{UNTESTED_RULE}' and v.kind in (2, 3) and v.file_path = f.file_path and f.line not between v.miss_from and v.miss_to)"
_RULES = "rules(rule_id, risk, cap, top) as (values " + ", ".join(f"('{a}', {b[1]}, {c[1]}, {ACTIONS.index(d) + 1})" for a, b, c, d in RULES) + ")"
_CHAIN = f"""with {_VIEWS}, {_HEALTH}, {_SUPPRESSED}, {_OVER}, {_SURFACE}, {_COVERED}, {_RULES},
m as (select distinct finding_id, concat('{REGISTERED}', summary) as message from ov where kind = 1 union select finding_id, '{EXPORTED}' from ex union select finding_id, '{COVERED}' from co),
mi as (select x.message, list(distinct v.evidence_id) as ids from (select distinct message from m) x join ev v on contains(x.message, v.summary) group by x.message),
d as (select m.finding_id, list(distinct m.message) as messages, list_distinct(flatten(list(coalesce(mi.ids, [])))) as ids from m left join mi on mi.message = m.message group by m.finding_id),
lf as (select finding_id, outcome, source_hash, unsafe from (select *, row_number() over (partition by finding_id order by pos desc, outcome desc, source_hash desc, unsafe desc) as k from fb) as x where k = 1),
x as (select f.*, h.finding_id is not null as gone, h.reason as why, list_distinct(list_concat(f.said, coalesce(d.messages, []))) as counter, coalesce(d.ids, []) as ids, ru.rule_id is not null as reg, ru.risk as rule_risk, ru.cap, ru.top, st.selective_threshold, st.conformal_threshold, st.status,
  l.outcome, coalesce(l.source_hash = f.source_hash, false) as same, coalesce(l.unsafe, false) as unsafe from fi f left join hit h on h.finding_id = f.finding_id left join d on d.finding_id = f.finding_id left join rules ru on ru.rule_id = f.rule_id left join stat st on st.rule_id = f.rule_id left join lf l on l.finding_id = f.finding_id),
y as (select *, least(c, case when reg then cap else 2 end) as c1, least(a, case when reg then top else 2 end) as a1, len(counter) as nc from x),
z as (select *, case when nc > 0 or r = 3 then least(a1, 2) else a1 end as a2, greatest(0e0, least(1e0, [4e-1, 7e-1, 95e-2][c1] - least(6e-1, nc * 2e-1))) as score, greatest([55e-2, 7e-1, 9e-1][r], coalesce(selective_threshold, 0), coalesce(conformal_threshold, 0)) as lim from y),
w as (select *, a2 = 3 and score < lim as low, coalesce(status in ('observe-only', 'disabled'), false) as sick, coalesce(same and outcome = 'accepted' and reg and not unsafe, false) as yes, coalesce(same and outcome in ('{"', '".join(CLOSING)}'), false) as shut from z)
select finding_id, gone as suppressed, concat('C', c) as original_confidence, concat('C', case when gone then c when score < 5e-1 then 1 else c1 end) as final_confidence, {_list(ACTIONS)}[a] as original_action,
{_list(ACTIONS)}[case when gone then 1 when yes then 3 when shut then 1 when low or sick then least(a2, 2) else a2 end] as final_action, round(case when gone then 0e0 else score end, 6) as evidence_score,
case when gone then concat('suppressed: ', why) else concat_ws('; ', case when not reg then 'unregistered rule' end, case when reg and rule_risk <> r then concat('risk differs from the rule''s R', rule_risk) end, case when nc > 0 then 'counterevidence' end, case when r = 3 then 'R3 needs manual review' end,
  case when low then printf('score %.2f under threshold %.2f', score, lim) end, case when sick then concat('rule ', status) end, case when score < 5e-1 then 'score under 0.50' end, case when yes then 'accepted in review' end, case when not yes and shut then concat('closed in review: ', outcome) end) end as reasons,
cast(case when gone then len(said) else nc end as int) as n_counter, case when gone then '' else coalesce(array_to_string(list_sort(ids), ','), '') end as counter_ids from w"""
ORACLE_SQL = {
    "policy_chain": _CHAIN,
    "policy_health": f"with {_VIEWS}, {_HEALTH} select rule_id, n as samples, k as accepted, n - k as rejected, bad as unsafe_actions, round(1e0 * k / n, 6) as rule_precision, round(low, 6) as lower_bound, round(selective_threshold, 6) as selective_threshold, round(conformal_threshold, 6) as conformal_threshold, status from stat",
    "policy_suppressions": f"with {_VIEWS}, {_SUPPRESSED} select * from hit",
    "coverage_veto": f"with {_VIEWS}, {_COVERED} select * from co",
    "surface_veto": f"with {_VIEWS}, {_SURFACE} select * from ex",
    "registration_overlap": f"with {_VIEWS}, {_OVER} select finding_id, evidence_id from ov",
}

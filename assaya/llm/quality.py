"""Host-level quality rules, DataFrame functions only.

Base rules are evaluated per document; failures are aggregated by host (the ``source``
column), each host's failure rate is shrunk towards an empirical beta prior fitted by the
method of moments over all hosts, and hosts whose shrunk rate exceeds ``max_host_rate``
lose all their documents.

Defined results: a null or empty text has no words and so fails the base rules; a null
source belongs to no host and is judged by the base rules alone; repeated rows are judged
one by one and each counts for its host; an empty table gives an empty result; columns
other than doc_id, text and source are never read by the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MIN_WORDS = 50
#: Hosts lose their documents when the shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Most hosts whose verdicts are broadcast; beyond it the verdicts are joined by shuffle.
BROADCAST_HOSTS = 20_000
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``: a lambda variable is never evaluated again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: equal windows meet by sorting (hash, position)."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(twice, lambda x: x["p"]))
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("p")))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    some = _let(hashes, lambda h: _let(F.sort_array(windows(h)), covered))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(some)


def base_rules(text: Column) -> Column:
    """A struct of the base features of one whole text."""
    text = F.coalesce(text, F.lit(""))

    def features(words: Column) -> Column:
        n = F.size(words).cast("long")
        repeats = repeat_words(words)
        return F.struct(n.alias("n_words"), repeats.alias("n_repeat_words"))

    def lines(found: Column) -> Column:
        return (F.size(found) - F.size(F.array_distinct(found))).cast("long")

    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        _let(words, features).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(with_word, lines).alias("n_dup_lines"),
    )


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base features of each row."""
    f = docs.select("doc_id", F.col("source").cast("string").alias("source"), base_rules(F.col("text")).alias("f"))
    f = f.select("doc_id", "source", F.col("f.w.n_words").alias("n_words"), F.col("f.word_chars").alias("word_chars"), F.col("f.n_symbols").alias("n_symbols"), F.col("f.n_dup_lines").alias("n_dup_lines"), F.col("f.w.n_repeat_words").alias("n_repeat_words"))
    return f.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """source, n, failures, rate and host_failed for each host of ``judged`` (source, base_failed).

    The prior is a beta distribution whose mean is the hosts' pooled rate and whose strength
    follows from the variance of the hosts' rates; one row of moments goes to the driver.
    """
    hosts = judged.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("n")
    hosts, _ = written(hosts, "host-counts")
    m = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.var_pop(rate).alias("v")).first()
    mean = (m["f"] or 0) / m["n"] if m["n"] else 0.0
    strength = min(1000.0, max(1.0, mean * (1 - mean) / m["v"] - 1)) if m["v"] else 1000.0
    shrunk = (F.col("failures") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", shrunk).withColumn("host_failed", F.col("rate") > max_rate)


def with_verdicts(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``rows`` (any with a source) with host_failed; few failed hosts are broadcast, many joined by shuffle."""
    bad = hosts.where("host_failed").select(F.col("source").alias("_bad_host"), F.lit(True).alias("_host_failed"))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = rows.join(bad, rows["source"] == bad["_bad_host"], "left")
    return joined.withColumn("host_failed", F.coalesce(F.col("_host_failed"), F.lit(False))).drop("_bad_host", "_host_failed")


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Features and verdicts, a row for each row of ``docs``. The features (not the texts) are written once to shared storage."""
    f, _ = written(features(docs), "quality")
    hosts, _ = written(host_verdicts(f, max_rate), "hosts")
    out = with_verdicts(f, hosts)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns unchanged.

    The base rules run once: the rows are written to shared storage with their verdict, of which the host counts read two columns.
    """
    f = F.transform(F.array(base_rules(F.col("text"))), lambda f: failed(f["w"]["n_words"], f["w"]["n_repeat_words"]))
    marked, _ = written(docs.withColumn("_base_failed", F.get(f, F.lit(0))), "marked")
    hosts, _ = written(host_verdicts(marked.select(F.col("source").cast("string").alias("source"), F.col("_base_failed").alias("base_failed")), max_rate), "hosts")
    bad = hosts.where("host_failed").select(F.col("source").alias("_bad_host"))
    ok = marked.where(~F.col("_base_failed")).drop("_base_failed")
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    return ok.join(bad, ok["source"].cast("string") == bad["_bad_host"], "left_anti")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed")


ORACLE_SQL = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
w as (select r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
t as (select r, unnest(generate_series(1, len(ws) - 2)) as i, ws from w where len(ws) >= 3),
g as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as c from t),
p as (select r, count(distinct i + k) as n from g, (values (0), (1), (2)) as v(k) where c >= 2 group by r),
l as (select r, unnest(string_split(text, chr(10))) as line from d),
m as (select r, count(*) - count(distinct line) as n from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
f as (select w.doc_id, w.source, cast(len(ws) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(m.n, 0) as bigint) as n_dup_lines, cast(coalesce(p.n, 0) as bigint) as n_repeat_words
  from w left join p using (r) left join m using (r)),
b as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed from f),
h as (select source, count(*) as n, sum(cast(base_failed as int)) as x from b where source is not null group by source),
q as (select sum(x) / sum(n) as mean, var_pop(x / n) as v from h),
s as (select mean, case when v > 0 then least(1000, greatest(1, mean * (1 - mean) / v - 1)) else 1000 end as k from q),
z as (select source from h, s where (x + mean * k) / (n + k) > {MAX_HOST_RATE})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (not base_failed and z.source is null) as kept, z.source is not null as host_failed
from b left join z on b.source = z.source
"""

"""URL filter: host/path rules first, then a weighted vocabulary counted by Aho-Corasick.

The vocabulary gives each term a weight. A url is rejected if its distinct terms weigh ``LIMIT`` or
more: strict terms weigh that much alone, soft ones half of it, so that two distinct soft terms reject.
Weights in between are open to the caller, whose terms may come from a table (``vocabulary_of``). A hit
counts only between boundaries: the characters beside it are not ASCII letters or digits. Matching is
on the A-Z lower-cased url.

Defined results: a null url, or one without ``://``, has an empty host and path, meets no
rule, and a null one has no terms either (allow); repeated rows are judged one by one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict); the longest that fits wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRICT = ("porn", "xxx", "hentai", "escort", "sexcam", "viagra", "camgirl", "bestiality")
SOFT = ("adult", "casino", "poker", "betting", "nude", "hot", "cam", "dating", "pills", "loan", "torrent", "crack")
#: Weight that rejects; a soft term's weight.
LIMIT, SOFT_WEIGHT = 1.0, 0.5
VOCABULARY = dict.fromkeys(SOFT, SOFT_WEIGHT) | dict.fromkeys(STRICT, LIMIT)
#: Most terms that a vocabulary may have: it goes to every worker.
MAX_TERMS = 1_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``; path: then up to ``? #``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substr(rest, F.length(host) + 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def found_terms(automaton, url: str) -> dict[str, float]:
    """Distinct terms with boundaries on both sides, and their weights."""
    low = url.translate(_LOWER)
    out = {}
    for end, (term, weight) in automaton.iter(low):
        start = end - len(term) + 1
        if (start == 0 or low[start - 1] not in _INNER) and (end + 1 == len(low) or low[end + 1] not in _INNER):
            out[term] = weight
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}
_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton_of(vocabulary=VOCABULARY):
    out = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        out.add_word(term, (term, float(weight)))
    out.make_automaton()
    return out


def vocabulary_of(terms: DataFrame) -> dict[str, float]:
    """The vocabulary that a table (term, weight) holds: lower-cased, the largest weight of a repeated term, without nulls and empty terms."""
    low = F.translate(F.col("term"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = terms.select(low.alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight is not null")
    rows = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    return {r.term: r.weight for r in rows}


def judge(pages: DataFrame, rules=RULES, vocabulary=VOCABULARY, limit: float = LIMIT) -> DataFrame:
    """page_id, url, host, path, rule, n_strict, n_soft (distinct terms of ``limit`` or more, and of less), weight, verdict for each row."""
    ids = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(vocabulary)
        for b in batches:
            found = [[] if u is None or not vocabulary else list(found_terms(automaton, u).values()) for u in b.column(1).to_pylist()]
            strict = [sum(w >= limit for w in x) for x in found]
            soft = [len(x) - n for x, n in zip(found, strict, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(strict, pa.int32()), pa.array(soft, pa.int32()), pa.array([math.fsum(x) for x in found], pa.float64())], names=["page_id", "url", "n_strict", "n_soft", "weight"])

    counted = pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, f"page_id {ids}, url string, n_strict int, n_soft int, weight double")
    host, path = host_path(F.col("url"))
    out = counted.withColumn("host", host).withColumn("path", path)
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("weight") >= limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("rule", name).withColumn("verdict", F.coalesce(verdict, method))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def _hits(terms) -> str:
    one = "cast(regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') as int)"
    return " + ".join(one.format(t) for t in terms)


ORACLE_SQL = f"""
with u as (select page_id, url, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as low,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') else '' end as rest from pages),
h as (select page_id, low, rest, regexp_extract(rest, '^[^/]*') as raw from u),
p as (select page_id, low, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, substr(rest, length(raw) + 1) as path from h),
r as (select *, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule,
  {_hits(STRICT)} as n_strict, {_hits(SOFT)} as n_soft from p)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
    when n_strict >= 1 or {SOFT_WEIGHT} * n_soft >= {LIMIT} then 'block' else 'allow' end as verdict,
  cast(n_strict as int) as n_strict, cast(n_soft as int) as n_soft
from r
"""

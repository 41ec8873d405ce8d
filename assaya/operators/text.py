"""Text forensics: tokens, bigram perplexity proxy, sentence lengths, repetition and vocabulary figures of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import TOKENS, WORDS


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _all(text, pattern: str):
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))


def token_counts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(_all(F.col("text"), TOKENS)).cast("long").alias("tokens"), F.size(_all(F.col("text"), WORDS)).cast("long").alias("words"))


def _over_runs(items: Column, worth, zero: Column) -> Column:
    """The sum of ``worth`` of the number of each distinct item of an array, which is sorted and read once within its row."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("long").alias("n"), zero.alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        again = F.coalesce(acc["last"] == x, F.lit(False))
        return F.struct(x.alias("last"), F.when(again, acc["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"), F.when(again, acc["sum"]).otherwise(acc["sum"] + worth(acc["n"])).alias("sum"))

    return F.aggregate(F.sort_array(items), start, step, lambda acc: acc["sum"] + worth(acc["n"]))


def _successive(items: Column, n: int) -> Column:
    """Each ``n`` successive items of an array, with a blank between them, which no item holds."""
    most = F.greatest(F.size(items) - (n - 1), F.lit(0))
    out = F.slice(items, 1, most)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, k + 1, most), lambda a, b: F.concat_ws(" ", a, b))
    return out


def perplexity(docs: DataFrame) -> DataFrame:
    """exp of the mean negative log probability of each token given the one before, with add-one smoothing over the text's own vocabulary.

    All within the row: the logs of n + 1 for each pair and of c + v for each first token are summed apart.
    """
    t = docs.select("doc_id", _all(F.lower("text"), TOKENS).alias("t"))
    t = t.select("doc_id", F.size(F.array_distinct("t")).alias("v"), F.size("t").alias("size"), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("prev"), _successive(F.col("t"), 2).alias("pairs"))
    zero, n = F.lit(0.0), F.col("size") - 1
    both = _over_runs(F.col("prev"), lambda c: c * F.log(c + F.col("v")), zero) - _over_runs(F.col("pairs"), lambda k: k * F.log(k + 1), zero)
    return t.select("doc_id", F.when(n > 0, F.round(F.exp(both / n), 6)).alias("perplexity"))


def burstiness(docs: DataFrame) -> DataFrame:
    """Words per sentence: their number, mean, population deviation and coefficient of variation."""
    s = docs.select("doc_id", F.explode(F.split("text", r"[.!?]+(?:\s+|$)", -1)).alias("s")).select("doc_id", F.size(_all(F.col("s"), WORDS)).alias("n")).where("n > 0")
    g = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("sd"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("cv"))
    return docs.select("doc_id").join(g, "doc_id", "left").select("doc_id", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sd", F.lit(0.0)).alias("sd"), "cv")


def trigrams(docs: DataFrame) -> DataFrame:
    """Word trigrams of each text, and those that occur more than once."""
    w = docs.select("doc_id", _successive(_all(F.lower("text"), WORDS), 3).alias("w"))
    repeated = _over_runs(F.col("w"), lambda n: F.when(n > 1, n).otherwise(0).cast("long"), F.lit(0).cast("long"))
    return w.select("doc_id", F.size("w").cast("long").alias("trigrams"), repeated.alias("repeated_trigrams"))


def stylometry(docs: DataFrame) -> DataFrame:
    words = _all(F.lower("text"), WORDS)
    return docs.select("doc_id", F.size(words).cast("long").alias("words"), F.size(F.array_distinct(words)).cast("long").alias("distinct_words"), F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS))).cast("long").alias("function_words"))


#: Fixed values.
FUNCTION_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")

QUERIES = {
    "text_tokens": lambda spark, sf: token_counts(documents(spark, sf)),
    "text_perplexity": lambda spark, sf: perplexity(documents(spark, sf)),
    "text_burstiness": lambda spark, sf: burstiness(documents(spark, sf)),
    "text_trigrams": lambda spark, sf: trigrams(documents(spark, sf)),
    "text_stylometry": lambda spark, sf: stylometry(documents(spark, sf)),
}
_W, _T = WORDS.replace("'", "''"), TOKENS.replace("'", "''")
_D = "d as (select doc_id, coalesce(text, '') as text from documents)"
ORACLE_SQL = {
    "text_tokens": f"with {_D} select doc_id, cast(len(regexp_extract_all(text, '{_T}')) as bigint) as tokens, cast(len(regexp_extract_all(text, '{_W}')) as bigint) as words from d",
    "text_perplexity": f"""with {_D}, a as (select doc_id, regexp_extract_all(lower(text), '{_T}') as ts from d),
t as (select doc_id, unnest(ts) as tok, unnest(generate_series(1, len(ts))) as pos from a where len(ts) > 0),
p as (select doc_id, tok, lag(tok) over (partition by doc_id order by pos) as prev from t),
n as (select doc_id, prev, tok, count(*) as n from p where prev is not null group by all),
c as (select *, sum(n) over (partition by doc_id, prev) as c from n),
v as (select doc_id, count(distinct tok) as v from t group by doc_id),
x as (select doc_id, round(exp(-sum(n * ln((n + 1) / (c + v))) / sum(n)), 6) as perplexity from c join v using (doc_id) group by doc_id)
select d.doc_id, perplexity from d left join x using (doc_id)""",
    "text_burstiness": f"""with {_D}, s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?]+(?:\\s+|$)')) as s from d),
n as (select doc_id, len(regexp_extract_all(s, '{_W}')) as n from s),
g as (select doc_id, count(*) as units, round(avg(n), 6) as mean, round(stddev_pop(n), 6) as sd, round(stddev_pop(n) / avg(n), 6) as cv from n where n > 0 group by doc_id)
select d.doc_id, coalesce(units, 0) as units, coalesce(mean, 0) as mean, coalesce(sd, 0) as sd, cv from d left join g using (doc_id)""",
    "text_trigrams": f"""with {_D}, a as (select doc_id, regexp_extract_all(lower(text), '{_W}') as ws from d),
t as (select doc_id, unnest(ws) as w, unnest(generate_series(1, len(ws))) as pos from a where len(ws) > 0),
p as (select doc_id, w, lag(w) over o as a, lag(w, 2) over o as b from t window o as (partition by doc_id order by pos)),
n as (select doc_id, count(*) as n from p where b is not null group by doc_id, b, a, w),
g as (select doc_id, sum(n) as n, sum(case when n > 1 then n else 0 end) as r from n group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as bigint) as trigrams, cast(coalesce(r, 0) as bigint) as repeated_trigrams from d left join g using (doc_id)""",
    "text_stylometry": f"""with {_D}, a as (select doc_id, regexp_extract_all(lower(text), '{_W}') as ws from d)
select doc_id, cast(len(ws) as bigint) as words, cast(len(list_distinct(ws)) as bigint) as distinct_words, cast(len(list_filter(ws, lambda w: w in {FUNCTION_WORDS})) as bigint) as function_words from a""",
}

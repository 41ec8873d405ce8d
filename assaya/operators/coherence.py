"""How far the sections of a text could change places: overlap of neighbours as written and as shuffled.

The shuffle is a fixed permutation for each number of sections. It comes from a vectorized function
of that number alone; texts and words stay in the JVM and nothing is shuffled over the network.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .review import _IN, _W, sections
from .wording import content_words

# The generator that the shuffle draws from.
SEED, FACTOR, ADDEND, MODULUS = 0x9E3779B9, 1664525, 1013904223, 1 << 32


@lru_cache(maxsize=256)
def permutation(n: int) -> list[int]:
    """What stands at each of ``n`` places after the shuffle, which swaps from the end with drawn places."""
    order, state = list(range(n)), SEED
    for last in range(n - 1, 0, -1):
        state = (state * FACTOR + ADDEND) % MODULUS
        drawn = state % (last + 1)
        order[last], order[drawn] = order[drawn], order[last]
    return order


def _overlap(a: Column, b: Column) -> Column:
    """Shared words by the smaller set's, not rounded; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def _mean_overlap(sets: Column, order: Column) -> Column:
    """The mean overlap of each set with the one before it, ``order`` (from 0) being their order; 0 for fewer than two."""
    pairs = F.transform(F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda x, k: _overlap(F.get(sets, x), F.get(sets, F.get(order, k))))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / F.size(pairs)).otherwise(F.lit(0.0))


def interchangeability(texts: DataFrame) -> DataFrame:
    """doc_id, sections, original and shuffled coherence, and their ratio (1 at most; null where the original is 0), of ``texts`` (doc_id, text).

    A null text has no sections; fewer than two give zeros and a null index.
    """

    @F.pandas_udf("array<int>")
    def drawn(n: pd.Series) -> pd.Series:
        return n.map(permutation)

    sets = texts.select("doc_id", F.transform(sections(F.coalesce("text", F.lit(""))), content_words).alias("sets"))
    n = F.size("sets")
    rows = sets.withColumn("order", drawn(n))
    own = F.transform("order", lambda _, k: k)
    rows = rows.select("doc_id", n.cast("long").alias("sections"), _mean_overlap(F.col("sets"), own).alias("a"), _mean_overlap(F.col("sets"), F.col("order")).alias("b"))
    index = F.when(F.col("a") > 0, F.least(F.lit(1.0), F.col("b") / F.col("a")))
    return rows.select("doc_id", "sections", *(F.round(c, 6).alias(name) for c, name in (("a", "original_coherence"), ("b", "shuffled_coherence"))), F.round(index, 6).alias("interchangeability"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as texts whose sections are their turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    held = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(held, lambda t: t["text"]), "\n\n").alias("text"))


QUERIES = {"text_interchangeability": lambda spark, sf: interchangeability(_conversations(spark, sf))}
_OVERLAP = "case when len({a}) = 0 or len({b}) = 0 then 0e0 else 1e0 * len(list_intersect({a}, {b})) / least(len({a}), len({b})) end"
ORACLE_SQL = {
    "text_interchangeability": f"""with recursive c as (select conv_id as doc_id, string_agg(text, '\n\n' order by turn, text) as text from conversations where text is not null group by conv_id),
p as (select doc_id, list_transform(list_filter(string_split_regex(text, '\\r?\\n(?:\\s*\\r?\\n)+'), lambda s: regexp_matches(s, '\\S')), lambda s: list_distinct(list_filter(regexp_extract_all(lower(s), '{_W}'), lambda x: length(x) > 2 and x not in ({_IN["stop"]})))) as ws from c),
g as (select distinct len(ws) as n, len(ws) - 1 as i, {SEED} as state, range(1, len(ws) + 1) as arr from p where len(ws) > 1 union all
  select n, i - 1, d.state, list_transform(range(1, n + 1), lambda k: case k when i + 1 then arr[d.state % (i + 1) + 1] when d.state % (i + 1) + 1 then arr[i + 1] else arr[k] end) from (select n, i, arr, (state * {FACTOR} + {ADDEND}) % {MODULUS} as state from g where i > 0) as d),
o as (select n, arr from g where i = 0), s as (select doc_id, ws, arr, unnest(range(2, len(ws) + 1)) as k from p join o on o.n = len(p.ws)),
m as (select doc_id, avg({_OVERLAP.format(a="ws[k]", b="ws[k - 1]")}) as a, avg({_OVERLAP.format(a="ws[arr[k]]", b="ws[arr[k - 1]]")}) as b from s group by doc_id)
select p.doc_id, cast(len(ws) as bigint) as sections, round(coalesce(a, 0e0), 6) as original_coherence, round(coalesce(b, 0e0), 6) as shuffled_coherence, case when a > 0 then round(least(1e0, b / a), 6) end as interchangeability from p left join m on m.doc_id = p.doc_id""",
}

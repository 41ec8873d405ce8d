"""Rules on lines, words and names: normalised lines, content words, package roots, Markdown cells, nearest declared names.

Each takes a column or DataFrames of the caller. Null texts count as empty; null names are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import WORDS
from .text import FUNCTION_WORDS

#: Fixed values, beside FUNCTION_WORDS.
STOP_WORDS = ("about", "after", "all", "also", "but", "could", "do", "does", "each", "how", "more", "most", "not", "only", "other", "our", "over", "same", "some", "than", "their", "there", "these", "they", "through", "under", "very", "we", "what", "when", "where", "which", "who", "why", "you")
#: Characters that Markdown gives a meaning.
MARKS = "\\`*_[]~"
#: Quoted literals on one line; numbers between ASCII word boundaries; white space.
_QUOTED = "'[^'\n\r]*'|\"[^\"\n\r]*\"|`[^`\n\r]*`"
_NUMBER = r"(?<![A-Za-z0-9_])[0-9]+(?:[.][0-9]+)?(?![A-Za-z0-9_])"
_SPACE = "[ \t\n\r\f\x0b]+"


def normalized_line(line: Column) -> Column:
    """Lower case, literals and numbers by placeholders, white space squeezed."""
    out = F.regexp_replace(F.lower(line), _QUOTED, "<literal>")
    return F.trim(F.regexp_replace(F.regexp_replace(out, _NUMBER, "<number>"), _SPACE, " "))


def line_repetition(texts: DataFrame) -> DataFrame:
    """doc_id, line_count, boilerplate (distinct repeated lines) and repeated_rate of ``texts`` (doc_id, text); texts without a line give no row."""
    lines = texts.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("raw")).select("doc_id", normalized_line(F.col("raw")).alias("line")).where("line <> ''")
    n = F.col("n")
    counted = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id")
    out = counted.agg(F.sum("n").alias("line_count"), F.count_if(n > 1).alias("boilerplate"), F.sum(F.when(n > 1, n).otherwise(0)).alias("repeated"))
    return out.select("doc_id", "line_count", "boilerplate", F.round(F.col("repeated") / F.col("line_count"), 6).alias("repeated_rate"))


def content_words(text: Column) -> Column:
    """Distinct words of three characters or more that are no stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORDS})"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*FUNCTION_WORDS, *STOP_WORDS))


def overlap(left: Column, right: Column) -> Column:
    """Shared words by the smaller set's; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(left, right)) / least, 6))


def lexical_overlap(turns: DataFrame) -> DataFrame:
    """The overlap of each turn of a conversation with the next one."""
    words = turns.select("conv_id", "turn", content_words(F.col("text")).alias("words"))
    after = words.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("words").alias("next_words"))
    return words.join(after, ["conv_id", "turn"]).select("conv_id", "turn", (F.col("turn") + 1).alias("next_turn"), overlap(F.col("words"), F.col("next_words")).alias("overlap"))


def package_root(name: Column) -> Column:
    """The first segment of a package's path, the first two where it has a scope."""
    return F.when(F.startswith(name, F.lit("@")), F.substring_index(name, "/", 2)).otherwise(F.substring_index(name, "/", 1))


def package(name: Column) -> Column:
    """The normalised name of a package's root."""
    return F.regexp_replace(F.lower(package_root(name)), "[_.]+", "-")


def markdown_text(value: Column) -> Column:
    """``value`` on one line, with HTML's and Markdown's marks escaped in this order."""
    out = F.trim(F.regexp_replace(value, _SPACE, " "))
    for mark, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|")):
        out = F.replace(out, F.lit(mark), F.lit(safe))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("\\" + c)), MARKS, out)


#: Longest name of which all deletions are keys; of longer ones the pieces are.
LONGEST_NAME = 64


def _without(text: str, place: str) -> str:
    return f"concat(substr({text}, 1, {place} - 1), substr({text}, {place} + 1))"


#: Hashes of a name with none, one and two of its characters left out.
_DELETIONS = f"""transform(concat(array(low), if(length(low) < 1, array(), transform(sequence(1, length(low)), i -> {_without("low", "i")})),
  if(length(low) < 2, array(), flatten(transform(sequence(1, length(low) - 1), i -> transform(sequence(i, length(low) - 1), j -> {_without(f'({_without("low", "i")})', "j")}))))), x -> xxhash64(x))"""


def nearest_declared(seen: DataFrame, declared: DataFrame, most: int = 2) -> DataFrame:
    """name, declared, distance: for each distinct ``name`` of ``seen`` the nearest of ``declared`` (name) within ``most`` edits, ignoring case.

    Of several at one distance the smallest declared name is taken; names without one give no row. No cross join. Names
    within two edits have a text in common that is left when at most two characters of each go, so these texts' hashes are
    the join's keys: a part that many names share, such as a scope, is no key. For other ``most`` and for names of over
    LONGEST_NAME characters the keys are ``most + 1`` pieces of the declared name, one of which is whole and moved by
    ``most`` places at most. Candidates are verified exactly. Names that are declared as they are need no candidates.
    """
    k = most + 1
    # Pieces of a name of n characters: piece p runs from n * p div k up to n * (p + 1) div k.
    pieces = f"transform(sequence(0, {most}), p -> struct(length(low) as n, p as p, substr(low, length(low) * p div {k} + 1, length(low) * (p + 1) div {k} - length(low) * p div {k}) as piece))"
    probes = f"""flatten(flatten(transform(sequence(greatest(0, length(low) - {most}), length(low) + {most}), n -> transform(sequence(0, {most}), p ->
      transform(filter(sequence(n * p div {k} - {most}, n * p div {k} + {most}), s -> s >= 0 and s + n * (p + 1) div {k} - n * p div {k} <= length(low)),
        s -> struct(n as n, p as p, substr(low, s + 1, n * (p + 1) div {k} - n * p div {k}) as piece))))))"""

    lowered = lambda names, name: names.select(F.col("name").alias(name), F.lower("name").alias("low")).where(f"{name} is not null").distinct()
    same = lowered(seen, "name").join(lowered(declared, "declared").groupBy("low").agg(F.min("declared").alias("declared")), "low").select("name", "declared", F.lit(0).cast("long").alias("distance"))
    seen = seen.select("name").join(same.select("name"), "name", "left_anti")

    def keyed(names: DataFrame, keys: str, name: str, fit: str) -> DataFrame:
        low = names.select(F.col("name").alias(name), F.lower("name").alias("low")).where(f"{name} is not null and {fit}").distinct()
        return low.select(name, F.col("low").alias(f"{name}_low"), F.explode(F.array_distinct(F.expr(keys))).alias("key"))

    def near(seen_keys: str, declared_keys: str, fit: str) -> DataFrame:
        pairs = keyed(seen, seen_keys, "name", fit).join(keyed(declared, declared_keys, "declared", fit), "key")
        return pairs.withColumn("distance", F.levenshtein("name_low", "declared_low", most)).where("distance >= 0").select("name", "declared", "distance")

    if most == 2:  # two names within two edits are both short or both long
        found = near(_DELETIONS, _DELETIONS, f"length(low) <= {LONGEST_NAME + most}").unionByName(near(probes, pieces, f"length(low) > {LONGEST_NAME}"))
    else:
        found = near(probes, pieces, "true")
    best = found.groupBy("name").agg(F.min(F.struct("distance", "declared")).alias("best"))
    return same.unionByName(best.select("name", "best.declared", F.col("best.distance").cast("long").alias("distance")))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.lit("@Acme/")).otherwise(F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_.")), F.lit("/Sub.module"))
    return parts.select(raw.alias("raw")).distinct().select("raw", package(F.col("raw")).alias("package"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", markdown_text(F.col("text")).alias("cell"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts, each as it is and with one character changed, against the declared brands and names."""
    parts = _table(spark, sf_dir, "part")
    seen = parts.select(F.explode(F.array(F.col("p_name"), F.concat("p_brand", F.lit("x")), F.concat(F.lit("q"), F.expr("substr(p_name, 3)")), F.concat(F.lit("abc"), F.col("p_name")))).alias("name"))
    return nearest_declared(seen, parts.select(F.explode(F.array("p_name", "p_brand")).alias("name")))


QUERIES = {
    "line_repetition": lambda spark, sf: line_repetition(_table(spark, sf, "documents")),
    "lexical_overlap": lambda spark, sf: lexical_overlap(_table(spark, sf, "conversations")),
    "package_normalize": _packages,
    "markdown_escape": _cells,
    "nearest_name": _names,
}
_S = "'[ \t\n\r\f\x0b]+', ' ', 'g'"
_STOP = ", ".join(f"'{w}'" for w in (*FUNCTION_WORDS, *STOP_WORDS))
_CELL = f"replace(replace(replace(replace(trim(regexp_replace(text, {_S})), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|')"
_LINE = "regexp_replace(lower(raw), '''[^''\n\r]*''|\"[^\"\n\r]*\"|`[^`\n\r]*`', '<literal>', 'g')"
ORACLE_SQL = {
    "line_repetition": f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw from documents),
n as (select doc_id, trim(regexp_replace(regexp_replace({_LINE}, '\\b[0-9]+(?:[.][0-9]+)?\\b', '<number>', 'g'), {_S})) as line from l),
g as (select doc_id, line, count(*) as n from n where line <> '' group by doc_id, line)
select doc_id, cast(sum(n) as bigint) as line_count, count(*) filter (where n > 1) as boilerplate, round(1e0 * sum(case when n > 1 then n else 0 end) / sum(n), 6) as repeated_rate from g group by doc_id""",
    "lexical_overlap": f"""with w as (select conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{WORDS.replace("'", "''")}'), lambda w: length(w) > 2 and w not in ({_STOP}))) as ws from conversations)
select a.conv_id, a.turn, b.turn as next_turn, case when len(a.ws) = 0 or len(b.ws) = 0 then 0e0 else round(1e0 * len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)), 6) end as overlap from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1""",
    "package_normalize": """with r as (select distinct concat(case when p_partkey % 2 = 0 then '@Acme/' else '' end, replace(p_name, ' ', '_.'), '/Sub.module') as raw from part)
select raw, regexp_replace(lower(regexp_extract(raw, '^(@[^/]*/[^/]*|[^/]*)')), '[_.]+', '-', 'g') as package from r""",
    "markdown_escape": f"select doc_id, regexp_replace({_CELL}, '([\\\\`*_\\[\\]~])', '\\\\\\1', 'g') as cell from documents",
    "nearest_name": """with declared as (select distinct unnest([p_name, p_brand]) as declared from part),
seen as (select distinct unnest([p_name, concat(p_brand, 'x'), concat('q', substr(p_name, 3)), concat('abc', p_name)]) as name from part),
c as (select name, declared, levenshtein(lower(name), lower(declared)) as distance from seen cross join declared)
select name, declared, cast(distance as bigint) as distance from (select *, row_number() over (partition by name order by distance, declared) as k from c where distance <= 2) as x where k = 1""",
}

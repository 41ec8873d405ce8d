"""Who is affected: searches against the direction of edges from many starts at once, and look-ups of names and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import EDGES, run
from .shared import use_checkpoints

# Limits of a search and of a look-up.
MAX_DEPTH, MOST_NODES, MOST_NAMES, MOST_IMPACTS, MOST_EDGES = 3, 10_000, 50, 20, 100


def impact(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, most: int = MOST_NODES) -> DataFrame:
    """start_id, node_id, depth, place of what reaches each start over ``edges`` (edge_id, from_id, to_id) within ``max_depth`` steps.

    A round joins the frontier with the edges into it, drops what was found before and is written to
    the shared folder. Nodes are numbered as a search one by one would meet them: by the place of the
    node that they lead to, then by edge id; the first ``most`` of a start stay, and of a node's edges
    the first ``most`` by id are read, so no hub multiplies beyond that. A start is not among its own
    results unless a cycle leads back to it. Null starts and edges with a null end find nothing.
    """
    spark = edges.sparkSession
    use_checkpoints(spark)
    into = Window.partitionBy("to_id").orderBy("edge_id")
    known = edges.where("from_id is not null and to_id is not null").withColumn("_k", F.row_number().over(into)).where(F.col("_k") <= most).select("edge_id", "from_id", "to_id")
    frontier = starts.where("start_id is not null").select("start_id").distinct().select("start_id", F.col("start_id").alias("node_id"), F.lit(0).cast("long").alias("place"))
    found = None
    for depth in range(1, max_depth + 1):
        met = frontier.join(known, frontier["node_id"] == known["to_id"]).groupBy("start_id", F.col("from_id").alias("node_id")).agg(F.min(F.struct("place", "edge_id")).alias("came"))
        n = F.lit(0)
        if found is not None:
            met = met.join(found.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti")
            met = met.join(found.groupBy("start_id").agg(F.count(F.lit(1)).alias("held")), "start_id", "left")
            n = F.coalesce("held", F.lit(0))
        nth = F.row_number().over(Window.partitionBy("start_id").orderBy("came", "node_id"))
        new = met.withColumn("nth", nth).where(F.col("nth") <= most).withColumn("place", n + F.col("nth")).where(F.col("place") <= most)
        frontier = new.select("start_id", "node_id", "place").checkpoint()
        level = frontier.select("start_id", "node_id", F.lit(depth).alias("depth"), "place")
        found = level if found is None else found.unionByName(level)
        if frontier.isEmpty():
            break
    return found


def neighbours(edges: DataFrame, nodes: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """node_id, incoming and outgoing: the first ``most`` edge ids each way, by id, of ``nodes`` (node_id)."""
    out = nodes.select("node_id").distinct()
    for name, end in (("incoming", "to_id"), ("outgoing", "from_id")):
        nth = F.row_number().over(Window.partitionBy(end).orderBy("edge_id"))
        ids = edges.withColumn("_k", nth).where(F.col("_k") <= most).groupBy(F.col(end).alias("node_id")).agg(F.array_sort(F.collect_list("edge_id")).alias(name))
        out = out.join(ids, "node_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def looked_up(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """query, node_id, exported, place: the nodes of each of ``queries`` (query).

    A query with a slash is a file path and finds all its nodes by start; any other is a name or
    qualified name and finds the first MOST_NAMES, exported ones first, then by path. Blanks at a
    query's ends don't count; a query that finds nothing has no row.
    """
    asked = queries.select(F.regexp_replace("query", r"^\s+|\s+$", "").alias("query")).where("query <> ''").distinct()
    by_file = Window.partitionBy("query").orderBy("start", "node_id")
    files = asked.where(F.contains("query", F.lit("/"))).join(nodes, F.col("query") == F.col("file_path")).select("query", "node_id", "exported", F.row_number().over(by_file).alias("place"))
    labels = nodes.select("node_id", "exported", "file_path", F.explode(F.array_compact(F.array_distinct(F.array("name", "qualified_name")))).alias("query"))
    by_name = Window.partitionBy("query").orderBy(F.desc("exported"), "file_path", "node_id")
    names = asked.where(~F.contains("query", F.lit("/"))).join(labels, "query").withColumn("place", F.row_number().over(by_name)).where(F.col("place") <= MOST_NAMES)
    return files.unionByName(names.select("query", "node_id", "exported", "place"))


def context(nodes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """query, node_id, exported, place and, for the first MOST_IMPACTS nodes of a query, impacted (node ids in the order of the search), incoming and outgoing."""
    found = looked_up(nodes, queries)
    first = found.where(F.col("place") <= MOST_IMPACTS).select("node_id").distinct()
    reach = impact(edges, first.withColumnRenamed("node_id", "start_id")).groupBy(F.col("start_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("place", F.col("node_id").alias("id")))).alias("r"))
    told = neighbours(edges, first).join(reach, "node_id", "left").select("node_id", "incoming", "outgoing", F.coalesce(F.transform("r", lambda x: x["id"]), F.array().cast("array<string>")).alias("impacted"))
    rows = found.join(told, "node_id", "left")
    shown = F.col("place") <= MOST_IMPACTS
    return rows.select("query", "node_id", "exported", "place", *(F.when(shown, F.col(c)).alias(c) for c in ("impacted", "incoming", "outgoing")))


_E = f"{EDGES}, e as (select concat(from_id, '>', to_id) as edge_id, from_id, to_id from edges)"
_STARTS = "st as (select concat('r', cast(r_regionkey as varchar(20))) as start_id from {region} union all select concat('n', cast(n_nationkey as varchar(20))) from {nation} union all select concat('c', cast(c_custkey as varchar(20))) from {customer} union all select 'none')"
_NODES = """nodes as (select concat('c', cast(c_custkey as varchar(20))) as node_id, concat(lower(c_mktsegment), cast(c_custkey % 20 as varchar(20))) as name, concat('app.', c_name) as qualified_name, concat('src/n', cast(c_nationkey as varchar(20)), '.py') as file_path, c_acctbal > 0 as exported, c_custkey as start from {customer}
  union all select concat('n', cast(n_nationkey as varchar(20))), lower(n_name), concat('geo.', lower(n_name)), 'src/nations.py', true, n_nationkey from {nation} union all select concat('r', cast(r_regionkey as varchar(20))), lower(r_name), lower(r_name), 'src/regions.py', false, r_regionkey from {region})"""
_ASKED = "asked as (select name as query from nodes union select concat(' ', file_path) from nodes union select qualified_name from nodes where node_id like 'n%' union select 'none' union select 'src/none')"


def _table(spark: SparkSession, sf_dir: str, views: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"with {views} select * from {name}")


def impact_from_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact(_table(spark, sf_dir, _E, "e"), _table(spark, sf_dir, _STARTS, "st"))


def graph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _table(spark, sf_dir, _NODES, "nodes")
    out = context(nodes, _table(spark, sf_dir, _E, "e"), _table(spark, sf_dir, f"{_NODES}, {_ASKED}", "asked"))
    return out.select("query", "node_id", "exported", "place", F.size("impacted").cast("long").alias("n_impacted"), F.array_join("incoming", ",").alias("incoming"), F.array_join("outgoing", ",").alias("outgoing"), F.element_at(F.when(F.size("impacted") > 0, F.col("impacted")), -1).alias("last_impacted"))


QUERIES = {"impact_from_many": impact_from_many, "graph_context": graph_context}


def _search(starts: str) -> str:
    """The levels of a search, each in the order of (place of the target, edge id)."""
    out = [f"k as (select * from (select *, row_number() over (partition by to_id order by edge_id) as k from e) as x where k <= {MOST_NODES})", f"l0 as (select distinct start_id, start_id as node_id, 0 as place from {starts})"]
    for d in range(1, MAX_DEPTH + 1):
        seen = " union all ".join(f"select start_id, node_id from l{j}" for j in range(1, d)) or "select start_id, node_id from l0 where false"
        out.append(f"""m{d} as (select l.start_id, k.from_id as node_id, min({{'p': l.place, 'i': k.edge_id}}) as came from l{d - 1} l join k on k.to_id = l.node_id group by 1, 2),
s{d} as ({seen}), c{d} as (select start_id, count(*) as held from s{d} group by 1),
l{d} as (select start_id, node_id, place from (select m.start_id, m.node_id, coalesce(c.held, 0) + row_number() over (partition by m.start_id order by m.came, m.node_id) as place from m{d} m left join c{d} c on c.start_id = m.start_id
  where not exists (select 1 from s{d} s where s.start_id = m.start_id and s.node_id = m.node_id)) as x where place <= {MOST_NODES})""")
    return ", ".join(out) + ", im as (" + " union all ".join(f"select start_id, node_id, {d} as depth, place from l{d}" for d in range(1, MAX_DEPTH + 1)) + ")"


def _duck(text: str) -> str:
    return text.replace("{region}", "region").replace("{nation}", "nation").replace("{customer}", "customer").replace("{orders}", "orders").replace("{supplier}", "supplier")


ORACLE_SQL = {
    "impact_from_many": _duck(f"with {_E}, {_STARTS}, ") + _search("st") + " select * from im",
    "graph_context": _duck(f"with {_E}, {_NODES}, {_ASKED}, q as (select distinct trim(query) as query from asked), ")
    + f"""fo as (select query, node_id, exported, row_number() over (partition by query order by start, node_id) as place from q join nodes on contains(query, '/') and query = file_path
union all select * from (select query, node_id, exported, row_number() over (partition by query order by exported desc, file_path, node_id) as place from q join nodes on not contains(query, '/') and (query = name or query = qualified_name)) as x where place <= {MOST_NAMES}),
st as (select distinct node_id as start_id from fo where place <= {MOST_IMPACTS}), {_search("st")}, ag as (select start_id, count(*) as n, max_by(node_id, place) as last from im group by 1),
i as (select to_id as node_id, string_agg(edge_id, ',' order by edge_id) as ids from (select *, row_number() over (partition by to_id order by edge_id) as k from e) as x where k <= {MOST_EDGES} group by 1),
o as (select from_id as node_id, string_agg(edge_id, ',' order by edge_id) as ids from (select *, row_number() over (partition by from_id order by edge_id) as k from e) as x where k <= {MOST_EDGES} group by 1)
select fo.query, fo.node_id, fo.exported, cast(fo.place as int) as place, case when place <= {MOST_IMPACTS} then coalesce(ag.n, 0) end as n_impacted, case when place <= {MOST_IMPACTS} then coalesce(i.ids, '') end as incoming, case when place <= {MOST_IMPACTS} then coalesce(o.ids, '') end as outgoing,
case when place <= {MOST_IMPACTS} then ag.last end as last_impacted from fo left join ag on ag.start_id = fo.node_id left join i on i.node_id = fo.node_id left join o on o.node_id = fo.node_id""",
}

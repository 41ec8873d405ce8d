"""Behaviour clustering: time-windowed links between actors that share a key, components, and roll-ups by domain."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import use_checkpoints

WINDOW_US = 15 * 60 * 1_000_000
#: Signals by priority.
SIGNALS = (("content-hash", "content_hash"), ("semantic-hash", "semantic_hash"), ("template", "template_key"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as behaviour events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    semantic = F.when(F.col("event_type").isin("purchase", "error"), F.concat("event_type", F.lit(":"), F.floor("value").cast("long").cast("string")))
    return e.select(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("id"), F.col("user_id").cast("string").alias("actor"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.col("props").alias("content_hash"), semantic.alias("semantic_hash"), F.lit(None).cast("string").alias("template_key"), F.col("event_type").alias("domain"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """id, pos and the reason why an event is left out (null if it is accepted); the first row of an id shadows later ones."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    reason = F.when(F.col("id").isNull() | (F.col("id") == ""), "missing-id").when(F.col("nth") > 1, "duplicate-id").when(F.col("actor").isNull() | (F.col("actor") == ""), "missing-actor").when(F.col("t_us").isNull(), "invalid-time")
    return rows.withColumn("nth", nth).select("id", "pos", reason.alias("reason"))


def accepted(rows: DataFrame) -> DataFrame:
    """The first row of each id, if its id, actor and time are there. First is by ``pos``, or without that column by time and then actor."""
    place = [F.col("pos")] if "pos" in rows.columns else [F.col("t_us"), F.col("actor")]
    first = rows.where(F.col("id") != "").groupBy("id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "id")), F.struct(*place)).alias("_e"))
    return first.select("id", "_e.*").where((F.col("actor") != "") & F.col("t_us").isNotNull())


_SLOTS = "rank int, left_id string, right_id string"


def _linked(window_us: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads slots carried into a bucket, then the bucket's events in order, key by key; links each event to the foremost open slot of another actor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slots, queue = None, {}, []
        for b in batches:
            ranks, left, right = [], [], []
            for rank, key, bucket, is_event, t, event, actor, start_t, start_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != (rank, key, bucket):
                    now, slots, queue = (rank, key, bucket), {}, []
                if is_event:
                    own = None
                    while queue:
                        at, first, other = queue[0]
                        slot = slots.get(other)
                        if slot is None or slot[0] != (at, first) or slot[2] < t - window_us:  # replaced, or idle for too long
                            heappop(queue)
                        elif other == actor:
                            own = heappop(queue)
                        else:
                            ranks.append(rank)
                            left.append(slot[1])
                            right.append(event)
                            break
                    if own:
                        heappush(queue, own)
                start = start_t, start_id
                if actor not in slots or slots[actor][0] != start:
                    heappush(queue, (start_t, start_id, actor))
                slots[actor] = start, event, t
            if ranks:
                yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], names=["rank", "left_id", "right_id"])

    return run


def edges(rows: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """left_id, right_id, signal: each accepted event links to one earlier event of another actor with its key, in the window.

    Per key, an actor holds one slot whose place is that of the actor's first event since it was last
    idle for longer than the window; an event links to the latest event of the foremost other slot.
    Time is cut into buckets of a window, and what is open at the end of one is carried into the next
    (a slot's latest event is never older). So a hot key is as many groups as it has buckets, each
    read once in order, and time grows with the number of events, not with pairs of them.
    """
    rows = accepted(rows)
    found = None
    for rank, (_, column) in enumerate(SIGNALS):
        x = rows.where(F.col(column).isNotNull()).select("id", "actor", "t_us", F.col(column).alias("key"), F.lit(rank).alias("rank"))
        found = x if found is None else found.unionByName(x)
    actor = Window.partitionBy("rank", "key", "actor").orderBy("t_us", "id")
    opens = F.when(F.coalesce(F.col("t_us") - F.lag("t_us").over(actor) <= window_us, F.lit(False)), F.lit(None)).otherwise(F.struct("t_us", "id"))
    x = found.withColumn("start", F.last(opens, ignorenulls=True).over(actor.rowsBetween(Window.unboundedPreceding, 0))).withColumn("bucket", F.floor(F.col("t_us") / window_us))
    carried = x.groupBy("rank", "key", "actor", "start", "bucket").agg(F.max(F.struct("t_us", "id")).alias("e"))
    shape = lambda e, t, bucket, is_event: ["rank", "key", bucket.alias("bucket"), F.lit(is_event).alias("is_event"), t.alias("t"), e.alias("event"), "actor", F.col("start.t_us").alias("start_t"), F.col("start.id").alias("start_id")]
    both = x.select(*shape(F.col("id"), F.col("t_us"), F.col("bucket"), True)).unionByName(carried.select(*shape(F.col("e.id"), F.col("e.t_us"), F.col("bucket") + 1, False)))
    dealt = both.repartition("rank", "key", "bucket").sortWithinPartitions("rank", "key", "bucket", "is_event", "t", "event")
    links = dealt.mapInArrow(_linked(window_us), _SLOTS).groupBy("left_id", "right_id").agg(F.min("rank").alias("rank"))
    return links.select("left_id", "right_id", F.element_at(F.array(*(F.lit(s) for s, _ in SIGNALS)), F.col("rank") + 1).alias("signal"))


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component), by contraction, checkpointed each round.

    In each round every node points to its smallest neighbour, pointers are followed to their ends,
    and links are rewritten to what their ends point to. Rounds go on until no link is left.
    """
    spark = links.sparkSession
    use_checkpoints(spark)
    u, v = F.col("left_id"), F.col("right_id")
    left = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct().checkpoint()
    labels = left.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node")).checkpoint()
    left = left.where("u <> v")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("p")).checkpoint()
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            if parent.join(up.where("p <> pp"), "p", "left_semi").isEmpty():
                break
            parent = parent.join(up, "p").select("node", F.col("pp").alias("p")).checkpoint()
        labels = labels.join(parent.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("p", "label").alias("label")).checkpoint()
        a, b = parent.select(F.col("node").alias("u"), F.col("p").alias("pu")), parent.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        ends = left.join(a, "u").join(b, "v").where("pu <> pv")
        left = ends.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct().checkpoint()
    return labels


def clusters(rows: DataFrame, window_us: int = WINDOW_US, least_actors: int = 2) -> DataFrame:
    """first_id, event_ids, actor_ids, pairs, shared_signal and confidence of each component of accepted events with enough actors."""
    rows = accepted(rows)
    use_checkpoints(rows.sparkSession)
    links = edges(rows, window_us).checkpoint()
    labels = components(links)
    members = labels.join(rows.select(F.col("id").alias("node"), "actor"), "node")
    groups = members.groupBy("label").agg(F.array_sort(F.collect_set("node")).alias("ids"), F.array_sort(F.collect_set("actor")).alias("actors")).where(F.size("actors") >= least_actors)
    own = links.join(labels, links["left_id"] == labels["node"]).groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), *[F.sum((F.col("signal") == s).cast("long")).alias(f"n{k}") for k, (s, _) in enumerate(SIGNALS)])
    most = F.greatest("n0", "n1", "n2")
    signal = F.when(F.col("n0") == most, SIGNALS[0][0]).when(F.col("n1") == most, SIGNALS[1][0]).otherwise(SIGNALS[2][0])
    confidence = F.when((F.col("shared_signal") == "content-hash") & (F.col("n0") >= 2), "high").when(F.col("shared_signal") != "content-hash", "medium").otherwise("low")
    out = groups.join(own, "label").withColumn("shared_signal", signal)
    return out.select(F.col("label").alias("first_id"), F.concat_ws(",", "ids").alias("event_ids"), F.concat_ws(",", "actors").alias("actor_ids"), "pairs", "shared_signal", confidence.alias("confidence"))


def domains(rows: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Counts of events, actors and hashes by domain, the rate of repeated hashes, and the links within the domain."""
    base = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("actor").alias("actor_count"), F.countDistinct("content_hash").alias("unique_hashes"), F.count("content_hash").alias("hashes"))
    named = rows.select("id", "domain")
    links = edges(rows, window_us).join(named.select(F.col("id").alias("left_id"), F.col("domain").alias("ld")), "left_id").join(named.select(F.col("id").alias("right_id"), F.col("domain").alias("rd")), "right_id")
    pairs = links.where("ld = rd").groupBy(F.col("ld").alias("domain")).agg(F.count(F.lit(1)).alias("pairs"))
    rate = F.when(F.col("hashes") > 0, (F.col("hashes") - F.col("unique_hashes")) / F.col("hashes")).otherwise(F.lit(0.0))
    return base.join(pairs, "domain", "left").select("domain", "event_count", "actor_count", "unique_hashes", rate.alias("repeated_rate"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pair_count"))


_EVENTS = """select lpad(cast(event_id as varchar), 10, '0') as id, cast(user_id as varchar) as actor, epoch_us(ts) as t_us, props as content_hash,
  case when event_type in ('purchase', 'error') then concat(event_type, ':', cast(cast(floor(value) as bigint) as varchar)) end as semantic_hash, event_type as domain from events"""
_EDGES = f"""ev as ({_EVENTS}),
k as (select id, actor, t_us, content_hash as key, 0 as rank, 'content-hash' as signal from ev where content_hash is not null
  union all select id, actor, t_us, semantic_hash, 1, 'semantic-hash' from ev where semantic_hash is not null),
g as (select *, case when t_us - lag(t_us) over (partition by rank, key, actor order by t_us, id) <= {WINDOW_US} then 0 else 1 end as new from k),
r as (select *, sum(new) over (partition by rank, key, actor order by t_us, id) as run from g),
s as (select *, min(t_us) over w as start_t, first(id) over (partition by rank, key, actor, run order by t_us, id) as start_id from r window w as (partition by rank, key, actor, run)),
p as (select x.rank, x.signal, x.id as right_id, y.id as left_id, row_number() over (partition by x.rank, x.id order by y.start_t, y.start_id, y.t_us desc, y.id desc) as best
  from s x join s y on x.rank = y.rank and x.key = y.key and y.actor <> x.actor and y.t_us >= x.t_us - {WINDOW_US} and (y.t_us < x.t_us or y.t_us = x.t_us and y.id < x.id)),
edges as (select left_id, right_id, arg_min(signal, rank) as signal from p where best = 1 group by left_id, right_id)"""

QUERIES = {
    "behavior_edges": lambda spark, sf: edges(events(spark, sf)),
    "behavior_clusters": lambda spark, sf: clusters(events(spark, sf)),
    "behavior_domains": lambda spark, sf: domains(events(spark, sf)),
}
ORACLE_SQL = {
    "behavior_edges": f"with {_EDGES} select * from edges",
    "behavior_clusters": f"""with recursive {_EDGES},
b as (select left_id as u, right_id as v from edges union select right_id, left_id from edges),
t(u, v) as (select u, u from b union select t.u, b.v from t join b on t.v = b.u),
l as (select u as node, min(v) as label from t group by u),
m as (select label, string_agg(distinct node, ',' order by node) as event_ids, string_agg(distinct actor, ',' order by actor) as actor_ids, count(distinct actor) as n from l join ev on ev.id = l.node group by label),
o as (select label, count(*) as pairs, count(*) filter (signal = 'content-hash') as n0, count(*) filter (signal = 'semantic-hash') as n1 from edges join l on l.node = left_id group by label)
select label as first_id, event_ids, actor_ids, pairs, case when n0 >= n1 then 'content-hash' else 'semantic-hash' end as shared_signal,
  case when n0 >= n1 and n0 >= 2 then 'high' when n0 < n1 then 'medium' else 'low' end as confidence from m join o using (label) where n >= 2""",
    "behavior_domains": f"""with {_EDGES},
d as (select domain, count(*) as event_count, count(distinct actor) as actor_count, count(distinct content_hash) as unique_hashes, count(content_hash) as hashes from ev group by domain),
q as (select l.domain, count(*) as pairs from edges join ev l on l.id = left_id join ev r on r.id = right_id where l.domain = r.domain group by l.domain)
select d.domain, event_count, actor_count, unique_hashes, case when hashes > 0 then (hashes - unique_hashes) / hashes else 0 end as repeated_rate, coalesce(pairs, 0) as pair_count from d left join q using (domain)""",
}

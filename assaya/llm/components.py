"""Connected components of an edge table by contraction; links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shuffled, written

#: Pointer-jumping steps in a round.
_JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of ``edges`` (u, v); label is the smallest node of its component.

    In each round every node points to its smallest neighbour, pointers are followed a few steps,
    and edges are rewritten to what their ends point to. Rounds go on until no edge is left.
    """
    spark = edges.sparkSession
    left, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    labels, labels_path = None, None
    while not left.isEmpty():
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("p"))
        parent, parent_path = written(parent, "parents")
        for _ in range(_JUMPS):
            up = shuffled(parent.select(F.col("node").alias("p"), F.col("p").alias("pp")))
            jumped, jumped_path = written(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "parents")
            settled = jumped.join(shuffled(up.where("p <> pp")), "p", "left_semi").isEmpty()
            remove(spark, parent_path)
            parent, parent_path = jumped, jumped_path
            if settled:
                break
        if labels is None:
            following = parent.select("node", F.col("p").alias("label"))
        else:
            up = shuffled(parent.select(F.col("node").alias("label"), "p"))
            known = labels.join(up, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            following = known.unionByName(parent.select("node", F.col("p").alias("label")).join(known.select("node"), "node", "left_anti"))
        following, following_path = written(following, "labels")
        a, b = parent.select(F.col("node").alias("u"), F.col("p").alias("pu")), parent.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        rest = left.join(shuffled(a), "u").join(shuffled(b), "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        rest, rest_path = written(rest, "edges")
        remove(spark, path, parent_path, *([labels_path] if labels_path else []))
        left, path, labels, labels_path = rest, rest_path, following, following_path
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")

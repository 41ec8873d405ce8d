"""Centroid clustering: Lloyd's rounds in exact integers, with exponion search for the nearest centroid.

Each vector carries its cluster, an upper bound of its distance to that centroid and a lower bound
of its distance to all others. A vector whose bounds settle the matter is not looked at. Any other
one scans only the centroids in a ball around its present centroid: with the upper bound u and the
distance s from that centroid to its nearest other, the nearest and the second nearest centroid
lie within 2u + s. Centroids are listed by their distance from each centroid, so the ball is the
head of a list; vectors whose balls hold up to the same power of two of centroids are measured
together. The radius is inclusive and all bounds are widened by ``SLACK``, so ties and rounding
cost a look, never a result.

A round is one map over the vectors, written to the shared folder with their new bounds; sums of
each cluster come as a few rows a task from the same pass. Only centroids reach the driver.

Components are floor(scale * x), held within ``LIMIT`` (|x| of 131,072 at a scale of 1,024) so that
every squared distance fits a long. The centroids' distances from each other take k * k numbers in
each worker: up to some thousands of centroids.

Defined results: vectors that are null, of another length or with a null, NaN or infinite component
are left out; equal rows are clustered one by one, each with the same result; a null vec_id takes
part, but starts a centroid only if too few others are left; of fewer vectors than centroids each
starts one; an empty table gives an empty result; ties go to the smaller number; an empty cluster
keeps its centroid; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, remove, table, written

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 27
#: Relative slack of bounds, far above the rounding of 64-bit floats.
SLACK = 1e-9
_UP, _DOWN = 1 + SLACK, 1 - SLACK


def points(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """vec_id and point (integers) of the fit rows of ``vectors``."""
    v = F.col(vector)
    fit = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    held = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))
    return vectors.where(v.isNotNull() & fit).select("vec_id", F.transform(v, lambda x: F.floor(held(x)).cast("int")).alias("point"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each of ``x`` from each of ``c``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # exact in floats
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` from the same rows of ``c``."""
    return ((x - c) ** 2).sum(1)


class Search:
    """The centroids of a round, the lists of their distances, and how far each has moved since the round before."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        gaps = np.sqrt(squared(centroids, centroids).astype(float))
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        k = len(centroids)
        self.nearest = self.gaps[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(own_squared(centroids, before).astype(float)) * _UP
        top = np.argsort(moved)[::-1][:2]
        self.moved, self.others = moved, np.where(np.arange(k) == top[0], moved[top[-1]] if k > 1 else 0, moved[top[0]])
        self.measured = 0

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters and bounds of ``x`` under these centroids, from those under the centroids before."""
        cluster, upper, lower = cluster.copy(), (upper + self.moved[cluster]) * _UP, (lower - self.others[cluster]) * _DOWN
        settled = np.maximum(lower, self.nearest[cluster] / 2 * _DOWN)
        todo = np.flatnonzero(upper >= settled)
        finite = todo[np.isfinite(upper[todo])]
        upper[finite] = np.sqrt(own_squared(x[finite], self.centroids[cluster[finite]]).astype(float)) * _UP
        self.measured += len(finite)
        todo = todo[upper[todo] >= settled[todo]]
        radius = (2 * upper[todo] + self.nearest[cluster[todo]]) * _UP
        for a in np.unique(cluster[todo]):
            mine = np.flatnonzero(cluster[todo] == a)
            inside = np.searchsorted(self.gaps[a], radius[mine], side="right")
            rings = np.ceil(np.log2(np.maximum(inside, 1))).astype(int)
            for ring in np.unique(rings):
                self._scan(x, todo[mine[rings == ring]], np.sort(self.order[a, : 1 << ring]), cluster, upper, lower)
        return cluster, upper, lower

    def _scan(self, x, rows, candidates, cluster, upper, lower) -> None:
        """Nearest and second nearest of ``candidates`` (in ascending order, so that the first minimum is the smaller number)."""
        d = squared(x[rows], self.centroids[candidates])
        self.measured += d.size
        best = d.argmin(1)
        at = np.arange(len(rows))
        upper[rows] = np.sqrt(d[at, best].astype(float)) * _UP
        d[at, best] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(d.min(1).astype(float)) * _DOWN if len(candidates) > 1 else np.inf
        cluster[rows] = candidates[best]


def _points_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


_STATE = "point array<int>, cluster int, upper double, lower double, n long, sums array<long>"


def _round(state: DataFrame, search: Search) -> DataFrame:
    """The vectors with new clusters and bounds, and for each task and cluster a row with the number and sum of its vectors."""
    k, dims = search.centroids.shape
    sent = state.sparkSession.sparkContext.broadcast(search)  # k * k numbers
    kind = state.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, schema = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            x = _points_of(b.column(1), dims)
            cluster, upper, lower = sent.value.assign(x, *(b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)))
            for a in np.unique(cluster):
                count[a] += (cluster == a).sum()
                total[a] += x[cluster == a].sum(0)
            none = [pa.nulls(b.num_rows, t) for t in (pa.int64(), pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), *none], names=["vec_id", "point", "cluster", "upper", "lower", "n", "sums"])
            schema = out.schema
            yield out
        if schema is not None:
            used = np.flatnonzero(count)
            rows = [*(pa.nulls(len(used), schema.field(c).type) for c in (0, 1)), pa.array(used, pa.int32()), *(pa.nulls(len(used), pa.float64()) for _ in range(2)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, schema=schema)

    return state.select("vec_id", "point", "cluster", "upper", "lower").mapInArrow(run, f"vec_id {kind}, {_STATE}")


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's next place: the floor of the mean of its vectors, exactly."""
    sums = rows.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in sums.collect():  # centroids times dimensions
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The points of the k vectors with the smallest hash of their vec_id."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "point").limit(k).collect()
    return np.array([r["point"] for r in first], np.int64)


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of ``rows`` (vec_id, point) after ``rounds`` rounds and a last assignment, and the centroids."""
    spark = rows.sparkSession
    ready(spark)
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids, before = starts(rows, k, seed), None
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), centroids
    state, path = rows.select("vec_id", "point", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")), None
    for _ in range(rounds):
        done, at = written(_round(state, Search(centroids, before)), "centroids")
        if path:
            remove(spark, path)
        before, centroids = centroids, _moved(done, centroids)
        state, path = done.where("n is null"), at
        if (before == centroids).all():  # all further rounds would be like this one
            break
    search = spark.sparkContext.broadcast(Search(centroids, before))
    dims = centroids.shape[1]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _points_of(b.column(1), dims)
                own = search.value.assign(x, *(b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4)))[0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int32()), pa.array(own_squared(x, search.value.centroids[own]))], names=["vec_id", "cluster", "distance"])

    out, _ = written(state.select("vec_id", "point", "cluster", "upper", "lower").mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "clusters")
    if path:
        remove(spark, path)
    return out, centroids


def summed(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the inertia of its cluster and of all, and the digest of its centroid."""
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    named = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = sums.agg(F.sum("s").cast("long").alias("inertia"))
    few = sums.select("cluster", F.col("s").cast("long").alias("cluster_inertia")).join(named, "cluster").join(F.broadcast(total))  # a row for each centroid
    return found.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(*cluster(points(table(spark, sf_dir, "embeddings"))))


def _oracle() -> str:
    gap = "cast(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"
    steps = [
        f"""p as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(cast(x as double)))) = {DIMS})""",
        f"c0 as materialized (select row_number() over (order by h nulls last, v) - 1 as k, v from (select v, sha256('{SEED}:' || cast(vec_id as varchar)) as h from p order by h nulls last, v limit {CENTROIDS}) as x)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"d{r} as materialized (select p.rid, c.k, {gap} as d from p cross join c{r} c)")
        steps.append(f"a{r} as materialized (select rid, k, d from (select *, row_number() over (partition by rid order by d, k) as n from d{r}) as x where n = 1)")
        if r < ROUNDS:
            mean = f"select k, list(cast(floor(cast(s as double) / n) as bigint) order by pos) as v from (select a.k, i.pos, sum(p.v[i.pos]) as s, count(*) as n from a{r} a join p on p.rid = a.rid cross join range(1, {DIMS + 1}) i(pos) group by a.k, i.pos) as y group by k"
            steps.append(f"c{r + 1} as materialized ({mean} union all select k, v from c{r} where k not in (select k from a{r}))")
    sums = f"i as (select k, cast(sum(d) as bigint) as s from a{ROUNDS} group by k)"
    out = f"select p.vec_id, cast(a.k as int) as cluster, a.d as distance, i.s as cluster_inertia, cast((select sum(s) from i) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256 from a{ROUNDS} a join p on p.rid = a.rid join i on i.k = a.k join c{ROUNDS} c on c.k = a.k"
    return f"with {', '.join(steps)}, {sums} {out}"


ORACLE_SQL = _oracle()

"""Ball k-means over integer vectors.

A cluster is a ball: its centroid, and a radius that all its members lie within.  Another
centroid is a neighbour of a ball only if half its distance lies within the radius; with a
member's own distance below half of that to the nearest neighbour the member is in the stable
core and is compared with nothing.  The rest of the ball is cut into annuli by half the
distances to the neighbours in ascending order: a member in the m-th annulus is compared with
the first m neighbours, exactly.

Vectors stay where they are: every round is a map over a table of vectors with their cluster,
and a sum a cluster, component and task.  Radii after a centroid has moved are bounded by the
old radius and the way it moved, so they cost no pass of their own.  What reaches the driver is
``k`` centroids, radii and sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelquilt.llm.common import Scratch, quoted

#: Components saturate here, so that a squared distance of 64 of them has 63 bits.
MOST = 1 << 27
#: Below this, 64-bit floats hold every sum of products exactly.
EXACT = 1 << 20
#: Added to radii, so that rounding never loses a neighbour.
SLACK = 1e-6


class Balls:
    """Centroids, the radius of each one's members, and what follows from them."""

    def __init__(self, centroids: np.ndarray, radius: np.ndarray | None = None):
        self.centroids, k = centroids, len(centroids)
        self.radius = radius
        away = np.array([[squares(a - b) for b in centroids] for a in centroids], dtype=np.int64).reshape(k, k)
        #: For each ball: squared distances of its neighbours in ascending order, and their numbers.
        self.near: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(k):
            order = np.argsort(away[j], kind="stable")
            order = order[order != j]
            if radius is not None:
                order = order[np.sqrt(away[j][order].astype(np.float64)) <= 2 * radius[j] + SLACK * (1 + radius[j])]
            self.near.append((away[j][order], order))

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector without a ball yet, and its squared distance."""
        best, own = distances(x, self.centroids[0]), np.zeros(len(x), dtype=np.int32)
        for j in range(1, len(self.centroids)):
            d = distances(x, self.centroids[j])
            less = d < best
            best[less], own[less] = d[less], j
        return own, best

    def again(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector, whose ball is known, and its squared distance."""
        own, best = old.copy(), np.zeros(len(x), dtype=np.int64)
        for j in np.unique(old).tolist():
            at = np.flatnonzero(old == j)
            d = distances(x[at], self.centroids[j])
            best[at] = d
            square, other = self.near[j]
            # annulus of each member: neighbours at up to twice its distance, ties included
            annulus = np.searchsorted(square, 4 * d.astype(object), side="right") if len(d) and int(d.max()) >> 61 else np.searchsorted(square, 4 * d, side="right")
            for m in range(int(annulus.max(initial=0))):
                there = at[annulus > m]
                c = int(other[m])
                e = distances(x[there], self.centroids[c])
                less = (e < best[there]) | (e == best[there]) & (c < own[there])
                best[there[less]], own[there[less]] = e[less], c
        return own, best


def squares(x: np.ndarray) -> int:
    return sum(int(v) * int(v) for v in x)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to one centroid."""
    d = x - c
    if len(d) and (np.abs(d) >= EXACT).any():
        return (d * d).sum(axis=1)
    f = d.astype(np.float64)
    return np.einsum("ij,ij->i", f, f).astype(np.int64)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), dims)


def integers(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, q) of the vectors with ``dims`` finite components; q: floor(scale * x), saturated."""
    e = vectors.select(vectors[quoted(vec_id)].alias("vec_id"), vectors[quoted(embedding)].cast("array<double>").alias("e"))
    # a bound of 1e300 is true of finite values alone (of NaN and infinity it isn't, NaN being the largest)
    sound = (F.size("e") == dims) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) <= 1.7976931348623157e308))
    q = F.transform("e", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return e.where(F.coalesce(sound, F.lit(False))).select("vec_id", q.alias("q"))


def _assign(points: DataFrame, balls: Balls, dims: int) -> DataFrame:
    """(vec_id, q, cluster, distance); compared within balls where ``points`` has clusters."""
    known = "cluster" in points.columns
    schema = f"vec_id {points.schema['vec_id'].dataType.simpleString()}, q array<int>, cluster int, distance bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(1)
            x = matrix(q, dims)
            own, best = balls.again(x, batch.column(2).to_numpy().copy()) if known else balls.first(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), q, pa.array(own.astype(np.int32)), pa.array(best)], ["vec_id", "q", "cluster", "distance"])

    return points.select("vec_id", "q", *["cluster"] * known).mapInArrow(work, schema)


def _sums(assigned: DataFrame, dims: int) -> tuple[dict[int, list[int]], dict[int, int], dict[int, int]]:
    """Of each cluster: sums by component, members, largest squared distance.  Components -1 and -2 hold the last two."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int, int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own, d = matrix(batch.column(0), dims), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for j in np.unique(own).tolist():
                at = own == j
                s, n, r = held.get(j, (np.zeros(dims, dtype=np.int64), 0, 0))
                held[j] = s + x[at].sum(axis=0), n + int(at.sum()), max(r, int(d[at].max()))
        for j, (s, n, r) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * (dims + 2), pa.int32()), pa.array([*range(dims), -1, -2], pa.int32()), pa.array([*s.tolist(), n, r], pa.int64())], ["cluster", "part", "v"])

    parts = assigned.select("q", "cluster", "distance").mapInArrow(work, "cluster int, part int, v bigint")
    whole = parts.groupBy("cluster", "part").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("total"), F.max("v").alias("most"))
    sums: dict[int, list[int]] = {}
    members, farthest = {}, {}
    for row in whole.collect():  # k * (dims + 2) rows, whatever the input
        if row["part"] == -1:
            members[row["cluster"]] = int(row["total"])
        elif row["part"] == -2:
            farthest[row["cluster"]] = row["most"]
        else:
            sums.setdefault(row["cluster"], [0] * dims)[row["part"]] = int(row["total"])
    return sums, members, farthest


def _moved(balls: Balls, sums: dict, members: dict, farthest: dict) -> Balls:
    """Centroids at the floored means of their members; empty ones stay.  Radii grow by the way moved."""
    new = balls.centroids.copy()
    for j, s in sums.items():
        new[j] = [v // members[j] for v in s]
    way = np.array([squares(a - b) for a, b in zip(new, balls.centroids)], dtype=np.float64) ** 0.5
    reach = np.array([farthest.get(j, 0) for j in range(len(new))], dtype=np.float64) ** 0.5
    return Balls(new, reach + way + SLACK)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every sound vector.

    Vectors that are null, have another number of components, or a null or non-finite one, are
    left out.  Repeated rows are vectors of their own; null ids are hashed as empty and keep
    their rows; ties go to the smaller cluster, ties among the first centroids to the smaller
    components.  With fewer than ``k`` vectors there are as many clusters; an empty table gives
    an empty one.  Further columns are left aside.  Components beyond 2**27 after scaling
    saturate; inertias that don't fit in 64 bits are null.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "balls")
    points = scratch.write(integers(vectors, vec_id, embedding, dims, scale), "points")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r["q"] for r in points.select("q", place.alias("h")).orderBy("h", "q").limit(k).collect()]
    if not start:
        scratch.keep(points)
        return points.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    balls = Balls(np.array(start, dtype=np.int64))
    for i in range(rounds + 1):
        assigned = scratch.write(_assign(points, balls, dims), f"round{i}")
        scratch.drop(points)
        points = assigned
        if i < rounds:
            balls = _moved(balls, *_sums(points, dims))
    scratch.keep(points)
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in balls.centroids]
    known = spark.createDataFrame([(j, d) for j, d in enumerate(digest)], "cluster int, centroid_sha256 string")
    own = points.groupBy("cluster").agg(F.expr("try_sum(distance)").alias("cluster_inertia"))
    every = points.agg(F.expr("try_sum(distance)").alias("inertia"))
    facts = own.join(F.broadcast(known), "cluster").crossJoin(F.broadcast(every))  # a row a cluster
    return points.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

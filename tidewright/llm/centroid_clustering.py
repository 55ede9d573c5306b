"""Centroid clustering by Yinyang grouping: k-means whose filters skip most distances and change no result.

Vectors become integers (``floor(scale * x)``), so distances, sums and centroids are exact and ties are
real ties.  The starting centroids are put into groups once.  Each row keeps its cluster, an upper bound
of the distance to it and, for each group, one lower bound of the distance to the group's other centroids.
After the centroids have moved, a row whose least lower bound still exceeds its upper bound stays where it
is (global filter); otherwise its own distance is computed, only groups whose bound doesn't exceed it are
opened (group filter), and in those only centroids whose own drift may have brought them near enough
(local filter); what survives is measured exactly.  Bounds are widened by ``SLACK``, far over what
floating point can lose, so that the filters never decide a near tie.

Each round is one map over the table of rows and bounds, written to the shared folder (the round before is
deleted), and one sum over the rows that changed cluster: only partial sums by cluster are shuffled, so the
size of a cluster doesn't matter.  What the driver holds and sends out is the centroids, ``k`` times the
width, both parameters.

Defined results: vectors of another width, with a null or a non-finite component, and null vectors are not
kept; with fewer than ``k`` kept vectors each of them starts a centroid; ties of the starting hash (repeated
or null ids, the null id hashing as the empty text) go by components; repeated rows are rows of their own;
an empty table gives no rows; extra columns are ignored.  A component beyond ``LARGEST`` raises an error, as
its distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import drop_written, ship, written

K, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
SLACK, LARGEST = 1e-9, 1 << 27
STATE = "vec_id long, x array<int>, was int, cluster int, upper double, lower array<double>, distance long"


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves, started evenly spread."""
    c = centroids.astype(float)
    groups = max(1, min(groups, len(c)))
    centre = c[np.linspace(0, len(c) - 1, groups).astype(int)]
    for _ in range(rounds):
        of = ((c[:, None, :] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.array([c[of == g].mean(0) if (of == g).any() else centre[g] for g in range(groups)])
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((x - c) ** 2).sum(1)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 + SLACK) + SLACK


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float)) * (1 - SLACK) - SLACK


def first_scan(x: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cluster, squared distance, upper bound and a lower bound for each group, all from exact distances."""
    best, cluster = squared(x, centroids[0]), np.zeros(len(x), np.int64)
    lower = np.full((len(x), group.max() + 1), np.inf)
    for c in range(1, len(centroids)):
        d = squared(x, centroids[c])
        nearer = d < best
        loser, loses = np.where(nearer, best, d), np.where(nearer, group[cluster], group[c])
        rows = np.arange(len(x))
        lower[rows, loses] = np.minimum(lower[rows, loses], below(loser))
        best, cluster = np.where(nearer, d, best), np.where(nearer, c, cluster)
    return cluster, best, above(best), lower


def next_scan(x: np.ndarray, was: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``first_scan``, but from the bounds of the round before; also how many distances were measured."""
    largest = np.array([drift[group == g].max() for g in range(lower.shape[1])])
    old, upper, lower = lower, upper + drift[was], lower - largest
    upper = upper * (1 + SLACK)
    cluster, measured = was.copy(), 0
    near = np.flatnonzero(lower.min(1) <= upper)  # global filter
    own = squared(x[near], centroids[was[near]])
    measured += len(near)
    upper[near] = above(own)
    still = lower[near].min(1) <= upper[near]
    near, best = near[still], own[still]
    started, at = best.copy(), was[near].copy()
    reach = upper[near]
    for g in range(lower.shape[1]):
        open_ = lower[near, g] <= reach  # group filter
        if not open_.any():
            continue
        members = np.flatnonzero(group == g)
        rest = np.full(len(near), np.inf)  # the group's bound anew, from what is measured or still excluded
        for c in members:
            other = open_ & (was[near] != c)
            bound = old[near, g] - drift[c]
            far = other & (bound > reach)  # local filter
            rest[far] = np.minimum(rest[far], bound[far])
            rows = np.flatnonzero(other & ~far)
            d = squared(x[near[rows]], centroids[c])
            measured += len(rows)
            wins = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
            lost = rows[~wins]
            rest[lost] = np.minimum(rest[lost], below(d[~wins]))
            won = rows[wins]
            # the one that loses its place bounds its own group
            loses, lost_d = group[at[won]], below(best[won])
            same = loses == g
            rest[won[same]] = np.minimum(rest[won[same]], lost_d[same])
            lower[near[won[~same]], loses[~same]] = np.minimum(lower[near[won[~same]], loses[~same]], lost_d[~same])
            best[won], at[won] = d[wins], c
            reach[won] = above(d[wins])
        lower[near[open_], g] = rest[open_]
        # the old own centroid was left out above; once it has lost, it bounds its group like the others
        back = open_ & (group[was[near]] == g) & (at != was[near])
        lower[near[back], g] = np.minimum(lower[near[back], g], below(started[back]))
    upper[near], cluster[near] = reach, at
    return cluster, upper, lower, measured


def start(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest hash, in ascending order of it; a row of the result is a centroid."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = kept.select(F.sha2(name.cast("binary"), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def integers(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, x) of the kept vectors."""
    e = F.col("embedding")
    sound = F.coalesce(F.size(e) == width, F.lit(False))
    finite = F.forall(e, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(e, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    fits = F.forall(whole, lambda v: F.abs(v) <= LARGEST)
    kept = vectors.where(sound).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("w"), fits.alias("fits"))
    return kept.select("vec_id", F.when(F.col("fits"), F.col("w").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}"))).alias("x"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, group: np.ndarray) -> DataFrame:
    """The next ``STATE``: every row with its cluster under ``centroids``; without a drift, from scratch."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width, np.int64)
            if drift is None:
                was = np.full(len(x), -1)
                cluster, distance, upper, lower = first_scan(x, centroids, group)
            else:
                was = batch.column(3).to_numpy().astype(np.int64)
                cluster, upper, lower, _ = next_scan(x, was, batch.column(4).to_numpy().copy(), _matrix(batch.column(5), group.max() + 1, float).copy(), centroids, drift, group)
                distance = squared(x, centroids[cluster])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(distance, pa.int64())],
                names=["vec_id", "x", "was", "cluster", "upper", "lower", "distance"],
            )

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How sums (k x width) and counts of the clusters change by the rows that moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width, np.int64)
            for column, sign in ((1, -1), (2, 1)):
                c = batch.column(column).to_numpy()
                for at in np.unique(c[c >= 0]):
                    total[at, :width] += sign * x[c == at].sum(0)
                    total[at, width] += sign * int((c == at).sum())
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(place, pa.int32()), pa.array(total[at, place], pa.int64())], names=["cluster", "place", "total"])

    moved = state.where("was <> cluster").select("x", "was", "cluster").mapInArrow(run, "cluster int, place int, total long")
    out = np.zeros((k, width + 1), np.int64)
    for r in moved.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # at most k times (width + 1) rows
        out[r["cluster"], r["place"]] = r["total"]
    return out[:, :width], out[:, width]


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, x, cluster, distance) under the last centroids, and those centroids.

    ``groups`` is the number of centroid groups, a tenth of ``k`` and 2 at least if not given.
    """
    spark = vectors.sparkSession
    ship(spark)
    state = written(integers(vectors, width, scale), "vectors")
    centroids = start(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, x array<int>, cluster int, distance long"), centroids.reshape(0, width)
    k = len(centroids)
    group = grouped(centroids, groups or max(2, k // 10))
    sums, counts, drift = np.zeros((k, width), np.int64), np.zeros(k, np.int64), None
    for turn in range(rounds + 1):
        before = state
        state = written(assigned(before, centroids, drift, group), f"clusters-{turn}")
        drop_written(before)
        if turn == rounds:
            break
        more, n = changes(state, k, width)
        sums, counts = sums + more, counts + n
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        drift = above(squared(moved, centroids))
        drift[(moved == centroids).all(1)] = 0.0
        if not drift.any():
            break  # all later rounds would find the same
        centroids = moved
    return state.select("vec_id", "x", "cluster", "distance"), centroids


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per vector its cluster, its distance, the sums of distances and a hash of the final centroid."""
    spark = found.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    kind = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return found.join(F.broadcast(spark.createDataFrame(rows, kind)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

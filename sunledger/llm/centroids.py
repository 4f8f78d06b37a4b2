"""Exact k-means of integer vectors, with Hamerly's bounds.

Every vector carries its cluster, an upper bound on the distance to its centroid and one lower bound on the distance to
every other. When centroids have moved, the upper one grows by how far the own centroid went and the lower one falls by
the farthest way of any other. While the upper bound stays under the lower one, or under half the way from the own centroid
to the next, the cluster cannot change, and nothing is computed. Else the own distance is computed, and where that does
not settle it, the vector gets a full scan of all centroids. Distances are squared integers, compared exactly, with ties
to the smaller number; bounds are rounded outwards and must differ to skip a vector, so they never change a result.

Vectors and bounds lie in one table that each round writes anew (and deletes before the last): vectors are never shuffled.
Vectors that changed their cluster add their components to the new one's sum and take them from the old one's; sums are
made in each task first. The driver sees the k centroids and sums, nothing else.

Vectors null, of another number of components or with a null or non-finite one take no part and are not in the result.
Repeated rows and ids count as often as they are there. With fewer vectors than k there are as many clusters as
vectors; without any, the result is empty. Components are floor(scale * x); where one reaches 2**25 in size, Python's
integers do the work of 64-bit ones, and distances and inertias beyond a long are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunledger.llm.common import discard, materialize

LONGEST = (1 << 63) - 1
#: Sizes of components for which 64-bit sums of squared differences are exact, for up to 2048 components.
SMALL = 1 << 25
BOUNDS = "cluster int, upper double, lower double, before int, scanned boolean"


def _kind(vectors: DataFrame) -> str:
    return "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"


def kept_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and embedding (doubles; floats stay floats) of vectors with size finite components."""
    x = F.col("embedding")
    whole = (F.size(x) == size) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(x.isNotNull() & F.coalesce(whole, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast(_kind(vectors)).alias("embedding"))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as int64 where sums of squares of differences are exact in it, else as Python's integers."""
    scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], dtype=object).reshape(scaled.shape)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every row of vectors to the row of centroids beside it (or the one centroid)."""
    gap = vectors - centroids
    return (gap * gap).sum(axis=-1)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _root(x: np.ndarray, towards: Callable) -> np.ndarray:
    """Square root rounded outwards: one step for a large integer's conversion, one for the root."""
    return towards(np.sqrt(towards(np.asarray(x, dtype=object).astype(np.float64))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Moved:
    """What a round needs to know of the centroids: all distances are rounded so that bounds stay bounds."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.centroids, k = centroids, len(centroids)
        pairs = squared(centroids[:, None, :], centroids[None, :, :]).astype(object)
        self.half = np.full(k, np.inf)
        if k > 1:
            near = np.array([min(pairs[i][j] for j in range(k) if j != i) for i in range(k)], dtype=object)
            self.half = _down(_root(near, _down) / 2)
        self.drift = np.zeros(k) if before is None else _root(squared(centroids, before), _up)
        others = [max((d for j, d in enumerate(self.drift) if j != i), default=0.0) for i in range(k)]
        self.others = np.array(others)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Full scan: nearest centroid (ties: smallest number), upper and lower bound."""
        distances = np.stack([squared(vectors, c) for c in self.centroids], axis=1)
        nearest = distances.argmin(axis=1)
        rows = np.arange(len(vectors))
        best = distances[rows, nearest]
        if len(self.centroids) == 1:
            return nearest, _root(best, _up), np.full(len(vectors), np.inf)
        rest = distances.copy()
        rest[rows, nearest] = distances.max() + 1
        return nearest, _root(best, _up), _root(rest.min(axis=1), _down)

    def step(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Bring clusters and bounds up to date, in place; says which vectors had to be scanned."""
        upper[:] = _up(upper + self.drift[cluster])
        lower[:] = _down(lower - self.others[cluster])
        safe = np.maximum(lower, self.half[cluster])
        loose = np.flatnonzero(upper >= safe)
        upper[loose] = _root(squared(vectors[loose], self.centroids[cluster[loose]]), _up)
        scan = loose[upper[loose] >= safe[loose]]
        scanned = np.zeros(len(vectors), bool)
        if len(scan):
            cluster[scan], upper[scan], lower[scan] = self.assign(vectors[scan])
            scanned[scan] = True
        return scanned


def _as_matrix(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SMALL for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if small else object)


def _round(centroids: list[list[int]], before: list[list[int]] | None, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = Moved(_as_matrix(centroids), None if before is None else _as_matrix(before))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = integers(_matrix(batch.column("embedding")), scale)
            if before is None:
                cluster, upper, lower = moved.assign(vectors)
                old, scanned = np.full(len(vectors), -1), np.ones(len(vectors), bool)
            else:
                cluster, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                old = cluster.copy()
                scanned = moved.step(vectors, cluster, upper, lower)
            columns = [pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(old.astype(np.int32)), pa.array(scanned)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), *columns], ["vec_id", "embedding", "cluster", "upper", "lower", "before", "scanned"])

    return run


def _changes(k: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's vectors add to each cluster: (cluster, n, sums as decimal text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * k, [None] * k
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = integers(_matrix(batch.column("embedding")), scale)
            for sign, name in ((1, "cluster"), (-1, "before")):
                cluster = batch.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(cluster[cluster >= 0]):
                    own = vectors[cluster == c]
                    total = own.sum(axis=0).astype(object) * sign
                    counts[c] += sign * len(own)
                    sums[c] = total if sums[c] is None else sums[c] + total
        there = [c for c in range(k) if sums[c] is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(there, pa.int32()), pa.array([counts[c] for c in there], pa.int64()), pa.array([[str(x) for x in sums[c]] for c in there], pa.list_(pa.string()))], ["cluster", "n", "sums"]
        )

    return run


def _distances(centroids: list[list[int]], scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = _as_matrix(centroids)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cluster = integers(_matrix(batch.column("embedding")), scale), batch.column("cluster")
            exact = [str(x) for x in squared(vectors, final[cluster.to_numpy(zero_copy_only=False)])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(exact), batch.column("scanned")], ["vec_id", "cluster", "exact", "scanned"])

    return run


def seeds(vectors: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The k vectors whose `seed:vec_id` has the least SHA-256 (ties: smaller vector first; null ids are written as -)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("-")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return [[int(x) for x in integers(np.array([r["embedding"]], np.float64), scale)[0]] for r in first]


def _updated(state: DataFrame, centroids: list[list[int]], counts: list[int], sums: list[list[int]], scale: int) -> list[list[int]]:
    """Counts and sums take in what changed; the new centroids are floors of means, those of empty clusters stay."""
    k = len(centroids)
    parts = state.filter("before <> cluster").select("embedding", "cluster", "before").mapInArrow(_changes(k, scale), "cluster int, n long, sums array<string>")
    number = F.col("x").cast("decimal(38,0)")
    each = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(number).cast("string").alias("x"))
    for row in each.collect():  # k x components numbers
        sums[row["cluster"]][row["at"]] += int(row["x"])
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        counts[row["cluster"]] += row["n"]
    return [[x // n for x in s] if n else c for c, n, s in zip(centroids, counts, sums, strict=True)]


def within_long(x: Column) -> Column:
    return F.when(F.abs(x) <= LONGEST, x).cast("long")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, scanned (by the last assignment).

    vectors: vec_id, embedding; other columns are not looked at. rounds times, vectors go to their nearest centroid and
    each centroid to the floor of its vectors' mean; then they are assigned once more.
    """
    spark, rows = vectors.sparkSession, kept_vectors(vectors, size)
    centroids = seeds(rows, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned boolean")
    k = len(centroids)
    counts, sums = [0] * k, [[0] * size for _ in range(k)]
    state, before = rows, None
    for r in range(rounds + 1):
        new = materialize(state.mapInArrow(_round(centroids, before, scale), f"vec_id long, embedding {_kind(rows)}, {BOUNDS}"), "bounds")
        if before is not None:
            discard(state)
        state, before = new, centroids
        if r < rounds:
            centroids = _updated(state, centroids, counts, sums, scale)
    exact = materialize(state.select("vec_id", "embedding", "cluster", "scanned").mapInArrow(_distances(centroids, scale), "vec_id long, cluster int, exact string, scanned boolean"), "distances")
    discard(state)
    inertia = {r["cluster"]: int(r["x"]) for r in exact.groupBy("cluster").agg(F.sum(F.col("exact").cast("decimal(38,0)")).cast("string").alias("x")).collect()}  # k numbers
    short = lambda x: x if x <= LONGEST else None
    sha = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = short(sum(inertia.values()))
    known = [(c, short(x), whole, sha[c]) for c, x in inertia.items()]
    of = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    out = exact.withColumn("distance", within_long(F.col("exact").cast("decimal(38,0)")))
    return out.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")

"""Exact k-means over integer vectors, with Hamerly's bounds to skip distances.

Each round is one pass over a table in the shared folder that holds, beside each vector, its cluster, one upper bound
of the distance to its centroid and one lower bound of the distance to any other.  After centroids move, the upper
bound grows by the own centroid's drift and the lower one shrinks by the largest drift of another.  A vector whose
upper bound stays below its lower bound, or below half the distance from its centroid to the nearest other, keeps its
cluster unseen; else the upper bound is made exact, and if that doesn't settle it the vector is compared with every
centroid in integers.  Bounds are rounded away from each other, so no tie and no rounding is taken for a decision.

Rounds depend on k x dimensions numbers alone, which is all that reaches the driver: sums are taken cluster by cluster
with partial sums in every task, so a cluster of a third of all vectors is no task's burden.  A round's table replaces
the one before, which is removed.

Vectors that are null, have another number of components or a null or non-finite one are left out.  Repeated rows are
vectors of their own; where ids repeat, starting centroids are taken by components.  Components are clamped to
+-LARGEST, so squared distances always fit a long; sums of distances beyond that stop at the largest long.  With fewer
vectors than centroids there are as many centroids as vectors; no vectors give no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.shared import fresh_path, remove

#: 64 x (2 x LARGEST)^2 is the largest that a long holds.
LARGEST = 189_812_531
#: With components up to this, products of doubles are exact.
EXACT_DOUBLE = 1 << 22
STATE = "vec_id long, x array<int>, cluster int, distance long, upper double, lower double, scans int"


def kept_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<int>): whole numbers floor(scale * component) of the vectors that have dims finite components."""
    e = F.col(embedding)
    sound = (F.size(e) == dims) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))

    def whole(v: Column) -> Column:
        return F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")

    return embeddings.where(F.coalesce(sound, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, whole).alias("x"))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT_DOUBLE and x.shape[1] <= 256:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)).astype(np.int64)
    # sums wrap modulo 2^64, and the distances themselves fit
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(1)


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + 1e-12) + 1e-9


def _below(d2: np.ndarray) -> np.ndarray:
    return np.maximum(np.sqrt(d2.astype(np.float64)) * (1 - 1e-12) - 1e-9, 0.0)


def assign(x: np.ndarray, centroids: np.ndarray, state: dict | None = None, moved_from: np.ndarray | None = None) -> dict:
    """Nearest centroid of each row (ties: the smaller number), with bounds; state and the centroids it was made for let rows be skipped."""
    n, k = len(x), len(centroids)
    if state is None:
        out = {"cluster": np.zeros(n, np.int32), "distance": np.zeros(n, np.int64), "upper": np.full(n, np.inf), "lower": np.zeros(n), "scans": np.zeros(n, np.int32)}
        open_rows = np.arange(n)
    else:
        out = {name: values.copy() for name, values in state.items()}
        drift = _above(_own_squares(centroids, moved_from))
        own = out["cluster"]
        order = np.argsort(drift)
        largest_other = np.full(k, drift[order[-1]])
        largest_other[order[-1]] = drift[order[-2]] if k > 1 else 0.0
        out["upper"] = (out["upper"] + drift[own]) * (1 + 1e-12)
        out["lower"] = np.maximum(out["lower"] - largest_other[own], 0.0) * (1 - 1e-12)
        between = _squares(centroids, centroids)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        half = _below(between.min(1)) / 2
        bound = np.maximum(out["lower"], half[own])
        unsure = np.flatnonzero(out["upper"] >= bound)
        out["distance"][unsure] = _own_squares(x[unsure], centroids[own[unsure]])
        out["upper"][unsure] = _above(out["distance"][unsure])
        open_rows = unsure[out["upper"][unsure] >= bound[unsure]]
    if len(open_rows):
        d2 = _squares(x[open_rows], centroids)
        at = np.argmin(d2, 1)
        rows = np.arange(len(open_rows))
        least = d2[rows, at]
        d2[rows, at] = np.iinfo(np.int64).max
        out["cluster"][open_rows], out["distance"][open_rows] = at, least
        out["upper"][open_rows], out["lower"][open_rows] = _above(least), _below(d2.min(1)) if k > 1 else np.inf
        out["scans"][open_rows] += 1
    return out


def _round(vectors: DataFrame, centroids: np.ndarray, moved_from: np.ndarray | None, exact: bool) -> DataFrame:
    """The next state table; exact: distances of skipped vectors too."""
    dims = centroids.shape[1]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), dims).astype(np.int64)
            state = None
            if moved_from is not None:
                state = {name: b.column(name).to_numpy(zero_copy_only=False) for name in ("cluster", "distance", "upper", "lower", "scans")}
            now = assign(x, centroids, state, moved_from)
            if exact:
                now["distance"] = _own_squares(x, centroids[now["cluster"]])
            columns = {"vec_id": b.column("vec_id"), "x": b.column("x"), **{n: pa.array(v) for n, v in now.items()}}
            yield pa.RecordBatch.from_arrays([columns[f.split()[0]] for f in STATE.split(", ")], names=[f.split()[0] for f in STATE.split(", ")])

    return vectors.mapInArrow(run, STATE)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, DataFrame]:
    """Assignments (vec_id, x, cluster, distance, scans) and centroids (cluster, components, size, cluster_inertia, inertia, centroid_sha256) of vectors (vec_id, x).

    scans: how often a vector was compared with every centroid; without bounds it would be rounds + 1.
    """
    spark = vectors.sparkSession

    def kept(df: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, table = kept(vectors, "vectors")
    first = table.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "x").limit(k).collect()
    empty = "vec_id long, x array<int>, cluster int, distance long, scans int"
    if not first:
        none = spark.createDataFrame([], "cluster int, components array<long>, size long, cluster_inertia long, inertia long, centroid_sha256 string")
        return spark.createDataFrame([], empty), none
    centroids, before = np.array([r["x"] for r in first], dtype=np.int64), None
    for at in range(rounds + 1):
        last = path
        path, table = kept(_round(table, centroids, before, exact=at == rounds), "assigned")
        remove(spark, last)
        if at == rounds:
            break
        sums = table.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.element_at("x", i + 1)).alias(f"s{i}") for i in range(centroids.shape[1])])
        before, centroids = centroids, centroids.copy()
        for row in sums.collect():
            centroids[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    names = [(j, c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sizes = table.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("d"))
    # over at most k rows
    sizes = sizes.withColumn("all", F.sum("d").over(Window.partitionBy()))
    found = spark.createDataFrame(names, "cluster int, components array<long>, centroid_sha256 string").join(sizes, "cluster", "left")
    found = found.select(
        "cluster", "components", F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.least(F.coalesce("d", F.lit(0)), largest).cast("long").alias("cluster_inertia"),
        F.least(F.max("all").over(Window.partitionBy()), largest).cast("long").alias("inertia"), "centroid_sha256",
    )
    return table.select(*[f.split()[0] for f in empty.split(", ")]), found

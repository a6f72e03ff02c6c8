"""Clusters of integer vectors around a few centroids, in Spark expressions alone.

Components are scaled and rounded down to integers, so all distances and sums are exact and no order of rows changes
a result. Each round compares every vector with the centroids as literal arrays: ``zip_with`` and ``aggregate`` give the
products, ``array_min`` over structs (distance, number) the nearest centroid, and one column sum per component, combined
before the shuffle, the new centroids. Only k rows of sums come back in a round, so a cluster with a third of all
vectors is no hot spot, and the vectors are stored once and never shuffled.

The first centroids are the k kept vectors with the least SHA-256 of ``<seed>:<id>``.

Results: one row for each kept vector, in which repeated rows are repeated. A vector is left out if it is null, has another
number of components, or a component that is null, infinite or no number. With fewer than k kept vectors all are
centroids at first; equal centroids share their vectors' ties with the least number, and a centroid without vectors stays. An
empty table gives an empty result. Rows without an id come last among the first centroids. Components beyond about
2**24 overflow the distance and fail with an arithmetic error instead of a wrong result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.session import stage


@dataclass(frozen=True)
class Clusters:
    assigned: DataFrame  # id, q (integers), cluster, distance
    centroids: list[list[int]]


def quantised(vectors: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """Rows (id, q, norm) of the vectors that are whole; norm is the sum of squares."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") == size)).filter(finite)
    whole = rows.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("q"))
    return whole.withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda total, x: total + x * x))


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (distance, cluster) of the nearest centroid, the lower number on a tie, from the columns q and norm."""
    ways = []
    for number, centroid in enumerate(centroids):
        # One expression text: building k x size literals one by one would take the driver longer than the round.
        fixed = f"array({', '.join(f'{c}L' for c in centroid)})"
        products = f"aggregate(zip_with(q, {fixed}, (a, b) -> a * b), 0L, (total, x) -> total + x)"
        ways.append(f"struct(norm + {sum(c * c for c in centroid)}L - 2 * {products} AS distance, {number} AS cluster)")
    return F.expr(f"array_min(array({', '.join(ways)}))")


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["q"]) for r in rows.orderBy(F.asc_nulls_last(key), "q").select("q").limit(k).collect()]


def update(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids moved to the rounded-down means of their vectors; sums are taken in Spark, k rows come back."""
    own = rows.select("q", nearest(centroids)["cluster"].alias("cluster"))
    sums = own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    )
    moved = list(centroids)
    for r in sums.collect():
        moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return moved


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", size: int = 64, scale: int = 64, k: int = 16,
    rounds: int = 3, seed: int = 1,
) -> Clusters:
    """Vectors with the cluster and squared distance after ``rounds`` moves of the centroids."""
    rows = stage(quantised(vectors, id_column, vector_column, size, scale), "vectors")
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        empty = rows.select("id", "q", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(empty.withColumnRenamed("id", id_column), [])
    for _ in range(rounds):
        centroids = update(rows, centroids)
    found = rows.select("id", "q", nearest(centroids).alias("found"))
    assigned = found.select("id", "q", "found.cluster", "found.distance").withColumnRenamed("id", id_column)
    return Clusters(assigned, centroids)


def with_inertia(made: Clusters) -> DataFrame:
    """The assignment with each cluster's and the whole sum of distances and the digest of the cluster's centroid."""
    rows = stage(made.assigned.drop("q"), "clusters")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    # One value for each centroid.
    inertia = F.array(*[F.lit(sums.get(i, 0)).cast("long") for i in range(len(made.centroids))] or [F.lit(0).cast("long")])
    names = F.array(*[F.lit(",".join(map(str, c))) for c in made.centroids] or [F.lit("")])
    return rows.select(
        "*", F.get(inertia, "cluster").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.sha2(F.get(names, "cluster"), 256).alias("centroid_sha256"),
    )

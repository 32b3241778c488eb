"""Centroid clustering of vectors in whole numbers, by JVM expressions.

``cluster`` turns vectors into whole-number arrays once, then runs rounds of: ``zip_with``
and ``aggregate`` give each vector's distances to the literal centroid arrays, ``array_min``
over (distance, number) structs chooses, and one aggregate of a generated-code sum for
each component gives the next centroids. A distance is computed as |v|^2 + (|c|^2 - 2 v.c),
so that an element costs one product; all of it is exact in 64 bits.

The driver holds the centroids (``k`` arrays) and nothing else. Each round is one scan of
the stored vectors and an aggregate with map-side sums, so a very common vector or a cluster with a
third of all rows is ``k`` partial rows a task.

Cases: a vector that is null, has another number of components, or holds a null, NaN or infinite
one is left out. Components are held to +-2**27 after scaling, beyond which squared
distances would not fit 64 bits. Ties take the smaller cluster number; repeated rows are
separate vectors; a null ``vec_id`` is clustered like any other but starts no cluster. With
fewer vectors than ``k``, each starts a cluster; an empty table gives no row. Other
columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, written

LARGEST = 1 << 27


def whole_numbers(vectors: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): the kept vectors as arrays of ``floor(scale * x)`` and their squared lengths."""
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x")).filter((F.size("x") == dims) & F.forall(
        "x", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    held = F.transform("x", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    return kept.select("vec_id", held.alias("v")).withColumn("norm", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x))


def nearest(centroids: list[list[int]]) -> Column:
    """Struct (d, cluster) of the nearest centroid of ``v``; ``d`` is the distance less ``norm``."""
    def literal(c: list[int]) -> str:
        return "array(" + ",".join(f"{x}L" for x in c) + ")"
    each = ",".join(f"named_struct('c', {literal([-2 * x for x in c])}, 'n', {sum(x * x for x in c)}L, 'i', {i})" for i, c in enumerate(centroids))
    return F.expr(f"""array_min(transform(array({each}), t -> named_struct(
        'd', aggregate(zip_with(v, t.c, (a, b) -> a * b), t.n, (s, x) -> s + x), 'cluster', t.i)))""")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order (then by components)."""
    ranked = vectors.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r.v) for r in ranked.orderBy("h", "v").limit(k).collect()]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The next centroids: floor of the mean of each one's vectors; one without vectors stays."""
    sums = vectors.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))])
    out = list(centroids)
    for row in sums.collect():  # k rows at most
        out[row.cluster] = [row[i] // row.n for i in range(2, len(row))]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: int = 2,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each kept vector, and the final centroids."""
    spark = vectors.sparkSession
    whole = written(whole_numbers(vectors, dims, scale, id_col, vec_col), scratch(spark, "whole-vectors"))
    centroids = first_centroids(whole, k, seed)
    if not centroids:
        return whole.select("vec_id", F.lit(0).alias("cluster"), F.col("norm").alias("distance")).limit(0), []
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    near = whole.withColumn("near", nearest(centroids))
    return near.select("vec_id", F.col("near.cluster").alias("cluster"), (F.col("norm") + F.col("near.d")).alias("distance")), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` (written once) with its cluster's and the whole inertia and the centroid's digest."""
    spark = assigned.sparkSession
    stored = written(assigned, scratch(spark, "clusters"))
    total = F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("bigint")
    each = stored.groupBy("cluster").agg(total.alias("cluster_inertia"))
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    per_cluster = each.join(F.broadcast(digests), "cluster")
    # k rows
    joined = stored.join(F.broadcast(per_cluster), "cluster")
    whole = stored.agg(total.alias("inertia"))
    return joined.withColumn("inertia", whole.scalar()).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same clusters in SQL, the rounds written out."""
    parts = [f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS i, v AS c FROM e WHERE vec_id IS NOT NULL
  ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, i := i)) AS near FROM (
    SELECT r, i, CAST(list_sum([(v[j] - c[j]) * (v[j] - c[j]) for j in range(1, {dims + 1})]) AS BIGINT) AS d FROM e, c{n}) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT i, j, CAST(sum(x) AS BIGINT) AS s, CAST(count(*) AS BIGINT) AS n FROM (
    SELECT near.i AS i, unnest(range(1, {dims + 1})) AS j, unnest(v) AS x FROM a{n} JOIN e USING (r)) GROUP BY i, j),
m{n} AS (SELECT i, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{n} GROUP BY i),
c{n + 1} AS MATERIALIZED (SELECT c{n}.i, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (i))""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT e.vec_id, CAST(near.i AS INTEGER) AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.i) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM {last} JOIN e USING (r) JOIN c{rounds} ON c{rounds}.i = near.i"""

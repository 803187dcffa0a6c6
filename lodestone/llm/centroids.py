"""Centroid clustering (Lloyd's rounds over integers) in DataFrame expressions only.

A component x becomes the integer floor(256 * x), so distances, sums and centroids are exact and no order of adding
changes a result. The centroids of a round are literals: K arrays in the plan. zip_with and aggregate give a
vector's squared distance to each, array_min of structs (distance, number) chooses the nearest, and ties go
to the smaller number. New centroids are sums of columns, one a component, added up where the vectors lie: a task sends
K rows on, whatever it has read, so copies and large clusters make no hot task. Only those K rows come to the driver in a round.

The first centroids are the K vectors with the smallest hash of their id. Kept vectors have exactly DIM components, none
null, NaN or infinite, and none beyond LARGEST / 256, as squared distances of larger ones need more than 64 bits; others
have no row in the result. A null id has no hash and comes last in that order; equal hashes (repeated ids) are ordered
by components. Repeated rows are clustered each. With fewer than K vectors there are so many centroids. Empty table:
empty result. Very long arrays aren't kept. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, n_tasks, spool, table

K, DIM, ROUNDS, SCALE, SEED, LARGEST = 40, 64, 5, 256, 2, 1 << 27
Centroids = list[tuple[int, ...]]


def integers(vector: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """array<bigint> of floor(scale * x); null for vectors that aren't kept."""
    bound = F.lit(LARGEST / scale)
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= bound, F.lit(False)))  # NaN is larger than any number
    return F.when((F.size(vector) == dim) & usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> Centroids:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").select("v").limit(k).collect()
    return [tuple(r["v"]) for r in rows]


def nearest(centroids: Centroids) -> Column:
    """struct (distance, cluster) of column v, whose squares add up to column square: |v - c|^2 = |v|^2 + |c|^2 - 2 vc."""
    one = "struct(square + {}L - 2 * aggregate(zip_with(v, array({}), (a, b) -> a * b), 0L, (s, x) -> s + x) AS distance, {} AS cluster)"
    all_of = (one.format(sum(x * x for x in c), ", ".join(f"{x}L" for x in c), i) for i, c in enumerate(centroids))
    return F.expr(f"array_min(array({', '.join(all_of)}))")


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid's vectors' componentwise floor(sum / count); one without vectors stays."""
    dim = range(len(centroids[0]))
    sums = [F.sum(F.col("v")[d]).alias(f"s{d}") for d in dim]
    rows = vectors.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()
    new = {r["cluster"]: tuple(r[f"s{d}"] // r["n"] for d in dim) for r in rows}
    return [new.get(i, c) for i, c in enumerate(centroids)]


def cluster(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> tuple[DataFrame, Centroids]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of the kept vectors, and the final centroids."""
    vectors = df.select(F.col(vec_id).alias("vec_id"), integers(F.col(vector), dim).alias("v")).filter("v IS NOT NULL")
    square = F.aggregate(F.transform("v", lambda x: x * x), F.lit(0).cast("long"), lambda s, x: s + x)
    tasks = max(n_tasks(df.sparkSession), vectors.rdd.getNumPartitions())  # a vector costs far more to compare than to move
    vectors = spool(vectors.withColumn("square", square).repartition(tasks), "vectors")
    centroids = first_centroids(vectors, k)
    if not centroids:
        none = F.lit(None)
        return vectors.select("vec_id", none.cast("int").alias("cluster"), *[none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    near = nearest(centroids)
    assigned = spool(vectors.select("vec_id", near.alias("_near")).select("vec_id", "_near.cluster", "_near.distance"), "assigned")
    discard(vectors)
    totals = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    of = F.array(*[F.lit(totals.get(i, 0)).cast("long") for i in range(len(centroids))])
    return assigned.select("vec_id", "cluster", "distance", of[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia")), centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    out, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    digest = F.array(*map(F.lit, digests))[F.col("cluster")] if digests else F.lit(None).cast("string")
    return out.withColumn("centroid_sha256", digest)


def _sql() -> str:
    steps = [f"""
kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) <= {LARGEST // SCALE})) = {DIM}),
vec AS (SELECT row_number() OVER () AS r, * FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM vec QUALIFY cluster < {K})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS (SELECT r, any_value(vec.vec_id) AS vec_id, any_value(vec.v) AS v,
    min((CAST(list_sum(list_transform(list_zip(vec.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), c.cluster)) AS near
  FROM vec CROSS JOIN c{i} c GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS v FROM (
    SELECT near[2] AS cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT near, unnest(v) AS x, unnest(range({DIM})) AS d FROM a{i}) GROUP BY near[2], d) GROUP BY cluster),
c{i + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(near[2] AS INT) AS cluster, near[1] AS distance, CAST(sum(near[1]) OVER (PARTITION BY near[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(near[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.cluster = near[2]
"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLES = {"op13_centroid_clustering": _sql()}

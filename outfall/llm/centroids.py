"""Centroid clustering with JVM expressions only (operator 12).

Vectors become integers once and are written to the shared folder. A round is one scan: ``zip_with`` and ``aggregate`` give the squared distance to each
centroid, a literal array; ``array_min`` of (distance, number) picks the cluster; sums of the columns of a vector, combined before the exchange, give the
next centroids. What comes back to the driver in a round is one row per cluster, however many vectors there are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outfall.llm.common import stored

SIZE = 64
CENTROIDS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Integers are held within this bound, so that a squared distance of up to 64 components fits into a long.
MOST = 1 << 27
LONGEST = (1 << 63) - 1


def integers(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v) of vectors with ``size`` components, none null or not finite; v is floor(1024 * x), held within ``MOST``."""
    x = F.col("embedding")
    whole = (F.size(x) == size) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * float(SCALE)))).cast("int")
    return vectors.where(x.isNotNull() & whole).select(F.col("vec_id"), F.transform(x, scaled).alias("v"))


def first_centroids(found: DataFrame, n: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in their order; equal ids by components, a null id last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in found.select("v", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "v").limit(n).collect()]


def nearest(centroids: list[list[int]], v: str = "v") -> Column:
    """Struct (distance, cluster) of the nearest centroid; equal distances: the smaller number. Each centroid is one literal array, folded from a string."""
    near = []
    for k, c in enumerate(centroids):
        literal = f"CAST(split('{','.join(map(str, c))}', ',') AS array<bigint>)"
        square = f"zip_with({v}, {literal}, (a, b) -> (a - b) * (a - b))"
        near.append(f"struct(aggregate({square}, 0L, (total, d) -> total + d) AS distance, {k} AS cluster)")
    return F.expr(f"array_min(array({', '.join(near)}))")


def column_sums(size: int) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.expr(f"sum(CAST(v[{i}] AS bigint)) AS s{i}") for i in range(size))]


def moved(found: DataFrame, centroids: list[list[int]], sums: list[Column]) -> list[list[int]]:
    """Floor of the mean of each centroid's vectors, component by component; a centroid without vectors stays."""
    out = list(centroids)
    for r in found.select("v", nearest(centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(*sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def cluster_vectors(vectors: DataFrame, size: int = SIZE, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another size or hold null or non-finite components give no row. With fewer kept vectors than ``n`` there are as many
    centroids as vectors; without any there are no rows. Repeated rows count each; equal vectors share a cluster, whatever their number. A null vec_id is
    no first centroid unless too few others exist. Components beyond 131,072 count as that bound; inertias beyond a long as the largest long.
    Other columns are left out.
    """
    found = stored(integers(vectors, size), "vectors")
    centroids = first_centroids(found, n, seed)
    if not centroids:
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return found.sparkSession.createDataFrame([], kinds)
    sums = column_sums(size)
    for _ in range(rounds):
        centroids = moved(found, centroids, sums)
    placed = found.select("vec_id", nearest(centroids).alias("near")).select("vec_id", "near.cluster", "near.distance")
    total = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("total")).collect()}
    inertias = [min(total.get(k, 0), LONGEST) for k in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = F.col("cluster") + 1
    return placed.select("vec_id", "cluster", "distance", F.element_at(F.lit(inertias).cast("array<bigint>"), own).alias("cluster_inertia"),
                         F.lit(min(sum(total.values()), LONGEST)).cast("long").alias("inertia"), F.element_at(F.lit(digests), own).alias("centroid_sha256"))


def cluster_sql(size: int = SIZE, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same as one query for DuckDB: a pair of common tables for each round."""
    assigned = "SELECT vec_id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, k := k)) AS near FROM vectors, c{} GROUP BY vec_id, v"
    tables = [f"""vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {size} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
              f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1)::INT AS k, v AS c FROM vectors ORDER BY k LIMIT {n})"]
    for t in range(rounds):
        tables += [f"a{t} AS MATERIALIZED ({assigned.format(t)})",
                   f"""s{t} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS m FROM (SELECT near.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY k, i)""",
                   f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.k AS k, coalesce(any_value(u), any_value(c)) AS c FROM c{t} LEFT JOIN (
        SELECT k, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS u FROM s{t} GROUP BY k) new ON new.k = c{t}.k GROUP BY c{t}.k)"""]
    tables.append(f"last AS MATERIALIZED ({assigned.format(rounds)})")
    return f"""WITH {', '.join(tables)} SELECT vec_id, near.k AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.k))::BIGINT AS cluster_inertia,
        (sum(near.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{rounds} ON c{rounds}.k = near.k"""

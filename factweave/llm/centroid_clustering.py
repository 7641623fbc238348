"""Centroid clustering by plain Lloyd rounds on integers.

A vector with exactly `dim` finite components becomes integers floor(scale * x), written once. Each round broadcasts the k
centroids (k x dim numbers), and mapInPandas takes integer squared differences to each centroid in NumPy; argmin takes the
lowest number of those that tie. A partition gives at most k rows of sums and counts; they merge through groupBy, so the
driver gets k x dim numbers a round. New centroids are exact floors; a centroid without vectors stays. Integers make every figure the same
however the rows are dealt.

Scaled components must lie within 2^27 of zero, so that squared distances fit 64 bits; beyond that the job fails with an
error rather than give wrong figures. Sums merge as decimals of 38 digits.

Cases: null vectors, vectors of another length and vectors with null, NaN or infinite components are left out; equal vectors
and repeated rows count each; a null vec_id hashes as the empty string, and equal hashes are told apart by the components;
with fewer than k vectors there are as many centroids as vectors; an empty table, or one with no such vector, gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep

#: Largest scaled component: differences stay below 2^28, squared distances of 64 components below 2^62.
LARGEST = 1 << 27


def integer_vectors(table: DataFrame, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of int), for vectors with exactly dim finite components."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda e: e.cast("double"))
    odd = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform("x", lambda e: F.floor(e * scale))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dim) & ~odd)
    far = F.exists("v", lambda e: F.abs(e) > LARGEST)
    rows = rows.select("vec_id", whole.alias("v"))
    checked = F.when(far, F.raise_error(F.lit("a scaled component is beyond 2^27"))).otherwise(F.col("v"))
    return rows.select("vec_id", checked.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `3:` and the id, in that order."""
    digest = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the lowest of those that tie) and the squared distance to it, of each row of v."""
    distance = np.empty((len(v), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        d = v - centre
        distance[:, c] = np.einsum("ij,ij->i", d, d)
    cluster = distance.argmin(1)
    return cluster, distance[np.arange(len(v)), cluster]


def _sums(vectors: DataFrame, centroids: np.ndarray) -> list:
    """For each component i of each cluster with vectors: cluster, i, n (vectors), total."""
    spark, (k, dim) = vectors.sparkSession, centroids.shape
    shared = spark.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for frame in frames:
            if len(frame):
                v = np.stack(frame["v"].to_numpy()).astype(np.int64)
                cluster, _ = nearest(v, shared.value)
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    sums[c] += v[cluster == c].sum(0)
        some = np.flatnonzero(counts)
        if len(some):
            yield pd.DataFrame({"cluster": some, "n": counts[some], "sums": list(sums[some])})

    parts = vectors.select("v").mapInPandas(run, "cluster int, n long, sums array<bigint>")
    numbers = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    total = F.sum(F.col("s").cast("decimal(20,0)"))
    rows = numbers.groupBy("cluster", "i").agg(F.sum("n").alias("n"), total.alias("total")).collect()
    shared.unpersist()
    return rows


def lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of every row of vectors (vec_id, v; read once a round), and the final centroids."""
    centroids = first_centroids(vectors, k)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in _sums(vectors, centroids):
            moved[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():
            break  # no later round would move one
        centroids = moved
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cluster, distance = nearest(np.stack(frame["v"].to_numpy()).astype(np.int64), shared.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

    return vectors.mapInPandas(assign, "vec_id long, cluster int, distance long"), centroids


def clustered(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid (array of long) of every vector."""
    assigned, centroids = lloyd(keep(integer_vectors(table, dim, scale)), k, rounds)
    assigned = keep(assigned)
    summed = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("long").alias("s")).collect()
    of = {r["cluster"]: r["s"] for r in summed}  # k rows at most
    facts = [(c, of[c], sum(of.values()), [int(x) for x in centroids[c]]) for c in sorted(of)]
    schema = "cluster int, cluster_inertia long, inertia long, centroid array<bigint>"
    return assigned.join(F.broadcast(table.sparkSession.createDataFrame(facts, schema)), "cluster")


def op13_centroid_clustering(spark, sf_dir):
    out = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _statement(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """The same in DuckDB: one row for each component, distances by a join on the component."""
    steps = [
        f"""r AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)""",
        f"""v AS MATERIALIZED (SELECT rid, vec_id, i, CAST(floor({scale} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
  FROM r, unnest(range(1, {dim + 1})) AS s(i))""",
        f"""c0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN (SELECT rid, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c
  FROM r QUALIFY c < {k}) USING (rid))""",
    ]
    assigned = """a{0} AS MATERIALIZED (SELECT rid, c, d FROM (SELECT rid, c, CAST(sum((v.x - c{0}.x) * (v.x - c{0}.x)) AS BIGINT) AS d
  FROM v JOIN c{0} USING (i) GROUP BY rid, c) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""
    moved = """c{1} AS MATERIALIZED (SELECT o.c, o.i, CAST(coalesce((s - ((s % n + n) % n)) // n, o.x) AS BIGINT) AS x
  FROM c{0} o LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM a{0} JOIN v USING (rid) GROUP BY c, i) m ON m.c = o.c AND m.i = o.i)"""
    for k_round in range(rounds):
        steps += [assigned.format(k_round), moved.format(k_round, k_round + 1)]
    steps.append(assigned.format(rounds))
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN r USING (rid) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


#: Integer components and exact floors make both engines agree to the last digit.
SQL = {"op13_centroid_clustering": _statement()}

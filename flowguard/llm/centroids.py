"""Centroid clustering of integer vectors by equal-average equal-variance search.

Centroids are sorted by the sum (that is, the mean) of their components. A vector starts at its own mean and looks
outward on both sides. With d components, sums S and deviations A = sqrt(d * sum(v * v) - S * S), every squared
distance D obeys d * D >= (S_x - S_c)^2 + (A_x - A_c)^2. The first term alone ends the search, since it only grows
outward; both together rule out one centroid. What remains is compared by exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowguard.llm.common import stage

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
_FAR = 1 << 40  # stands for "no centroid is left on this side"
_SLACK = 1e-12  # relative; floating point never rules out what integers would not


def largest_component(dimensions: int) -> int:
    """Components stay below this size, so that dimensions * distance fits 64 bits."""
    return (1 << 30) // dimensions


class Codebook:
    """Centroids sorted by mean, searched outward from a vector's own mean."""

    def __init__(self, centroids: np.ndarray):
        total = centroids.sum(1)
        self.number = np.lexsort((np.arange(len(total)), total))
        self.rows, self.total = centroids[self.number], total[self.number]
        self.deviation = _deviation(self.rows, self.total)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid number, squared distance, exact distances worked out) of each row of ``x``."""
        k, d = self.rows.shape
        total = x.sum(1)
        deviation = _deviation(x, total)
        right = np.searchsorted(self.total, total)
        left = right - 1
        best = np.full(len(x), (1 << 62) // d)
        cluster = np.full(len(x), k)
        compared = np.zeros(len(x), dtype=np.int32)
        live = np.arange(len(x))
        while True:
            below, above = left[live], right[live]
            gap_below = np.where(below >= 0, total[live] - self.total[np.maximum(below, 0)], _FAR)
            gap_above = np.where(above < k, self.total[np.minimum(above, k - 1)] - total[live], _FAR)
            down = gap_below <= gap_above
            gap = np.where(down, gap_below, gap_above)
            square = np.where(gap < _FAR, gap, 0) ** 2
            on = (gap < _FAR) & (square <= d * best[live])
            live, down, square, at = live[on], down[on], square[on], np.where(down, below, above)[on]
            if not live.size:
                return cluster.astype(np.int32), best, compared
            left[live[down]] -= 1
            right[live[~down]] += 1
            apart = np.abs(deviation[live] - self.deviation[at]) - _SLACK * (deviation[live] + self.deviation[at])
            bound = square + np.maximum(apart, 0.0) ** 2
            near = bound * (1 - _SLACK) <= d * best[live].astype(np.float64)
            rows, at = live[near], at[near]
            difference = x[rows] - self.rows[at]
            distance = np.einsum("ij,ij->i", difference, difference)
            compared[rows] += 1
            number = self.number[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < cluster[rows]))
            best[rows[better]], cluster[rows[better]] = distance[better], number[better]


def _deviation(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.sqrt((x.shape[1] * np.einsum("ij,ij->i", x, x) - total * total).astype(np.float64))


def _whole(dimensions: int, scale: int):
    """Batches of (vec_id, embedding) to (vec_id, v), v in whole numbers; other vectors are left out."""
    most = largest_component(dimensions)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("embedding")
            right_size = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(listed), dimensions), False)
            batch = batch.filter(right_size)
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(x * scale)
                good = (np.abs(v) < most).all(1)  # false for NaN (which null has become here) and for infinity
            v = v[good].astype(np.int32)
            offsets = np.arange(0, v.size + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.ravel()))], ["vec_id", "v"]
            )

    return rows


def _vectors(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dimensions)


def _sums(book, clusters: int, dimensions: int):
    """Per task: rows and component sums of each centroid's vectors."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(clusters, dtype=np.int64), np.zeros((clusters, dimensions), dtype=np.int64)
        for batch in batches:
            x = _vectors(batch, dimensions)
            cluster, _, _ = book.value.nearest(x)
            count += np.bincount(cluster, minlength=clusters)
            np.add.at(total, cluster, x)
        used = np.flatnonzero(count)
        for c in used.tolist():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([count[c]]), pa.array([total[c].tolist()], pa.list_(pa.int64()))], ["cluster", "n", "sums"]
            )

    return rows


def _assigned(book, dimensions: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, compared = book.value.nearest(_vectors(batch, dimensions))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster), pa.array(distance), pa.array(compared)], ["vec_id", "cluster", "distance", "compared"]
            )

    return rows


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component.

    Vectors of another length are left out, and so are those with a null or non-finite component, or one of
    2**30 / dimensions or more after scaling: distances of such would not fit a long.
    """
    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(_whole(dimensions, scale), "vec_id long, v array<int>")


def _start(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors with the smallest hashes; equal hashes go by their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def _moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Floor of each centroid's component means; those without vectors stay. Only clusters x dimensions sums come back."""
    parts = sums.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    found = parts.groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    moved = centroids.copy()
    for r in found.collect():
        moved[r.cluster, r["at"]] = int(r.total) // int(r.n)
    return moved


def fit_centroids(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Centroids after ``rounds`` of assignment and exact floor means; fewer than ``clusters`` if there are fewer vectors."""
    centroids = _start(vectors, clusters)
    for _ in range(rounds if len(centroids) else 0):
        book = vectors.sparkSession.sparkContext.broadcast(Codebook(centroids))
        sums = vectors.mapInArrow(_sums(book, len(centroids), dimensions), "cluster int, n long, sums array<long>")
        centroids = _moved(centroids, sums)
        book.unpersist()
    return centroids


RESULT = "vec_id long, cluster int, distance long, compared int"


def assign(vectors: DataFrame, centroids: np.ndarray, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, compared) of every vector; compared counts its exact distances."""
    spark: SparkSession = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    return vectors.mapInArrow(_assigned(spark.sparkContext.broadcast(Codebook(centroids)), dimensions), RESULT)


def _long(n: int) -> int | None:
    return n if n < 1 << 63 else None


def cluster_vectors(
    embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """Cluster of every usable vector, with its cluster's and the whole inertia and its centroid's digest.

    See ``whole_vectors`` for what is left out. Repeated rows count as often as they come; a null vec_id hashes as the
    empty text. Inertias beyond a long are null. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    vectors = stage(whole_vectors(embeddings, dimensions, scale), "centroid-vectors")
    centroids = fit_centroids(vectors, clusters, rounds, dimensions)
    found = stage(assign(vectors, centroids, dimensions), "centroid-assigned")
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = _long(sum(inertia.values()))
    facts = [(c, _long(n), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sorted(inertia.items())]
    # one row per centroid: as small as the centroids themselves
    by_cluster = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return found.join(by_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def _round_sql(no: int) -> str:
    return f"""
a{no} AS MATERIALIZED (
  SELECT rid, vec_id, v, cluster, distance FROM (
    SELECT k.rid, k.vec_id, k.v, c.cluster,
           CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance,
           row_number() OVER (PARTITION BY k.rid ORDER BY distance, c.cluster) AS place
    FROM kept k CROSS JOIN c{no} c) WHERE place = 1)"""


def _means_sql(no: int) -> str:
    return f"""
m{no} AS (
  SELECT cluster, list(CASE WHEN s >= 0 OR s % n = 0 THEN s // n ELSE s // n - 1 END ORDER BY pos) AS v FROM (
    SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{no}) GROUP BY cluster, pos) GROUP BY cluster),
c{no + 1} AS MATERIALIZED (SELECT c.cluster, COALESCE(m.v, c.v) AS v FROM c{no} c LEFT JOIN m{no} m USING (cluster))"""


#: Counterpart of the query's contract columns.
CENTROIDS_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         sha256('1:' || COALESCE(CAST(vec_id AS VARCHAR), '')) AS key
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY key, v) - 1 AS INTEGER) AS cluster, v FROM (SELECT key, v FROM kept ORDER BY key, v LIMIT {CLUSTERS})),
{",".join(_round_sql(no) + "," + _means_sql(no) for no in range(ROUNDS))},
{_round_sql(ROUNDS)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
"""

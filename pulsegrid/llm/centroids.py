"""Centroid clustering of integer vectors; Ptolemy's inequality over pivot pairs spares exact distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pulsegrid.session import cut

WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
PIVOTS = 4
LARGEST = 1 << 27  # 64 squared differences of such components still fit a long
SLACK = 1e-12  # above all rounding of a few products of doubles
BLOCK = 2048


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, pair by pair."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(vectors, p[None, :]) for p in pivots], axis=1).astype(np.float64))


def spread_pivots(candidates: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: the first one, then always the farthest from those taken."""
    taken = [0]
    gap = squared(candidates, candidates[:1])
    while len(taken) < most and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(candidates, candidates[taken[-1]][None, :]))
    return candidates[taken]


@dataclass(frozen=True)
class Centres:
    """Centroids with their distances to the pivots, and the pivot pairs."""

    centroids: np.ndarray
    pivots: np.ndarray
    to_pivots: np.ndarray
    pairs: tuple[tuple[int, int, float], ...]

    @classmethod
    def of(cls, centroids: np.ndarray, pivots: np.ndarray) -> Centres:
        between = pivot_distances(pivots, pivots)
        pairs = tuple((i, j, float(between[i, j])) for i, j in combinations(range(len(pivots)), 2))
        return cls(centroids, pivots, pivot_distances(centroids, pivots), pairs)

    def lower_bounds(self, near: np.ndarray) -> np.ndarray:
        """Squared distance that every vector has at least to every centroid.

        ``near`` holds the vectors' distances to the pivots p, s. Ptolemy:
        d(x,c) d(p,s) >= |d(x,p) d(c,s) - d(x,s) d(c,p)|. Each step gives up
        more than its rounding can amount to.
        """
        best = np.zeros((len(near), len(self.centroids)))
        for i, j, apart in self.pairs:
            one = np.outer(near[:, i], self.to_pivots[:, j])
            two = np.outer(near[:, j], self.to_pivots[:, i])
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / apart, out=best)
        return best * best * (1 - SLACK)

    def assign(self, vectors: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: smaller number), exact squared distance, and how many distances were computed."""
        bounds = self.lower_bounds(near)
        first = bounds.argmin(axis=1)
        best = squared(vectors, self.centroids[first])
        # The bound is an integer's lower bound in floats: only a strictly larger one rules a centroid out.
        near_enough = bounds <= best[:, None]
        near_enough[np.arange(len(vectors)), first] = True
        row, centre = np.nonzero(near_enough)
        exact = squared(vectors[row], self.centroids[centre])
        begin = np.searchsorted(row, np.arange(len(vectors)))
        least = np.minimum.reduceat(exact, begin) if len(row) else exact
        hit = exact == least[row]
        cluster = np.full(len(vectors), -1)
        cluster[row[hit][::-1]] = centre[hit][::-1]
        return cluster, least, len(row) + len(vectors)


def kept_vectors(rows: DataFrame, key: str, vector: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(id, v): vectors of ``width`` finite components, each as floor(scale * x).

    Components beyond 2**27 after scaling are an error, since squared
    distances are longs.
    """
    body = F.col(vector)
    fine = F.forall(body, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(body, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(scaled, lambda x: F.abs(x) <= LARGEST)
    checked = F.when(fits, scaled).otherwise(F.raise_error(F.lit("a scaled component is above 2**27")).cast("array<bigint>"))
    return rows.where((F.size(body) == width) & fine).select(F.col(key).alias("id"), checked.cast("array<int>").alias("v"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _matrix(part.column("v"), np.int64), _matrix(part.column("near"), np.float64)


def with_pivots(kept: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``near``, the distances to the pivots, which hold for every round."""

    def run(batches):
        for batch in batches:
            near = pivot_distances(_matrix(batch.column("v"), np.int64), pivots) if batch.num_rows else np.zeros((0, len(pivots)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(list(near), pa.list_(pa.float64()))], names=["id", "v", "near"]
            )

    return kept.mapInArrow(run, StructType([*kept.schema, *StructType.fromDDL("near array<double>")]))


def round_sums(table: DataFrame, centres: Centres) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (number of vectors, sum of every component), after one assignment.

    A task sends one row per cluster, so at most clusters x tasks rows are shuffled.
    """
    k, width = centres.centroids.shape
    shared = table.sparkSession.sparkContext.broadcast(centres)
    names = [f"s{i}" for i in range(width)]

    def run(batches):
        centres = shared.value
        count, sums = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for _, vectors, near in _blocks(batches):
            cluster, _, _ = centres.assign(vectors, near)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += vectors[cluster == c].sum(axis=0)
        used = np.flatnonzero(count)
        columns = [used.astype(np.int32), count[used], *sums[used].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "n", *names])

    parts = table.select("v", "near").mapInArrow(run, "cluster int, n long, " + ", ".join(f"{n} long" for n in names))
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names])
    return {r["cluster"]: (r["n"], [r[n] for n in names]) for r in totals.collect()}


def cluster_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", first: Column | None = None,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    ``first`` orders the vectors whose smallest ``clusters`` are the first
    centroids (default: SHA-256 of ``2:<key>``; equal ones by their
    components, null keys last). A round assigns every vector to its nearest
    centroid and moves non-empty centroids to the floor of the mean; one more
    assignment follows the last round. Vectors of another width or with a null
    or non-finite component are left out; repeated rows are vectors of their
    own; with fewer vectors than clusters there are fewer centroids; an empty
    table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    order = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256) if first is None else first
    kept = kept_vectors(rows, key, vector, width, scale)
    start = kept.orderBy(order.asc_nulls_last(), "v").limit(clusters).collect()
    if not start:
        schema = StructType([
            StructField(key, rows.schema[key].dataType),
            *StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"),
        ])
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in start], dtype=np.int64)
    pivots = spread_pivots(centroids)
    table = cut(with_pivots(kept, pivots))
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, sums) in round_sums(table, Centres.of(centroids, pivots)).items():
            moved[c] = [s // n for s in sums]
        centroids = moved

    shared = spark.sparkContext.broadcast(Centres.of(centroids, pivots))

    def run(batches):
        centres = shared.value
        for part, vectors, near in _blocks(batches):
            cluster, distance, _ = centres.assign(vectors, near)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"]
            )

    assigned = cut(table.mapInArrow(run, StructType([table.schema["id"], *StructType.fromDDL("cluster int, distance long")])))
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame(  # one row per cluster
        [(c, d, total, digests[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def cluster_sql() -> str:
    """The query on ``embeddings`` for a SQL engine, every round written out."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('2:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS}))""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, k.v AS v, min({{'d': list_sum(list_transform(list_zip(k.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c}}) AS m
    FROM (SELECT *, row_number() OVER () AS row FROM kept) AS k CROSS JOIN c{i} GROUP BY row, vec_id, k.v)""")
        if i < ROUNDS:
            # Shifted by a multiple of the count, // floors below zero as well.
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM (
        SELECT m.c AS c, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {WIDTH + 1}) AS r(p) GROUP BY m.c, p) GROUP BY c) AS n ON n.c = c{i}.c)""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia,
    (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.c = m.c"""

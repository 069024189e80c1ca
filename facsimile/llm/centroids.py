"""Centroid clustering in integers, with centroids ruled out by PCA-rotated coordinates.

Vectors become integers, so that sums, centroids and distances are exact and the same for
every partitioning. A rotation by principal axes is fitted on a bounded sample. Each vector
is stored with its leading rotated coordinates and the norm of the rest. The squared
distance of the leading coordinates plus the squared difference of the rest's norms is a
lower bound of the squared distance; centroids whose bound exceeds the best distance known
are skipped, the others are verified in integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import store

LARGEST = 1 << 27  # of an integer component: the squared distance of 64 such differences still fits 64 bits
SLACK = 1e-9  # share of the squared norms by which rounded bounds may be too large; products of a few hundred doubles err by 1e-13
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Rotation:
    """Principal axes of a sample, the first ``leading`` of which are stored."""

    mean: np.ndarray
    axes: np.ndarray
    leading: int

    @classmethod
    def fit(cls, sample: np.ndarray, leading: int) -> Rotation:
        centred = sample - sample.mean(axis=0)
        _, axes = np.linalg.eigh(centred.T @ centred)
        return cls(sample.mean(axis=0), axes[:, ::-1], leading)

    def coordinates(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the others."""
        turned = (vectors - self.mean) @ self.axes
        return turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(axis=1))


def nearest(
    vectors: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation
) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, ties to the smaller number, and how many distances were computed."""
    centre_lead, centre_rest = rotation.coordinates(centroids)
    squares = (lead**2).sum(axis=1) + rest**2
    centre_squares = (centre_lead**2).sum(axis=1) + centre_rest**2
    bound = (lead**2).sum(axis=1)[:, None] - 2 * (lead @ centre_lead.T) + (centre_lead**2).sum(axis=1) + (rest[:, None] - centre_rest) ** 2
    bound -= SLACK * (squares[:, None] + centre_squares) + 1e-3

    def distance(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        apart = vectors[rows] - centroids[centre]
        return np.einsum("ij,ij->i", apart, apart)

    cluster = bound.argmin(axis=1)
    first, best = cluster.copy(), distance(np.arange(len(vectors)), cluster)
    verified = len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        d = distance(rows, np.full(len(rows), c))
        closer = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[closer]], cluster[rows[closer]] = d[closer], c
        verified += len(rows)
    return cluster, best, verified


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _slices(batches):
    for batch in batches:
        for i in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


class Clusters:
    """Vectors stored with their rotated coordinates, and the centroids so far."""

    def __init__(self, stored: DataFrame, centroids: np.ndarray, rotation: Rotation, dims: int) -> None:
        self.stored, self.centroids, self.rotation, self.dims = stored, centroids, rotation, dims

    def _assign(self):
        centroids, rotation, dims = self.centroids, self.rotation, self.dims

        def assign(batch):
            vectors = _matrix(batch.column("vector"), dims, np.int64)
            lead = _matrix(batch.column("lead"), rotation.leading, np.float64)
            return vectors, *nearest(vectors, lead, batch.column("rest").to_numpy(), centroids, rotation)[:2]

        return assign

    def step(self) -> bool:
        """Replace every centroid that has vectors by the floor of their mean; whether one has moved. A task sends its sums, a row per cluster."""
        assign, k, dims = self._assign(), len(self.centroids), self.dims

        def emit(batches):
            sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
            for batch in _slices(batches):
                vectors, cluster, _ = assign(batch)
                counts += np.bincount(cluster, minlength=k)
                for c in range(k):
                    sums[c] += vectors[cluster == c].sum(axis=0)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
            )

        parts = self.stored.select("vector", "lead", "rest").mapInArrow(emit, "cluster int, n long, sums array<long>")
        places = parts.select("cluster", "n", F.posexplode("sums").alias("place", "value"))
        whole = places.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
        moved = self.centroids.copy()
        for r in whole.collect():  # a number per centroid and component
            moved[r.cluster, r.place] = int(r.total) // r.n
        same = np.array_equal(moved, self.centroids)
        self.centroids = moved
        return not same

    def assigned(self) -> DataFrame:
        """(row, cluster, distance) of every vector."""
        assign = self._assign()

        def emit(batches):
            for batch in _slices(batches):
                _, cluster, distance = assign(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["row", "cluster", "distance"]
                )

        kind = self.stored.schema["row"].dataType.simpleString()
        return self.stored.mapInArrow(emit, f"row {kind}, cluster int, distance long")

    def labelled(self) -> DataFrame:
        """(row, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
        found, k = self.assigned(), len(self.centroids)
        totals = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("total")).collect()}  # a row per cluster
        whole = None if None in totals.values() or sum(totals.values()) >= 1 << 63 else sum(totals.values())
        facts = [F.struct(F.lit(totals.get(c)).cast("long").alias("inertia"), F.lit(centroid_digest(self.centroids[c])).alias("digest")) for c in range(k)]
        own = F.array(*facts)[F.col("cluster")]
        return found.select(
            "row", "cluster", "distance", own["inertia"].alias("cluster_inertia"),
            F.lit(whole).cast("long").alias("inertia"), own["digest"].alias("centroid_sha256"),
        )


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(row, name, vector): rows whose vector has ``dims`` finite components, as integers; ``name`` is the id as text, empty for null."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    edge = float(LARGEST)
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(edge)), F.lit(-edge))).cast("int"))
    return table.filter((F.size(vector) == dims) & ~bad).select(
        F.struct(*[F.col(f"`{c}`") for c in table.columns if c != vector_col]).alias("row"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        whole.alias("vector"),
    )


def fit_centroids(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    dims: int = 64,
    scale: int = 1024,
    leading: int = 16,
    sample: int = 4096,
) -> Clusters | None:
    """Centroids after ``rounds`` rounds and the kept vectors; ``labelled`` tells each its cluster. No kept vector: None.

    Vectors of other lengths, null ones and those with a null or non-finite component are
    left out; components beyond 2^27 / ``scale`` count as that bound, so that distances
    of up to 128 components fit 64 bits. The first centroids are the ``k`` vectors of the
    smallest SHA-256 of seed and id (equal ids: the smaller vector first; fewer vectors:
    fewer clusters). Repeated rows are vectors each, a null id is an empty one, a tie goes
    to the smaller number, a cluster without vectors keeps its centroid. Sums of distances
    that exceed 64 bits are null. Other columns, whatever their names, come back in ``row``.

    ``sample`` bounds the different vectors that fit the rotation (about as many, chosen
    by hash); it affects how many distances are computed, never the result.
    """
    kept = integer_vectors(table, id_col, vector_col, dims, scale)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("name")).cast("binary"), 256)
    seeds = kept.select("vector", rank.alias("rank")).orderBy("rank", "vector").limit(k).collect()  # k rows
    if not seeds:
        return None
    share = min(1.0, sample / kept.count())
    uniform = F.shiftrightunsigned(F.xxhash64("vector"), 11) / F.lit(float(1 << 53))
    some = kept.filter(uniform < share).select("vector").distinct().collect()  # about ``sample`` rows
    points = np.array([r.vector for r in some] or [r.vector for r in seeds], np.float64)
    rotation = Rotation.fit(points, min(leading, dims))

    def rotate(batches):
        for batch in _slices(batches):
            lead, rest = rotation.coordinates(_matrix(batch.column("vector"), dims, np.float64))
            until = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * rotation.leading)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vector"), pa.ListArray.from_arrays(until, pa.array(lead.reshape(-1))), pa.array(rest)],
                names=["row", "vector", "lead", "rest"],
            )

    kind = kept.schema["row"].dataType.simpleString()
    turned = kept.select("row", "vector").mapInArrow(rotate, f"row {kind}, vector array<int>, lead array<double>, rest double")
    clusters = Clusters(store(turned, "rotated"), np.array([r.vector for r in seeds], np.int64), rotation, dims)
    for _ in range(rounds):
        if not clusters.step():  # the rounds left would change nothing either
            break
    return clusters

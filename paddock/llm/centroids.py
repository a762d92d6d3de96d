"""Centroid clustering of embeddings on integers, with centroids filtered by n-simplex projection.

Components become integers floor(256 x). A few pivots are chosen among the first centroids, the farthest from the
simplex of those before it each time. The distances of a vector to the pivots, computed once and stored as the coordinates of
the apex of a simplex over them, bound its distance to every centroid: the distance of two apexes is a lower bound, the one with the last coordinate
mirrored an upper bound. Only centroids whose lower bound does not exceed the least upper bound (with a margin for rounding)
are compared, by exact integer distances. A round is one pass over the stored table; tasks add up the
vectors of each cluster, and one row for each centroid comes to the driver.

Rows: vectors that are null, have not `components` components, or null or non-finite ones, give no row. Every other row is a
vector of its own, repeated ids and rows as well. A null id stands last among the hashes that choose the first centroids; equal hashes are
ordered by the integers. With fewer than `k` vectors there are as many centroids. Ties go to the smaller number;
equal centroids leave the later one empty, and an empty one stays as it is. An empty table gives no rows; other columns are ignored.
Distances must fit into 64 bits: a component of 2^19 or more (integers of 2^27) raises an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import saved

#: clusters, rounds, components and integer steps of one unit
CLUSTERS, ROUNDS, COMPONENTS, STEPS = 40, 5, 64, 256
#: pivots, at most; one closer than this share of the widest to the span of the others is left out
PIVOTS, FLAT = 16, 0.05
#: rows that are compared at once, and largest integer component
ROWS, LARGEST = 1_000, 2**27


class Simplex:
    """Pivots and the triangular coordinates of the simplex that they span."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS) -> None:
        """Pivots out of `points` (integers, one a row): the first, then the one with the greatest height over those chosen."""
        self.pivots = points[:1]
        self.base = np.zeros((1, 0))
        widest = 0.0
        while len(points) and len(self.pivots) < most:
            apex = self.apexes(points)
            k = int(apex[:, -1].argmax())
            widest = max(widest, apex[k, -1])
            if apex[k, -1] <= FLAT * widest:
                break
            self.base = np.vstack([np.hstack([self.base, np.zeros((len(self.base), 1))]), apex[k]])
            self.pivots = np.vstack([self.pivots, points[k]])

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Apex coordinates: solved from the squared distances to the pivots; the last one is the height."""
        squares = np.stack([((x - p) ** 2).sum(1) for p in self.pivots], 1).astype(np.float64)
        corners = self.base[1:]
        right = (squares[:, :1] + (corners**2).sum(1) - squares[:, 1:]) / 2
        flat = np.linalg.solve(corners, right.T).T if len(corners) else right
        height = np.sqrt(np.maximum(squares[:, 0] - (flat**2).sum(1), 0))
        return np.hstack([flat, height[:, None]])


def bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of all distances between two lists of apexes, widened for rounding."""
    size = (x**2).sum(1)[:, None] + (y**2).sum(1)[None]
    flat = (x[:, :-1] ** 2).sum(1)[:, None] + (y[:, :-1] ** 2).sum(1)[None] - 2 * x[:, :-1] @ y[:, :-1].T
    margin = 1e-7 * size + 1e-3
    return flat + (x[:, -1:] - y[:, -1]) ** 2 - margin, flat + (x[:, -1:] + y[:, -1]) ** 2 + margin


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones) and exact squared distance of each row."""
    cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        part = slice(at, at + ROWS)
        low, high = bounds(apexes[part], corners)
        row, number = np.nonzero(low <= high.min(1)[:, None])  # by row, then number; the least upper bound's own is among them
        exact = ((x[part][row] - centroids[number]) ** 2).sum(1)
        first = np.searchsorted(row, np.arange(len(low)))
        least = np.minimum.reduceat(exact, first)
        found = np.flatnonzero(exact == least[row])
        found = found[np.searchsorted(row[found], np.arange(len(low)))]
        cluster[part], distance[part] = number[found], least
    return cluster, distance


def integers(column: pa.Array, components: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), components)
    out = np.floor(values * STEPS)
    if len(out) and np.abs(out).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // STEPS}: distances would not fit into 64 bits")
    return out.astype(np.int64)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def clusters(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, salt: str = "2:",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = rows.where((F.size("vector") == components) & F.forall("vector", finite))
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    steps = F.transform("vector", lambda x: F.floor(x * STEPS))
    chosen = kept.orderBy(hashed.asc_nulls_last(), steps).limit(k).select("vector").toArrow()["vector"].combine_chunks()
    centroids = integers(chosen, components)
    simplex = Simplex(centroids)
    width = len(simplex.pivots)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column("vector"), components)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _blobs(x.astype("<i4")), _blobs(simplex.apexes(x))], names=["vec_id", "x", "apex"])

    points = saved(kept.mapInArrow(prepared, "vec_id long, x binary, apex binary"), "points")

    def assigned(batch: pa.RecordBatch, centroids: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = _matrix(batch.column("x"), "<i4", components).astype(np.int64)
        return x, *nearest(x, _matrix(batch.column("apex"), np.float64, width), centroids, corners)

    def moved(centroids: np.ndarray) -> np.ndarray:
        """Centroids after one round: exact sums by task, added in Spark."""
        corners = simplex.apexes(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((len(centroids), components), np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                x, cluster, _ = assigned(batch, centroids, corners)
                np.add.at(total, cluster, x)
                n += np.bincount(cluster, minlength=len(n))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

        wide = lambda c: F.sum(c.cast("decimal(38,0)"))
        parts = points.mapInArrow(sums, "cluster long, n long, total array<long>")
        # one row for each of the k centroids
        found = parts.groupBy("cluster").agg(wide(F.col("n")).alias("n"), F.array(*[wide(F.col("total")[i]) for i in range(components)]).alias("total")).collect()
        after = centroids.copy()
        for r in found:
            after[r["cluster"]] = [int(t) // int(r["n"]) for t in r["total"]]
        return after

    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(centroids)
    corners = simplex.apexes(centroids) if len(centroids) else centroids

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, distance = assigned(batch, centroids, corners)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    result = saved(points.mapInArrow(placed, "vec_id long, cluster int, distance long"), "clusters")
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    # one row for each of the k centroids
    spread = {r["cluster"]: int(r["sum"]) for r in result.groupBy("cluster").agg(wide.alias("sum")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = spark.createDataFrame(
        [(c, n, sum(spread.values()), digest[c]) for c, n in sorted(spread.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return result.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS) -> str:
    """DuckDB's version: all distances of every round."""
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor({STEPS} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c FROM kept QUALIFY cluster < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT row_no, vec_id, v, cluster, c, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept, c{i}),
        a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT cluster, pos, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({components})) AS pos FROM a{i}) GROUP BY ALL),
            m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{i} GROUP BY cluster),
            c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    last = f"a{rounds}"
    return f"""WITH {', '.join(parts)}
    SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last}"""


SQL = _sql()

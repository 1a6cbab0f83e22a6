"""Centroid clustering by an equal-average equal-variance search.

Vectors become integers. A vector x with mean m and deviation s (the norm of x less m in every component) is no nearer
to a centroid with mean m' and deviation s' than

    distance^2 >= D (m - m')^2 + (s - s')^2.

Centroids are sorted by mean; for each vector the search goes outward from its own mean, on either side, until the
means alone are further apart than the best distance found; of those passed, centroids whose deviation is too far off
are not measured. Both tests leave room for rounding and for ties; what is measured is measured in integers, and among
equal distances the smaller number wins, so the result is that of an exhaustive search.

Assigning is a scan; a round sends a sum of each component of each cluster from every task, added exactly by an
aggregation on (cluster, component), so clusters of any size are no burden. The driver holds the centroids only.

Defined cases: vectors that are null, of another length, or hold null or non-finite entries are left out; fewer vectors
than clusters give fewer centroids; vectors of equal vec_id start in the order of their components, those of null
vec_id last; an empty cluster keeps its centroid and has no inertia; entries beyond 2 ** 62 / 64 are taken as that;
distances and inertias that no long holds are null; repeated rows are vectors of their own; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, scratch
from .exact_sums import NAMES, joined, schema, small, split, summed
from .whitening import rows_of, usable, whole

CLUSTERS, DIMENSIONS, ROUNDS, SEED = 16, 64, 3, 1
#: The largest component whose squared differences 64 bits can add up over a vector, for 2 ** 10 dimensions.
FITS = 1 << 25
#: Room for rounding in the tests that leave centroids out.
ROOM = 1e-9


class Search:
    """The nearest of some centroids, for many vectors at once."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.small = not self.centroids.size or int(np.abs(self.centroids).max()) <= FITS
        self.sums = self.centroids.sum(1) if len(centroids) else np.zeros(0, object)
        mean = self.sums.astype(np.float64) / max(1, self.centroids.shape[1])
        self.order = np.argsort(mean, kind="stable")
        self.mean = mean[self.order]
        self.deviation = np.sqrt(((self.centroids.astype(np.float64) - mean[:, None]) ** 2).sum(1))[self.order]
        self.ranked = self.centroids[self.order].astype(np.int64 if self.small else object)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the number of its nearest centroid and the squared distance; counts what was measured."""
        x = small(x, FITS) if self.small else x.astype(object)
        n, d = x.shape
        k, ranked = len(self.order), self.ranked if x.dtype != object else self.ranked.astype(object)
        plain = x.astype(np.float64)
        mean = plain.sum(1) / d
        deviation = np.sqrt(((plain - mean[:, None]) ** 2).sum(1))
        start = np.clip(np.searchsorted(self.mean, mean), 0, k - 1)
        best, number = self.distances(x, ranked[start]), self.order[start]
        self.measured = n
        for side in (-1, 1):
            rows = np.arange(n)
            for step in range(1, k):
                at = start[rows] + side * step
                rows, at = rows[(at >= 0) & (at < k)], at[(at >= 0) & (at < k)]
                most = best[rows].astype(np.float64) * (1 + ROOM) + ROOM
                far = d * (mean[rows] - self.mean[at]) ** 2
                on = far * (1 - ROOM) <= most + ROOM * d * mean[rows] ** 2  # the centroids beyond have means as far at least
                rows, at, far, most = rows[on], at[on], far[on], most[on]
                if not len(rows):
                    break
                like = (far + (deviation[rows] - self.deviation[at]) ** 2) * (1 - ROOM) <= most + ROOM * (d * mean[rows] ** 2 + deviation[rows] ** 2)
                some, which = rows[like], at[like]
                self.measured += len(some)
                distance, named = self.distances(x[some], ranked[which]), self.order[which]
                better = (distance < best[some]) | ((distance == best[some]) & (named < number[some]))
                best[some[better]], number[some[better]] = distance[better], named[better]
        return number, best

    @staticmethod
    def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        off = x - c
        return np.einsum("ij,ij->i", off, off) if off.dtype != object else (off * off).sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    return next((x for _, _, x in rows_of(column)), np.zeros((0, DIMENSIONS), np.int64))


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance for vectors(vec_id, x), and the distance's limbs."""
    search = Search(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                number, best = search.nearest(_matrix(b["x"]))
                found = best.tolist()
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(number, pa.int32()), pa.array([v if v < 1 << 63 else None for v in found], pa.int64()), *(pa.array(v, pa.int64()) for v in split(found))], names=["vec_id", "cluster", "distance", *NAMES])

    return vectors.mapInArrow(run, schema(f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: each component the floor of its mean; those without vectors as they were."""
    search = Search(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b["x"])
            number, _ = search.nearest(x)
            x = small(x, 1 << 40)
            for c in np.unique(number):
                own = x[number == c]
                found[c] = found.get(c, 0) + np.array([len(own), *own.sum(0).tolist()], object)
        for c, got in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(got), pa.int32()), pa.array(range(len(got)), pa.int32()), *(pa.array(v, pa.int64()) for v in split(got.tolist()))], names=["cluster", "at", *NAMES])

    rows = summed(vectors.mapInArrow(run, schema("cluster int, at int")), "cluster", "at").collect()  # clusters times dimensions
    found = {(r["cluster"], r["at"]): joined(r) for r in rows}
    return [[found[i, d + 1] // found[i, 0] for d in range(len(c))] if (i, 0) in found else c for i, c in enumerate(centroids)]


def clustered(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED, vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for table(vec_id, vector)."""
    usable_rows = table.where(usable(F.col(vector)) & (F.size(vector) == dimensions))
    with scratch(table.sparkSession) as keep:
        vectors = materialize(usable_rows.select("vec_id", whole(F.col(vector), offset=0).alias("x")), "vectors")
        first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        centroids = [list(r["x"]) for r in vectors.orderBy(first.asc_nulls_last(), "x").limit(clusters).select("x").collect()]
        for _ in range(rounds if centroids else 0):
            centroids = moved(vectors, centroids)
        found = keep(materialize(assigned(vectors, centroids), "assigned"))
        sums = {r["cluster"]: joined(r) for r in summed(found, "cluster").collect()}
    whole_sum = sum(sums.values())
    rows = [(c, s if s < 1 << 63 else None, whole_sum if whole_sum < 1 << 63 else None, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    facts = table.sparkSession.createDataFrame(rows, "_of int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("_of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_equal_average_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings"))


def sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> str:
    """The same by exhaustive search, for an engine with list functions; each round is a step of its own."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT {clusters}))""",
    ]
    near = "SELECT r, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.r, v.vec_id, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {k} k) GROUP BY r"
    for i in range(1, rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(k=f'c{i - 1}')})")
        total = "sum(v.x[s.i])::HUGEINT"
        floor = f"(({total} - ((({total} % count(*)) + count(*)) % count(*))) // count(*))::BIGINT"
        steps.append(f"m{i} AS MATERIALIZED (SELECT c, list(y ORDER BY i) AS x FROM (SELECT a.c, s.i, {floor} AS y FROM a{i} a JOIN v USING (r), range(1, {dimensions + 1}) s(i) GROUP BY a.c, s.i) GROUP BY c)")
        steps.append(f"c{i} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i - 1} k LEFT JOIN m{i} m USING (c))")
    steps.append(f"f AS MATERIALIZED ({near.format(k=f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
    SELECT f.vec_id, f.c::INTEGER AS cluster, f.d::BIGINT AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(list_transform(k.x, lambda y: y::VARCHAR), ',')) AS centroid_sha256
    FROM f JOIN c{rounds} k USING (c)"""


OP13_SQL = sql()

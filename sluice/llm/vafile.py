"""Centroid clustering over a vector-approximation file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_map, near_rows, stage

# vectors that the cell edges are taken from; they decide how many vectors are fetched, never a result
FIT_ROWS = 4096
STEP_ROWS = 8192


def component_limit(dims: int) -> int:
    """Largest component whose squared distances over ``dims`` components surely fit a long."""
    return isqrt((1 << 62) // max(1, dims)) // 2


def integer_vector(column: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) per component; null unless there are ``dims`` components, all finite."""
    values, limit = column.cast("array<double>"), component_limit(dims)
    whole = F.transform(values, lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(limit))), F.lit(float(-limit)))).cast("int"))
    finite = F.forall(values, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when((F.size(values) == dims) & finite, whole)


class Cells:
    """Cell edges of each dimension, and the packing of cell numbers into ``bits`` bits each."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> None:
        self.bits, self.count, self.dims = bits, 1 << bits, len(low)
        inner = np.quantile(sample, np.arange(1, self.count) / self.count, axis=0, method="nearest").astype(np.int64)
        # a cell holds its lower edge and all below the next one
        self.edges = inner.T.copy()
        self.low = np.concatenate([low[:, None], self.edges], axis=1)
        self.high = np.concatenate([self.edges - 1, high[:, None]], axis=1)
        self.shift = np.arange(self.dims) * self.count

    def pack(self, vectors: np.ndarray) -> np.ndarray:
        cells = np.stack([np.searchsorted(self.edges[d], vectors[:, d], side="right") for d in range(self.dims)], axis=1)
        spread = (cells[:, :, None] >> np.arange(self.bits)) & 1
        return np.packbits(spread.astype(np.uint8).reshape(len(vectors), -1), axis=1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        spread = np.unpackbits(packed, axis=1, count=self.dims * self.bits).reshape(len(packed), self.dims, self.bits)
        return (spread.astype(np.int64) << np.arange(self.bits)).sum(axis=2)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per centroid the least and greatest squared difference to each cell of each dimension, flat by dimension."""
        point = centroids[:, :, None]
        below, above = self.low[None] - point, point - self.high[None]
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(below ** 2, above ** 2)
        return least.reshape(len(centroids), -1), most.reshape(len(centroids), -1)

    def candidates(self, packed: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Row by centroid: can this centroid be the nearest, judged by the distance intervals of the cells alone?"""
        at = self.unpack(packed) + self.shift
        lower = np.stack([t[at].sum(axis=1) for t in tables[0]], axis=1)
        upper = np.stack([t[at].sum(axis=1) for t in tables[1]], axis=1)
        return lower <= upper.min(axis=1)[:, None]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _packed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(lo, STEP_ROWS)


def _nearest(vectors: np.ndarray, centroids: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest allowed centroid by exact integer distance (ties: smaller number), and that distance."""
    far = (vectors ** 2).sum(axis=1)[:, None] - 2 * (vectors @ centroids.T) + (centroids ** 2).sum(axis=1)
    far = np.where(allowed, far, np.iinfo(np.int64).max)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


STATE = pa.schema([("row", pa.int64()), ("cells", pa.binary()), ("cluster", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])
STATE_DDL = "row long, cells binary, cluster int, sums array<long>, n long"


def _with_sums(part: pa.RecordBatch, best: np.ndarray, before: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows with their cluster, then a row per cluster with what this step adds to its components and its count."""
    yield pa.RecordBatch.from_arrays(
        [part.column(0), part.column(1), pa.array(best, pa.int32()), pa.nulls(len(best), STATE.field(3).type), pa.nulls(len(best), pa.int64())],
        schema=STATE)
    moved = best != before
    sums, counts = np.zeros((k, vectors.shape[1]), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for index, sign in ((best[moved], 1), (before[moved], -1)):
        known = index >= 0
        np.add.at(sums, index[known], sign * vectors[moved][known])
        np.add.at(counts, index[known], sign)
    used = np.flatnonzero(sums.any(axis=1) | (counts != 0))
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()),
         pa.array(list(sums[used]), STATE.field(3).type), pa.array(counts[used], pa.int64())], schema=STATE)


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3, bits: int = 5, scale: int = 64,
) -> DataFrame:
    """Lloyd's rounds on integer vectors, assigned by a VA-file: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors have ``dims`` finite components, others are left out; a component becomes floor(scale * x), held within
    :func:`component_limit` so that distances fit a long. The first centroids are the ``k`` vectors with the smallest sha256 of ``1:<id>``.

    Method: each vector is compressed to ``bits`` bits a dimension (cells between quantiles of ``FIT_ROWS`` vectors). Lookup
    tables give each centroid's distance interval from the cells alone. Only where intervals overlap, or the cluster has changed, is
    the full vector fetched: by a join on row numbers, after a sift in the scan. Sums of components change by the moved vectors alone,
    so rounds after the first read the narrow cells. First and last round read vectors and cells side by side without a join, as they need every
    vector for the sums and the distances; cells still decide which centroids are computed.

    The driver holds k centroids, their sums and the cell edges. All arithmetic is on integers, so the result does not depend on partitions or cells.
    Rows with a null id are clustered but never a first centroid; repeated rows are clustered each, and two rows
    of one id can both be first centroids (of one id the smaller vector first). Ties go to the smaller cluster number. With fewer than k
    vectors there are fewer clusters; without any vector that has an id, cluster and all after it are null; an empty table gives no rows. Sums
    of distances beyond a long are null. Other columns are not read.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).alias("vec_id"), integer_vector(F.col(vec_col), dims, scale).alias("vec")).where("vec IS NOT NULL")
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.where("vec_id IS NOT NULL").select(hashed.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    if not first:
        return kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), *(
            F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit(None).cast("string").alias("centroid_sha256"))
    centroids = np.array([r.vec for r in first], dtype=np.int64)
    k = len(centroids)

    sample = np.array([r.vec for r in kept.orderBy(F.xxhash64("vec_id", "vec")).limit(FIT_ROWS).collect()], dtype=np.int64)
    ends = kept.agg(*(F.min(F.col("vec")[d]) for d in range(dims)), *(F.max(F.col("vec")[d]) for d in range(dims))).first()
    cells = Cells(sample, np.array(ends[:dims], dtype=np.int64), np.array(ends[dims:], dtype=np.int64), bits)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            packed = pa.array([r.tobytes() for r in cells.pack(_matrix(part.column(2), np.int64))], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, packed], names=["row", "vec_id", "vec", "cells"])

    numbered = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")
    file = stage(arrow_map(numbered, compress, f"row long, vec_id {dict(kept.dtypes)['vec_id']}, vec array<int>, cells binary"), "vectors")

    def assign(now: np.ndarray):
        """(row, cells, before, vec) to rows with their cluster and to sums."""
        tables = cells.tables(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _steps(batches):
                vectors = _matrix(part.column(3), np.int64)
                best, _ = _nearest(vectors, now, cells.candidates(_packed(part.column(1)), tables))
                yield from _with_sums(part, best, part.column(2).to_numpy(zero_copy_only=False), vectors, len(now))

        return run

    def settle(now: np.ndarray):
        """(row, cells, cluster) and the one centroid that the cells leave, -1 where intervals overlap."""
        tables = cells.tables(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _steps(batches):
                may = cells.candidates(_packed(part.column(1)), tables)
                sole = np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sole, pa.int32())], names=["row", "cells", "cluster", "sole"])

        return run

    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    state = None
    for _ in range(rounds):
        if state is None:
            changed = stage(arrow_map(file.select("row", "cells", F.lit(-1).alias("before"), "vec"), assign(centroids), STATE_DDL), "assigned")
            state = changed.where("row IS NOT NULL").select("row", "cells", "cluster")
        else:
            scanned = stage(arrow_map(state, settle(centroids), "row long, cells binary, cluster int, sole int"), "scanned")
            wanted = scanned.where("sole <> cluster").select("row", "cells", F.col("cluster").alias("before"))
            fetched = wanted.join(near_rows(file.select("row", "vec"), "row", wanted, "row"), "row")
            changed = stage(arrow_map(fetched.select("row", "cells", "before", "vec"), assign(centroids), STATE_DDL), "assigned")
            state = scanned.where("sole = cluster").select("row", "cells", "cluster").unionByName(
                changed.where("row IS NOT NULL").select("row", "cells", "cluster"))
        added = changed.where("row IS NULL").groupBy("cluster").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"d{d}") for d in range(dims))).collect()
        for r in added:
            counts[r.cluster] += r.n
            sums[r.cluster] = [a + r[f"d{d}"] for d, a in enumerate(sums[r.cluster])]
        centroids = np.array([[s // counts[i] for s in sums[i]] if counts[i] else centroids[i] for i in range(k)], dtype=np.int64)

    last, tables = centroids, cells.tables(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _steps(batches):
            best, far = _nearest(_matrix(part.column(2), np.int64), last, cells.candidates(_packed(part.column(1)), tables))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = stage(arrow_map(file.select("vec_id", "cells", "vec"), measure, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long"), "clusters")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    total = each.agg(F.sum("own").alias("total"))
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    # a row per centroid
    about = each.crossJoin(F.broadcast(total)).join(F.broadcast(digests), "cluster")
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(own AS long)").alias("cluster_inertia"), F.expr("try_cast(total AS long)").alias("inertia"),
        "centroid_sha256")


def fetched_share(rows: DataFrame, centroids: np.ndarray, vec_col: str = "embedding", dims: int = 64, bits: int = 5, scale: int = 64) -> float:
    """Share of vectors whose distance intervals overlap for the given centroids: what a round has to fetch at most."""
    vectors = rows.select(integer_vector(F.col(vec_col), dims, scale).alias("vec")).where("vec IS NOT NULL")
    sample = np.array([r.vec for r in vectors.orderBy(F.xxhash64("vec")).limit(FIT_ROWS).collect()], dtype=np.int64)
    cells = Cells(sample, sample.min(axis=0), sample.max(axis=0), bits)
    return float((cells.candidates(cells.pack(sample), cells.tables(centroids)).sum(axis=1) > 1).mean())


def oracle() -> str:
    """The whole computation as SQL, a round per group of table expressions."""
    lines = ["""WITH kept AS MATERIALIZED (
  SELECT vec_id, [TRY_CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec,
    sha256('1:' || CAST(vec_id AS VARCHAR)) AS h
  FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), flat AS MATERIALIZED (
  SELECT vec_id, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT n - 1 AS cluster, generate_subscripts(vec, 1) AS d, unnest(vec) AS x
  FROM (SELECT vec, row_number() OVER (ORDER BY h) AS n FROM kept) WHERE n <= 16
)"""]
    for i in range(4):
        lines.append(f""", a{i} AS MATERIALIZED (
  SELECT vec_id, min_by(cluster, far * 16 + cluster) AS cluster, min(far) AS distance
  FROM (SELECT f.vec_id, c.cluster, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS far
        FROM flat f JOIN c{i} c ON f.d = c.d GROUP BY ALL) GROUP BY vec_id
)""")
        if i < 3:
            lines.append(f""", c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x
  FROM c{i} c LEFT JOIN (SELECT a.cluster, f.d, CAST(sum(f.x) AS BIGINT) AS s, count(*) AS n
                         FROM a{i} a JOIN flat f ON f.vec_id = a.vec_id GROUP BY ALL) m
    ON m.cluster = c.cluster AND m.d = c.d
)""")
    lines.append("""
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, s.centroid_sha256
FROM a3 a JOIN (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY cluster) s
  ON s.cluster = a.cluster""")
    return "".join(lines)

"""Centroid clustering with heap-ordered bounds: Lloyd's rounds, exact to the last integer.

Vectors lie in blocks. A block keeps, for each cluster, a heap of its vectors by the gap between
the distance to the second-nearest centroid (lower bound) and to their own (upper bound), offset
by the drift that the cluster had accumulated when the gap was taken. A round moves centroids and
adds to the drifts; only vectors whose gap has been used up come off the heaps and are measured
again. Blocks and their heaps are two tables bucketed alike, so a round joins them without a
shuffle and writes only heaps. Per round the driver sees one sum for each cluster and component.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, groups, shared_dir, sliced, table, written

#: Vectors in a block on average, blocks in a bucket at most, and the largest integer component.
BLOCK, BUCKET_BLOCKS, LARGEST = 1_024, 256, 1 << 27
#: Shares of a distance and of a drift by which rounding may err; far above what doubles do.
SLACK = 1e-12

_STATE = "block long, cluster binary, heap_sizes array<int>, gaps binary, members binary, sums binary"


def _integers(dimensions: int, scale: int):
    """Rows (id, floor(scale * component) as 32-bit integers, n) of valid vectors; equal rows of a batch are one."""

    def integers(batches):
        for batch in sliced(batches):
            ids, vectors = batch.column(0), batch.column(1)
            right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False)
            ids, flat = ids.filter(right), vectors.filter(right).flatten()
            empty = flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            good = np.isfinite(values).all(axis=1) & ~empty.reshape(-1, dimensions).any(axis=1)
            whole = np.floor(values[good] * scale)
            if len(whole) and np.abs(whole).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST / scale:g}: their distances do not fit in 64 bits")
            seen: dict[tuple, int] = {}
            for key in zip(ids.filter(pa.array(good)).to_pylist(), map(bytes, whole.astype("<i4")), strict=True):
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int64()), pa.array([k[1] for k in seen], pa.binary()), pa.array(seen.values(), pa.int64())],
                names=["id", "vector", "n"],
            )

    return integers


def _blocks(batches):
    """Sorted rows as one row for each block; equal rows of a block are one."""
    for (block,), rows in groups(batches, ["block"]):
        seen: dict[tuple, int] = {}
        for i, v, n in zip(*(rows.column(c).to_pylist() for c in ("id", "vector", "n")), strict=True):
            seen[i, v] = seen.get((i, v), 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([[k[0] for k in seen]], pa.list_(pa.int64())), pa.array([list(seen.values())], pa.list_(pa.int64())), pa.array([b"".join(k[1] for k in seen)], pa.binary())],
            names=["block", "ids", "counts", "vectors"],
        )


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers: a row for each vector, a column for each centroid."""
    return np.stack([np.square(vectors - c).sum(axis=1) for c in centroids], axis=1)


def _gaps(squared: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance to the second-nearest centroid less that to the own one, rounded to the safe side."""
    near = np.sqrt(squared[np.arange(len(own)), own].astype(float))
    if squared.shape[1] == 1:
        return np.full(len(own), np.inf)
    rest = squared.copy()
    rest[np.arange(len(own)), own] = np.iinfo(np.int64).max
    second = np.sqrt(rest.min(axis=1).astype(float))
    return second - near - SLACK * (second + near)


class Heaps:
    """The clusters of a block's vectors, and for each cluster a heap of (gap + drift when taken, vector)."""

    def __init__(self, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.cluster, self.heaps = cluster, heaps

    @classmethod
    def new(cls, vectors: np.ndarray, centroids: np.ndarray) -> Heaps:
        squared = _distances(vectors, centroids)
        cluster = squared.argmin(axis=1)  # the smaller number where two are as near
        gaps = _gaps(squared, cluster)
        heaps = []
        for c in range(len(centroids)):
            members = np.flatnonzero(cluster == c)
            heaps.append(list(zip(gaps[members].tolist(), members.tolist(), strict=True)))
            heapq.heapify(heaps[-1])
        return cls(cluster, heaps)

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Takes the vectors off their heaps whose gap the drift has used up."""
        out = []
        for heap, moved in zip(self.heaps, drift.tolist(), strict=True):
            limit = moved * (1 + SLACK) + SLACK
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def settle(self, vectors: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Measures expired vectors again and puts them on their heaps; returns those measured."""
        popped = self.expired(drift)
        if len(popped):
            squared = _distances(vectors[popped], centroids)
            own = squared.argmin(axis=1)
            self.cluster[popped] = own
            for c, gap, member in zip(own.tolist(), (_gaps(squared, own) + drift[own]).tolist(), popped.tolist(), strict=True):
                heapq.heappush(self.heaps[c], (gap, member))
        return popped

    def row(self, block: int, sums: np.ndarray) -> list[pa.Array]:
        entries = [e for heap in self.heaps for e in heap]
        return [
            pa.array([block], pa.int64()),
            pa.array([self.cluster.astype("<i4").tobytes()], pa.binary()),
            pa.array([[len(h) for h in self.heaps]], pa.list_(pa.int32())),
            pa.array([np.array([g for g, _ in entries], "<f8").tobytes()], pa.binary()),
            pa.array([np.array([m for _, m in entries], "<i4").tobytes()], pa.binary()),
            pa.array([sums.astype("<i8").tobytes()], pa.binary()),
        ]

    @classmethod
    def read(cls, row: dict) -> Heaps:
        gaps, members = np.frombuffer(row["gaps"], "<f8").tolist(), np.frombuffer(row["members"], "<i4").tolist()
        heaps, at = [], 0
        for n in row["heap_sizes"]:
            heaps.append(list(zip(gaps[at : at + n], members[at : at + n], strict=True)))
            at += n
        return cls(np.frombuffer(row["cluster"], "<i4").astype(np.int64), heaps)


def _sums(vectors: np.ndarray, counts: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """For each cluster the sums of components, then the count."""
    weighed = np.concatenate([vectors * counts[:, None], counts[:, None]], axis=1)
    out = np.zeros((k, weighed.shape[1]), np.int64)
    np.add.at(out, cluster, weighed)
    return out


def _round(centroids: np.ndarray, drift: np.ndarray, dimensions: int, inertia: bool):
    """One assignment of all blocks; sums are those of clusters, or their inertia after the last."""
    k = len(centroids)

    def assign(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, dimensions).astype(np.int64)
                counts = np.array(row["counts"], np.int64)
                if row.get("cluster") is None:
                    heaps = Heaps.new(vectors, centroids)
                    changed, before = True, None
                else:
                    heaps = Heaps.read(row)
                    before = heaps.cluster.copy()
                    changed = heaps.settle(vectors, centroids, drift)
                if inertia:
                    far = np.square(vectors - centroids[heaps.cluster]).sum(axis=1)
                    sums = np.zeros(k, np.int64)
                    np.add.at(sums, heaps.cluster, far * counts)
                elif before is None:
                    sums = _sums(vectors, counts, heaps.cluster, k)
                else:  # only vectors that changed their cluster change its sums
                    sums = np.frombuffer(row["sums"], "<i8").reshape(k, -1).copy()
                    moved = changed[before[changed] != heaps.cluster[changed]]
                    sums += _sums(vectors[moved], counts[moved], heaps.cluster[moved], k) - _sums(vectors[moved], counts[moved], before[moved], k)
                yield pa.RecordBatch.from_arrays(heaps.row(row["block"], sums), names=["block", "cluster", "heap_sizes", "gaps", "members", "sums"])

    return assign


def _totals(batches):
    """The sums of a partition's blocks: (place, value)."""
    total: list[int] = []
    for batch in batches:
        for sums in batch.column(0).to_pylist():
            values = np.frombuffer(sums, "<i8").tolist()
            total = [a + b for a, b in zip(total, values, strict=True)] if total else values
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], names=["place", "value"])


class _Tables:
    """Tables bucketed by block in the shared folder, dropped at the end."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets

    def put(self, df: DataFrame) -> DataFrame:
        name = f"clusters_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.bucketBy(self.buckets, "block").option("path", path).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out.written_to, out.name = path, name
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.spark.sql(f"DROP TABLE `{df.name}`")
            discard(df)


def _total(state: DataFrame) -> list[int]:
    rows = state.select("sums").mapInArrow(_totals, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return [int(r["value"]) for r in rows]


def _first(rows: DataFrame, k: int, seed: int) -> list[bytes]:
    """The k vectors with the smallest SHA-256 of 'seed:id', rows counting each; a null id comes last."""
    ranked = rows.withColumn("rank", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256))
    return [bytes(r["vector"]) for r in ranked.orderBy(F.col("rank").asc_nulls_last(), "vector", "n").limit(k).collect() for _ in range(min(r["n"], k))][:k]


def _lasting(spark: SparkSession, blocks: DataFrame, tables: _Tables, now: np.ndarray, dimensions: int, rounds: int) -> tuple[np.ndarray, DataFrame]:
    """Final centroids and the heaps of the last assignment, whose sums are inertia."""
    drift = np.zeros(len(now))
    state = None
    for at in range(rounds + 1):
        step = _round(now, drift, dimensions, at == rounds)
        both = blocks.drop("ids") if state is None else blocks.drop("ids").join(state.hint("shuffle_hash"), "block")
        then = tables.put(both.mapInArrow(step, _STATE))
        if state is not None:
            tables.drop(state)
        state = then
        if at < rounds:
            sums = np.array(_total(state), object).reshape(len(now), -1)
            moved = np.array([[s // row[-1] for s in row[:-1]] if row[-1] else old.tolist() for row, old in zip(sums, now, strict=True)], np.int64)
            steps = np.sqrt(np.square(moved - now).sum(axis=1).astype(float))
            drift = drift + steps + [max(np.delete(steps, c), default=0.0) for c in range(len(now))]
            now = moved
    return now, state


def cluster_vectors(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    dimensions: int = 64,
    scale: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row for each vector: (id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    Vectors with exactly `dimensions` components, none null or non-finite, are kept and become
    floor(scale * component) as integers; others have no row. The first centroids are the k
    vectors with the smallest hash of seed and id; a table with fewer vectors has as many
    clusters as vectors. Each row is a vector of its own: repeated rows and repeated or null ids
    count and return each time; of rows with equal ids the least vector in bytes comes first
    among the first centroids, null ids come last. Ties go to the smaller cluster number.
    Integers beyond 2^27 raise an error, as distances would not fit in 64 bits. Other columns are
    not read; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    n_blocks = max(1, -(-vectors.count() // BLOCK))
    n_buckets = max(-(-n_blocks // BUCKET_BLOCKS), min(n_blocks, 2 * spark.sparkContext.defaultParallelism))
    whole = rows.mapInArrow(_integers(dimensions, scale), "id long, vector binary, n long")
    tables = _Tables(spark, n_buckets)
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks))).repartition(n_buckets, "block").sortWithinPartitions("block")
    blocks = tables.put(dealt.mapInArrow(_blocks, "block long, ids array<long>, counts array<long>, vectors binary"))
    first = _first(whole, k, seed)
    names = f"`{id_col}` long, cluster int, distance long"
    if not first:
        tables.drop(blocks)
        return spark.createDataFrame([], f"{names}, cluster_inertia long, inertia long, centroid_sha256 string")
    start = np.stack([np.frombuffer(v, "<i4") for v in first]).astype(np.int64)
    final, state = _lasting(spark, blocks, tables, start, dimensions, rounds)
    inertia = _total(state)

    def members(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["cluster"], "<i4")
                far = np.square(np.frombuffer(row["vectors"], "<i4").reshape(-1, dimensions).astype(np.int64) - final[own]).sum(axis=1)
                for ids, c, d in _repeated(row["ids"], row["counts"], own, far):
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=[id_col, "cluster", "distance"])

    out = written(blocks.join(state.select("block", "cluster").hint("shuffle_hash"), "block").mapInArrow(members, names))
    tables.drop(blocks, state)
    at = (F.col("cluster") + 1).cast("int")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in final]
    of_cluster = lambda values: F.element_at(F.array(*map(F.lit, values)), at)
    return out.withColumns({"cluster_inertia": of_cluster(inertia).cast("long"), "inertia": F.lit(sum(inertia)).cast("long"), "centroid_sha256": of_cluster(digests)})


def _repeated(ids: list, counts: list, own: np.ndarray, far: np.ndarray, most: int = 10_000):
    """The rows of a block, each as often as it was counted, in pieces of bounded length."""
    held: tuple[list, list, list] = ([], [], [])
    for i, n, c, d in zip(ids, counts, own.tolist(), far.tolist(), strict=True):
        while n:
            take = min(n, most - len(held[0]))
            for column, value in zip(held, (i, c, d), strict=True):
                column.extend([value] * take)
            n -= take
            if len(held[0]) == most:
                yield held
                held = ([], [], [])
    if held[0]:
        yield held


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def clusters_sql(rounds: int = 10) -> str:
    """DuckDB SQL: one pair of assignment and centroids for each round."""
    parts = [
        """e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)) NULLS LAST, r) - 1 AS INT) AS cluster, v AS m FROM e QUALIFY cluster < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM
  (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM e, c{i}) GROUP BY r, vec_id, v)"""
        )
        if i < rounds:
            parts.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.m, c.m) AS m FROM c{i} c LEFT JOIN (SELECT cluster, list(q ORDER BY p) AS m FROM
  (SELECT cluster, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS q FROM (SELECT cluster, p, sum(x) AS s, CAST(count(*) AS HUGEINT) AS n FROM
  (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY cluster, p)) GROUP BY cluster) n ON n.cluster = c.cluster)"""
            )
    return f"""WITH {', '.join(parts)}
SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.m, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


QUERIES = {"op12_clusters": op12_clusters}
SQL = {"op12_clusters": clusters_sql()}

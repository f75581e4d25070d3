"""Centroid clustering by scalar lookup tables.

Vectors become integers once and are kept in blocks: per dimension the integer values that occur in the block, and per vector
the codes of its values. In every round a block tabulates the squared difference of each dimension, occurring value and
centroid; the distance of a vector is then a sum of gathered table entries, and no product of a vector is formed. Per round
only one row per task and centroid, with exact integer sums, is shuffled, and as many rows as there are centroids reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayloom.llm import textkit as K
from stayloom.session import cut_lineage

DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
BLOCK = 8192
LIMIT = 1 << 26
BLOCKS = "ids binary, empty binary, sizes binary, values binary, codes binary"
SUMS = "cluster int, n bigint, inertia decimal(38,0), sums array<bigint>"
RESULT = "vec_id bigint, cluster int, distance bigint"


def integer_vectors(vectors: DataFrame, column: str = "embedding", *, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors with exactly ``dimensions`` components, all finite; x holds floor(scale * component)."""
    x = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    small = F.forall(F.col("x"), lambda v: F.abs(v) <= F.lit(LIMIT))
    kept = vectors.where((F.size(x) == dimensions) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("x"))
    return kept.withColumn("x", F.when(small, F.col("x")).otherwise(
        F.raise_error(F.lit(f"a scaled component beyond {LIMIT} has no distance in 64 bits"))))


def start_order(salt: int = 3) -> Column:
    """The hash by which starting vectors are chosen; a NULL id counts as empty text."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def _block(ids: pa.Array, x: np.ndarray) -> dict[str, list[bytes]]:
    """The vectors of ``x`` as values per dimension and the code of each component among them."""
    values, codes = zip(*[np.unique(x[:, d], return_inverse=True) for d in range(x.shape[1])])
    return {"ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()],
            "empty": [ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
            "sizes": [np.array([len(v) for v in values], np.int32).tobytes()],
            "values": [np.concatenate(values).astype(np.int32).tobytes()],
            "codes": [np.stack(codes).astype(np.uint16).tobytes()]}


def to_blocks(vectors: DataFrame, *, dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """Blocks of at most ``block`` vectors, which fit 16-bit codes; made from the rows of one task, without a shuffle."""

    def work(batches):
        held_ids, held = [], []

        def flush():
            x = np.concatenate(held)
            ids = pa.concat_arrays(held_ids)
            held.clear()
            held_ids.clear()
            return pa.RecordBatch.from_pydict(_block(ids, x))

        room = block
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, room)
                held_ids.append(part.column("vec_id"))
                held.append(part.column("x").flatten().to_numpy().reshape(-1, dimensions))
                at += part.num_rows
                room -= part.num_rows
                if room == 0:
                    yield flush()
                    room = block
        if held:
            yield flush()

    return K.map_arrow(vectors, work, BLOCKS)


class Block:
    """One block read back: the values that occur per dimension and the codes of its vectors."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        cell = {c: batch.column(c)[row].as_buffer() for c in batch.schema.names}
        self.ids = pa.array(np.frombuffer(cell["ids"], np.int64), mask=np.frombuffer(cell["empty"], np.uint8).astype(bool))
        self.sizes = np.frombuffer(cell["sizes"], np.int32)
        self.values = np.frombuffer(cell["values"], np.int32).astype(np.int64)
        self.first = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.codes = np.frombuffer(cell["codes"], np.uint16).reshape(len(self.sizes), -1)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, ties to the smaller number."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        table = (self.values[:, None] - centroids.T[owner]) ** 2  # a row per dimension and value, a column per centroid
        distance = np.zeros((self.codes.shape[1], len(centroids)), np.int64)
        for d, codes in enumerate(self.codes):
            distance += table[self.first[d]:self.first[d] + self.sizes[d]].take(codes, axis=0)
        cluster = distance.argmin(axis=1)
        return cluster, distance[np.arange(len(cluster)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors per cluster and the sums of their components: counts of each value times the value."""
        total = np.zeros((k, len(self.sizes)), np.int64)
        for d, codes in enumerate(self.codes):
            size = int(self.sizes[d])
            seen = np.bincount(cluster * size + codes, minlength=k * size).reshape(k, size)
            total[:, d] = seen @ self.values[self.first[d]:self.first[d] + size]
        return np.bincount(cluster, minlength=k), total


def _cluster_sums(blocks: DataFrame, centroids: np.ndarray) -> list:
    """Vectors, summed distance and summed components per centroid; at most one row per centroid reaches the driver."""
    k, dimensions = centroids.shape

    def work(batches):
        n, inertia, total = np.zeros(k, np.int64), [0] * k, np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                cluster, distance = block.assign(centroids)
                count, sums = block.sums(cluster, k)
                n += count
                total += sums
                for c in np.flatnonzero(count).tolist():
                    inertia[c] += int(distance[cluster == c].sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), pa.int32()), pa.array(n), pa.array(inertia, pa.decimal128(38, 0)), pa.array(total.tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "inertia", "sums"])

    whole = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dimensions)]
    return K.map_arrow(blocks, work, SUMS).groupBy("cluster").agg(
        F.sum("n").alias("n"), F.sum("inertia").cast("decimal(38,0)").alias("inertia"), *whole).where("n > 0").collect()


def fit(blocks: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` rounds; each is the componentwise floor of its vectors' mean, an empty one stays."""
    centroids = start.copy()
    for _ in range(rounds):
        moved = centroids.copy()
        for r in _cluster_sums(blocks, centroids):
            moved[r["cluster"]] = [r[f"s{d}"] // r["n"] for d in range(centroids.shape[1])]
        if (moved == centroids).all():
            break  # every further round gives the same
        centroids = moved
    return centroids


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""

    def work(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                cluster, distance = block.assign(centroids)
                yield pa.RecordBatch.from_arrays([block.ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return K.map_arrow(blocks, work, RESULT)


def cluster_vectors(vectors: DataFrame, column: str = "embedding", *, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
                    scale: int = SCALE, salt: int = 3, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and ``centroid`` (the components) of every vector that is kept.

    Kept are vectors with exactly ``dimensions`` components, none of them NULL, NaN or infinite; other rows are not in the
    result. The ``k`` vectors with the smallest hash of salt and id start as centroids 0, 1, ...; of rows with one id the
    smaller vector comes first, and a NULL id counts as empty text. Fewer vectors than ``k`` give as many centroids, an
    empty table an empty result. Repeated rows count as often as they occur. A scaled component beyond 2**26 fails the job,
    because squared distances would leave 64 bits. Other columns are ignored, whatever their names.
    """
    if not 0 < block <= 1 << 16:
        raise ValueError("a block holds 1 to 65536 vectors, since codes have 16 bits")
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, column, dimensions=dimensions, scale=scale)
    blocks = cut_lineage(to_blocks(rows, dimensions=dimensions, block=block), "vectors")
    first = rows.orderBy(start_order(salt), "x").limit(k).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), dimensions)
    if not len(start):
        none = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return spark.createDataFrame([], none)
    centroids = fit(blocks, start, rounds)
    sums = {r["cluster"]: int(r["inertia"]) for r in _cluster_sums(blocks, centroids)}
    described = F.array(*[F.struct(F.lit(sums.get(c, 0)).cast("bigint").alias("inertia"),
                                   F.array(*[F.lit(int(v)).cast("bigint") for v in row]).alias("centroid"))
                          for c, row in enumerate(centroids)])
    own = F.get(described, F.col("cluster"))
    return assign(blocks, centroids).select(
        "vec_id", "cluster", "distance", own["inertia"].alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("bigint").alias("inertia"), own["centroid"].alias("centroid"))


def centroid_digest(components: Column) -> Column:
    return F.sha2(F.array_join(components.cast("array<string>"), ","), 256)


def sql(table: str = "embeddings", *, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, salt: int = 3) -> str:
    """DuckDB SQL for the rows of ``cluster_vectors`` with the digest of each centroid, one group of queries per round."""
    finite = "list_aggregate(list_transform(embedding, lambda v: (v is not null and isfinite(v))::int), 'min') = 1"
    parts = [f"""kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda v: floor({scale} * v::double)::bigint) as x
  from {table} where len(embedding) = {dimensions} and {finite})""", """cell as materialized (
  select r, unnest(range(1, len(x) + 1)) as d, unnest(x) as v from kept)""", f"""c0 as materialized (
  select (row_number() over (order by sha256('{salt}:' || coalesce(vec_id::varchar, '')), x) - 1)::int as c, x
  from kept order by c limit {k})"""]

    def nearest(i: int) -> str:
        return f"""a{i} as materialized (
  select r, min((dist, c)) as best from (
    select r, c, sum((v - e.w) * (v - e.w))::bigint as dist
    from cell join (select c, unnest(range(1, len(x) + 1)) as d, unnest(x) as w from c{i}) e using (d) group by r, c) group by r)"""

    for i in range(rounds):
        parts.append(nearest(i))
        parts.append(f"""m{i + 1} as (
  select c, list(((s - ((s % n) + n) % n) // n)::bigint order by d) as x from (
    select best[2] as c, d, sum(v)::bigint as s, count(*) as n from a{i} join cell using (r) group by all) group by c)""")
        parts.append(f"c{i + 1} as materialized (select c0.c, coalesce(m.x, o.x) as x from c0 join c{i} o using (c) left join m{i + 1} m using (c))")
    parts.append(nearest(rounds))
    return "with " + ",\n".join(parts) + f"""
select vec_id, c as cluster, best[1] as distance, (sum(best[1]) over (partition by c))::bigint as cluster_inertia,
  (sum(best[1]) over ())::bigint as inertia, sha256(list_aggregate(x, 'string_agg', ',')) as centroid_sha256
from a{rounds} join kept using (r) join c{rounds} fin on fin.c = best[2]""".replace("join kept using (r) join c", "join (select r, vec_id from kept) using (r) join c")

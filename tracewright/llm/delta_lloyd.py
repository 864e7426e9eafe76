"""Centroid clustering by Delta Lloyd, in exact integers.

Every vector becomes integers floor(scale * x). Vectors stand in blocks, a few thousand to a row, in a table bucketed by
block that is written once. What changes stands apart: each round writes owners and distances, some 12 bytes a vector,
bucketed alike, so that a round joins both without a shuffle and without writing vectors again.

1. The first round compares every vector with every centroid.
2. Each block notes signed transfers: what its vectors that changed owner take from the old cluster and bring to the new one
   (count and componentwise sum). Spark adds the transfers up; at most k * (dims + 1) integers reach the driver, which keeps
   the global sums and derives the next centroids from them.
3. Each further round compares a vector whose owner's centroid stayed only with the centroids that changed, and a vector
   whose owner moved with all. Where no centroid changed nothing can: the remaining rounds are skipped.

Centroids (k times dims integers) go to the tasks with the code. Nothing else is sent to all. A lost executor costs the
round's tasks: what a round reads are written tables.

Edge cases: vectors of another length, or with a null, NaN or infinite component, and null vectors are left out; a null key
hashes like empty text and orders first; rows alike in key are clustered each; with fewer vectors than ``k`` there are as many
centroids as vectors; an empty table gives an empty result; other columns may have any name. Components so large that a squared
distance wouldn't fit a long are an error, as the result couldn't be exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

K, ROUNDS, DIMENSIONS, SCALE, SALT, ROWS = 40, 5, 64, 256, "2:", 4096

STATE = "block bigint, owners binary, distances binary, moves array<struct<cluster:int,sums:array<bigint>>>"


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all rows of c, exact."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    bound = 4 * v.shape[1] * most * most
    if bound < 1 << 53:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if bound >= 1 << 63:
        raise ValueError("components too large: a squared distance must fit a long")
    return np.stack([((v - row) ** 2).sum(1) for row in c], 1)


def assign(v: np.ndarray, centroids: np.ndarray, changed: np.ndarray, owners: np.ndarray | None, distances: np.ndarray | None):
    """(owners, distances) after a round; changed: numbers of the centroids that did. Ties go to the smaller number."""
    if owners is None:
        d = squared(v, centroids)
        best = d.argmin(1)
        return best.astype(np.int32), d[np.arange(len(v)), best]
    owners, distances = owners.copy(), distances.copy()
    moved = np.isin(owners, changed)
    stay = ~moved
    if len(changed) and stay.any():
        d = squared(v[stay], centroids[changed])
        best = d.argmin(1)
        least, number = d[np.arange(len(d)), best], changed[best]
        better = (least < distances[stay]) | (least == distances[stay]) & (number < owners[stay])
        rows = np.flatnonzero(stay)[better]
        owners[rows], distances[rows] = number[better], least[better]
    if moved.any():
        owners[moved], distances[moved] = assign(v[moved], centroids, changed, None, None)
    return owners, distances


def transfers(v: np.ndarray, new: np.ndarray, old: np.ndarray | None) -> list[dict]:
    """Signed count and sums, by cluster, of the vectors that changed owner; the count follows the sums."""
    sums: dict[int, np.ndarray] = {}
    moved = np.ones(len(new), bool) if old is None else new != old
    full = np.concatenate((v, np.ones((len(v), 1), np.int64)), 1)[moved]
    for owners, sign in ((new[moved], 1),) if old is None else ((new[moved], 1), (old[moved], -1)):
        for c in np.unique(owners).tolist():
            sums[c] = sums.get(c, 0) + sign * full[owners == c].sum(0)
    return [{"cluster": c, "sums": s.tolist()} for c, s in sorted(sums.items())]


def usable(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, x): vectors of the right length whose components are all finite."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(f"`{key}`").alias("key"), v.cast("array<double>").alias("x"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    q = np.floor(scale * x)
    if len(q) and np.abs(q).max() >= 1 << 31:
        raise ValueError("components too large: a squared distance must fit a long")
    return q.astype(np.int64)


def blocks(found: DataFrame, dims: int, scale: int, rows: int) -> DataFrame:
    """(block, keys, data): components of up to ``rows`` vectors as 16-bit integers where they fit, else as 32-bit ones."""
    kind = found.schema["key"].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, x = batch.column("key"), batch.column("x")
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for i in range(0, len(batch), rows):
                q = whole(flat[i : i + rows], scale)
                small = np.abs(q).max() < 1 << 15
                ids = pa.ListArray.from_arrays(pa.array([0, len(q)], pa.int32()), keys.slice(i, len(q)))
                data = pa.array([q.astype("<i2" if small else "<i4").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, data], ["block", "keys", "data"])
                number += 1

    return found.mapInArrow(pack, f"block bigint, keys array<{kind}>, data binary")


def components(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dims else "<i4").reshape(n, dims).astype(np.int64)


def walked(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, changed: np.ndarray):
    """(block, keys, vectors, new owners, new distances, old owners) for each block, one at a time."""
    dims = centroids.shape[1]
    for batch in batches:
        for i in range(len(batch)):
            at = {name: batch.column(name)[i] for name in batch.schema.names}
            keys = at["keys"].values
            v = components(at["data"].as_py(), len(keys), dims)
            old = distances = None
            if "owners" in at:
                old, distances = np.frombuffer(at["owners"].as_py(), "<i4"), np.frombuffer(at["distances"].as_py(), "<i8")
            owners, distances = assign(v, centroids, changed, old, distances)
            yield at["block"].as_py(), keys, v, owners, distances, old


def round_of(table: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """STATE rows after one assignment."""

    def step(batches):
        schema = pa.schema(
            [("block", pa.int64()), ("owners", pa.binary()), ("distances", pa.binary())]
            + [("moves", pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])))]
        )
        for block, _, v, owners, distances, old in walked(batches, centroids, changed):
            yield pa.RecordBatch.from_pylist([{"block": block, "owners": owners.tobytes(), "distances": distances.tobytes(), "moves": transfers(v, owners, old)}], schema)

    return table.mapInArrow(step, STATE)


def last_round(table: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of every vector after the last assignment."""
    kind = table.schema["keys"].dataType.elementType.simpleString()

    def step(batches):
        for _, keys, _, owners, distances, _ in walked(batches, centroids, changed):
            yield pa.RecordBatch.from_arrays([keys, pa.array(owners), pa.array(distances)], ["key", "cluster", "distance"])

    return table.mapInArrow(step, f"key {kind}, cluster int, distance bigint")


class Model:
    """Centroids with the global sums behind them: one row of Python integers each, the count last."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.sums = [[0] * (centroids.shape[1] + 1) for _ in centroids]

    def apply(self, state: DataFrame) -> np.ndarray:
        """Add a round's transfers; the numbers of the centroids that change."""
        found = state.select(F.explode("moves").alias("m")).select("m.cluster", F.posexplode("m.sums").alias("i", "s"))
        for r in found.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
            self.sums[r.cluster][r.i] += int(r.s)
        fresh = np.array([[s // n for s in sums] if n else c.tolist() for (*sums, n), c in zip(self.sums, self.centroids, strict=True)], np.int64)
        changed = np.flatnonzero((fresh != self.centroids).any(1)).astype(np.int32)
        self.centroids = fresh
        return changed


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMENSIONS,
    scale: int = SCALE, salt: str = SALT, rows: int = ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every usable vector, as a written table, and the final centroids."""
    spark = vectors.sparkSession
    found = usable(vectors, key, vector, dims)
    order = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    seeds = found.select(order.alias("h"), "key", "x").orderBy("h", "key", "x").limit(k).collect()
    if not seeds:
        return found.select("key", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), np.empty((0, dims), np.int64)
    model = Model(whole(np.array([r.x for r in seeds], np.float64), scale))
    name, tables = f"delta_lloyd_{uuid.uuid4().hex}", []
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(df: DataFrame) -> DataFrame:
        tables.append(f"{name}_{len(tables)}")
        df.write.bucketBy(buckets, "block").sortBy("block").saveAsTable(tables[-1])
        return spark.table(tables[-1])

    try:
        data = write(blocks(found, dims, scale, rows).repartition(buckets, "block"))
        table, changed = data, np.arange(len(model.centroids), dtype=np.int32)
        for _ in range(rounds):
            state = write(round_of(table, model.centroids, changed))
            if len(tables) > 2:
                spark.sql(f"DROP TABLE {tables[-2]}")
            changed = model.apply(state)
            table = data.join(state.select("block", "owners", "distances"), "block")
            if not len(changed):
                break
        return materialize(last_round(table, model.centroids, changed), "clusters"), model.centroids
    finally:
        for t in tables:
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(read_table(spark, sf_dir, "embeddings"))
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r.cluster: int(r.s) for r in per.collect()}
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_sql(k: int = K, rounds: int = ROUNDS) -> str:
    """Lloyd's rounds written out one after the other, all vectors against all centroids."""
    parts = [
        """v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS u, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        "p AS (SELECT u, unnest(range(1, 65)) AS i, unnest(q) AS x FROM v)",
        f"""s AS (
  SELECT u, CAST(n - 1 AS INTEGER) AS c
  FROM (SELECT u, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id NULLS FIRST, u) AS n FROM v) WHERE n <= {k})""",
        "c0 AS (SELECT c, i, x FROM s JOIN p USING (u))",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT u, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, min(d) AS d
  FROM (SELECT u, c, CAST(sum((p.x - z.x) * (p.x - z.x)) AS BIGINT) AS d FROM p JOIN c{r} z USING (i) GROUP BY u, c) GROUP BY u)"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (
  SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
  FROM (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN p USING (u) GROUP BY c, i))"""
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, coalesce(m.x, z.x) AS x FROM c{r} z LEFT JOIN m{r} m USING (c, i))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN v USING (u) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) f ON a.c = f.c"""

"""k-means on whole numbers by Shallot: bounds, a remembered second-nearest centroid and a shrinking ball of neighbours.

Components become floor(scale * x); centroids are componentwise floor means, so every squared distance is an integer and a
result does not depend on partitions or retries. Between rounds each vector keeps its nearest and second-nearest centroid, an
upper bound of its distance to the first and a lower bound of its distance to all others. A round, for each vector:

1. Move the bounds by how far the centroids moved. If the upper bound is below the lower one, or below half the distance from
   its centroid to the next centroid, nothing can have changed and the vector is not read.
2. Else measure the nearest centroid exactly and test again.
3. Else measure the remembered second one too, take the closer of the two as the centre and scan the other centroids in order of
   their distance from it, as long as they lie in the ball of radius (distance to the centre + second-best distance so far).
   The ball shrinks whenever a closer second is found. Survivors are compared by integers, ties going to the smaller number.

Bounds are doubles rounded outwards, and tests that skip work are strict, so ties are never skipped.

On Spark: vectors travel in blocks of up to 4096 rows together with their state, written in the checkpoint folder once a
round, so a lost executor repeats one round. Tasks return, per centroid, the sums of the vectors that came and went; a round
moves k * (dim + 1) numbers per task to one aggregate. Centroids and their distances (k * k doubles) travel to the tasks.

Defined cases: rows whose vector is null, has not exactly ``dim`` components, or holds null, NaN or infinite ones are left out.
Components beyond +-2^27 / scale count as that bound. A null key takes part under the text ``null``; rows that repeat a key
are rows of their own, ordered by vector where their hashes tie. With fewer vectors than k there are as many centroids as
vectors. Equal centroids: the smaller number wins. An empty table gives an empty result. Other columns do not take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.vectors import SLACK, down, finite, group_sums, matrix, squared_gaps, up, whole_components
from ionloom.session import cut_lineage

BLOCK = 4096


class Geometry:
    """What a round needs of the centroids: their distances to each other, sorted, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = np.asarray(centroids, np.int64)
        k = len(self.centroids)
        apart = squared_gaps(self.centroids, self.centroids)
        hidden = apart.copy()
        np.fill_diagonal(hidden, -1)  # a centroid comes first among its own neighbours
        self.order = hidden.argsort(axis=1, kind="stable")
        self.apart = down(np.take_along_axis(apart, self.order, axis=1))
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else up(((self.centroids - before) ** 2).sum(axis=1))
        top = np.argsort(-self.moved, kind="stable")[:2]
        self.others_moved = np.full(k, self.moved[top[0]])
        self.others_moved[top[0]] = self.moved[top[1]] if k > 1 else 0.0


def measure(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the centroid in the same row."""
    return ((x - centroids) ** 2).sum(axis=1)


def first_state(x: np.ndarray, geo: Geometry) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nearest, second, upper, lower) from distances to all centroids."""
    gaps = squared_gaps(x, geo.centroids)
    rows = np.arange(len(x))
    near = gaps.argmin(axis=1)
    if gaps.shape[1] == 1:
        return near, near.copy(), up(gaps[rows, near]), np.full(len(x), np.inf)
    rest = gaps.copy()
    rest[rows, near] = np.iinfo(np.int64).max
    second = rest.argmin(axis=1)
    return near, second, up(gaps[rows, near]), down(rest[rows, second])


def next_state(x, near, second, upper, lower, geo: Geometry):
    """The state after the centroids have moved; ``x`` is read only where bounds do not decide."""
    near, second = near.copy(), second.copy()
    upper = (upper + geo.moved[near]) * (1 + SLACK)
    if len(geo.centroids) == 1:
        return near, second, upper, lower
    lower = lower - geo.others_moved[near]
    lower = lower - np.abs(lower) * SLACK
    live = np.flatnonzero(~(upper < np.maximum(lower, geo.half[near])))
    d_near = measure(x[live].astype(np.int64), geo.centroids[near[live]])
    upper[live] = up(d_near)
    open_ = ~(upper[live] < np.maximum(lower[live], geo.half[near[live]]))
    live, d_near = live[open_], d_near[open_]
    if not len(live):
        return near, second, upper, lower
    wide = x[live].astype(np.int64)
    a, b = near[live], second[live]
    d_second = measure(wide, geo.centroids[b])
    swap = (d_second < d_near) | ((d_second == d_near) & (b < a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    d_near, d_second = np.where(swap, d_second, d_near), np.where(swap, d_near, d_second)
    centre, known, radius = a.copy(), b.copy(), up(d_near)
    by_centre = np.argsort(centre, kind="stable")
    for rows in np.split(by_centre, np.flatnonzero(np.diff(centre[by_centre])) + 1):
        c = centre[rows[0]]
        for turn in range(1, len(geo.centroids)):
            rows = rows[geo.apart[c, turn] <= radius[rows] + up(d_second[rows])]
            if not len(rows):
                break
            j = geo.order[c, turn]
            new = rows[known[rows] != j]
            d = measure(wide[new], geo.centroids[j])
            first = (d < d_near[new]) | ((d == d_near[new]) & (j < a[new]))
            next_ = ~first & ((d < d_second[new]) | ((d == d_second[new]) & (j < b[new])))
            won, placed = new[first], new[next_]
            b[won], d_second[won] = a[won], d_near[won]
            a[won], d_near[won] = j, d[first]
            b[placed], d_second[placed] = j, d[next_]
    near[live], second[live] = a, b
    upper[live], lower[live] = up(d_near), down(d_second)
    return near, second, upper, lower


def _block_schema(key_kind: str) -> str:
    return (f"keys array<{key_kind}>, ints binary, near binary, second binary, upper binary, lower binary, "
            "centroid int, n long, sums array<long>")


def _blocks(kept: DataFrame, dim: int) -> DataFrame:
    """Vectors in blocks of up to BLOCK rows, without state."""
    kind = kept.schema["key"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                keys = part.column("key")
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([np.ascontiguousarray(matrix(part.column("ints"), dim), np.int32).tobytes()], pa.binary()),
                ], names=["keys", "ints"])

    return kept.mapInArrow(pack, f"keys array<{kind}>, ints binary")


def _round(blocks: DataFrame, dim: int, geo: Geometry, kind: str) -> DataFrame:
    """Blocks with their next state, and per task and centroid the sums of vectors that came less those that went."""
    fresh = "near" not in blocks.columns
    names = ["keys", "ints", "near", "second", "upper", "lower"]

    def step(batches):
        k = len(geo.centroids)
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        state_kinds = {"near": np.int32, "second": np.int32, "upper": np.float64, "lower": np.float64}
        key_list = None
        for batch in batches:
            key_list = batch.column("keys").type
            made = {n: [] for n in state_kinds}
            for row in range(batch.num_rows):
                x = np.frombuffer(batch.column("ints")[row].as_buffer(), np.int32).reshape(-1, dim)
                if fresh:
                    state = first_state(x, geo)
                    came, went = np.arange(len(x)), np.zeros(0, int)
                    old = state[0]
                else:
                    held = [np.frombuffer(batch.column(n)[row].as_buffer(), t) for n, t in state_kinds.items()]
                    old = held[0].astype(np.int64)
                    state = next_state(x, old, held[1].astype(np.int64), held[2], held[3], geo)
                    came = went = np.flatnonzero(state[0] != old)
                for rows, group, sign in ((came, state[0], 1), (went, old, -1)):
                    at, n, total = group_sums(group[rows], x[rows])
                    sums[at] += sign * total
                    counts[at] += sign * n
                for (n, t), value in zip(state_kinds.items(), state):
                    made[n].append(value.astype(t).tobytes())
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("keys"), batch.column("ints"), *[pa.array(made[n], pa.binary()) for n in state_kinds],
                pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(pa.int64())),
            ], names=[*names, "centroid", "n", "sums"])
        used = np.flatnonzero((counts != 0) | sums.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(used), key_list), *[pa.nulls(len(used), pa.binary())] * 5, pa.array(used.astype(np.int32)),
                pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64())),
            ], names=[*names, "centroid", "n", "sums"])

    return cut_lineage(blocks.mapInArrow(step, _block_schema(kind)))


def fit(kept: DataFrame, dim: int, k: int, rounds: int, salt: str) -> tuple[DataFrame, np.ndarray]:
    """Blocks with the last assignment, and the centroids it refers to."""
    kind = kept.schema["key"].dataType.simpleString()
    text = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("key").cast("string"), F.lit("null")))
    start = kept.orderBy(F.sha2(text, 256), "ints").limit(k).select("ints").collect()
    centroids = np.array([r["ints"] for r in start], np.int64).reshape(-1, dim)
    totals, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    blocks, before = _blocks(kept, dim), None
    for turn in range(rounds + 1):
        out = _round(blocks, dim, Geometry(centroids, before), kind)
        blocks = out.where("keys IS NOT NULL").select("keys", "ints", "near", "second", "upper", "lower")
        if turn == rounds:
            break
        changes = out.where("centroid IS NOT NULL").groupBy("centroid").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums")
        )
        for row in changes.collect():  # at most k rows
            counts[row["centroid"]] += row["n"]
            totals[row["centroid"]] = [t + s for t, s in zip(totals[row["centroid"]], row["sums"])]
        before, centroids = centroids, np.array(
            [[t // n for t in total] if n else old.tolist() for total, n, old in zip(totals, counts, centroids)], np.int64
        )
        if (before == centroids).all():  # every later round would repeat this one
            break
    return blocks, centroids


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, salt: str = "3", scale: int = 1024,
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that counts."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(finite(F.col("v"))).where(F.size("v") == dim)
    kept = cut_lineage(rows.select("key", whole_components(F.col("v"), scale).alias("ints")))
    if not kept.limit(1).count():
        return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks, centroids = fit(kept, dim, k, rounds, salt)

    def unpack(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x = np.frombuffer(batch.column("ints")[row].as_buffer(), np.int32).reshape(-1, dim).astype(np.int64)
                near = np.frombuffer(batch.column("near")[row].as_buffer(), np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("keys").slice(row, 1).flatten(), pa.array(near), pa.array(measure(x, centroids[near])),
                ], names=["key", "cluster", "distance"])

    placed = cut_lineage(blocks.select("keys", "ints", "near").mapInArrow(unpack, f"key {kind}, cluster int, distance long"))
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame(
        [(c, s, sum(inertia.values()), digest[c]) for c, s in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return placed.join(F.broadcast(about), "cluster").select(  # k rows
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

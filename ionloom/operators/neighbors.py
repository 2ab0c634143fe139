"""Exact k nearest neighbours by pruned blocks.

Points are assigned to the nearest of a few pivots. With the distance to the pivot known, the triangle
inequality bounds how far any point of a cell can be, so a cell of queries only receives the cells that can
still hold one of its k nearest points. Big cells are cut into blocks, so a hot cell is many tasks. Each pair
of blocks is one small matrix product that keeps k candidates per query; candidates are merged by a max-k
aggregate. No candidate is dropped that could be among the k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.operators.sampling import hash_order
from ionloom.session import bounded_rows, cut_lineage

MAX_PIVOT_ROWS = 16384


def distance_matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of ``a`` and ``b``; cosine is returned on unit vectors as half the squared L2."""
    if metric == "chebyshev":
        out = np.empty((len(a), len(b)))
        for j in range(len(b)):
            out[:, j] = np.abs(a - b[j]).max(axis=1)
        return out
    if metric == "cosine":
        return 1.0 - _unit(a) @ _unit(b).T
    out = np.empty((len(a), len(b)))
    for j in range(len(b)):
        gap = a - b[j]
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _unit(a: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, norm, out=np.zeros_like(a), where=norm > 0)


def stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype("float64") if len(series) else np.zeros((0, 0))


def _bound_metric(metric: str) -> str:
    """Cosine order equals Euclidean order on unit vectors, which obeys the triangle inequality."""
    return "euclidean" if metric == "cosine" else metric


def knn(points: DataFrame, k: int, metric: str = "euclidean", vector: str = "vector", block: int = 1024,
        pivots: int = 64) -> DataFrame:
    """points(region, pixel_id, vector) -> (region, i, j, distance, rank 1..k), self excluded, ties by id."""
    base = points.select("region", "pixel_id", F.col(vector).alias("v"))
    if metric == "cosine":
        length = F.sqrt(S.dot(F.col("v"), F.col("v")))
        base = base.withColumn("v", S.scaled(F.col("v"), F.when(length > 0, length).otherwise(
            F.raise_error(F.lit("cosine neighbours need non-zero spectra: drop the background first"))
        )))
    inner = _bound_metric(metric)
    order = Window.partitionBy("region", "_s").orderBy("_o")
    sampled = base.withColumn("_o", hash_order(7, "region", "pixel_id")).withColumn("_s", F.substring("_o", 1, 2))
    first = sampled.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 1)
    whole = Window.partitionBy("region").orderBy("_o")
    # one pivot per block of points: a small region is a single cell
    cells = base.groupBy("region").agg(F.least(F.lit(pivots), F.ceil(F.count(F.lit(1)) / block)).alias("_cells"))
    chosen = first.withColumn("_r", F.row_number().over(whole)).join(cells, "region").where(F.col("_r") <= F.col("_cells"))
    table: dict[int, np.ndarray] = {}
    for row in bounded_rows(chosen.select("region", "_r", "v"), MAX_PIVOT_ROWS, "pivots"):
        table.setdefault(row["region"], []).append((row["_r"], row["v"]))
    table = {r: np.array([v for _, v in sorted(rows)], dtype="float64") for r, rows in table.items()}
    shared = points.sparkSession.sparkContext.broadcast(table)

    def assign(batches):
        for pdf in batches:
            for region, part in pdf.groupby("region"):
                gaps = distance_matrix(stack(part["v"]), shared.value[region], inner)
                cell = gaps.argmin(axis=1)
                yield part.assign(cell=cell, to_pivot=gaps[np.arange(len(part)), cell])

    placed = base.mapInPandas(
        assign, "region int, pixel_id long, v array<double>, cell int, to_pivot double"
    ).withColumn("chunk", F.pmod(F.xxhash64("pixel_id"), F.lit(1 << 30)))
    sizes = placed.groupBy("region", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"), F.max("to_pivot").alias("reach"),
        F.min("to_pivot").alias("near"), F.count(F.lit(1)).alias("members"),
    )
    sizes = cut_lineage(sizes)
    placed = cut_lineage(
        placed.join(sizes.select("region", "cell", "parts"), ["region", "cell"])
        .withColumn("chunk", F.pmod("chunk", "parts").cast("int"))
    )
    routes = _routes(sizes, shared, inner, k)
    parts = sizes.select("region", "cell", "parts")
    query_side = routes.join(parts.select("region", F.col("cell").alias("dc"), F.col("parts").alias("_p")), ["region", "dc"])
    queries = placed.join(query_side.withColumnRenamed("qc", "cell"), ["region", "cell"]).select(
        "region", "pixel_id", "v", F.col("cell").alias("qc"), F.col("chunk").alias("qk"), "dc",
        F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("dk"), F.lit(0).alias("role"),
    )
    data_side = routes.join(parts.select("region", F.col("cell").alias("qc"), F.col("parts").alias("_p")), ["region", "qc"])
    data = placed.join(data_side.withColumnRenamed("dc", "cell"), ["region", "cell"]).select(
        "region", "pixel_id", "v", "qc", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("qk"),
        F.col("cell").alias("dc"), F.col("chunk").alias("dk"), F.lit(1).alias("role"),
    )

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        ids = d["pixel_id"].to_numpy()
        asked = q["pixel_id"].to_numpy()
        if not len(q) or not len(d):
            return pd.DataFrame({"region": [], "i": [], "j": [], "distance": []})
        gaps = distance_matrix(stack(q["v"]), stack(d["v"]), metric)
        gaps[asked[:, None] == ids[None, :]] = np.inf
        take = np.lexsort((np.broadcast_to(ids, gaps.shape), gaps), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(asked)), take.shape[1])
        cols = take.ravel()
        out = pd.DataFrame({
            "region": pdf["region"].iloc[0], "i": asked[rows], "j": ids[cols], "distance": gaps[rows, cols]
        })
        return out[np.isfinite(out["distance"])]

    candidates = queries.unionByName(data).groupBy("region", "qc", "qk", "dc", "dk").applyInPandas(
        best, "region int, i long, j long, distance double"
    )
    nearest = Window.partitionBy("region", "i").orderBy("distance", "j")
    return candidates.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _routes(cells: DataFrame, pivots, metric: str, k: int) -> DataFrame:
    """Which data cells each query cell needs, from one summary row per cell (at most ``pivots`` per region).

    Reach of a query cell: the smallest radius r such that cells lying wholly within r hold more than k
    points. A data cell is needed when its closest possible point is within that radius.
    """
    listed = cells.groupBy("region").agg(F.collect_list(F.struct("cell", "near", "reach", "members")).alias("b"))

    def choose(batches):
        for pdf in batches:
            for region, rows in zip(pdf["region"], pdf["b"]):
                ids = np.array([e["cell"] for e in rows])
                near, reach, members = (np.array([e[f] for e in rows]) for f in ("near", "reach", "members"))
                centre = pivots.value[region][ids]
                between = distance_matrix(centre, centre, metric)
                for q, gap in enumerate(between):
                    far = gap + reach[q] + reach
                    order = np.argsort(far, kind="stable")
                    enough = np.searchsorted(np.cumsum(members[order]), k + 1)
                    limit = far[order[min(enough, len(order) - 1)]]
                    closest = np.maximum.reduce([gap - reach[q] - reach, near - gap - reach[q], np.zeros(len(gap))])
                    need = np.flatnonzero(closest <= limit * (1 + 1e-9) + 1e-12)
                    yield pd.DataFrame({"region": region, "qc": ids[q], "dc": ids[need]})

    return listed.mapInPandas(choose, "region int, qc int, dc int")


def knn_rank(points: DataFrame, metric: str = "euclidean", vector: str = "vector", k: int = 100) -> DataFrame:
    return knn(points, k, metric, vector)

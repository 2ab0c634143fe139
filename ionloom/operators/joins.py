"""Joins between pixels, masks, axes, polygons and neighbours.

No join forces a broadcast: small sides are broadcast by the optimizer on their measured size, larger ones
fall back to a shuffled join that adaptive execution splits when a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import geometry as G


def join_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask, ["region", "y", "x"])


def join_mz_axis(ions: DataFrame, axis: DataFrame) -> DataFrame:
    """m/z value of each index; ``axis`` is (region, mz_index, mz) or (mz_index, mz)."""
    keys = [c for c in ("region", "mz_index") if c in axis.columns]
    return ions.join(axis, keys)


def nearest_mz(axis: DataFrame, requests: DataFrame) -> DataFrame:
    """Closest axis entry of every requested m/z, the lower index on equal distance.

    As-of in both directions over one sorted union per region: no pair of request and axis entry is formed.
    Requests of one region are spread by m/z cell; the axis entry before and after a cell is carried over by
    the cell summary, so a window never holds more than one cell.
    """
    cell = F.floor(F.col("mz") / 16.0)
    entries = axis.select("region", "mz", "mz_index").distinct().withColumn("_cell", cell)
    summary = entries.groupBy("region", "_cell").agg(
        F.min(F.struct("mz", "mz_index")).alias("first"),
        F.max(F.struct("mz", F.negative("mz_index").alias("neg"))).alias("last"),
    )
    asked = requests.select("region", F.col("mz")).distinct().withColumn("_cell", cell)
    cells = summary.select("region", "_cell", "first", "last").join(
        asked.select("region", "_cell").distinct(), ["region", "_cell"], "full_outer"
    )
    by_cell = Window.partitionBy("region").orderBy("_cell")
    around = cells.select(
        "region", "_cell",
        F.last("last", True).over(by_cell.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.first("first", True).over(by_cell.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )
    merged = entries.select("region", "_cell", "mz", "mz_index").unionByName(
        asked.select("region", "_cell", "mz", F.lit(None).cast("int").alias("mz_index"))
    )
    inside = Window.partitionBy("region", "_cell").orderBy("mz")
    hit = F.when(F.col("mz_index").isNotNull(), F.struct("mz", "mz_index"))
    down = F.when(F.col("mz_index").isNotNull(), F.struct("mz", F.negative("mz_index").alias("neg")))
    near = merged.select(
        "region", "_cell", "mz", "mz_index",
        F.max(down).over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("_down"),
        F.min(hit).over(inside.rangeBetween(0, Window.unboundedFollowing)).alias("_up"),
    ).where(F.col("mz_index").isNull()).join(around, ["region", "_cell"])
    down, up = F.coalesce("_down", "_prev"), F.coalesce("_up", "_next")
    low_gap, high_gap = F.col("mz") - down["mz"], up["mz"] - F.col("mz")
    take_low = high_gap.isNull() | (low_gap < high_gap) | (
        (low_gap == high_gap) & (F.negative(down["neg"]) <= up["mz_index"])
    )
    return near.select(
        "region", F.col("mz").alias("requested"),
        F.when(low_gap.isNotNull() & take_low, F.negative(down["neg"])).otherwise(up["mz_index"]).cast("int")
        .alias("mz_index"),
        F.when(low_gap.isNotNull() & take_low, down["mz"]).otherwise(up["mz"]).alias("mz"),
    )


def polygon_pixels(grid: DataFrame, polygons: DataFrame, tile: int = 16) -> DataFrame:
    """Pixels on or inside each polygon(region, polygon, xs, ys, ...).

    Equi-join on the tiles of the bounding box, then the ray test; a polygon never meets a pixel outside
    the tiles it touches, and a big polygon is spread over all its tiles.
    """
    boxed = polygons.withColumns({
        "_ty": F.sequence(F.floor(F.array_min("ys") / tile), F.floor(F.array_max("ys") / tile)),
        "_tx": F.sequence(F.floor(F.array_min("xs") / tile), F.floor(F.array_max("xs") / tile)),
        "_edges": G.edges(F.transform("xs", lambda v: v.cast("double")), F.transform("ys", lambda v: v.cast("double"))),
    })
    extra = [c for c in polygons.columns if c not in ("region", "xs", "ys")]
    tiles = boxed.select("region", *extra, "_edges", F.explode("_ty").alias("_ty"), "_tx").select(
        "region", *extra, "_edges", "_ty", F.explode("_tx").alias("_tx")
    )
    placed = grid.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    inside = G.inside_polygon(F.col("x").cast("double"), F.col("y").cast("double"), F.col("_edges"))
    return placed.join(tiles, ["region", "_ty", "_tx"]).where(inside).drop("_ty", "_tx", "_edges")


def grid_neighbors(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Pairs (pixel, neighbour) inside a square of side 2 * radius + 1; the join key is a single pixel."""
    reach = F.sequence(F.lit(-radius), F.lit(radius))
    shifted = pixels.select(
        "region", "y", "x", F.col("pixel_id"), F.explode(reach).alias("dy")
    ).select("*", F.explode(reach).alias("dx")).select(
        "region", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"),
        F.col("pixel_id").alias("center_id"), "dy", "dx",
    )
    return shifted.join(pixels.select("region", "y", "x", F.col("pixel_id").alias("neighbor_id")), ["region", "y", "x"]).select(
        "region", "center_id", "neighbor_id", "dy", "dx"
    )


def pixels_in_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    return pixels.join(mask, ["region", "y", "x"], "left_semi")


def pending_runs(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done, ["method", "path"], "left_anti")


def method_region_grid(paths: DataFrame, methods: list[str]) -> DataFrame:
    """Every method for every path: the method names travel inside each row, so nothing is paired by a join."""
    return paths.select("path", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))


def category_pairs(rows: DataFrame, *keys: str) -> DataFrame:
    """Unordered pairs of distinct categories, a < b. The pairs are the result; categories are few."""
    names = rows.select(*keys, "category").distinct()
    listed = names.groupBy(*keys).agg(F.sort_array(F.collect_set("category")).alias("_all"))
    return listed.select(*keys, "_all", F.posexplode("_all").alias("_i", "category_a")).select(
        *keys, "category_a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("category_b")
    )

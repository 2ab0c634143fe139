"""Group summaries over masks, labels and m/z.

Means over pixels divide by the size of the group on the grid, so zeros left out of ``ions`` count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.functions.order_stats import exact_quantiles
from ionloom.operators.normalize import ion_max_norm
from ionloom.session import small_side


def axis_of(sizes: DataFrame, n_mz: int) -> DataFrame:
    """Every group with every m/z index."""
    return sizes.withColumn("mz_index", F.explode(F.sequence(F.lit(0), F.lit(n_mz - 1))))


def region_mean_spectrum(ions: DataFrame, sizes: DataFrame, n_mz: int) -> DataFrame:
    """Mean intensity per group and m/z; ``sizes`` is (group keys..., n)."""
    keys = [c for c in sizes.columns if c != "n"]
    sums = ions.groupBy(*keys, "mz_index").agg(F.sum("intensity").alias("_s"))
    return axis_of(sizes, n_mz).join(sums, [*keys, "mz_index"], "left").select(
        *keys, "mz_index", (F.coalesce("_s", F.lit(0.0)) / F.col("n")).alias("mean")
    )


def region_percentile_spectrum(ions: DataFrame, sizes: DataFrame, n_mz: int, p: float = 0.3) -> DataFrame:
    keys = [c for c in sizes.columns if c != "n"]
    found = exact_quantiles(ions, [*keys, "mz_index"], "intensity", {"q": p}, sizes)
    return axis_of(sizes, n_mz).join(found, [*keys, "mz_index"], "left").select(
        *keys, "mz_index", F.coalesce("q", F.lit(0.0)).alias("q")
    )


def roi_mean_ratio(ions: DataFrame, masks: DataFrame, peaks: DataFrame) -> DataFrame:
    """Mean of A over mean of B per peak m/z, ions scaled by their own maximum, divided by the best score."""
    listed = peaks.select("region", "mz_index").distinct()
    scaled = ion_max_norm(ions.join(small_side(listed), ["region", "mz_index"], "left_semi"))
    sizes = masks.groupBy("region").agg(
        F.sum((F.col("side") == 0).cast("long")).alias("_na"), F.sum((F.col("side") == 1).cast("long")).alias("_nb")
    )
    sums = scaled.join(masks.select("region", "pixel_id", "side"), ["region", "pixel_id"]).groupBy(
        "region", "mz_index"
    ).agg(
        F.sum(F.when(F.col("side") == 0, F.col("intensity")).otherwise(0.0)).alias("_a"),
        F.sum(F.when(F.col("side") == 1, F.col("intensity")).otherwise(0.0)).alias("_b"),
    )
    def mean(total, n):  # a side without pixels has mean 0
        return F.coalesce(F.try_divide(F.col(total), F.col(n)), F.lit(0.0))

    ratios = sums.join(small_side(sizes), "region").select(
        "region", "mz_index",
        (mean("_a", "_na") / (F.lit(S.RATIO_EPSILON) + mean("_b", "_nb"))).alias("score"),
    )
    best = F.max("score").over(Window.partitionBy("region"))
    return ratios.withColumn("score", F.coalesce(F.try_divide(F.col("score"), best), F.lit(0.0)))


def max_over_pixels(ions: DataFrame) -> DataFrame:
    return ions.groupBy("region", "mz_index").agg(F.max("intensity").alias("max_intensity"))


def max_projection(ions: DataFrame, top: int = 30) -> DataFrame:
    """The strongest m/z of every region by their maximum over pixels."""
    order = Window.partitionBy("region").orderBy(F.desc("max_intensity"), "mz_index")
    return max_over_pixels(ions).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def global_percentile(ions: DataFrame, sizes: DataFrame, n_mz: int, p: float) -> DataFrame:
    """Percentile of the whole cube of each region, zeros included."""
    cells = sizes.select("region", (F.col("n") * n_mz).alias("n"))
    return exact_quantiles(ions, ["region"], "intensity", {"q": p}, cells)


def area_by_label(pixels: DataFrame, *keys: str) -> DataFrame:
    return pixels.groupBy(*(keys or ("region", "label"))).agg(F.count(F.lit(1)).alias("area"))


def majority_label(pixels: DataFrame, component: str, label: str) -> DataFrame:
    """Most frequent label inside each component, the smallest on ties; counts are combined before the shuffle."""
    counts = pixels.groupBy("region", component, label).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy("region", component).agg(
        F.max(F.struct(F.col("_c"), F.negative(F.col(label)).alias("_neg"))).alias("_best")
    ).select("region", component, F.negative(F.col("_best._neg")).alias(label), F.col("_best._c").alias("votes"))


def mz_frequency(peaks: DataFrame) -> DataFrame:
    """Number of components that list an m/z."""
    return peaks.groupBy("region", "mz_index").agg(F.countDistinct("component").alias("seen"))


def rare_mz(peaks: DataFrame, below: int = 2) -> DataFrame:
    return mz_frequency(peaks).where(F.col("seen") < below)


def common_mz(peaks: DataFrame, top: int = 200) -> DataFrame:
    order = Window.partitionBy("region").orderBy(F.desc("seen"), "mz_index")
    return mz_frequency(peaks).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def node_weight(edges: DataFrame) -> DataFrame:
    """Per category: confusion summed over its edges, scaled by the largest sum, and its degree."""
    ends = edges.select(
        "region", F.explode(F.array("category_a", "category_b")).alias("category"), "confusion"
    )
    sums = ends.groupBy("region", "category").agg(
        F.sum("confusion").alias("weight"), F.count(F.lit(1)).alias("degree")
    )
    most = F.max("weight").over(Window.partitionBy("region"))
    return sums.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), most), F.lit(0.0)))


def mean_color(image: DataFrame, channels: tuple[str, ...] = ("c0", "c1", "c2")) -> DataFrame:
    return image.groupBy("region").agg(*[F.avg(c).alias(c) for c in channels])


def metric_leaderboard(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide runs(method, path, metric...) -> long (method, metric, mean over paths, best path value)."""
    tall = runs.unpivot(["method", "path"], metrics, "metric", "value")
    return tall.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.max("value").alias("best"))


def metric_table(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """One column per metric again, averaged per method."""
    return runs.unpivot(["method", "path"], metrics, "metric", "value").groupBy("method").pivot(
        "metric", metrics
    ).agg(F.avg("value"))


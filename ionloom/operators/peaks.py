"""Ranks along the m/z axis, peaks and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.functions.order_stats import average_rank, ordered_position


def find_peaks(curves: DataFrame, keys: list[str], value: str, height: float = 0.0) -> DataFrame:
    """Strict local maxima of each curve along mz_index; a plateau counts once, at its middle (rounded down).

    Equal neighbours are folded into runs, then each run is compared with the run before and after it.
    The window holds one curve, that is one m/z axis.
    """
    line = Window.partitionBy(*keys).orderBy("mz_index")
    stepped = curves.select(*keys, "mz_index", F.col(value).alias("_v")).withColumn(
        "_new", F.when(F.lag("_v").over(line) == F.col("_v"), 0).otherwise(1)
    ).withColumn("_run", F.sum("_new").over(line))
    runs = stepped.groupBy(*keys, "_run").agg(
        F.min("mz_index").alias("_from"), F.max("mz_index").alias("_to"), F.first("_v").alias("height")
    )
    order = Window.partitionBy(*keys).orderBy("_run")
    return runs.withColumns({
        "_prev": F.lag("height").over(order), "_next": F.lead("height").over(order)
    }).where(
        (F.col("_prev") < F.col("height")) & (F.col("_next") < F.col("height")) & (F.col("height") >= height)
    ).select(*keys, F.floor((F.col("_from") + F.col("_to")) / 2).cast("int").alias("mz_index"), "height")


def union_peaks(*lists: DataFrame) -> DataFrame:
    result = lists[0].select("region", "mz_index")
    for other in lists[1:]:
        result = result.union(other.select("region", "mz_index"))
    return result.distinct()


def rank_dense_order(df: DataFrame, keys: list[str], value: str, tie: str, out: str = "rank") -> DataFrame:
    return ordered_position(df, keys, value, tie, out)


def rank_average(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Every row with its 1-based average rank.

    The join back meets one rank row per distinct value; adaptive execution splits the rows of a hot value.
    """
    ranks = average_rank(df, keys, value, out).drop("t")
    return df.join(ranks, [*keys, value])


def pixel_rank_per_mz(dense_ions: DataFrame) -> DataFrame:
    """0-based rank of every pixel within each m/z, by (intensity, pixel_id)."""
    return ordered_position(dense_ions, ["region", "mz_index"], "intensity", "pixel_id", "rank")


def top_n_mz_pixel(spectra: DataFrame, n: int = 200) -> DataFrame:
    """The n strongest m/z of each pixel; the sort happens inside the row, nothing is shuffled.

    Equal intensities are ordered by the higher index first.
    """
    entries = F.transform("spectrum", lambda v, i: F.struct(v.alias("intensity"), i.alias("mz_index")))
    ranked = F.slice(F.sort_array(entries, asc=False), 1, n)
    return spectra.select("region", "pixel_id", F.posexplode(ranked).alias("_p", "_e")).select(
        "region", "pixel_id", (F.col("_p") + 1).alias("rank"), F.col("_e.mz_index").alias("mz_index"),
        F.col("_e.intensity").alias("intensity"),
    )


def top_scores(stats: DataFrame, n: int = 5) -> DataFrame:
    """The n best m/z of each region; the group is one m/z axis."""
    order = Window.partitionBy("region").orderBy(F.desc("score"), "mz_index")
    return stats.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_bottom(stats: DataFrame, n: int = 50) -> DataFrame:
    """The n highest and n lowest scores of each region."""
    high = Window.partitionBy("region").orderBy(F.desc("score"), "mz_index")
    low = Window.partitionBy("region").orderBy("score", "mz_index")
    ranked = stats.withColumns({"_h": F.row_number().over(high), "_l": F.row_number().over(low)})
    sides = F.filter(
        F.array(F.struct(F.lit("top").alias("side"), F.col("_h").alias("rank")),
                F.struct(F.lit("bottom").alias("side"), F.col("_l").alias("rank"))),
        lambda s: s["rank"] <= n,
    )
    return ranked.select("region", "mz_index", "score", F.explode(sides).alias("_s")).select(
        "region", "mz_index", "score", "_s.side", "_s.rank"
    )


def top3_intensity(spectra: DataFrame) -> DataFrame:
    best = S.top3(F.col("spectrum"))
    return spectra.select(
        "region", "y", "x", "pixel_id", *[F.element_at(best, i + 1).alias(f"p{i}") for i in range(3)]
    )


# The six percent marks of the percentile ratio picture
RATIO_PERCENTS = (99.99, 99.9, 99.9, 99.0, 98.0, 85.0)


def sort_percentile_pick(spectra: DataFrame, percents: tuple[float, ...] = RATIO_PERCENTS, *extra) -> DataFrame:
    """Element of the sorted spectrum at each percent mark; ``extra`` columns are carried along."""
    ordered = spectra.withColumn("_sorted", F.sort_array("spectrum"))
    return ordered.select(
        "region", "y", "x", "pixel_id",
        *[S.pick_by_percent(F.col("_sorted"), p).alias(f"p{i}") for i, p in enumerate(percents)], *extra,
    )


def centroid_contrast(centers: DataFrame, n: int = 5) -> DataFrame:
    """For every ordered pair of centres the n m/z with the largest difference.

    centers(region, label, mz_index, mean): paired through the m/z axis with an equi-join on (region, mz_index).
    """
    other = centers.select("region", "mz_index", F.col("label").alias("label_b"), F.col("mean").alias("_mb"))
    pairs = centers.join(other, ["region", "mz_index"]).where(F.col("label") != F.col("label_b"))
    order = Window.partitionBy("region", "label", "label_b").orderBy(F.desc("contrast"), "mz_index")
    return pairs.select(
        "region", F.col("label").alias("label"), "label_b", "mz_index", (F.col("mean") - F.col("_mb")).alias("contrast")
    ).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def component_top_peaks(centers: DataFrame, n: int = 40, height: float = 0.0, value: str = "mean",
                        component: str = "label") -> DataFrame:
    peaks = find_peaks(centers, ["region", component], value, height)
    order = Window.partitionBy("region", component).orderBy(F.desc("height"), "mz_index")
    return peaks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

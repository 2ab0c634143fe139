"""From raw peaks to a binned cube.

Input: peaks(region, y, x, mz DOUBLE, intensity). Every bin assignment is an arithmetic expression, so the
only shuffle is the one that sums intensities of the same (pixel, bin), after a map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import cut_lineage, small_side

PIXEL_XY = ["region", "y", "x"]


def _sum_bins(binned: DataFrame, column: str) -> DataFrame:
    return binned.groupBy(*PIXEL_XY, column).agg(F.sum("intensity").alias("intensity"))


def peak_spectra(peaks: DataFrame) -> DataFrame:
    """One row per pixel with its peaks in ascending m/z: (region, y, x, mz ARRAY, intensity ARRAY). Peaks without m/z are left out."""
    listed = peaks.where("mz IS NOT NULL").groupBy(*PIXEL_XY).agg(F.sort_array(F.collect_list(F.struct("mz", "intensity"))).alias("_peaks"))
    return listed.select(*PIXEL_XY, F.col("_peaks.mz").alias("mz"), F.col("_peaks.intensity").alias("intensity"))


def bin_peaks(peaks: DataFrame, min_mz: float, max_mz: float, bins_per_mz: int) -> DataFrame:
    """Round half to even onto the grid; peaks outside the grid are left out, shared bins are summed."""
    count = bins_per_mz * round(max_mz - min_mz + 1)
    binned = peaks.withColumn(
        "mz_index", F.rint((F.col("mz").cast("float").cast("double") - F.lit(float(min_mz))) * bins_per_mz).cast("int")
    ).where(F.col("mz_index").between(0, count - 1))
    return _sum_bins(binned, "mz_index")


def auto_range(peaks: DataFrame) -> DataFrame:
    """One row per region: observed m/z range and the number of bins for one bin per unit."""
    return peaks.groupBy("region").agg(
        F.min(F.col("mz").cast("float")).cast("double").alias("min_mz"),
        F.max(F.col("mz").cast("float")).cast("double").alias("max_mz"),
    ).withColumn("n_units", F.rint(F.col("max_mz") - F.col("min_mz") + 1).cast("int"))


def bin_auto_range(peaks: DataFrame, bins_per_mz: int) -> DataFrame:
    """Grid taken from the data of each region; the range table has one row per region."""
    binned = peaks.join(small_side(auto_range(peaks)), "region").withColumn(
        "mz_index",
        F.rint((F.col("mz").cast("float").cast("double") - F.col("min_mz")) * bins_per_mz).cast("int"),
    ).where(F.col("mz_index").between(0, F.col("n_units") * bins_per_mz - 1))
    return _sum_bins(binned, "mz_index")


def nonzero_axis(peaks: DataFrame, bins_per_mz: int) -> DataFrame:
    """Sorted distinct quantized m/z per region. The axis is bounded by the m/z range times the resolution."""
    quantized = peaks.select(
        "region", F.rint(F.col("mz").cast("float").cast("double") * bins_per_mz).cast("long").alias("q")
    ).distinct()
    position = Window.partitionBy("region").orderBy("q")
    return quantized.select(
        "region", "q", (F.row_number().over(position) - 1).alias("mz_index"),
        F.round(F.col("q") / bins_per_mz, 6).alias("mz"),
    )


def bin_nonzero(peaks: DataFrame, bins_per_mz: int) -> DataFrame:
    """Keep only m/z values that occur. Sums first, so the axis join moves binned rows instead of raw peaks."""
    quantized = peaks.withColumn("q", F.rint(F.col("mz").cast("float").cast("double") * bins_per_mz).cast("long"))
    return _sum_bins(quantized, "q").join(small_side(nonzero_axis(peaks, bins_per_mz)), ["region", "q"]).select(
        *PIXEL_XY, "mz_index", "mz", "intensity"
    )


def window_join(peaks: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Range join: peaks with every target at most ``tolerance`` away.

    Both sides get a cell of width ``2 * tolerance``; a target is listed in the cells its window touches
    (two or three), a peak only in its own, so the equi-join meets each match exactly once. A target list that
    measures small is broadcast, so peaks stay where they are even when one m/z is crowded; a longer list is a
    shuffled join whose hot cells adaptive execution splits.
    """
    width = 2.0 * tolerance
    cells = targets.withColumn(
        "_cell",
        F.explode(F.sequence(
            F.floor((F.col("target_mz") - tolerance) / width), F.floor((F.col("target_mz") + tolerance) / width)
        )),
    )
    keyed = peaks.withColumn("_cell", F.floor(F.col("mz") / width))
    return keyed.join(small_side(cells), "_cell").where(
        (F.col("mz") >= F.col("target_mz") - tolerance) & (F.col("mz") <= F.col("target_mz") + tolerance)
    ).drop("_cell")


def match_mz_list(peaks: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """Sum per pixel and target of ``targets(target_index, target_mz)``; one peak may serve several targets."""
    return window_join(peaks, targets, tolerance).groupBy(*PIXEL_XY, "target_index", "target_mz").agg(
        F.sum("intensity").alias("intensity")
    )


def mz_grid(spark, start_mz: float, end_mz: float, bins_per_mz: int) -> DataFrame:
    """Regular m/z axis start, start + 1/bins, ... below end + 1, rounded to 3 decimals."""
    n = int(-(-(end_mz + 1 - start_mz) * bins_per_mz // 1))
    return spark.range(n).select(
        F.col("id").cast("int").alias("mz_index"),
        F.round(F.lit(float(start_mz)) + F.col("id") * F.lit(1.0 / bins_per_mz), 3).alias("mz"),
    )


def tolerance_window_sum(peaks: DataFrame, grid: DataFrame, tolerance: float) -> DataFrame:
    """Sum of all peaks within ``tolerance`` of each grid m/z."""
    targets = grid.select(F.col("mz_index").alias("target_index"), F.col("mz").alias("target_mz"))
    return match_mz_list(peaks, targets, tolerance).select(
        *PIXEL_XY, F.col("target_index").alias("mz_index"), F.col("target_mz").alias("mz"), "intensity"
    )


def coord_rebase(pixels: DataFrame) -> DataFrame:
    """Shift each region to origin 0 and add its extent; an aggregate and a join, no window over a region."""
    extent = pixels.groupBy("region").agg(
        F.min("y").alias("_y0"), F.min("x").alias("_x0"),
        (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"),
    )
    return pixels.join(small_side(extent), "region").withColumn("y", F.col("y") - F.col("_y0")).withColumn(
        "x", F.col("x") - F.col("_x0")
    ).drop("_y0", "_x0")


def region_frames(frames: DataFrame) -> DataFrame:
    """Per region: number of frames and the first frame."""
    return frames.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame_id").alias("first_frame")
    )


def scan_concat(scans: DataFrame) -> DataFrame:
    """All scans of a frame as one peak list, in scan order; a frame is one pixel."""
    ordered = F.sort_array(F.collect_list(F.struct("scan", "mz", "intensity")))
    return scans.groupBy("frame_id").agg(
        F.transform(ordered, lambda s: F.struct(s["mz"].alias("mz"), s["intensity"].alias("intensity"))).alias("peaks")
    )


def ion_chromatogram(
    scans: DataFrame, frames: DataFrame, jobs: DataFrame, mz_cell: float = 32.0, time_cell: int = 64
) -> DataFrame:
    """Summed intensity per (job, frame) inside the time, m/z and mobility window of each job.

    jobs(job, t0, t1, mz0, mz1, k0, k1). A job is listed in the cells of time x m/z that its window touches, a peak with the time
    of its frame lies in one, so frames and jobs never meet without a peak. Peaks in an m/z cell and frames in a time cell
    that no job touches are left out before peaks and frames are joined.
    """
    cells = lambda low, high, width: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    asked = cut_lineage(jobs.select("job", "t0", "t1", "mz0", "mz1", "k0", "k1").where(
        "t0 <= t1 AND mz0 <= mz1 AND k0 <= k1"
    ).withColumn("_tc", cells("t0", "t1", time_cell)).withColumn("_mc", cells("mz0", "mz1", mz_cell)))
    timed = frames.select("frame_id", "t").withColumn("_tc", F.floor(F.col("t") / time_cell)).join(
        small_side(asked.select("_tc").distinct()), "_tc", "left_semi"
    )
    mobile = asked.agg(F.min("k0").alias("_k0"), F.max("k1").alias("_k1")).first()  # one row
    peaks = scans.select("frame_id", "mz", "mobility", "intensity").where(
        F.col("mobility").between(mobile["_k0"], mobile["_k1"])
    ).withColumn("_mc", F.floor(F.col("mz") / mz_cell)).join(
        small_side(asked.select("_mc").distinct()), "_mc", "left_semi"
    )
    inside = (
        F.col("t").between(F.col("t0"), F.col("t1")) & F.col("mz").between(F.col("mz0"), F.col("mz1"))
        & F.col("mobility").between(F.col("k0"), F.col("k1"))
    )
    return peaks.join(timed, "frame_id").join(small_side(asked), ["_tc", "_mc"]).where(inside).groupBy("job", "frame_id").agg(
        F.sum("intensity").alias("intensity")
    )


def compare_extractions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Max and mean of two cubes side by side per region; both are (region, intensity)."""

    def summary(cube, suffix):
        return cube.groupBy("region").agg(
            F.max("intensity").alias(f"max_{suffix}"), F.avg("intensity").alias(f"mean_{suffix}")
        )

    return summary(first, "a").join(summary(second, "b"), "region", "full_outer")

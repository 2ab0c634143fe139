"""Which m/z separate groups of pixels: rank tests, mean ratios, point comparisons, ion images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import geometry as G
from ionloom.functions import spectrum as S
from ionloom.functions.order_stats import exact_quantiles, running_before
from ionloom.model import tagged_ions, to_ions
from ionloom.operators.aggregates import axis_of, region_percentile_spectrum, roi_mean_ratio
from ionloom.operators.normalize import ion_max_norm
from ionloom.operators.peaks import find_peaks, top_n_mz_pixel, union_peaks
from ionloom.session import bounded_rows, cut_lineage, small_side

# Fixed value: two-sided 5 % limit of the normal distribution
Z_LIMIT = 1.959963984540054
MAX_CATEGORIES = 512


def _cube(c: Column) -> Column:
    return c * c * c - c


def pairwise_u(source: DataFrame, members: DataFrame, n_mz: int, peaks: DataFrame | None = None) -> DataFrame:
    """Mann-Whitney U of every pair of groups (a < b) for every m/z of a region, zeros included.

    ``source`` is spectra or ions; members(region, pixel_id, code) has small integer codes. Returns (region, mz_index, a, b, u, auc, z,
    mean_a, mean_b).

    Equal intensities are merged into one row with a count per group (a map-side combine), earlier counts
    come from the bucketed running sum, and each row meets the other groups as array elements. Pixels are
    never paired with pixels and no m/z is held by a single task. Zeros are one tie group, added in closed
    form, so they are never shuffled.
    """
    sizes = members.groupBy("region", "code").agg(F.count(F.lit(1)).alias("n"))
    codes = sorted(r["code"] for r in bounded_rows(members.select("code").distinct(), MAX_CATEGORIES, "categories"))
    tagged = tagged_ions(source, members, "code")
    if peaks is not None:
        peaks = small_side(peaks.select("region", "mz_index").distinct())
        tagged = tagged.join(peaks, ["region", "mz_index"], "left_semi")
    counts = [f"c{i}" for i in range(len(codes))]
    counted = tagged.groupBy("region", "mz_index", "intensity").agg(
        *[F.sum((F.col("code") == code).cast("long")).alias(c) for c, code in zip(counts, codes)]
    )
    ranked = running_before(counted, ["region", "mz_index"], "intensity", counts)
    own = F.array(*counts)
    earlier = F.array(*[f"before_{c}" for c in counts])
    cells = ranked.select(
        "region", "mz_index", own.alias("own"), earlier.alias("earlier"), F.posexplode(own).alias("i", "ca")
    ).where(F.col("ca") > 0)
    cells = cells.select(
        "region", "mz_index", "i", "ca",
        F.posexplode(F.arrays_zip(F.col("own"), F.col("earlier"))).alias("j", "o"),
    ).where(F.col("i") != F.col("j"))
    partial = cells.where(F.col("i") < F.col("j")).groupBy("region", "mz_index", "i", "j").agg(
        F.sum(F.col("ca") * (F.col("o.earlier") + F.col("o.own") / 2)).alias("s"),
        F.sum(3 * F.col("ca") * F.col("o.own") * (F.col("ca") + F.col("o.own"))).alias("cross_ties"),
    )
    singles = counted.groupBy("region", "mz_index").agg(
        *[F.sum(c).alias(f"m{i}") for i, c in enumerate(counts)],
        *[F.sum(_cube(F.col(c))).alias(f"t{i}") for i, c in enumerate(counts)],
        *[F.sum(F.col(c) * F.col("intensity")).alias(f"v{i}") for i, c in enumerate(counts)],
    )
    wide_sizes = sizes.groupBy("region").agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("code") == code, F.col("n"))), F.lit(0)) for code in codes]).alias("n")
    )
    k = len(codes)
    if peaks is not None:
        axis = peaks.join(wide_sizes, "region")
    else:
        axis = axis_of(wide_sizes, n_mz)
    zero = F.lit(0).cast("long")

    def gather(prefix, fill):
        return F.array(*[F.coalesce(F.col(f"{prefix}{i}"), fill) for i in range(k)]).alias(prefix)

    base = axis.join(singles, ["region", "mz_index"], "left").select(
        "region", "mz_index", "n", gather("m", zero), gather("t", zero), gather("v", F.lit(0.0))
    )
    per_group = F.arrays_zip(F.col("n"), F.col("m"), F.col("t"), F.col("v"))
    first = base.select("region", "mz_index", per_group.alias("g"), F.posexplode(per_group).alias("i", "ga"))
    pairs = first.select(
        "region", "mz_index", "i", "ga",
        F.posexplode(F.col("g")).alias("j", "gb"),
    ).where((F.col("i") < F.col("j")) & (F.col("ga.n") > 0) & (F.col("gb.n") > 0))
    joined = pairs.join(partial, ["region", "mz_index", "i", "j"], "left")
    na, nb = F.col("ga.n"), F.col("gb.n")
    za, zb = na - F.col("ga.m"), nb - F.col("gb.m")
    n = na + nb
    u = F.coalesce("s", F.lit(0.0)) + F.col("ga.m") * zb + za * zb / 2.0
    ties = (
        F.col("ga.t") + F.col("gb.t") + F.coalesce("cross_ties", zero) + _cube(za + zb)
    ).cast("double")
    spread = F.sqrt(na * nb / 12.0 * (n + 1 - ties / (n * (n - 1))))
    larger = F.greatest(u, na * nb - u)
    lookup = F.array(*[F.lit(c) for c in codes])
    return joined.select(
        "region", "mz_index",
        F.element_at(lookup, F.col("i") + 1).alias("a"), F.element_at(lookup, F.col("j") + 1).alias("b"),
        u.alias("u"), (u / (na * nb)).alias("auc"),
        ((larger - na * nb / 2.0 - 0.5) / F.nullif(spread, F.lit(0.0))).alias("z"),
        (F.col("ga.v") / na).alias("mean_a"), (F.col("gb.v") / nb).alias("mean_b"),
    )


def mann_whitney_u(source: DataFrame, masks: DataFrame, n_mz: int, peaks: DataFrame | None = None) -> DataFrame:
    """Side 0 against side 1 of masks(region, pixel_id, side)."""
    members = masks.select("region", "pixel_id", F.col("side").alias("code"))
    return pairwise_u(source, members, n_mz, peaks).drop("a", "b")


def mask_peaks(source: DataFrame, masks: DataFrame, n_mz: int, height: float = 0.0) -> DataFrame:
    """Union of the peaks of the 30th percentile spectra of both sides."""
    sizes = masks.groupBy("region", "side").agg(F.count(F.lit(1)).alias("n"))
    curves = region_percentile_spectrum(tagged_ions(source, masks, "side"), sizes, n_mz, 0.3)
    return union_peaks(find_peaks(curves, ["region", "side"], "q", height))


def region_vs_region(source: DataFrame, masks: DataFrame, n_mz: int, height: float = 0.0,
                     method: str = "U-Test") -> DataFrame:
    """m/z that separate side 0 from side 1: (region, mz_index, score, ...). ``source`` is spectra or ions."""
    peaks = mask_peaks(source, masks, n_mz, height)
    if method != "U-Test":
        return roi_mean_ratio(to_ions(source) if "spectrum" in source.columns else source, masks, peaks)
    return mann_whitney_u(source, masks, n_mz, peaks).where(F.col("z") > Z_LIMIT).select(
        "region", "mz_index", F.col("auc").alias("score"), "u", "z"
    )


def mask_complement(spectra: DataFrame, mask: DataFrame, thin: int = 3) -> DataFrame:
    """Foreground pixels outside the mask, thinned to every third row and column."""
    grid = spectra.where((F.col("y") % thin == 0) & (F.col("x") % thin == 0) & (F.array_max("spectrum") > 0))
    return grid.select("region", "y", "x", "pixel_id").join(
        mask.select("region", "pixel_id"), ["region", "pixel_id"], "left_anti"
    )


def region_vs_rest(spectra: DataFrame, source: DataFrame, mask: DataFrame, n_mz: int, height: float = 0.0) -> DataFrame:
    sides = mask.select("region", "pixel_id", F.lit(0).alias("side")).unionByName(
        mask_complement(spectra, mask).select("region", "pixel_id", F.lit(1).alias("side"))
    )
    return region_vs_region(source, sides, n_mz, height)


def point_vs_point(spectra: DataFrame, ions: DataFrame, points: DataFrame, top: int = 200) -> DataFrame:
    """points(region, side, pixel_id): rank gain of point 1 over point 0 within each m/z, scaled to 0.5 +- 0.5.

    Ranks are wanted for two pixels only, so they are counted, not sorted: a non-zero value has all zeros and
    the smaller non-zero values below it, a zero has the zeros with a smaller pixel id below it.
    """
    chosen = spectra.join(points, ["region", "pixel_id"])
    listed = top_n_mz_pixel(chosen, top).select("region", "mz_index").distinct()
    marks = chosen.select("region", "side", "pixel_id", F.posexplode("spectrum").alias("mz_index", "intensity")).join(
        listed, ["region", "mz_index"], "left_semi"
    ).groupBy("region", "mz_index").agg(*[
        F.max(F.when(F.col("side") == s, F.struct("intensity", "pixel_id"))).alias(f"_p{s}") for s in (0, 1)
    ])
    size = spectra.groupBy("region").agg((F.max("y") + 1).alias("_h"), F.count(F.lit(1)).alias("_n"))

    def counted(s):
        mark, here = F.col(f"_p{s}"), F.struct("intensity", "pixel_id")
        before = F.when(mark["intensity"] > 0, here < mark).otherwise(F.col("pixel_id") < mark["pixel_id"])
        return F.sum(before.cast("long")).alias(f"_b{s}")

    def rank(s):
        mark, nonzero = F.col(f"_p{s}"), F.coalesce("_nonzero", F.lit(0))
        before = F.coalesce(f"_b{s}", F.lit(0))
        return F.when(mark["intensity"] > 0, F.col("_n") - nonzero + before).otherwise(mark["pixel_id"] - before)

    below = ions.select("region", "pixel_id", "mz_index", "intensity").join(marks, ["region", "mz_index"]).groupBy(
        "region", "mz_index"
    ).agg(counted(0), counted(1), F.count(F.lit(1)).alias("_nonzero"))
    return marks.join(below, ["region", "mz_index"], "left").join(size, "region").select(
        "region", "mz_index", (((rank(1) - rank(0)) / (F.col("_h") * F.col("_h")) + 1) / 2).alias("score"),
    )


def point_vs_disc(spectra: DataFrame, source: DataFrame, y: int, x: int, n_mz: int, radius: int = 3) -> DataFrame:
    """AUC of one pixel against the disc around it, for the peaks of either."""
    near = spectra.where(G.in_disc(F.col("x"), F.col("y"), x, y, radius))
    sides = near.select(
        "region", "pixel_id", F.when((F.col("y") == y) & (F.col("x") == x), 0).otherwise(1).alias("side")
    )
    return mann_whitney_u(source, sides, n_mz, mask_peaks(source, sides, n_mz)).select(
        "region", "mz_index", F.col("auc").alias("score"), "z"
    )


def category_separation(source: DataFrame, members: DataFrame, n_mz: int) -> DataFrame:
    """Edges (a, b, mz_index, score, means): a is higher with AUC above 0.6, swapped when below 0.4."""
    tested = cut_lineage(pairwise_u(source, members, n_mz).where(F.col("z") > Z_LIMIT))
    higher = tested.where(F.col("auc") > 0.6).select(
        "region", F.col("a").alias("category_a"), F.col("b").alias("category_b"), "mz_index",
        F.col("auc").alias("score"), "z", "mean_a", "mean_b",
    )
    lower = tested.where(F.col("auc") < 0.4).select(
        "region", F.col("b").alias("category_a"), F.col("a").alias("category_b"), "mz_index",
        (1 - F.col("auc")).alias("score"), "z", F.col("mean_b").alias("mean_a"), F.col("mean_a").alias("mean_b"),
    )
    return higher.unionByName(lower)


def separation_edges(
    separation: DataFrame, similarity: DataFrame, drop: list, limit: float = 0.05, per_edge: int = 3
) -> DataFrame:
    """Edges whose confusion exceeds ``limit`` with their best m/z (AUC above 0.7), background left out.

    similarity(region, category_a, category_b, confusion). An edge lists at most one m/z axis.
    """
    edges = similarity.where(
        (F.col("confusion") > limit) & ~F.col("category_a").isin(drop) & ~F.col("category_b").isin(drop)
    )
    order = Window.partitionBy("region", "category_a", "category_b").orderBy(F.desc("score"), "mz_index")
    best = separation.where((F.col("score") > 0.7) | (F.col("score") < 0.3)).withColumn(
        "rank", F.row_number().over(order)
    ).where(F.col("rank") <= per_edge)
    return edges.join(
        best.select("region", "category_a", "category_b", "mz_index", "score", "rank"),
        ["region", "category_a", "category_b"], "left",
    )


def ion_image(ions: DataFrame, pixels: DataFrame, sizes: DataFrame, mz_index: int, p: float = 0.99) -> DataFrame:
    """One m/z over all pixels, divided by its percentile and clipped to 1. The m/z predicate reaches the scan."""
    one = ions.where(F.col("mz_index") == mz_index).select("region", "pixel_id", "intensity")
    top = exact_quantiles(one, ["region"], "intensity", {"q": p}, sizes)
    return pixels.select("region", "y", "x", "pixel_id").join(one, ["region", "pixel_id"], "left").join(
        small_side(top), "region", "left"
    ).select(
        "region", "y", "x", "pixel_id",
        S.unit_ratio(F.coalesce("intensity", F.lit(0.0)), F.coalesce("q", F.lit(0.0))).alias("value"),
    )


def aggregated_ion_image(
    ions: DataFrame, pixels: DataFrame, stats: DataFrame, n: int = 5, p: float = 0.995
) -> DataFrame:
    """Mean of the max-scaled images of the n best m/z, scaled by its percentile, clipped, 0..255."""
    order = Window.partitionBy("region").orderBy(F.desc("score"), F.desc("mz_index"))
    best = stats.withColumn("_r", F.row_number().over(order)).where((F.col("_r") <= n) & (F.col("score") != 0))
    best = small_side(best.select("region", "mz_index"))
    listed = best.groupBy("region").agg(F.count(F.lit(1)).alias("_k"))
    scaled = ion_max_norm(ions.join(best, ["region", "mz_index"], "left_semi"))
    sums = scaled.groupBy("region", "pixel_id").agg(F.sum("intensity").alias("_s"))
    mean = pixels.select("region", "y", "x", "pixel_id").join(sums, ["region", "pixel_id"], "left").join(
        small_side(listed), "region", "left"  # a region without a scored m/z is black
    ).select("region", "y", "x", "pixel_id", F.coalesce(F.try_divide("_s", "_k"), F.lit(0.0)).alias("_v"))
    mean = cut_lineage(mean)
    top = exact_quantiles(mean, ["region"], "_v", {"q": p})
    return mean.join(small_side(top), "region").select(
        "region", "y", "x", "pixel_id", S.to_byte(S.unit_ratio(F.col("_v"), F.col("q"))).alias("value")
    )


def mean_ion_image(images: DataFrame) -> DataFrame:
    """Mean of several ion images (region, y, x, value), divided by the maximum of the region, 0..255."""
    mean = cut_lineage(images.groupBy("region", "y", "x").agg(F.avg("value").alias("_v")))
    top = mean.groupBy("region").agg(F.max("_v").alias("_m"))
    return mean.join(small_side(top), "region").select(
        "region", "y", "x", (F.coalesce(F.try_divide("_v", "_m"), F.lit(0.0)) * 255).cast("int").alias("value")
    )


def overlay_blend(first: DataFrame, second: DataFrame, gain: float = 1.4) -> DataFrame:
    """Half of each image, rescaled by the maximum, multiplied by a gain, clipped to 255.

    Both are (region, y, x, c0, c1, c2) with 0..255.
    """
    channels = ["c0", "c1", "c2"]
    other = second.select("region", "y", "x", *[F.col(c).alias(f"_{c}") for c in channels])
    mixed = first.join(other, ["region", "y", "x"]).select(
        "region", "y", "x", *[F.rint(F.col(c) * 0.5 + F.col(f"_{c}") * 0.5).alias(c) for c in channels]
    )
    top = mixed.groupBy("region").agg(F.max(F.greatest(*channels)).alias("_m"))
    return mixed.join(small_side(top), "region").select(
        "region", "y", "x",
        *[
            F.least(F.lit(255), (F.floor(F.col(c) / F.nullif(F.col("_m"), F.lit(0.0)) * 255) * gain).cast("int")).alias(c)
            for c in channels
        ],
    )


def spectrum_grid(stats: DataFrame, n_mz: int) -> DataFrame:
    """Cell of each m/z on a square board and the brightness of its score."""
    side = int(1 + n_mz**0.5)
    return stats.select(
        "region", "mz_index", F.floor(F.col("mz_index") / side).cast("int").alias("cell_row"),
        (F.col("mz_index") % side).alias("cell_col"), F.pow("score", F.lit(4.0)).alias("brightness"),
    )


def reversed_scores(stats: DataFrame) -> DataFrame:
    return stats.withColumn("score", 1 - F.col("score"))


__all__ = [
    "pairwise_u", "mann_whitney_u", "mask_peaks", "region_vs_region", "region_vs_rest", "mask_complement",
    "point_vs_point", "point_vs_disc", "category_separation", "separation_edges", "ion_image",
    "aggregated_ion_image", "mean_ion_image", "overlay_blend", "spectrum_grid", "reversed_scores",
]

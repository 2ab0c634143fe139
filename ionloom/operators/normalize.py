"""Normalization and contrast operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.functions.order_stats import exact_quantiles
from ionloom.model import to_ions
from ionloom.session import cut_lineage, small_side


def tic(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("spectrum", S.tic(F.col("spectrum")))


def median_norm(spectra: DataFrame) -> DataFrame:
    return spectra.withColumn("spectrum", S.median_norm(F.col("spectrum")))


def tic_ions(ions: DataFrame) -> DataFrame:
    """TIC on the long layout: one aggregate per pixel joined back on the pixel."""
    totals = ions.groupBy("region", "pixel_id").agg(F.sum("intensity").alias("_t"))
    return ions.join(totals, ["region", "pixel_id"]).withColumn(
        "intensity", F.col("intensity") / (F.col("_t") + S.TIC_EPSILON)
    ).drop("_t")


def quantile_spectrum(spectra: DataFrame, p: float) -> DataFrame:
    """(region, q ARRAY): quantile of each m/z over all pixels of a region, zeros included; one row per region."""
    sizes = spectra.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("spectrum")).alias("_bins"))
    found = exact_quantiles(to_ions(spectra), ["region", "mz_index"], "intensity", {"q": p}, sizes.drop("_bins"))
    axis = sizes.select("region", F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("mz_index"))
    entries = axis.join(found, ["region", "mz_index"], "left").select(
        "region", F.struct("mz_index", F.coalesce("q", F.lit(0.0)).alias("q")).alias("_e")
    )
    return entries.groupBy("region").agg(F.transform(F.sort_array(F.collect_list("_e")), lambda e: e["q"]).alias("q"))


def spatial_tic(spectra: DataFrame) -> DataFrame:
    """TIC, then each m/z over its 99th percentile across pixels, clipped to 1.

    The percentiles of a region are one array (one m/z axis), so spectra stay arrays and are joined per region.
    """
    normed = tic(spectra)
    return normed.join(small_side(quantile_spectrum(normed, 0.99)), "region").withColumn(
        "spectrum",
        F.zip_with("spectrum", "q", lambda v, q: F.least(F.lit(1.0), v / (q + S.TIC_EPSILON))),
    ).drop("q")


def ion_max_norm(ions: DataFrame) -> DataFrame:
    top = ions.groupBy("region", "mz_index").agg(F.max("intensity").alias("_m"))
    return ions.join(small_side(top), ["region", "mz_index"]).withColumn(
        "intensity", F.col("intensity") / F.col("_m")
    ).drop("_m")


def _clip(unit):
    return F.when(unit > 1, 1.0).when(unit < 0, 0.0).otherwise(unit)


def stack_channels(image: DataFrame, keys, channels: list[str]) -> DataFrame:
    """(keys, ch, level): one row per pixel and channel."""
    pairs = F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).cast("double").alias("level")) for c in channels])
    return image.select(*keys, F.explode(pairs).alias("_s")).select(*keys, "_s.*")


def stretch(
    image: DataFrame,
    channels: list[str],
    low: float = 0.00001,
    high: float = 0.99999,
    epsilon: float = 0.0,
    floor_first: bool = True,
    keys: tuple[str, ...] = ("region",),
    population: DataFrame | None = None,
) -> DataFrame:
    """Contrast stretch per channel: subtract the low quantile, divide by the high quantile of the result, clip.

    Shifting keeps the order, so the high quantile of the shifted data is interpolated between the shifted
    neighbours of the same rank: one quantile pass serves all channels and both ends. ``population`` counts
    further pixels of value 0 that belong to the image but are not in the table.
    """
    k = list(keys)
    ends = exact_quantiles(
        stack_channels(image, k, channels), [*k, "ch"], "level", {"lo": low, "hi": high}, population, True
    )

    def moved(end):
        gap = F.col(end) - F.col("lo")
        return F.greatest(gap, F.lit(0.0)) if floor_first else gap

    ends = ends.withColumn("top", moved("hi_a") + (moved("hi_b") - moved("hi_a")) * F.col("hi_f"))
    wide = ends.groupBy(*k).agg(
        *[F.max(F.when(F.col("ch") == c, F.col(e))).alias(f"_{e}_{c}") for c in channels for e in ("lo", "top")]
    )
    stretched = {}
    for c in channels:
        gap = F.col(c) - F.col(f"_lo_{c}")
        gap = F.greatest(gap, F.lit(0.0)) if floor_first else gap
        stretched[c] = _clip(gap / F.nullif(F.col(f"_top_{c}") + F.lit(epsilon), F.lit(0.0)))
    return image.join(small_side(wide), k).withColumns(stretched).drop(*[f"_{e}_{c}" for c in channels for e in ("lo", "top")])


def stretch_gray(image: DataFrame, channels: list[str], low: float = 0.001, high: float = 0.999,
                 keys: tuple[str, ...] = ("region",), population: DataFrame | None = None) -> DataFrame:
    return stretch(image, channels, low, high, 1e-7, keys=keys, population=population)


def stretch_umap(image: DataFrame, channels: list[str], low: float = 0.0001, high: float = 0.9999) -> DataFrame:
    return stretch(image, channels, low, high, floor_first=False)


def hist_equalize(
    image: DataFrame, channel: str, bins: int = 256, keys: tuple[str, ...] = ("region",), out: str | None = None
) -> DataFrame:
    """Histogram equalization: the cumulative share of each bin, interpolated between left bin edges, 0..bins-1.

    Counts are combined before the shuffle; the cumulative table has at most ``bins`` rows per group.
    A group holding one value spans 0.5 around it, as a histogram of one value does.
    """
    k = list(keys)
    span = image.groupBy(*k).agg(F.min(channel).alias("_a"), F.max(channel).alias("_z")).select(
        *k,
        F.when(F.col("_z") > F.col("_a"), F.col("_a")).otherwise(F.col("_a") - 0.5).alias("_a"),
        F.when(F.col("_z") > F.col("_a"), F.col("_z")).otherwise(F.col("_z") + 0.5).alias("_z"),
    )
    placed = image.join(small_side(span), k).withColumn("_at", (F.col(channel) - F.col("_a")) / (F.col("_z") - F.col("_a")) * bins)
    placed = placed.withColumn("_bin", F.least(F.floor("_at"), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(*k, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*k)
    share = counts.select(
        *k, "_bin", "_c",
        F.sum("_c").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_c").over(group).alias("_all_c"),
        F.lead("_bin").over(group.orderBy("_bin")).alias("_next_bin"),
        F.lead("_c").over(group.orderBy("_bin")).alias("_next_c"),
    ).select(
        *k, "_bin", "_upto", "_all_c",
        F.when((F.col("_bin") < bins - 1) & (F.col("_next_bin") == F.col("_bin") + 1), F.col("_next_c")).otherwise(
            F.lit(0)
        ).alias("_step"),
    )
    equalized = (F.col("_upto") + F.col("_step") * (F.col("_at") - F.col("_bin"))) / F.col("_all_c") * (bins - 1)
    return placed.join(small_side(share), [*k, "_bin"]).withColumn(out or channel, equalized).drop(
        "_a", "_z", "_at", "_bin", "_upto", "_all_c", "_step"
    )


def equalize_channels(image: DataFrame, channels: list[str], keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """8-bit equalization of each channel: (cdf - cdf_min) / (n - cdf_min) * 255, rounded half to even."""
    k = list(keys)
    levels = stack_channels(image, k, channels).groupBy(*k, "ch", "level").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*k, "ch")
    upto = F.sum("_c").over(group.orderBy("level").rowsBetween(Window.unboundedPreceding, 0))
    lut = levels.select(*k, "ch", "level", upto.alias("_u"), F.sum("_c").over(group).alias("_n"),
                        F.first("_c").over(group.orderBy("level")).alias("_f"))
    lut = lut.select(
        *k, "ch", "level",
        F.when(F.col("_n") == F.col("_f"), F.col("level")).otherwise(
            F.rint((F.col("_u") - F.col("_f")) * 255.0 / (F.col("_n") - F.col("_f")))
        ).cast("int").alias("_to"),
    )
    lut = cut_lineage(lut)
    for c in channels:
        one = lut.where(F.col("ch") == c).select(*k, F.col("level").alias(c), F.col("_to").alias(f"_{c}"))
        image = image.join(small_side(one), [*k, c]).withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return image

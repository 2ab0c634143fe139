"""From per-pixel numbers to pictures: top-3, percentile ratio, sub-segments, component painting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import color as C
from ionloom.functions import spectrum as S
from ionloom.functions.order_stats import exact_quantiles
from ionloom.operators.normalize import hist_equalize, stack_channels, stretch, stretch_gray
from ionloom.operators.peaks import RATIO_PERCENTS, sort_percentile_pick, top3_intensity
from ionloom.operators.sampling import uniform
from ionloom.session import cut_lineage, small_side

PLACE = ["region", "y", "x", "pixel_id"]


def scale_by_quantile(image: DataFrame, channels: list[str], p: float, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Each channel over its quantile, clipped to 1; one quantile pass for all channels."""
    k = list(keys)
    image = cut_lineage(image)  # a few numbers per pixel; the spectra behind them are read once
    tops = exact_quantiles(stack_channels(image, k, channels), [*k, "ch"], "level", {"q": p}).groupBy(*k).agg(
        *[F.max(F.when(F.col("ch") == c, F.col("q"))).alias(f"_q_{c}") for c in channels]
    )
    return image.join(small_side(tops), k).withColumns({
        c: S.unit_ratio(F.col(c), F.col(f"_q_{c}"))
        for c in channels
    }).drop(*[f"_q_{c}" for c in channels])


def top3_levels(spectra: DataFrame, power: float = 1.0, p: float = 0.999) -> DataFrame:
    """Three largest intensities per pixel as 0..255 levels, before any colour conversion."""
    best = top3_intensity(spectra)
    names = ["p0", "p1", "p2"]
    if power != 1:
        best = best.withColumns({n: F.pow(n, F.lit(float(power))) for n in names})
    return scale_by_quantile(best, names, p).select(
        *PLACE, *[S.to_byte(F.col(n)).alias(f"c{i}") for i, n in enumerate(names)], (F.col("p0") == 0).alias("empty")
    )


def _painted(levels: DataFrame, convert, extra: tuple[str, ...] = ()) -> DataFrame:
    """Colours of the three levels; ``convert`` gives them as one array, which is worked out once a pixel."""
    colours = convert(F.col("c0").cast("double"), F.col("c1").cast("double"), F.col("c2").cast("double"))
    return levels.withColumn("_rgb", colours).select(
        *extra, *PLACE, *[F.when(F.col("empty"), 0).otherwise(F.col("_rgb")[i]).alias(f"c{i}") for i in range(3)]
    )


def top3_rgb(spectra: DataFrame, power: float = 1.0) -> DataFrame:
    return _painted(top3_levels(spectra, power), C.lab_to_rgb)


def percentile_ratio_levels(spectra: DataFrame, p: float = 0.999) -> DataFrame:
    """Three ratios of sorted-spectrum picks as 0..255 levels."""
    picks = sort_percentile_pick(spectra, RATIO_PERCENTS, S.is_foreground(F.col("spectrum")).alias("_in")).select(
        *PLACE, *[(F.col(f"p{2 * i}") / (F.col(f"p{2 * i + 1}") + S.RATIO_EPSILON)).alias(f"r{i}") for i in range(3)],
        (~F.col("_in")).alias("empty"),
    )
    return scale_by_quantile(picks, ["r0", "r1", "r2"], p).select(
        *PLACE, *[S.to_byte(F.col(f"r{i}")).alias(f"c{i}") for i in range(3)], "empty"
    )


def percentile_ratio_rgb(spectra: DataFrame) -> DataFrame:
    return _painted(percentile_ratio_levels(spectra), C.lab_to_linear_rgb)


def percentile_ratio_gray(spectra: DataFrame, high: float = 0.999, low: float = 0.99) -> DataFrame:
    """p99.9 over p99 of each spectrum, scaled by the image's p99, 0..255."""
    ratio = spectra.withColumn("_s", F.sort_array("spectrum")).select(
        *PLACE, (S.quantile(F.col("_s"), high) / (S.quantile(F.col("_s"), low) + S.RATIO_EPSILON)).alias("value")
    )
    return scale_by_quantile(ratio, ["value"], 0.99).withColumn("value", S.to_byte(F.col("value")))


def image_of(embedding: DataFrame, spectra: DataFrame, channels: list[str], lab: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Stretch embedding channels to 0..255, optionally read them as LAB, black outside the sample.

    ``extra`` names columns that tell several pictures of a region apart.
    """
    inside = spectra.select("region", "pixel_id", "y", "x", S.is_foreground(F.col("spectrum")).alias("_in"))
    placed = embedding.join(inside, ["region", "pixel_id"])
    if lab:
        placed = placed.withColumns({c: F.when(F.col("_in"), F.col(c)).otherwise(F.lit(0.0)) for c in channels})
    levels = stretch(cut_lineage(placed), channels, keys=(*extra, "region")).select(
        *extra, *PLACE, (~F.col("_in")).alias("empty"),
        *[S.to_byte(F.coalesce(F.col(c), F.lit(0.0))).alias(f"c{i}") for i, c in enumerate(channels)],
    )
    return _painted(levels, C.lab_to_rgb if lab else lambda *c: F.array(*[v.cast("int") for v in c]), extra)


def component_scores(pixels: DataFrame, column: str = "scores") -> DataFrame:
    return pixels.select("region", "y", "x", "pixel_id", F.posexplode(column).alias("component", "score"))


def component_normalize(pixels: DataFrame, column: str = "scores", method: str = "spatial_norm",
                        factors: dict[int, float] | None = None) -> DataFrame:
    """Long (pixel, component, score) with comparable components.

    ``spatial_norm``: over the component's sum, then over its 99th percentile; otherwise over the percentile
    of all components together. Dividing by a positive number keeps the order, so the percentile of the
    sum-normalized scores is the percentile of the scores over the same sum: both come from one pass.
    """
    tall = component_scores(cut_lineage(pixels.select(*PLACE, column)), column)
    if method == "spatial_norm":
        keys = ["region", "component"]
        sums = tall.groupBy(*keys).agg(F.sum("score").alias("_s"))
        tops = exact_quantiles(tall, keys, "score", {"_q": 0.99})
        whole = F.col("_s") + S.TIC_EPSILON
        scaled = tall.join(small_side(sums.join(tops, keys)), keys).withColumn(
            "score", F.col("score") / whole / (F.col("_q") / whole + S.TIC_EPSILON)
        ).drop("_s", "_q")
    else:
        tops = exact_quantiles(tall, ["region"], "score", {"_q": 0.99})
        scaled = tall.join(small_side(tops), "region").withColumn(
            "score", F.col("score") / F.nullif(F.col("_q"), F.lit(0.0))
        ).drop("_q")
    if factors:
        table = F.create_map(*[F.lit(x) for pair in factors.items() for x in (pair[0], float(pair[1]))])
        scaled = scaled.withColumn("score", F.col("score") * F.coalesce(F.element_at(table, F.col("component")), F.lit(1.0)))
    return scaled


def component_argmax(normalized: DataFrame) -> DataFrame:
    """Label of each pixel: the component with the largest score, the first on ties."""
    return normalized.groupBy("region", "y", "x", "pixel_id").agg(
        F.max(F.struct("score", F.negative("component").alias("_neg"))).alias("_best")
    ).select("region", "y", "x", "pixel_id", F.negative("_best._neg").alias("label"), F.col("_best.score").alias("score"))


def component_paint(labels: DataFrame, colours: DataFrame) -> DataFrame:
    """Colour of the winning component (label, r, g, b 0..255) with the score as brightness."""
    value = F.floor(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)) * 255)
    strongest = F.greatest("r", "g", "b")
    return labels.join(colours, "label").select(
        *PLACE, "label",
        *[F.rint(F.col(c) / F.nullif(strongest, F.lit(0)) * value).cast("int").alias(f"c{i}") for i, c in enumerate("rgb")],
    )


def subsegment(guided: DataFrame, n: int = 5, bins: int = 2048, low: float = 0.00001, high: float = 0.99999) -> DataFrame:
    """Split each segment by a guiding value: stretch, equalize, quantize to n levels, code level + (n + 2) * label.

    guided(region, y, x, pixel_id, label, value). The stretch sees the whole image with 0 outside the segment.
    """
    guided = cut_lineage(guided)
    sizes = guided.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    keys = ("region", "label")
    stretched = stretch_gray(guided, ["value"], low, high, keys, sizes)
    level = hist_equalize(stretched, "value", bins, keys).withColumn("value", F.col("value") / (bins - 1))
    return level.withColumn("code", S.digitize(F.col("value"), 0.0, 1.0, n) + F.col("label") * (n + 2))


def guided_segment_color(guided: DataFrame, schemes: DataFrame, lut: DataFrame, bins: int = 2048) -> DataFrame:
    """Grey guiding picture (0..1) stretched inside each segment, coloured by the scheme of the segment."""
    keys = ("region", "label")
    level = hist_equalize(stretch_gray(cut_lineage(guided), ["value"], keys=keys), "value", bins, keys)
    placed = level.withColumn("level", S.to_byte(F.col("value") / (bins - 1))).join(schemes, "label")
    return C.apply_color_scheme(placed, lut).select(*PLACE, "label", "r", "g", "b")


def random_color_schemes(labels: DataFrame, low: list[str], high: list[str], ratio: float, seed: int = 0,
                         by_area: bool = False) -> DataFrame:
    """Scheme per label: ``int(ratio * k)`` labels from the low list, the rest from the high list.

    labels(label, area); by area the smallest segments come first. Labels are few.
    """
    numbered = labels.withColumn("_i", F.row_number().over(Window.orderBy(*(["area", "label"] if by_area else ["label"]))) - 1)
    k = F.count(F.lit(1)).over(Window.partitionBy())

    def pick(names):
        options = F.array(*[F.lit(n) for n in names])
        return F.element_at(options, (F.floor(uniform(seed, "_i") * len(names)) + 1).cast("int"))

    return numbered.withColumn("_k", k).select(
        "label", "area", F.when(F.col("_i") < F.floor(F.col("_k") * ratio), pick(low)).otherwise(pick(high)).alias("scheme")
    )


def component_match(components: DataFrame, centers: DataFrame) -> DataFrame:
    """Closest reference centre of each component by cosine: (region, component, center, similarity).

    Both are long (.., mz_index, value); they meet on the m/z index and are summed per pair.
    """
    c2 = components.groupBy("region", "component").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_nc"))
    r2 = centers.groupBy("center").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_nr"))
    other = centers.select("center", "mz_index", F.col("value").alias("_v"))
    dots = components.join(other, "mz_index").groupBy("region", "component", "center").agg(
        F.sum(F.col("value") * F.col("_v")).alias("_d")
    )
    scored = dots.join(c2, ["region", "component"]).join(r2, "center").withColumn(
        "similarity", F.coalesce(F.col("_d") / F.nullif(F.col("_nc") * F.col("_nr"), F.lit(0.0)), F.lit(0.0))
    )
    return scored.groupBy("region", "component").agg(
        F.max(F.struct("similarity", F.negative("center").alias("_neg"))).alias("_b")
    ).select("region", "component", F.negative("_b._neg").alias("center"), F.col("_b.similarity").alias("similarity"))


def component_drop(normalized: DataFrame, matched: DataFrame, noise_center: int) -> DataFrame:
    """Zero the component matched to the noise centre."""
    noise = matched.where(F.col("center") == noise_center).select("region", "component", F.lit(True).alias("_noise"))
    return normalized.join(small_side(noise), ["region", "component"], "left").withColumn(
        "score", F.when(F.col("_noise"), F.lit(0.0)).otherwise(F.col("score"))
    ).drop("_noise")


def center_similarity(spectra: DataFrame, center: DataFrame, mask: DataFrame) -> DataFrame:
    """One minus the cosine to a centre(region, center ARRAY) inside the mask, over its maximum, 0..255."""
    scored = spectra.join(mask.select("region", "pixel_id"), ["region", "pixel_id"], "left_semi").join(
        center, "region"
    ).select(*PLACE, (1 - S.cosine_similarity(F.col("spectrum"), F.col("center"))).alias("_v"))
    scored = cut_lineage(scored)
    top = scored.groupBy("region").agg(F.max("_v").alias("_m"))
    return scored.join(small_side(top), "region").select(
        *PLACE, S.to_byte(F.col("_v") / F.nullif(F.col("_m"), F.lit(0.0))).alias("value")
    )


def consensus_spectrum(components: DataFrame) -> DataFrame:
    """Smallest value per m/z over all listed component spectra."""
    return components.groupBy("mz_index").agg(F.min("value").alias("value"))


def consensus_peak(consensus: DataFrame, start: int, stop: int) -> DataFrame:
    """m/z with the largest consensus value in [start, stop), the first on ties."""
    return consensus.where((F.col("mz_index") >= start) & (F.col("mz_index") < stop)).agg(
        F.max(F.struct("value", F.negative("mz_index").alias("_neg"))).alias("_b")
    ).select(F.negative("_b._neg").alias("mz_index"), F.col("_b.value").alias("value"))

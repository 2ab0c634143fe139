"""Samples by hash of the row id and a seed: the same rows on any number of partitions and in every retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.session import cut_lineage, small_side


def hash_order(seed: int, *ids: str) -> Column:
    """Repeatable pseudo-random sort key (hex digest)."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def uniform(seed: int, *ids) -> Column:
    """Repeatable uniform number in [0, 1) from the row id: the first 48 bits of a digest that SQL engines share."""
    return F.conv(F.substring(hash_order(seed, *ids), 1, 12), 16, 10).cast("double") / float(1 << 48)


def random_sample(pixels: DataFrame, n: int, seed: int = 0, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """n pixels per region in hash order. Sampling is the feature.

    Each hash prefix keeps its own first n before the final pick, so no task sorts a whole region. Only ids are
    sorted; the other columns are fetched for the few drawn rows.
    """
    ids = list(dict.fromkeys([*keys, "region", "pixel_id"]))
    ordered = pixels.select(*ids).withColumn("_o", hash_order(seed, "region", "pixel_id")).withColumn(
        "_s", F.substring("_o", 1, 2)
    )
    part = Window.partitionBy(*keys, "_s").orderBy("_o")
    whole = Window.partitionBy(*keys).orderBy("_o")
    first = ordered.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
    drawn = first.withColumn("sample_index", F.row_number().over(whole) - 1).where(F.col("sample_index") < n)
    return pixels.join(small_side(drawn.select(*ids, "sample_index")), ids).select(*pixels.columns, "sample_index")


def enumerate_pixels(pixels: DataFrame, out: str = "position") -> DataFrame:
    """Consecutive numbers 0.. per region by pixel id, via block offsets instead of one window per region."""
    block = F.floor(F.col("pixel_id") / 4096)
    blocked = pixels.withColumn("_blk", block)
    counts = blocked.groupBy("region", "_blk").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("region").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("region", "_blk", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("region", "_blk").orderBy("pixel_id")
    return blocked.join(offsets, ["region", "_blk"]).withColumn(
        out, F.col("_base") + F.row_number().over(inside) - 1
    ).drop("_blk", "_base")


def sample_pairs(spectra: DataFrame, n_pairs: int = 30000, seed: int = 0) -> DataFrame:
    """min(n_pairs, foreground size) random pairs with replacement per region: (region, pair, pixel_a, pixel_b)."""
    numbered = enumerate_pixels(
        spectra.where(S.is_foreground(F.col("spectrum"))).select("region", "pixel_id")
    )
    sizes = numbered.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    drawn = sizes.select(
        "region", "_n", F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(n_pairs)) - 1)).alias("pair")
    ).select(
        "region", "pair",
        F.floor(uniform(seed, "region", "pair") * F.col("_n")).alias("_pa"),
        F.floor(uniform(seed + 1, "region", "pair") * F.col("_n")).alias("_pb"),
    )
    for side in ("a", "b"):
        ids = numbered.select("region", F.col("position").alias(f"_p{side}"), F.col("pixel_id").alias(f"pixel_{side}"))
        drawn = drawn.join(ids, ["region", f"_p{side}"])
    return drawn.select("region", "pair", "pixel_a", "pixel_b")


def coreset_probability(spectra: DataFrame) -> DataFrame:
    """q = 0.5 * (squared distance to the mean / sum of them + 1 / N) for every pixel."""
    n_and_mean = spectra.select("region", "pixel_id", F.posexplode("spectrum").alias("i", "v")).groupBy(
        "region", "i"
    ).agg(F.avg("v").alias("u"))
    mean = n_and_mean.groupBy("region").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "u"))), lambda e: e["u"]).alias("_mean")
    )
    gap = spectra.join(small_side(mean), "region").withColumn(
        "d2", S.total(F.zip_with("spectrum", "_mean", lambda a, b: (a - b) * (a - b)))
    ).select("region", "pixel_id", "d2")
    gap = cut_lineage(gap)  # one number per pixel
    whole = gap.groupBy("region").agg(F.sum("d2").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    return gap.join(small_side(whole), "region").withColumn(
        "q", (F.coalesce(F.try_divide("d2", "_sum"), F.lit(1.0) / F.col("_n")) + F.lit(1.0) / F.col("_n")) * 0.5
    ).drop("_sum", "_n")


def coreset_sample(spectra: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement proportional to q: (region, draw, pixel_id, weight = 1 / (q * n)).

    The cumulative q comes from block offsets; draws and block starts are put in one line per region (one entry
    per 4096 pixels), and a draw then meets only the pixels of the block it falls in.
    """
    q = coreset_probability(spectra).select("region", "pixel_id", "q").withColumn("_blk", F.floor(F.col("pixel_id") / 4096))
    blocks = q.groupBy("region", "_blk").agg(F.sum("q").alias("_qb"))
    upto = Window.partitionBy("region").orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    edges = blocks.select("region", "_blk", "_qb", F.sum("_qb").over(upto).alias("_end")).withColumn(
        "_start", F.col("_end") - F.col("_qb")
    )
    edges = cut_lineage(edges.select("region", "_blk", "_start", "_end"))  # one row per 4096 pixels
    draws = edges.groupBy("region").agg(F.max("_end").alias("_all")).select(
        "region", "_all", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")
    ).select("region", "draw", (uniform(seed, "region", "draw") * F.col("_all")).alias("_at"))
    line = edges.select("region", F.col("_start").alias("_at"), "_blk", F.lit(None).cast("int").alias("draw")).unionByName(
        draws.withColumn("_blk", F.lit(None).cast("long"))
    )
    so_far = Window.partitionBy("region").orderBy("_at", F.col("draw").isNotNull()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = line.select(
        "region", "draw", "_at", F.last("_blk", True).over(so_far).alias("_blk"),
        F.max(F.when(F.col("_blk").isNotNull(), F.col("_at"))).over(so_far).alias("_start"),
    ).where(F.col("draw").isNotNull()).select("region", "draw", (F.col("_at") - F.col("_start")).alias("_u"), "_blk")
    inside = Window.partitionBy("region", "_blk").orderBy("pixel_id").rowsBetween(Window.unboundedPreceding, 0)
    ranged = q.withColumn("_hi", F.sum("q").over(inside)).withColumn("_lo", F.col("_hi") - F.col("q"))
    last = F.max(F.struct("_lo", "pixel_id", "q"))
    return placed.join(ranged, ["region", "_blk"]).where(F.col("_lo") <= F.col("_u")).groupBy("region", "draw").agg(
        last.alias("_pick")
    ).select("region", "draw", "_pick.pixel_id", (F.lit(1.0) / (F.col("_pick.q") * n)).alias("weight"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight N / (k * n_c) per class."""
    counts = rows.groupBy("region", label).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("region")
    return counts.withColumn(
        "weight", F.sum("n").over(group) / (F.count(F.lit(1)).over(group) * F.col("n"))
    )


def stratified_split(rows: DataFrame, label: str = "label", test_share: float = 0.4, seed: int = 42) -> DataFrame:
    """Mark exactly round(test_share * n_c) rows of each class as test, chosen by hash order.

    The hash prefix splits a large class; offsets of the prefixes give the position in the whole class.
    """
    hashed = rows.withColumn("_o", hash_order(seed, "region", "pixel_id")).withColumn(
        "_s", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int")
    )
    counts = hashed.groupBy("region", label, "_s").agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy("region", label)
    offsets = counts.select(
        "region", label, "_s",
        F.coalesce(F.sum("_c").over(group.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_c").over(group).alias("_n"),
    )
    inside = Window.partitionBy("region", label, "_s").orderBy("_o")
    position = F.col("_base") + F.row_number().over(inside)
    return hashed.join(offsets, ["region", label, "_s"]).withColumn(
        "is_test", position <= F.round(F.col("_n") * test_share)
    ).drop("_o", "_s", "_base", "_n")


def balanced_accuracy(predictions: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Mean recall over classes of (label, prediction)."""
    recall = predictions.groupBy(*keys, "label").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("_r")
    )
    return recall.groupBy(*keys).agg(F.avg("_r").alias("balanced_accuracy"))


__all__ = [
    "hash_order", "uniform", "random_sample", "enumerate_pixels", "sample_pairs", "coreset_probability",
    "coreset_sample", "class_weights", "stratified_split", "balanced_accuracy",
]

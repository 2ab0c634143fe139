"""Data model: the same cube as one row per pixel (``spectra``) or one row per non-zero intensity (``ions``).

spectra(region, y, x, pixel_id, spectrum ARRAY<DOUBLE>, ...)
ions(region, y, x, pixel_id, mz_index, intensity), zeros left out
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXEL = ["region", "pixel_id"]


def to_ions(spectra: DataFrame, *extra: str, column: str = "spectrum") -> DataFrame:
    """Long layout. Only non-zero intensities leave the scan stage; their number is what later shuffles carry."""
    return spectra.select(
        "region", "y", "x", "pixel_id", *extra, F.posexplode(column).alias("mz_index", "intensity")
    ).where(F.col("intensity") != 0)


def tagged_ions(source: DataFrame, members: DataFrame, tag: str) -> DataFrame:
    """Ions of the pixels listed in members(region, pixel_id, <tag>).

    From ``spectra`` the pixels are chosen before they are unfolded, so the join moves whole spectra, not ions.
    """
    listed = members.select("region", "pixel_id", tag)
    if "spectrum" in source.columns:
        chosen = source.select("region", "y", "x", "pixel_id", "spectrum").join(listed, ["region", "pixel_id"])
        return to_ions(chosen, tag)
    return source.select("region", "pixel_id", "mz_index", "intensity").join(listed, ["region", "pixel_id"])


def grid_sizes(spectra: DataFrame, *keys: str) -> DataFrame:
    """Number of pixels per group: the denominator that puts the implicit zeros back."""
    return spectra.groupBy(*(keys or ("region",))).agg(F.count(F.lit(1)).alias("n"))


def _scatter(n_mz: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scatter(index: pd.Series, value: pd.Series) -> pd.Series:
        dense = np.zeros((len(index), n_mz))
        for row, (i, v) in enumerate(zip(index, value)):
            if i is not None and len(i):
                dense[row, np.asarray(i, dtype=int)] = v
        return pd.Series(list(dense))

    return scatter


def densify(ions: DataFrame, grid: DataFrame, n_mz: int) -> DataFrame:
    """Fixed-length spectra for every pixel of ``grid``, also the ones without a peak.

    One shuffle on the pixel; a pixel holds at most ``n_mz`` entries.
    """
    entries = ions.groupBy(*PIXEL).agg(F.collect_list(F.struct("mz_index", "intensity")).alias("_e"))
    return grid.join(entries, PIXEL, "left").withColumn(
        "spectrum", _scatter(n_mz)(F.col("_e.mz_index"), F.col("_e.intensity"))
    ).drop("_e")


def full_grid(extent: DataFrame) -> DataFrame:
    """Every (y, x) of regions given as (region, height, width).

    Rows are laid out first and spread over the cluster before the columns are generated,
    so one huge region is not produced by one task.
    """
    rows = extent.select(
        "region", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")
    ).repartition("region", "y")
    return rows.select(
        "region", F.col("y").cast("int").alias("y"), "width",
        F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"),
    ).select(
        "region", "y", F.col("x").cast("int").alias("x"),
        (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("pixel_id"),
    )


def union_images(*images: DataFrame) -> DataFrame:
    """Pixels of several images stacked for training."""
    result = images[0]
    for image in images[1:]:
        result = result.unionByName(image, allowMissingColumns=True)
    return result

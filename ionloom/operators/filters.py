"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.session import small_side

# Names used by the annotation convention
EMPTY_CATEGORY = "artefact"
PARENT_ALIASES = {"HPC": "HPF"}


def bin_of(mz: float, extraction_start: float, bins_per_mz: int) -> int:
    return int(bins_per_mz * (mz - extraction_start))


def mz_range_slice(ions: DataFrame, start_bin: int, end_bin: int) -> DataFrame:
    """Bins [start, end) of the long layout, re-based to 0; the range predicate reaches a Parquet scan."""
    kept = ions.where((F.col("mz_index") >= start_bin) & (F.col("mz_index") < end_bin))
    return kept.withColumn("mz_index", F.col("mz_index") - start_bin)


def spatial_subsample(pixels: DataFrame, n: int) -> DataFrame:
    return pixels.where((F.col("y") % n == 0) & (F.col("x") % n == 0))


def drop_background(spectra: DataFrame) -> DataFrame:
    return spectra.where(S.is_foreground(F.col("spectrum")))


def zero_background(spectra: DataFrame, *columns: str) -> DataFrame:
    inside = S.is_foreground(F.col("spectrum"))
    return spectra.withColumns({c: F.when(inside, F.col(c)).otherwise(F.lit(0)) for c in columns})


def mask_filter(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels of the mask. The mask carries one row per pixel, so the join has no hot key."""
    return pixels.join(mask.select("region", "y", "x").distinct(), ["region", "y", "x"], "left_semi")


def rotate90(pixels: DataFrame) -> DataFrame:
    """(y, x) -> (width - 1 - x, y); the width per region is a tiny aggregate, not a window over the region."""
    width = pixels.groupBy("region").agg(F.max("x").alias("_last"))
    turned = pixels.join(small_side(width), "region")
    others = [c for c in pixels.columns if c not in ("y", "x")]
    return turned.select(*others, (F.col("_last") - F.col("x")).alias("y"), F.col("y").alias("x"))


def clean_category(text: Column, aliases: dict[str, str] | None = None) -> Column:
    cleaned = F.regexp_replace(F.trim(text), "\n", "")
    named = F.when(cleaned == "", F.lit(EMPTY_CATEGORY)).otherwise(cleaned)
    for old, new in (aliases or {}).items():
        named = F.when(named == old, F.lit(new)).otherwise(named)
    return named


def category_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.upper(clean_category(p)) for p in parts])


def category_filter(rows: DataFrame, ignore: list[str] = (), keep: list[str] | None = None) -> DataFrame:
    if ignore:
        rows = rows.where(~F.col("category").isin(list(ignore)))
    if keep is not None:
        rows = rows.where(F.col("category").isin(list(keep)))
    return rows


def score_threshold(stats: DataFrame, threshold: float, above: bool = True) -> DataFrame:
    return stats.where(F.col("score") > threshold if above else F.col("score") < threshold)


def region_importance(scores: DataFrame, factors: dict[int, float], column: str = "scores") -> DataFrame:
    return scores.withColumn(column, S.weighted(F.col(column), factors))


def region_bonus(scores: DataFrame, additions: dict[int, float], column: str = "scores") -> DataFrame:
    """Additive variant: a constant per component, 0 where none is given."""
    table = F.create_map(*[F.lit(x) for pair in additions.items() for x in (pair[0], float(pair[1]))])
    return scores.withColumn(
        column, F.transform(column, lambda s, i: s + F.coalesce(F.element_at(table, i), F.lit(0.0)))
    )

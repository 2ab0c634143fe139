"""Distinct values of several columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(pixels: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(kind, region, value): the set of values of each named integer column, in one pass and one shuffle."""
    pairs = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).cast("int").alias("value")) for kind, c in columns.items()
    ])
    return pixels.select("region", F.explode(pairs).alias("_p")).select("_p.kind", "region", "_p.value").distinct()

"""Spectra that arrive as files go through the same column expressions as a stored cube.

Only operators that look at one pixel at a time are offered: they need no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ionloom.functions import spectrum as S
from ionloom.operators.filters import drop_background
from ionloom.operators.normalize import tic


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def summaries(spectra: DataFrame) -> DataFrame:
    """Foreground pixels with their strongest share of the total ion count and average m/z index."""
    normed = tic(drop_background(spectra))
    return normed.select(
        "region", "y", "x", "pixel_id", F.array_max("spectrum").alias("top_share"),
        S.avg_mz(F.col("spectrum")).alias("avg_mz"),
    )


def run_once(rows: DataFrame, out: str, state: str) -> None:
    """Process everything that has arrived, then stop; the state folder makes a restart continue exactly there."""
    job = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
        availableNow=True
    ).start()
    job.awaitTermination()

"""Cube tables, manifests and result sinks."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.session import bounded_rows

MANIFEST_SCHEMA = (
    "folder string, path string, start_mz double, end_mz double, bins int, nonzero boolean, "
    "mzs array<double>, id string"
)


def write_cube(spectra: DataFrame, path: str, manifest: DataFrame | None = None) -> None:
    """Parquet partitioned by region; rows of a region are spread over files by pixel block first."""
    spectra.repartition("region", F.floor(F.col("pixel_id") / 65536)).write.mode("overwrite").partitionBy(
        "region"
    ).parquet(f"{path}/spectra")
    if manifest is not None:
        write_manifest(manifest, path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/spectra")


def write_npy(spectra: DataFrame, path: str) -> None:
    """``<region>.npy`` cubes in a shared POSIX folder.

    The driver writes the file headers only; every task fills in the pixels it holds, so no cube is ever in
    one process. A repeated task writes the same bytes again.
    """
    os.makedirs(path, exist_ok=True)
    shapes = spectra.groupBy("region").agg(
        F.max("y") + 1, F.max("x") + 1, F.max(F.size("spectrum"))
    )
    for region, *shape in bounded_rows(shapes, 100_000, "regions"):
        np.lib.format.open_memmap(f"{path}/{region}.npy", mode="w+", dtype="float32", shape=tuple(shape)).flush()

    def fill(rows):
        cubes = {}
        for row in rows:
            cube = cubes.get(row.region)
            if cube is None:
                cube = cubes[row.region] = np.load(f"{path}/{row.region}.npy", mmap_mode="r+")
            cube[row.y, row.x] = row.spectrum
        for cube in cubes.values():
            cube.flush()

    spectra.select("region", "y", "x", "spectrum").foreachPartition(fill)


def write_ions(ions: DataFrame, path: str) -> None:
    """Long layout, sorted by m/z inside each file so that an m/z predicate skips row groups."""
    ions.repartition("region", F.floor(F.col("pixel_id") / 65536)).sortWithinPartitions(
        "region", "mz_index"
    ).write.mode("overwrite").partitionBy("region").parquet(f"{path}/ions")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")


def parse_manifests(texts: DataFrame, column: str = "json") -> DataFrame:
    """Manifest documents (one JSON text per extraction) to rows; documents that do not parse become null rows."""
    return texts.withColumn("m", F.from_json(F.col(column), MANIFEST_SCHEMA))


def list_extractions(texts: DataFrame, column: str = "json") -> DataFrame:
    """Display name and folder of every readable extraction; unreadable ones are left out."""
    parsed = parse_manifests(texts, column).where(F.col("m.path").isNotNull() & F.col("m.bins").isNotNull())
    prefix = F.when(F.col("m.id").isNotNull() & (F.col("m.id") != ""), F.concat("m.id", F.lit(" "))).otherwise("")
    return parsed.select(
        F.concat(prefix, F.lit("m/z "), F.col("m.start_mz").cast("string"), F.lit("-"),
                 F.col("m.end_mz").cast("string"), F.lit(" "), F.col("m.bins").cast("string"), F.lit(" bins"))
        .alias("display_name"),
        F.col("m.folder").alias("folder"),
    )


def read_mz_axis(manifests: DataFrame) -> DataFrame:
    """m/z axis per extraction: the stored list, or start, start + 1/bins, ... below end + 1 at 3 decimals."""
    steps = F.ceil((F.col("end_mz") + 1 - F.col("start_mz")) * F.col("bins")).cast("int")
    regular = F.transform(
        F.sequence(F.lit(0), steps - 1), lambda i: F.round(F.col("start_mz") + i / F.col("bins"), 3)
    )
    return manifests.select(
        "folder", F.posexplode(F.coalesce(F.col("mzs"), regular)).alias("mz_index", "mz")
    )


def run_name(text: Column) -> Column:
    """Run label without blanks and with ':' replaced."""
    return F.regexp_replace(F.regexp_replace(text, " ", ""), ":", "_")


def write_results_csv(rows: DataFrame, path: str, append: bool = True) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)


def read_results_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_factors(weights: DataFrame, components: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").partitionBy("region").parquet(f"{path}/weights")
    components.write.mode("overwrite").parquet(f"{path}/components")

"""Small cubes as DataFrames."""

import numpy as np
import pandas as pd

SCHEMA = "region int, y int, x int, pixel_id long, spectrum array<double>"


def cube_frame(spark, cubes):
    """{region: array rows x cols x m/z} -> spectra."""
    rows = []
    for region, cube in cubes.items():
        height, width, _ = cube.shape
        for y in range(height):
            for x in range(width):
                rows.append((region, y, x, y * width + x, [float(v) for v in cube[y, x]]))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["region", "y", "x", "pixel_id", "spectrum"]), SCHEMA)


def sparse_cube(rng, height, width, n_mz, zeros=0.5):
    cube = np.round(rng.gamma(2.0, 2.0, (height, width, n_mz)), 1)
    cube[rng.random(cube.shape) < zeros] = 0
    return cube

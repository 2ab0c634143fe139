"""Colour expressions. RGB is 0..255, LAB is the CIE definition for the D65 white point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.spectrum import let

# sRGB primaries to XYZ (D65), its inverse, the white point and the CIE thresholds
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
XYZ_TO_RGB = (
    (3.240479, -1.537150, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE = (0.950456, 1.0, 1.088754)
CIE_LIMIT = 0.008856
CIE_SLOPE = 7.787
CIE_KAPPA = 903.3

# Ends of the ion heat scale
HEAT_LOW = (255, 255, 255)
HEAT_HIGH = (139, 69, 19)


def _expand(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _compress(v: Column) -> Column:
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = [_expand(c / 255.0) for c in (r, g, b)]
    x, y, z = (sum(w * c for w, c in zip(row, lin)) / white for row, white in zip(RGB_TO_XYZ, WHITE))

    def f(t):
        return F.when(t > CIE_LIMIT, F.cbrt(t)).otherwise(t * CIE_SLOPE + 16 / 116)

    lightness = F.when(y > CIE_LIMIT, F.cbrt(y) * 116 - 16).otherwise(y * CIE_KAPPA)
    return lightness, (f(x) - f(y)) * 500, (f(y) - f(z)) * 200


def _lab_to_linear(lightness: Column, a: Column, b: Column) -> Column:
    """Linear red, green and blue in 0..1 as one array. Each step is worked out once and handed on, so the code
    generated for three channels stays small."""
    def back(t):
        limit = CIE_SLOPE * CIE_LIMIT + 16 / 116
        return F.when(t <= limit, (t - 16 / 116) / CIE_SLOPE).otherwise(t * t * t)

    def from_lab(lab):
        dark = lab[0] <= CIE_LIMIT * CIE_KAPPA
        y = F.when(dark, lab[0] / CIE_KAPPA).otherwise(F.pow((lab[0] + 16) / 116, F.lit(3.0)))
        fy = F.when(dark, lab[0] / CIE_KAPPA * CIE_SLOPE + 16 / 116).otherwise((lab[0] + 16) / 116)
        return let(F.array(y, fy, fy + lab[1] / 500, fy - lab[2] / 200), from_steps)

    def from_steps(t):
        return let(F.array(back(t[2]) * WHITE[0], t[0], back(t[3]) * WHITE[2]), from_xyz)

    def from_xyz(c):
        return F.array(*[F.least(F.greatest(r[0] * c[0] + r[1] * c[1] + r[2] * c[2], F.lit(0.0)), F.lit(1.0)) for r in XYZ_TO_RGB])

    return let(F.array(lightness, a, b), from_lab)


def byte_lab(l8: Column, a8: Column, b8: Column) -> tuple[Column, Column, Column]:
    """8-bit LAB (L scaled to 0..255, a and b shifted by 128) back to the CIE ranges."""
    return l8 * (100.0 / 255.0), a8 - 128.0, b8 - 128.0


def lab_to_byte(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    def clip(v):
        return F.least(F.greatest(F.rint(v), F.lit(0.0)), F.lit(255.0)).cast("int")

    return clip(lightness * (255.0 / 100.0)), clip(a + 128), clip(b + 128)


def lab_to_rgb(l8: Column, a8: Column, b8: Column) -> Column:
    """8-bit LAB to an array of 8-bit sRGB."""
    return F.transform(_lab_to_linear(*byte_lab(l8, a8, b8)), lambda c: F.rint(_compress(c) * 255).cast("int"))


def lab_to_linear_rgb(l8: Column, a8: Column, b8: Column) -> Column:
    """8-bit LAB to an array of 8-bit linear RGB."""
    return F.transform(_lab_to_linear(*byte_lab(l8, a8, b8)), lambda c: F.rint(c * 255).cast("int"))


def gray(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def ion_heat_color(level: Column) -> list[Column]:
    """Level 0..255 on the scale from white to brown, truncated."""
    return [(low + (high - low) * (level / 255.0)).cast("int") for low, high in zip(HEAT_LOW, HEAT_HIGH)]


def linear_ramps(spark: SparkSession, ends: dict[str, tuple[tuple[int, int, int], tuple[int, int, int]]]) -> DataFrame:
    """Lookup table (scheme, level, r, g, b) of straight ramps between two colours, 256 rows per scheme."""
    table = None
    for name, (low, high) in ends.items():
        ramp = spark.range(256).select(
            F.lit(name).alias("scheme"), F.col("id").cast("int").alias("level"),
            *[(F.lit(a) + (F.lit(b) - F.lit(a)) * F.col("id") / 255).cast("int").alias(n)
              for n, a, b in zip("rgb", low, high)],
        )
        table = ramp if table is None else table.unionByName(ramp)
    return table


def apply_color_scheme(image: DataFrame, lut: DataFrame) -> DataFrame:
    """Colour of (scheme, level); the table has 256 rows per scheme and is broadcast when it is small enough."""
    return image.join(lut, ["scheme", "level"])

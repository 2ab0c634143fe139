"""Polygon expressions on coordinate arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCLE_CORNERS = 50


def circle_x(cx: Column, radius: Column) -> Column:
    """x of the 50 corners that stand for a circle; the last corner closes the ring."""
    step = 2 * math.pi / (CIRCLE_CORNERS - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_CORNERS - 1)), lambda i: cx + radius * F.cos(i * F.lit(step)))


def circle_y(cy: Column, radius: Column) -> Column:
    step = 2 * math.pi / (CIRCLE_CORNERS - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(CIRCLE_CORNERS - 1)), lambda i: cy + radius * F.sin(i * F.lit(step)))


def _shifted(values: Column) -> Column:
    """Next corner of every corner, the first one after the last."""
    return F.concat(F.slice(values, F.lit(2), F.size(values) - 1), F.slice(values, 1, 1))


def edges(xs: Column, ys: Column) -> Column:
    return F.arrays_zip(
        xs.alias("xa"), ys.alias("ya"), _shifted(xs).alias("xb"), _shifted(ys).alias("yb")
    )


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula."""
    twice = F.aggregate(
        F.zip_with(
            F.zip_with(xs, _shifted(ys), lambda a, b: a * b),
            F.zip_with(_shifted(xs), ys, lambda a, b: a * b),
            lambda p, q: (p - q).cast("double"),
        ),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return F.abs(twice) / 2


def inside_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Even-odd ray test for a point, or the point lies on an edge. ``corners`` is an array of xa, ya, xb, yb."""

    def crosses(e):
        between = (e["ya"] > y) != (e["yb"] > y)
        at = e["xa"] + (y - e["ya"]) * (e["xb"] - e["xa"]) / F.nullif(e["yb"] - e["ya"], F.lit(0.0))
        return between & (x < at)

    def touches(e):
        on_line = (e["xb"] - e["xa"]) * (y - e["ya"]) == (e["yb"] - e["ya"]) * (x - e["xa"])
        return (
            on_line
            & x.between(F.least(e["xa"], e["xb"]), F.greatest(e["xa"], e["xb"]))
            & y.between(F.least(e["ya"], e["yb"]), F.greatest(e["ya"], e["yb"]))
        )

    crossings = F.size(F.filter(corners, lambda e: F.coalesce(crosses(e), F.lit(False))))
    return (crossings % 2 == 1) | F.exists(corners, touches)


def in_disc(x: Column, y: Column, cx, cy, radius: int) -> Column:
    dx, dy = x - cx, y - cy
    return dx * dx + dy * dy <= radius * radius

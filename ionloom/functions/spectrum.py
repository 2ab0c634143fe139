"""Row-local expressions over a spectrum array. They stay inside the JVM and also accept a stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards against division by zero
TIC_EPSILON = 1e-6
RATIO_EPSILON = 1e-5


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; inside a lambda it would run once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def scaled(values: Column, divisor: Column) -> Column:
    return let(divisor, lambda d: F.transform(values, lambda v: v / d))


def tic(values: Column) -> Column:
    """Total-ion-count normalization."""
    return scaled(values, total(values) + TIC_EPSILON)


def quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolated quantile of an ascending array."""

    def pick(values):
        h = (F.size(values) - 1) * F.lit(float(p))
        low = F.floor(h).cast("int")
        first = F.element_at(values, low + 1)
        return first + (F.element_at(values, F.least(low + 2, F.size(values))) - first) * (h - low)

    return let(ordered, pick)


def median_norm(values: Column) -> Column:
    return scaled(values, quantile(F.sort_array(values), 0.5) + TIC_EPSILON)


def pick_by_percent(ordered: Column, percent: float) -> Column:
    """Element at ``int(n * percent / 100)`` of an ascending array."""
    return F.element_at(ordered, F.floor(F.size(ordered) * F.lit(percent) / 100).cast("int") + 1)


def top3(values: Column) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, 3)


def mz_slice(values: Column, start_bin: int, end_bin: int) -> Column:
    return F.slice(values, start_bin + 1, end_bin - start_bin)


def is_foreground(values: Column) -> Column:
    return F.array_max(values) > 0


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))


def chebyshev_distance(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 when one side is all zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def index_moment(values: Column) -> Column:
    """Sum of intensity times m/z index."""
    index = F.sequence(F.lit(0), F.size(values) - 1)
    return total(F.zip_with(values, index, lambda v, i: v * i))


def avg_mz(values: Column) -> Column:
    """Mean over the m/z axis of normalized intensity times index; null on an empty pixel."""
    return index_moment(values) / F.nullif(total(values), F.lit(0.0)) / F.size(values)


def avg_mz_raw(values: Column) -> Column:
    return index_moment(values) / F.size(values)


def certainty(scores: Column) -> Column:
    """One minus the entropy of the scores to the base of their number; 1 when the scores are all zero.

    The entropy of values that do not quite sum to one is taken after rescaling them to one.
    """

    def spread(whole):
        parts = F.transform(scores, lambda s: F.when(s > 0, s / whole * F.ln(s / whole)).otherwise(F.lit(0.0)))
        return F.when(whole > 0, 1 + total(parts) / F.ln(F.size(scores))).otherwise(F.lit(1.0))

    return let(total(scores), spread)


def peak_share(scores: Column) -> Column:
    return F.array_max(scores) / (total(scores) + F.lit(1e-7))


def sharp_softmax(similarity: Column, sharpness: float = 50.0) -> Column:
    powers = let(
        F.array_max(similarity), lambda top: F.transform(similarity, lambda s: F.exp((s - top) * sharpness))
    )
    return let(powers, lambda p: scaled(p, total(p)))


def argmax(scores: Column) -> Column:
    """0-based index of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def weighted(scores: Column, factors: dict[int, float]) -> Column:
    """Multiply component scores by a factor per component, 1 where none is given."""
    if not factors:
        return scores
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in (pair[0], float(pair[1]))])
    return F.transform(scores, lambda s, i: s * F.coalesce(F.element_at(table, i), F.lit(1.0)))


def digitize(value: Column, low: float, high: float, n: int) -> Column:
    """Index of the bin of ``n`` evenly spaced edges: edge[i-1] <= value < edge[i]."""
    return F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(n - 1)).cast("int")


def color_code(a: Column, b: Column, c: Column, n: int) -> Column:
    return a * n * n + b * n + c


def unit_ratio(value: Column, top: Column) -> Column:
    """value / top clipped to 1; when top is 0 a positive value counts as 1 and a zero stays 0."""
    return F.when(top > 0, F.least(F.lit(1.0), value / F.nullif(top, F.lit(0.0)))).when(value > 0, 1.0).otherwise(0.0)


def to_byte(unit: Column) -> Column:
    """0..1 to 0..255, truncating."""
    return (unit * 255).cast("int")

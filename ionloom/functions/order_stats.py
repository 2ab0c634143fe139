"""Exact ranks and quantiles that never bring one group into one task.

A group such as (region, m/z) may hold a third of all rows, so ``percentile`` or a window partitioned by
the group alone would put it on one executor. Every function here splits a group by an order-preserving
bucket of the value. The bucket depends on the value only, so it needs no sampling and is the same in
every retry. Bucket totals are small (at most a few thousand rows per group), their running sum gives the
offset of each bucket, and the exact order is settled inside single buckets after equal values have been
merged by a map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.session import small_side

BUCKETS_PER_OCTAVE = 64
TIE_BLOCK = 65536


def order_bucket(value: Column) -> Column:
    """Integer that never decreases when ``value`` grows; 0 holds exactly the value 0."""
    octave = F.floor(F.log2(F.abs(value)) * BUCKETS_PER_OCTAVE) + 1100 * BUCKETS_PER_OCTAVE
    return F.when(value > 0, octave).when(value < 0, -octave).otherwise(F.lit(0)).cast("int")


def _usable(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def running_before(
    counted: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str], then_by: Sequence[str] = ()
) -> DataFrame:
    """Add ``before_<count>``: sum of the count over smaller (value, then_by) of the same group."""
    df, k = _keyed(counted, keys)
    df = df.withColumn("_bucket", order_bucket(F.col(value)))
    earlier = Window.partitionBy(*k).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*k, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts]).select(
        *k, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in counts]
    )
    inside = (
        Window.partitionBy(*k, "_bucket").orderBy(value, *then_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = df.join(offsets, [*k, "_bucket"]).select(
        *df.columns,
        *[
            (F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}")
            for c in counts
        ],
    )
    return out.drop("_bucket", "_all")


def ordered_position(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """0-based position inside the group by (value, tie). ``tie`` is an integer id.

    Equal values are split into blocks of the id, so a hot value is ranked by many tasks.
    """
    rows, k = _keyed(_usable(df, value), keys)
    rows = rows.withColumn("_block", F.floor(F.col(tie) / TIE_BLOCK))
    blocks = rows.groupBy(*k, value, "_block").agg(F.count(F.lit(1)).alias("_m"))
    offsets = running_before(blocks, k, value, ["_m"], ["_block"])
    inside = Window.partitionBy(*k, value, "_block").orderBy(tie)
    return (
        rows.join(offsets.drop("_m"), [*k, value, "_block"])
        .withColumn(out, F.col("before__m") + F.row_number().over(inside) - 1)
        .drop("_block", "before__m", "_all")
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """1-based rank, ties share the mean of their ranks. Returns one row per distinct value with its count ``t``."""
    counted = _usable(df, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t"))
    ranked = running_before(counted, keys, value, ["t"])
    return ranked.withColumn(out, F.col("before_t") + (F.col("t") + 1) / 2).drop("before_t")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    population: DataFrame | None = None,
    neighbours: bool = False,
) -> DataFrame:
    """Exact linear-interpolated quantiles, one column per entry of ``probs``.

    ``population`` holds the true group size ``n`` per (a subset of) the keys when zeros are left out of
    ``df``; values must then be non-negative. A group without any row is absent from the result: its
    quantiles are 0.

    A histogram over order buckets tells the one or two buckets each quantile falls in (two rows per quantile,
    materialized and broadcast when small); a second pass over the rows keeps just those buckets. ``neighbours`` also returns the two values around each
    quantile and the weight of the upper one (``<q>_a``, ``<q>_b``, ``<q>_f``).
    """
    rows, k = _keyed(_usable(df, value), keys)
    rows = rows.select(*k, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_b", order_bucket(F.col("_v")))
    group = Window.partitionBy(*k)
    earlier = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = rows.groupBy(*k, "_b").agg(F.count(F.lit(1)).alias("_c")).select(
        *k, "_b", "_c",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(group).alias("_seen"),
    )
    if population is None:
        hist = hist.withColumn("_n", F.col("_seen"))
    else:
        shared = [c for c in population.columns if c != "n"]
        sized = population.withColumnRenamed("n", "_n")
        hist = hist.join(sized, shared)
    wanted = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        for end, pos in ((0, low), (1, F.least(low + 1, F.col("_n") - 1))):
            wanted.append(
                F.struct(F.lit(name).alias("q"), F.lit(end).alias("end"), pos.alias("pos"), (h - low).alias("frac"))
            )
    zeros = F.col("_n") - F.col("_seen")
    need = hist.select(
        *k, "_b", "_before", "_c", zeros.alias("_zeros"), F.explode(F.array(*wanted)).alias("_w")
    ).select(
        *k, "_b", "_zeros", (F.col("_w.pos") - F.col("_zeros") - F.col("_before")).alias("_pos"), "_before", "_c",
        F.col("_w.q").alias("_q"), F.col("_w.end").alias("_end"), F.col("_w.frac").alias("_frac"),
        (F.col("_w.pos") < F.col("_zeros")).alias("_zero"),
    ).where(
        (~F.col("_zero") & F.col("_pos").between(0, F.col("_c") - 1)) | (F.col("_zero") & (F.col("_before") == 0))
    )
    need = small_side(need)
    inside = Window.partitionBy(*k, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    candidates = (
        rows.join(need.where(~F.col("_zero")).select(*k, "_b"), [*k, "_b"], "left_semi")
        .groupBy(*k, "_b", "_v").agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_first", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    )
    found = (
        need.where(~F.col("_zero")).join(candidates, [*k, "_b"])
        .where((F.col("_pos") >= F.col("_first")) & (F.col("_pos") < F.col("_first") + F.col("_m")))
        .select(*k, "_q", "_end", "_frac", "_v")
    )
    found = found.unionByName(need.where("_zero").select(*k, "_q", "_end", "_frac", F.lit(0.0).alias("_v")))

    def pick(name, end, column="_v"):
        return F.max(F.when((F.col("_q") == name) & (F.col("_end") == end), F.col(column)))

    columns = []
    for q in probs:
        a, b, f = pick(q, 0), pick(q, 1), pick(q, 0, "_frac")
        columns.append((a + (b - a) * f).alias(q))
        if neighbours:
            columns += [a.alias(f"{q}_a"), b.alias(f"{q}_b"), f.alias(f"{q}_f")]
    return found.groupBy(*k).agg(*columns).drop("_all")

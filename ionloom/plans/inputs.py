"""The given tables read as imaging data, in Spark and in SQL.

spectra  from ``embeddings``: 250 pixels per region on a 25 x 10 grid, 64 m/z bins from 300 on,
         intensity 0 for every 37th vector and for elements below -0.1, else (element + 0.1) * 100
peaks    from ``lineitem``: region by line status, grid 128 wide, m/z = 300 + 0.5 * part + discount
frames   from ``orders``, jobs from ``supplier``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_MZ = 64
WIDTH = 25
PIXELS = 250
FIRST_MZ = 300
GRID = 128


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    vec = F.col("vec_id")
    place = F.pmod(vec, F.lit(PIXELS))
    value = lambda e: F.when((vec % 37 == 0) | (e.cast("double") < -0.1), 0.0).otherwise(
        (e.cast("double") + 0.1) * 100
    )
    return table(spark, sf, "embeddings").select(
        F.floor(vec / PIXELS).cast("int").alias("region"), F.floor(place / WIDTH).cast("int").alias("y"),
        (place % WIDTH).cast("int").alias("x"), place.cast("long").alias("pixel_id"), "label",
        F.transform("embedding", value).alias("spectrum"),
    )


def axis(spark: SparkSession, sf: str) -> DataFrame:
    """(region, mz_index, mz): the axis of each region has as many entries as its spectra."""
    sized = spectra(spark, sf).groupBy("region").agg(F.max(F.size("spectrum")).alias("_n"))
    return sized.select("region", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("mz_index")).withColumn(
        "mz", (F.col("mz_index") + FIRST_MZ).cast("double")
    )


def masks(pixels: DataFrame) -> DataFrame:
    """Label 0 is side 0, label 1 is side 1."""
    return pixels.where(F.col("label").isin(0, 1)).select("region", "y", "x", "pixel_id", F.col("label").alias("side"))


def image(pixels: DataFrame) -> DataFrame:
    """A picture made of the first three bins, 20 levels per intensity unit, at most 255."""
    return pixels.select(
        "region", "y", "x", "pixel_id", "label",
        *[F.least(F.lit(255), F.floor(F.element_at("spectrum", i + 1) * 8)).cast("int").alias(f"c{i}") for i in range(3)],
    )


def block_scores(pixels: DataFrame) -> DataFrame:
    """Four component scores per pixel: summed intensity of each quarter of the axis."""
    quarter = lambda i: F.aggregate(
        F.slice("spectrum", i * 16 + 1, 16), F.lit(0.0), lambda acc, v: acc + v
    )
    return pixels.withColumn("scores", F.array(*[quarter(i) for i in range(4)]))


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("region"),
        F.floor(F.col("l_orderkey") / GRID).cast("int").alias("y"), (F.col("l_orderkey") % GRID).cast("int").alias("x"),
        (F.lit(300.0) + F.col("l_partkey") * 0.5 + F.col("l_discount")).alias("mz"),
        F.col("l_extendedprice").alias("intensity"),
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("target_index"),
        (F.lit(300.05) + F.col("p_partkey") * 0.5).alias("target_mz"),
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("t"),
        F.col("o_orderstatus").alias("region"),
    )


def scans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("scan"),
        (F.lit(300.0) + F.col("l_partkey") * 0.5 + F.col("l_discount")).alias("mz"), F.col("l_tax").alias("mobility"),
        F.col("l_extendedprice").alias("intensity"),
    )


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One chromatogram job per supplier: a 200 day, 40 m/z and 0.04 mobility window."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("job"), (key * 37 % 2000 - 1000).cast("int").alias("t0"),
        (key * 37 % 2000 - 800).cast("int").alias("t1"),
        (F.lit(300.0) + key * 53 % 900).alias("mz0"), (F.lit(340.0) + key * 53 % 900).alias("mz1"),
        F.lit(0.02).alias("k0"), F.lit(0.06).alias("k1"),
    )


def polygons(spark: SparkSession, sf: str) -> DataFrame:
    """One drawn shape per supplier, in region 0 or 1: a quadrilateral inside the grid."""
    key = F.col("s_suppkey")
    drawn = table(spark, sf, "supplier").select(
        key.alias("polygon"), (key * 7 % 18).cast("int").alias("_x"), (key * 3 % 6).cast("int").alias("_y"),
        (key % 5 + 2).cast("int").alias("_w"), (key % 3 + 1).cast("int").alias("_h"), F.col("s_nationkey").alias("_nation"),
    )
    x, y, w, h = (F.col(c) for c in ("_x", "_y", "_w", "_h"))
    return drawn.select(
        (F.col("polygon") % 2).cast("int").alias("region"), "polygon",
        F.concat(F.lit("AREA_"), (F.col("_nation") % 7).cast("string")).alias("category"),
        F.array(x, x + w, x + w + 1, x).alias("xs"), F.array(y, y, y + h, y + h).alias("ys"),
    )


# --- the same in SQL -------------------------------------------------------------------------------------

_CTES = {
    "spectra": """spectra AS (
  SELECT CAST(vec_id // 250 AS INTEGER) AS region, CAST((vec_id % 250) // 25 AS INTEGER) AS y,
         CAST(vec_id % 25 AS INTEGER) AS x, CAST(vec_id % 250 AS BIGINT) AS pixel_id, label,
         list_transform(embedding, lambda e: CASE WHEN vec_id % 37 = 0 OR CAST(e AS DOUBLE) < CAST(-0.1 AS DOUBLE)
           THEN CAST(0 AS DOUBLE) ELSE (CAST(e AS DOUBLE) + CAST(0.1 AS DOUBLE)) * 100 END) AS spectrum
  FROM embeddings)""",
    "ions": """ions AS (
  SELECT region, y, x, pixel_id, label, CAST(unnest(range(64)) AS INTEGER) AS mz_index, unnest(spectrum) AS v FROM spectra)""",
    "sums": "sums AS (SELECT region, pixel_id, sum(v) AS s, max(v) AS top FROM ions GROUP BY ALL)",
    "tic": """tic AS (
  SELECT region, y, x, pixel_id, label, mz_index, v / (CAST(1e-6 AS DOUBLE) + s) AS v
  FROM ions JOIN sums USING (region, pixel_id))""",
    "grid": "grid AS (SELECT region, count(*) AS n FROM spectra GROUP BY region)",
    "image": """image AS (
  SELECT region, y, x, pixel_id, label, CAST(least(255, floor(spectrum[1] * 8)) AS INTEGER) AS c0,
         CAST(least(255, floor(spectrum[2] * 8)) AS INTEGER) AS c1, CAST(least(255, floor(spectrum[3] * 8)) AS INTEGER) AS c2
  FROM spectra)""",
    "scores": """scores AS (
  SELECT region, y, x, pixel_id, label, CAST(mz_index // 16 AS INTEGER) AS component, sum(v) AS score
  FROM ions GROUP BY ALL)""",
    "peaks": """peaks AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS region, CAST(l_orderkey // 128 AS INTEGER) AS y,
         CAST(l_orderkey % 128 AS INTEGER) AS x,
         CAST(300 AS DOUBLE) + l_partkey * CAST(0.5 AS DOUBLE) + l_discount AS mz, l_extendedprice AS intensity
  FROM lineitem)""",
    "targets": """targets AS (
  SELECT CAST(p_partkey AS INTEGER) AS target_index,
         CAST(300.05 AS DOUBLE) + p_partkey * CAST(0.5 AS DOUBLE) AS target_mz FROM part)""",
    "frames": """frames AS (
  SELECT o_orderkey AS frame_id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS t,
         o_orderstatus AS region FROM orders)""",
    "scans": """scans AS (
  SELECT l_orderkey AS frame_id, l_linenumber AS scan,
         CAST(300 AS DOUBLE) + l_partkey * CAST(0.5 AS DOUBLE) + l_discount AS mz, l_tax AS mobility,
         l_extendedprice AS intensity FROM lineitem)""",
    "jobs": """jobs AS (
  SELECT s_suppkey AS job, s_suppkey * 37 % 2000 - 1000 AS t0, s_suppkey * 37 % 2000 - 800 AS t1,
         CAST(300 + s_suppkey * 53 % 900 AS DOUBLE) AS mz0, CAST(340 + s_suppkey * 53 % 900 AS DOUBLE) AS mz1,
         CAST(0.02 AS DOUBLE) AS k0, CAST(0.06 AS DOUBLE) AS k1 FROM supplier)""",
    "polygons": """polygons AS (
  SELECT CAST(s_suppkey % 2 AS INTEGER) AS region, s_suppkey AS polygon,
         'AREA_' || CAST(s_nationkey % 7 AS VARCHAR) AS category,
         CAST(s_suppkey * 7 % 18 AS INTEGER) AS px, CAST(s_suppkey * 3 % 6 AS INTEGER) AS py,
         CAST(s_suppkey % 5 + 2 AS INTEGER) AS w, CAST(s_suppkey % 3 + 1 AS INTEGER) AS h FROM supplier)""",
    # a quadrilateral (px,py) (px+w,py) (px+w+1,py+h) (px,py+h): left, top and bottom are straight, the right edge leans
    "covered": """covered AS (
  SELECT s.region, s.y, s.x, s.pixel_id, p.polygon, p.category, (2 * p.w + 1) * p.h / CAST(2 AS DOUBLE) AS area
  FROM spectra s JOIN polygons p ON s.region = p.region AND s.y BETWEEN p.py AND p.py + p.h AND s.x >= p.px
   AND (s.x - p.px - p.w) * p.h <= (s.y - p.py))""",
    "painted": """painted AS (
  SELECT region, y, x, pixel_id, category FROM (
    SELECT *, row_number() OVER (PARTITION BY region, pixel_id ORDER BY area, polygon DESC) AS r FROM covered) WHERE r = 1)""",
}
_NEEDS = {
    "ions": ["spectra"], "sums": ["ions"], "tic": ["sums"], "grid": ["spectra"], "image": ["spectra"],
    "scores": ["ions"], "covered": ["spectra", "polygons"], "painted": ["covered"],
}


def sql(*names: str, then: str) -> str:
    """WITH clause of the named inputs (and what they need), then the statement (may start with more CTEs)."""
    ordered: list[str] = []

    def add(name):
        for other in _NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(_CTES[n] for n in ordered) + ("\n" if not then.startswith(",") else "") + then

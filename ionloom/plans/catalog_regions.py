"""Aggregates, ranks, peaks, top-k lists and region comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.model import grid_sizes, to_ions
from ionloom.operators import aggregates as G
from ionloom.operators import compare as C
from ionloom.operators import filters
from ionloom.operators import normalize
from ionloom.operators import peaks as P
from ionloom.plans import inputs as I
from ionloom.plans.catalog_tables import ions, r6
from ionloom.plans.registry import query
from ionloom.sources import cubes

sql = I.sql

# --- SQL parts --------------------------------------------------------------------------------------------


def peaks_sql(source, keys, out):
    """Peaks of column v along mz_index."""
    k = ", ".join(keys)
    return f"""
, {out}_0 AS (SELECT {k}, mz_index, v, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS nw FROM {source} WINDOW w AS (PARTITION BY {k} ORDER BY mz_index))
, {out}_1 AS (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY mz_index) AS run FROM {out}_0)
, {out}_2 AS (SELECT {k}, run, min(mz_index) AS a, max(mz_index) AS b, any_value(v) AS v FROM {out}_1 GROUP BY {k}, run)
, {out} AS (SELECT {k}, CAST((a + b) // 2 AS INTEGER) AS mz_index, v AS height FROM (
    SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS nx FROM {out}_2 WINDOW w AS (PARTITION BY {k} ORDER BY run)) WHERE p < v AND nx < v)
"""


def u_sql(source, members):
    """Rank test of every pair of codes in ``members`` over column v of ``source``: CTE tested(region, a, b, mz_index, u, auc, z, mean_a, mean_b)."""
    return f"""
, mm AS (SELECT t.region, t.mz_index, s.code, t.v FROM {source} t JOIN {members} s USING (region, pixel_id))
, sz AS (SELECT region, code, count(*) AS n FROM {members} GROUP BY ALL)
, prs AS (SELECT a.region, a.code AS a, b.code AS b, a.n AS na, b.n AS nb FROM sz a JOIN sz b ON a.region = b.region AND a.code < b.code)
, rk AS (SELECT p.region, p.a, p.b, p.na, p.nb, m.mz_index, m.code, m.v,
    rank() OVER (PARTITION BY p.region, p.a, p.b, m.mz_index ORDER BY m.v) AS r0,
    count(*) OVER (PARTITION BY p.region, p.a, p.b, m.mz_index, m.v) AS t
    FROM prs p JOIN mm m ON m.region = p.region AND m.code IN (p.a, p.b))
, ag AS (SELECT region, a, b, mz_index, na, nb,
    sum(r0 + (t - 1) / CAST(2 AS DOUBLE)) FILTER (code = a) - na * (na + 1) / CAST(2 AS DOUBLE) AS u,
    sum(CAST(t AS DOUBLE) * t - 1) AS ties, sum(v) FILTER (code = a) / na AS mean_a, sum(v) FILTER (code = b) / nb AS mean_b
    FROM rk GROUP BY region, a, b, mz_index, na, nb)
, tested AS (SELECT region, a, b, mz_index, u, u / (na * nb) AS auc, mean_a, mean_b,
    (greatest(u, na * nb - u) - na * nb / CAST(2 AS DOUBLE) - 0.5)
    / nullif(sqrt(na * nb / CAST(12 AS DOUBLE) * (na + nb + 1 - ties / (CAST(na + nb AS DOUBLE) * (na + nb - 1)))), 0) AS z FROM ag)
"""


SIDES = ", sides AS (SELECT region, pixel_id, label AS code FROM spectra WHERE label IN (0, 1))"


def p30_sql(source, members="sides"):
    return f"""
, p30 AS (SELECT region, code, mz_index, quantile_cont(v, 0.3) AS v FROM {source} JOIN {members} USING (region, pixel_id) GROUP BY ALL)
""" + peaks_sql("p30", ["region", "code"], "pk") + ", upk AS (SELECT DISTINCT region, mz_index FROM pk)\n"


LIMIT = "1.959963984540054"


def label_sizes(pixels):
    return pixels.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates -------------------------------------------------------------------------------------------


@query("region_mean_spectrum", sql("ions", then="SELECT region, label, mz_index, round(avg(v), 6) AS mean FROM ions GROUP BY ALL"))
def region_mean_spectrum(spark, sf):
    pixels = I.spectra(spark, sf)
    return G.region_mean_spectrum(to_ions(pixels, "label"), label_sizes(pixels), I.N_MZ).select(
        "region", "label", "mz_index", r6("mean", "mean")
    )


@query("region_percentile_spectrum", sql("ions", then="""
SELECT region, label, mz_index, round(quantile_cont(v, 0.3), 6) AS p30 FROM ions GROUP BY ALL"""))
def region_percentile_spectrum(spark, sf):
    pixels = I.spectra(spark, sf)
    return G.region_percentile_spectrum(to_ions(pixels, "label"), label_sizes(pixels), I.N_MZ, 0.3).select(
        "region", "label", "mz_index", r6("q", "p30")
    )


@query("roi_mean_ratio", sql("ions", then=SIDES + p30_sql("ions") + """
, sc AS (SELECT region, pixel_id, mz_index, v / max(v) OVER (PARTITION BY region, mz_index) AS v FROM ions)
, ra AS (SELECT region, mz_index, avg(v) FILTER (code = 0) / (CAST(1e-5 AS DOUBLE) + avg(v) FILTER (code = 1)) AS score
         FROM sc JOIN sides USING (region, pixel_id) JOIN upk USING (region, mz_index) GROUP BY ALL)
SELECT region, mz_index, round(score / max(score) OVER (PARTITION BY region), 6) AS score FROM ra"""))
def roi_mean_ratio(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.region_vs_region(pixels, I.masks(pixels), I.N_MZ, method="ROI-MEANS").select(
        "region", "mz_index", r6("score", "score")
    )


@query("max_projection", sql("ions", then="""
, m AS (SELECT region, mz_index, max(v) AS m FROM ions GROUP BY ALL)
SELECT region, mz_index, round(m, 6) AS max_intensity, CAST(row_number() OVER (PARTITION BY region ORDER BY m DESC, mz_index) AS INTEGER) AS rank
FROM m QUALIFY rank <= 30"""))
def max_projection(spark, sf):
    return G.max_projection(ions(spark, sf), 30).withColumn("max_intensity", r6("max_intensity"))


@query("max_over_mz", sql("sums", then="SELECT region, pixel_id, round(top, 6) AS max_intensity FROM sums"))
def max_over_mz(spark, sf):
    return I.spectra(spark, sf).select("region", "pixel_id", r6(F.array_max("spectrum"), "max_intensity"))


@query("global_percentile", sql("ions", then="SELECT region, round(quantile_cont(v, 0.95), 6) AS q FROM ions GROUP BY region"))
def global_percentile(spark, sf):
    pixels = I.spectra(spark, sf)
    return G.global_percentile(to_ions(pixels), grid_sizes(pixels), I.N_MZ, 0.95).select("region", r6("q", "q"))


@query("avg_mz", sql("ions", "sums", then="""
SELECT region, pixel_id, round(sum(v / nullif(s, 0) * mz_index) / 64, 6) AS avg_mz, round(sum(v * mz_index) / 64, 4) AS raw
FROM ions JOIN sums USING (region, pixel_id) GROUP BY ALL"""))
def avg_mz(spark, sf):
    c = F.col("spectrum")
    return I.spectra(spark, sf).select(
        "region", "pixel_id", r6(S.avg_mz(c), "avg_mz"), r6(S.avg_mz_raw(c), "raw", 4)
    )


@query("area_by_label", sql("spectra", then="SELECT region, label, count(*) AS area FROM spectra GROUP BY ALL"))
def area_by_label(spark, sf):
    return G.area_by_label(I.spectra(spark, sf))


@query("majority_label", sql("spectra", then="""
, c AS (SELECT region, y AS component, label, count(*) AS votes FROM spectra GROUP BY ALL)
SELECT region, component, label, votes FROM c QUALIFY row_number() OVER (PARTITION BY region, component ORDER BY votes DESC, label) = 1"""))
def majority_label(spark, sf):
    return G.majority_label(I.spectra(spark, sf).withColumn("component", F.col("y")), "component", "label")


CENTERS = ", centers AS (SELECT region, label, mz_index, avg(v) AS v FROM ions GROUP BY ALL)"


def label_centers(spark, sf):
    pixels = I.spectra(spark, sf)
    return G.region_mean_spectrum(to_ions(pixels, "label"), label_sizes(pixels), I.N_MZ)


def component_peaks(spark, sf):
    return P.find_peaks(label_centers(spark, sf), ["region", "label"], "mean", 8.0).withColumnRenamed("label", "component")


FREQUENCY = CENTERS + peaks_sql("centers", ["region", "label"], "pk") + """
, freq AS (SELECT region, mz_index, count(DISTINCT label) AS seen FROM pk WHERE height >= 8 GROUP BY ALL)
"""


@query("mz_frequency", sql("ions", then=FREQUENCY + "SELECT region, mz_index, seen FROM freq"))
def mz_frequency(spark, sf):
    return G.mz_frequency(component_peaks(spark, sf))


@query("rare_mz", sql("ions", then=FREQUENCY + "SELECT region, mz_index, seen FROM freq WHERE seen < 2"))
def rare_mz(spark, sf):
    return G.rare_mz(component_peaks(spark, sf))


@query("common_mz", sql("ions", then=FREQUENCY + """
SELECT region, mz_index, seen, CAST(row_number() OVER (PARTITION BY region ORDER BY seen DESC, mz_index) AS INTEGER) AS rank FROM freq QUALIFY rank <= 20"""))
def common_mz(spark, sf):
    return G.common_mz(component_peaks(spark, sf), 20)


EDGES = """
, lab AS (SELECT region, label, count(*) AS n FROM spectra GROUP BY ALL)
, sim AS (SELECT a.region, a.label AS category_a, b.label AS category_b, (a.n * b.n % 17) / CAST(20 AS DOUBLE) AS confusion
          FROM lab a JOIN lab b ON a.region = b.region AND a.label < b.label)
"""


def similarity(pixels):
    """A confusion value per label pair of a region, derived from the label areas."""
    sizes = label_sizes(pixels)
    other = sizes.select("region", F.col("label").alias("category_b"), F.col("n").alias("_n"))
    return sizes.join(other, "region").where(F.col("label") < F.col("category_b")).select(
        "region", F.col("label").alias("category_a"), "category_b", (F.col("n") * F.col("_n") % 17 / 20.0).alias("confusion")
    )


@query("node_weight", sql("spectra", then=EDGES + """
, ends AS (SELECT region, category_a AS category, confusion FROM sim UNION ALL SELECT region, category_b, confusion FROM sim)
, w AS (SELECT region, category, sum(confusion) AS s, count(*) AS degree FROM ends GROUP BY ALL)
SELECT region, category, degree, round(s / max(s) OVER (PARTITION BY region), 6) AS weight FROM w"""))
def node_weight(spark, sf):
    return G.node_weight(similarity(I.spectra(spark, sf))).select("region", "category", "degree", r6("weight", "weight"))


@query("mean_color", sql("image", then="""
SELECT region, round(avg(c0), 6) AS c0, round(avg(c1), 6) AS c1, round(avg(c2), 6) AS c2 FROM image WHERE label = 0 GROUP BY region"""))
def mean_color(spark, sf):
    colours = G.mean_color(I.image(I.spectra(spark, sf)).where("label = 0"))
    return colours.select("region", *[r6(c, c) for c in ("c0", "c1", "c2")])


def runs(spark, sf):
    """One benchmark run per part: method, path and three metric columns."""
    return I.table(spark, sf, "part").select(
        F.col("p_type").alias("method"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"),
        (F.col("p_size") * 0.01).alias("trust"), F.col("p_retailprice").alias("seconds"),
        (F.col("p_size") % 7).cast("double").alias("rank_error"),
    )


RUN_METRICS = ["trust", "seconds", "rank_error"]


@query("metric_leaderboard", """
WITH t AS (SELECT p_type AS method, p_size * CAST(0.01 AS DOUBLE) AS trust, p_retailprice AS seconds, CAST(p_size % 7 AS DOUBLE) AS rank_error FROM part)
SELECT method, 'trust' AS metric, round(avg(trust), 6) AS mean, max(trust) AS best FROM t GROUP BY method
UNION ALL SELECT method, 'seconds', round(avg(seconds), 6), max(seconds) FROM t GROUP BY method
UNION ALL SELECT method, 'rank_error', round(avg(rank_error), 6), max(rank_error) FROM t GROUP BY method""")
def metric_leaderboard(spark, sf):
    return G.metric_leaderboard(runs(spark, sf), RUN_METRICS).withColumn("mean", r6("mean"))


@query("metric_table", """
SELECT p_type AS method, round(avg(p_size * CAST(0.01 AS DOUBLE)), 6) AS trust, round(avg(p_retailprice), 6) AS seconds,
       round(avg(p_size % 7), 6) AS rank_error FROM part GROUP BY p_type""")
def metric_table(spark, sf):
    return G.metric_table(runs(spark, sf), RUN_METRICS).select("method", *[r6(m, m) for m in RUN_METRICS])


@query("run_name", """
SELECT p_partkey, p_brand || ':' || p_type AS raw, replace(replace(p_brand || ' ' || p_type || ': k ' || p_size, ' ', ''), ':', '_') AS name FROM part""")
def run_name(spark, sf):
    return I.table(spark, sf, "part").select(
        "p_partkey", F.concat("p_brand", F.lit(":"), "p_type").alias("raw"),
        cubes.run_name(F.concat("p_brand", F.lit(" "), "p_type", F.lit(": k "), F.col("p_size").cast("string"))).alias("name"),
    )


# --- ranks and peaks --------------------------------------------------------------------------------------


@query("rank_dense_order", sql("peaks", then="""
SELECT region, y, x, mz, intensity, row_number() OVER (PARTITION BY region ORDER BY intensity, CAST(y AS BIGINT) * 1000000000 + x * 1000000 + CAST(round(mz * 100) AS BIGINT)) - 1 AS rank FROM peaks
QUALIFY count(*) OVER (PARTITION BY region, y, x, mz, intensity) = 1"""))
def rank_dense_order(spark, sf):
    raw = I.peaks(spark, sf)
    keyed = raw.withColumn(
        "tie", F.col("y").cast("long") * 1000000000 + F.col("x") * 1000000 + F.round(F.col("mz") * 100).cast("long")
    )
    ranked = P.rank_dense_order(keyed, ["region"], "intensity", "tie")
    once = keyed.groupBy("region", "y", "x", "mz", "intensity").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return ranked.join(once.drop("_n"), ["region", "y", "x", "mz", "intensity"], "left_semi").select(
        "region", "y", "x", "mz", "intensity", "rank"
    )


@query("rank_average", sql("peaks", then="""
SELECT region, intensity, count(*) AS n, round(avg(r0 + (t - 1) / CAST(2 AS DOUBLE)), 4) AS rank FROM (
  SELECT region, intensity, rank() OVER (PARTITION BY region ORDER BY intensity) AS r0, count(*) OVER (PARTITION BY region, intensity) AS t FROM peaks)
GROUP BY ALL"""))
def rank_average(spark, sf):
    ranked = P.rank_average(I.peaks(spark, sf), ["region"], "intensity")
    return ranked.groupBy("region", "intensity").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rank"), "rank", 4))


@query("pixel_rank_per_mz", sql("ions", then="""
SELECT region, mz_index, pixel_id, row_number() OVER (PARTITION BY region, mz_index ORDER BY v, pixel_id) - 1 AS rank FROM ions"""))
def pixel_rank_per_mz(spark, sf):
    dense = I.spectra(spark, sf).select("region", "pixel_id", F.posexplode("spectrum").alias("mz_index", "intensity"))
    return P.pixel_rank_per_mz(dense).select("region", "mz_index", "pixel_id", "rank")


@query("find_peaks", sql("ions", then=", src AS (SELECT region, pixel_id, mz_index, v FROM ions)" + peaks_sql("src", ["region", "pixel_id"], "pk") + """
SELECT region, pixel_id, mz_index, round(height, 6) AS height FROM pk WHERE height >= 1"""))
def find_peaks(spark, sf):
    dense = I.spectra(spark, sf).select("region", "pixel_id", F.posexplode("spectrum").alias("mz_index", "v"))
    return P.find_peaks(dense, ["region", "pixel_id"], "v", 1.0).withColumn("height", r6("height"))


@query("cumulative_cdf", sql("image", then="""
, c AS (SELECT region, c0 AS level, count(*) AS n FROM image GROUP BY ALL)
SELECT region, level, n, CAST(sum(n) OVER (PARTITION BY region ORDER BY level) AS BIGINT) AS upto FROM c"""))
def cumulative_cdf(spark, sf):
    from ionloom.functions.order_stats import running_before

    counts = I.image(I.spectra(spark, sf)).groupBy("region", F.col("c0").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return running_before(counts, ["region"], "level", ["n"]).select(
        "region", "level", "n", (F.col("before_n") + F.col("n")).alias("upto")
    )


# --- top-k ------------------------------------------------------------------------------------------------


@query("top3_intensity", sql("ions", then="""
, r AS (SELECT region, pixel_id, v, row_number() OVER (PARTITION BY region, pixel_id ORDER BY v DESC) AS r FROM ions)
SELECT region, pixel_id, round(max(v) FILTER (r = 1), 6) AS p0, round(max(v) FILTER (r = 2), 6) AS p1, round(max(v) FILTER (r = 3), 6) AS p2 FROM r GROUP BY ALL"""))
def top3_intensity(spark, sf):
    return P.top3_intensity(I.spectra(spark, sf)).select("region", "pixel_id", *[r6(c, c) for c in ("p0", "p1", "p2")])


@query("top_n_mz_pixel", sql("ions", then="""
SELECT region, pixel_id, mz_index, round(v, 6) AS intensity, CAST(row_number() OVER (PARTITION BY region, pixel_id ORDER BY v DESC, mz_index DESC) AS INTEGER) AS rank
FROM ions QUALIFY rank <= 20"""))
def top_n_mz_pixel(spark, sf):
    return P.top_n_mz_pixel(I.spectra(spark, sf), 20).withColumn("intensity", r6("intensity"))


MEAN0 = ", st AS (SELECT region, mz_index, avg(v) AS score FROM ions WHERE label = 0 GROUP BY ALL)"


def mean_scores(spark, sf):
    """Mean intensity of label 0 as the score of each m/z."""
    return label_centers(spark, sf).where("label = 0").select("region", "mz_index", F.col("mean").alias("score"))


@query("top5_scores", sql("ions", then=MEAN0 + """
SELECT region, mz_index, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY region ORDER BY score DESC, mz_index) AS INTEGER) AS rank FROM st QUALIFY rank <= 5"""))
def top5_scores(spark, sf):
    return P.top_scores(mean_scores(spark, sf), 5).withColumn("score", r6("score"))


@query("top_bottom_50", sql("ions", then=MEAN0 + """
SELECT region, mz_index, round(score, 6) AS score, 'top' AS side, CAST(row_number() OVER (PARTITION BY region ORDER BY score DESC, mz_index) AS INTEGER) AS rank FROM st QUALIFY rank <= 50
UNION ALL SELECT region, mz_index, round(score, 6), 'bottom', CAST(row_number() OVER (PARTITION BY region ORDER BY score, mz_index) AS INTEGER) AS rank FROM st QUALIFY rank <= 50"""))
def top_bottom_50(spark, sf):
    return P.top_bottom(mean_scores(spark, sf), 50).withColumn("score", r6("score"))


@query("score_threshold", sql("ions", then=MEAN0 + """
SELECT region, mz_index, round(score, 6) AS score, score > 9 AS above FROM st WHERE score > 9 OR score < 8"""))
def score_threshold(spark, sf):
    stats = mean_scores(spark, sf)
    above = filters.score_threshold(stats, 9.0).withColumn("above", F.lit(True))
    below = filters.score_threshold(stats, 8.0, above=False).withColumn("above", F.lit(False))
    return above.unionByName(below).withColumn("score", r6("score"))


@query("sort_percentile_pick", sql("ions", then="""
, r AS (SELECT region, pixel_id, v, row_number() OVER (PARTITION BY region, pixel_id ORDER BY v) AS r FROM ions)
SELECT region, pixel_id, round(max(v) FILTER (r = 64), 6) AS p0, round(max(v) FILTER (r = 64), 6) AS p1, round(max(v) FILTER (r = 64), 6) AS p2,
       round(max(v) FILTER (r = 64), 6) AS p3, round(max(v) FILTER (r = 63), 6) AS p4, round(max(v) FILTER (r = 55), 6) AS p5 FROM r GROUP BY ALL"""))
def sort_percentile_pick(spark, sf):
    return P.sort_percentile_pick(I.spectra(spark, sf)).select("region", "pixel_id", *[r6(f"p{i}", f"p{i}") for i in range(6)])


@query("centroid_contrast_top5", sql("ions", then=CENTERS + """
, d AS (SELECT a.region, a.label, b.label AS label_b, a.mz_index, a.v - b.v AS contrast FROM centers a JOIN centers b ON a.region = b.region AND a.mz_index = b.mz_index AND a.label <> b.label)
SELECT region, label, label_b, mz_index, round(contrast, 6) AS contrast, CAST(row_number() OVER (PARTITION BY region, label, label_b ORDER BY contrast DESC, mz_index) AS INTEGER) AS rank
FROM d QUALIFY rank <= 5"""))
def centroid_contrast_top5(spark, sf):
    return P.centroid_contrast(label_centers(spark, sf), 5).withColumn("contrast", r6("contrast"))


@query("component_top_peaks", sql("ions", then=CENTERS + peaks_sql("centers", ["region", "label"], "pk") + """
SELECT region, label, mz_index, round(height, 6) AS height, CAST(row_number() OVER (PARTITION BY region, label ORDER BY height DESC, mz_index) AS INTEGER) AS rank FROM pk QUALIFY rank <= 10"""))
def component_top_peaks(spark, sf):
    return P.component_top_peaks(label_centers(spark, sf), 10).withColumn("height", r6("height"))


# --- statistics -------------------------------------------------------------------------------------------


@query("mann_whitney_u", sql("ions", then=SIDES + u_sql("ions", "sides") + """
SELECT region, mz_index, round(u, 4) AS u, round(auc, 6) AS auc, round(z, 6) AS z, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM tested"""))
def mann_whitney_u(spark, sf):
    pixels = I.spectra(spark, sf)
    tested = C.mann_whitney_u(pixels, I.masks(pixels), I.N_MZ)
    return tested.select("region", "mz_index", r6("u", "u", 4), *[r6(c, c) for c in ("auc", "z", "mean_a", "mean_b")])


@query("union_peaks", sql("tic", "spectra", then=SIDES + p30_sql("tic") + "SELECT region, mz_index FROM upk"))
def union_peaks(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.mask_peaks(normalize.tic(pixels), I.masks(pixels), I.N_MZ)


@query("region_vs_region", sql("tic", "spectra", then=SIDES + p30_sql("tic") + u_sql("tic", "sides") + f"""
SELECT region, mz_index, round(auc, 6) AS score, round(u, 4) AS u, round(z, 6) AS z FROM tested JOIN upk USING (region, mz_index) WHERE z > {LIMIT}"""))
def region_vs_region(spark, sf):
    """Flagship: TIC, p30 spectra of both sides, peaks, rank test on the union of the peaks."""
    pixels = I.spectra(spark, sf)
    found = C.region_vs_region(normalize.tic(pixels), I.masks(pixels), I.N_MZ)
    return found.select("region", "mz_index", r6("score", "score"), r6("u", "u", 4), r6("z", "z"))


REST = """
, sides AS (SELECT region, pixel_id, 0 AS code FROM spectra WHERE label = 0 UNION ALL
  SELECT region, pixel_id, 1 FROM spectra JOIN sums USING (region, pixel_id) WHERE label <> 0 AND top > 0 AND y % 3 = 0 AND x % 3 = 0)
"""


@query("mask_complement", sql("spectra", "sums", then="""
SELECT region, y, x, pixel_id FROM spectra JOIN sums USING (region, pixel_id) WHERE label <> 0 AND top > 0 AND y % 3 = 0 AND x % 3 = 0"""))
def mask_complement(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.mask_complement(pixels, pixels.where("label = 0"))


@query("region_vs_rest", sql("tic", "spectra", then=REST + p30_sql("tic") + u_sql("tic", "sides") + f"""
SELECT region, mz_index, round(auc, 6) AS score, round(z, 6) AS z FROM tested JOIN upk USING (region, mz_index) WHERE z > {LIMIT}"""))
def region_vs_rest(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.region_vs_rest(pixels, normalize.tic(pixels), pixels.where("label = 0"), I.N_MZ).select(
        "region", "mz_index", r6("score", "score"), r6("z", "z")
    )


@query("point_vs_point", sql("ions", then="""
, top AS (SELECT DISTINCT region, mz_index FROM (SELECT region, mz_index, row_number() OVER (PARTITION BY region, pixel_id ORDER BY v DESC, mz_index DESC) AS r
          FROM ions WHERE pixel_id IN (5, 17)) WHERE r <= 20)
, rk AS (SELECT region, mz_index, pixel_id, row_number() OVER (PARTITION BY region, mz_index ORDER BY v, pixel_id) - 1 AS r FROM ions)
, h AS (SELECT region, max(y) + 1 AS h FROM spectra GROUP BY region)
SELECT region, mz_index, round(((max(r) FILTER (pixel_id = 17) - max(r) FILTER (pixel_id = 5)) / CAST(h * h AS DOUBLE) + 1) / 2, 6) AS score
FROM rk JOIN top USING (region, mz_index) JOIN h USING (region) GROUP BY region, mz_index, h"""))
def point_vs_point(spark, sf):
    pixels = I.spectra(spark, sf)
    points = pixels.where(F.col("pixel_id").isin(5, 17)).select(
        "region", "pixel_id", F.when(F.col("pixel_id") == 5, 0).otherwise(1).alias("side")
    )
    return C.point_vs_point(pixels, to_ions(pixels), points, 20).withColumn("score", r6("score"))


@query("point_vs_disc", sql("ions", then="""
, sides AS (SELECT region, pixel_id, CASE WHEN y = 5 AND x = 12 THEN 0 ELSE 1 END AS code FROM spectra WHERE (y - 5) * (y - 5) + (x - 12) * (x - 12) <= 9)
""" + p30_sql("ions") + u_sql("ions", "sides") + """
SELECT region, mz_index, round(auc, 6) AS score, round(z, 6) AS z FROM tested JOIN upk USING (region, mz_index)"""))
def point_vs_disc(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.point_vs_disc(pixels, pixels, 5, 12, I.N_MZ).select("region", "mz_index", r6("score", "score"), r6("z", "z"))


ALL_SIDES = ", sides AS (SELECT region, pixel_id, label AS code FROM spectra)"
SEPARATION = f"""
, sep AS (SELECT region, a AS category_a, b AS category_b, mz_index, auc AS score, z, mean_a, mean_b FROM tested WHERE z > {LIMIT} AND auc > 0.6
  UNION ALL SELECT region, b, a, mz_index, 1 - auc, z, mean_b, mean_a FROM tested WHERE z > {LIMIT} AND auc < 0.4)
"""


def separation(pixels):
    return C.category_separation(pixels, pixels.select("region", "pixel_id", F.col("label").alias("code")), I.N_MZ)


@query("category_separation", sql("ions", then=ALL_SIDES + u_sql("ions", "sides") + SEPARATION + """
SELECT region, category_a, category_b, mz_index, round(score, 6) AS score, round(z, 6) AS z, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM sep"""))
def category_separation(spark, sf):
    return separation(I.spectra(spark, sf)).select(
        "region", "category_a", "category_b", "mz_index", *[r6(c, c) for c in ("score", "z", "mean_a", "mean_b")]
    )


@query("separation_edges", sql("ions", then=ALL_SIDES + u_sql("ions", "sides") + SEPARATION + EDGES + """
, best AS (SELECT region, category_a, category_b, mz_index, score, CAST(row_number() OVER (PARTITION BY region, category_a, category_b ORDER BY score DESC, mz_index) AS INTEGER) AS rank
           FROM sep WHERE score > 0.7 OR score < 0.3 QUALIFY rank <= 3)
SELECT region, category_a, category_b, round(confusion, 6) AS confusion, mz_index, round(score, 6) AS score, rank
FROM sim LEFT JOIN best USING (region, category_a, category_b) WHERE confusion > 0.05 AND category_a <> 9 AND category_b <> 9"""))
def separation_edges(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.separation_edges(separation(pixels), similarity(pixels), [9]).select(
        "region", "category_a", "category_b", r6("confusion", "confusion"), "mz_index", r6("score", "score"), "rank"
    )


@query("ion_image", sql("ions", then="""
, one AS (SELECT region, y, x, v FROM ions WHERE mz_index = 5)
, q AS (SELECT region, quantile_cont(v, 0.99) AS q FROM one GROUP BY region)
SELECT region, y, x, round(least(1, v / q), 6) AS value FROM one JOIN q USING (region)"""))
def ion_image(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.ion_image(to_ions(pixels), pixels, grid_sizes(pixels), 5).select("region", "y", "x", r6("value", "value"))


def aggregated_sql(p):
    return MEAN0 + f"""
, best AS (SELECT region, mz_index FROM st WHERE score <> 0 QUALIFY row_number() OVER (PARTITION BY region ORDER BY score DESC, mz_index DESC) <= 5)
, sc AS (SELECT region, pixel_id, mz_index, v / max(v) OVER (PARTITION BY region, mz_index) AS v FROM ions)
, im AS (SELECT region, pixel_id, avg(v) AS v FROM sc JOIN best USING (region, mz_index) GROUP BY ALL)
, q AS (SELECT region, quantile_cont(v, {p}) AS q FROM im GROUP BY region)
SELECT region, pixel_id, CAST(trunc(least(1, v / q) * 255) AS INTEGER) AS value FROM im JOIN q USING (region)"""


@query("aggregated_ion_image", sql("ions", then=aggregated_sql(0.995)))
def aggregated_ion_image(spark, sf):
    pixels = I.spectra(spark, sf)
    return C.aggregated_ion_image(to_ions(pixels), pixels, mean_scores(spark, sf)).select("region", "pixel_id", "value")


@query("mean_ion_image", sql("ions", then="""
, m AS (SELECT region, y, x, avg(v) AS v FROM ions WHERE mz_index IN (3, 5, 8) GROUP BY ALL)
SELECT region, y, x, CAST(trunc(v / max(v) OVER (PARTITION BY region) * 255) AS INTEGER) AS value FROM m"""))
def mean_ion_image(spark, sf):
    picked = I.spectra(spark, sf).select(
        "region", "y", "x", F.explode(F.array(*[F.element_at("spectrum", i + 1) for i in (3, 5, 8)])).alias("value")
    )
    return C.mean_ion_image(picked)


@query("overlay_blend", sql("image", then="""
, m AS (SELECT region, y, x, round_even(c0 * 0.5 + c2 * 0.5, 0) AS a, round_even(c1 * CAST(0.5 AS DOUBLE) + c1 * 0.5, 0) AS b, round_even(c2 * 0.5 + c0 * 0.5, 0) AS c FROM image)
, t AS (SELECT region, max(greatest(a, b, c)) AS t FROM m GROUP BY region)
SELECT region, y, x, CAST(least(255, trunc(floor(CAST(a AS DOUBLE) / t * 255) * CAST(1.4 AS DOUBLE))) AS INTEGER) AS c0,
       CAST(least(255, trunc(floor(CAST(b AS DOUBLE) / t * 255) * CAST(1.4 AS DOUBLE))) AS INTEGER) AS c1,
       CAST(least(255, trunc(floor(CAST(c AS DOUBLE) / t * 255) * CAST(1.4 AS DOUBLE))) AS INTEGER) AS c2 FROM m JOIN t USING (region)"""))
def overlay_blend(spark, sf):
    first = I.image(I.spectra(spark, sf))
    second = first.select("region", "y", "x", F.col("c2").alias("c0"), "c1", F.col("c0").alias("c2"))
    return C.overlay_blend(first, second)


@query("spectrum_grid", sql("ions", then=MEAN0 + """
SELECT region, mz_index, CAST(mz_index // 9 AS INTEGER) AS cell_row, CAST(mz_index % 9 AS INTEGER) AS cell_col,
       round(pow(1 - score / 100, 4), 6) AS brightness FROM st"""))
def spectrum_grid(spark, sf):
    unit = mean_scores(spark, sf).withColumn("score", F.col("score") / 100)
    return C.spectrum_grid(C.reversed_scores(unit), I.N_MZ).withColumn("brightness", r6("brightness"))



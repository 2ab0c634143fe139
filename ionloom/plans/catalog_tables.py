"""Sources, filters, binning, normalization and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.model import densify, to_ions, union_images
from ionloom.operators import binning, filters, joins, normalize, setops
from ionloom.plans import inputs as I
from ionloom.plans.registry import query
from ionloom.sources import annotations as A, cubes

sql = I.sql


def r6(column, name=None, digits=6):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits).alias(name) if name else F.round(column, digits)


def ions(spark, sf):
    return to_ions(I.spectra(spark, sf), "label")


# --- sources ----------------------------------------------------------------------------------------------


def manifests(spark, sf):
    """One extraction manifest per supplier as JSON text; every third stores its own m/z list, every seventh is broken."""
    key = F.col("s_suppkey")
    rows = I.table(spark, sf, "supplier").select(
        key.alias("_k"),
        F.struct(
            F.concat(F.lit("/data/"), F.col("s_name")).alias("folder"), F.concat(F.lit("/raw/"), F.col("s_name")).alias("path"),
            F.lit(300.0).alias("start_mz"), (F.lit(300.0) + key % 5).alias("end_mz"),
            (F.col("s_nationkey") % 5 + 1).cast("int").alias("bins"), (key % 3 == 0).alias("nonzero"),
            F.when(key % 3 == 0, F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: key + i * 0.25)).alias("mzs"),
            F.concat(F.lit("S"), key.cast("string")).alias("id"),
        ).alias("_m"),
    )
    return rows.select(F.when(F.col("_k") % 7 == 0, F.lit("not a manifest")).otherwise(F.to_json("_m")).alias("json"))


@query("list_extractions", """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) || ' m/z 300.0-' || CAST(CAST(300 + s_suppkey % 5 AS DOUBLE) AS VARCHAR)
       || ' ' || CAST(s_nationkey % 5 + 1 AS VARCHAR) || ' bins' AS display_name, '/data/' || s_name AS folder
FROM supplier WHERE s_suppkey % 7 <> 0""")
def list_extractions(spark, sf):
    return cubes.list_extractions(manifests(spark, sf))


@query("read_mz_axis", """
WITH m AS (SELECT *, s_nationkey % 5 + 1 AS bins, CAST(300 + s_suppkey % 5 AS DOUBLE) AS last FROM supplier WHERE s_suppkey % 7 <> 0),
stored AS (SELECT '/data/' || s_name AS folder, i AS mz_index, s_suppkey + i * CAST(0.25 AS DOUBLE) AS mz
           FROM m, range(5) t(i) WHERE s_suppkey % 3 = 0),
regular AS (SELECT '/data/' || s_name AS folder, i AS mz_index, round(300 + i / CAST(bins AS DOUBLE), 3) AS mz
            FROM m, range(40) t(i) WHERE s_suppkey % 3 <> 0 AND i < ceil((last + 1 - 300) * bins))
SELECT folder, CAST(mz_index AS INTEGER) AS mz_index, CAST(mz AS DOUBLE) AS mz FROM stored
UNION ALL SELECT folder, CAST(mz_index AS INTEGER), CAST(mz AS DOUBLE) FROM regular""")
def read_mz_axis(spark, sf):
    parsed = cubes.parse_manifests(manifests(spark, sf)).where(F.col("m.path").isNotNull()).select("m.*")
    return cubes.read_mz_axis(parsed)


def annotation_documents(spark, sf):
    """One annotation document per order with a shape per line item; every other document has the outer wrapper."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_tax", "l_discount")
    line = I.table(spark, sf, "lineitem").select(*columns).repartition("l_orderkey")  # plain columns move, shapes are made behind
    kind = F.col("l_linenumber") % 3
    x, y, q = F.col("l_partkey") % 100, F.col("l_suppkey") % 100, F.col("l_quantity")
    shape = F.struct(
        F.when(kind == 0, "circle").when(kind == 1, "ellipse").otherwise("polygon").alias("name"),
        F.when(kind < 2, x.cast("double")).alias("cx"), F.when(kind < 2, y.cast("double")).alias("cy"),
        F.when(kind == 0, q).alias("r"), F.when(kind == 1, q).alias("rx"),
        F.when(kind == 2, F.array(x, x + q, x)).alias("all_points_x"),
        F.when(kind == 2, F.array(y, y, y + q)).alias("all_points_y"),
    )
    attributes = F.create_map(
        F.lit("main_cat1"), F.concat(F.lit(" "), F.lower("l_returnflag")), F.lit("Allen_name"), F.col("l_linestatus"),
        F.lit("sub_cat2"), F.when(F.col("l_tax") == 0, " ").otherwise("t"),
        F.lit("anatomy"), F.col("l_returnflag"), F.lit("category"), F.when(F.col("l_discount") == 0, "").otherwise("d"),
    )
    region = F.to_json(F.struct(shape.alias("shape_attributes"), attributes.alias("region_attributes")))
    shapes = line.select("l_orderkey", region.alias("region")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("region"), ",").alias("regions"))
    key = F.concat((F.col("l_orderkey") % 4).cast("string"), F.lit("_"), F.col("l_orderkey").cast("string"), F.lit(".png"))
    named = F.coalesce(key, F.raise_error(F.lit("a line item without an order")).cast("string"))
    document = F.concat(F.lit('{"'), named, F.lit('":{"regions":['), F.col("regions"), F.lit("]}}"))
    return shapes.select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_orderkey") % 2 == 0, document).otherwise(
            F.concat(F.lit('{"' + A.WRAPPER_KEY + '":'), document, F.lit("}"))
        ).alias("json"),
    )


@query("read_annotations", """
SELECT CAST(l_orderkey % 4 AS VARCHAR) || '_' || CAST(l_orderkey AS VARCHAR) || '.png' AS image_key,
       upper(l_returnflag) || '_' || l_linestatus || '_' || CASE WHEN l_tax = 0 THEN 'ARTEFACT' ELSE 'T' END AS category,
       CASE WHEN l_linenumber % 3 = 2 THEN 3 ELSE 50 END AS corners,
       round(CASE WHEN l_linenumber % 3 = 2 THEN l_partkey % 100 + l_quantity ELSE l_partkey % 100 + l_quantity END, 4) AS right_edge
FROM lineitem WHERE l_orderkey % 4 = 1 AND NOT (l_returnflag = 'N' AND l_linestatus = 'F' AND l_tax = 0)""")
def read_annotations(spark, sf):
    return A.read_annotations(annotation_documents(spark, sf), 1, ignore=["N_F_ARTEFACT"]).select(
        "image_key", "category", F.size("xs").alias("corners"), r6(F.array_max("xs"), "right_edge", 4)
    )


@query("read_annotation_table", """
SELECT CAST(l_orderkey % 4 AS VARCHAR) || '_' || CAST(l_orderkey AS VARCHAR) || '.png' AS image_key, l_returnflag AS anatomy,
       CASE WHEN l_discount = 0 THEN 'artefact' ELSE 'd' END AS category, '' AS subcategory, count(*) AS shapes
FROM lineitem GROUP BY ALL""")
def read_annotation_table(spark, sf):
    return A.read_annotation_table(annotation_documents(spark, sf)).groupBy(
        "image_key", "anatomy", "category", "subcategory"
    ).agg(F.count(F.lit(1)).alias("shapes"))


@query("new_annotation_files", """
SELECT DISTINCT CAST(l_orderkey % 4 AS VARCHAR) || '_' || CAST(l_orderkey AS VARCHAR) || '.png' AS image_key
FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def new_annotation_files(spark, sf):
    documents = annotation_documents(spark, sf).where("order_id IS NOT NULL")  # both sides read the same shuffled line items
    earlier = I.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"))
    return A.new_annotation_files(documents, documents.join(earlier, "order_id", "left_semi"))


@query("shared_annotation_files", """
SELECT DISTINCT CAST(l_orderkey % 4 AS VARCHAR) || '_' || CAST(l_orderkey AS VARCHAR) || '.png' AS image_key
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def shared_annotation_files(spark, sf):
    documents = annotation_documents(spark, sf).where("order_id IS NOT NULL")  # both sides read the same shuffled line items
    earlier = I.table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("order_id"))
    return A.shared_annotation_files(documents, documents.join(earlier, "order_id", "left_semi"))


# --- filters and projections ------------------------------------------------------------------------------


@query("mz_range_slice", sql("ions", then="""
SELECT region, pixel_id, mz_index - 10 AS mz_index, round(v, 6) AS intensity FROM ions WHERE mz_index >= 10 AND mz_index < 40 AND v <> 0"""))
def mz_range_slice(spark, sf):
    start, stop = filters.bin_of(310, 300, 1), filters.bin_of(340, 300, 1)
    return filters.mz_range_slice(ions(spark, sf), start, stop).select(
        "region", "pixel_id", "mz_index", r6("intensity", "intensity")
    )


@query("mz_range_slice_array", sql("spectra", then="""
SELECT region, pixel_id, round(list_sum(spectrum[11:40]), 6) AS total, CAST(len(spectrum[11:40]) AS INTEGER) AS n_bins FROM spectra"""))
def mz_range_slice_array(spark, sf):
    part = S.mz_slice(F.col("spectrum"), 10, 40)
    return I.spectra(spark, sf).select("region", "pixel_id", r6(S.total(part), "total"), F.size(part).alias("n_bins"))


@query("spatial_subsample", sql("spectra", then="SELECT region, y, x, pixel_id FROM spectra WHERE y % 3 = 0 AND x % 3 = 0"))
def spatial_subsample(spark, sf):
    return filters.spatial_subsample(I.spectra(spark, sf), 3).select("region", "y", "x", "pixel_id")


@query("background_mask", sql("sums", then="SELECT region, pixel_id FROM sums WHERE top > 0"))
def background_mask(spark, sf):
    return filters.drop_background(I.spectra(spark, sf)).select("region", "pixel_id")


@query("background_zero", sql("sums", "image", then="""
SELECT region, pixel_id, CASE WHEN top > 0 THEN 255 - c0 ELSE 0 END AS value FROM image JOIN sums USING (region, pixel_id)"""))
def background_zero(spark, sf):
    pixels = I.spectra(spark, sf)
    inverted = pixels.join(I.image(pixels).select("region", "pixel_id", (255 - F.col("c0")).alias("value")), ["region", "pixel_id"])
    return filters.zero_background(inverted, "value").select("region", "pixel_id", "value")


@query("mask_filter", sql("ions", then="""
SELECT region, pixel_id, count(*) FILTER (v <> 0) AS n_peaks FROM ions WHERE label = 0 GROUP BY ALL"""))
def mask_filter(spark, sf):
    pixels = I.spectra(spark, sf)
    inside = filters.mask_filter(pixels, pixels.where("label = 0"))
    return inside.select("region", "pixel_id", F.size(F.filter("spectrum", lambda v: v != 0)).cast("long").alias("n_peaks"))


@query("rotate90", sql("spectra", then="""
SELECT region, pixel_id, CAST((max(x) OVER (PARTITION BY region)) - x AS INTEGER) AS y, y AS x FROM spectra"""))
def rotate90(spark, sf):
    return filters.rotate90(I.spectra(spark, sf).select("region", "y", "x", "pixel_id"))


@query("category_key", """
SELECT l_orderkey, l_linenumber, l_partkey, upper(l_returnflag) || '_' || CASE WHEN l_tax = 0 THEN 'ARTEFACT' ELSE 'HPC' END AS category,
       CASE WHEN l_tax = 0 THEN 'artefact' ELSE 'HPF' END AS parent FROM lineitem""")
def category_key(spark, sf):
    raw = F.when(F.col("l_tax") == 0, F.lit(" \n ")).otherwise(F.lit(" HPC\n"))
    cleaned = F.regexp_replace(raw, "\n", " ")
    return I.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        filters.category_key(F.concat(F.lit(" "), F.lower("l_returnflag")), cleaned).alias("category"),
        filters.clean_category(cleaned, filters.PARENT_ALIASES).alias("parent"),
    )


@query("category_filter", """
SELECT p_brand AS category, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')
  AND p_brand IN ('Brand#1', 'Brand#3', 'Brand#4', 'Brand#17') GROUP BY ALL""")
def category_filter(spark, sf):
    rows = I.table(spark, sf, "part").select(F.col("p_brand").alias("category"))
    kept = filters.category_filter(rows, ["Brand#1", "Brand#2"], ["Brand#1", "Brand#3", "Brand#4", "Brand#17"])
    return kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("region_importance", sql("scores", then="""
SELECT region, pixel_id, component, round(score * CASE component WHEN 0 THEN 0.5 WHEN 2 THEN 2.0 ELSE 1.0 END, 6) AS score,
       round(score + CASE component WHEN 1 THEN -0.4 WHEN 2 THEN 0.2 ELSE 0.0 END, 6) AS shifted FROM scores"""))
def region_importance(spark, sf):
    base = I.block_scores(I.spectra(spark, sf))
    weighted = filters.region_importance(base.withColumn("shifted", F.col("scores")), {0: 0.5, 2: 2.0})
    both = filters.region_bonus(weighted, {1: -0.4, 2: 0.2}, "shifted")
    return both.select(
        "region", "pixel_id", F.posexplode(F.arrays_zip("scores", "shifted")).alias("component", "_s")
    ).select("region", "pixel_id", "component", r6("_s.scores", "score"), r6("_s.shifted", "shifted"))


# --- binning ----------------------------------------------------------------------------------------------

BINNED = """
, binned AS (SELECT region, y, x, CAST(round_even((CAST(CAST(mz AS FLOAT) AS DOUBLE) - {start}) * 5, 0) AS INTEGER) AS mz_index, intensity FROM peaks)
"""


@query("bin_peaks", sql("peaks", then=BINNED.format(start="300") + """
SELECT region, y, x, mz_index, round(sum(intensity), 4) AS intensity FROM binned WHERE mz_index BETWEEN 0 AND 5004 GROUP BY ALL"""))
def bin_peaks(spark, sf):
    return binning.bin_peaks(I.peaks(spark, sf), 300, 1300, 5).withColumn("intensity", r6("intensity", digits=4))


@query("bin_auto_range", sql("peaks", then="""
, span AS (SELECT region, CAST(min(CAST(mz AS FLOAT)) AS DOUBLE) AS lo, CAST(max(CAST(mz AS FLOAT)) AS DOUBLE) AS hi FROM peaks GROUP BY region)
, binned AS (SELECT region, y, x, intensity, CAST(round_even((CAST(CAST(mz AS FLOAT) AS DOUBLE) - lo) * 5, 0) AS INTEGER) AS mz_index,
             round_even(hi - lo + 1, 0) * 5 AS n FROM peaks JOIN span USING (region))
SELECT region, y, x, mz_index, round(sum(intensity), 4) AS intensity FROM binned WHERE mz_index BETWEEN 0 AND n - 1 GROUP BY ALL"""))
def bin_auto_range(spark, sf):
    return binning.bin_auto_range(I.peaks(spark, sf), 5).withColumn("intensity", r6("intensity", digits=4))


@query("bin_nonzero", sql("peaks", then="""
, q AS (SELECT region, y, x, CAST(round_even(CAST(CAST(mz AS FLOAT) AS DOUBLE) * 5, 0) AS BIGINT) AS q, intensity FROM peaks)
, axis AS (SELECT region, q, CAST(row_number() OVER (PARTITION BY region ORDER BY q) - 1 AS INTEGER) AS mz_index FROM (SELECT DISTINCT region, q FROM q))
SELECT region, y, x, mz_index, round(q / CAST(5 AS DOUBLE), 6) AS mz, round(sum(intensity), 4) AS intensity
FROM q JOIN axis USING (region, q) GROUP BY ALL"""))
def bin_nonzero(spark, sf):
    return binning.bin_nonzero(I.peaks(spark, sf), 5).withColumn("intensity", r6("intensity", digits=4))


@query("match_mz_list", sql("peaks", "targets", then="""
SELECT region, y, x, target_index, round(sum(intensity), 4) AS intensity FROM peaks JOIN targets
ON mz >= target_mz - CAST(0.03 AS DOUBLE) AND mz <= target_mz + CAST(0.03 AS DOUBLE) GROUP BY ALL"""))
def match_mz_list(spark, sf):
    return binning.match_mz_list(I.peaks(spark, sf), I.targets(spark, sf), 0.03).select(
        "region", "y", "x", "target_index", r6("intensity", "intensity", 4)
    )


@query("tolerance_window_sum", sql("peaks", then="""
, axis AS (SELECT CAST(i AS INTEGER) AS mz_index, round(300 + i * CAST(0.5 AS DOUBLE), 3) AS g FROM range(2002) t(i))
SELECT region, y, x, mz_index, g AS mz, round(sum(intensity), 4) AS intensity FROM peaks JOIN axis
ON mz >= g - CAST(0.041 AS DOUBLE) AND mz <= g + CAST(0.041 AS DOUBLE) GROUP BY ALL"""))
def tolerance_window_sum(spark, sf):
    grid = binning.mz_grid(spark, 300, 1300, 2)
    return binning.tolerance_window_sum(I.peaks(spark, sf), grid, 0.041).withColumn("intensity", r6("intensity", digits=4))


@query("coord_rebase", sql("peaks", then="""
, p AS (SELECT DISTINCT region, y + 7 AS y, x + 3 AS x FROM peaks)
, e AS (SELECT region, min(y) AS y0, min(x) AS x0, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width FROM p GROUP BY region)
SELECT region, y - y0 AS y, x - x0 AS x, height, width FROM p JOIN e USING (region)"""))
def coord_rebase(spark, sf):
    shifted = I.peaks(spark, sf).select("region", (F.col("y") + 7).alias("y"), (F.col("x") + 3).alias("x")).distinct()
    return binning.coord_rebase(shifted)


@query("densify_spectrum", sql("ions", then="SELECT region, pixel_id, mz_index, round(v, 6) AS intensity FROM ions"))
def densify_spectrum(spark, sf):
    pixels = I.spectra(spark, sf)
    dense = densify(to_ions(pixels), pixels.select("region", "y", "x", "pixel_id"), I.N_MZ)
    return dense.select("region", "pixel_id", F.posexplode("spectrum").alias("mz_index", "v")).select(
        "region", "pixel_id", "mz_index", r6("v", "intensity")
    )


@query("region_frames", sql("frames", then="""
SELECT region, count(*) AS n_frames, min(frame_id) AS first_frame FROM frames GROUP BY region"""))
def region_frames(spark, sf):
    return binning.region_frames(I.frames(spark, sf))


@query("scan_concat", sql("scans", then="""
SELECT frame_id, CAST(count(*) AS INTEGER) AS n_peaks, round(sum(intensity), 4) AS total, round(min_by(mz, (scan, mz, intensity)), 6) AS first_mz
FROM scans GROUP BY frame_id"""))
def scan_concat(spark, sf):
    joined = binning.scan_concat(I.scans(spark, sf))
    return joined.select(
        "frame_id", F.size("peaks").alias("n_peaks"), r6(S.total(F.col("peaks.intensity")), "total", 4),
        r6(F.element_at("peaks.mz", 1), "first_mz"),
    )


@query("ion_chromatogram", sql("scans", "frames", "jobs", then="""
SELECT job, frame_id, round(sum(intensity), 4) AS intensity FROM jobs JOIN frames ON t BETWEEN t0 AND t1 JOIN scans USING (frame_id)
WHERE mz BETWEEN mz0 AND mz1 AND mobility BETWEEN k0 AND k1 GROUP BY ALL"""))
def ion_chromatogram(spark, sf):
    traced = binning.ion_chromatogram(I.scans(spark, sf), I.frames(spark, sf), I.jobs(spark, sf))
    return traced.select("job", "frame_id", r6("intensity", "intensity", 4))


@query("compare_extractions", sql("peaks", then="""
, fine AS (SELECT region, sum(intensity) AS i FROM peaks GROUP BY region, y, x, round_even((CAST(CAST(mz AS FLOAT) AS DOUBLE) - 300) * 5, 0))
, coarse AS (SELECT region, sum(intensity) AS i FROM peaks GROUP BY region, y, x, round_even(CAST(CAST(mz AS FLOAT) AS DOUBLE) - 300, 0))
SELECT region, round(a.m, 4) AS max_a, round(a.u, 4) AS mean_a, round(b.m, 4) AS max_b, round(b.u, 4) AS mean_b
FROM (SELECT region, max(i) AS m, avg(i) AS u FROM fine GROUP BY region) a
JOIN (SELECT region, max(i) AS m, avg(i) AS u FROM coarse GROUP BY region) b USING (region)"""))
def compare_extractions(spark, sf):
    raw = I.peaks(spark, sf)
    both = binning.compare_extractions(binning.bin_peaks(raw, 300, 1300, 5), binning.bin_peaks(raw, 300, 1300, 1))
    return both.select("region", *[r6(c, c, 4) for c in ("max_a", "mean_a", "max_b", "mean_b")])


# --- normalization ----------------------------------------------------------------------------------------


@query("tic", sql("tic", then="SELECT region, pixel_id, mz_index, round(v, 9) AS intensity FROM tic WHERE v <> 0"))
def tic(spark, sf):
    return to_ions(normalize.tic(I.spectra(spark, sf))).select("region", "pixel_id", "mz_index", r6("intensity", "intensity", 9))


@query("tic_long", sql("tic", then="SELECT region, pixel_id, mz_index, round(v, 9) AS intensity FROM tic WHERE v <> 0"))
def tic_long(spark, sf):
    return normalize.tic_ions(ions(spark, sf)).select("region", "pixel_id", "mz_index", r6("intensity", "intensity", 9))


@query("median_norm", sql("ions", then="""
, m AS (SELECT region, pixel_id, median(v) AS m FROM ions GROUP BY ALL)
SELECT region, pixel_id, mz_index, round(v / (CAST(1e-6 AS DOUBLE) + m), 5) AS intensity FROM ions JOIN m USING (region, pixel_id) WHERE v <> 0"""))
def median_norm(spark, sf):
    return to_ions(normalize.median_norm(I.spectra(spark, sf))).select(
        "region", "pixel_id", "mz_index", r6("intensity", "intensity", 5)
    )


SPATIAL = """
, p99 AS (SELECT region, mz_index, quantile_cont(v, 0.99) AS q FROM tic GROUP BY ALL)
, spatial AS (SELECT region, y, x, pixel_id, label, mz_index, least(1.0, v / (CAST(1e-6 AS DOUBLE) + q)) AS v FROM tic JOIN p99 USING (region, mz_index))
"""


@query("spatial_tic", sql("tic", then=SPATIAL + "SELECT region, pixel_id, mz_index, round(v, 6) AS intensity FROM spatial WHERE v <> 0"))
def spatial_tic(spark, sf):
    return to_ions(normalize.spatial_tic(I.spectra(spark, sf))).select("region", "pixel_id", "mz_index", r6("intensity", "intensity"))


@query("ion_max_norm", sql("ions", then="""
SELECT region, pixel_id, mz_index, round(v / max(v) OVER (PARTITION BY region, mz_index), 6) AS intensity FROM ions QUALIFY v <> 0"""))
def ion_max_norm(spark, sf):
    return normalize.ion_max_norm(ions(spark, sf)).select("region", "pixel_id", "mz_index", r6("intensity", "intensity"))


def stretch_sql(low, high, eps, floor_first=True):
    shifted = "greatest(v - lo, 0)" if floor_first else "v - lo"
    return sql("ions", then=f"""
, ch AS (SELECT region, pixel_id, mz_index AS ch, v FROM ions WHERE mz_index < 3)
, lo AS (SELECT region, ch, quantile_cont(v, {low}) AS lo FROM ch GROUP BY ALL)
, sh AS (SELECT region, pixel_id, ch, {shifted} AS v FROM ch JOIN lo USING (region, ch))
, hi AS (SELECT region, ch, quantile_cont(v, {high}) AS hi FROM sh GROUP BY ALL)
SELECT region, pixel_id, round(max(e) FILTER (ch = 0), 6) AS c0, round(max(e) FILTER (ch = 1), 6) AS c1, round(max(e) FILTER (ch = 2), 6) AS c2
FROM (SELECT region, pixel_id, ch, least(greatest(v / (hi + {eps}), 0), 1) AS e FROM sh JOIN hi USING (region, ch)) GROUP BY ALL""")


def channels_of(pixels):
    return pixels.select("region", "y", "x", "pixel_id", "label", *[F.element_at("spectrum", i + 1).alias(f"c{i}") for i in range(3)])


CH = ["c0", "c1", "c2"]


@query("stretch", stretch_sql(0.00001, 0.99999, "0"))
def stretch(spark, sf):
    return normalize.stretch(channels_of(I.spectra(spark, sf)), CH).select("region", "pixel_id", *[r6(c, c) for c in CH])


@query("stretch_gray", stretch_sql(0.001, 0.999, "CAST(1e-7 AS DOUBLE)"))
def stretch_gray(spark, sf):
    return normalize.stretch_gray(channels_of(I.spectra(spark, sf)), CH).select("region", "pixel_id", *[r6(c, c) for c in CH])


@query("stretch_umap", stretch_sql(0.0001, 0.9999, "0", False))
def stretch_umap(spark, sf):
    return normalize.stretch_umap(channels_of(I.spectra(spark, sf)), CH).select("region", "pixel_id", *[r6(c, c) for c in CH])


@query("stretch_umap_narrow", stretch_sql(0.03, 0.97, "0", False))
def stretch_umap_narrow(spark, sf):
    return normalize.stretch_umap(channels_of(I.spectra(spark, sf)), CH, 0.03, 0.97).select(
        "region", "pixel_id", *[r6(c, c) for c in CH]
    )


def equalize_sql(source, bins, keys, out):
    """Histogram equalization of v in ``source`` per keys as CTEs ending in ``out`` (…, eq)."""
    k = ", ".join(keys)
    return f"""
, span AS (SELECT {k}, CASE WHEN max(v) > min(v) THEN min(v) ELSE min(v) - 0.5 END AS a, CASE WHEN max(v) > min(v) THEN max(v) ELSE max(v) + 0.5 END AS z FROM {source} GROUP BY {k})
, placed AS (SELECT {source}.*, (v - a) / (z - a) * {bins} AS pos, CAST(least(floor((v - a) / (z - a) * {bins}), {bins} - 1) AS INTEGER) AS bin FROM {source} JOIN span USING ({k}))
, cnt AS (SELECT {k}, bin, count(*) AS c FROM placed GROUP BY {k}, bin)
, cdf AS (SELECT {k}, bin, sum(c) OVER (PARTITION BY {k} ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY {k}) AS total FROM cnt)
, {out} AS (SELECT p.*, (c0.upto + CASE WHEN p.bin >= {bins} - 1 OR c1.bin IS NULL THEN 0 ELSE (c1.upto - c0.upto) * (p.pos - p.bin) END) / c0.total * ({bins} - 1) AS eq
  FROM placed p JOIN cdf c0 USING ({k}, bin) LEFT JOIN cdf c1 ON {' AND '.join(f'c1.{x} = p.{x}' for x in keys)} AND c1.bin = p.bin + 1)
"""


@query("hist_equalize", sql("ions", then=", src AS (SELECT region, pixel_id, v FROM ions WHERE mz_index = 0 AND label < 6)"
       + equalize_sql("src", 64, ["region"], "done") + "SELECT region, pixel_id, round(eq, 5) AS value FROM done"))
def hist_equalize(spark, sf):
    masked = channels_of(I.spectra(spark, sf)).where("label < 6")
    return normalize.hist_equalize(masked, "c0", 64).select("region", "pixel_id", r6("c0", "value", 5))


@query("equalize_channels", sql("image", then="""
, tall AS (SELECT region, pixel_id, 0 AS ch, c0 AS lv FROM image UNION ALL SELECT region, pixel_id, 1, c1 FROM image UNION ALL SELECT region, pixel_id, 2, c2 FROM image)
, cnt AS (SELECT region, ch, lv, count(*) AS c FROM tall GROUP BY ALL)
, cdf AS (SELECT region, ch, lv, sum(c) OVER (PARTITION BY region, ch ORDER BY lv) AS u, sum(c) OVER (PARTITION BY region, ch) AS n,
          first(c) OVER (PARTITION BY region, ch ORDER BY lv) AS f FROM cnt)
, lut AS (SELECT region, ch, lv, CAST(CASE WHEN n = f THEN lv ELSE round_even((u - f) * CAST(255 AS DOUBLE) / (n - f), 0) END AS INTEGER) AS t FROM cdf)
SELECT region, pixel_id, max(t) FILTER (ch = 0) AS c0, max(t) FILTER (ch = 1) AS c1, max(t) FILTER (ch = 2) AS c2 FROM tall JOIN lut USING (region, ch, lv) GROUP BY ALL"""))
def equalize_channels(spark, sf):
    return normalize.equalize_channels(I.image(I.spectra(spark, sf)), CH).select("region", "pixel_id", *CH)


@query("to_uint8", sql("ions", "sums", then="""
SELECT region, pixel_id, mz_index, CAST(trunc(v / top * 255) AS INTEGER) AS level FROM ions JOIN sums USING (region, pixel_id) WHERE top > 0 AND v <> 0"""))
def to_uint8(spark, sf):
    inside = filters.drop_background(I.spectra(spark, sf))
    unit = inside.withColumn("spectrum", S.scaled(F.col("spectrum"), F.nullif(F.array_max("spectrum"), F.lit(0.0))))
    return to_ions(unit).select(
        "region", "pixel_id", "mz_index", S.to_byte(F.col("intensity")).alias("level")
    )


# --- joins ------------------------------------------------------------------------------------------------


@query("join_mask", sql("ions", then="""
SELECT region, pixel_id, label AS side, round(sum(v), 6) AS total FROM ions WHERE label IN (0, 1) GROUP BY ALL"""))
def join_mask(spark, sf):
    pixels = I.spectra(spark, sf)
    return joins.join_mask(pixels.drop("pixel_id", "label"), I.masks(pixels)).select(
        "region", "pixel_id", "side", r6(S.total(F.col("spectrum")), "total")
    )


@query("join_mz_axis", sql("ions", then="""
SELECT region, CAST(300 + mz_index AS DOUBLE) AS mz, round(sum(v), 5) AS total FROM ions WHERE v <> 0 GROUP BY ALL"""))
def join_mz_axis(spark, sf):
    return joins.join_mz_axis(ions(spark, sf), I.axis(spark, sf)).groupBy("region", "mz").agg(r6(F.sum("intensity"), "total", 5))


@query("nearest_mz", sql("ions", then="""
, axis AS (SELECT DISTINCT region, mz_index, CAST(300 + mz_index AS DOUBLE) AS mz FROM ions WHERE region < 2)
, asked AS (SELECT DISTINCT CAST(s_suppkey % 2 AS INTEGER) AS region, CAST(290 + (s_suppkey * 3 % 160) * 0.5 AS DOUBLE) AS requested FROM supplier)
SELECT region, requested, mz_index, mz FROM (
  SELECT a.region, requested, mz_index, mz, row_number() OVER (PARTITION BY a.region, requested ORDER BY abs(mz - requested), mz_index) AS r
  FROM asked a JOIN axis b ON a.region = b.region) WHERE r = 1"""))
def nearest_mz(spark, sf):
    key = F.col("s_suppkey")
    asked = I.table(spark, sf, "supplier").select((key % 2).cast("int").alias("region"), (F.lit(290.0) + (key * 3 % 160) * 0.5).alias("mz"))
    return joins.nearest_mz(I.axis(spark, sf), asked)


@query("polygon_pixels", sql("covered", then="SELECT region, polygon, y, x FROM covered"))
def polygon_pixels(spark, sf):
    pixels = I.spectra(spark, sf)
    return joins.polygon_pixels(pixels.select("region", "y", "x"), I.polygons(spark, sf)).select("region", "polygon", "y", "x")


@query("grid_neighbors", sql("spectra", then="""
SELECT a.region, a.pixel_id AS center_id, b.pixel_id AS neighbor_id, b.y - a.y AS dy, b.x - a.x AS dx FROM spectra a JOIN spectra b
ON a.region = b.region AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1"""))
def grid_neighbors(spark, sf):
    return joins.grid_neighbors(I.spectra(spark, sf))


@query("pixels_in_mask", sql("spectra", then="SELECT region, y, x FROM spectra WHERE label = 3"))
def pixels_in_mask(spark, sf):
    pixels = I.spectra(spark, sf)
    return joins.pixels_in_mask(pixels.select("region", "y", "x"), pixels.where("label = 3"))


METHODS = ["PCA", "NMF", "TOP3"]


@query("method_region_grid", """
SELECT p_name || CAST(p_partkey AS VARCHAR) AS path, m AS method FROM part, (VALUES ('PCA'), ('NMF'), ('TOP3')) t(m)""")
def method_region_grid(spark, sf):
    paths = I.table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    return joins.method_region_grid(paths, METHODS)


@query("pending_runs", """
SELECT p_name || CAST(p_partkey AS VARCHAR) AS path, m AS method FROM part, (VALUES ('PCA'), ('NMF'), ('TOP3')) t(m)
WHERE NOT (m = 'NMF' AND p_size > 20)""")
def pending_runs(spark, sf):
    part = I.table(spark, sf, "part").withColumn("path", F.concat("p_name", F.col("p_partkey").cast("string")))
    done = part.where("p_size > 20").select("path", F.lit("NMF").alias("method"))
    return joins.pending_runs(joins.method_region_grid(part, METHODS), done)


@query("category_pairs", """
SELECT DISTINCT a.p_type AS kind, a.p_brand AS category_a, b.p_brand AS category_b FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand < b.p_brand""")
def category_pairs(spark, sf):
    rows = I.table(spark, sf, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("category"))
    return joins.category_pairs(rows, "kind")


# --- set operations ---------------------------------------------------------------------------------------


@query("union_images", sql("spectra", then="""
SELECT region, label, count(*) AS n FROM (SELECT region, label FROM spectra WHERE label < 4 UNION ALL SELECT region, label FROM spectra WHERE label > 1) GROUP BY ALL"""))
def union_images_query(spark, sf):
    pixels = I.spectra(spark, sf)
    both = union_images(pixels.where("label < 4"), pixels.where("label > 1"))
    return both.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_values", sql("spectra", then="""
SELECT 'label' AS kind, region, label AS value FROM spectra GROUP BY ALL UNION ALL
SELECT DISTINCT 'row' AS kind, region, y AS value FROM spectra"""))
def distinct_values(spark, sf):
    pixels = I.spectra(spark, sf)
    return setops.distinct_values(pixels, {"label": "label", "row": "y"})



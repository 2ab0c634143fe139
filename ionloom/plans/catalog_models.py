"""Fitted models, embeddings, sinks and pipelines over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.models import dense as D
from ionloom.models import factors as M
from ionloom.models import graph_embed as E
from ionloom.models import rank_embed as R
from ionloom.models import supervised as C
from ionloom.operators import binning
from ionloom.operators.normalize import tic
from ionloom.plans import inputs as I
from ionloom.plans import methods
from ionloom.plans.catalog_pictures import CENTERS, label_components
from ionloom.plans.catalog_tables import r6
from ionloom.plans.registry import query
from ionloom.session import scratch_folder
from ionloom.sources import cubes, datasources
from ionloom.streaming import row_local

sql = I.sql


# --- sources and sinks ------------------------------------------------------------------------------------


@query("read_cube", sql("ions", then="""
SELECT region, y, x, pixel_id, round(sum(CAST(CAST(v AS FLOAT) AS DOUBLE)), 4) AS total FROM ions GROUP BY ALL"""))
def read_cube(spark, sf):
    """Cubes are written as .npy files by the tasks and read back through the data source."""
    folder = scratch_folder(spark, "npy").removeprefix("file:")
    cubes.write_npy(I.spectra(spark, sf), folder)
    datasources.register(spark)
    back = spark.read.format("npy_cube").option("path", folder).option("rows", 4).load()
    return back.select("region", "y", "x", "pixel_id", r6(S.total(F.col("spectrum").cast("array<double>")), "total", 4))


@query("read_imzml", sql("peaks", then="""
SELECT region, y, x, count(*) AS n_peaks, round(min(mz), 4) AS first_mz, round(max(mz), 4) AS last_mz, round(sum(mz), 4) AS sum_mz,
  round(sum(CAST(CAST(intensity AS FLOAT) AS DOUBLE)), 3) AS total
FROM peaks GROUP BY region, y, x"""))
def read_imzml(spark, sf):
    """The peaks of every pixel are written as imzML pairs by the tasks and read back by byte ranges of the index."""
    folder = scratch_folder(spark, "imzml")
    datasources.register(spark)
    pixels = binning.peak_spectra(I.peaks(spark, sf).withColumn("intensity", F.col("intensity").cast("float")))
    pixels.write.format("imzml").mode("append").save(folder)
    back = spark.read.format("imzml").load(folder)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return back.select(
        "region", "y", "x", F.size("mz").cast("long").alias("n_peaks"), r6(F.array_min("mz"), "first_mz", 4),
        r6(F.array_max("mz"), "last_mz", 4), r6(total("mz"), "sum_mz", 4), r6(total(F.col("intensity").cast("array<double>")), "total", 3),
    )


@query("write_cube", sql("ions", then="SELECT region, pixel_id, round(sum(v), 6) AS total FROM ions GROUP BY ALL"))
def write_cube(spark, sf):
    folder = scratch_folder(spark, "cube")
    cubes.write_cube(I.spectra(spark, sf), folder)
    return cubes.read_cube(spark, folder).select(
        "region", "pixel_id", r6(S.total(F.col("spectrum")), "total")
    )


@query("write_ions", sql("peaks", then="""
, b AS (SELECT region, y, x, CAST(round_even((CAST(CAST(mz AS FLOAT) AS DOUBLE) - 300) * 5, 0) AS INTEGER) AS mz_index, intensity FROM peaks)
SELECT region, y, x, mz_index, round(sum(intensity), 4) AS intensity FROM b WHERE mz_index BETWEEN 1000 AND 1200 GROUP BY ALL"""))
def write_ions(spark, sf):
    """Peaks are binned, written in the long layout sorted by m/z, and one m/z range is read back."""
    folder = scratch_folder(spark, "ions")
    binned = binning.bin_peaks(I.peaks(spark, sf), 300, 1300, 5).withColumn(
        "pixel_id", F.col("y").cast("long") * I.GRID + F.col("x")
    )
    cubes.write_ions(binned, folder)
    return spark.read.parquet(f"{folder}/ions").where(F.col("mz_index").between(1000, 1200)).select(
        "region", "y", "x", "mz_index", r6("intensity", "intensity", 4)
    )


@query("write_results_csv", """
SELECT p_type AS method, p_name || CAST(p_partkey AS VARCHAR) AS path, p_retailprice AS seconds FROM part""")
def write_results_csv(spark, sf):
    folder = scratch_folder(spark, "results")
    rows = I.table(spark, sf, "part").select(
        F.col("p_type").alias("method"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_retailprice").alias("seconds"),
    )
    cubes.write_results_csv(rows.where("seconds < 950"), folder)
    cubes.write_results_csv(rows.where("seconds >= 950"), folder)
    return cubes.read_results_csv(spark, folder, "method string, path string, seconds double")


@query("write_factors", sql("scores", then=CENTERS + """
SELECT 'weights' AS part, region, pixel_id AS place, component AS entry, round(score, 6) AS value FROM scores
UNION ALL SELECT 'components', region, CAST(label AS BIGINT), mz_index, round(v, 6) FROM centers"""))
def write_factors(spark, sf):
    """Weights (summed quarters of the axis) and components (mean spectra) are written; every number is read back."""
    folder = scratch_folder(spark, "factors")
    weights = I.block_scores(I.spectra(spark, sf)).select("region", "y", "x", "pixel_id", "scores")
    cubes.write_factors(weights, label_components(spark, sf), folder)
    w = spark.read.parquet(f"{folder}/weights").select(
        "region", F.col("pixel_id").alias("place"), F.posexplode("scores").alias("entry", "value")
    )
    h = spark.read.parquet(f"{folder}/components").select(
        "region", F.col("component").cast("long").alias("place"), F.col("mz_index").alias("entry"), "value"
    )
    both = w.withColumn("part", F.lit("weights")).unionByName(h.withColumn("part", F.lit("components")))
    return both.select("part", "region", "place", "entry", r6("value", "value"))


@query("stream_row_local", sql("ions", "sums", then="""
SELECT region, pixel_id, round(max(v) / (max(s) + CAST(1e-6 AS DOUBLE)), 9) AS top_share, round(sum(v / nullif(s, 0) * mz_index) / 64, 6) AS avg_mz
FROM ions JOIN sums USING (region, pixel_id) WHERE top > 0 GROUP BY ALL"""))
def stream_row_local(spark, sf):
    """The row-local operators applied to the spectra arriving as a file stream."""
    folder = scratch_folder(spark, "stream")
    I.spectra(spark, sf).write.parquet(f"{folder}/in")
    rows = row_local.summaries(row_local.read_stream(spark, f"{folder}/in", I.spectra(spark, sf).schema))
    row_local.run_once(rows, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("region", "pixel_id", r6("top_share", "top_share", 9), r6("avg_mz", "avg_mz"))


# --- factors and clusters ---------------------------------------------------------------------------------


@query("pca3")
def pca3(spark, sf):
    return M.pca3_image(tic(I.spectra(spark, sf)))


@query("nmf_fit")
def nmf_fit(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    h, _ = M.nmf_fit(pixels, 5, I.N_MZ)
    return M.components_table(pixels, h)


@query("nmf_transform")
def nmf_transform(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    h, _ = M.nmf_fit(pixels, 5, I.N_MZ)
    return M.nmf_transform(pixels, h).select("region", "pixel_id", F.posexplode("scores").alias("component", "weight"))


@query("nmf3_image")
def nmf3_image(spark, sf):
    return M.nmf3_image(tic(I.spectra(spark, sf)), I.N_MZ)


@query("kmeans_segment")
def kmeans_segment(spark, sf):
    return M.kmeans_segment(tic(I.spectra(spark, sf)), 5).select("region", "y", "x", "pixel_id", "label")


@query("nested_segment")
def nested_segment(spark, sf):
    pixels = I.spectra(spark, sf)
    h, _ = M.nmf_fit(tic(pixels), 3, I.N_MZ)
    return M.nested_segment(pixels, h, 1)


@query("component_meta_cluster")
def component_meta_cluster(spark, sf):
    return M.component_meta_cluster(label_components(spark, sf), 5)


@query("model_grid")
def model_grid(spark, sf):
    return M.model_grid(tic(I.spectra(spark, sf)))


@query("silhouette_scan")
def silhouette_scan(spark, sf):
    return M.silhouette_scan(tic(I.spectra(spark, sf)))


@query("fast_ica3")
def fast_ica3(spark, sf):
    return M.fast_ica3(tic(I.spectra(spark, sf)))


@query("lda3")
def lda3(spark, sf):
    return M.lda3(I.spectra(spark, sf))


@query("class_scatter")
def class_scatter(spark, sf):
    return M.class_scatter(tic(I.spectra(spark, sf)))


# --- graph and landmark embeddings ------------------------------------------------------------------------


@query("fuzzy_graph_embed")
def fuzzy_graph_embed(spark, sf):
    return E.fuzzy_graph_embed(tic(I.spectra(spark, sf)), epochs=200)


@query("spectral_embed3")
def spectral_embed3(spark, sf):
    return E.spectral_embed3(tic(I.spectra(spark, sf)))


@query("landmark_mds3")
def landmark_mds3(spark, sf):
    return E.landmark_mds3(tic(I.spectra(spark, sf)), 50)


@query("landmark_isomap3")
def landmark_isomap3(spark, sf):
    return E.landmark_isomap3(tic(I.spectra(spark, sf)))


# --- rank embeddings --------------------------------------------------------------------------------------


def seeds_sql(draws: int) -> str:
    """Each draw again as two CTEs: the winner of the race, and the distances to all winners so far."""
    steps = [", s0 AS (SELECT region, pixel_id, 0 AS draw FROM spectra "
             "QUALIFY row_number() OVER (PARTITION BY region ORDER BY md5('0-' || region || '-' || pixel_id)) = 1)"]
    for k in range(draws):
        steps.append(
            f", w{k} AS (SELECT t.region, t.mz_index, t.v FROM tic t JOIN s{k} USING (region, pixel_id)), "
            f"e{k} AS (SELECT t.region, t.pixel_id, sum((t.v - w.v) * (t.v - w.v)) AS d2 FROM tic t JOIN w{k} w USING (region, mz_index) GROUP BY ALL)"
        )
        steps.append(f", g{k} AS MATERIALIZED (SELECT * FROM e{k})" if not k else
                     f", g{k} AS MATERIALIZED (SELECT region, pixel_id, least(e.d2, g.d2) AS d2 FROM e{k} e JOIN g{k - 1} g USING (region, pixel_id))")
        share = (f"CAST('0x' || substr(md5('{k + 1}-' || region || '-' || pixel_id), 1, 12) AS BIGINT) "
                 "/ CAST(281474976710656 AS DOUBLE)")
        steps.append(
            f", s{k + 1} AS MATERIALIZED (SELECT region, pixel_id, {k + 1} AS draw FROM g{k} WHERE d2 > 0 "
            f"QUALIFY row_number() OVER (PARTITION BY region ORDER BY -ln(greatest({share}, CAST(1e-12 AS DOUBLE))) / d2, pixel_id) = 1)"
        )
    return "\n".join(steps) + "\n" + " UNION ALL ".join(f"SELECT region, draw, pixel_id FROM s{k}" for k in range(draws))


@query("kmeanspp_sample", sql("tic", then=seeds_sql(5)))
def kmeanspp_sample(spark, sf):
    return R.kmeanspp_sample(tic(I.spectra(spark, sf)), 5).select("region", "draw", "pixel_id")


@query("kmeans_sample")
def kmeans_sample(spark, sf):
    return R.kmeans_sample(tic(I.spectra(spark, sf)), 12).select("center", "region", "pixel_id")


@query("saliency_embed")
def saliency_embed(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    coordinates, _ = R.saliency_embed(pixels)
    return R.embedding_image(pixels, coordinates)


@query("spearman_embed")
def spearman_embed(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    coordinates, _ = R.spearman_embed(pixels, sampling="random")
    return R.embedding_image(pixels, coordinates)


@query("saliency_cluster_embed")
def saliency_cluster_embed(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    coordinates, _ = R.saliency_cluster_embed(pixels, init="top3")
    return R.embedding_image(pixels, coordinates)


# --- classifiers ------------------------------------------------------------------------------------------


@query("pixel_classifier")
def pixel_classifier(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    model = C.pixel_classifier(pixels)
    return C.predict_map(model, pixels)


@query("mz_importance")
def mz_importance(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    return C.mz_importance(C.pixel_classifier(pixels), pixels, 20)


@query("pair_classifier")
def pair_classifier(spark, sf):
    return C.pair_classifier(tic(I.spectra(spark, sf)))


@query("mlp_segment")
def mlp_segment(spark, sf):
    pixels = tic(I.spectra(spark, sf))
    classes = pixels.agg(F.max("label")).first()[0] + 1
    model = C.mlp_segment(pixels, I.N_MZ, classes)
    return C.class_scores(model, pixels).select("region", "pixel_id", S.argmax(F.col("scores")).alias("label"))


@query("mlp_mz_rank")
def mlp_mz_rank(spark, sf):
    """The ten m/z with the largest input weights of the dense network."""
    pixels = tic(I.spectra(spark, sf))
    classes = pixels.agg(F.max("label")).first()[0] + 1
    return D.top_mz(C.mlp_segment(pixels, I.N_MZ, classes), pixels, 10)


@query("sparse_mz_select")
def sparse_mz_select(spark, sf):
    return C.sparse_mz_select(tic(I.spectra(spark, sf)), 10, 0.001)


# --- pipelines --------------------------------------------------------------------------------------------


@query("visualization_manifest", sql("spectra", then="""
SELECT DISTINCT region || '_' || m || '.png' AS visualization, region || '.npy' AS data, n AS method
FROM spectra, (VALUES ('TOP3', 'TOP3'), ('PercentileRatio', 'Percentile Ratio')) t(m, n)"""))
def visualization_manifest(spark, sf):
    return methods.visualization_manifest(methods.visualize(I.spectra(spark, sf), I.N_MZ, ["TOP3", "Percentile Ratio"]))


@query("benchmark_methods")
def benchmark_methods(spark, sf):
    return methods.benchmark(I.spectra(spark, sf), I.N_MZ, list(methods.METHODS)).select("method", "region", "metric", "value")

"""Non-negative factors, principal and independent components, clusters and topics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.models.pictures import component_argmax, component_normalize, image_of
from ionloom.operators.neighbors import stack
from ionloom.operators.spatial import ellipse_offsets, erode, median_blur3

FEATURES = "features"
PLACE = ["region", "y", "x", "pixel_id"]
SCORES_SCHEMA = "region int, y int, x int, pixel_id long, scores array<double>"


def featured(spectra: DataFrame, column: str = "spectrum") -> DataFrame:
    return spectra.withColumn(FEATURES, array_to_vector(F.col(column).cast("array<double>")))


def with_columns_of(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.col(array)[i] for i, n in enumerate(names)}).drop(array)


# --- non-negative matrix factorization -------------------------------------------------------------------


def solve_weights(x: np.ndarray, h: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares of every row of x on the rows of h by cyclic coordinate updates."""
    gram, target = h @ h.T, x @ h.T
    scale = np.maximum(np.diag(gram), 1e-12)
    w = np.maximum(target / np.maximum(gram.sum(axis=1), 1e-12), 0.0)
    for _ in range(sweeps):
        before = w.copy()
        for c in range(len(h)):
            w[:, c] = np.maximum(w[:, c] + (target[:, c] - w @ gram[:, c]) / scale[c], 0.0)
        if np.abs(w - before).max(initial=0.0) <= 1e-7 * (np.abs(w).max(initial=0.0) + 1e-12):
            break
    return w


def start_components(spectra: DataFrame, k: int, n_mz: int, seed: int) -> np.ndarray:
    mean = spectra.agg(F.avg(S.total(F.col("spectrum")))).first()[0] / n_mz
    return np.sqrt(max(mean, 1e-12) / k) * np.abs(np.random.default_rng(seed).standard_normal((k, n_mz)))


def nmf_fit(
    spectra: DataFrame, k: int, n_mz: int, iterations: int = 2000, seed: int = 0, tolerance: float = 1e-4
) -> tuple[np.ndarray, list[float]]:
    """Components H (k x n_mz) and the squared error after each pass.

    Passes end when one gains less than ``tolerance`` of the first error. The input is worked out once and kept.

    Each pass: H travels with the task, a batch solves its own weights and returns only the small sums
    W'W and W'X, added up by a shuffle on (component, column). The driver keeps k x n_mz numbers, never pixels.
    """
    data = spectra.select("spectrum").persist()
    h = start_components(data, k, n_mz, seed)
    errors: list[float] = []
    for _ in range(iterations):
        shared = spectra.sparkSession.sparkContext.broadcast(h)

        def sums(batches, shared=shared):
            h_now = shared.value
            gram, cross, square = np.zeros((k, k)), np.zeros((k, h_now.shape[1])), 0.0
            for pdf in batches:
                x = stack(pdf["spectrum"])
                if not len(x):
                    continue
                w = solve_weights(x, h_now)
                gram += w.T @ w
                cross += w.T @ x
                square += float(((x - w @ h_now) ** 2).sum())
            both = np.concatenate([gram, cross], axis=1)
            rows, cols = np.indices(both.shape)
            yield pd.DataFrame({"i": rows.ravel(), "j": cols.ravel(), "v": both.ravel()})
            yield pd.DataFrame({"i": [-1], "j": [0], "v": [square]})

        total = data.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(
            F.sum("v").alias("v")
        ).toPandas()
        shared.unpersist()
        errors.append(float(total.loc[total["i"] == -1, "v"].iloc[0]))
        if len(errors) > 1 and errors[-2] - errors[-1] < tolerance * errors[0]:
            break
        body = total[total["i"] >= 0]
        both = np.zeros((k, k + h.shape[1]))
        both[body["i"], body["j"]] = body["v"]
        gram, cross = both[:, :k], both[:, k:]
        for c in range(k):
            if gram[c, c] > 0:
                h[c] = np.maximum(h[c] + (cross[c] - gram[c] @ h) / gram[c, c], 0.0)
    data.unpersist()
    return h, errors


def nmf_transform(spectra: DataFrame, h: np.ndarray) -> DataFrame:
    """Weights of every pixel for fixed components: (region, y, x, pixel_id, scores). No shuffle."""
    shared = spectra.sparkSession.sparkContext.broadcast(h)

    def weights(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.drop(columns="spectrum").assign(scores=list(solve_weights(stack(pdf["spectrum"]), shared.value)))

    return spectra.select(*PLACE, "spectrum").mapInPandas(weights, SCORES_SCHEMA)


def components_table(spectra: DataFrame, h: np.ndarray, region: int = 0) -> DataFrame:
    """Long (region, component, mz_index, value) of a fitted model; k x n_mz rows."""
    rows, cols = np.indices(h.shape)
    frame = pd.DataFrame({"region": region, "component": rows.ravel(), "mz_index": cols.ravel(), "value": h.ravel()})
    return spectra.sparkSession.createDataFrame(frame, "region int, component int, mz_index int, value double")


def nmf3_image(spectra: DataFrame, n_mz: int, iterations: int = 2000) -> DataFrame:
    h, _ = nmf_fit(spectra, 3, n_mz, iterations)
    channels = ["w0", "w1", "w2"]
    weights = with_columns_of(nmf_transform(spectra, h).select("region", "pixel_id", "scores"), "scores", channels)
    return image_of(weights, spectra, channels)


def nested_segment(spectra: DataFrame, h: np.ndarray, radius: int = 2) -> DataFrame:
    """Segment, clean each segment's mask (3 x 3 median, erosion), and segment again inside with fixed components.

    All masks of all regions are cleaned in one job: (region, label) takes the place of the region.
    Returns (region, pixel_id, label, sublabel).
    """
    top = component_argmax(component_normalize(nmf_transform(spectra, h)))
    grid = top.select("region", "y", "x", "pixel_id", "label")
    k = len(h)
    masks = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c")).select(
        (F.col("region") * k + F.col("_c")).alias("region"), "y", "x", "pixel_id",
        (F.col("label") == F.col("_c")).cast("int").alias("value"),
    )
    clean = erode(median_blur3(masks), ellipse_offsets(radius)).where(F.col("value") > 0).select(
        F.floor(F.col("region") / k).cast("int").alias("region"), "pixel_id",
        F.pmod("region", F.lit(k)).cast("int").alias("label"),
    )
    inner = spectra.select(*PLACE, "spectrum").join(clean, ["region", "pixel_id"]).select(
        (F.col("region") * k + F.col("label")).cast("int").alias("region"), "y", "x", "pixel_id",
        S.median_norm(F.col("spectrum")).alias("spectrum"),
    )
    again = component_argmax(component_normalize(nmf_transform(inner, h)))
    return again.select(
        F.floor(F.col("region") / k).cast("int").alias("region"), "pixel_id",
        F.pmod("region", F.lit(k)).cast("int").alias("label"), F.col("label").alias("sublabel"),
    )


# --- clusters and topics ----------------------------------------------------------------------------------


def kmeans_fit(spectra: DataFrame, k: int, seed: int = 0, iterations: int = 20, init: str = "random"):
    return KMeans(k=k, seed=seed, maxIter=iterations, initMode=init, featuresCol=FEATURES, predictionCol="cluster").fit(
        featured(spectra)
    )


def kmeans_scores(spectra: DataFrame, centers: np.ndarray) -> DataFrame:
    """Softmax of 50 times the cosine to each centre: (region, y, x, pixel_id, scores)."""
    unit = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    shared = spectra.sparkSession.sparkContext.broadcast(unit)

    def cosine(batches):
        for pdf in batches:
            if len(pdf):
                x = stack(pdf["spectrum"])
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                yield pdf.drop(columns="spectrum").assign(scores=list((x @ shared.value.T) / np.where(norm > 0, norm, 1.0)))

    similarity = spectra.select(*PLACE, "spectrum").mapInPandas(cosine, SCORES_SCHEMA)
    return similarity.withColumn("scores", S.sharp_softmax(F.col("scores")))


def kmeans_segment(spectra: DataFrame, k: int) -> DataFrame:
    model = kmeans_fit(spectra, k)
    scores = kmeans_scores(spectra, np.array(model.clusterCenters()))
    return scores.withColumn("label", S.argmax(F.col("scores")))


def silhouette_scan(spectra: DataFrame, ks: range = range(2, 10), seed: int = 42) -> DataFrame:
    data = featured(spectra).persist()
    judge = ClusteringEvaluator(featuresCol=FEATURES, predictionCol="cluster")
    found = [
        (k, float(judge.evaluate(
            KMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol="cluster").fit(data).transform(data)
        )))
        for k in ks
    ]
    data.unpersist()
    return spectra.sparkSession.createDataFrame(found, "k int, silhouette double")


def model_grid(spectra: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 40, 60, 80, 100)) -> DataFrame:
    """Training cost of k-means for each k, all on one persisted input."""
    data = featured(spectra).persist()
    found = []
    for k in ks:
        model = KMeans(k=k, seed=0, initMode="random", featuresCol=FEATURES).fit(data)
        found.append((k, len(model.clusterCenters()), float(model.summary.trainingCost)))
    data.unpersist()
    return spectra.sparkSession.createDataFrame(found, "k int, n_centers int, cost double")


def component_meta_cluster(components: DataFrame, k: int) -> DataFrame:
    """Cluster the component spectra of all regions: (region, component, cluster)."""
    rows = components.groupBy("region", "component").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("mz_index", "value"))), lambda e: e["value"]).alias("spectrum")
    )
    data = featured(rows)
    return KMeans(k=k, seed=0, featuresCol=FEATURES, predictionCol="cluster").fit(data).transform(data).select(
        "region", "component", "cluster"
    )


def lda3(spectra: DataFrame, iterations: int = 10, seed: int = 0) -> DataFrame:
    """Three topic shares per pixel; background pixels take no part in the fit and have shares of 0."""
    data = featured(spectra.where(S.is_foreground(F.col("spectrum"))))
    model = LDA(k=3, maxIter=iterations, seed=seed, featuresCol=FEATURES, optimizer="online").fit(data)
    shares = model.transform(data).select("region", "pixel_id", vector_to_array("topicDistribution").alias("_t"))
    named = with_columns_of(shares, "_t", ["t0", "t1", "t2"])
    return spectra.select("region", "pixel_id").join(named, ["region", "pixel_id"], "left").fillna(0.0, ["t0", "t1", "t2"])


# --- linear projections -----------------------------------------------------------------------------------


def pca_project(spectra: DataFrame, k: int = 3) -> DataFrame:
    """Centred principal coordinates e0..; each axis is signed so that its largest loading is positive."""
    data = featured(spectra)
    model = PCA(k=k, inputCol=FEATURES, outputCol="_p").fit(data)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    raw = model.transform(data).select("region", "pixel_id", vector_to_array("_p").alias("_p"))
    means = raw.agg(*[F.avg(F.col("_p")[i]).alias(f"m{i}") for i in range(k)]).first()
    return raw.select(
        "region", "pixel_id",
        *[((F.col("_p")[i] - F.lit(means[i])) * F.lit(float(signs[i]))).alias(f"e{i}") for i in range(k)],
    )


def pca3_image(spectra: DataFrame) -> DataFrame:
    return image_of(pca_project(spectra, 3), spectra, ["e0", "e1", "e2"])


def fast_ica3(spectra: DataFrame, iterations: int = 50, tolerance: float = 1e-5, seed: int = 0) -> DataFrame:
    """Three independent components: principal coordinates whitened, then symmetric fixed-point steps.

    One step is one aggregate of 12 averages over three columns; only a 3 x 3 matrix is on the driver.
    """
    z = pca_project(spectra, 3)
    spread = z.agg(*[F.stddev_pop(f"e{i}").alias(f"s{i}") for i in range(3)]).first()
    z = z.select("region", "pixel_id", *[(F.col(f"e{i}") / F.lit(spread[i] or 1.0)).alias(f"z{i}") for i in range(3)]).persist()
    names = ["z0", "z1", "z2"]

    def decorrelate(m):
        values, vectors = np.linalg.eigh(m @ m.T)
        return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-15))) @ vectors.T @ m

    w = decorrelate(np.random.default_rng(seed).standard_normal((3, 3)))
    for _ in range(iterations):
        terms = []
        for i in range(3):
            g = F.tanh(sum(F.lit(float(w[i, j])) * F.col(names[j]) for j in range(3)))
            terms += [F.avg(g * F.col(n)) for n in names] + [F.avg(1 - g * g)]
        row = np.array(z.agg(*[t.alias(f"t{i}") for i, t in enumerate(terms)]).first(), dtype=float).reshape(3, 4)
        new = decorrelate(row[:, :3] - row[:, 3:] * w)
        moved = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max()
        w = new
        if moved < tolerance:
            break
    z.unpersist()
    return z.select(
        "region", "pixel_id",
        *[sum(F.lit(float(w[i, j])) * F.col(names[j]) for j in range(3)).alias(f"e{i}") for i in range(3)],
    )


def class_scatter(spectra: DataFrame, label: str = "label", span: float = 400.0) -> DataFrame:
    """Class mean spectra on two principal axes, scaled to 0..span; one row per class."""
    means = spectra.select(label, F.posexplode("spectrum").alias("i", "v")).groupBy(label, "i").agg(F.avg("v").alias("v"))
    rows = means.groupBy(label).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("spectrum")
    ).select(F.lit(0).alias("region"), F.col(label).cast("long").alias("pixel_id"), "spectrum")
    flat = pca_project(rows, 2)
    ends = flat.agg(*[f(f"e{i}").alias(f"{n}{i}") for i in range(2) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return flat.select(
        F.col("pixel_id").alias(label),
        *[((F.col(f"e{i}") - F.lit(ends[f"lo{i}"])) / F.lit((ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0) * span).alias(a)
          for i, a in enumerate("xy")],
    )

"""Named picture methods and the runs that apply them: the visualization and benchmark pipelines.

A method is any callable (spectra DataFrame, n_mz) -> image DataFrame (region, y, x, pixel_id, c0, c1, c2).
All regions of a cube table go through a method in one job.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.models import factors, graph_embed, pictures, rank_embed
from ionloom.operators import metrics, normalize, sampling
from ionloom.session import cut_lineage, small_side
from ionloom.sources.cubes import run_name

Method = Callable[[DataFrame, int], DataFrame]


class _Umap:
    """A picture of the neighbour graph of (k, metric); pictures of several graphs can be drawn together."""

    def __init__(self, k: int, min_dist: float, metric: str, epochs: int):
        self.k, self.min_dist, self.metric, self.epochs = k, min_dist, metric, epochs

    def __call__(self, spectra: DataFrame, n_mz: int) -> DataFrame:
        graph = graph_embed.fuzzy_graph(spectra, 3, self.k, self.metric)
        points = graph_embed.embed_graph(*graph, 3, self.k, self.min_dist, self.epochs)
        return pictures.image_of(points, spectra, ["e0", "e1", "e2"])


def _draw_together(spectra: DataFrame, drawn: dict[str, _Umap]) -> tuple[DataFrame, dict[str, float]]:
    """Images of all these methods with the column ``picture``, their place in ``drawn``, and the seconds of each.

    Graphs, start points, epochs and pictures are made in the same jobs. A method's seconds are its part of the whole, as its
    epochs took of the time that tasks spent on the epochs of all.
    """
    started = time.time()
    graphs = list(dict.fromkeys((m.k, m.metric) for m in drawn.values()))
    edges, points = graph_embed.fuzzy_graphs(spectra, graphs)
    wanted = [(graphs.index((m.k, m.metric)), m.k, m.min_dist, m.epochs) for m in drawn.values()]
    placed, spent = graph_embed.embed_graphs(edges, points, 3, wanted)
    image = cut_lineage(pictures.image_of(placed, spectra, ["e0", "e1", "e2"], extra=("picture",)))
    whole = time.time() - started
    return image, {name: whole * own / max(sum(spent), 1e-9) for name, own in zip(drawn, spent)}


def _saliency(points: int, epochs: int, sampling_name: str, strength: float = 0.001) -> Method:
    def run(spectra, n_mz):
        coordinates, _ = rank_embed.saliency_embed(spectra, points, epochs, strength, sampling=sampling_name)
        return rank_embed.embedding_image(spectra, coordinates)

    return run


METHODS: dict[str, Method] = {
    "TOP3": lambda spectra, n_mz: pictures.top3_rgb(spectra),
    "Percentile Ratio": lambda spectra, n_mz: pictures.percentile_ratio_rgb(spectra),
    "PCA": lambda spectra, n_mz: factors.pca3_image(spectra),
    "NMF": lambda spectra, n_mz: factors.nmf3_image(spectra, n_mz),
    "FastICA": lambda spectra, n_mz: pictures.image_of(factors.fast_ica3(spectra), spectra, ["e0", "e1", "e2"]),
    "Saliency Optimization": _saliency(500, 200, "coreset", 0.005),
    "Saliency Optimization Random": _saliency(500, 200, "random", 0.005),
}
# Names under which stored leaderboards hold these methods, and their settings
METHODS |= {
    "SALIENCY-OPTIMIZATION1": _saliency(1000, 200, "coreset"),
    "SALIENCY-OPTIMIZATION2": _saliency(1000, 500, "coreset"),
    "UMAP min_dist=0.1, n=15, metric=L2": _Umap(15, 0.1, "euclidean", 200),
    "UMAP min_dist=0.1, n=50, metric=L2": _Umap(50, 0.1, "euclidean", 200),
    "UMAP min_dist=0.5, n=15, metric=L2": _Umap(15, 0.5, "euclidean", 200),
    "UMAP min_dist=0.5, n=50, metric=L2": _Umap(50, 0.5, "euclidean", 200),
    "UMAP min_dist=0.9, n=100, metric=L2": _Umap(100, 0.9, "euclidean", 200),
    "UMAP min_dist=0.9, n=300, metric=L2": _Umap(300, 0.9, "euclidean", 200),
    "UMAP min_dist=0.5, n=300, metric=L2": _Umap(300, 0.5, "euclidean", 200),
    "UMAP min_dist=0.1, n=15, metric=L∞": _Umap(15, 0.1, "chebyshev", 200),
    "UMAP min_dist=0.1, n=50, metric=L∞": _Umap(50, 0.1, "chebyshev", 200),
    "UMAP min_dist=0.5, n=15, metric=L∞": _Umap(15, 0.5, "chebyshev", 200),
    "UMAP min_dist=0.5, n=50, metric=L∞": _Umap(50, 0.5, "chebyshev", 200),
    "UMAP min_dist=0.9, n=100, metric=L∞": _Umap(100, 0.9, "chebyshev", 200),
    "UMAP min_dist=0.9, n=300, metric=L∞": _Umap(300, 0.9, "chebyshev", 200),
    "UMAP min_dist=0.5, n=300, metric=L∞": _Umap(300, 0.5, "chebyshev", 200),
}

NORMALIZATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tic": normalize.tic, "median": normalize.median_norm, "spatial_tic": normalize.spatial_tic, "none": lambda s: s,
}


def register_method(name: str, method: Method) -> None:
    METHODS[name] = method


def visualize(spectra: DataFrame, n_mz: int, names: list[str], normalization: str = "tic") -> DataFrame:
    """Images of several methods stacked with a ``method`` column."""
    normed = NORMALIZATIONS[normalization](spectra)
    stacked = None
    for name in names:
        image = METHODS[name](normed, n_mz).select(
            F.lit(name).alias("method"), "region", "y", "x", "pixel_id", "c0", "c1", "c2"
        )
        stacked = image if stacked is None else stacked.unionByName(image)
    return stacked


def visualization_manifest(images: DataFrame) -> DataFrame:
    """visualization, data, method rows of the written images."""
    return images.select("region", "method").distinct().select(
        F.concat(F.col("region").cast("string"), F.lit("_"), run_name(F.col("method")), F.lit(".png")).alias("visualization"),
        F.concat(F.col("region").cast("string"), F.lit(".npy")).alias("data"), "method",
    )


def _out():
    return F.array(*[F.col(c).cast("double") for c in ("c0", "c1", "c2")]).alias("out")


def _scores(gaps: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    scores = metrics.saliency_smoothness(gaps)
    wide = metrics.neighbour_ranks(sample, k, ("chebyshev", "euclidean"))
    tables = [
        metrics.pearson(gaps), metrics.spearman(gaps), metrics.neighbour_scores(metrics.neighbour_ranks(sample, k), k),
        metrics.trustworthiness(wide, k).withColumnRenamed("trustworthiness", "trustworthiness_linf"),
    ]
    for table in tables:
        names = [c for c in table.columns if c != "region"]
        scores = scores.unionByName(table.unpivot("region", names, "metric", "value"))
    return scores


def score_image(spectra: DataFrame, image: DataFrame, pairs: int = 30000, k: int = 100, seed: int = 0,
                drawn: DataFrame | None = None, known: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(region, metric, value) of all quality scores of one image; the neighbour scores take all foreground pixels.

    ``drawn`` holds the pairs and the distances of their spectra where several images are scored; ``known`` returns the
    image's rows of ``score_images``, where it is scored with others.
    """
    if known is not None:
        return known()
    drawn = sampling.sample_pairs(spectra, pairs, seed) if drawn is None else drawn
    gaps = metrics.pair_distances(drawn, spectra, image)
    sample = metrics.metric_sample(spectra).join(image.select("region", "pixel_id", _out()), ["region", "pixel_id"])
    return _scores(gaps, cut_lineage(sample), k)  # read by several scores


def score_images(spectra: DataFrame, images: DataFrame, k: int, drawn: DataFrame) -> DataFrame:
    """(method, region, metric, value) of images(method, region, pixel_id, c0, c1, c2), all scored in the same jobs.

    A region of a picture is numbered and scored as a region of its own.
    """
    found = images.select("method", "region").distinct()
    # one row per region of a picture
    number = small_side(found.withColumn("_picture", F.row_number().over(Window.orderBy("method", "region"))))
    own = images.join(number, ["method", "region"]).select("region", "pixel_id", "c0", "c1", "c2", "_picture")

    def apart(df):
        return df.withColumn("region", F.col("_picture")).drop("_picture")

    pairs = drawn.join(number.select("region", "_picture"), "region")
    gaps = metrics.pair_distances(apart(pairs), spectra, apart(own))
    sample = metrics.metric_sample(spectra).join(own.select("region", "pixel_id", "_picture", _out()), ["region", "pixel_id"])
    scores = cut_lineage(_scores(gaps, apart(sample.select("region", "pixel_id", "spectrum", "out", "_picture")), k))
    return scores.withColumnRenamed("region", "_picture").join(number, "_picture").select("method", "region", "metric", "value")


def benchmark(spectra: DataFrame, n_mz: int, names: list[str], done: DataFrame | None = None, pairs: int = 30000,
              k: int = 100) -> DataFrame:
    """Leaderboard rows (method, region, metric, value) for every method and region that is not in ``done`` yet.

    ``done`` has the columns method and region, or method alone when a method is finished for all regions.
    """
    # normalized spectra, pairs and the distances of their spectra are the same for every method; they are per region,
    # so a method that is left to do for some regions reads the part it needs
    normed = cut_lineage(normalize.tic(spectra))
    drawn = metrics.spectra_distances(sampling.sample_pairs(normed, pairs), normed)
    images: dict[str, tuple[DataFrame, DataFrame, float]] = {}
    graphs = {name: METHODS[name] for name in names if isinstance(METHODS[name], _Umap)} if done is None else {}
    if graphs:
        image, spent = _draw_together(normed, graphs)
        for place, name in enumerate(graphs):
            images[name] = normed, image.where(F.col("picture") == place).drop("picture"), spent[name]
    for name in names:
        left = normed
        if name in images:
            continue
        if done is not None:
            own = done.where(F.col("method") == name)
            if "region" in done.columns:
                left = left.join(small_side(own.select("region").distinct()), "region", "left_anti")
            elif own.limit(1).count():
                continue
            if not left.limit(1).count():
                continue
        started = time.time()
        image = cut_lineage(METHODS[name](left, n_mz))
        images[name] = left, image, time.time() - started
    stacked = None
    for name, (_, image, _) in images.items():
        one = image.select(F.lit(name).alias("method"), "region", "pixel_id", "c0", "c1", "c2")
        stacked = one if stacked is None else stacked.unionByName(one)
    if stacked is None:
        return None
    scored = cache(lambda: score_images(normed, stacked, k, drawn))
    board = None
    for name, (left, image, seconds) in images.items():
        rows = score_image(left, image, pairs, k, drawn=drawn, known=lambda: scored().where(F.col("method") == name).drop("method"))
        timing = image.select("region").distinct().select("region", F.lit("seconds").alias("metric"), F.lit(seconds).alias("value"))
        rows = rows.unionByName(timing).select(F.lit(name).alias("method"), "region", "metric", "value")
        board = rows if board is None else board.unionByName(rows)
    return cut_lineage(board)

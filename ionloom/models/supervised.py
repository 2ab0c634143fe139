"""Classifiers on labelled spectra: (region, pixel_id, label INT, spectrum)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.models import boosting, dense
from ionloom.models.factors import FEATURES, PLACE, featured
from ionloom.operators.neighbors import stack
from ionloom.operators.sampling import class_weights, stratified_split
from ionloom.session import bounded_rows, cut_lineage

MAX_CATEGORIES = 512


def weighted_training(labelled: DataFrame) -> DataFrame:
    """Labelled spectra with the balanced weight of their class."""
    whole = labelled.withColumn("_region", F.col("region")).withColumn("region", F.lit(0))
    weights = class_weights(whole.select("region", "label")).select("label", "weight")
    return featured(labelled.join(weights, "label"))


# Settings of the boosted classifiers
PIXEL_SETTINGS = boosting.Settings(rounds=100, depth=7, step=0.1, child_weight=5.0, max_step=1.0)
PAIR_SETTINGS = boosting.Settings(rounds=40, depth=4, step=0.1)


def forest_classifier(labelled: DataFrame, trees: int = 40, depth: int = 8, seed: int = 42):
    """Multi-class tree ensemble on balanced weights. Returns the fitted model."""
    return RandomForestClassifier(
        labelCol="label", featuresCol=FEATURES, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(weighted_training(labelled))


def _classes(labelled: DataFrame) -> list[int]:
    return [r["label"] for r in bounded_rows(labelled.select("label").where("label IS NOT NULL").distinct().orderBy("label"), MAX_CATEGORIES, "categories")]


def _numbered(labelled: DataFrame, classes: list[int]) -> DataFrame:
    """Class numbers 0.. instead of labels; rows without a label or spectrum take no part."""
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    return labelled.where("label IS NOT NULL AND spectrum IS NOT NULL").withColumn("label", place.cast("int"))


def pixel_classifier(labelled: DataFrame, settings: boosting.Settings = PIXEL_SETTINGS) -> boosting.Boosted:
    """Boosted trees on annotated spectra, one tree per class and round."""
    classes = _classes(labelled)
    rows = _numbered(labelled, classes).withColumn("train", F.lit(True))
    task = boosting.class_task(len(classes))
    if not classes:
        return boosting.Boosted([], [], task, settings, classes)
    edges = boosting.bin_edges(rows, settings.bins)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row per class
    blocks = boosting.binned_blocks(rows, edges, len(classes))
    sizes = np.array([counts.get(c, 0) for c in range(len(classes))])
    _, trees = boosting.fit(blocks, len(edges), sizes, task, settings)
    return boosting.Boosted(edges, trees, task, settings, classes)


def predict_map(model, spectra: DataFrame) -> DataFrame:
    """Class of every foreground pixel; -1 outside the sample."""
    inside = S.is_foreground(F.col("spectrum"))
    if not isinstance(model, boosting.Boosted):
        predicted = model.transform(featured(spectra))
        return predicted.select(*PLACE, F.when(inside, F.col("prediction").cast("int")).otherwise(-1).alias("label"))
    shared = spectra.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def best(spectrum: pd.Series) -> pd.Series:
        model = shared.value
        if not model.rounds:
            return pd.Series(np.full(len(spectrum), -1))
        return pd.Series(np.array(model.classes)[model.margins(stack(spectrum)).argmax(axis=1)])

    # all trees are walked for every pixel, so pixels are dealt out however few files they come from
    dealt = spectra.select(*PLACE, "spectrum").repartition(max(1, -(-spectra.count() // boosting.BLOCK)))
    return dealt.select(*PLACE, F.when(inside, best("spectrum")).otherwise(-1).alias("label"))


def mz_importance(model, spectra: DataFrame, n: int = 20) -> DataFrame:
    """The n m/z with the largest importance of a tree model."""
    share = model.importance if isinstance(model, boosting.Boosted) else model.featureImportances.toArray()
    ranked = sorted(enumerate(share.tolist()), key=lambda p: (-p[1], p[0]))[:n]
    return spectra.sparkSession.createDataFrame(
        [(r + 1, i, v) for r, (i, v) in enumerate(ranked)], "rank int, mz_index int, importance double"
    )


def pair_classifier(labelled: DataFrame, settings: boosting.Settings = PAIR_SETTINGS) -> DataFrame:
    """Similarity 1 - balanced accuracy of a boosted classifier per category pair, on a stratified 40 % test part.

    All pairs are fitted together; a pixel takes part in the models of its own category.
    """
    spark = labelled.sparkSession
    classes = _classes(labelled)
    if len(classes) < 2:
        return spark.createDataFrame([], "category_a int, category_b int, confusion double")
    rows = _numbered(labelled, classes).withColumn("region", F.lit(0))
    rows = cut_lineage(stratified_split(rows).select("label", (~F.col("is_test")).alias("train"), "spectrum"))
    counts = {r["label"]: r["count"] for r in rows.where("train").groupBy("label").count().collect()}  # one row per class
    sizes = np.array([counts.get(c, 0) for c in range(len(classes))])
    task, pairs = boosting.pair_task(len(classes), sizes)
    edges = boosting.bin_edges(rows.where("train"), settings.bins)
    features = len(edges)
    blocks, _ = boosting.fit(boosting.binned_blocks(rows, edges, len(classes) - 1), features, sizes, task, settings)

    def tested(batches):
        for batch in batches:
            for _, label, train, margins in boosting._opened(batch, features):
                keep = np.flatnonzero(~train)
                right = (margins[keep] > 0) == (task.target[label[keep]] > 0)
                shape = right.shape[1]
                yield pd.DataFrame({
                    "model": task.takes[label[keep]].ravel(), "label": np.repeat(label[keep], shape), "right": right.ravel(), "n": 1,
                }).groupby(["model", "label"], as_index=False).sum().pipe(pa.RecordBatch.from_pandas, preserve_index=False)

    recall = blocks.mapInArrow(tested, "model long, label int, right long, n long").groupBy("model", "label").agg(
        (F.sum("right") / F.sum("n")).alias("recall")
    ).groupBy("model").agg((1 - F.avg("recall")).alias("confusion"))
    named = spark.createDataFrame([(m, classes[a], classes[b]) for m, (a, b) in enumerate(pairs)], "model long, category_a int, category_b int")
    return named.join(recall, "model").select("category_a", "category_b", "confusion")


def mlp_segment(labelled: DataFrame, n_mz: int, n_classes: int, settings: dense.Settings = dense.Settings()) -> dense.Dense:
    """Dense network over spectra with a weight per m/z, on balanced classes."""
    return dense.fit(labelled, n_mz, n_classes, settings)


def class_scores(model: dense.Dense, spectra: DataFrame) -> DataFrame:
    """Probability of each class per pixel: (region, y, x, pixel_id, scores)."""
    return dense.scores(model, spectra)


def sparse_mz_select(labelled: DataFrame, n: int = 10, penalty: float = 0.01, iterations: int = 50) -> DataFrame:
    """The n m/z with the largest absolute weight of an L1-penalized linear model."""
    model = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=iterations, labelCol="label", featuresCol=FEATURES
    ).fit(featured(labelled))
    size = abs(model.coefficientMatrix.toArray()).max(axis=0).tolist()
    table = labelled.sparkSession.createDataFrame(list(enumerate(size)), "mz_index int, weight double")
    order = Window.orderBy(F.desc("weight"), "mz_index")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

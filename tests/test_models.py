import inspect

import numpy as np
import pytest
from conftest import SF
from helpers import cube_frame, sparse_cube
from pyspark.sql import functions as F

from ionloom.models import factors, graph_embed, rank_embed, supervised
from ionloom.operators.normalize import tic
from ionloom.plans import catalog, methods


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(0)
    parts = rng.gamma(1.0, 2.0, (3, 8))
    weights = rng.dirichlet([0.3] * 3, (2, 9, 8))
    cubes = {r: weights[r] @ parts + rng.uniform(0, 0.05, (9, 8, 8)) for r in (0, 1)}
    cubes[0][0, 0] = 0
    return tic(cube_frame(spark, cubes)).persist()


def test_soft_rank_limit_and_gradient():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 5, (3, 12))
    ranks, _ = rank_embed.soft_rank(x, 1e-4)
    assert np.allclose(ranks, x.argsort(1).argsort(1) + 1, atol=1e-6)
    for strength in (0.5, 5.0):
        ranks, pull = rank_embed.soft_rank(x, strength)
        assert np.allclose(ranks.sum(1), 78)
        weight = rng.normal(size=x.shape)
        grad = pull(weight)
        for _ in range(10):
            i, j = rng.integers(3), rng.integers(12)
            step = np.zeros_like(x)
            step[i, j] = 1e-6
            up, down = rank_embed.soft_rank(x + step, strength)[0], rank_embed.soft_rank(x - step, strength)[0]
            assert grad[i, j] == pytest.approx(((up - down) * weight).sum() / 2e-6, abs=1e-4)


def test_nmf_error_falls(pixels):
    h, errors = factors.nmf_fit(pixels, 3, 8, 8)
    assert h.shape == (3, 8) and (h >= 0).all()
    assert all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:]))
    assert errors[-1] < 0.2 * errors[0]


def test_nmf_fit_does_not_depend_on_partitions(pixels):
    one, _ = factors.nmf_fit(pixels.coalesce(1), 2, 8, 3)
    many, _ = factors.nmf_fit(pixels.repartition(7), 2, 8, 3)
    assert np.allclose(one, many)


def test_pca_matches_numpy(pixels):
    got = {(r["region"], r["pixel_id"]): [r["e0"], r["e1"], r["e2"]] for r in factors.pca_project(pixels).collect()}
    rows = sorted((r["region"], r["pixel_id"], r["spectrum"]) for r in pixels.select("region", "pixel_id", "spectrum").collect())
    x = np.array([r[2] for r in rows])
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:3] * np.sign(axes[:3][np.arange(3), np.abs(axes[:3]).argmax(1)])[:, None]
    assert np.allclose(np.array([got[r[:2]] for r in rows]), centred @ axes.T, atol=1e-6)


def test_independent_components_are_white(pixels):
    out = np.array([[r["e0"], r["e1"], r["e2"]] for r in factors.fast_ica3(pixels, 20).collect()])
    assert np.allclose(np.cov(out.T, bias=True), np.eye(3), atol=1e-6)


@pytest.mark.parametrize("fit", [rank_embed.saliency_embed, rank_embed.spearman_embed])
def test_rank_embedding_improves(pixels, fit):
    coordinates, losses = fit(pixels, 20, 8, 0.1, sampling="random")
    assert coordinates.count() == 144
    assert losses[-1] < losses[0]


def test_cluster_embedding_improves(pixels):
    _, losses = rank_embed.saliency_cluster_embed(pixels, (4,), 0.5, 15, 6, 0.1, "random")
    assert losses[-1] < losses[0]


def test_reference_sampling(pixels):
    for name in ("random", "coreset", "kmeans++", "kmeans"):
        rows = rank_embed.reference_points(pixels, 5, name).collect()
        assert rows and all(max(r["spectrum"]) > 0 for r in rows)
        assert len({(r["region"], r["pixel_id"]) for r in rows}) == len(rows)


def test_landmark_placement_keeps_distances(spark):
    rng = np.random.default_rng(4)
    points = np.c_[rng.normal(size=(60, 3)) * [3, 2, 1], np.zeros((60, 2))].reshape(6, 10, 5)
    frame = cube_frame(spark, {0: points})
    placed = {r["pixel_id"]: [r["e0"], r["e1"], r["e2"]] for r in graph_embed.landmark_mds3(frame, 20).collect()}
    out = np.array([placed[i] for i in range(60)])
    flat = points.reshape(60, 5)
    assert np.allclose(
        np.linalg.norm(out[:, None] - out[None], axis=-1), np.linalg.norm(flat[:, None] - flat[None], axis=-1), atol=1e-6
    )


def test_isomap_unrolls_a_line(spark):
    line = np.zeros((1, 30, 2))
    line[0, :, 0] = np.arange(30)
    placed = {r["pixel_id"]: r["e0"] for r in graph_embed.landmark_isomap3(cube_frame(spark, {0: line}), 6, 2, 1).collect()}
    steps = np.diff([placed[i] for i in range(30)])
    assert np.allclose(np.abs(steps), 1, atol=0.05)


def test_spectral_vectors_are_orthonormal(pixels):
    rows = [r for r in graph_embed.spectral_embed3(pixels, 6, 4).collect() if r["region"] == 1]
    v = np.array([[r["e0"], r["e1"], r["e2"]] for r in rows])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-6)


def test_membership_weights_sum_to_log_k(pixels):
    edges = graph_embed.knn_graph(pixels, 8)
    sums = graph_embed.membership(edges, 8).groupBy("region", "i").agg(F.sum("w").alias("w")).collect()
    assert np.median([abs(r["w"] - 3) for r in sums]) < 1e-3


def test_classifiers(pixels):
    labelled = pixels.withColumn("label", (F.col("spectrum")[0] > F.col("spectrum")[1]).cast("int"))
    model = supervised.forest_classifier(labelled, 10, 4)
    predicted = supervised.predict_map(model, pixels).join(labelled.select("region", "pixel_id", F.col("label").alias("t")), ["region", "pixel_id"])
    assert predicted.where("label = t").count() > 130


def test_sparse_selection_finds_the_informative_mz(spark):
    cube = np.random.default_rng(6).uniform(0, 1, (12, 12, 9))
    labelled = cube_frame(spark, {0: cube}).withColumn("label", (F.col("spectrum")[2] > 0.5).cast("int"))
    ranked = supervised.sparse_mz_select(labelled, 3, 0.02).orderBy("rank").collect()
    assert ranked[0]["mz_index"] == 2 and len(ranked) == 3


def test_benchmark_skips_finished_methods(spark, pixels):
    done = spark.createDataFrame([("TOP3",)], "method string")
    board = methods.benchmark(pixels, 8, ["TOP3", "Percentile Ratio"], done, 100, 5)
    assert {r["method"] for r in board.select("method").distinct().collect()} == {"Percentile Ratio"}
    assert {"trustworthiness", "mrre_false", "lcmc", "spearman_cosine", "saliency_20_g2", "seconds"} <= {
        r["metric"] for r in board.select("metric").distinct().collect()
    }


@pytest.mark.parametrize("name, module, operator", [
    ("fuzzy_graph_embed", graph_embed, "fuzzy_graph_embed"), ("spectral_embed3", graph_embed, "spectral_embed3"),
    ("landmark_isomap3", graph_embed, "landmark_isomap3"), ("saliency_embed", rank_embed, "saliency_embed"),
    ("spearman_embed", rank_embed, "spearman_embed"), ("saliency_cluster_embed", rank_embed, "saliency_cluster_embed"),
    ("pixel_classifier", supervised, "pixel_classifier"), ("mz_importance", supervised, "pixel_classifier"),
    ("pair_classifier", supervised, "pair_classifier"), ("mlp_segment", supervised, "mlp_segment"),
])
def test_questions_run_operators_at_full_settings(spark, monkeypatch, name, module, operator):
    class Called(Exception):
        pass

    kind = inspect.signature(getattr(module, operator))

    def called(*args, **options):
        raise Called(kind.bind(*args, **options))

    monkeypatch.setattr(module, operator, called)
    with pytest.raises(Called) as caught:
        catalog.QUERIES[name](spark, SF)
    given = dict(caught.value.args[0].arguments)
    labels = {r["label"] for r in next(iter(given.values())).select("label").distinct().collect()}
    assert labels == set(range(10)) and given.pop("n_classes", 10) == 10
    size = {"k", "epochs", "points", "rounds", "landmarks", "trees", "depth", "clusters", "fraction", "hidden", "settings"}
    assert all(v == kind.parameters[k].default or k == "epochs" and v > kind.parameters[k].default for k, v in given.items() if k in size)


def test_benchmark_question_runs_every_method_and_keeps_seconds(spark, monkeypatch):
    def one(spectra, n_mz):
        return spectra.select("region", "y", "x", "pixel_id", *[F.col("spectrum")[i].alias(f"c{i}") for i in range(3)])

    asked = []
    monkeypatch.setattr(methods, "METHODS", {name: one for name in methods.METHODS})
    monkeypatch.setattr(methods, "score_image", lambda spectra, image, pairs, k, **shared: asked.append((pairs, k)) or image.select(
        "region", F.lit("lcmc").alias("metric"), F.lit(0.0).alias("value")).distinct())
    board = catalog.QUERIES["benchmark_methods"](spark, SF)
    assert set(asked) == {(30000, 100)} and len(asked) == len(methods.METHODS)
    seconds = board.where("metric = 'seconds'").select("method").distinct().collect()
    assert {r["method"] for r in seconds} == set(methods.METHODS)


def test_graphs_of_several_settings_equal_the_single_ones(pixels, monkeypatch):
    def rows(df, *columns):
        return [[r[c] for c in columns] for r in df.orderBy("region", "pixel_id").collect()]

    wanted = [(5, "euclidean"), (9, "chebyshev"), (12, "euclidean")]
    drawn = [(0, 5, 0.1, 2), (2, 12, 0.5, 2), (0, 5, 0.9, 2)]
    edges, points = graph_embed.fuzzy_graphs(pixels, wanted)
    for g, (k, metric) in enumerate(wanted):
        one, start = graph_embed.fuzzy_graph(pixels, 3, k, metric)
        weights = [{(r["region"], r["i"], r["j"]): r["w"] for r in df.collect()} for df in (edges.where(f"graph = {g}"), one)]
        assert weights[0] == weights[1]
        begun = [rows(df, "region", "pixel_id", "position") for df in (points.where(f"graph = {g}"), start)]
        assert begun[0] == begun[1] and len(begun[0]) == 2 * 72
    for most in (1 << 22, 72 * 12):  # every region in one task; the graph of most edges by joins
        monkeypatch.setattr(graph_embed, "EDGES_IN_TASK", most)
        images, seconds = graph_embed.embed_graphs(edges, points, 3, drawn)
        assert len(seconds) == 3 and min(seconds) > 0
        for picture, (graph, near, min_dist, epochs) in enumerate(drawn):
            own = [df.where(f"graph = {graph}").drop("graph") for df in (edges, points)]
            alone = graph_embed.embed_graph(*own, 3, near, min_dist, epochs)
            got, want = (rows(df, "region", "pixel_id", "e0", "e1", "e2") for df in (images.where(f"picture = {picture}"), alone))
            assert len(got) == 2 * 72 and np.allclose(got, want, atol=1e-6)


def test_images_scored_together_equal_single_scores(spark, pixels):
    normed = methods.normalize.tic(pixels)
    drawn = methods.metrics.spectra_distances(methods.sampling.sample_pairs(normed, 100), normed)
    images = {
        name: normed.select("region", "y", "x", "pixel_id", *[(F.col("spectrum")[(i + turn) % 8] * 1000).cast("int").alias(f"c{i}") for i in range(3)])
        for turn, name in enumerate(("b", "a", "c"))
    }
    images["c"] = images["c"].where("region = 1")
    stacked = None
    for name, image in images.items():
        one = image.select(F.lit(name).alias("method"), "region", "pixel_id", "c0", "c1", "c2")
        stacked = one if stacked is None else stacked.unionByName(one)
    got = {(r["method"], r["region"], r["metric"]): r["value"] for r in methods.score_images(normed, stacked, 5, drawn).collect()}
    want = {
        (name, r["region"], r["metric"]): r["value"]
        for name, image in images.items() for r in methods.score_image(normed, image, 100, 5, drawn=drawn).collect()
        if name != "c" or r["region"] == 1
    }
    assert set(got) == set(want) and {(n, r) for n, r, _ in got} == {("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 1)}
    assert all(got[key] == pytest.approx(value, abs=1e-9, nan_ok=True) for key, value in want.items())


def test_benchmark_searches_neighbours_once_a_metric(spark, pixels, monkeypatch):
    searched = []
    whole = graph_embed.knn
    monkeypatch.setattr(graph_embed, "knn", lambda spectra, k, metric, *a: searched.append((k, metric)) or whole(spectra, k, metric, *a))
    names = [n for n in methods.METHODS if n.startswith("UMAP") and ("n=15," in n or "n=50," in n)]
    monkeypatch.setattr(methods, "METHODS", {n: methods._Umap(m.k, m.min_dist, m.metric, 2) for n, m in methods.METHODS.items() if n in names})
    board = methods.benchmark(pixels, 8, names, None, 100, 5)
    assert sorted(searched) == [(50, "chebyshev"), (50, "euclidean")]
    seconds = {(r["method"], r["region"]): r["value"] for r in board.where("metric = 'seconds'").collect()}
    assert set(seconds) == {(n, r) for n in names for r in (0, 1)} and min(seconds.values()) > 0


def test_neighbour_scores_take_all_foreground_pixels(spark, pixels, monkeypatch):
    taken = []
    whole = methods.metrics.neighbour_ranks
    monkeypatch.setattr(methods.metrics, "neighbour_ranks", lambda sample, *a: taken.append(sample.count()) or whole(sample, *a))
    image = pixels.select("region", "y", "x", "pixel_id", *[F.col("spectrum")[i].alias(f"c{i}") for i in range(3)])
    methods.score_image(pixels, image, 100, 5)
    assert set(taken) == {2 * 9 * 8 - 1}


@pytest.mark.parametrize("fit, options", [
    (rank_embed.saliency_embed, {"similarity_reg": 0.3}), (rank_embed.spearman_embed, {"sampling": "random"}),
    (rank_embed.saliency_cluster_embed, {"clusters": (4,), "fraction": 0.5}),
])
def test_rank_embedding_in_one_task_and_by_jobs(pixels, monkeypatch, fit, options):
    found = []
    for cells in (1 << 30, 0, 72 * 15 - 1):  # whole regions, no region, and (where a point is background) one of two
        monkeypatch.setattr(rank_embed, "CELLS_IN_TASK", cells)
        monkeypatch.setattr(rank_embed, "BLOCK_ROWS", 7)
        coordinates, losses = fit(pixels, points=15, epochs=3, **options)
        rows = coordinates.orderBy("region", "pixel_id").collect()
        found.append((np.array([[r["e0"], r["e1"], r["e2"]] for r in rows]), losses, [(r["region"], r["pixel_id"]) for r in rows]))
    assert found[0][2] == found[1][2] == found[2][2] and len(set(found[0][2])) == 2 * 72
    for other in found[1:]:
        assert np.allclose(found[0][0], other[0], atol=1e-7) and np.allclose(found[0][1], other[1], rtol=1e-9)


@pytest.mark.parametrize("fit", [rank_embed.saliency_embed, rank_embed.spearman_embed, rank_embed.saliency_cluster_embed])
def test_rank_embedding_takes_more_reference_points_than_the_driver_holds(pixels, monkeypatch, fit):
    monkeypatch.setattr(rank_embed, "MAX_STATE_ROWS", 15)  # the two regions have more together, none has more alone
    found = []
    for cells in (1 << 30, 0):  # nothing of small regions is held by the driver; large regions follow each other
        monkeypatch.setattr(rank_embed, "CELLS_IN_TASK", cells)
        coordinates, losses = fit(pixels, points=15, epochs=3)
        found.append((np.array([r[2:] for r in coordinates.orderBy("region", "pixel_id").collect()]), losses))
    assert len(found[0][0]) == 2 * 72 and all(np.isfinite(x).all() for x, _ in found)
    assert np.allclose(found[0][0], found[1][0], atol=1e-7) and np.allclose(found[0][1], found[1][1], rtol=1e-9)


def test_blocks_of_many_regions_are_full(spark):
    n, regions = 80, 9
    rows = [(r, i, [0, 1], True, False, [], [0.0, 0.0, float(i)]) for r in range(regions) for i in range(n)]
    table = spark.createDataFrame(rows, "region int, pixel_id long, input_rank array<int>, inside boolean, named boolean, clusters array<int>, p array<double>")
    blocks = rank_embed._packed(table.drop("p").repartition(5), table.select("region", "pixel_id", "p"), 3)
    sizes = [len(r["inside"]) for r in blocks.select("inside").collect()]
    assert sorted(sizes) == [16] * regions + [64] * regions


def test_hash_equals_the_one_of_spark(spark):
    rows = spark.createDataFrame([(5, -3, 7), (0, 0, 0), (-(1 << 62), 12345678901, -1)], "a long, b long, c long")
    got = rows.select("a", "b", "c", F.xxhash64("a", "b", "c").alias("h")).collect()
    columns = [np.array([r[c] for r in got]) for c in "abc"]
    assert graph_embed.xxhash64(*columns).tolist() == [r["h"] for r in got]


def test_block_lanczos_against_dense_eigenvectors():
    rng = np.random.default_rng(3)
    for n, blocks in ((60, 1), (150, 1), (90, 3), (3, 1)):  # three blocks: the largest eigenvalue three times
        full = rng.random((n, n)) * (rng.random((n, n)) < 0.2)
        full = full + full.T + np.eye(n) * 0.1
        part = np.arange(n) * blocks // n
        full *= part[:, None] == part[None]
        degree = full.sum(1)
        full /= np.sqrt(np.outer(degree, degree))
        i, j = np.nonzero(full)
        count = min(4, n)
        v = graph_embed.krylov_vectors(i, j, full[i, j], rng.standard_normal((n, count)), 1e-8, 500, 16)
        values = np.sort(np.linalg.eigvalsh(full))[::-1][:count]
        assert np.allclose(v.T @ v, np.eye(count), atol=1e-8)
        assert np.allclose(np.sort(np.linalg.eigvalsh(v.T @ full @ v))[::-1], values, atol=1e-7)


def test_graph_embedding_in_one_task_and_by_jobs(pixels, monkeypatch):
    edges = graph_embed.cut_lineage(graph_embed.symmetrize(graph_embed.membership(graph_embed.knn_graph(pixels, 6), 6)))
    vectors = graph_embed.cut_lineage(graph_embed.leading_vectors(edges, 3))
    found = []
    for limit in (1 << 30, 0):
        monkeypatch.setattr(graph_embed, "EDGES_IN_TASK", limit)
        monkeypatch.setattr(graph_embed, "leading_vectors", lambda e, dims, seed: vectors)
        rows = graph_embed.fuzzy_graph_embed(pixels, 3, 6, epochs=3).orderBy("region", "pixel_id").collect()
        found.append(np.array([[r["region"], r["pixel_id"], r["e0"], r["e1"], r["e2"]] for r in rows]))
    assert len(found[0]) == 2 * 72 and np.allclose(found[0], found[1], atol=1e-6)


def test_large_graphs_reach_the_same_vectors(spark, monkeypatch):
    cliques = [(i, j) for i in range(20) for j in range(20) if i != j and i // 10 == j // 10] + [(3, 15), (15, 3)]
    edges = spark.createDataFrame([(r, i, j, 1.0 + 0.1 * r) for r in (0, 1) for i, j in cliques], "region int, i long, j long, w double")
    found = []
    for limit in (1 << 30, 0):
        monkeypatch.setattr(graph_embed, "EDGES_IN_TASK", limit)
        rows = graph_embed.leading_vectors(edges, 1, rounds=30, tolerance=1e-6).where("region = 1").orderBy("pixel_id").collect()
        found.append(np.array([r["e0"] for r in rows]))
    assert abs(found[0] @ found[1]) > 0.999 and len({np.sign(x) for x in found[0][:10]}) == 1 != len({np.sign(x) for x in found[0]})


def test_graph_embedding_keeps_groups_together(spark):
    rng = np.random.default_rng(2)
    group = rng.integers(0, 3, (12, 12))
    cube = rng.normal(0, 0.05, (12, 12, 5)) + np.eye(3, 5)[group] * 4 + 1
    rows = graph_embed.fuzzy_graph_embed(cube_frame(spark, {0: cube}), 3, 10, epochs=60).orderBy("pixel_id").collect()
    x = np.array([[r["e0"], r["e1"], r["e2"]] for r in rows])
    own = group.ravel()
    gap = np.linalg.norm(x[:, None] - x[None], axis=-1)
    np.fill_diagonal(gap, np.inf)
    assert (own[gap.argsort(axis=1)[:, :5]] == own[:, None]).mean() > 0.98


def test_small_regions_are_not_put_into_one_task(spark, monkeypatch):
    """Each region runs all its epochs in one task, and regions run beside each other however small their blocks are."""
    tasks, run = [], rank_embed._small_regions

    def watched(*given):
        tasks.append(run(*given).rdd.getNumPartitions())
        return run(*given)

    monkeypatch.setattr(rank_embed, "_small_regions", watched)
    cubes = {r: sparse_cube(np.random.default_rng(r), 4, 4, 5, 0.2) for r in range(4)}
    coordinates, losses = rank_embed.saliency_embed(cube_frame(spark, cubes), points=6, epochs=2, sampling="random")
    assert tasks == [4] and len(losses) == 2
    assert coordinates.groupBy("region").count().orderBy("region").collect() == [(r, 16) for r in range(4)]

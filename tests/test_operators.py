import numpy as np
import pytest
from helpers import cube_frame, sparse_cube
from pyspark.sql import functions as F

from ionloom.functions import geometry as G
from ionloom.functions import spectrum as S
from ionloom.model import full_grid, to_ions
from ionloom.operators import aggregates, binning, compare, filters, joins, metrics, neighbors, normalize, peaks, sampling, spatial


def test_tic_sums_to_one_and_empty_pixels_stay_zero(spark):
    cube = sparse_cube(np.random.default_rng(0), 3, 4, 6)
    cube[1, 2] = 0
    for r in normalize.tic(cube_frame(spark, {0: cube})).collect():
        assert sum(r["spectrum"]) == pytest.approx(0 if (r["y"], r["x"]) == (1, 2) else 1, abs=1e-4)


def test_spatial_tic_matches_numpy(spark):
    cubes = {r: sparse_cube(np.random.default_rng(r), 5, 4, 7) for r in (0, 1)}
    got = {(r["region"], r["y"], r["x"]): r["spectrum"] for r in normalize.spatial_tic(cube_frame(spark, cubes)).collect()}
    for region, cube in cubes.items():
        normed = cube / (1e-6 + cube.sum(-1, keepdims=True))
        want = np.minimum(normed / (1e-6 + np.quantile(normed, 0.99, axis=(0, 1))), 1)
        for y, x in np.ndindex(want.shape[:2]):
            assert got[region, y, x] == pytest.approx(want[y, x].tolist(), abs=1e-9)


def test_plateau_and_strict_peak(spark):
    curve = [0, 2, 2, 2, 1, 3, 0]
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(curve)], "region int, mz_index int, v double")
    assert sorted(r["mz_index"] for r in peaks.find_peaks(rows, ["region"], "v").collect()) == [2, 5]
    assert [r["mz_index"] for r in peaks.find_peaks(rows, ["region"], "v", 2.5).collect()] == [5]


def test_rank_test_against_pair_counting(spark):
    cube = sparse_cube(np.random.default_rng(3), 6, 5, 4)
    pixels = cube_frame(spark, {0: cube})
    code = F.when(F.col("pixel_id") < 9, 0).when(F.col("pixel_id") < 20, 1).otherwise(2)
    members = pixels.select("region", "pixel_id", code.alias("code"))
    flat = cube.reshape(-1, 4)
    groups = [flat[:9], flat[9:20], flat[20:]]
    for source in (pixels, to_ions(pixels)):
        rows = compare.pairwise_u(source, members, 4).collect()
        assert len(rows) == 12
        for r in rows:
            a, b = groups[r["a"]][:, r["mz_index"]], groups[r["b"]][:, r["mz_index"]]
            u = (a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()
            assert r["u"] == pytest.approx(u)
            assert r["mean_a"] == pytest.approx(a.mean()) and r["mean_b"] == pytest.approx(b.mean())
            both = np.r_[a, b]
            _, t = np.unique(both, return_counts=True)
            n = len(both)
            s = np.sqrt(len(a) * len(b) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
            mu = len(a) * len(b) / 2
            assert r["z"] == pytest.approx((max(u, 2 * mu - u) - mu - 0.5) / s)


def test_edge_tables_give_defined_values(spark):
    flat = cube_frame(spark, {0: np.full((2, 3, 4), 2.0), 1: np.zeros((2, 2, 4))})
    q = sampling.coreset_probability(flat)
    assert {round(r.q, 6) for r in q.where("region = 0").collect()} == {round(1 / 6, 6)}
    scores = {(r.region, r.score) for r in metrics.outlier_score(flat).collect()}
    assert {region for region, _ in scores} == {0, 1} and (1, 0.0) in scores
    sample = flat.where("region = 0").select("region", "pixel_id", "spectrum")
    ranks = metrics.reference_ranks(flat, sample).collect()
    assert len(ranks) == 10 and all(not r.max_rank for r in ranks if r.region == 1)
    assert metrics.pixel_reference_distances(flat, sample).select("region").distinct().count() == 1


def test_reference_points_are_not_held_for_all_regions_at_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    cubes = {r: rng.random((3, 4, 5)) + 0.1 for r in range(3)}
    pixels = cube_frame(spark, cubes)
    sample = pixels.where("region < 2 AND pixel_id % 3 = 0").select("region", "pixel_id", "spectrum")
    monkeypatch.setattr(metrics, "MAX_REFERENCE_ROWS", 1)  # no table of all regions may be made
    monkeypatch.setattr(metrics, "GROUP_PIXELS", 5, raising=False)  # a region is dealt to several groups
    ranks = {(r.region, r.pixel_id): r for r in metrics.reference_ranks(pixels, sample).collect()}
    gaps = {(r.region, r.pixel_id, r.reference_id): r for r in metrics.pixel_reference_distances(pixels, sample).collect()}
    near = {(r.region, r.pixel_id): r._d for r in metrics.nearest_reference(pixels, sample).collect()}
    assert len(ranks) == len(near) == 36 and len(gaps) == 2 * 12 * 4
    for region, cube in cubes.items():
        flat = cube.reshape(12, 5)
        unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        for i in range(12):
            row = ranks[region, i]
            if region == 2:
                assert not row.max_rank and not row.cosine_rank and near[region, i] == 0
                continue
            cosine = [1 - unit[i] @ unit[j] for j in range(0, 12, 3)]
            widest = [np.abs(flat[i] - flat[j]).max() for j in range(0, 12, 3)]
            place = [np.argsort(np.argsort(np.round(x, 12), kind="stable")).tolist() for x in (cosine, widest)]
            assert row.cosine_rank == place[0] and row.max_rank == np.maximum(*place).tolist()
            assert [gaps[region, i, j].maxabs for j in range(0, 12, 3)] == pytest.approx(widest)
            assert near[region, i] == pytest.approx(min(w for w, j in zip(widest, range(0, 12, 3)) if j != i))


def test_few_pairs_and_single_pixels(spark):
    for n in (1, 2, 6):
        gaps = spark.createDataFrame([(0, i, 0.1 * i, 0.2 * i, 1.0 * i) for i in range(n)], "region int, pair int, cosine double, maxabs double, output double")
        metrics.correlation_curve(gaps).collect()
        metrics.correlation_curve(gaps, "maxabs").collect()
        assert metrics.saliency_smoothness(gaps).where("value is null").count() == 0
    ranks = spark.createDataFrame([(0, 1, 2, 1, 1, 2)], "region int, i long, j long, rank_in long, rank_out long, n long")
    for found in (metrics.trustworthiness(ranks, 1), metrics.mrre(ranks, 1), metrics.lcmc(ranks, 1)):
        assert found.count() == 1


def test_one_sided_masks_and_regions_without_scores(spark):
    ions = spark.createDataFrame([(0, 0, 0, 0, 1, 2.0), (1, 0, 0, 0, 1, 3.0)], "region int, y int, x int, pixel_id long, mz_index int, intensity double")
    masks = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "region int, pixel_id long, side int")
    peaks = spark.createDataFrame([(0, 1), (1, 1)], "region int, mz_index int")
    found = {r.region: r.score for r in aggregates.roi_mean_ratio(ions, masks, peaks).collect()}
    assert found == {0: 1.0, 1: 0.0}
    edges = spark.createDataFrame([(0, "a", "b", 0.0)], "region int, category_a string, category_b string, confusion double")
    assert {r.weight for r in aggregates.node_weight(edges).collect()} == {0.0}
    stats = spark.createDataFrame([(0, 1, 0.9)], "region int, mz_index int, score double")
    image = compare.aggregated_ion_image(ions, ions.select("region", "y", "x", "pixel_id"), stats)
    assert {r.region for r in image.collect()} == {0, 1}
    black = spark.createDataFrame([(0, 0, 0, 0)], "region int, y int, x int, value int")
    assert compare.mean_ion_image(black).first().value == 0


def test_random_sample_keeps_columns_and_rule(spark):
    pixels = cube_frame(spark, {0: np.arange(60.0).reshape(5, 4, 3), 1: np.ones((2, 2, 3))})
    drawn = sampling.random_sample(pixels, 6, 1).collect()
    assert sorted((r.region, r.sample_index) for r in drawn) == [(0, i) for i in range(6)] + [(1, i) for i in range(4)]
    assert all(len(r.spectrum) == 3 for r in drawn)
    assert metrics.metric_sample(pixels, 5).count() == 9 and metrics.metric_sample(pixels).count() == 24


def test_rotation_four_times_is_identity(spark):
    pixels = cube_frame(spark, {0: sparse_cube(np.random.default_rng(0), 3, 5, 2)}).select("region", "y", "x", "pixel_id")
    turned = pixels
    for _ in range(4):
        turned = filters.rotate90(turned)
    assert sorted(map(tuple, turned.select(*pixels.columns).collect())) == sorted(map(tuple, pixels.collect()))


def test_binning_rounds_half_to_even_sums_and_drops_outside(spark):
    rows = [(0, 0, 0, 300.1, 1.0), (0, 0, 0, 300.3, 2.0), (0, 0, 0, 300.2, 4.0), (0, 0, 0, 299.0, 8.0), (0, 0, 1, 305.0, 16.0)]
    frame = spark.createDataFrame(rows, "region int, y int, x int, mz double, intensity double")
    got = {(r["x"], r["mz_index"]): r["intensity"] for r in binning.bin_peaks(frame, 300, 302, 5).collect()}
    want = {}
    for _, _, x, mz, v in rows:
        b = int(np.round((np.float64(np.float32(mz)) - 300) * 5))
        if 0 <= b < 15:
            want[x, b] = want.get((x, b), 0) + v
    assert got == want


def test_window_join_finds_every_match_once(spark):
    rng = np.random.default_rng(5)
    mzs = np.r_[np.round(rng.uniform(300, 303, 200), 3), np.full(100, 301.0)]
    peaks_frame = spark.createDataFrame(
        [(0, i % 7, i % 5, float(m), 1.0) for i, m in enumerate(mzs)], "region int, y int, x int, mz double, intensity double"
    )
    targets = np.round(np.arange(300, 303, 0.037), 3)
    target_frame = spark.createDataFrame([(i, float(t)) for i, t in enumerate(targets)], "target_index int, target_mz double")
    got = binning.window_join(peaks_frame, target_frame, 0.05).groupBy("target_index").count().collect()
    want = {i: int(((mzs >= t - 0.05) & (mzs <= t + 0.05)).sum()) for i, t in enumerate(targets)}
    assert {r["target_index"]: r["count"] for r in got} == {i: n for i, n in want.items() if n}


@pytest.mark.parametrize("shape", [(1, 1, 5), (1, 6, 3), (5, 4, 9)])
def test_cube_filters_reflect_the_border(spark, shape):
    cube = sparse_cube(np.random.default_rng(7), *shape)
    padded = np.pad(cube, 1, mode="edge")
    got = spatial.cube_filters(cube_frame(spark, {0: cube}), 4).collect()
    for r in got:
        for i, c in enumerate(r["cells"]):
            y, x, z = r["y"], r["x"], r["block"] * 4 + i
            around = np.sort(padded[y:y + 3, x:x + 3, z:z + 3].ravel())
            assert (c["own"], c["local_max"], c["local_median"]) == (cube[y, x, z], around[-1], around[13])
    assert sum(len(r["cells"]) for r in got) == cube.size


def test_components_against_flood_fill(spark):
    rng = np.random.default_rng(11)
    mask = (rng.random((12, 15)) < 0.45).astype(int)
    mask[3, :] = 1  # one long run
    frame = spark.createDataFrame(
        [(0, y, x, int(mask[y, x])) for y in range(12) for x in range(15)], "region int, y int, x int, value int"
    )
    got = {}
    for r in spatial.connected_components(frame).collect():
        got.setdefault(r["label"], set()).add((r["y"], r["x"]))
    want, seen = [], set()
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        blob, todo = set(), [start]
        while todo:
            p = todo.pop()
            if p in blob:
                continue
            blob.add(p)
            todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)
                     if 0 <= p[0] + a < 12 and 0 <= p[1] + b < 15 and mask[p[0] + a, p[1] + b]]
        seen |= blob
        want.append(blob)
    assert sorted(map(sorted, got.values())) == sorted([sorted((int(a), int(b)) for a, b in w) for w in want])


def test_full_grid_and_densify(spark):
    extent = spark.createDataFrame([(0, 2, 3), (4, 1, 1)], "region int, height int, width int")
    assert sorted((r["region"], r["y"], r["x"], r["pixel_id"]) for r in full_grid(extent).collect()) == [
        (0, y, x, y * 3 + x) for y in range(2) for x in range(3)
    ] + [(4, 0, 0, 0)]


def test_nearest_takes_the_lower_index_on_a_tie(spark):
    axis = spark.createDataFrame([(0, i, 300.0 + i) for i in range(100)], "region int, mz_index int, mz double")
    asked = spark.createDataFrame([(0, v) for v in (10.0, 300.5, 316.0, 315.5, 399.4, 1000.0)], "region int, mz double")
    got = {r["requested"]: r["mz_index"] for r in joins.nearest_mz(axis, asked).collect()}
    assert got == {10.0: 0, 300.5: 0, 316.0: 16, 315.5: 15, 399.4: 99, 1000.0: 99}


def test_polygon_edges_belong_to_it(spark):
    grid = full_grid(spark.createDataFrame([(0, 8, 8)], "region int, height int, width int"))
    shape = spark.createDataFrame([(0, 1, [1, 5, 5, 1], [2, 2, 4, 4])], "region int, polygon int, xs array<int>, ys array<int>")
    got = {(r["y"], r["x"]) for r in joins.polygon_pixels(grid, shape, 3).collect()}
    assert got == {(y, x) for y in (2, 3, 4) for x in range(1, 6)}
    area = shape.select(G.polygon_area(F.col("xs"), F.col("ys"))).first()[0]
    assert area == 8.0


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev", "cosine"])
def test_knn_with_a_third_of_equal_points(spark, metric):
    rng = np.random.default_rng(1)
    vectors = rng.gamma(1.0, 1.0, (120, 5))
    vectors[:40] = vectors[0]
    frame = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(vectors)], "region int, pixel_id long, vector array<double>")
    got = {}
    for r in neighbors.knn(frame, 6, metric, block=16, pivots=5).collect():
        got.setdefault(r["i"], []).append((r["rank"], r["distance"]))
    gaps = neighbors.distance_matrix(vectors, vectors, metric)
    np.fill_diagonal(gaps, np.inf)
    for i in range(120):
        assert [d for _, d in sorted(got[i])] == pytest.approx(np.sort(gaps[i])[:6].tolist(), abs=1e-9)


def test_identity_picture_is_fully_trustworthy(spark):
    cube = sparse_cube(np.random.default_rng(2), 5, 6, 4, 0.1) + 0.1
    sample = cube_frame(spark, {0: cube}).withColumn("out", F.col("spectrum"))
    ranks = metrics.neighbour_ranks(sample, 5)
    assert metrics.trustworthiness(ranks, 5).first()["trustworthiness"] == pytest.approx(1.0)
    scores = metrics.mrre(ranks, 5).first()
    assert (scores["mrre_false"], scores["mrre_missing"]) == (1.0, 1.0)
    assert metrics.lcmc(ranks, 5).first()["lcmc"] == pytest.approx(1 - 5 / 29)


def test_neighbour_ranks_in_one_task_and_by_counting(spark, monkeypatch):
    """Against all ranks in NumPy, with many equal distances in both spaces."""
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 3, (60, 3)).astype(float), rng.integers(0, 4, (60, 2)).astype(float)
    rows = [(0, 7 * i % 60, a[i].tolist(), b[i].tolist()) for i in range(60)]
    sample = spark.createDataFrame(rows, "region int, pixel_id long, spectrum array<double>, out array<double>")
    ids = np.array([r[1] for r in rows])
    ranks = []
    for values, metric in ((a, "chebyshev"), (b, "euclidean")):
        gap = neighbors.distance_matrix(values, values, metric)
        np.fill_diagonal(gap, -1)
        place = np.empty((60, 60), int)
        for i in range(60):
            place[i, np.lexsort((ids, gap[i]))] = np.arange(60)
        ranks.append(place)
    want = {(0, ids[i], ids[j], ranks[0][i, j], ranks[1][i, j], 60) for i in range(60) for j in range(60)
            if i != j and min(ranks[0][i, j], ranks[1][i, j]) <= 6}
    monkeypatch.setattr(metrics, "RANK_BLOCK", 25)
    for limit in (4096, 10):
        monkeypatch.setattr(metrics, "PIXELS_IN_TASK", limit)
        got = metrics.neighbour_ranks(sample, 6, ("chebyshev", "euclidean")).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_samples_do_not_depend_on_partitions(spark):
    pixels = cube_frame(spark, {0: sparse_cube(np.random.default_rng(0), 12, 11, 3)})
    for draw in (
        lambda p: sampling.random_sample(p.select("region", "pixel_id"), 17, 3),
        lambda p: sampling.sample_pairs(p, 50, 3),
        lambda p: sampling.coreset_sample(p, 20, 3).select("region", "draw", "pixel_id"),
    ):
        one, many = draw(pixels.coalesce(1)).collect(), draw(pixels.repartition(8)).collect()
        assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and one


def test_stratified_split_keeps_the_share(spark):
    rows = spark.createDataFrame([(0, i, 0 if i < 100 else 1) for i in range(130)], "region int, pixel_id long, label int")
    got = {(r["label"], r["is_test"]): r["count"] for r in sampling.stratified_split(rows).groupBy("label", "is_test").count().collect()}
    assert got == {(0, True): 40, (0, False): 60, (1, True): 12, (1, False): 18}


def test_row_local_expressions(spark):
    frame = spark.createDataFrame([([1.0, 3.0, 0.0, 4.0],), ([0.0] * 4,)], "s array<double>")
    c = F.col("s")
    first, empty = frame.select(
        S.top3(c).alias("top"), S.avg_mz(c).alias("avg"), S.certainty(c).alias("certainty"),
        S.quantile(F.sort_array(c), 0.3).alias("q"), S.sharp_softmax(c, 1.0).alias("soft"), S.median_norm(c).alias("median"),
    ).collect()
    share = np.array([1, 3, 4]) / 8
    assert first["top"] == [4.0, 3.0, 1.0]
    assert first["avg"] == pytest.approx((3 + 12) / 8 / 4)
    assert first["certainty"] == pytest.approx(1 + (share * np.log(share)).sum() / np.log(4))
    assert first["q"] == pytest.approx(np.quantile([1, 3, 0, 4], 0.3))
    assert sum(first["soft"]) == pytest.approx(1)
    assert first["median"] == pytest.approx([v / (2 + 1e-6) for v in (1, 3, 0, 4)])
    assert empty["avg"] is None and empty["certainty"] == 1.0


def test_equalize_single_valued_group(spark):
    image = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 0.0), (1, 4.0), (1, 4.0)], "region int, v double")
    got = normalize.hist_equalize(image, "v", 8).collect()
    for region, values in ((0, [1.0, 1.0]), (1, [0.0, 4.0, 4.0])):
        hist, edges = np.histogram(values, 8, density=True)
        cdf = hist.cumsum()
        want = np.interp(values, edges[:-1], 7 * cdf / cdf[-1])
        assert sorted(r["v"] for r in got if r["region"] == region) == pytest.approx(sorted(want))


def test_coreset_draws_follow_the_cumulative_probability(spark, monkeypatch):
    pixels = cube_frame(spark, {0: sparse_cube(np.random.default_rng(9), 9, 8, 3)})
    q = {r["pixel_id"]: r["q"] for r in sampling.coreset_probability(pixels).collect()}
    assert sum(q.values()) == pytest.approx(1)
    edges = np.cumsum([q[i] for i in range(72)])
    drawn = spark.range(200).select(F.lit(0).alias("region"), F.col("id").cast("int").alias("draw")).select(
        "draw", sampling.uniform(5, "region", "draw").alias("u")
    )
    want = {r["draw"]: int(np.searchsorted(edges, r["u"] * edges[-1], "right")) for r in drawn.collect()}
    rows = sampling.coreset_sample(pixels, 200, 5).collect()
    assert {r["draw"]: r["pixel_id"] for r in rows} == want
    assert all(r["weight"] == pytest.approx(1 / (q[r["pixel_id"]] * 200)) for r in rows)


def test_chromatogram_meets_jobs_with_peaks_only(spark):
    """Against a plain loop, with nulls and repeats; frames and jobs, many of each in one window, are not joined alone."""
    rng = np.random.default_rng(1)
    frames = [(i, int(rng.integers(-300, 300))) for i in range(30)] + [(3, 10), (None, 5), (4, None)]
    scans = [(int(rng.integers(0, 31)), float(rng.uniform(290, 500)), float(rng.integers(0, 9)) / 100, float(i)) for i in range(300)]
    scans += [(None, 310.0, 0.03, 1.0), (3, None, 0.03, 1.0), (3, 310.0, None, 1.0), (3, 310.0, 0.03, None), scans[0]]
    jobs = [(j, int(t), int(t + rng.integers(-20, 400)), float(m), float(m + rng.integers(-5, 90)), 0.02, 0.06)
            for j, (t, m) in enumerate(zip(rng.integers(-400, 200, 12), rng.integers(280, 480, 12)))]
    jobs += [jobs[0], (None, -300, 300, 300.0, 400.0, 0.0, 0.03), (90, None, 5, 300.0, 400.0, 0.0, 1.0), (91, 0, 9, 300.0, None, 0.0, 1.0)]
    traced = binning.ion_chromatogram(
        spark.createDataFrame(scans, "frame_id long, mz double, mobility double, intensity double"),
        spark.createDataFrame(frames, "frame_id long, t int"),
        spark.createDataFrame(jobs, "job int, t0 int, t1 int, mz0 double, mz1 double, k0 double, k1 double"),
    )
    between = lambda low, v, high: None not in (low, v, high) and low <= v <= high
    want = {}
    for job, t0, t1, mz0, mz1, k0, k1 in jobs:
        for frame, t in frames:
            for own, mz, k, v in scans:
                if own is not None and own == frame and between(t0, t, t1) and between(mz0, mz, mz1) and between(k0, k, k1):
                    want.setdefault((job, frame), []).append(v)
    want = {key: None if all(v is None for v in held) else pytest.approx(sum(v for v in held if v is not None)) for key, held in want.items()}
    assert {(r["job"], r["frame_id"]): r["intensity"] for r in traced.collect()} == want and len(want) > 30
    joins = [line for line in traced._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line and "_tc#" in line]
    assert joins and all("LeftSemi" in line or "_mc#" in line for line in joins)
    none = binning.ion_chromatogram(
        spark.createDataFrame(scans, "frame_id long, mz double, mobility double, intensity double"), spark.createDataFrame(frames, "frame_id long, t int"),
        spark.createDataFrame([], "job int, t0 int, t1 int, mz0 double, mz1 double, k0 double, k1 double"),
    )
    assert none.count() == 0

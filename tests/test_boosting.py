"""Boosted trees: split choice against a plain scan, the same trees by level and in one task, on any partitions."""

import numpy as np
import pytest
from helpers import cube_frame
from pyspark.sql import functions as F

from ionloom.models import boosting, supervised
from ionloom.session import ship_package


def plain_split(codes, g, h, unit, s):
    """Best (gain, feature, cut) by trying every cut of every feature."""
    def worth(a, b):
        w = float(np.clip(-a / (b + s.penalty), -s.max_step, s.max_step)) if s.max_step else -a / (b + s.penalty)
        return -(2 * a * w + (b + s.penalty) * w * w)

    g, h = g / unit, h / unit
    best = (0.0, 0, 0)
    for f in range(codes.shape[1]):
        for cut in range(s.bins - 1):
            left = codes[:, f] <= cut
            if left.any() and not left.all() and min(h[left].sum(), h[~left].sum()) >= s.child_weight:
                gain = worth(g[left].sum(), h[left].sum()) + worth(g[~left].sum(), h[~left].sum()) - worth(g.sum(), h.sum())
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    return best


@pytest.mark.parametrize("settings", [boosting.Settings(bins=8), boosting.Settings(bins=8, child_weight=3.0, max_step=0.3, penalty=0.5)])
def test_split_choice_of_one_level(settings):
    rng = np.random.default_rng(2)
    for _ in range(20):
        codes = rng.integers(0, 8, (60, 5)).astype(np.uint8)
        g, h = rng.integers(-1000, 1000, 60), rng.integers(1, 400, 60)
        unit = 1000.0
        sums = boosting.histograms(codes, np.zeros(60, np.int64), g, h, 1, 8)
        gain, feature, cut, left = (x[0] for x in boosting.best_splits(sums, unit, settings))
        want = plain_split(codes, g, h, unit, settings)
        assert gain == pytest.approx(want[0], abs=1e-6) and (gain < 1e-6 or (feature, cut) == want[1:])
        below = codes[:, feature] <= cut
        assert gain < 1e-6 or left.tolist() == [g[below].sum(), h[below].sum(), below.sum()]


def test_subtree_ends_where_no_split_gains():
    settings = boosting.Settings(depth=3, bins=4)
    codes = np.array([[0], [0], [3], [3]], np.uint8)
    made = boosting.grow(codes, np.array([-8, -8, 8, 8]), np.array([8, 8, 8, 8]), 0, 4.0, settings)
    assert [m[:3] for m in made] == [(0, 0, 0), (1, -1, 0), (2, -1, 0)]
    assert made[1][3] == pytest.approx(4 / 5) and made[2][3] == pytest.approx(-4 / 5)


@pytest.fixture(scope="module")
def labelled(spark):
    ship_package(spark)
    rng = np.random.default_rng(0)
    cube = rng.gamma(1.0, 1.0, (20, 20, 6))
    df = cube_frame(spark, {0: cube, 1: cube[::-1]})
    high = F.array_position("spectrum", F.array_max("spectrum")).cast("int")
    return df.withColumn("label", F.when(high <= 3, high * 10).otherwise(40)).persist()


def fitted(rows, task, settings, cells):
    edges = boosting.bin_edges(rows, settings.bins)
    sizes = np.array([r["count"] for r in rows.groupBy("label").count().orderBy("label").collect()])
    blocks = boosting.binned_blocks(rows.withColumn("train", F.lit(True)), edges, task.takes.shape[1])
    return boosting.fit(blocks, len(edges), sizes, task, settings, cells)[1]


@pytest.mark.parametrize("kind", ["pairs", "softmax"])
def test_levels_tasks_and_partitions_give_the_same_trees(labelled, monkeypatch, kind):
    monkeypatch.setattr(boosting, "KEPT", 2)
    monkeypatch.setattr(boosting, "BLOCK", 100)
    monkeypatch.setattr(boosting, "RANGE", 1 << 12)
    settings = boosting.Settings(rounds=4, depth=3, bins=16)
    rows = supervised._numbered(labelled, [10, 20, 30, 40])
    sizes = np.array([r["count"] for r in rows.groupBy("label").count().orderBy("label").collect()])
    task = boosting.pair_task(4, sizes)[0] if kind == "pairs" else boosting.class_task(4)
    ways = [fitted(rows, task, settings, 0), fitted(rows.repartition(5), task, settings, 1 << 30), fitted(rows.coalesce(1), task, settings, 900)]
    for other in ways[1:]:
        for a, b in zip(ways[0], other, strict=True):
            for part in ("feature", "cut", "value"):
                assert np.array_equal(getattr(a, part), getattr(b, part)), part


def test_margins_follow_a_plain_fit(labelled):
    """All rounds again in NumPy, with the gradients of the formula and a scan for each split."""
    settings = boosting.Settings(rounds=3, depth=2, bins=8)
    rows = supervised._numbered(labelled, [10, 20, 30, 40]).where("label < 2")
    task = boosting.class_task(2)
    trees = fitted(rows, task, settings, 0)
    edges = boosting.bin_edges(rows, 8)
    data = rows.select("spectrum", "label").collect()
    codes = boosting.codes_of(np.array([r["spectrum"] for r in data]), edges)
    label = np.array([r["label"] for r in data])
    margin = np.zeros((len(data), 2))
    for done in trees:
        e = np.exp(margin)
        p = e / e.sum(1, keepdims=True)
        for c in range(2):
            g, h = p[:, c] - (label == c), 2 * p[:, c] * (1 - p[:, c])
            node = {0: np.ones(len(data), bool)}
            for depth in range(2):
                for at in [a for a in node if (1 << depth) - 1 <= a < (2 << depth) - 1]:
                    mine = node[at]
                    gain, f, cut = plain_split(codes[mine], g[mine], h[mine], 1.0, settings)
                    if gain > 1e-6:
                        assert (done.feature[c, at], done.cut[c, at]) == (f, cut)
                        node[2 * at + 1], node[2 * at + 2] = mine & (codes[:, f] <= cut), mine & (codes[:, f] > cut)
                        del node[at]
            for at, mine in node.items():
                assert done.feature[c, at] < 0 and done.value[c, at] == pytest.approx(-g[mine].sum() / (h[mine].sum() + 1), abs=1e-6)
                margin[mine, c] += settings.step * done.value[c, at]


def test_classes_and_importance(spark, labelled):
    settings = boosting.Settings(rounds=12, depth=4, step=0.3, child_weight=1.0, max_step=1.0)
    model = supervised.pixel_classifier(labelled, settings)
    assert model.classes == [10, 20, 30, 40]
    seen = supervised.predict_map(model, labelled).join(labelled.select("region", "pixel_id", F.col("label").alias("t")), ["region", "pixel_id"])
    assert seen.where("label = t").count() > 0.95 * 800
    ranked = supervised.mz_importance(model, labelled, 6).collect()
    assert {r["mz_index"] for r in ranked[:3]} <= {0, 1, 2, 3, 4, 5} and sum(r["importance"] for r in ranked) == pytest.approx(1)


def test_pairs_of_equal_and_different_classes(spark, labelled):
    odd = labelled.withColumn("label", F.when(F.col("label") == 40, F.lit(None)).otherwise(F.col("label")))
    noise = F.when(F.col("label") == 10, F.when(F.xxhash64("region", "pixel_id") % 2 == 0, 10).otherwise(11)).otherwise(F.col("label"))
    rows = supervised.pair_classifier(odd.withColumn("label", noise), boosting.Settings(rounds=8, depth=3)).collect()
    found = {(r["category_a"], r["category_b"]): r["confusion"] for r in rows}
    assert set(found) == {(10, 11), (10, 20), (10, 30), (11, 20), (11, 30), (20, 30)}
    assert found[10, 11] > 0.3 and found[20, 30] < 0.15 and found[10, 30] < 0.15


def test_tables_without_classes(spark, labelled):
    none = labelled.withColumn("label", F.lit(None).cast("int"))
    assert supervised.pair_classifier(none).count() == 0
    assert supervised.pair_classifier(labelled.withColumn("label", F.lit(1))).count() == 0
    got = supervised.predict_map(supervised.pixel_classifier(none), labelled).select("label").distinct().collect()
    assert [r["label"] for r in got] == [-1]


def test_pixels_of_one_file_are_dealt_to_several_tasks(spark, monkeypatch):
    """Blocks and predictions do not stay in the one partition their pixels were read from."""
    monkeypatch.setattr(boosting, "BLOCK", 16)
    rows = [(0, i // 10, i % 10, i, i % 2, [float(i % 2 + 1), float(i % 5 + 1)]) for i in range(80)] + [(0, 9, 0, 80, 1, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "region int, y int, x int, pixel_id long, label int, spectrum array<double>").coalesce(1)
    blocks = boosting.binned_blocks(frame.withColumn("train", F.lit(True)), [np.array([1.5]), np.array([2.5])], 2)
    assert blocks.rdd.getNumPartitions() > 1
    assert sum(len(b["label"]) // 4 for b in blocks.collect()) == 81
    model = supervised.pixel_classifier(frame, boosting.Settings(rounds=3, depth=2))
    predicted = supervised.predict_map(model, frame)
    assert predicted.rdd.getNumPartitions() > 1
    got = {r["pixel_id"]: r["label"] for r in predicted.collect()}
    assert got == {i: i % 2 for i in range(80)} | {80: -1}


def test_sums_of_a_block_and_of_the_smaller_children(monkeypatch):
    rng = np.random.default_rng(5)
    n = 1 << 13
    codes = rng.integers(0, 16, (n, 3)).astype(np.uint8)
    place = rng.integers(0, 4, n)
    g, h = rng.integers(-(1 << 26), 1 << 26, n), np.full(n, 1 << 25)
    out = np.zeros((4, 3, 16, 3), np.int64)
    boosting._block_sums(np.ascontiguousarray(codes.T), None, place * 16, g.astype(float), h.astype(float), 4, 16, out)
    assert (out == boosting.histograms(codes, place, g, h, 4, 16)).all()
    out[:] = 0
    boosting._block_sums(np.ascontiguousarray(codes.T), None, np.zeros(n, np.int64), g.astype(float), h.astype(float), 4, 16, out)
    assert (out == boosting.histograms(codes, np.zeros(n, np.int64), g, h, 4, 16)).all()  # all rows in one node

    summed = []
    sums = boosting._sums_of
    monkeypatch.setattr(boosting, "_sums_of", lambda columns, rows, *a: summed.append(len(rows)) or sums(columns, rows, *a))
    for settings in (boosting.Settings(depth=5, bins=16, child_weight=0.0), boosting.Settings(depth=5, bins=16, child_weight=2.0, max_step=0.4)):
        unit = float(1 << 22)
        summed.clear()
        made = boosting.grow(codes, g, h, 0, unit, settings)
        whole = {}  # rows of each node, following the cuts
        for node, feature, cut, value, gain in sorted(made):
            rows = np.arange(n) if not node else whole[node]
            hist = boosting.histograms(codes[rows], np.zeros(len(rows), np.int64), g[rows], h[rows], 1, 16)
            best, at, place_, _ = (x[0] for x in boosting.best_splits(hist, unit, settings))
            if feature < 0:
                assert value == pytest.approx(float(boosting.leaf(g[rows].sum(), h[rows].sum(), unit, settings)))
                assert best == 0 or node >= 2**settings.depth - 1
            else:
                assert (feature, cut) == (at, place_) and gain == pytest.approx(float(best))
                right = codes[rows, feature] > cut
                whole[2 * node + 1], whole[2 * node + 2] = rows[~right], rows[right]
        assert sum(len(rows) for node, rows in whole.items() if node >= 2**settings.depth - 1) > 0
        assert sum(summed) <= n + (settings.depth - 1) * n // 2


def test_blocks_share_tasks_and_margins_are_written_as_the_study_grows(labelled, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 8)
    settings = boosting.Settings(rounds=5, depth=3, child_weight=1.0, bins=16)
    written = []
    whole = boosting.brought_up
    monkeypatch.setattr(boosting, "brought_up", lambda blocks, features, since, *a: written.append((len(since), blocks.rdd.getNumPartitions())) or whole(blocks, features, since, *a))
    found = []
    for walked, met in ((1 << 22, 32), (1, 2)):
        monkeypatch.setattr(boosting, "WALKED", walked)
        monkeypatch.setattr(boosting, "MET", met)
        monkeypatch.setattr(boosting, "CELLS", 300)
        written.clear()
        found.append(supervised.pixel_classifier(labelled, settings).rounds)
        assert [w for w, _ in written] == ([5] if walked > 1 else [1] * 5)
        assert all(tasks <= 2 * labelled.sparkSession.sparkContext.defaultParallelism < 100 for _, tasks in written)
    for one, other in zip(*found):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and np.array_equal(one.value, other.value)

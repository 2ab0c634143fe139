import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import spectrum as S
from ionloom.models import dense
from ionloom.operators.normalize import tic

SCHEMA = "region int, y int, x int, pixel_id long, label int, spectrum array<double>"


def planted(spark, n=600, n_mz=12, parts=3):
    """Class 0, 1, 2 by the larger one of m/z 2, 5 and 9; the others are noise."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (n, n_mz))
    label = x[:, [2, 5, 9]].argmax(axis=1)
    rows = [(0, i // 30, i % 30, i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(label, x))]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts), x, label


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    network = dense.Network(5, 3, dense.Settings(hidden=(4, 3), dropout=0.0), weights=[1.0, 2.0, 0.5])
    x, label = rng.uniform(0, 1, (9, 5)), rng.integers(0, 3, 9)
    vector = network.start() + rng.normal(0, 0.1, network.size)
    _, grad, moments = network.gradient(vector, x, label)
    for i in range(network.trained):
        up, down = vector.copy(), vector.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (network.gradient(up, x, label)[0] - network.gradient(down, x, label)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-5
    first = (x * network.view(vector)["mz"]) @ network.view(vector)["w0"] + network.view(vector)["b0"]
    assert np.allclose(moments[0][0], first.mean(axis=0)) and np.allclose(moments[0][1], first.var(axis=0, ddof=1))


def test_learns_planted_classes_and_finds_their_mz(spark):
    frame, x, label = planted(spark)
    given = dense.Settings(hidden=(32, 16), epochs=30, batch=64, step=0.003, dropout=0.0)
    model = dense.fit(frame, 12, 3, given)
    assert model.losses[-1] < model.losses[0]
    assert (model.scores(x).argmax(axis=1) == label).mean() > 0.9
    assert {r["mz_index"] for r in dense.top_mz(model, frame, 3).collect()} == {2, 5, 9}
    got = {r["pixel_id"]: r["scores"] for r in dense.scores(model, frame).collect()}
    assert np.allclose([got[i] for i in range(len(x))], model.scores(x))


def test_shards_average_and_partitions_do_not_matter(spark):
    given = dense.Settings(hidden=(16, 8), epochs=20, batch=32, step=0.01, shard=100, dropout=0.0)
    models = [dense.fit(planted(spark, parts=p)[0], 12, 3, given) for p in (1, 5)]
    _, x, label = planted(spark)
    assert np.allclose(models[0].vector, models[1].vector, atol=1e-9)
    assert (models[0].scores(x).argmax(axis=1) == label).mean() > 0.8


def test_one_shard_takes_the_steps_of_a_single_trainer(spark):
    given = dense.Settings(hidden=(6,), epochs=3, batch=50)
    frame, *_ = planted(spark, n=120)
    model = dense.fit(frame, 12, 3, given)
    block = dense._shards(frame.select("region", "pixel_id", "label", frame.spectrum.cast("array<float>").alias("spectrum")), 12, 1, 0).first()
    x, label = np.frombuffer(block["x"], "<f4").reshape(-1, 12), np.frombuffer(block["label"], "<i4")
    held, steps = np.concatenate([model.network.start(), np.zeros(2 * model.network.trained)]), 0
    for epoch in range(3):
        held, steps, _ = model.network.epoch(held, steps, x, label, np.random.default_rng([0, epoch, 0]))
    assert steps == 9 and np.allclose(held[: model.network.size], model.vector, atol=1e-6)


def test_nulls_empty_tables_and_wrong_input(spark):
    given = dense.Settings(hidden=(4,), epochs=2)
    rows = [(0, 0, 0, 0, 0, [1.0, None]), (0, 0, 1, 1, 1, [0.0, 1.0]), (0, 0, 2, 2, None, [1.0, 1.0]), (None, 0, 3, None, 1, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = dense.fit(frame, 2, 2, given)
    assert np.isfinite(model.vector).all() and len(model.losses) == 2
    assert [r["scores"] is None for r in dense.scores(model, frame).orderBy("x").collect()] == [False, False, False, True]
    empty = dense.fit(frame.limit(0), 2, 2, given)
    assert empty.losses == [] and np.allclose(empty.scores(np.ones((1, 2))).sum(), 1)
    with pytest.raises(ValueError, match="labels"):
        dense.fit(frame, 2, 1, given)
    with pytest.raises(Exception, match="entries"):
        dense.fit(frame, 3, 2, given)


def test_scores_of_spectra_made_by_expressions(spark):
    """The label of normalized spectra in one plan, as mlp_segment asks for it."""
    given = dense.Settings(hidden=(4,), epochs=2)
    rows = [(0, 0, i, i, i % 2, [float(i % 2), 1.0, float(i)]) for i in range(20)] + [(None, None, 20, None, 0, None)]
    frame = tic(spark.createDataFrame(rows, SCHEMA).withColumn("spectrum", F.transform("spectrum", lambda v: v * 2)))
    model = dense.fit(frame, 3, 2, given)
    got = dense.scores(model, frame).select("x", "pixel_id", S.argmax(F.col("scores")).alias("label")).collect()
    want = {r["x"]: None if r["spectrum"] is None else int(model.scores(np.array([r["spectrum"]])).argmax()) for r in frame.collect()}
    assert {r["x"]: r["label"] for r in got} == want
    assert [r["pixel_id"] for r in got if r["x"] == 20] == [None]

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom import session
from ionloom.functions import order_stats as O


def frame(spark, values, group=None):
    pdf = pd.DataFrame({"g": group if group is not None else 0, "id": np.arange(len(values)), "v": values})
    return spark.createDataFrame(pdf, "g int, id long, v double").repartition(5)


def test_order_bucket_never_decreases(spark):
    values = np.sort(np.r_[-np.geomspace(1e-300, 1e300, 200), 0.0, np.geomspace(1e-300, 1e300, 200), np.linspace(0.9, 1.1, 500)])
    got = [r[0] for r in frame(spark, values).orderBy("v").select(O.order_bucket(F.col("v"))).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("n", [1, 2, 3, 257])
def test_quantiles_with_hot_value(spark, n):
    rng = np.random.default_rng(n)
    values = rng.normal(0, 5, n)
    values[: n // 3] = 1.25  # a third of all rows share one value
    probs = {"a": 0.0, "b": 0.00001, "c": 0.3, "d": 0.5, "e": 0.99, "f": 1.0}
    row = O.exact_quantiles(frame(spark, values), ["g"], "v", probs).first()
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_quantiles_put_left_out_zeros_back(spark):
    rng = np.random.default_rng(0)
    for n, zeros in ((10, 0), (10, 3), (10, 9), (500, 250), (37, 12)):
        values = np.r_[np.zeros(zeros), rng.gamma(1, 3, n - zeros)]
        population = spark.createDataFrame([(0, n)], "g int, n long")
        probs = {f"p{i}": p for i, p in enumerate((0.0, 0.25, 0.3, 0.5, 0.9, 1.0))}
        row = O.exact_quantiles(frame(spark, values[values > 0]), ["g"], "v", probs, population).first()
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_quantiles_without_keys(spark):
    values = np.arange(101.0)
    assert O.exact_quantiles(frame(spark, values), [], "v", {"m": 0.5}).first()["m"] == 50.0


def test_positions_split_a_hot_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(O, "TIE_BLOCK", 16)
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 300).astype(float)
    values[:150] = 2.0
    got = {r["id"]: r["pos"] for r in O.ordered_position(frame(spark, values), ["g"], "v", "id", "pos").collect()}
    want = np.lexsort((np.arange(300), values)).argsort()
    assert [got[i] for i in range(300)] == want.tolist()


def test_average_rank(spark):
    values = np.array([3.0, 0.0, 0.0, 5.0, 3.0, 3.0])
    got = {r["v"]: r["rank"] for r in O.average_rank(frame(spark, values), ["g"], "v", "rank").collect()}
    assert got == {0.0: 1.5, 3.0: 4.0, 5.0: 6.0}


def test_shuffled_join_gives_the_same_as_broadcast(spark, monkeypatch):
    values = np.random.default_rng(2).normal(size=400)
    group = np.arange(400) % 3
    probs = {"a": 0.1, "b": 0.77}
    small = sorted(map(tuple, O.exact_quantiles(frame(spark, values, group), ["g"], "v", probs).collect()))
    monkeypatch.setattr(O, "small_side", lambda df, row_limit=0: session.cut_lineage(df))
    large = sorted(map(tuple, O.exact_quantiles(frame(spark, values, group), ["g"], "v", probs).collect()))
    assert small == large


def test_small_side_broadcasts_only_below_the_limit_in_bytes(spark):
    each = session.measured_bytes(spark.range(1))
    few = session.small_side(spark.range(10), 10 * each)
    many = session.small_side(spark.range(11), 10 * each)
    assert "broadcast" in few._jdf.queryExecution().toString().lower().split("== physical")[0]
    assert "broadcast" not in many._jdf.queryExecution().toString().lower().split("== physical")[0]
    wide = spark.range(2).selectExpr("id", "array_repeat(1.0D, 1000) AS v", "struct(id, repeat('x', 500) AS t) AS s", "array(null, 'abc') AS a")
    assert 2 * 8500 < session.measured_bytes(wide) < 2 * 10000
    assert session.measured_bytes(spark.range(0)) == 0

"""Dense network over spectra, trained data-parallel.

A weight per m/z multiplies the spectrum; each hidden layer is dropout, a linear map, batch normalization and a rectifier; a
linear map gives the class scores. The loss is cross entropy with class weights and smoothed labels plus an absolute penalty on
the m/z weights, which leaves the m/z that matter with large ones; steps are AdamW.

Pixels are packed once into shards of about ``Settings.shard`` rows by a hash, so a shard never grows with the table. In an epoch
every shard starts from the common state and takes its mini-batches in an order of its own; the states are then averaged by row
counts (local steps with averaging): one map and one sum an epoch, whatever the size, and a table of one shard takes exactly the
steps of a single trainer. The sum runs in slices of the state, so that neither a task nor the driver holds more than one state
per partition and one in all. Shards, orders and dropout depend on row values, seed and epoch alone, so a retried task repeats
its numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.session import cut_lineage, settings

EPS_NORM, EPS_STEP = 1e-5, 1e-8
SLICE = 1 << 16


@dataclass(frozen=True)
class Settings:
    hidden: tuple[int, ...] = (256, 128, 64)
    epochs: int = 50
    batch: int = 1024
    dropout: float = 0.2
    smoothing: float = 0.2
    penalty: float = 0.01  # on the absolute m/z weights
    step: float = 1e-3
    decay: float = 0.01
    momentum: float = 0.1  # of the running moments of the normalization
    shard: int = 8192
    seed: int = 0


class Network:
    """Layout of a state vector and the steps on it; vectors hold all parameters, then the running moments."""

    def __init__(self, n_mz: int, n_classes: int, given: Settings, weights=None):
        self.given, self.n_mz, self.n_classes = given, n_mz, n_classes
        self.weights = np.ones(n_classes) if weights is None else np.asarray(weights, float)
        widths = [n_mz, *given.hidden, n_classes]
        self.layers = len(given.hidden)
        shapes = {"mz": (n_mz,)}
        for i, (a, b) in enumerate(zip(widths, widths[1:])):
            shapes |= {f"w{i}": (a, b), f"b{i}": (b,)}
            if i < self.layers:
                shapes |= {f"gain{i}": (b,), f"shift{i}": (b,)}
        moments = {f"{kind}{i}": (h,) for i, h in enumerate(given.hidden) for kind in ("mean", "var")}
        self.places, at = {}, 0
        for name, shape in (shapes | moments).items():
            size = int(np.prod(shape))
            self.places[name] = (at, at + size, shape)
            at += size
            if name == f"b{self.layers}":
                self.trained = at
        self.size = at

    def view(self, vector: np.ndarray) -> dict[str, np.ndarray]:
        return {n: vector[a:b].reshape(shape) for n, (a, b, shape) in self.places.items() if b <= len(vector)}

    def start(self) -> np.ndarray:
        vector = np.zeros(self.size)
        state, rng = self.view(vector), np.random.default_rng(self.given.seed)
        for name, values in state.items():
            if name[0] in "wb" and name[1:].isdigit():
                bound = 1 / np.sqrt(state["w" + name[1:]].shape[0])
                values[...] = rng.uniform(-bound, bound, values.shape)
            elif name.startswith(("gain", "var")) or name == "mz":
                values[...] = 1
        return vector

    def scores(self, vector: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Class probabilities with the running moments."""
        s = self.view(vector)
        h = x * s["mz"]
        for i in range(self.layers):
            z = (h @ s[f"w{i}"] + s[f"b{i}"] - s[f"mean{i}"]) / np.sqrt(s[f"var{i}"] + EPS_NORM)
            h = np.maximum(z * s[f"gain{i}"] + s[f"shift{i}"], 0)
        return _softmax(h @ s[f"w{self.layers}"] + s[f"b{self.layers}"])

    def gradient(self, vector: np.ndarray, x: np.ndarray, label: np.ndarray, rng=None):
        """(loss, gradient of the trained part, batch moments by layer) of one mini-batch; dropout only with ``rng``."""
        s, drop, n = self.view(vector), self.given.dropout, len(x)
        h, kept, moments = x * s["mz"], [], []
        for i in range(self.layers):
            mask = 1.0 if rng is None or not drop else (rng.random(h.shape, np.float32) >= drop).astype(h.dtype) / (1 - drop)
            d = h * mask
            z = d @ s[f"w{i}"] + s[f"b{i}"]
            mean, var = z.mean(axis=0), z.var(axis=0)
            scale = 1 / np.sqrt(var + EPS_NORM)
            unit = (z - mean) * scale
            h = np.maximum(unit * s[f"gain{i}"] + s[f"shift{i}"], 0)
            kept.append((mask, d, unit, scale, h > 0))
            moments.append((mean, var * n / max(n - 1, 1)))
        p = _softmax(h @ s[f"w{self.layers}"] + s[f"b{self.layers}"])
        goal = np.full(p.shape, self.given.smoothing / self.n_classes)
        goal[np.arange(n), label] += 1 - self.given.smoothing
        goal *= self.weights
        total = self.weights[label].sum()
        loss = -(goal * np.log(np.maximum(p, 1e-30))).sum() / total + self.given.penalty * np.abs(s["mz"]).sum()
        flat = np.zeros(self.trained)
        g = self.view(flat)
        back = ((p * goal.sum(axis=1, keepdims=True) - goal) / total).astype(x.dtype)
        g[f"w{self.layers}"][...], g[f"b{self.layers}"][...] = h.T @ back, back.sum(axis=0)
        back = back @ s[f"w{self.layers}"].T
        for i in reversed(range(self.layers)):
            mask, d, unit, scale, on = kept[i]
            back = back * on
            g[f"gain{i}"][...], g[f"shift{i}"][...] = (back * unit).sum(axis=0), back.sum(axis=0)
            back = back * s[f"gain{i}"]
            back = scale * (back - back.mean(axis=0) - unit * (back * unit).mean(axis=0))
            g[f"w{i}"][...], g[f"b{i}"][...] = d.T @ back, back.sum(axis=0)
            back = (back @ s[f"w{i}"].T) * mask
        g["mz"][...] = (back * x).sum(axis=0) + self.given.penalty * np.sign(s["mz"])
        return loss, flat, moments

    def epoch(self, held: np.ndarray, steps: int, x: np.ndarray, label: np.ndarray, rng) -> tuple[np.ndarray, int, float]:
        """One pass over a shard from the common (state, first and second moments of the steps); (the same, steps, mean loss)."""
        vector, first, second = held[: self.size].copy(), held[self.size : self.size + self.trained].copy(), held[self.size + self.trained :].copy()
        trained, s, order, losses = vector[: self.trained], self.view(vector), rng.permutation(len(x)), []
        for rows in np.array_split(order, -(-len(x) // self.given.batch)):
            loss, grad, moments = self.gradient(vector.astype(x.dtype), x[rows], label[rows], rng)
            losses.append(loss)
            steps += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            trained *= 1 - self.given.step * self.given.decay
            trained -= self.given.step * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + EPS_STEP)
            for i, (mean, var) in enumerate(moments):
                s[f"mean{i}"] += self.given.momentum * (mean - s[f"mean{i}"])
                s[f"var{i}"] += self.given.momentum * (var - s[f"var{i}"])
        return np.concatenate([vector, first, second]), steps, float(np.mean(losses))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Dense:
    """A fitted network; ``losses`` holds the mean training loss of each epoch."""

    network: Network
    vector: np.ndarray
    losses: list[float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.network.scores(self.vector, x)

    @property
    def mz_weights(self) -> np.ndarray:
        return self.network.view(self.vector)["mz"]


def _shards(rows: DataFrame, n_mz: int, count: int, seed: int) -> DataFrame:
    """(shard, label, x): the labels and spectra of a shard as bytes, in an order that depends on values alone."""
    mixed = F.xxhash64("region", "pixel_id", "label", "spectrum", F.lit(seed))
    marked = rows.select(F.pmod(mixed, F.lit(count)).alias("shard"), mixed.alias("_order"), "label", "spectrum")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending"), ("label", "ascending")])
        x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["spectrum"].chunks]).astype("<f4")
        label = table["label"].to_numpy().astype("<i4")
        if len(x) != len(label) * n_mz:
            raise ValueError(f"spectra must have {n_mz} entries")
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()), "label": [label.tobytes()], "x": [x.tobytes()]})

    return cut_lineage(marked.groupBy("shard").applyInArrow(pack, "shard long, label binary, x binary"))


def fit(labelled: DataFrame, n_mz: int, n_classes: int, given: Settings = Settings(), weights=None) -> Dense:
    """Train on rows (region, pixel_id, label 0 .. n_classes - 1, spectrum of ``n_mz`` entries).

    ``weights`` per class; None balances the classes. Rows without a label or spectrum take no part, missing entries are 0,
    other labels and spectra of another length are errors. Without rows the start of the network is returned.
    """
    rows = labelled.where("label IS NOT NULL AND spectrum IS NOT NULL").select(
        "region", "pixel_id", F.col("label").cast("int").alias("label"),
        F.transform("spectrum", lambda v: F.coalesce(v.cast("float"), F.lit(0.0).cast("float"))).alias("spectrum"),
    )
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).limit(n_classes + 1).collect()}
    if any(not 0 <= c < n_classes for c in counts):
        raise ValueError(f"labels must lie in 0 .. {n_classes - 1}")
    total = sum(counts.values())
    if weights is None:
        weights = [total / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(n_classes)]
    network = Network(n_mz, n_classes, given, weights)
    held = np.concatenate([network.start(), np.zeros(2 * network.trained)])
    if not total:
        return Dense(network, held[: network.size], [])
    shards = _shards(rows, n_mz, -(-total // given.shard), given.seed)
    spark, steps, losses = labelled.sparkSession, 0, []
    context = spark.sparkContext
    fixed = context.broadcast(network)
    for epoch in range(given.epochs):
        shared = context.broadcast((held, steps))

        def train(batches, shared=shared, epoch=epoch):
            network, (held, steps), kept = fixed.value, shared.value, None
            for batch in batches:
                for shard, label, x in zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "x"))):
                    label = np.frombuffer(label, "<i4")
                    rng = np.random.default_rng([network.given.seed, epoch, shard])
                    after, taken, loss = network.epoch(held, steps, np.frombuffer(x, "<f4").reshape(len(label), -1), label, rng)
                    now = np.concatenate([after, [taken, loss, 1.0]]) * len(label)
                    kept = now if kept is None else kept + now
            if kept is not None:
                part = TaskContext.get().partitionId()
                for at in range(0, len(kept), SLICE):
                    yield pa.RecordBatch.from_pydict({
                        "slice": pa.array([at // SLICE], pa.int64()), "part": pa.array([part], pa.int64()), "sums": [kept[at : at + SLICE].tobytes()],
                    })

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            sums = sum(np.frombuffer(b.as_py()) for b in table["sums"])
            return pa.table({"slice": table["slice"].slice(0, 1), "sums": [sums.tobytes()]})

        parts = shards.mapInArrow(train, "slice long, part long, sums binary")
        with settings(spark, spark__sql__adaptive__enabled="false"):  # one small sum an epoch: nothing to plan anew
            found = parts.groupBy("slice").applyInArrow(add, "slice long, sums binary").collect()  # one state in all
        whole = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["slice"])])
        whole = whole / whole[-1]
        held, steps = whole[:-3], max(1, round(whole[-3]))
        losses.append(float(whole[-2]))
        shared.unpersist()
    return Dense(network, held[: network.size], losses)


def scores(model: Dense, spectra: DataFrame) -> DataFrame:
    """Probability of each class per pixel: (region, y, x, pixel_id, scores); null without a spectrum."""
    shared = spectra.sparkSession.sparkContext.broadcast(replace(model, losses=[]))
    rows = spectra.select("region", "y", "x", "pixel_id", "spectrum")

    # a map over whole batches: a function among expressions would be merged with those that make the spectrum
    def scored(batches):
        for batch in batches:
            held, out = batch.column(4), [None] * len(batch)
            there = np.flatnonzero(held.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                x = np.nan_to_num(np.stack([np.asarray(held[i].as_py(), dtype=float) for i in there.tolist()]))
                for i, row in zip(there.tolist(), shared.value.scores(x)):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names[:4], "scores"])

    schema = T.StructType([*rows.drop("spectrum").schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(scored, schema)


def top_mz(model: Dense, spectra: DataFrame, n: int = 10) -> DataFrame:
    """The n m/z with the largest absolute input weight."""
    size = np.abs(model.mz_weights)
    ranked = sorted(range(len(size)), key=lambda i: (-size[i], i))[:n]
    return spectra.sparkSession.createDataFrame(
        [(r + 1, i, float(size[i])) for r, i in enumerate(ranked)], "rank int, mz_index int, weight double"
    )

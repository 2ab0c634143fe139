"""Boosted trees for many models at once, grown from histograms of whole numbers.

A study asks for one boosted classifier per pair of categories, or one tree per class and round. All models of a round
grow together: a Spark job reads the binned spectra once and works for every model that a pixel takes part in.

* Features are binned once. Bin edges come from one histogram over order-preserving value buckets, so they do not depend
  on partitions. Blocks of pixels travel as bytes: one code per feature.
* Gradients are rounded to multiples of 2^-26 of the largest weight and summed as integers. Sums of integers have no order,
  so trees are the same on any number of partitions and after any retry.
* A node with many pixels is split by a job of its level: each task sums (gradient, curvature, count) by model, node,
  feature and bin, sums meet by ranges of features, and each range answers with its best split per node.
* A node whose pixels fit ``CELLS`` codes is shipped to one task, which finishes its whole subtree by the same rule. A
  small study thus takes one job a round, a large one a job per level.
* Margins are kept with the blocks and brought up to date every ``KEPT`` rounds, more often in a large study (``WALKED``);
  in between, a task adds the trees since.
* A task holds several blocks and sums their histograms before they meet the others'.

The driver holds trees (models * rounds * 2^(depth + 1) nodes) and split candidates, never pixels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.order_stats import order_bucket
from ionloom.operators.neighbors import stack
from ionloom.session import cut_lineage

#: Pixels of a block, at most 2^13: see ``_block_sums``.
BLOCK = 4096
#: Codes (pixels * features) up to which one task finishes the subtree of a node.
CELLS = 1 << 24
#: Bytes of histograms a task holds at once; models that need more go through several jobs.
HELD = 128 << 20
#: Bytes of histograms that meet in one group.
RANGE = 4 << 20
KEPT = 16
#: Pixels * slots * rounds up to which jobs walk trees again instead of writing margins.
WALKED = 1 << 22
#: Blocks of a task at most, and tasks that meet without being merged first.
HELD_BLOCKS, MET = 64, 32
_ONE = 1 << 26
_LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    rounds: int = 40
    depth: int = 4
    step: float = 0.1
    penalty: float = 1.0
    child_weight: float = 1.0
    max_step: float = 0.0  # bound of a leaf before ``step``; 0 for none
    bins: int = 64


@dataclass(frozen=True)
class Task:
    """Which models the rows of a class train: model numbers, targets and weights, one row per class.

    ``softmax`` couples the models of a row as classes; otherwise each is a logistic model of its own.
    """

    takes: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    models: int
    softmax: bool = False

    @property
    def unit(self) -> float:
        return _ONE / max(float(self.weight.max(initial=0.0)), 1e-12)

    def gradients(self, label: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gradient, curvature) of each row and slot in whole units."""
        if self.softmax:
            e = np.exp(margins - margins.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
        else:
            p = 1 / (1 + np.exp(-margins))
        weight = self.weight[label] * self.unit
        curve = np.maximum(p * (1 - p) * (2 if self.softmax else 1), 1e-16)
        return np.rint((p - self.target[label]) * weight).astype(np.int64), np.rint(curve * weight).astype(np.int64)


@dataclass
class Trees:
    """One tree per model in heap order: children of node i are 2i + 1 (code <= cut) and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Trees:
        shape = (models, (2 << depth) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape))

    def nodes(self, codes: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Node each row ends in for each of its models (rows x slots)."""
        at = np.zeros(model.shape, np.int64)
        flat, feature_of, cut_of = codes.ravel(), self.feature.ravel(), self.cut.ravel()
        rows, first = np.arange(len(codes))[:, None] * codes.shape[1], model * self.feature.shape[1]
        while True:
            place = first + at
            feature = feature_of.take(place)
            inner = feature >= 0
            if not inner.any():
                return at
            right = flat.take(rows + np.maximum(feature, 0)) > cut_of.take(place)
            at = np.where(inner, 2 * at + 1 + right, at)


def leaf(g, h, unit: float, s: Settings):
    """Value of a leaf, before ``step``."""
    w = -(g / unit) / (h / unit + s.penalty)
    return np.clip(w, -s.max_step, s.max_step) if s.max_step else w


def _worth(g, h, unit: float, s: Settings):
    w = leaf(g, h, unit, s)
    return -(2 * (g / unit) * w + (h / unit + s.penalty) * w * w)


def best_splits(hist: np.ndarray, unit: float, s: Settings) -> tuple[np.ndarray, ...]:
    """Best split of each node from sums (nodes, features, bins, 3): gain, feature, cut, left sums (nodes, 3).

    The counts may be left out where ``child_weight`` is above 0. A split leaves ``child_weight`` of curvature and a pixel on either side. Ties go to the lower feature, then cut;
    without a split the gain is 0.
    """
    left = hist.cumsum(axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left
    enough = np.minimum(left[..., 1], right[..., 1]) / unit >= s.child_weight
    if hist.shape[-1] > 2:  # with a bound above 0 a side that reaches it has pixels
        enough &= (left[..., 2] > 0) & (right[..., 2] > 0)
    gain = _worth(left[..., 0], left[..., 1], unit, s) + _worth(right[..., 0], right[..., 1], unit, s)
    gain = np.where(enough, gain - _worth(whole[..., 0], whole[..., 1], unit, s), 0.0)
    flat = gain.reshape(len(hist), -1)
    at = flat.argmax(axis=1)
    feature, cut = np.unravel_index(at, gain.shape[1:])
    rows = np.arange(len(hist))
    top = flat[rows, at]
    return np.where(top > _LEAST_GAIN, top, 0.0), feature, cut, left[rows, feature, cut]


def histograms(codes: np.ndarray, group: np.ndarray, g: np.ndarray, h: np.ndarray, groups: int, bins: int) -> np.ndarray:
    """Sums (groups, features, bins, 3) of the rows of each group."""
    out = np.zeros((groups, codes.shape[1], bins, 3), np.int64)
    base, size = group * bins, groups * bins
    g, h = g.astype(float), h.astype(float)  # whole numbers far below 2^53
    for f in range(codes.shape[1]):
        at = base + codes[:, f]
        for plane, weight in enumerate((g, h, None)):
            out[:, f, :, plane] = np.bincount(at, weight, size).astype(np.int64).reshape(groups, bins)
    return out


def _block_sums(columns: np.ndarray, rows, base: np.ndarray, g: np.ndarray, h: np.ndarray, groups: int, bins: int, out: np.ndarray) -> None:
    """Add the sums of ``rows`` of a block of codes (features, rows) to out (groups, features, bins, 3)."""
    size = groups * bins
    # curvature (below 2^26 a row) and count share one whole number below 2^53 for up to 2^13 rows
    both = h * float(1 << 14) + 1.0
    for f in range(len(columns)):
        at = base + (columns[f] if rows is None else columns[f].take(rows))
        out[:, f, :, 0] += np.bincount(at, g, size).astype(np.int64).reshape(groups, bins)
        packed = np.bincount(at, both, size).astype(np.int64).reshape(groups, bins)
        out[:, f, :, 1] += packed >> 14
        out[:, f, :, 2] += packed & ((1 << 14) - 1)


def _sums_of(columns: np.ndarray, rows: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray, groups: int, bins: int, planes: int) -> np.ndarray:
    """``histograms`` of some rows of codes (features, rows), with counts if ``planes`` is 3."""
    out = np.zeros((groups, len(columns), bins, planes), np.int64)
    base, size = place * bins, groups * bins
    weights = (g[rows].astype(float), h[rows].astype(float), None)[:planes]
    for f in range(len(columns)):
        at = base + columns[f].take(rows)
        for plane, weight in enumerate(weights):
            out[:, f, :, plane] = np.bincount(at, weight, size).astype(np.int64).reshape(groups, bins)
    return out


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray, root: int, unit: float, s: Settings) -> list[tuple]:
    """Rows (node, feature, cut, value, gain) of the subtree below heap node ``root``, level by level.

    Of two children the one with fewer rows is summed, the other is what is left of their parent's sums.
    """
    out: list[tuple] = []
    columns = np.ascontiguousarray(codes.T)
    planes = 2 if s.child_weight > 0 else 3
    depth = int(np.log2(root + 1))
    fit = max(1, (HELD >> 2) // (codes.shape[1] * s.bins * 24))
    # (node, its rows, its sums or none): sums are kept for the nodes of one level
    level: list[tuple] = [(root, np.arange(len(codes)), None)]
    while level:
        following: list[tuple] = []
        for low in range(0, len(level), fit):
            some = level[low : low + fit]
            open_ = [x for x in some if x[2] is None]
            if open_:
                place = np.repeat(np.arange(len(open_)), [len(rows) for _, rows, _ in open_])
                new = iter(_sums_of(columns, np.concatenate([rows for _, rows, _ in open_]), place, g, h, len(open_), s.bins, planes))
            sums = np.stack([next(new) if x is None else x for _, _, x in some])
            gain, feature, cut, _ = best_splits(sums, unit, s)
            whole = sums[:, 0].sum(axis=1)
            pairs, halves = [], []
            for i, (node, rows, _) in enumerate(some):
                if gain[i] > 0 and depth < s.depth:
                    out.append((node, int(feature[i]), int(cut[i]), 0.0, float(gain[i])))
                    right = columns[feature[i]].take(rows) > cut[i]
                    sides = [rows[~right], rows[right]]
                    if depth + 1 == s.depth:  # a leaf needs only its own two sums
                        for child, own in zip((2 * node + 1, 2 * node + 2), sides):
                            out.append((child, -1, 0, float(leaf(g[own].sum(), h[own].sum(), unit, s)), 0.0))
                    else:
                        pairs.append((node, sides, int(len(sides[1]) < len(sides[0])), i))
                        halves.append(sides[pairs[-1][2]])
                else:
                    out.append((node, -1, 0, float(leaf(whole[i, 0], whole[i, 1], unit, s)), 0.0))
            if pairs:
                place = np.repeat(np.arange(len(pairs)), [len(rows) for rows in halves])
                less = _sums_of(columns, np.concatenate(halves), place, g, h, len(pairs), s.bins, planes)
                for (node, sides, side, i), own in zip(pairs, less):
                    both = [own, sums[i] - own] if side == 0 else [sums[i] - own, own]
                    # beyond one batch of nodes sums are worked out again rather than held
                    keep = len(following) < fit
                    following += [(2 * node + 1 + c, sides[c], both[c] if keep else None) for c in (0, 1)]
        level = sorted(following, key=lambda x: x[0])
        depth += 1
    return out


# --- binned blocks ----------------------------------------------------------------------------------------


def bin_edges(spectra: DataFrame, bins: int) -> list[np.ndarray]:
    """Lower edges of bins 1.. of each feature, about equally many values in each.

    Values are counted by order bucket (1/64 of an octave); an edge is the smallest value of a bucket, so equal values
    share a bin. One shuffle of at most features * buckets rows per task; the driver gets features * bins edges.
    """
    values = spectra.select(F.posexplode("spectrum").alias("f", "v")).where("v IS NOT NULL")
    counted = values.groupBy("f", order_bucket(F.col("v").cast("double")).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").cast("double").alias("low")
    )
    group = Window.partitionBy("f")
    before = F.coalesce(F.sum("n").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.select("f", "b", "low", F.floor(before * bins / F.sum("n").over(group)).alias("bin"))
    edges = placed.groupBy("f", "bin").agg(F.min("low").alias("edge")).groupBy("f").agg(
        F.sort_array(F.collect_list("edge")).alias("edges")
    ).collect()
    if not edges:
        return []
    out = [np.zeros(0)] * (max(r["f"] for r in edges) + 1)
    for r in edges:
        out[r["f"]] = np.array(r["edges"][1:])
    return out


def codes_of(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.searchsorted(e, values[:, f], "right")
    return out


_BLOCKS = "codes binary, label binary, train binary, margins binary"


def binned_blocks(rows: DataFrame, edges: list[np.ndarray], slots: int) -> DataFrame:
    """Blocks of rows(label: class number, train: boolean, spectrum), written once, with margins 0."""
    def pack(batches):
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                yield pd.DataFrame({
                    "codes": [codes_of(stack(part["spectrum"]), edges).tobytes()],
                    "label": [part["label"].to_numpy(np.int32).tobytes()], "train": [part["train"].to_numpy(bool).tobytes()],
                    "margins": [np.zeros((len(part), slots)).tobytes()],
                })

    rows = rows.select("label", "train", "spectrum")
    # every round works on the blocks where they lie: about two tasks a core, so that few histograms meet
    n = -(-rows.count() // BLOCK)
    tasks = max(1, min(n, 2 * rows.sparkSession.sparkContext.defaultParallelism), -(-n // HELD_BLOCKS))
    return cut_lineage(rows.repartition(tasks).mapInPandas(pack, _BLOCKS))


def _opened(batch: pa.RecordBatch, features: int):
    """(codes, label, train, margins) of each block of a batch."""
    for codes, label, train, margins in zip(*[batch.column(c) for c in ("codes", "label", "train", "margins")]):
        label = np.frombuffer(label.as_buffer(), np.int32) if label.as_py() else np.zeros(0, np.int32)
        if len(label):
            yield (np.frombuffer(codes.as_buffer(), np.uint8).reshape(-1, features), label,
                   np.frombuffer(train.as_buffer(), bool), np.frombuffer(margins.as_buffer()).reshape(len(label), -1))


def with_trees(codes, label, margins, since: list[Trees], task: Task, step: float) -> np.ndarray:
    model = task.takes[label]
    for trees in since:
        margins = margins + step * trees.value[model, trees.nodes(codes, model)]
    return margins


# --- fitting ----------------------------------------------------------------------------------------------


@dataclass
class Boosted:
    """Fitted models: bin edges, the trees of every round, and what the models stand for."""

    edges: list[np.ndarray]
    rounds: list[Trees]
    task: Task
    settings: Settings
    classes: list = field(default_factory=list)

    @property
    def importance(self) -> np.ndarray:
        """Mean gain of the splits of each feature over all trees, as a share."""
        total, used = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for t in self.rounds:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
            np.add.at(used, t.feature[inner], 1)
        mean = total / np.maximum(used, 1)
        return mean / max(mean.sum(), 1e-300)

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Margins of every model for spectra of unknown class."""
        codes, every = codes_of(values, self.edges), np.tile(np.arange(self.task.models), (len(values), 1))
        out = np.zeros(every.shape)
        for trees in self.rounds:
            out += self.settings.step * trees.value[every, trees.nodes(codes, every)]
        return out


def fit(blocks: DataFrame, features: int, sizes: np.ndarray, task: Task, s: Settings, cells: int | None = None) -> tuple[DataFrame, list[Trees]]:
    """Blocks with the margins after the last kept round, and the trees of all rounds. ``sizes``: training rows per class."""
    cells = CELLS if cells is None else cells
    rows = np.zeros(task.models, np.int64)
    np.add.at(rows, task.takes.ravel(), np.repeat(sizes, task.takes.shape[1]))
    tasks = blocks.rdd.getNumPartitions()
    done: list[Trees] = []
    since: list[Trees] = []
    kept = max(1, min(KEPT, WALKED // max(1, int(sizes.sum()) * task.takes.shape[1])))
    for _ in range(s.rounds):
        if len(since) >= kept:
            blocks, since = brought_up(blocks, features, since, task, s.step), []
        trees = Trees.empty(task.models, s.depth)
        large = {(m, 0): int(n) for m, n in enumerate(rows) if n}
        small: list[tuple[int, int]] = []
        depth = 0
        while large:
            small += [k for k, n in large.items() if n * features <= cells]
            large = {k: n for k, n in large.items() if n * features > cells}
            if not large:
                break
            following = {}
            for (model, node), (gain, feature, cut, left, whole) in _split_level(blocks, tasks, features, large, trees, since, task, s).items():
                if gain <= 0:
                    trees.value[model, node] = leaf(whole[0], whole[1], task.unit, s)
                    continue
                trees.feature[model, node], trees.cut[model, node], trees.gain[model, node] = feature, cut, gain
                for child, sums in ((2 * node + 1, left), (2 * node + 2, whole - left)):
                    if depth + 1 == s.depth:
                        trees.value[model, child] = leaf(sums[0], sums[1], task.unit, s)
                    else:
                        following[model, child] = int(sums[2])
            large, depth = following, depth + 1
        if small:
            _finish(blocks, features, small, trees, since, task, s)
        done.append(trees)
        since.append(trees)
    return brought_up(blocks, features, since, task, s.step), done


def brought_up(blocks: DataFrame, features: int, since: list[Trees], task: Task, step: float) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast((since, task))

    def add(batches):
        for batch in batches:
            made = [with_trees(c, y, m, shared.value[0], shared.value[1], step).tobytes() for c, y, _, m in _opened(batch, features)]
            yield batch.set_column(3, "margins", pa.array(made, pa.binary()))

    return cut_lineage(blocks.mapInArrow(add, _BLOCKS))


def _training(batch, features: int, shared, step: float):
    """(codes, model, node, gradient, curvature) of the training rows of each block, per slot."""
    trees, since, task = shared
    for codes, label, train, margins in _opened(batch, features):
        keep = np.flatnonzero(train)
        codes, label, margins = codes[keep], label[keep], margins[keep]
        g, h = task.gradients(label, with_trees(codes, label, margins, since, task, step))
        model = task.takes[label]
        yield codes, model, trees.nodes(codes, model), g, h


def _split_level(blocks: DataFrame, tasks: int, features: int, large: dict, trees: Trees, since, task: Task, s: Settings) -> dict:
    """(model, node) -> (gain, feature, cut, left sums, whole sums), from histograms added up over all tasks."""
    keys = sorted(large)
    per_node = features * s.bins * 24
    found: dict = {}
    for low in range(0, len(keys), max(1, HELD // per_node)):
        some = keys[low : low + max(1, HELD // per_node)]
        number = np.full(trees.feature.shape, -1)
        number[tuple(np.array(some).T)] = np.arange(len(some))
        wide = max(1, RANGE // (len(some) * s.bins * 24))  # features of a range
        shared = blocks.sparkSession.sparkContext.broadcast((trees, since, task))

        def sums(batches, some=some, number=number, wide=wide, shared=shared):
            total = np.zeros((len(some), features, s.bins, 3), np.int64)
            for batch in batches:
                for codes, model, node, g, h in _training(batch, features, shared.value, s.step):
                    group, columns = number[model, node], np.ascontiguousarray(codes.T)
                    for slot in range(group.shape[1]):
                        own = group[:, slot]
                        rows = np.flatnonzero(own >= 0)
                        if len(rows):
                            # nodes that these rows fall in, so that sums are no wider than needed
                            here, place = np.unique(own[rows], return_inverse=True)
                            found = np.zeros((len(here), features, s.bins, 3), np.int64)
                            _block_sums(columns, None if len(rows) == len(own) else rows, place * s.bins, g[rows, slot].astype(float),
                                        h[rows, slot].astype(float), len(here), s.bins, found)
                            total[here] += found
            for f in range(0, features, wide):
                yield pa.record_batch({
                    "f": pa.array([f], pa.int32()), "part": pa.array([0], pa.int32()),
                    "sums": pa.array([np.ascontiguousarray(total[:, f : f + wide]).tobytes()], pa.binary()),
                })

        def add(table: pa.Table) -> np.ndarray:
            total = 0
            for frame in table.column("sums"):
                total = total + np.frombuffer(frame.as_buffer(), np.int64)
            return total.reshape(len(some), -1, s.bins, 3)

        def merge(table: pa.Table) -> pa.Table:
            return pa.table({"f": table.column("f").slice(0, 1), "part": table.column("part").slice(0, 1), "sums": pa.array([add(table).tobytes()], pa.binary())})

        def choose(table: pa.Table) -> pa.Table:
            total = add(table)
            gain, feature, cut, left = best_splits(total, task.unit, s)
            whole = total[:, 0].sum(axis=1)
            first = table.column("f")[0].as_py()
            return pa.table({
                "k": pa.array(np.arange(len(total), dtype=np.int32)), "gain": pa.array(gain), "feature": pa.array((feature + first).astype(np.int32)),
                "cut": pa.array(cut.astype(np.int32)), "sums": pa.array(np.concatenate([left, whole], axis=1).tolist(), pa.list_(pa.int64())),
            })

        partial = blocks.mapInArrow(sums, "f int, part int, sums binary").withColumn("part", F.spark_partition_id() % 32)
        # no group meets more than a bounded number of tasks
        merged = partial.groupBy("f", "part").applyInArrow(merge, "f int, part int, sums binary") if tasks > MET else partial
        answers = merged.groupBy("f").applyInArrow(choose, "k int, gain double, feature int, cut int, sums array<long>")
        for r in answers.collect():  # ranges * nodes rows
            key = some[r["k"]]
            now = (r["gain"], r["feature"], r["cut"], np.array(r["sums"][:3]), np.array(r["sums"][3:]))
            if key not in found or (now[0], -now[1]) > (found[key][0], -found[key][1]):
                found[key] = now
        shared.unpersist()
    return found


def _finish(blocks: DataFrame, features: int, small: list, trees: Trees, since, task: Task, s: Settings) -> None:
    """Grow the subtrees of nodes whose rows fit a task; each (model, node) is one group."""
    wanted = np.zeros(trees.feature.shape, bool)
    wanted[tuple(np.array(small).T)] = True
    shared = blocks.sparkSession.sparkContext.broadcast((trees, since, task))

    def deal(batches):
        for batch in batches:
            for codes, model, node, g, h in _training(batch, features, shared.value, s.step):
                row, slot = np.nonzero(wanted[model, node])
                m, n = model[row, slot], node[row, slot]
                order = np.lexsort((n, m))
                row, slot, m, n = row[order], slot[order], m[order], n[order]
                starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (n[1:] != n[:-1])]) if len(m) else np.zeros(0, int)
                cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(m)])]
                yield pa.record_batch({
                    "model": pa.array(m[starts].astype(np.int32)), "node": pa.array(n[starts].astype(np.int32)),
                    "codes": pa.array([codes[row[c]].tobytes() for c in cuts], pa.binary()),
                    "g": pa.array([g[row[c], slot[c]].tobytes() for c in cuts], pa.binary()),
                    "h": pa.array([h[row[c], slot[c]].tobytes() for c in cuts], pa.binary()),
                })

    def build(table: pa.Table) -> pa.Table:
        joined = {c: b"".join(table.column(c).to_pylist()) for c in ("codes", "g", "h")}
        model, root = table.column("model")[0].as_py(), table.column("node")[0].as_py()
        made = grow(np.frombuffer(joined["codes"], np.uint8).reshape(-1, features), np.frombuffer(joined["g"], np.int64),
                    np.frombuffer(joined["h"], np.int64), root, task.unit, s)
        node, feature, cut, value, gain = zip(*made)
        return pa.table({
            "model": pa.array([model] * len(made), pa.int32()), "node": pa.array(node, pa.int32()), "feature": pa.array(feature, pa.int32()),
            "cut": pa.array(cut, pa.int32()), "value": pa.array(value, pa.float64()), "gain": pa.array(gain, pa.float64()),
        })

    # a task a node, as far as tasks go: by size alone the planner would let a few grow all trees
    tasks = min(len(small), int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nodes = blocks.mapInArrow(deal, "model int, node int, codes binary, g binary, h binary").repartition(tasks, "model", "node")
    grown = nodes.groupBy("model", "node").applyInArrow(build, "model int, node int, feature int, cut int, value double, gain double")
    for r in grown.collect():  # at most models * 2^(depth + 1) nodes
        at = r["model"], r["node"]
        trees.feature[at], trees.cut[at], trees.value[at], trees.gain[at] = r["feature"], r["cut"], r["value"], r["gain"]
    shared.unpersist()


def pair_task(classes: int, sizes: np.ndarray) -> tuple[Task, list[tuple[int, int]]]:
    """A balanced logistic model for each pair a < b of classes; b is the target."""
    pairs = [(a, b) for a in range(classes) for b in range(a + 1, classes)]
    takes, target, weight = (np.zeros((classes, max(classes - 1, 0)), t) for t in (np.int64, float, float))
    filled = [0] * classes
    for m, (a, b) in enumerate(pairs):
        for c in (a, b):
            takes[c, filled[c]], target[c, filled[c]] = m, float(c == b)
            weight[c, filled[c]] = (sizes[a] + sizes[b]) / (2 * max(int(sizes[c]), 1))
            filled[c] += 1
    return Task(takes, target, weight, len(pairs)), pairs


def class_task(classes: int, weight: np.ndarray | None = None) -> Task:
    """One tree per class and round, coupled by softmax."""
    every = np.tile(np.arange(classes), (classes, 1))
    each = np.ones(classes) if weight is None else np.asarray(weight, float)
    return Task(every, np.eye(classes), np.tile(each[:, None], (1, classes)), classes, softmax=True)

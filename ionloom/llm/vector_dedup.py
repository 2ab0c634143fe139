"""Near copies among embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A hash rotates a vector with three rounds of random signs and a fast Hadamard transform and takes the signed axis nearest to the
result. A bucket joins ``hashes`` of them; a vector is posted in its ``probes`` nearest buckets of each of ``tables`` tables,
and two vectors meet if any of their buckets agree. ``plan`` chooses hashes from the number of vectors, so that a bucket of
unrelated vectors stays small, and tables so that pairs exactly at the threshold meet with the wanted probability (worked out
on drawn pairs; closer pairs meet more often). Every pair that meets is verified by its cosine in double precision.

1. Equal vectors become one class with a weight, so copies of one vector cost no pairs.
2. Classes are hashed and posted as (bucket, class); buckets with one class end here.
3. A bucket of more than ``BLOCK`` classes is dealt to blocks by class, and pairs of blocks are verified in tasks of their own: no
   task holds more than two blocks, whatever a bucket holds. Cosines are matrix products; pairs never become rows. A task
   returns per class the weight of its partners and one class it is connected with.
4. A pair can meet in several buckets; it is counted in the first one they share (by table, then code) only. Each row
   carries all its codes, so a task sees that by itself.
5. Counts are summed per class, connections give components, and rows take the values of their class.

Verified work within a large group of near copies grows with the square of its number of different vectors, as every link has
to be counted; it is spread over block pairs.

Defined cases: vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing (0 links, a
component of their own). Vectors of different lengths never link. Null keys are kept and count as largest; rows that repeat a
key are rows of their own, and equal vectors are links whatever their keys. A component's id is its smallest key. Links at
exactly the threshold count. An empty table gives an empty result. Other columns do not take part.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.components import components
from ionloom.llm.textbatch import mix
from ionloom.llm.vectors import finite
from ionloom.session import cut_lineage

#: Classes of a block; a task holds two blocks at most.
BLOCK = 1024
#: Buckets a vector is posted in per table, and unrelated vectors it may meet per table, about.
PROBES, MEETS = 4, 2
#: Linked pairs whose codes are compared at once.
PAIRS = 1 << 17
_DRAWN = 4000


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row, not scaled; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pair = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x


def _axes(x: np.ndarray, seed: tuple[int, ...], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The signed axes nearest to each rotated row, and how much farther than the nearest each one is."""
    width = x.shape[1]
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = _hadamard(x * s) / math.sqrt(width)
    size = np.abs(x)
    near = np.argsort(-size, axis=1, kind="stable")[:, :most]
    value = np.take_along_axis(size, near, axis=1)
    positive = np.take_along_axis(x, near, axis=1) > 0
    return near * 2 + positive, (value[:, :1] - value) ** 2


def bucket_codes(unit: np.ndarray, hashes: int, tables: int, probes: int = PROBES) -> np.ndarray:
    """Codes of the buckets of each unit vector, tables * probes columns, table by table.

    The probes of a table are the combinations of axes that are least farther away in sum, found hash by hash.
    """
    n, dim = unit.shape
    width = 1 << max(0, (dim - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :dim] = unit
    out = np.zeros((n, tables * probes), np.uint64)
    for t in range(tables):
        code, cost = np.full((n, 1), np.uint64(dim * 1024 + t)), np.zeros((n, 1))
        for h in range(hashes):
            axis, far = _axes(x, (29, t, h, width), min(probes, width))
            total = (cost[:, :, None] + far[:, None, :]).reshape(n, -1)
            joined = (code[:, :, None] * np.uint64(2 * width + 1) + axis[:, None, :].astype(np.uint64)).reshape(n, -1)
            best = np.argsort(total, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(joined, best, axis=1), np.take_along_axis(total, best, axis=1)
        short = probes - code.shape[1]  # a narrow vector has fewer buckets: the last one again
        code = np.concatenate([code, np.repeat(code[:, -1:], short, axis=1)], axis=1) if short else code
        out[:, t * probes : (t + 1) * probes] = mix(code)
    return out.view(np.int64)


def units(values: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square over- or underflows."""
    scaled = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


@lru_cache(maxsize=256)
def meeting_share(dim: int, cosine: float, hashes: int, probes: int) -> float:
    """Share of drawn pairs at exactly this cosine that meet in one table."""
    rng = np.random.default_rng(31)
    a = units(rng.normal(size=(_DRAWN, dim)))
    b = rng.normal(size=(_DRAWN, dim))
    b -= (b * a).sum(axis=1)[:, None] * a
    near = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * (units(b) if dim > 1 else 0)
    one, two = (bucket_codes(v, hashes, 1, probes) for v in (a, near))
    return float((one[:, :, None] == two[:, None, :]).any(axis=(1, 2)).mean())


def plan(n: int, dim: int, cosine: float, recall: float, probes: int = PROBES) -> tuple[int, int]:
    """(hashes per bucket, tables) for n vectors."""
    axes = 2 << max(0, (dim - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(n * probes * probes / MEETS, 1)) / math.log(axes)))
    met = min(max(meeting_share(dim, cosine, hashes, probes), 1e-3), 1 - 1e-9)
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def _hashed(classes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    def codes(batches):
        for batch in batches:
            vectors = batch.column("vec")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            made: list = [None] * batch.num_rows
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                found = bucket_codes(units(_matrix(vectors.take(pa.array(rows)), dim)), *plans[int(dim)])
                for row, code in zip(rows, found):
                    made[row] = code
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"]
            )

    return classes.mapInArrow(codes, f"{', '.join(f'{n} {t}' for n, t in classes.dtypes)}, codes array<long>")


def _first_meeting(mine: np.ndarray, theirs: np.ndarray, probes: int) -> np.ndarray:
    """For each pair of rows of codes the code of the first bucket both are in, by table and then code."""
    n = len(mine)
    a, b = mine.reshape(n, -1, probes), theirs.reshape(n, -1, probes)
    shared = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    table = shared.any(axis=2).argmax(axis=1)
    rows = np.arange(n)
    return np.where(shared[rows, table], a[rows, table], np.iinfo(np.int64).max).min(axis=1)


def _connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n points."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(code: int, cid, weight, vectors, codes, first, last, cosine: float, probes: int):
    """Links of one pair of blocks: (classes with a link, weight of the partners counted here, one connected class of each).

    ``first`` and ``last`` mark the members of either block; they are the same for a block with itself.
    """
    length = np.sqrt((vectors * vectors).sum(axis=1))
    left, right = np.flatnonzero(first), np.flatnonzero(last)
    near = (vectors[left] @ vectors[right].T) / (length[left][:, None] * length[right][None, :]) >= cosine
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    keep = (a < b) if first[right[0]] else np.ones(len(a), bool)
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    add = np.zeros(len(cid), np.int64)
    for at in range(0, len(a), PAIRS):
        i, j = a[at : at + PAIRS], b[at : at + PAIRS]
        here = _first_meeting(codes[i], codes[j], probes) == code
        np.add.at(add, i[here], weight[j[here]])
        np.add.at(add, j[here], weight[i[here]])
    label = _connected(len(cid), a, b)
    linked = np.zeros(len(cid), bool)
    linked[a] = linked[b] = True
    return cid[linked], add[linked], cid[label[linked]]


def _links(members: DataFrame, cosine: float, probes: int) -> DataFrame:
    """(cid, add, mate) rows from members(dim, code, lo, hi, blk, cid, w, vec, codes), which lie together by block pair."""
    key = ["dim", "code", "lo", "hi"]

    def verify(batches):
        def runs():
            held = None
            for batch in batches:
                held = pa.concat_batches([held, batch]) if held is not None else batch
                keys = np.stack([held.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in key], axis=1)
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
                for s, e in zip(starts[:-1], starts[1:]):
                    yield held.slice(s, e - s)
                held = held.slice(starts[-1])
            if held is not None and held.num_rows:
                yield held

        found: list = []

        def flush():
            cid, add, mate = (np.concatenate(x) for x in zip(*found))
            found.clear()
            return pa.record_batch({"cid": pa.array(cid), "add": pa.array(add), "mate": pa.array(mate)})

        for run in runs():
            if run.num_rows < 2:
                continue
            dim, code, lo, hi = (run.column(c)[0].as_py() for c in key)
            blk = run.column("blk").to_numpy()
            first, last = blk == lo, blk == hi
            if not first.any() or not last.any():
                continue
            values = _matrix(run.column("vec"), dim)
            values = np.ldexp(values, -np.frexp(np.abs(values).max(axis=1))[1][:, None])
            codes = run.column("codes").flatten().to_numpy().reshape(run.num_rows, -1)
            got = _verified(code, run.column("cid").to_numpy(), run.column("w").to_numpy(), values, codes, first, last, cosine, probes)
            if got is not None:
                found.append(got)
                if sum(len(x[0]) for x in found) > 10_000:
                    yield flush()
        if found:
            yield flush()

    return members.mapInArrow(verify, "cid long, add long, mate long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.999, key: str = "vec_id",
                 vector: str = "embedding", probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; ``recall`` is planned for pairs exactly at the threshold."""
    spark = vectors.sparkSession
    vec = F.col(f"`{vector}`")
    if vectors.schema[vector].dataType.elementType.simpleString() not in ("float", "double"):
        vec = vec.cast("array<double>")
    usable = finite(vec) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.when(usable, vec).alias("vec")).select(
        "id", "vec", F.when(F.col("vec").isNotNull(), F.xxhash64("vec")).alias("h1"),
        F.when(F.col("vec").isNotNull(), F.xxhash64(F.reverse("vec"))).alias("h2"),  # 128 bits tell vectors apart
    )
    valid = rows.where("vec IS NOT NULL")
    plans = {r["d"]: plan(r["count"], r["d"], cosine, recall, probes) for r in valid.groupBy(F.size("vec").alias("d")).count().collect()}
    classes = valid.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("low"), F.first("vec").alias("vec"))
    classes = cut_lineage(_hashed(classes, plans).withColumn("cid", F.monotonically_increasing_id()))

    posts = classes.select("cid", F.size("vec").alias("dim"), F.explode(F.array_distinct("codes")).alias("code"))
    crowded = posts.groupBy("dim", "code").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"),
                                               F.count(F.lit(1)).alias("_m")).where("_m > 1").drop("_m")
    blk = F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int")
    placed = posts.join(crowded, ["dim", "code"]).withColumn("blk", blk).withColumn(
        "_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).select("dim", "code", F.least("blk", "_o").alias("lo"), F.greatest("blk", "_o").alias("hi"), "blk", "cid")
    members = placed.join(classes.select("cid", "w", "vec", "codes"), "cid").repartition("dim", "code", "lo", "hi").sortWithinPartitions(
        "dim", "code", "lo", "hi", "cid"
    )
    found = cut_lineage(_links(members, cosine, probes))
    counts = found.groupBy("cid").agg(F.sum("add").alias("add"))
    comps = components(found, "cid", "mate")
    named = classes.select("cid", "h1", "h2", "w", "low").join(counts, "cid", "left").join(
        comps.select(F.col("node").alias("cid"), "comp"), "cid", "left"
    ).withColumn("comp", F.coalesce("comp", "cid"))
    named = cut_lineage(named)
    smallest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = named.join(smallest, "comp").select(
        "h1", "h2", (F.col("w") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), "component_id"
    )
    component = F.coalesce("component_id", "id")
    return rows.select("id", "h1", "h2").join(by_class, ["h1", "h2"], "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )

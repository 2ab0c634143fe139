"""Language by nearest centroid: TF-IDF vectors of letter n-grams against a few clustered centroids per language.

Texts are lower-cased, everything that is no letter counts as a space, and byte pairs and triples are hashed into
``DIMENSIONS`` counts. Weighted by rarity and scaled to length 1, they are compared by cosine with the centroids of every
language. The best cosine is the score; below the distance that nearly all training texts of the winner keep, the
prediction is marked ``rejected``.

The fit (rarity weights and centroids) reads a bounded sample of about ``per_language`` texts per language, chosen by hash
of the id. Null texts and texts without a letter are ``und`` with score 0. Ties go to the alphabetically first language.
Other columns are kept; columns of the output names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb

DIMENSIONS = 4096
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def gram_counts(column: pa.Array) -> np.ndarray:
    """Hashed counts of byte pairs and triples: one row per text."""
    data, offsets = tb.utf8_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    codes = _FOLD[data].astype(np.uint32)
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    out = np.zeros(len(column) * DIMENSIONS, np.int64)
    for n in (2, 3):
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) + codes[k : len(codes) - n + 1 + k]
        h *= np.uint32(2654435769)
        cell = (h >> np.uint32(20)).astype(np.int64)
        whole = owner[: len(h)] == owner[n - 1 :]
        whole &= (codes[: len(h)] != 32) | (codes[n - 1 :] != 32)
        out += np.bincount((owner[: len(h)] * DIMENSIONS + cell)[whole], minlength=len(out))
    return out.reshape(len(column), DIMENSIONS)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def vectors(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(gram_counts(column)).astype(np.float32) * weights)


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts."""
    centres = [unit(rows.mean(axis=0, keepdims=True))[0]]
    near = rows @ centres[0]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[int(near.argmin())])
        near = np.maximum(near, rows @ centres[-1])
    held = np.stack(centres)
    for _ in range(rounds):
        own = (rows @ held.T).argmax(axis=1)
        held = unit(np.stack([rows[own == c].mean(axis=0) if (own == c).any() else held[c] for c in range(len(held))]))
    return held


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid, sorted
    centroids: bytes
    weights: bytes
    reach: tuple[float, ...]  # least cosine of each centroid's language that is not rejected


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 700, centroids: int = 4, train: Column | None = None) -> Model:
    """Learn from the rows with a language that ``train`` (a condition on the key) admits."""
    tb.small_batches(docs.sparkSession)
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.lit(True) if train is None else train)).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")
    )
    sizes = {r.l: r.n for r in usable.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("l") == name, min(1.0, per_language / n)).otherwise(rate)

    @F.arrow_udf("binary")
    def counts(column: pa.Array) -> pa.Array:
        return pa.array([row.astype(np.float32).tobytes() for part in tb.slices(column) for row in gram_counts(part)], pa.binary())

    chosen = usable.where(F.pmod(F.xxhash64(F.lit(31), "k"), F.lit(1 << 20)) < rate * float(1 << 20))
    rows = chosen.select("l", counts("t").alias("v")).limit(2 * per_language * max(1, len(sizes))).collect()
    if not rows:
        return Model((), b"", np.ones(DIMENSIONS, np.float32).tobytes(), ())
    table = np.stack([np.frombuffer(r.v, np.float32) for r in rows])
    own = np.array([r.l for r in rows])
    weights = (np.log((1 + len(rows)) / (1 + (table > 0).sum(axis=0))) + 1).astype(np.float32)
    table = unit(np.sqrt(table) * weights)
    names, held, reach = [], [], []
    for name in sorted(set(own.tolist())):
        mine = table[own == name]
        found = cluster(mine, centroids)
        best = (mine @ found.T).max(axis=1)
        names += [name] * len(found)
        held.append(found)
        reach += [float(np.quantile(best, 0.005)) * 0.8] * len(found)
    return Model(tuple(names), np.concatenate(held).astype(np.float32).tobytes(), weights.tobytes(), tuple(reach))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected``."""
    tb.small_batches(docs.sparkSession)
    names = pa.array([*model.languages, "und"])

    @F.arrow_udf("struct<l:string,s:double,r:boolean>")
    def nearest(column: pa.Array) -> pa.Array:
        if not model.languages:
            n = len(column)
            return pa.StructArray.from_arrays([pa.array(["und"] * n), pa.array([0.0] * n), pa.array([True] * n)], names=["l", "s", "r"])
        weights = np.frombuffer(model.weights, np.float32)
        centres = np.frombuffer(model.centroids, np.float32).reshape(-1, DIMENSIONS)
        reach = np.array(model.reach)
        which, cosines = [np.zeros(0, np.int64)], [np.zeros(0)]
        for part in tb.slices(column, 1 << 20):
            for at in range(0, len(part), 256):  # dense rows of 4096 numbers
                near = vectors(part.slice(at, 256), weights) @ centres.T
                which.append(near.argmax(axis=1))
                cosines.append(near.max(axis=1).astype(float))
        best, cosine = np.concatenate(which), np.clip(np.concatenate(cosines), 0, 1)
        return pa.StructArray.from_arrays(
            [names.take(pa.array(best)), pa.array(cosine), pa.array(cosine < reach[best])], names=["l", "s", "r"]
        )

    readable = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    near = tb.unused(docs, "_near")[0]
    return docs.withColumn(near, nearest(text)).withColumns({
        "lang_pred": F.when(readable, F.col(near)["l"]).otherwise(F.lit("und")),
        "score": F.when(readable, F.col(near)["s"]).otherwise(F.lit(0.0)),
        "rejected": F.when(readable, F.col(near)["r"]).otherwise(F.lit(True)),
    }).drop(near)

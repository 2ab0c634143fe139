"""Quality score by compression: which of two zstandard dictionaries, of good or of bad text, packs a text smaller.

Two dictionaries are trained on pieces of labelled text. A text is cut into pieces of ``PIECE_BYTES`` (all of it, so long
texts are judged by the same measure as short ones), every piece is compressed with both, and the size difference per
byte becomes a probability through a logistic curve fitted on other labelled texts.

The fit reads a bounded sample: ``pieces`` pieces per class for the dictionaries and about ``calibration`` texts for the
curve, both chosen by hash of the id. Rows with null or contradicting labels are not learned from. Null and empty texts
get the score of a zero difference. With one class only the score is that class's share; without labels it is 0.5.
Other columns are kept; columns of the output names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb

PIECE_BYTES = 1024
DICTIONARY_BYTES = 112_640
SMOOTHING_BYTES = 50
LEVEL = 3


def fold(key: Column, folds: int) -> Column:
    """Remainder of the crc32 of the id's text."""
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def train_dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples: their raw bytes serve as dictionary
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Scales:
    """Compressors of the two dictionaries."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        self.packers = []
        for data in dictionaries:
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
            ))

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) per byte; positive speaks for good text."""
        bad, good = self.packers
        gap = sum(
            len(bad.compress(text[at : at + PIECE_BYTES])) - len(good.compress(text[at : at + PIECE_BYTES]))
            for at in range(0, len(text), PIECE_BYTES)
        )
        return gap / (len(text) + SMOOTHING_BYTES)


def difference(dictionaries: tuple[bytes, bytes]):
    """Function from a text column to the normalized size difference."""

    @F.arrow_udf("double")
    def gap(column: pa.Array) -> pa.Array:
        scales = tb.kept(("scales", dictionaries), lambda: Scales(dictionaries))
        data, offsets = tb.utf8_bytes(column)
        raw = memoryview(data)
        return pa.array([scales.difference(bytes(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:])], pa.float64())

    return gap


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a light penalty on the slope."""
    design = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    ridge = np.diag([1e-9, 1e-4])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


@dataclass(frozen=True)
class Model:
    dictionaries: tuple[bytes, bytes] | None
    intercept: float
    slope: float


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", pieces: int = 4000, calibration: int = 6000, train: Column | None = None) -> Model:
    """Learn from the labelled rows that ``train`` (a condition on the key) admits."""
    spark = docs.sparkSession
    tb.small_batches(spark)
    usable = labels.where(F.col(label).isin(0, 1) & (F.lit(True) if train is None else train)).groupBy(
        F.col(key).alias("_key")
    ).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_key", "_y")
    half = F.pmod(F.xxhash64(F.lit(11), "_key"), F.lit(1 << 20))
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = 0.5 if not total else float(min(max(next(iter(counts)), 0.001), 0.999))
        return Model(None, float(np.log(share / (1 - share))), 0.0)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    dictionaries = []
    for y in (0, 1):
        chosen = usable.where((F.col("_y") == y) & (half % 2 == 0)).orderBy(half, "_key").limit(pieces).select("_key")
        body = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).select("_key", F.coalesce("_text", F.lit("")).alias("t"))
        cut = body.select("_key", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor(F.length("t") / PIECE_BYTES).cast("int")),
            lambda i: F.substring(F.col("t"), i * PIECE_BYTES + 1, F.lit(PIECE_BYTES)),
        )).alias("at", "piece")).where(F.length("piece") > 0)
        rows = cut.orderBy(F.xxhash64(F.lit(12), "_key", "at")).limit(pieces).collect()
        dictionaries.append(train_dictionary([r.piece.encode() for r in rows]))
    pair = (dictionaries[0], dictionaries[1])
    held = usable.where(half % 2 == 1).orderBy(half, "_key").limit(calibration)
    seen = texts.join(F.broadcast(held), F.col("_id") == F.col("_key")).select("_y", difference(pair)(F.col("_text")).alias("x")).limit(2 * calibration).toPandas()
    if seen["_y"].nunique() < 2:
        share = counts[1] / total
        return Model(None, float(np.log(share / (1 - share))), 0.0)
    return Model(pair, *logistic(seen["x"].to_numpy(float), seen["_y"].to_numpy(float)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher for good text) and ``predicted``."""
    tb.small_batches(docs.sparkSession)
    gap = difference(model.dictionaries)(F.col(text)) if model.dictionaries else F.lit(0.0)
    chance = 1 / (1 + F.exp(-(F.lit(model.intercept) + gap * model.slope)))
    return docs.withColumn("score", chance).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

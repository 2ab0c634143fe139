"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a 64-bit key: a hash of the text, then a hash of the row id, so equal texts stand together but a
group of copies of any size can be cut. Probes inside the key range are counted over all partitions (exact bytes and
rows below each), the range of every splitter is narrowed around its target, and this repeats until the splitters meet
the tolerance. Then rows are exchanged once, by sub-range, and numbered.

Only histograms (a row per probe) reach the driver. Null text counts as no bytes, every row weighs ``overhead`` bytes
more. Rows that repeat both id and text share a key and stay together. An empty table gives an empty result, fewer rows
than shards leave shards empty. Columns other than id and text are not needed; columns of the added names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb
from ionloom.session import cut_lineage

LOW, HIGH = -(1 << 63), (1 << 63) - 1
ROWS_PER_PART = 200_000


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", overhead: int = 16, name: str = "_k") -> DataFrame:
    """Add ``size`` and the sort key ``name``."""
    high = F.shiftright(F.xxhash64(text), 32)
    low = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    return docs.withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long"),
        name: F.shiftleft(high, 32) + low,
    })


def histogram(rows: DataFrame, bounds: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows in each interval: below bounds[0], from bounds[0] up to bounds[1], ..."""
    edges = np.array(bounds, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), "right")
            np.add.at(sizes, at, batch.column(1).to_numpy())
            n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sizes[used]), pa.array(n[used])], names=["b", "s", "n"])

    found = rows.select("_k", "size").mapInArrow(count, "b long, s long, n long").groupBy("b").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    sizes, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for row in found.collect():  # one row per probe at most
        sizes[row.b], n[row.b] = row.s, row.n
    return sizes, n


def splitters(rows: DataFrame, targets: Sequence[int], slack: Sequence[float], probes: int = 64, rounds: int = 40) -> list[int]:
    """For each target, a key with about that many bytes below it (within ``slack`` unless a single key is heavier)."""
    low, high = [LOW] * len(targets), [HIGH] * len(targets)
    best: list[tuple[float, int]] = [(float("inf"), LOW)] * len(targets)
    for _ in range(rounds):
        open_ = [i for i in range(len(targets)) if best[i][0] > slack[i] and high[i] - low[i] > 1]
        if not open_:
            break
        spans = {(low[i], high[i]) for i in open_}
        each = max(probes, len(targets) * 2) if len(spans) == 1 else probes
        points = sorted({a + (b - a) * k // (each + 1) for a, b in spans for k in range(1, each + 1)} - {LOW})
        below = np.cumsum(histogram(rows, points)[0])[:-1]
        for i in open_:
            at = int(np.searchsorted(below, targets[i]))
            for k in (at - 1, at):
                if 0 <= k < len(points):
                    gap = abs(int(below[k]) - targets[i])
                    best[i] = min(best[i], (gap, points[k]))
            if at > 0:
                low[i] = max(low[i], points[at - 1])
            if at < len(points):
                high[i] = min(high[i], points[at])
    return [point for _, point in best]


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", tolerance: float = 0.002, overhead: int = 16) -> DataFrame:
    """Add ``size``, ``shard`` and ``slot`` (0.. without gaps in each shard). Payload columns cross the exchange once."""
    docs = docs.drop("shard", "slot")
    order, sub, number, base = tb.unused(docs, "_k", "_part", "_n", "_base")
    weighed = keyed(docs, key, text, overhead, order)
    rows = cut_lineage(weighed.select(F.col(order).alias("_k"), "size"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(16, -(-n // (ROWS_PER_PART * shards)))  # sub-ranges of a shard, numbered by different tasks
    cuts = shards * parts
    targets = [total * i // cuts for i in range(1, cuts)]
    slack = [tolerance * total / shards if i % parts == 0 else 0.3 * total / cuts for i in range(1, cuts)]
    found = splitters(rows, targets, slack) if n else [LOW + 1 + i for i in range(cuts - 1)]
    outer = sorted(found[i - 1] for i in range(1, cuts) if i % parts == 0)
    bounds = sorted(set(found))
    counts = histogram(rows, bounds)[1]
    owner = np.searchsorted(np.array(outer, np.int64), np.array([LOW, *bounds], np.int64), "right")
    before = np.cumsum(counts) - counts
    first = {}
    for b, s in enumerate(owner.tolist()):
        first.setdefault(s, int(before[b]))
    places = docs.sparkSession.createDataFrame(
        [(b, s, int(before[b]) - first[s]) for b, s in enumerate(owner.tolist())], f"{sub} int, shard int, {base} long"
    )  # one row per sub-range
    edges = np.array(bounds, np.int64)

    @F.arrow_udf("int")
    def part(column: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, column.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    inside = Window.partitionBy(sub).orderBy(order, key)
    placed = weighed.withColumn(sub, part(order)).withColumn(number, F.row_number().over(inside))
    return placed.join(F.broadcast(places), sub).withColumn(
        "slot", (F.col(base) + F.col(number) - 1).cast("long")
    ).drop(sub, order, number, base)

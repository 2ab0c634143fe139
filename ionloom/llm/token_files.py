"""Token-id files: fixed-size blocks of ids turned into byte or bit planes, each plane compressed with zstandard.

A folder of Parquet files holds one row per chunk: whole documents up to about ``CHUNK_IDS`` ids. Their ids are cut into
blocks of ``BLOCK_IDS``; a block is transposed so that plane p holds byte (or bit) p of all its ids, and every plane is
one zstandard frame in ``payload``. The other columns are the index: where a chunk stands in its shard, which documents
it holds, and where each frame ends, so a single block can be read without the rest. Spark's writer commits the files,
so a lost executor or a repeated task leaves no half or double chunk.

Null ids count as an empty list; every document gets ``end_id`` appended. Repeated keys are written as they come,
after each other. An empty table gives an empty folder that reads back as no rows. Columns other than key and ids are
not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.llm import bpe
from ionloom.llm import textbatch as tb
from ionloom.session import scratch_folder, settings

#: Bytes of texts, or of chunks, that travel to a task's Python worker at once.
BATCH_BYTES = 4 << 20
CHUNK_IDS = 1 << 18
BLOCK_IDS = 1 << 16


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of one block of unsigned 32-bit ids, lowest first."""
    cells = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [plane.tobytes() for plane in np.ascontiguousarray(cells.T)]
    table = np.unpackbits(cells, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(table.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Ids of one block of ``n`` from its 4 byte planes or 32 bit planes."""
    if len(planes) == 4:
        return np.ascontiguousarray(np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T).view("<u4").ravel()
    table = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(table, axis=1, bitorder="little").view("<u4").ravel()


def pack(ids: np.ndarray, bits: bool = False, level: int = 3) -> tuple[bytes, list[int]]:
    """(payload, end of each frame) of the ids of one chunk."""
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(p) for at in range(0, len(ids), BLOCK_IDS) for p in to_planes(ids[at : at + BLOCK_IDS], bits)]
    return b"".join(frames), np.cumsum([len(f) for f in frames]).tolist() if frames else []


def unpack(payload: bytes, ends: list[int], n: int) -> np.ndarray:
    """All ids of one chunk."""
    blocks = -(-n // BLOCK_IDS)
    if not blocks:
        return np.zeros(0, "<u4")
    per_block = len(ends) // blocks
    press = zstandard.ZstdDecompressor()
    starts = [0, *ends[:-1]]
    out = []
    for b in range(blocks):
        planes = [press.decompress(payload[starts[k] : ends[k]]) for k in range(b * per_block, (b + 1) * per_block)]
        out.append(from_planes(planes, min(BLOCK_IDS, n - b * BLOCK_IDS)))
    return np.concatenate(out)


def in_order(df: DataFrame, key: str, *ties: str | Column) -> DataFrame:
    """Range-partition and sort by the key; ``ties`` split a key that many rows share."""
    return df.repartitionByRange(key, *ties).sortWithinPartitions(key, *ties)


def write(df: DataFrame, folder: str, key: str = "doc_id", ids: str = "ids", end_id: int = 0, bits: bool = False) -> None:
    """Write rows that are already in global order (see ``in_order``); one shard per partition."""
    key_type = df.schema[key].dataType
    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("frame_ends", T.ArrayType(T.IntegerType())), T.StructField("payload", T.BinaryType()),
    ])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        chunk, first, waiting = 0, 0, 0
        keys, sizes, parts = [], [], []

        def row():
            data = np.concatenate(parts)
            payload, ends = pack(data, bits)
            own = pa.concat_arrays([k if k.type == keys[0].type else k.cast(keys[0].type) for k in keys])
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first], pa.int64()),
                pa.array([len(data)], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own),
                pa.array([sizes], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int32())), pa.array([payload], pa.binary()),
            ], names=[f.name for f in schema.fields])

        for batch in batches:
            lists = batch.column(1)
            if lists.null_count:
                lists = pc.fill_null(lists, pa.scalar([], lists.type))
            place = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[place[0] : place[-1]]
            counts = np.diff(place)
            ends = np.cumsum(counts + 1)
            data = np.full(ends[-1] if len(ends) else 0, end_id, "<u4")
            data[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
            i = base = 0
            while i < len(lists):  # rows up to the one that fills the chunk
                upto = min(int(np.searchsorted(ends, base + CHUNK_IDS - waiting)) + 1, len(lists))
                keys.append(batch.column(0).slice(i, upto - i))
                sizes.extend((counts[i:upto] + 1).tolist())
                parts.append(data[base : ends[upto - 1]])
                waiting += int(ends[upto - 1]) - base
                i, base = upto, int(ends[upto - 1])
                if waiting >= CHUNK_IDS:
                    yield row()
                    chunk, first, waiting = chunk + 1, first + waiting, 0
                    keys, sizes, parts = [], [], []
        if parts:
            yield row()

    df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInArrow(chunks, schema).write.option(
        "compression", "uncompressed"  # the payload is compressed already
    ).parquet(folder)


def read(spark: SparkSession, folder: str, key: str = "doc_id", raw: bool = False) -> DataFrame:
    """One row per document: key, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``.

    ``raw`` returns the ids as little-endian unsigned 32-bit bytes. The sizes of the shards, one row each, are the only
    thing summed over the whole folder.
    """
    files = spark.read.parquet(folder)
    key_type = files.schema["keys"].dataType.elementType
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    schema = T.StructType([
        T.StructField(key, key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType() if raw else T.ArrayType(T.IntegerType())),
    ])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                at, n, keys, sizes, ends, payload = (batch.column(k)[i] for k in range(6))
                data = unpack(payload.as_py(), ends.as_py(), n.as_py())
                own = np.array(sizes.as_py(), np.int64)
                place = np.concatenate([[0], np.cumsum(own)])
                held = tb.binary_array(place * 4, data.view(np.uint8)) if raw else tb.list_array(place, data.view(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(place[:-1] + at.as_py()), pa.array(own), held], names=schema.names
                )

    # a chunk is about a megabyte of ids: few of them travel together. A bound in bytes changes no other query's result
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return files.join(F.broadcast(bases), "shard").select(
        (F.col("first") + F.col("_base")).alias("at"), "n_ids", "keys", "sizes", "frame_ends", "payload"
    ).mapInArrow(documents, schema)


def store(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0, bits: bool = False) -> str:
    """Encode all texts in ascending key order and write them to a new folder in the shared checkpoint place."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "token-files")
    ordered = in_order(docs.select(key, text), key, F.xxhash64(text))
    encoded = bpe.encode(ordered, vocabulary, text, "_ids")
    # batches by bytes: enough short texts at once that a word is looked up once for many of them
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="10000", spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        write(encoded, folder, key, "_ids", end_id, bits)
    return folder

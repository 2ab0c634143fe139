"""NumPy and Arrow helpers for text columns inside tasks: byte buffers, ragged arrays, word and shingle hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch for whole texts; with SLICE_BYTES it bounds the memory of a Python worker.
BATCH_ROWS = 500
#: A batch is worked on in slices of about this many bytes (one text is never cut).
SLICE_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of few rows, since one text can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@cache
def _trim() -> Callable[[int], int]:
    """The C library's call that returns freed memory to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Return what this worker has freed to the system; workers outlive their task and would keep it beside the next one."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps between the tasks of one step. What an earlier step has kept is let go."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
        give_back()  # what it took to make it
    return _kept[key]


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a step that keeps nothing: what earlier steps kept is let go, and what is freed on the way given back."""
    _kept.clear()
    give_back()
    for batch in batches:
        yield batch
        give_back()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(ends):
        ends = np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, ends - ends[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive pieces of the column of about ``most`` bytes, at least one text each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = utf8_bytes(column)[1]
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield column.slice(at, upto - at)
        at = upto


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Offsets of a ragged array whose rows have these lengths."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged_take(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array in the given order: (offsets, values)."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    out = offsets_of(lengths)
    at = np.arange(out[-1])
    at += np.repeat(offsets[:-1][rows] - out[:-1], lengths)
    return out, values[at]


def list_array(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binary_array(offsets: np.ndarray, data: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Binary (or string) column over existing bytes; the offsets must cover less than 2 GB."""
    return pa.Array.from_buffers(
        kind or pa.binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))],
    )


_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_rng = np.random.default_rng(20)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (finalizer of a common hash)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans between ASCII white space: (starts, ends, offsets of each text into them)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    cut = edges[inside[edges] & inside[edges + 1]]
    first[cut] = True
    last[cut] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def lower_word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased: (hashes, offsets of each text)."""
    data, offsets = utf8_bytes(column)
    data = _LOWER[data]
    starts, ends, per_text = words(data, offsets)
    return span_hashes(data, starts, ends), per_text


_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


def plain_word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``lower_word_hashes`` for words in lower case of any script, where ASCII signs separate words."""
    data, offsets = utf8_bytes(pc.utf8_lower(column))
    data = _PLAIN[data]
    starts, ends, per_text = words(data, offsets)
    return span_hashes(data, starts, ends), per_text


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words per text. With ``short``, a text of fewer words is one run of all its words.

    Returns (hashes, offsets of each text); order and repeats are kept.
    """
    count = np.diff(offsets)
    runs = np.maximum(count - n + 1, 0)
    few = (count > 0) & (count < n) if short else np.zeros(len(count), bool)
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs + few, out=out[1:])
    made = np.zeros(out[-1], np.uint64)
    at = np.arange(int(runs.sum()))
    own = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs, out=own[1:])
    source = at + np.repeat(offsets[:-1] - own[:-1], runs)
    value = np.full(len(at), n, np.uint64)
    for k in range(n):
        value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[source + k]
    made[at + np.repeat(out[:-1] - own[:-1], runs)] = mix(value)
    for i in np.flatnonzero(few):
        whole = np.full(1, count[i], np.uint64)
        for h in hashes[offsets[i] : offsets[i + 1]]:
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + h
        made[out[i]] = mix(whole)[0]
    return made, out

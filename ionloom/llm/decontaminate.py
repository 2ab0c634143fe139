"""Benchmark decontamination: shared word n-grams as seeds, Smith-Waterman alignment as the score.

Every n-gram of a benchmark item goes into a fixed-size bit filter. One pass over the training texts keeps the passages
around filter hits (as word hashes, reaching on both sides as far as an alignment with the longest item can). A passage
and an item that share any n-gram, however common, are a pair. A pair is aligned once, unless no stretch of the passage
holds as many words of the item as a copy must match. The local alignment of passage and item words, divided by the best
score possible for the item, is the score.

A pair is a copy if the score reaches the threshold and the alignment is worth ``SHORT`` matching words (``NEAR_WHOLE`` of
an item for which that is less, so a phrase of a short item is not enough), or if the passage holds ``EXCERPT`` words of
the item in a row, whatever share of a long item they are. Every copy with ``n`` words in a row left intact is found; one with a word put in after
every ``n - 1`` words or fewer is not.

Words are in lower case and end at ASCII white space or signs, so a copy in capitals or with other punctuation is a copy.
Null or empty texts and items match nothing, and items of
fewer than ``n`` words are too short to be told from chance and match nothing. Repeated items each match; repeated documents
give repeated hits merged by id. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb
from ionloom.session import cut_lineage, small_side

N = 3
MATCH, MISMATCH, GAP = 1.0, -0.5, 0.5
THRESHOLD = 0.5
EXCERPT = 13  # words in a row that make a copy of any item, however long
SHORT, NEAR_WHOLE = 7, 0.8  # an alignment is worth so many words, or such a share of a shorter item
FILTER_BITS = 24
ALIGNMENT = "struct<score:double,start:bigint,stop:bigint,copy:boolean>"


def needed(length: int, threshold: float) -> float:
    """Score that makes an alignment with an item of so many words a copy."""
    return MATCH * max(threshold * length, min(NEAR_WHOLE * length, SHORT))


def holds_run(words: np.ndarray, item: np.ndarray, size: int) -> bool:
    """Whether the two have ``size`` words in a row in common."""
    if min(len(words), len(item)) < size:
        return False
    runs = [tb.shingle_hashes(x, np.array([0, len(x)]), size, short=False)[0] for x in (words, item)]
    return bool(np.isin(*runs).any())


def align(passages: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the passage position where it ends, all pairs in step."""
    best = np.zeros(len(items))
    end = np.zeros(len(items), np.int64)
    if not items:
        return best, end
    width, height = max(map(len, passages)), max(map(len, items))
    own = np.arange(len(items))
    table = np.zeros((len(items), width), np.uint64)
    rows = np.zeros((len(items), height), np.uint64)
    there = np.zeros((len(items), width), bool)
    for i, (p, q) in enumerate(zip(passages, items)):
        table[i, : len(p)], there[i, : len(p)], rows[i, : len(q)] = p, True, q
    lengths = np.array([len(q) for q in items])
    slope = GAP * np.arange(width)
    above = np.zeros((len(items), width + 1))
    for k in range(height):
        step = np.where((table == rows[:, k, None]) & there, MATCH, MISMATCH)
        cell = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - GAP), 0)
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope  # gaps along the passage
        live = k < lengths
        above[live, 1:] = cell[live]
        at = cell.argmax(axis=1)
        top = cell[own, at]
        better = live & (top > best)
        best[better], end[better] = top[better], at[better] + 1
    return best, end


def _grams(texts: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """N-grams of the items in order, and the items' word hashes."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = tb.plain_word_hashes(batch.column(1))
            made, per_item = tb.shingle_hashes(hashes, offsets, n, short=False)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), tb.list_array(per_item, made.view(np.int64), pa.int64()), tb.binary_array(offsets * 8, hashes.view(np.uint8)),
            ], names=["item_id", "grams", "words"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(grams, f"item_id {kind}, grams array<bigint>, words binary").where(F.size("grams") > 0)


def bit_filter(grams: DataFrame) -> np.ndarray:
    """Bit array of 2^FILTER_BITS with two bits per n-gram; its size does not depend on the table."""
    mask = (1 << FILTER_BITS) - 1
    spots = F.array(F.col("h").bitwiseAND(mask), F.shiftright("h", 32).bitwiseAND(mask))
    rows = grams.select(F.explode(spots).alias("b")).distinct().groupBy(F.floor(F.col("b") / 65536).alias("page")).agg(F.collect_set("b").alias("bits"))
    out = np.zeros(1 << FILTER_BITS, bool)
    for row in rows.collect():  # at most 256 pages
        out[row.bits] = True
    return out


def passages(docs: DataFrame, bits: np.ndarray, reach: int, key: str, text: str, n: int) -> DataFrame:
    """Stretches of words around filter hits: doc_id, first, words, hits."""
    packed = docs.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())  # 2 MB
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(packed.value, np.uint8)).view(bool)
        for batch in tb.lean(batches):
            keys, at = [], 0
            firsts, words, hits = [], [], []
            for part in tb.slices(batch.column(1)):
                hashes, offsets = tb.plain_word_hashes(part)
                made, per_text = tb.shingle_hashes(hashes, offsets, n, short=False)
                hit = np.flatnonzero(table[made & mask] & table[(made >> np.uint64(32)) & mask])
                owner = np.searchsorted(per_text, hit, "right") - 1
                place = hit - per_text[owner]
                if len(hit):
                    apart = np.flatnonzero((np.diff(owner) != 0) | (np.diff(place) > 2 * reach)) + 1
                    for low, high in zip([0, *apart.tolist()], [*apart.tolist(), len(hit)]):
                        d = int(owner[low])
                        size = int(offsets[d + 1] - offsets[d])
                        start = max(0, int(place[low]) - reach)
                        stop = min(size, int(place[high - 1]) + n + reach)
                        keys.append(at + d)
                        firsts.append(start)
                        words.append(hashes[offsets[d] + start : offsets[d] + stop].tobytes())
                        hits.append(np.unique(made[hit[low:high]]).view(np.int64))
                at += len(part)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keys, pa.int64())), pa.array(firsts, pa.int64()), pa.array(words, pa.binary()),
                pa.array(hits, pa.list_(pa.int64())),
            ], names=["doc_id", "first", "words", "hits"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(find, f"doc_id {kind}, first long, words binary, hits array<bigint>")


def span(length: int, threshold: float) -> int:
    """Most passage words an alignment that reaches the threshold can take: all matches, and the gaps they can pay for."""
    return int(length * (1 + max(0.0, 1 - threshold) * MATCH / GAP)) + 1


def stretch(words: np.ndarray, item: np.ndarray, threshold: float) -> tuple[int, int]:
    """The part of a passage outside which no alignment makes a copy by its score; (0, 0) if none does anywhere.

    Every match takes a passage word that the item has, so an alignment's score is at most the count of such words in it.
    """
    width = span(len(item), threshold)
    sums = np.concatenate([[0], np.cumsum(np.isin(words, item))])
    starts = np.arange(max(1, len(words) - width + 1))
    held = sums[np.minimum(starts + width, len(words))] - sums[starts]
    able = np.flatnonzero(MATCH * held >= needed(len(item), threshold))
    return (int(able[0]), min(len(words), int(able[-1]) + width)) if len(able) else (0, 0)


def align_batch(words: pa.Array, item_words: pa.Array, threshold: float = THRESHOLD) -> pa.Array:
    """Score, first and last word (in the passage) of the best alignment of each row, and whether it is a copy.

    The score is 0 where no alignment can make a copy.
    """
    own = [np.frombuffer(w, np.uint64) for w in words.to_pylist()]
    other = [np.frombuffer(w, np.uint64) for w in item_words.to_pylist()]
    excerpt = np.array([holds_run(p, q, EXCERPT) for p, q in zip(own, other)], bool)
    parts = [(0, len(p)) if x else stretch(p, q, threshold) for p, q, x in zip(own, other, excerpt)]
    own = [p[low:high] for p, (low, high) in zip(own, parts)]
    score, start, stop = np.zeros(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    copy = np.zeros(len(own), bool)
    order = sorted((i for i in range(len(own)) if len(own[i])), key=lambda i: (len(own[i]), len(other[i])))
    at = 0
    while at < len(order):  # pairs of similar length, a bounded number of cells at a time
        upto = at + 1
        while upto < len(order) and (upto + 1 - at) * len(own[order[upto]]) <= 400_000:
            upto += 1
        some = order[at:upto]
        best, end = align([own[i] for i in some], [other[i] for i in some])
        score[some] = best / (MATCH * np.array([max(1, len(other[i])) for i in some]))
        stop[some] = end
        near = [k for k, i in enumerate(some) if excerpt[i] or best[k] >= needed(len(other[i]), threshold)]
        if near:  # the same alignment read backwards gives its start
            back = align([own[some[k]][: end[k]][::-1] for k in near], [other[some[k]][::-1] for k in near])[1]
            start[[some[k] for k in near]] = end[near] - back
            copy[[some[k] for k in near]] = True
        at = upto
    moved = np.array([low for low, _ in parts], np.int64)
    columns = [pa.array(score), pa.array(start + moved), pa.array(stop + moved), pa.array(copy)]
    return pa.StructArray.from_arrays(columns, names=["score", "start", "stop", "copy"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    n: int = N, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and item that it holds a copy of: doc_id, item_id, score, start_word, end_word of the best place."""
    tb.small_batches(docs.sparkSession)

    def aligned(words: pa.Array, item_words: pa.Array) -> pa.Array:
        try:
            return align_batch(words, item_words, threshold)
        finally:
            tb.give_back()

    items = cut_lineage(_grams(benchmark, item_key, item_text, n).withColumn("_i", F.monotonically_increasing_id()))
    grams = items.select("_i", F.explode(F.array_distinct("grams")).alias("h"))
    reach = span(items.agg(F.coalesce(F.max(F.length("words") / 8), F.lit(0)).cast("int")).first()[0], threshold)
    found = cut_lineage(passages(docs, bit_filter(grams), reach, key, text, n).withColumn("_p", F.monotonically_increasing_id()))
    pairs = found.select("_p", F.explode("hits").alias("h")).join(small_side(grams), "h").select("_p", "_i").distinct()
    scored = pairs.join(found.select("_p", "doc_id", "first", "words"), "_p").join(
        small_side(items.select("_i", "item_id", F.col("words").alias("item_words"))), "_i"
    ).withColumn("_a", F.arrow_udf(aligned, ALIGNMENT)("words", "item_words")).where("_a.copy")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        F.col("_a.score").alias("score"), (-(F.col("first") + F.col("_a.start"))).alias("s"), (F.col("first") + F.col("_a.stop")).alias("e")
    )).alias("b"))
    return best.select(
        F.col("doc_id").alias(key), F.col("item_id").alias(item_key), F.col("b.score").alias("score"),
        (-F.col("b.s")).alias("start_word"), F.col("b.e").alias("end_word"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark item in them, with all their columns.

    Ids may repeat or be null: a row is told by its id and a digest of its text, so a clean row stays whatever shares its id.
    """
    digest, chars = F.xxhash64(F.col(text)), F.length(F.col(text))
    row = F.struct(F.col(key).alias("k"), digest.alias("d"), chars.alias("n"))
    bad = contaminated(docs.select(row.alias("row"), F.col(text).alias("text")), benchmark, "row", "text", **options)
    id_, d, n = tb.unused(docs, "_k", "_d", "_n")
    bad = bad.select(F.col("row.k").alias(id_), F.col("row.d").alias(d), F.col("row.n").alias(n)).distinct()
    same = F.col(key).eqNullSafe(F.col(id_)) & (digest == F.col(d)) & chars.eqNullSafe(F.col(n))
    return docs.join(small_side(bad), same, "left_anti")

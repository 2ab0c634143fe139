"""Exact Jaccard join of word-shingle sets by a grouped prefix join, down to connected components.

Order the shingles of every set by how rare they are in the whole table. Two sets with a Jaccard of at least ``num/den``
share one of their first n - ceil(n * num / den) + 1 shingles (their prefixes). The steps:

1. Count in how many documents each shingle occurs: sorted blocks of distinct shingles per task, merged per hash range.
   The result is two bit arrays of fixed size (occurs twice or more, occurs often). They only order the shingles; a shared
   bit makes an order less good, never a result wrong. A shingle without a bit occurs once and can match nothing.
2. Documents with the same set are one class; classes with the same prefix and size are one group. Only prefix shingles
   that occur elsewhere are posted, once per group.
3. Round one: each group meets one group it shares a prefix shingle with, the one with the smallest share of shingles
   of its own, and the classes of a group meet its
   first class. The pairs are expanded to classes, verified exactly, and give components.
4. Round two: prefix shingles whose groups are not all in one component yet. Groups outside the main component of a
   shingle meet all groups of that shingle in other components, if size and position allow the similarity. Pairs inside
   a component need no test, so a large group of near copies costs a pass and not the square of its size.

Every pair that can reach the similarity is verified or already connected, whatever the frequency of a shingle.

Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than ``n`` is one shingle of all its
words; without words the set is empty and links with nothing. Null ids are kept and count as largest. Rows that repeat an
id are rows of their own. Sets are told apart by 64 bits of a digest. An empty table gives an empty result. Columns other
than id and text do not take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm import textbatch as tb
from ionloom.llm.components import components
from ionloom.session import cut_lineage, small_side

N = 5
NUM, DEN = 75, 100
FILTER_BITS = 27
OFTEN = 64
#: Shingles a task gathers before it sorts and emits them.
GATHERED = 3_000_000


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for part in tb.slices(column):
        hashes, offsets = tb.lower_word_hashes(part)
        made, place = tb.shingle_hashes(hashes, offsets, n)
        for a, b in zip(place[:-1], place[1:]):
            one = np.sort(made[a:b])
            if len(one) > 1:
                one = one[np.concatenate([[True], one[1:] != one[:-1]])]
            yield one


def _pack(keys: np.ndarray, counts: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Sorted keys of 48 bits as byte planes of their gaps, and saturated counts, in one frame."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = gaps.view(np.uint8).reshape(-1, 8)[:, :6].T
    return press.compress(np.ascontiguousarray(planes).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes())


def _unpack(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    n = len(raw) // 7
    cells = np.zeros((n, 8), np.uint8)
    cells[:, :6] = raw[: 6 * n].reshape(6, n).T
    return np.cumsum(cells.view(np.uint64).ravel()), raw[6 * n :]


def frequency_bits(docs: DataFrame, text: str = "text", n: int = N, bits: int = FILTER_BITS, often: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """Bit arrays by the top bits of a shingle hash: occurs in two documents or more, occurs in ``often`` or more."""
    rows = docs.count()
    ranges = min(max(8, (rows // 1000).bit_length()), 20)  # log2 of the hash ranges; a range stays small enough for a task

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_content_size=True)
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            flat = np.concatenate(held)
            held.clear()  # the gathered sets and the sorted copy are not held at once
            flat >>= np.uint64(16)
            flat.sort()
            cuts = np.searchsorted(flat, np.arange(1, 1 << ranges, dtype=np.uint64) << np.uint64(48 - ranges))
            frames, owner = [], []
            for r, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(flat)])):
                if a < b:  # keys and counts are made for one range at a time
                    part = flat[a:b]
                    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    frames.append(_pack(part[first], np.diff(np.append(first, b - a)), press))
                    owner.append(r)
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.array(frames, pa.binary())], names=["range", "frame"])

        for batch in tb.lean(batches):
            for one in _sets(batch.column(0), n):
                held.append(one)
                size += len(one)
                if size >= GATHERED:
                    yield emit()
                    size = 0
        if size:
            yield emit()

    width = 1 << (bits - ranges)

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(f) for f in table.column("frame").to_pylist()]
        keys = np.concatenate([k for k, _ in parts])
        counts = np.concatenate([c for _, c in parts]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts, first)
        spot = ((keys[first] >> np.uint64(48 - bits)) & np.uint64(width - 1)).astype(np.int64)
        out = []
        for least in (2, often):
            flags = np.zeros(width, np.uint8)
            flags[spot[total >= least]] = 1
            out.append(zstandard.compress(np.packbits(flags).tobytes(), 1))
        return pa.table({"range": table.column("range").slice(0, 1), "two": pa.array([out[0]]), "many": pa.array([out[1]])})

    found = docs.select(text).mapInArrow(gather, "range int, frame binary").groupBy("range").applyInArrow(merge, "range int, two binary, many binary")
    page = max(1, width // 8)
    two, many = np.zeros(page << ranges, np.uint8), np.zeros(page << ranges, np.uint8)
    for row in found.collect():  # two arrays of 2^bits bits in all, however many documents there are
        for target, frame in ((two, row.two), (many, row.many)):
            target[row.range * page : (row.range + 1) * page] = np.frombuffer(zstandard.decompress(frame), np.uint8)
    return two, many


def prefix_sets(docs: DataFrame, two: np.ndarray, many: np.ndarray, key: str = "doc_id", text: str = "text", n: int = N, num: int = NUM, den: int = DEN, bits: int = FILTER_BITS) -> DataFrame:
    """Per document: id, n (set size), cls (class), grp (group of equal prefix and size), at (position of the first posted
    shingle), posted (prefix shingles that may occur elsewhere), members (packed set, null when nothing is posted)."""
    shared = docs.sparkSession.sparkContext.broadcast((zstandard.compress(two.tobytes(), 1), zstandard.compress(many.tobytes(), 1)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in shared.value]
        for batch in tb.lean(batches):
            sizes, classes, groups, at, posted, members = [], [], [], [], [], []
            for one in _sets(batch.column(1), n):
                size = len(one)
                spot = (one >> np.uint64(64 - bits)).astype(np.int64)
                level = sum(((t[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1).astype(np.int8) for t in tables) if size else np.zeros(0, np.int8)
                first = size - (size * num + den - 1) // den + 1 if size else 0
                order = np.argsort(level, kind="stable")[:first]  # by level, then by hash
                lone = int((level[order] == 0).sum())
                whole = hashlib.blake2b(one.tobytes(), digest_size=8).digest()
                sizes.append(size)
                classes.append(int.from_bytes(whole, "little", signed=True))
                groups.append(int.from_bytes(hashlib.blake2b(one[order].tobytes() + size.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True))
                at.append(lone)
                posted.append(one[order[lone:]].view(np.int64))
                members.append(one.tobytes() if lone < first else None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(groups, pa.int64()),
                pa.array(at, pa.int32()), pa.array(posted, pa.list_(pa.int64())), pa.array(members, pa.binary()),
            ], names=["id", "n", "cls", "grp", "at", "posted", "members"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        build, f"id {kind}, n long, cls long, grp long, at int, posted array<bigint>, members binary"
    )


def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the intersection of two packed sorted sets."""
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        both.sort(kind="stable")  # two sorted runs are merged
        out.append(int((both[1:] == both[:-1]).sum()))
    return pa.array(out, pa.int32())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Class pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("i", F.arrow_udf(overlap, "int")("ma", "mb"))
    return both.where(F.col("i") * den >= (F.col("na") + F.col("nb") - F.col("i")) * num).select("a", "b")


def possible(n1: str, n2: str, at1: str, at2: str, num: int, den: int):
    """Whether two groups may reach the similarity if this is the first prefix shingle they share."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    most = F.least(F.col(n1) - F.col(at1), F.col(n2) - F.col(at2))
    return (small * den >= large * num) & (most * den >= (F.col(n1) + F.col(n2) - most) * num)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id that links reach)."""
    tb.small_batches(docs.sparkSession)
    two, many = frequency_bits(docs, text, n)
    found = cut_lineage(prefix_sets(docs, two, many, key, text, n, num, den))
    linked = found.where(F.col("members").isNotNull())
    classes = cut_lineage(linked.groupBy("cls").agg(
        F.min("id").alias("first_id"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("at").alias("at"),
        F.first("posted").alias("posted"), F.first("members").alias("members"),
    ))
    sets = classes.select("cls", "n", "members")
    groups = classes.groupBy("grp").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("at").alias("at"), F.first("posted").alias("posted"))
    # the share of shingles that occur nowhere else; the original of many edited copies has the smallest
    own = (F.col("at") / F.col("n")).alias("own")
    postings = groups.select("grp", "n", own, F.posexplode("posted").alias("p", "token"), "at").select(
        "grp", "n", "own", "token", (F.col("p") + F.col("at")).alias("at")
    )
    postings = cut_lineage(postings)
    buckets = postings.groupBy("token").agg(F.min(F.struct("own", "grp")).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    buckets = cut_lineage(buckets)

    # round one
    stars = postings.join(buckets.select("token", "hub"), "token").where("grp <> hub.grp").groupBy("grp").agg(F.min("hub").alias("hub")).select("grp", F.col("hub.grp").alias("hub"))
    leads = cut_lineage(groups.select("grp", "lead", "size"))
    star_pairs = stars.join(leads.select("grp", F.col("lead").alias("a")), "grp").join(
        leads.select(F.col("grp").alias("hub"), F.col("lead").alias("b")), "hub"
    ).select("a", "b")
    inner = classes.select("cls", "grp").join(leads.where("size > 1"), "grp").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b"))
    edges = cut_lineage(verified(star_pairs.unionByName(inner), sets, num, den))
    comps = components(edges)

    # round two: what shares a shingle and is not connected yet
    placed = cut_lineage(classes.select("cls", "grp").join(comps, F.col("cls") == F.col("node"), "left").select("cls", "grp", F.coalesce("comp", "cls").alias("comp")))
    spans = placed.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = cut_lineage(postings.join(buckets.select("token"), "token", "left_semi").join(spans, "grp"))
    open_tokens = rows.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("token")
    main = rows.groupBy("token", "low").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.max(F.struct("c", "low")).alias("m")).select("token", F.col("m.low").alias("main"))
    marked = cut_lineage(open_tokens.join(main, "token"))
    live = cut_lineage(rows.join(marked, "token"))
    outside = live.where("low <> high or low <> main").select("token", F.col("grp").alias("g1"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("low").alias("l1"), F.col("high").alias("h1"))
    others = live.select("token", F.col("grp").alias("g2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    near = outside.join(others, "token").where(
        (F.col("g1") != F.col("g2")) & ~((F.col("l1") == F.col("h1")) & (F.col("l2") == F.col("h2")) & (F.col("l1") == F.col("l2")))
        & possible("n1", "n2", "at1", "at2", num, den)
    ).select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"))
    mixed = spans.where("low <> high").select(F.col("grp").alias("g1"), F.col("grp").alias("g2"))
    group_pairs = cut_lineage(near.unionByName(mixed).distinct())
    pairs = group_pairs.join(placed.select(F.col("grp").alias("g1"), F.col("cls").alias("a"), F.col("comp").alias("ca")), "g1").join(
        placed.select(F.col("grp").alias("g2"), F.col("cls").alias("b"), F.col("comp").alias("cb")), "g2"
    ).where((F.col("ca") != F.col("cb")) & ((F.col("g1") < F.col("g2")) | (F.col("a") < F.col("b")))).select("a", "b")
    pairs = cut_lineage(pairs)
    more = verified(pairs, sets, num, den)
    comps = components(edges.unionByName(more))

    # back to documents: only classes with several rows or links differ from their own id
    ends = classes.select("cls", "first_id").join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    ends = cut_lineage(ends.select("cls", "first_id", "comp"))
    heads = ends.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = cut_lineage(ends.join(heads, "comp").select(F.col("cls").alias("_c"), "component_id"))
    return found.select("id", "n", F.when(F.col("members").isNotNull(), F.col("cls")).alias("cls")).join(
        named, F.col("cls") == F.col("_c"), "left"
    ).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, null ids last.

    Ids may repeat or be null: a row is told by its id and a digest of its text, and of rows that repeat both one stays.
    """
    digest, chars = F.xxhash64(F.col(text)), F.length(F.col(text))
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), digest.alias("d"), chars.alias("n"))
    found = near_duplicates(docs.select(row.alias("row"), F.col(text).alias("text")), "row", "text", **options)
    marked = found.groupBy("row").agg(
        F.max(F.col("row").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("copies")
    ).where("NOT stays OR copies > 1")
    marked = cut_lineage(marked.select(F.col("row.k").alias("_k"), F.col("row.d").alias("_d"), F.col("row.n").alias("_n"), "stays"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(key).alias("_key"), digest.alias("_digest"), chars.alias("_chars"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_digest") == F.col("_d")) & F.col("_chars").eqNullSafe(F.col("_n"))
    kept = rows.join(small_side(marked.drop("stays")), same, "left_anti").select("_row.*")
    repeated = marked.where("stays").drop("stays")
    if not repeated.limit(1).count():
        return kept
    again = rows.join(small_side(repeated), same, "left_semi").groupBy("_key", "_digest", "_chars").agg(F.first("_row").alias("_row"))
    return kept.unionByName(again.select("_row.*"))

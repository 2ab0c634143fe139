"""Compression of vectors to one small code per part, with a search tree over the entries of each codebook.

Every component x becomes floor(scale * x). A vector is cut into equal consecutive parts; each part position has a codebook
of integer entries, refined by rounds of assignment and componentwise floor means. All arithmetic that decides anything is on
integers, so results do not depend on partitions, order or retries.

The nearest entry is found with a GNAT (geometric near-neighbour access tree). A node holds a few split points; every other
entry belongs to its nearest split point, and for each split point and each child the node keeps the range of distances
between them. A query's distance to a split point, widened by the best distance so far, rules a child out when it lies wholly
outside that range. Ranges are rounded outwards and the test is strict, so an entry that ties with the best is always
seen; survivors are compared by their exact squared distance and then by index.

On Spark: the kept integers are written once; a round is one pass over them in which each task sums its parts by entry, and one
aggregate of at most parts * entries rows per task. Codebooks (parts * entries * width numbers) travel to the tasks; nothing
else does.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are left out, and so are vectors of
another length than ``dim`` (by default the commonest one, the greater of equally common) and of lengths that the parts
don't divide. Components beyond +-2^27 / scale count as that bound. Null keys are kept and come last where keys are ordered;
rows that repeat a key, or key and vector, are rows of their own, ordered by vector among equal keys. Fewer rows than entries
give a shorter codebook; an empty table gives an empty result. Other columns do not take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.llm.vectors import down, finite, group_sums, matrix, one_length, plain_products, squared_gaps, up, whole_components
from ionloom.session import cut_lineage, small_side

#: Split points of a node, and entries up to which a node is not split.
FAN, LEAF = 8, 64


class _Node:
    def __init__(self, entries: np.ndarray, rows: np.ndarray, fan: int, leaf: int):
        self.rows, self.children = rows, None
        if len(rows) <= leaf:
            return
        here = entries[rows]
        chosen = [0]
        gap = squared_gaps(here, here[:1])[:, 0]
        while len(chosen) < fan and gap.max() > 0:  # each next split point is the one farthest from those before
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, squared_gaps(here, here[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return
        to_split = squared_gaps(here, here[chosen])
        own = to_split.argmin(axis=1)
        rest = np.ones(len(rows), bool)
        rest[chosen] = False
        self.rows = rows[chosen]
        self.low = np.full((len(chosen), len(chosen)), np.inf)
        self.high = np.full((len(chosen), len(chosen)), -np.inf)
        self.children = []
        for j in range(len(chosen)):
            inside = rest & (own == j)
            if inside.any():
                self.low[:, j] = down(to_split[inside].min(axis=0))
                self.high[:, j] = up(to_split[inside].max(axis=0))
            self.children.append(_Node(entries, rows[inside], fan, leaf) if inside.any() else None)


class Gnat:
    """Nearest entry of a set of integer vectors; ties go to the lower index."""

    def __init__(self, entries: np.ndarray, fan: int = FAN, leaf: int = LEAF):
        self.entries = np.asarray(entries, np.int64)
        self.root = _Node(self.entries, np.arange(len(entries)), fan, leaf)
        #: distances worked out so far, against len(queries) * len(entries) without a tree
        self.measured = 0

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each query."""
        self.plain = plain_products(queries, self.entries)
        kind = float if self.plain else np.int64
        own, queries = self.entries.astype(kind), queries.astype(kind)
        self.squares, squares = (own * own).sum(axis=1), (queries * queries).sum(axis=1)
        self.points = own
        best = np.full(len(queries), np.iinfo(np.int64).max, kind)
        index = np.full(len(queries), len(self.entries), np.int64)
        self._visit(self.root, queries, squares, np.arange(len(queries)), best, index)
        return index, best.astype(np.int64)

    def _gaps(self, queries, squares, entries):
        """Squared distances; as doubles they are whole numbers below 2^53 and as exact as integers."""
        self.measured += len(queries) * len(entries)
        if self.plain:
            return squares[:, None] + self.squares[entries][None] - 2 * (queries @ self.points[entries].T)
        return squared_gaps(queries, self.points[entries])

    def _visit(self, node, queries, squares, rows, best, index):
        gaps = self._gaps(queries[rows], squares[rows], node.rows)
        least = gaps.min(axis=1)
        # the lowest index among the nearest ones of this node
        first = np.where(gaps == least[:, None], node.rows[None, :], len(self.entries)).min(axis=1)
        better = (least < best[rows]) | ((least == best[rows]) & (first < index[rows]))
        best[rows[better]] = least[better]
        index[rows[better]] = first[better]
        if node.children is None:
            return
        nearest_first = gaps.argsort(axis=1, kind="stable")
        low, high = down(gaps), up(gaps)
        for turn in range(len(node.children)):
            turn_of = nearest_first[:, turn]
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                mine = np.flatnonzero(turn_of == j)
                if not len(mine):
                    continue
                reach = up(best[rows[mine]])[:, None]
                out = (low[mine] - reach > node.high[:, j]) | (high[mine] + reach < node.low[:, j])
                mine = mine[~out.any(axis=1)]
                if len(mine):
                    self._visit(child, queries, squares, rows[mine], best, index)


def codebook_digest(books: list[np.ndarray]) -> str:
    """Lowercase hex sha256 of all components by part, entry and position, decimal, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int, parts: int,
                  dim: int | None) -> tuple[DataFrame, int | None]:
    """(key, label, ints) of the rows that count, written once, and the common length."""
    rows = vectors.select(
        F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") if label else F.lit(None).cast("int")).alias("label"),
        F.col(f"`{vector}`").alias("v"),
    ).where(finite(F.col("v"))).where((F.size("v") > 0) & (F.size("v") % parts == 0))
    dim = one_length(rows, "v", dim)
    rows = rows.where(F.size("v") == (dim or 0))
    return cut_lineage(rows.select("key", "label", whole_components(F.col("v"), scale).alias("ints"))), dim


def fit_codebooks(kept: DataFrame, dim: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """Codebooks of the parts: the first ``entries`` rows by key, then ``rounds`` of assignment and floor means.

    ``entries`` * ``dim`` numbers are held on the driver. An entry that no part is nearest to stays.
    """
    width = dim // parts
    first = kept.orderBy(F.asc_nulls_last("key"), "ints").limit(entries).select("ints").collect()
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), dim)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        def totals(batches, books=books):
            trees = [Gnat(b) for b in books]
            sums = [np.zeros((len(b), width), np.int64) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                ints = matrix(batch.column("ints"), dim)
                for p, tree in enumerate(trees):
                    piece = ints[:, p * width : (p + 1) * width]
                    at, n, total = group_sums(tree.nearest(piece)[0], piece)
                    sums[p][at] += total
                    counts[p][at] += n
            for p in range(parts):
                used = np.flatnonzero(counts[p])
                yield pa.record_batch({
                    "part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)),
                    "n": pa.array(counts[p][used]), "sums": pa.array(list(sums[p][used]), pa.list_(pa.int64())),
                })

        summed = kept.select("ints").mapInArrow(totals, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
        )
        books = [b.copy() for b in books]
        for row in summed.collect():  # at most parts * entries rows
            books[row["part"]][row["entry"]] = [s // row["n"] for s in row["sums"]]
    return books


def encode(kept: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(key, label, code, error) of every row: two hex digits per part (more for larger codebooks), squared distances summed."""
    parts, width = len(books), dim // len(books)
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    def code(batches):
        trees = [Gnat(b) for b in books]
        names = np.array([f"{i:0{digits}x}" for i in range(len(books[0]))], object)
        for batch in batches:
            ints = matrix(batch.column("ints"), dim)
            text, error = np.full(len(ints), "", object), np.zeros(len(ints), np.int64)
            for p, tree in enumerate(trees):
                at, gap = tree.nearest(ints[:, p * width : (p + 1) * width])
                text += names[at]
                error += gap
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                names=["key", "label", "code", "error"],
            )

    kinds = [kept.schema["key"], kept.schema["label"]]
    return kept.mapInArrow(code, T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = 1024,
             parts: int = 4, entries: int = 256, rounds: int = 4, dim: int | None = None) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every vector that counts."""
    kept, dim = whole_vectors(vectors, key, vector, label, scale, parts, dim)
    if dim is None or not kept.limit(1).count():
        kind = vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books = fit_codebooks(kept, dim, parts, entries, rounds)
    coded = cut_lineage(encode(kept, books, dim))
    by_label = small_side(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_l"))).select(
        F.col("key").alias(key), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")
    )

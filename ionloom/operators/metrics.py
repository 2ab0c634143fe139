"""How well a picture preserves the spectra: distances of sampled pairs, rank scores, neighbourhood scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import color as C
from ionloom.functions import spectrum as S
from ionloom.functions.order_stats import exact_quantiles, ordered_position
from ionloom.operators.neighbors import distance_matrix, knn, stack
from ionloom.operators.normalize import stack_channels
from ionloom.operators.peaks import rank_average
from ionloom.operators.sampling import random_sample
from ionloom.session import bounded_rows, cut_lineage, dealt, small_side

MEASURES = ["cosine", "maxabs", "output"]
DELTAS = (0.1, 0.2, 0.3)
GAMMAS = (0.0, 2.0)


def _pair_sides(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        own = values.select("region", F.col("pixel_id").alias(f"pixel_{side}"), F.col(column).alias(f"_{side}"))
        pairs = pairs.join(own, ["region", f"pixel_{side}"])
    return pairs


def spectra_distances(pairs: DataFrame, spectra: DataFrame) -> DataFrame:
    """L2, cosine and maximum distance of the spectra of each pair: the half of the scores that no picture changes."""
    a, b = F.col("_a"), F.col("_b")
    return cut_lineage(_pair_sides(pairs, spectra, "spectrum").select(
        "region", "pair", "pixel_a", "pixel_b",
        S.l2_distance(a, b).alias("l2"), S.cosine_distance(a, b).alias("cosine"), S.chebyshev_distance(a, b).alias("maxabs"),
    ))


def pair_distances(pairs: DataFrame, spectra: DataFrame, image: DataFrame) -> DataFrame:
    """L2, cosine and maximum distance of the spectra, L2 in LAB of the picture (c0, c1, c2) for each pair.

    ``pairs`` may be the result of ``spectra_distances`` already. Written out once: the sampled pairs are few and every
    score reads them several times.
    """
    known = pairs if "l2" in pairs.columns else spectra_distances(pairs, spectra)
    lightness, a, b = C.lab_to_byte(*C.rgb_to_lab(F.col("c0"), F.col("c1"), F.col("c2")))
    lab = image.select("region", "pixel_id", F.array(lightness, a, b).alias("lab"))
    return cut_lineage(_pair_sides(known, lab, "lab").select(
        "region", "pair", "pixel_a", "pixel_b", "l2", "cosine", "maxabs", S.l2_distance(F.col("_a"), F.col("_b")).alias("output"),
    ))


def pair_ranks(distances: DataFrame) -> DataFrame:
    """0-based ranks over all pairs of a region: cosine, max of cosine and L-infinity, output."""
    tall = stack_channels(distances, ["region", "pair"], MEASURES)
    ranked = ordered_position(tall, ["region", "ch"], "level", "pair", "_rank")
    wide = _spread(ranked, "_rank").select(
        "region", "pair", F.col("cosine").alias("cosine_rank"), F.col("maxabs").alias("maxabs_rank"),
        F.col("output").alias("result_rank"),
    )
    return distances.join(wide, ["region", "pair"]).withColumn("max_rank", F.greatest("cosine_rank", "maxabs_rank"))


def _spread(tall: DataFrame, value: str) -> DataFrame:
    return tall.groupBy("region", "pair").agg(*[F.max(F.when(F.col("ch") == m, F.col(value))).alias(m) for m in MEASURES])


def _share(hit, weight):
    """Weighted share; 0 when all weights are 0 (a single pair)."""
    return F.coalesce(F.try_divide(F.sum(F.when(hit, weight).otherwise(0.0)), F.sum(weight)), F.lit(0.0))


def saliency_smoothness(distances: DataFrame) -> DataFrame:
    """The 16 saliency and smoothness scores per region, as (region, metric, value)."""
    ranked = pair_ranks(distances)
    sizes = ranked.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(small_side(sizes), "region")
    n, top, own, cos = F.col("_n"), F.col("max_rank"), F.col("result_rank"), F.col("cosine_rank")
    columns, names = [], []
    for gamma in GAMMAS:
        g = int(gamma)
        for delta in DELTAS:
            d = int(delta * 100)
            columns.append(_share(own - top + n * delta > 0, F.pow(top.cast("double"), F.lit(gamma))).alias(f"saliency_{d}_g{g}"))
            columns.append(
                _share(cos - own - n * delta < 0, F.pow((n - cos).cast("double"), F.lit(gamma))).alias(f"smoothness_{d}_g{g}")
            )
            names += [f"saliency_{d}_g{g}", f"smoothness_{d}_g{g}"]
    wide = ranked.groupBy("region").agg(*columns)
    for gamma in GAMMAS:
        for kind in ("saliency", "smoothness"):
            name = f"avg_{kind}_g{int(gamma)}"
            wide = wide.withColumn(name, sum(F.col(f"{kind}_{int(d * 100)}_g{int(gamma)}") for d in DELTAS) / 3)
            names.append(name)
    return wide.unpivot("region", names, "metric", "value")


def pearson(distances: DataFrame) -> DataFrame:
    return distances.groupBy("region").agg(
        F.corr("cosine", "output").alias("pearson_cosine"), F.corr("maxabs", "output").alias("pearson_maxabs")
    )


def spearman(distances: DataFrame) -> DataFrame:
    tall = stack_channels(distances, ["region", "pair"], MEASURES)
    ranked = _spread(rank_average(tall, ["region", "ch"], "level", "_rank"), "_rank")
    return ranked.groupBy("region").agg(
        F.corr("cosine", "output").alias("spearman_cosine"), F.corr("maxabs", "output").alias("spearman_maxabs")
    )


def rank_error_scatter(distances: DataFrame) -> DataFrame:
    return pair_ranks(distances).select(
        "region", "pair", "cosine", "maxabs", F.abs(F.col("result_rank") - F.col("max_rank")).alias("rank_error")
    )


def correlation_curve(distances: DataFrame, metric: str = "cosine") -> DataFrame:
    """Pearson correlation over the pairs below each decile of the input distance, and below the maximum.

    The ten limits of a region travel as one array, so the pairs are read once and never multiplied by a join.
    """
    placed = ordered_position(distances, ["region"], metric, "pair", "_pos")
    sizes = distances.groupBy("region").agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.floor(F.col("_n") / 10).cast("int"), F.lit(1))
    marks = sizes.withColumn(
        "_at", F.explode(F.array_distinct(F.concat(
            F.filter(F.sequence(step, F.greatest(F.col("_n").cast("int") - 1, step), step), lambda i: i < F.col("_n")),
            F.array(F.col("_n").cast("int") - 1),
        )))
    )
    limits = placed.select("region", F.col("_pos").cast("int").alias("_at"), F.col(metric).alias("limit")).join(
        marks, ["region", "_at"]
    ).groupBy("region").agg(F.collect_list(F.struct("_at", "limit", "_n")).alias("_limits"))
    spread = distances.join(small_side(limits), "region").withColumn("_e", F.explode("_limits")).where(
        F.col(metric) < F.col("_e.limit")
    )
    return spread.groupBy(
        "region", F.floor(F.col("_e._at") * 100 / F.col("_e._n")).cast("int").alias("percent")
    ).agg(F.corr(metric, "output").alias("correlation"))


def metric_sample(spectra: DataFrame, points: int | None = None, seed: int = 0) -> DataFrame:
    """All foreground pixels, or ``points`` of each region when given: the same rule for regions of any size."""
    inside = spectra.where(S.is_foreground(F.col("spectrum")))
    return inside if points is None else random_sample(inside, points, seed).drop("sample_index")


#: Pixels of a region up to which one task ranks all its pairs; its rows of distances are worked out in pieces.
PIXELS_IN_TASK = 4096
#: Pixels of a block of a larger region; a task holds two blocks.
RANK_BLOCK = 1024
_RANKS = "region int, i long, j long, rank_in long, rank_out long, n long"
SPACES = ("spectrum", "out")


def neighbour_ranks(sample: DataFrame, k: int, metrics: tuple[str, str] = ("euclidean", "euclidean")) -> DataFrame:
    """For each sampled pixel its neighbours within k in either space, with the rank in both.

    sample(region, pixel_id, spectrum, out ARRAY). A pixel itself has rank 0; equal distances rank by id. A region of up to
    ``PIXELS_IN_TASK`` pixels is ranked by one task, a larger one by counting: see ``_counted_ranks``.
    """
    rows = sample.select("region", "pixel_id", *SPACES)
    sizes = small_side(rows.groupBy("region").agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.where(F.col("_n") > PIXELS_IN_TASK)

    def rank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pixel_id")
        ids, n = pdf["pixel_id"].to_numpy(), len(pdf)
        values = [stack(pdf[c]) for c in SPACES]
        found = []
        for low in range(0, n, 256):
            own = np.arange(low, min(low + 256, n))
            position = []
            for x, metric in zip(values, metrics):
                gap = distance_matrix(x, x[own], metric).T
                gap[np.arange(len(own)), own] = -1.0
                order = np.argsort(gap, axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
                position.append(place)
            near = np.minimum(*position) <= k
            near[np.arange(len(own)), own] = False
            i, j = np.nonzero(near)
            found.append(pd.DataFrame({
                "region": pdf["region"].iloc[0], "i": ids[own[i]], "j": ids[j], "rank_in": position[0][i, j],
                "rank_out": position[1][i, j], "n": n,
            }))
        return pd.concat(found)

    small = dealt(rows.join(large, "region", "left_anti"), "region").groupBy("region").applyInPandas(rank, _RANKS)
    if not large.limit(1).count():
        return small
    return small.unionByName(_counted_ranks(rows.join(large, "region"), k, metrics))


def _counted_ranks(rows: DataFrame, k: int, metrics: tuple[str, str]) -> DataFrame:
    """The same rows for regions of any size: rows(region, pixel_id, spectrum, out, _n).

    1. The k nearest pixels in either space, exactly.
    2. A neighbour in one space needs its rank in the other: blocks of pixels meet and measure these distances.
    3. Blocks meet again and count, for each pixel and each of its at most k such distances per space, how many pixels of the
       other block are nearer. Spark adds the counts up. No row holds more than k distances, whatever the region's size.
    """
    rows = cut_lineage(rows.withColumn("_parts", F.ceil(F.col("_n") / RANK_BLOCK).cast("int")))
    near = None
    for space, column, metric in zip((0, 1), SPACES, metrics):
        one = knn(rows.select("region", "pixel_id", F.col(column).alias("vector")), k, metric).select(
            "region", "i", "j", F.lit(space).alias("space"), F.col("rank").cast("long").alias("rank")
        )
        near = one if near is None else near.unionByName(one)
    both = near.groupBy("region", "i", "j").agg(*[F.max(F.when(F.col("space") == s, F.col("rank"))).alias(f"r{s}") for s in (0, 1)])
    both = cut_lineage(both)
    open_ = both.where("r0 IS NULL OR r1 IS NULL").select("region", "i", "j", F.when(F.col("r0").isNull(), 0).otherwise(1).alias("space"))
    asked = open_.groupBy("region", F.col("i").alias("pixel_id")).agg(
        *[F.collect_list(F.when(F.col("space") == s, F.col("j"))).alias(f"j{s}") for s in (0, 1)]
    )
    ids = [f"j{s}" for s in (0, 1)]
    gaps = cut_lineage(_block_pairs(rows, asked, ids, _measure(metrics), "region int, i long, j long, space int, gap double"))
    limits = gaps.groupBy("region", F.col("i").alias("pixel_id")).agg(*[
        F.sort_array(F.collect_list(F.when(F.col("space") == s, F.struct("gap", "j")))).alias(f"t{s}") for s in (0, 1)
    ]).select("region", "pixel_id", *[F.col(f"t{s}.{c}").alias(f"{c}{s}") for s in (0, 1) for c in ("gap", "j")])
    counted = _block_pairs(
        rows, limits, [f"{c}{s}" for s in (0, 1) for c in ("gap", "j")], _count(metrics), "region int, i long, j array<long>, space int, nearer array<int>"
    ).select("region", "i", "space", F.explode(F.arrays_zip("j", "nearer")).alias("e")).groupBy("region", "i", F.col("e.j").alias("j")).agg(
        F.max("space").alias("space"), (F.sum("e.nearer") + 1).alias("rank")
    )
    sizes = small_side(rows.select("region", F.col("_n").alias("n")).distinct())
    return both.join(counted, ["region", "i", "j"], "left").join(sizes, "region").select(
        "region", "i", "j", F.coalesce("r0", "rank").alias("rank_in"), F.coalesce("r1", "rank").alias("rank_out"), "n"
    )


def _block_pairs(rows: DataFrame, asked: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """Apply ``work(queries, data)`` to each pair of blocks; queries carry the columns of ``asked``."""
    blocked = rows.withColumn("_blk", F.pmod(F.xxhash64("pixel_id"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    names = ["region", "pixel_id", *SPACES]
    queries = blocked.join(asked, ["region", "pixel_id"]).select(*names, *columns, F.col("_blk").alias("q"), every.alias("d"), F.lit(0).alias("role"))
    data = blocked.select(*names, every.alias("q"), F.col("_blk").alias("d"), F.lit(1).alias("role"))
    empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1].sort_values("pixel_id")
        return work(q, d) if len(q) and len(d) else empty

    return queries.unionByName(data, allowMissingColumns=True).groupBy("region", "q", "d").applyInPandas(meet, schema)


def _measure(metrics):
    def work(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        ids, found = d["pixel_id"].to_numpy(), []
        for space, (column, metric) in enumerate(zip(SPACES, metrics)):
            wanted = q[f"j{space}"].to_numpy()
            row = np.repeat(np.arange(len(q)), [len(w) for w in wanted])
            j = np.concatenate([np.asarray(w, np.int64) for w in wanted])
            at = np.minimum(np.searchsorted(ids, j), len(ids) - 1)
            here = ids[at] == j
            gap = distance_matrix(stack(q[column]), stack(d[column]), metric)
            found.append(pd.DataFrame({
                "region": q["region"].iloc[0], "i": q["pixel_id"].to_numpy()[row[here]], "j": j[here], "space": space, "gap": gap[row[here], at[here]],
            }))
        return pd.concat(found)

    return work


def _count(metrics):
    def work(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        ids, out = d["pixel_id"].to_numpy(), []
        for space, (column, metric) in enumerate(zip(SPACES, metrics)):
            gap = distance_matrix(stack(q[column]), stack(d[column]), metric)
            for i, own, limit, j in zip(q["pixel_id"], gap, q[f"gap{space}"], q[f"j{space}"]):
                if not len(limit):
                    continue
                limit, j = np.asarray(limit, float), np.asarray(j, np.int64)
                order = np.argsort(own, kind="stable")
                order = order[ids[order] != i]
                sorted_gap, sorted_id = own[order], ids[order]  # by distance, then id
                nearer = np.searchsorted(sorted_gap, limit, "left")
                for t in np.flatnonzero(np.searchsorted(sorted_gap, limit, "right") > nearer):  # equal distances: by id
                    same = slice(nearer[t], np.searchsorted(sorted_gap, limit[t], "right"))
                    nearer[t] += np.searchsorted(sorted_id[same], j[t], "left")
                out.append((i, j, space, nearer.astype(np.int32)))
        return pd.DataFrame(out, columns=["i", "j", "space", "nearer"]).assign(region=q["region"].iloc[0])[["region", "i", "j", "space", "nearer"]]

    return work


def _trustworthiness(k: int) -> list:
    n = F.max("n")
    beyond = F.sum(F.when((F.col("rank_out") <= k) & (F.col("rank_in") > k), F.col("rank_in") - k).otherwise(0))
    return [(1 - F.try_divide(beyond * 2.0, n * k * (2 * n - 3 * k - 1))).alias("trustworthiness")]


def _mrre(k: int) -> list:
    n = F.max("n")
    steps = F.sequence(F.lit(1), F.lit(k))
    norm = F.first(F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.abs(F.col("n") - i * 2.0 + 1) / i))
    gap = F.abs(F.col("rank_in") - F.col("rank_out"))
    false = F.sum(F.when(F.col("rank_out") <= k, gap / F.col("rank_in")).otherwise(0.0))
    missing = F.sum(F.when(F.col("rank_in") <= k, gap / F.col("rank_out")).otherwise(0.0))
    return [(1 - F.try_divide(false, norm * n)).alias("mrre_false"), (1 - F.try_divide(missing, norm * n)).alias("mrre_missing")]


def _lcmc(k: int) -> list:
    n = F.max("n")
    common = F.sum(((F.col("rank_in") <= k) & (F.col("rank_out") <= k)).cast("long"))
    return [(F.try_divide(common, n * k) - F.try_divide(F.lit(float(k)), n - 1)).alias("lcmc")]


def trustworthiness(ranks: DataFrame, k: int) -> DataFrame:
    """1 - 2 / (n k (2n - 3k - 1)) * sum over output neighbours of the input rank beyond k; null where that is undefined."""
    return ranks.groupBy("region").agg(*_trustworthiness(k))


def mrre(ranks: DataFrame, k: int) -> DataFrame:
    """Mean relative rank errors (1 is best): over output neighbours (false) and input neighbours (missing)."""
    return ranks.groupBy("region").agg(*_mrre(k))


def lcmc(ranks: DataFrame, k: int) -> DataFrame:
    """Share of common k nearest neighbours minus its expectation k / (n - 1)."""
    return ranks.groupBy("region").agg(*_lcmc(k))


def neighbour_scores(ranks: DataFrame, k: int) -> DataFrame:
    """``trustworthiness``, ``mrre`` and ``lcmc`` from one pass over the ranks, which need not be written out."""
    return ranks.groupBy("region").agg(*_trustworthiness(k), *_mrre(k), *_lcmc(k))


def outlier_score(spectra: DataFrame, n_reference: int = 100, seed: int = 0) -> DataFrame:
    """Smallest L-infinity distance to the sampled foreground pixels of the region, self excluded, scaled 0..1.

    The sample is at most ``n_reference`` spectra per region; it travels to the pixels of its own region.
    """
    sample = random_sample(spectra, n_reference, seed).where(S.is_foreground(F.col("spectrum")))
    scored = cut_lineage(nearest_reference(spectra, sample.select("region", "pixel_id", "spectrum")))
    high = exact_quantiles(scored, ["region"], "_d", {"hi": 0.999})
    unit = scored.join(small_side(high), "region").withColumn("_d", S.unit_ratio(F.col("_d"), F.col("hi"))).drop("hi")
    low = exact_quantiles(unit, ["region"], "_d", {"lo": 0.0001})
    return unit.join(small_side(low), "region").select(
        "region", "y", "x", "pixel_id", F.greatest(F.col("_d") - F.col("lo"), F.lit(0.0)).alias("score")
    )


MAX_REFERENCE_ROWS = 200_000


def reference_table(sample: DataFrame, column: str = "spectrum") -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """region -> (ids, matrix) of a bounded sample."""
    rows = bounded_rows(sample.select("region", "pixel_id", column).orderBy("region", "pixel_id"),
                        MAX_REFERENCE_ROWS, "reference points")
    grouped: dict[int, list] = {}
    for r in rows:
        grouped.setdefault(r[0], []).append((r[1], r[2]))
    return {
        region: (np.array([i for i, _ in part]), np.array([v for _, v in part], dtype="float64"))
        for region, part in grouped.items()
    }


#: Pixels of a region that meet its reference points in one group; bounds the memory of a Python worker.
GROUP_PIXELS = 2048


def beside_references(spectra: DataFrame, sample: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(pixels, ids, matrix)`` for groups of pixels of one region, with the reference points of that region alone.

    A region's points travel once to each of its groups, so a task holds one group whatever the number of regions.
    ``ids`` ascend and are empty where a region has no reference point.
    """
    pixels = spectra.select(*columns, "spectrum").where(F.col("region").isNotNull())
    groups = small_side(pixels.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / GROUP_PIXELS).alias("_n")))
    dealt = pixels.join(groups, "region").withColumn("_group", F.pmod(F.xxhash64("pixel_id"), F.col("_n"))).drop("_n")
    points = sample.select("region", F.col("pixel_id").alias("_id"), F.col("spectrum").alias("_point")).join(groups, "region").select(
        F.col("region").alias("_near"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_part"), "_id", "_point"
    )

    def meet(part: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        near = near.sort_values("_id", kind="stable", na_position="first")
        return work(part[[*columns, "spectrum"]], near["_id"].to_numpy(), stack(near["_point"]))

    # a fixed number of tasks: by size alone the planner would put most of these small, costly groups in one
    parts = int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = dealt.repartition(parts, "region", "_group").groupBy("region", "_group")
    right = points.repartition(parts, "_near", "_part").groupBy("_near", "_part")
    return left.cogroup(right).applyInPandas(meet, schema)


def nearest_reference(spectra: DataFrame, sample: DataFrame) -> DataFrame:
    def measure(part, ids, matrix):
        if not len(ids) or not len(part):  # no foreground pixel in the sample: nothing is an outlier
            return part.drop(columns="spectrum").assign(_d=0.0)
        gaps = distance_matrix(stack(part["spectrum"]), matrix, "chebyshev")
        gaps[part["pixel_id"].to_numpy()[:, None] == ids[None, :]] = 10000.0
        return part.drop(columns="spectrum").assign(_d=gaps.min(axis=1))

    return beside_references(spectra, sample, ["region", "y", "x", "pixel_id"], measure, "region int, y int, x int, pixel_id long, _d double")


def reference_ranks(spectra: DataFrame, sample: DataFrame) -> DataFrame:
    """Per pixel the ranks of the reference points: ``max_rank`` (of cosine and L-infinity) and ``cosine_rank``.

    Arrays follow the reference ids in ascending order; equal distances are ranked by that order.
    """
    def rank(gaps):
        order = np.argsort(gaps, axis=1, kind="stable")
        out = np.empty(order.shape, np.int32)
        np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int32)[None, :], axis=1)
        return out

    def measure(part, ids, matrix):
        if not len(ids) or not len(part):
            none = [[] for _ in range(len(part))]
            return part.drop(columns="spectrum").assign(cosine_rank=none, max_rank=none)
        values = stack(part["spectrum"])
        cosine = rank(np.round(distance_matrix(values, matrix, "cosine"), 12))
        widest = rank(distance_matrix(values, matrix, "chebyshev"))
        return part.drop(columns="spectrum").assign(cosine_rank=list(cosine), max_rank=list(np.maximum(cosine, widest)))

    return beside_references(
        spectra, sample, ["region", "pixel_id"], measure, "region int, pixel_id long, cosine_rank array<int>, max_rank array<int>"
    )


def pixel_reference_distances(spectra: DataFrame, sample: DataFrame) -> DataFrame:
    """Cosine and L-infinity distance of every pixel to every reference point of its region, one row each."""
    def measure(part, ids, matrix):
        if not len(ids) or not len(part):
            return pd.DataFrame({c: [] for c in ("region", "pixel_id", "reference_id", "cosine", "maxabs")})
        values = stack(part["spectrum"])
        return pd.DataFrame({
            "region": part["region"].iloc[0], "pixel_id": np.repeat(part["pixel_id"].to_numpy(), len(ids)),
            "reference_id": np.tile(ids, len(part)),
            "cosine": distance_matrix(values, matrix, "cosine").ravel(),
            "maxabs": distance_matrix(values, matrix, "chebyshev").ravel(),
        })

    return beside_references(
        spectra, sample, ["region", "pixel_id"], measure, "region int, pixel_id long, reference_id long, cosine double, maxabs double"
    )


def reference_rank_per_pixel(distances: DataFrame) -> DataFrame:
    """Ranks of the reference points within each pixel; the window holds one pixel's bounded reference list."""
    def order(column):
        return Window.partitionBy("region", "pixel_id").orderBy(column, "reference_id")

    ranked = distances.withColumns({
        "_c": F.row_number().over(order("cosine")) - 1, "_m": F.row_number().over(order("maxabs")) - 1
    })
    return ranked.select(
        "region", "pixel_id", "reference_id", F.col("_c").alias("cosine_rank"), F.greatest("_c", "_m").alias("max_rank")
    )

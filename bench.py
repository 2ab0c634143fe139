"""Benchmark: prints one JSON line with seconds per headline query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the input and the cores.
Every query is fully evaluated into the no-op sink; jobs a query starts while it is built are timed too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # raw peaks to cube
    "bin_peaks", "bin_auto_range", "bin_nonzero", "match_mz_list", "tolerance_window_sum", "ion_chromatogram",
    # normalization and pictures
    "tic", "median_norm", "spatial_tic", "stretch", "top3_rgb", "percentile_ratio_rgb", "subsegment",
    # region comparison
    "region_vs_region", "mann_whitney_u", "category_separation", "roi_mean_ratio", "aggregated_ion_image",
    # ranks, neighbours, quality
    "rank_dense_order", "knn_graph", "saliency_smoothness", "trustworthiness", "outlier_score",
    # spatial
    "cube_filters", "connected_components", "training_set",
    # models
    "pca3", "nmf3_image", "kmeans_segment", "saliency_embed",
]


def main() -> None:
    from ionloom.plans import catalog
    from ionloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()  # start-up is not part of any query
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Registered questions against their SQL on the smallest tables; the full list runs in oracle_check.py."""

import pytest
from conftest import SF
from oracle_check import compare

from ionloom.plans import catalog

CORE = """
list_extractions read_mz_axis read_annotations read_annotation_table new_annotation_files mz_range_slice rotate90
category_key region_importance bin_peaks bin_auto_range bin_nonzero match_mz_list tolerance_window_sum coord_rebase
densify_spectrum scan_concat ion_chromatogram compare_extractions tic median_norm spatial_tic ion_max_norm stretch
stretch_umap hist_equalize equalize_channels nearest_mz polygon_pixels grid_neighbors pending_runs category_pairs
region_mean_spectrum region_percentile_spectrum roi_mean_ratio max_projection global_percentile avg_mz majority_label
node_weight rank_dense_order pixel_rank_per_mz find_peaks top_n_mz_pixel top_bottom_50 region_vs_region region_vs_rest
point_vs_point category_separation separation_edges ion_image aggregated_ion_image certainty rgb_to_lab top3_rgb
percentile_ratio_rgb component_normalize component_paint subsegment guided_segment_color component_drop local_filters
erode morph_close connected_components training_set outlier_score saliency_smoothness spearman correlation_curve
trustworthiness mrre lcmc knn_graph knn_graph_cosine reference_rank_per_pixel read_cube write_ions stream_row_local
""".split()


@pytest.mark.parametrize("name", CORE)
def test_question(spark, duck, name):
    assert compare(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name]) is None


def test_every_statement_belongs_to_a_question():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)

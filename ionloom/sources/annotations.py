"""Region annotations: JSON documents of drawn shapes, and training sets made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import geometry as G
from ionloom.functions.order_stats import ordered_position
from ionloom.operators.aggregates import region_mean_spectrum
from ionloom.operators.filters import category_filter, category_key, clean_category
from ionloom.operators.joins import polygon_pixels

# Layout of an annotation document and the attribute names read by default
REGIONS_SCHEMA = (
    "map<string, struct<regions: array<struct<"
    "shape_attributes: struct<name: string, cx: double, cy: double, r: double, rx: double, ry: double,"
    " all_points_x: array<double>, all_points_y: array<double>>,"
    " region_attributes: map<string, string>>>>>"
)
KEYS_SCHEMA = "map<string, struct<regions: array<struct<>>>>"
WRAPPER_KEY = "_via_img_metadata"
CATEGORY_KEYS = ("main_cat1", "Allen_name", "sub_cat2")
TABLE_KEYS = ("anatomy", "category", "subcategory")


def _inner(column: str):
    """The images of a document, with or without the outer wrapper."""
    return F.coalesce(F.get_json_object(F.col(column), f"$.{WRAPPER_KEY}"), F.col(column))


def parse_documents(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row per shape: (document columns..., image_key, shape, attributes). Accepts the wrapped layout too."""
    others = [c for c in documents.columns if c != column]
    images = documents.select(*others, F.explode(F.from_json(_inner(column), REGIONS_SCHEMA)).alias("image_key", "_img"))
    return images.select(*others, "image_key", F.posexplode("_img.regions").alias("shape_index", "_r")).select(
        *others, "image_key", "shape_index", F.col("_r.shape_attributes").alias("shape"),
        F.col("_r.region_attributes").alias("attributes"),
    )


def read_annotations(
    documents: DataFrame, index: int | str | None = None, category_keys: tuple[str, ...] = CATEGORY_KEYS,
    ignore: list[str] = (), keep: list[str] | None = None,
) -> DataFrame:
    """Shapes of the images whose key starts with ``<index>_``: category and polygon corners.

    Circles and ellipses become rings of 50 corners (an ellipse uses its x radius).
    """
    shapes = parse_documents(documents)
    if index is not None:
        shapes = shapes.where(F.col("image_key").startswith(f"{index}_"))
    shape = F.col("shape")
    radius = F.when(shape["name"] == "ellipse", shape["rx"]).when(shape["name"] == "circle", shape["r"])
    named = shapes.withColumn("category", category_key(*[F.col("attributes")[k] for k in category_keys]))
    ringed = named.withColumns({
        "xs": F.when(radius.isNotNull(), G.circle_x(shape["cx"], radius)).otherwise(shape["all_points_x"]),
        "ys": F.when(radius.isNotNull(), G.circle_y(shape["cy"], radius)).otherwise(shape["all_points_y"]),
    })
    return category_filter(ringed.drop("shape", "attributes"), list(ignore), keep)


def read_annotation_table(documents: DataFrame) -> DataFrame:
    """Flat (image_key, shape_index, anatomy, category, subcategory), missing subcategory as ''."""
    attributes = F.col("attributes")
    first, second, third = TABLE_KEYS
    return parse_documents(documents).select(
        "image_key", "shape_index", clean_category(attributes[first]).alias(first),
        clean_category(attributes[second]).alias(second), F.coalesce(attributes[third], F.lit("")).alias(third),
    )


def annotation_keys(documents: DataFrame, column: str = "json") -> DataFrame:
    """The distinct keys of images with shapes; shapes are counted and not read."""
    images = documents.select(F.explode(F.from_json(_inner(column), KEYS_SCHEMA)).alias("image_key", "_img"))
    return images.where(F.size("_img.regions") > 0).select("image_key").distinct()


def new_annotation_files(new: DataFrame, old: DataFrame) -> DataFrame:
    return annotation_keys(new).exceptAll(annotation_keys(old))


def shared_annotation_files(new: DataFrame, old: DataFrame) -> DataFrame:
    return annotation_keys(new).intersect(annotation_keys(old))


def polygon_paint_order(grid: DataFrame, polygons: DataFrame) -> DataFrame:
    """Label each pixel with the smallest polygon over it: larger ones are painted first.

    polygons(region, polygon, category, xs, ys); corners are truncated to whole pixels. Overlaps are settled
    by a min aggregate, so no pixel collects its polygons.
    """
    whole = polygons.withColumns({
        c: F.transform(c, lambda v: v.cast("int")) for c in ("xs", "ys")
    })
    sized = whole.withColumn("area", G.polygon_area(F.col("xs"), F.col("ys")))
    covered = polygon_pixels(grid, sized.select("region", "polygon", "category", "area", "xs", "ys"))
    return covered.groupBy("region", "y", "x", "pixel_id").agg(
        F.min(F.struct(F.col("area"), F.negative("polygon").alias("_later"), F.col("category"))).alias("_top")
    ).select("region", "y", "x", "pixel_id", F.col("_top.category").alias("category"))


def label_codes(categories: DataFrame) -> DataFrame:
    """Alphabetical integer code per category over all regions; categories are few."""
    return categories.select("category").distinct().withColumn(
        "code", F.row_number().over(Window.orderBy("category")) - 1
    )


def training_set(spectra: DataFrame, polygons: DataFrame, subsample: int = 10) -> DataFrame:
    """Every ``subsample``-th pixel of each painted label in image order: (region, pixel_id, category, code, spectrum)."""
    painted = polygon_paint_order(spectra.select("region", "y", "x", "pixel_id"), polygons)
    placed = ordered_position(
        painted.withColumn("_all_equal", F.lit(0)), ["region", "category"], "_all_equal", "pixel_id", "_pos"
    )
    kept = placed.where(F.col("_pos") % subsample == 0).select("region", "pixel_id", "category")
    return kept.join(label_codes(polygons), "category").join(
        spectra.select("region", "pixel_id", "spectrum"), ["region", "pixel_id"]
    )


def training_means(spectra: DataFrame, ions: DataFrame, polygons: DataFrame, n_mz: int) -> DataFrame:
    """Mean spectrum per painted label, long: (region, category, mz_index, mean)."""
    painted = polygon_paint_order(spectra.select("region", "y", "x", "pixel_id"), polygons)
    sizes = painted.groupBy("region", "category").agg(F.count(F.lit(1)).alias("n"))
    labelled = ions.select("region", "pixel_id", "mz_index", "intensity").join(
        painted.select("region", "pixel_id", "category"), ["region", "pixel_id"]
    )
    return region_mean_spectrum(labelled, sizes, n_mz)

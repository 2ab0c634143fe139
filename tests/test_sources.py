import hashlib
import os
import re
import uuid

import numpy as np
import pytest
from conftest import SF
from helpers import cube_frame, sparse_cube
from pyspark.sql import functions as F

from ionloom.operators import binning
from ionloom.plans import catalog
from ionloom.sources import annotations, cubes, datasources


def test_npy_round_trip(spark, tmp_path):
    made = {r: sparse_cube(np.random.default_rng(r), 5 + r, 3, 4).astype("float32") for r in (0, 2)}
    cubes.write_npy(cube_frame(spark, made), str(tmp_path))
    for region, cube in made.items():
        assert np.array_equal(np.load(tmp_path / f"{region}.npy"), cube)
    datasources.register(spark)
    back = spark.read.format("npy_cube").option("path", str(tmp_path)).option("rows", 2).load()
    assert back.rdd.getNumPartitions() == 3 + 4
    for r in back.collect():
        assert r["spectrum"] == made[r["region"]][r["y"], r["x"]].tolist()
        assert r["pixel_id"] == r["y"] * 3 + r["x"]


def write_imzml(folder, spectra):
    """Minimal file pair: 64-bit m/z, 32-bit intensities."""
    data, items, offset = b"\0" * 16, [], 16
    for i, ((x, y), (mz, intensity)) in enumerate(spectra.items()):
        blobs = [np.asarray(mz, "<f8").tobytes(), np.asarray(intensity, "<f4").tobytes()]
        arrays = ""
        for group, blob in zip(("mzArray", "intensityArray"), blobs):
            arrays += (
                f'<binaryDataArray><referenceableParamGroupRef ref="{group}"/>'
                f'<cvParam accession="IMS:1000102" value="{offset}"/><cvParam accession="IMS:1000103" value="{len(mz)}"/>'
                f'<cvParam accession="IMS:1000104" value="{len(blob)}"/></binaryDataArray>'
            )
            offset += len(blob)
            data += blob
        items.append(
            f'<spectrum id="s{i}"><scanList><scan><cvParam accession="IMS:1000050" value="{x}"/>'
            f'<cvParam accession="IMS:1000051" value="{y}"/></scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>'
        )
    head = (
        '<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList>'
        '<referenceableParamGroup id="mzArray"><cvParam accession="MS:1000514"/><cvParam accession="MS:1000523"/></referenceableParamGroup>'
        '<referenceableParamGroup id="intensityArray"><cvParam accession="MS:1000515"/><cvParam accession="MS:1000521"/></referenceableParamGroup>'
        "</referenceableParamGroupList><run><spectrumList>"
    )
    (folder / "a.imzML").write_text(head + "".join(items) + "</spectrumList></run></mzML>")
    (folder / "a.ibd").write_bytes(data)


def test_imzml_reads_byte_ranges(spark, tmp_path):
    spectra = {(x, y): ([300.0 + x, 301.5, 302.25 + y], [1.0, x, y + 0.5]) for x in (1, 2, 3) for y in (4, 5)}
    write_imzml(tmp_path, spectra)
    datasources.register(spark)
    frame = spark.read.format("imzml").option("path", str(tmp_path / "a.imzML")).option("spectra", 4).load()
    assert frame.rdd.getNumPartitions() == 2
    got = {(r["x"], r["y"]): (r["mz"], r["intensity"]) for r in frame.collect()}
    assert got == {k: (v[0], [float(i) for i in v[1]]) for k, v in spectra.items()}
    peaks = frame.select("region", "y", "x", F.explode(F.arrays_zip("mz", "intensity")).alias("p")).select(
        "region", "y", "x", "p.mz", "p.intensity"
    )
    rebased = binning.coord_rebase(binning.bin_peaks(peaks, 300, 310, 4))
    assert {(r["height"], r["width"]) for r in rebased.collect()} == {(2, 3)}


@pytest.mark.parametrize("size", [3000, 1 << 20])
def test_imzml_written_by_tasks_is_read_by_byte_ranges(spark, tmp_path, size):
    rng = np.random.default_rng(3)
    spectra = {(r, y, x): (rng.uniform(300, 900, n).tolist(), rng.integers(0, 99, n).astype(float).tolist())
               for r in (0, 7) for y in range(3) for x in range(5) for n in [int(rng.integers(0, 6))]}
    rows = [(*k, *v) for k, v in spectra.items()]
    datasources.register(spark)
    frame = spark.createDataFrame(rows, datasources.PEAKS_SCHEMA).repartition(3)
    folder = str(tmp_path / "cube")
    frame.write.format("imzml").mode("append").save(folder)
    names = os.listdir(folder)
    assert not [n for n in names if n.startswith("_")] and len(names) == 2 * 2 * 3
    reader = spark.read.format("imzml").option("bytes", size)
    back = reader.load(folder)
    assert sorted((r["region"], r["y"], r["x"], tuple(r["mz"]), tuple(r["intensity"])) for r in back.collect()) == sorted(
        (*k, tuple(mz), tuple(v)) for k, (mz, v) in spectra.items()
    )
    one = next(os.path.join(folder, n) for n in sorted(names) if n.endswith(".imzML"))
    text, data = open(one).read(), open(one[:-6] + ".ibd", "rb").read()
    assert hashlib.sha1(data).hexdigest() in text and uuid.UUID(bytes=data[:16]).hex in text.replace("-", "")
    whole = sorted(map(str, datasources.imzml_index(one)))
    assert whole == sorted(str(e) for s in range(0, len(text), size // 40) for e in datasources.imzml_range(one, s, min(s + size // 40, len(text))))
    assert len(whole) == int(text.split('spectrumList count="')[1][:10])
    frame.limit(4).write.format("imzml").mode("overwrite").save(folder)
    assert reader.load(folder).count() == 4


def test_imzml_failed_and_empty_writes(spark, tmp_path):
    datasources.register(spark)
    folder = tmp_path / "cube"
    bad = spark.createDataFrame([(0, 0, 0, [1.0], [1.0]), (0, 0, 1, [1.0, 2.0], [1.0])], datasources.PEAKS_SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        bad.write.format("imzml").mode("append").save(str(folder))
    assert not folder.exists() or not os.listdir(folder)
    for row in [(None, 0, 0, [1.0], [1.0]), (0, 0, 0, None, [1.0]), (0, 0, 0, [None], [1.0])]:
        with pytest.raises(Exception, match="imzML"):
            spark.createDataFrame([row], datasources.PEAKS_SCHEMA).write.format("imzml").mode("append").save(str(folder))
    bad.limit(0).write.format("imzml").mode("append").save(str(folder))
    assert spark.read.format("imzml").load(str(folder)).count() == 0
    peaks = spark.createDataFrame([(0, 1, 2, 5.0, 1.0), (0, 1, 2, 3.0, 2.0), (0, 1, 2, None, 2.0)], "region int, y int, x int, mz double, intensity float")
    assert [tuple(r) for r in binning.peak_spectra(peaks).collect()] == [(0, 1, 2, [3.0, 5.0], [2.0, 1.0])]


def test_cube_and_results_round_trip(spark, tmp_path):
    frame = cube_frame(spark, {0: sparse_cube(np.random.default_rng(0), 3, 3, 4)})
    manifest = spark.createDataFrame(
        [("f", "p", 300.0, 303.0, 1, False, None, "id")], cubes.MANIFEST_SCHEMA
    )
    cubes.write_cube(frame, str(tmp_path / "c"), manifest)
    assert cubes.read_cube(spark, str(tmp_path / "c")).count() == 9
    axis = cubes.read_mz_axis(cubes.read_manifest(spark, str(tmp_path / "c"))).collect()
    assert [r["mz"] for r in axis] == [300.0, 301.0, 302.0, 303.0]


def test_smaller_polygon_wins_and_broken_documents_are_left_out(spark):
    shapes = (
        '{"0_a.png": {"regions": ['
        '{"shape_attributes": {"name": "polygon", "all_points_x": [0,6,6,0], "all_points_y": [0,0,6,6]}, "region_attributes": {"main_cat1": "big", "Allen_name": "", "sub_cat2": "x"}},'
        '{"shape_attributes": {"name": "circle", "cx": 3, "cy": 3, "r": 1.5}, "region_attributes": {"main_cat1": "small", "Allen_name": "n", "sub_cat2": "y"}}]},'
        ' "1_b.png": {"regions": []}}'
    )
    frame = spark.createDataFrame([(shapes,), ("broken",)], "json string")
    read = annotations.read_annotations(frame, 0)
    assert sorted(r["category"] for r in read.collect()) == ["BIG_ARTEFACT_X", "SMALL_N_Y"]
    polygons = read.select(F.lit(0).alias("region"), F.col("shape_index").alias("polygon"), "category", "xs", "ys")
    grid = spark.range(64).select(
        F.lit(0).alias("region"), F.floor(F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"),
        F.col("id").alias("pixel_id"),
    )
    painted = {(r["y"], r["x"]): r["category"] for r in annotations.polygon_paint_order(grid, polygons).collect()}
    assert painted[3, 3] == "SMALL_N_Y" and painted[0, 0] == "BIG_ARTEFACT_X" and (7, 7) not in painted
    assert len(painted) == 49


def test_annotation_keys_skip_the_shapes(spark):
    """Keys of images with shapes, whatever the shapes hold; the shapes themselves are not parsed."""
    texts = [
        '{"a": {"regions": [{"shape_attributes": {"name": "circle", "cx": 1}, "region_attributes": {"k": "v"}}]}}',
        '{"_via_img_metadata": {"b": {"regions": [{}, {}]}, "c": {"regions": []}, "d": {}, "a": {"regions": [{}]}}}',
        '{"e": {"regions": [{"shape_attributes": {"cx": "no number"}}]}}', '{"f": {"regions": null}}', '{"g": {"regions": "x"}}',
        '{"h": {"regions": [null]}}', '{"i": 5, "j": {"regions": [{}]}}', "{", "", None, "[]", '{"k": {"size": 3, "regions": [{"region_attributes": {}}]}}',
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "order_id int, json string")
    want = {r["image_key"] for r in annotations.parse_documents(frame).select("image_key").collect()}
    got = annotations.annotation_keys(frame)
    assert {r["image_key"] for r in got.collect()} == want and {"a", "b", "e", "k"} <= want
    assert "shape_attributes" not in got._jdf.queryExecution().optimizedPlan().toString()
    old = annotations.annotation_keys(frame.where("order_id = 0")).collect()
    assert [r["image_key"] for r in old] == ["a"]
    assert {r["image_key"] for r in annotations.new_annotation_files(frame, frame.where("order_id = 0")).collect()} == want - {"a"}
    assert [r["image_key"] for r in annotations.shared_annotation_files(frame, frame.where("order_id = 0")).collect()] == ["a"]


def test_annotation_documents_share_one_shuffle(spark):
    for name in ("new_annotation_files", "shared_annotation_files"):
        found = catalog.QUERIES[name](spark, SF)
        found.collect()
        assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString(), name


def test_spectra_leave_the_reader_in_batches(tmp_path, monkeypatch):
    """A read partition gives Arrow batches of bounded size with the numbers that were written, empty spectra too."""
    pair = datasources._Pair(str(tmp_path / "3-a"))
    given = [(i, 2 * i, np.arange(i % 4) + 0.25, np.arange(i % 4) * 1.5) for i in range(10)]
    for row in given:
        pair.add(*row)
    pair.finish()
    path = str(tmp_path / "3-a.imzML")
    text = open(path, "rb").read()
    types, roles = datasources.imzml_groups(path)
    bare = [datasources._bare_entry(m, types, roles) for m in re.findall(rb"<spectrum .*</spectrum>", text)]
    assert bare == list(datasources.imzml_index(path)) and len(bare) == 10
    other = re.search(rb"<spectrum .*</spectrum>", text)[0].replace(b"<scan>", b'<scan><userParam name="x"/>')
    assert datasources._bare_entry(other, types, roles) is None
    assert datasources._bare_entry(other.replace(b'<userParam name="x"/>', b""), types, {}) is None
    monkeypatch.setattr(datasources, "BATCH_SPECTRA", 4)
    reader = datasources.ImzMLReader(str(tmp_path), None, 0, 8 << 20)
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert [b.num_rows for b in batches] == [4, 4, 2]
    rows = [r for b in batches for r in b.to_pylist()]
    assert [(r["region"], r["y"], r["x"], r["mz"], r["intensity"]) for r in rows] == [(3, y, x, m.tolist(), v.tolist()) for y, x, m, v in given]

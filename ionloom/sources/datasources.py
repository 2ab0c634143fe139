"""Python data sources: NumPy cubes and imzML files.

The driver plans ranges from headers and file sizes; tasks read the XML index entries and the numbers. Files lie in a folder that
the driver and all executors can open as a plain path.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import uuid
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SPECTRA_SCHEMA = "region int, y int, x int, pixel_id long, spectrum array<float>"
PEAKS_SCHEMA = "region int, y int, x int, mz array<double>, intensity array<float>"

# imzML vocabulary accession numbers
ACC_X, ACC_Y = "IMS:1000050", "IMS:1000051"
ACC_OFFSET, ACC_LENGTH, ACC_ENCODED = "IMS:1000102", "IMS:1000103", "IMS:1000104"
ACC_MZ_ARRAY, ACC_INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
ACC_UUID, ACC_SHA1, ACC_PROCESSED, ACC_EXTERNAL = "IMS:1000080", "IMS:1000091", "IMS:1000031", "IMS:1000101"
ACC_TYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}


class Rows(InputPartition):
    def __init__(self, path: str, region: int, start: int, stop: int):
        self.path, self.region, self.start, self.stop = path, region, start, stop


class NpyCube(DataSource):
    """``<region>.npy`` cubes of rows x cols x m/z in a shared folder, one partition per block of image rows."""

    @classmethod
    def name(cls):
        return "npy_cube"

    def schema(self):
        return SPECTRA_SCHEMA

    def reader(self, schema):
        return NpyReader(self.options["path"], int(self.options.get("rows", 16)))


class NpyReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self):
        found = []
        for name in sorted(os.listdir(self.path)):
            match = re.fullmatch(r"(\d+)\.npy", name)
            if match:
                full = os.path.join(self.path, name)
                height = np.load(full, mmap_mode="r").shape[0]
                found += [Rows(full, int(match[1]), s, min(s + self.rows, height)) for s in range(0, height, self.rows)]
        return found

    def read(self, partition):
        cube = np.load(partition.path, mmap_mode="r")
        width = cube.shape[1]
        for y in range(partition.start, partition.stop):
            for x, spectrum in enumerate(np.asarray(cube[y], dtype="float32")):
                yield (partition.region, y, x, y * width + x, spectrum.tolist())


class Spans(InputPartition):
    """Index entries of one file, already read."""

    def __init__(self, path: str, region: int, spans: list):
        self.path, self.region, self.spans = path, region, spans


class Bytes(InputPartition):
    """The index entries that begin within a byte range of one XML file."""

    def __init__(self, path: str, region: int, start: int, stop: int):
        self.path, self.region, self.start, self.stop = path, region, start, stop


class ImzML(DataSource):
    """imzML pairs (XML index and ``.ibd`` numbers): one file, or a folder of ``<region>-*.imzML``.

    Options: ``path``; ``bytes`` of index a read partition takes (8 MB); ``region`` of a single file (0). The index must be in a
    one-byte or UTF-8 encoding. ``spectra`` plans partitions of that many spectra instead, which reads the index on the driver.

    Writing takes rows of ``PEAKS_SCHEMA`` into a folder; null regions, places or arrays and arrays of unequal length are errors.
    Every task writes one pair per region in a folder of the job; the commit moves finished pairs to their names, numbers before
    index, so a reader meets whole pairs only and failed or repeated attempts leave nothing behind.
    """

    @classmethod
    def name(cls):
        return "imzml"

    def schema(self):
        return PEAKS_SCHEMA

    def reader(self, schema):
        spectra = self.options.get("spectra")
        return ImzMLReader(
            self.options["path"], int(spectra) if spectra else None, int(self.options.get("region", 0)), int(self.options.get("bytes", 8 << 20))
        )

    def writer(self, schema, overwrite):
        return ImzMLWriter(self.options["path"], overwrite)


def _groups(node, types: dict, roles: dict) -> None:
    names = {c.get("accession") for c in node}
    types[node.get("id")] = next((t for a, t in ACC_TYPES.items() if a in names), "<f4")
    roles[node.get("id")] = "mz" if ACC_MZ_ARRAY in names else "intensity"


def _entry(spectrum, types: dict, roles: dict):
    """(y, x, m/z span, intensity span) of one spectrum element."""
    values, spans = {}, {}
    for child in spectrum.iter():
        name = _tag(child)
        if name == "cvParam":
            values.setdefault(child.get("accession"), child.get("value"))
        elif name == "binaryDataArray":
            params, group = {}, None
            for c in child.iter():
                held = c.attrib
                if held.get("accession"):
                    params[held["accession"]] = held.get("value")
                if group is None and _tag(c) == "referenceableParamGroupRef":
                    group = held.get("ref")
            kind = roles.get(group) or ("mz" if ACC_MZ_ARRAY in params else "intensity")
            code = types.get(group) or next((t for a, t in ACC_TYPES.items() if a in params), "<f4")
            spans[kind] = (int(params[ACC_OFFSET]), int(params[ACC_LENGTH]), code)
    return int(values[ACC_Y]), int(values[ACC_X]), spans["mz"], spans["intensity"]


def _tag(node) -> str:
    name = node.tag
    return name.rsplit("}", 1)[-1] if "}" in name else name


_PARAM = rb'<cvParam cvRef="IMS" accession="%s" name="%s" value="%s"/>'
_ARRAY = (
    rb'<binaryDataArray encodedLength="\d+"><referenceableParamGroupRef ref="([^"&<>]*)"/>'
    + _PARAM % (ACC_OFFSET.encode(), b"external offset", rb"(\d+)") + _PARAM % (ACC_LENGTH.encode(), b"external array length", rb"(\d+)")
    + _PARAM % (ACC_ENCODED.encode(), b"external encoded length", rb"\d+") + rb"<binary/></binaryDataArray>"
)
#: An entry with nothing but a place and two arrays, as ``_Pair`` writes it; any other entry goes through the XML parser.
BARE_ENTRY = re.compile(
    rb'<spectrum id="[^"&<>]*" index="\d+" defaultArrayLength="\d+"><scanList count="1"><scan>'
    + _PARAM % (ACC_X.encode(), b"position x", rb"(-?\d+)") + _PARAM % (ACC_Y.encode(), b"position y", rb"(-?\d+)")
    + rb'</scan></scanList><binaryDataArrayList count="2">' + _ARRAY * 2 + rb"</binaryDataArrayList></spectrum>"
)


def _bare_entry(text: bytes, types: dict, roles: dict):
    """What ``_entry`` finds in a bare spectrum element; None for any other."""
    match = BARE_ENTRY.fullmatch(text)
    if match is None:
        return None
    x, y, *arrays = match.groups()
    spans = {}
    for name, offset, length in (arrays[:3], arrays[3:]):
        name = name.decode()
        if name not in types or name not in roles:
            return None
        spans[roles[name]] = (int(offset), int(length), types[name])
    return (int(y), int(x), spans["mz"], spans["intensity"]) if len(spans) == 2 else None


def imzml_index(path: str):
    """The entries of a whole index, streamed."""
    types, roles = {}, {}
    for _, node in ET.iterparse(path):
        if _tag(node) == "referenceableParamGroup":
            _groups(node, types, roles)
        elif _tag(node) == "spectrum":
            yield _entry(node, types, roles)
            node.clear()


READ_BYTES = 1 << 20
#: Numbers or spectra after which a read batch goes out.
BATCH_NUMBERS, BATCH_SPECTRA = 1 << 20, 4096
SPECTRUM_START, SPECTRUM_END = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"


def imzml_groups(path: str) -> tuple[dict, dict]:
    """Types and roles of the parameter groups, from the part of the index before its spectra."""
    types, roles = {}, {}
    parser = ET.XMLPullParser(["start", "end"])
    with open(path, "rb") as file:
        while data := file.read(1 << 14):
            parser.feed(data)
            for event, node in parser.read_events():
                if event == "start" and _tag(node) == "spectrum":
                    return types, roles
                if event == "end" and _tag(node) == "referenceableParamGroup":
                    _groups(node, types, roles)
    return types, roles


def imzml_range(path: str, start: int, stop: int):
    """The entries whose element begins at a byte of [start, stop)."""
    types, roles = imzml_groups(path)
    with open(path, "rb") as file:
        file.seek(start)
        held, at, used = b"", start, 0  # bytes read, the place of the first one in the file, how many are done with
        while True:
            found = SPECTRUM_START.search(held, used)
            if found is not None and at + found.start() >= stop:
                return
            end = -1 if found is None else held.find(SPECTRUM_END, found.start())
            if end >= 0:
                used = end + len(SPECTRUM_END)
                text = held[found.start():used]
                yield _bare_entry(text, types, roles) or _entry(ET.fromstring(text), types, roles)
                continue
            if found is None and at + len(held) >= stop + 9:  # no start can begin before ``stop`` any more
                return
            used = found.start() if found else max(used, len(held) - 9)
            more = file.read(max(READ_BYTES, len(held) - used))
            if not more and found:
                raise ValueError(f"{path}: the spectrum at byte {at + used} does not end")
            if not more:
                return
            held, at, used = held[used:] + more, at + used, 0


class ImzMLReader(DataSourceReader):
    def __init__(self, path: str, spectra: int | None, region: int, size: int):
        self.path, self.spectra, self.region, self.size = _plain(path), spectra, region, size

    def files(self) -> list[tuple[str, int]]:
        if not os.path.isdir(self.path):
            return [(self.path, self.region)]
        names = [(n, re.fullmatch(r"(-?\d+)-.*\.imzML", n)) for n in sorted(os.listdir(self.path))]
        return [(os.path.join(self.path, n), int(m[1])) for n, m in names if m]

    def partitions(self):
        found = []
        for path, region in self.files():
            if self.spectra is None:
                length = os.path.getsize(path)
                found += [Bytes(path, region, s, min(s + self.size, length)) for s in range(0, length, self.size)]
                continue
            spans = []
            for entry in imzml_index(path):
                spans.append(entry)
                if len(spans) == self.spectra:
                    found.append(Spans(path, region, spans))
                    spans = []
            found += [Spans(path, region, spans)] if spans else []
        return found or [Spans(self.path, self.region, [])]

    def read(self, partition):
        entries = partition.spans if isinstance(partition, Spans) else imzml_range(partition.path, partition.start, partition.stop)
        data, rows, held = None, [], 0
        try:
            for y, x, mz, intensity in entries:
                data = data or open(os.path.splitext(partition.path)[0] + ".ibd", "rb")
                numbers = []
                for offset, length, code in (mz, intensity):
                    data.seek(offset)
                    numbers.append(np.frombuffer(data.read(length * np.dtype(code).itemsize), dtype=code))
                rows.append((y, x, *numbers))
                held += len(numbers[0]) + len(numbers[1])
                if held >= BATCH_NUMBERS or len(rows) >= BATCH_SPECTRA:
                    yield _peaks_batch(partition.region, rows)
                    rows, held = [], 0
            if rows:
                yield _peaks_batch(partition.region, rows)
        finally:
            if data is not None:
                data.close()


def _peaks_batch(region: int, rows: list) -> pa.RecordBatch:
    """Spectra as one Arrow batch: their numbers go to Spark without becoming Python objects."""
    y, x, mz, intensity = zip(*rows)
    lists = []
    for arrays, kind in ((mz, "<f8"), (intensity, "<f4")):
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(a) for a in arrays], out=offsets[1:])
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).astype(kind))))
    place = [pa.array(v, pa.int32()) for v in ([region] * len(rows), y, x)]
    return pa.RecordBatch.from_arrays([*place, *lists], names=["region", "y", "x", "mz", "intensity"])


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    names: list


class _Pair:
    """An imzML pair being written: spectra go out one by one, count and checksum are filled in at the end."""

    def __init__(self, stem: str):
        self.count, self.offset, self.sum = 0, 16, hashlib.sha1()
        mark = uuid.uuid4()
        self.data, self.index = open(stem + ".ibd", "wb"), open(stem + ".imzML", "wb")
        self._put(mark.bytes)
        group = lambda name, role, kind: (
            f'<referenceableParamGroup id="{name}"><cvParam cvRef="MS" accession="{role}" name="{name}"/>'
            f'<cvParam cvRef="MS" accession="{kind[0]}" name="{kind[1]}"/><cvParam cvRef="IMS" accession="{ACC_EXTERNAL}" name="external data" value="true"/>'
            "</referenceableParamGroup>"
        )
        self.index.write((
            '<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1">\n<fileDescription><fileContent>'
            f'<cvParam cvRef="IMS" accession="{ACC_PROCESSED}" name="processed"/>'
            f'<cvParam cvRef="IMS" accession="{ACC_UUID}" name="universally unique identifier" value="{{{mark}}}"/>'
            f'<cvParam cvRef="IMS" accession="{ACC_SHA1}" name="ibd SHA-1" value="'
        ).encode())
        self.sum_at = self.index.tell()
        self.index.write((
            "0" * 40 + '"/></fileContent></fileDescription>\n<referenceableParamGroupList count="2">'
            + group("mzArray", ACC_MZ_ARRAY, ("MS:1000523", "64-bit float"))
            + group("intensityArray", ACC_INTENSITY_ARRAY, ("MS:1000521", "32-bit float"))
            + '</referenceableParamGroupList>\n<run id="run"><spectrumList count="'
        ).encode())
        self.count_at = self.index.tell()
        self.index.write(b'0000000000">\n')

    def _put(self, blob: bytes) -> None:
        self.data.write(blob)
        self.sum.update(blob)

    def add(self, y: int, x: int, mz: np.ndarray, intensity: np.ndarray) -> None:
        arrays = ""
        for group, blob in (("mzArray", mz.astype("<f8").tobytes()), ("intensityArray", intensity.astype("<f4").tobytes())):
            arrays += (
                f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{group}"/>'
                f'<cvParam cvRef="IMS" accession="{ACC_OFFSET}" name="external offset" value="{self.offset}"/>'
                f'<cvParam cvRef="IMS" accession="{ACC_LENGTH}" name="external array length" value="{len(mz)}"/>'
                f'<cvParam cvRef="IMS" accession="{ACC_ENCODED}" name="external encoded length" value="{len(blob)}"/><binary/></binaryDataArray>'
            )
            self._put(blob)
            self.offset += len(blob)
        self.index.write((
            f'<spectrum id="spectrum={self.count}" index="{self.count}" defaultArrayLength="0"><scanList count="1"><scan>'
            f'<cvParam cvRef="IMS" accession="{ACC_X}" name="position x" value="{x}"/><cvParam cvRef="IMS" accession="{ACC_Y}" name="position y" value="{y}"/>'
            f'</scan></scanList><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>\n'
        ).encode())
        self.count += 1

    def finish(self) -> None:
        self.index.write(b"</spectrumList></run></mzML>\n")
        for place, text in ((self.sum_at, self.sum.hexdigest()), (self.count_at, f"{self.count:010d}")):
            self.index.seek(place)
            self.index.write(text.encode())
        self.close()

    def close(self) -> None:
        self.data.close()
        self.index.close()


class ImzMLWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _plain(path), overwrite
        self.working = os.path.join(self.path, f"_job-{uuid.uuid4().hex}")

    def write(self, iterator) -> Written:
        os.makedirs(self.working, exist_ok=True)
        attempt, pairs = uuid.uuid4().hex, {}
        try:
            for batch in iterator:
                if any(batch.column(c).null_count for c in range(batch.num_columns)):
                    raise ValueError("imzML rows need a region, y, x, m/z and intensities")
                place = {c: batch.column(c).to_pylist() for c in ("region", "y", "x")}
                lists = [_list_parts(batch.column(c)) for c in ("mz", "intensity")]
                for i in range(batch.num_rows):
                    (mz, mz_at), (value, value_at) = lists
                    mz, value = mz[mz_at[i] : mz_at[i + 1]], value[value_at[i] : value_at[i + 1]]
                    if len(mz) != len(value):
                        raise ValueError("m/z and intensities of a spectrum differ in length")
                    region = place["region"][i]
                    if region not in pairs:
                        pairs[region] = _Pair(os.path.join(self.working, f"{region}-{attempt}"))
                    pairs[region].add(place["y"][i], place["x"][i], mz, value)
            for pair in pairs.values():
                pair.finish()
        finally:
            for pair in pairs.values():
                pair.close()
        return Written([f"{region}-{attempt}" for region in pairs])

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        former = [n for n in os.listdir(self.path) if n.endswith((".imzML", ".ibd"))] if self.overwrite else []
        for name in sorted(former, reverse=True):  # the index of a pair goes first
            os.remove(os.path.join(self.path, name))
        for message in messages:
            for name in message.names if message else []:
                for ending in (".ibd", ".imzML"):
                    os.replace(os.path.join(self.working, name + ending), os.path.join(self.path, name + ending))
        shutil.rmtree(self.working, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.working, ignore_errors=True)


def _list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and borders of a list column without inner nulls."""
    values = column.values
    first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
    if values.slice(first, last - first).null_count:
        raise ValueError("imzML arrays must not hold nulls")
    return values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyCube)
    spark.dataSource.register(ImzML)

"""Session settings and lineage control."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "ionloom") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a local master may fall back to /tmp."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ionloom-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can read")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the reliable checkpoint folder, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes a value takes, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0)) + 16
        each = 8 * (1 + len(inner.fields)) if isinstance(inner, T.StructType) else 8
        return F.greatest(F.size(value), F.lit(0)) * each + 16
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, about, from one pass over a materialized table."""
    row = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(16))
    return df.agg(F.coalesce(F.sum(row.cast("long")), F.lit(0))).first()[0]


def small_side(df: DataFrame, byte_limit: int = 32 << 20) -> DataFrame:
    """Materialize a summary table and broadcast it only if its measured size in bytes allows.

    Summaries (extents, quantiles, peak lists) meet tables of pixels or ions on keys such as the region, where one
    key may hold a third of all rows. Broadcast, the large side is not shuffled at all; above ``byte_limit`` the
    join stays a shuffled one, which adaptive execution splits at hot keys.
    """
    done = cut_lineage(df)
    return F.broadcast(done) if measured_bytes(done) <= byte_limit else done


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs inside the block, put back afterwards; ``__`` in a name stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together, in a fixed number of tasks: by size alone the planner would put small, costly groups in one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared checkpoint folder for a table that is written and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ionloom-package-"), "ionloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in sorted(f for f in files if f.endswith(".py")):
                path = os.path.join(folder, file)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that is small by definition (categories, centres, samples) and refuse if it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, too many to hold on the driver")
    return rows

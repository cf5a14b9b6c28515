"""Session helpers: scratch space on the cluster's shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_LEAVING: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application, so that they import it from anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="spark-")  # the driver serves the file from here while the application runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a private folder only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def new_scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: one evaluation, read back the same after an executor is lost.

    The application's checkpoint folder is removed when it ends; with ``spark.cleaner.referenceTracking.cleanCheckpoints``
    Spark removes each checkpoint as soon as nothing refers to it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(spark))
    folder = context.getCheckpointDir()
    if folder not in _LEAVING:  # goes with the application, whoever named it
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
        _LEAVING.add(folder)
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Keep a summary table once and broadcast it when it is counted and measured to be small.

    For tables of one row per class, model or cell: without this, size estimates taken from the
    scanned data make Spark shuffle the big side on a handful of hot keys. A table of more than
    ``max_rows`` rows, or of more than BROADCAST_BYTES as text, is returned as it is and joins by
    shuffle, where adaptive execution splits skewed partitions.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if is_small(kept, max_rows) else kept


def is_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` stays within both limits; reads no more than ``max_rows`` rows plus one."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, wide = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (wide or 0) <= max_bytes

"""Session helpers: recommended settings, shared scratch folder, small literal tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Settings that may also be changed on a running session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    ship_package(spark)
    return spark


# Applications that have the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="civicpulse-")) / "civicpulse"
    context.addPyFile(shutil.make_archive(str(archive), "zip", home.parent, home.name))


def local_session(cores: int | str = "*", memory: str = "8g", app: str = "civicpulse") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    shuffle_partitions = "8" if cores == "*" else str(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.getCheckpointDir() is None:  # spark.checkpoint.dir is unset
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="civicpulse-"))
    return prepare(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named in ``spark.checkpoint.dir``, or set for checkpoints."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{shared.rstrip('/')}/civicpulse/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table given in code.

    It comes in as Arrow, so the optimizer knows its exact size and can broadcast it by the usual
    threshold.
    """
    columns = list(zip(*rows)) if rows else [()] * len(names)
    types = None if rows else pa.string()
    return spark.createDataFrame(
        pa.table({n: pa.array(c, type=types) for n, c in zip(names, columns)})
    )

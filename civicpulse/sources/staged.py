"""Tables that are written load by load, each load wholly or not at all, and once however often it is run.

An attempt writes its files to a folder of its own. The commit is one rename: of a manifest that names this
folder, its rows and its files. Readers read the folders that manifests name, so attempts that broke off
are never seen, and a second run of a load finds its manifest and writes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicpulse.sources.sinks import write_table

MANIFEST = "load string, folder string, schema string, n_rows long, n_files long, n_bytes long"


def write_load(df: DataFrame, path: str, load: str, partition_by: Sequence[str] = ()) -> dict:
    """Write ``df`` as the load of this name and return its manifest; one that is there already is left alone.

    Of two attempts at the same time one commits, and both return its manifest.
    """
    spark = df.sparkSession
    done = manifest_of(spark, path, load)
    if done:
        return done
    attempt = stage(df, path, load, partition_by)
    try:
        _commit(spark, path, attempt)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in str(error.java_exception.getClass()):
            raise
    return manifest_of(spark, path, load)


def stage(df: DataFrame, path: str, load: str, partition_by: Sequence[str] = ()) -> dict:
    """Write the files of an attempt, and return the manifest it would have; rows are counted in what was written."""
    spark = df.sparkSession
    folder = f"{quote(load, safe='')}-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{folder}", partition_by=partition_by)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    sizes = files.load(f"{path}/{folder}").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    n_rows = spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()
    return {"load": load, "folder": folder, "schema": df.schema.json(), "n_rows": n_rows, "n_files": sizes.n, "n_bytes": sizes.bytes}


def _manifest_path(path: str, load: str) -> str:
    return f"{path}/_manifests/{quote(load, safe='')}.json"


def _hadoop(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def manifest_of(spark: SparkSession, path: str, load: str) -> dict | None:
    """The manifest of a committed load."""
    place = _hadoop(spark, _manifest_path(path, load))
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    row = spark.read.schema(MANIFEST).json(place.toString()).first()
    return row.asDict()


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    """Make an attempt the load: its manifest is written aside and renamed, which fails if there is one."""
    final = _hadoop(spark, _manifest_path(path, manifest["load"]))
    aside = _hadoop(spark, f"{path}/_manifests/_{manifest['folder']}")
    stream = final.getFileSystem(spark._jsc.hadoopConfiguration()).create(aside, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all committed loads."""
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{path}/_manifests")


def read_loads(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the committed loads, with ``load``; a load whose files lost or gained rows is an error.

    The folders, one per load, are listed in the driver, as Spark lists the files in them.
    """
    found = manifests(spark, path).collect()
    parts = []
    for manifest in found:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        rows = spark.read.schema(schema).parquet(f"{path}/{manifest.folder}")
        if rows.count() != manifest.n_rows:
            raise ValueError(f"load {manifest.load!r} should have {manifest.n_rows} rows")
        parts.append(rows.withColumn("load", F.lit(manifest.load)))
    if not parts:
        raise ValueError(f"no load was committed to {path}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole

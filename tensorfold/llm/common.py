"""Small helpers shared by the corpus operators: the shared folder, staged tables, file systems."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: ASCII white space as the word contracts define it; Java, RE2 and Python read it alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Used only where the session names no shared folder and all its tasks run on this machine (tests, notebooks).
FALLBACK_DIR = "file:///tmp/checkpoints/tensorfold"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    found = found or FALLBACK_DIR
    if "://" not in found and not found.startswith("file:"):
        found = f"file://{os.path.abspath(found)}" if not found.startswith("/") else f"file://{found}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of one operator, below the shared folder."""
    return f"{shared_dir(spark)}/tensorfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage and survives lost executors; unlike a cache, whatever is written is never computed twice.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_work(spark: SparkSession) -> None:
    """Delete everything this application has staged; call it when no result is still to be read."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tensorfold/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str):
    """(file system, path) for a URI on an executor; plain paths are local."""
    from pyarrow import fs

    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return fs.FileSystem.from_uri(uri)


def fresh(taken: Sequence[str], *names: str) -> list[str]:
    """The names, with underscores before them where needed so that none is among ``taken``, in any case of letters."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out

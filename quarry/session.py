"""Sessions for local work, and the library on the executors' path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once a context, as a zip file that Spark distributes."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="quarry-")
    archive = os.path.join(folder, "quarry.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._quarry_shipped = True
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "quarry") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set, one of this machine serves a local master, as in tests; a cluster without
    a shared folder is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-checkpoint-"))
    return folder or context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was written to a path."""
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there, so a lost executor costs one read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

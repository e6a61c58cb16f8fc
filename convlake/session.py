"""What a Spark session needs before operators with Python in them run."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and see that a checkpoint folder is set: the cluster's own where it names one.

    Local workers get the package's path; on a cluster it is shipped as a zip file, once an application. A local session without
    a checkpoint folder makes one; a cluster must name one that executors share.
    """
    sc = spark.sparkContext
    local = sc.master == "local" or sc.master.startswith("local[")
    if local:
        known = sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
        if str(PACKAGE.parent) not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(PACKAGE.parent), known) if x)
    elif sc.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="package")) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(PACKAGE.rglob("*.py")):
                z.write(file, file.relative_to(PACKAGE.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not local:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return spark


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file or folder, in whatever store Spark reads the path from?"""
    store, at = _path(spark, path)
    return store.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file that this package wrote."""
    store, at = _path(spark, path)
    store.delete(at, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the checkpoint folder, which the driver and all executors share."""
    return f"{ready(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"

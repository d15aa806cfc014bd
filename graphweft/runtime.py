"""Session helpers: shipping the package to executors, cutting lineage, shared folder."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python stages can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="graphweft-")
    target = os.path.join(folder, "graphweft_ship.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.write(p, str(p.relative_to(_HERE.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset and all run here."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="graphweft-checkpoint-")
        atexit.register(shutil.rmtree, at[7:], True)
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:
        if spark.sparkContext._jsc is not None:  # else the session is gone, and its JVM deletes on exit what is left
            warnings.warn(f"{path} is left behind: {e}", stacklevel=2)


@atexit.register
def release() -> None:
    """Delete the tables that :func:`materialize` wrote."""
    while _made:
        _remove(*_made.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor, unlike a local checkpoint; columnar and compressed,
    so later passes read only the columns they need. Removed by :func:`release` or at the end of the process.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    names = {os.path.basename(os.path.dirname(f)) for f in df.inputFiles()}
    for made in [m for m in _made if os.path.basename(m[1]) in names]:
        _made.remove(made)
        _remove(*made)


def collect_garbage(spark: SparkSession) -> None:
    """Let the engine delete the shuffle files of what is done: it does so when the driver's JVM collects its garbage, else
    they stay until that happens to be short of memory."""
    for _ in range(2):  # what the first finds unused still held other things
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that is written by its owner and goes with :func:`release`."""
    path = f"{shared_dir(spark).rstrip('/')}/graphweft/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)  # should the session stop before :func:`release`
    _made.append((spark, path))
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

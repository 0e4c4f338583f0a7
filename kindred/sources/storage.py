"""Places that every executor can reach, and tables that cut lineage there."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: What removes the written tables at the end, by path.
_removals: dict[str, partial] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where the session names none, a local one if all runs in one process (tests), and else an error: executors don't share the driver's disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="kindred-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: through PYTHONPATH if that names it, else as a file that Spark hands out."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_kindred_shipped", False):
        return
    made = Path(tempfile.mkdtemp(prefix="kindred-ship-"))
    atexit.register(shutil.rmtree, made, True)
    with zipfile.ZipFile(made / "kindred_package.zip", "w") as z:
        for f in sorted((root / "kindred").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(made / "kindred_package.zip"))
    context._kindred_shipped = True


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    Unlike localCheckpoint the files outlive a lost executor; later plans start from them, so
    whatever is used twice is computed once. They are removed by ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kindred/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _removals[path] = partial(_remove, spark, path)
    atexit.register(_removals[path])
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Removes tables made by ``materialize`` that no later plan reads. Others and None are ignored."""
    for df in written:
        path = getattr(df, "_kindred_path", None)
        if path:
            atexit.unregister(_removals.pop(path))
            _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that have ended: it learns of them when the driver's garbage is collected.

    Python's references go in the first round, and what they held in the second.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone already; its folder goes with it
        pass

"""Session helpers shared by every part of the engine.

* ``ship`` makes this package importable on executors, whatever their working folder.
* ``Scratch`` writes intermediate tables to the folder that the cluster shares and reads them
  back, which cuts lineage without depending on any executor's disk.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark application."""
    sc = spark.sparkContext
    done = getattr(sc, "_varlens_shipped", None)
    if done == sc.applicationId:
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="varlens"))
    target = os.path.join(folder, "varlens_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(Path(_PACKAGE.name) / p.relative_to(_PACKAGE)))
    sc.addPyFile(target)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # rows may hold long texts
    sc._varlens_shipped = sc.applicationId


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes share: ``spark.checkpoint.dir``; where that is unset, a local one on a local master, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.realpath(os.path.join(tempfile.gettempdir(), "varlens-checkpoints"))
        os.makedirs(root[len("file://"):], exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """A private subfolder of the shared folder; removed when the application ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        self._fs = fs

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: later uses never recompute it."""
        target = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


_HELD: list = [None, None]


def held(kind, make=lambda: None):
    """What this Python worker keeps between tasks: one cache, made anew when another operator asks for its own.

    Workers outlive tasks and are shared by all operators of an application; caches that pile up would be lost memory.
    """
    if _HELD[0] != kind:
        import pyarrow as pa

        _HELD[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not glibc
            pass
        _HELD[:] = [kind, make()]
    return _HELD[1]

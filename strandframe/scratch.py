"""Intermediate tables in the cluster's shared folder.

Long jobs cut their lineage by writing a table and reading it again: unlike a
local checkpoint this survives the loss of any executor, and unlike a checkpoint
of rows it is columnar, has a known size and is computed once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="spark-scratch-")
    return "file://" + _LOCAL["dir"]


class Scratch:
    """Tables of one job. Results may still read them, so they are removed when told to, or when Python ends."""

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        atexit.register(self._quiet_clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read again."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._paths[id(out)] = at
        return out

    def free(self, df: DataFrame) -> None:
        at = self._paths.pop(id(df), None)
        if at:
            self._delete(at)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(at)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _quiet_clear(self) -> None:
        try:
            self.clear()
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass

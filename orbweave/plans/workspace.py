"""Intermediate tables in the folder that the cluster shares.

Iterative and multi-pass operators cut their lineage by writing a table and reading it
back, so a lost executor costs a re-read and never a recomputation from the source.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no folder of its own, as in tests.
DEFAULT_DIR = "file:///tmp/checkpoints/orbweave"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or DEFAULT_DIR


class Workspace:
    """Tables of one run, below one fresh folder of the shared directory.

    What a run leaves there goes by :meth:`clear`, or when the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/orbweave-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._end)

    def _end(self) -> None:
        """Remove the folder if the session is still there to do it."""
        try:
            self.clear()
        except Exception:  # the gateway has gone before us; the folder is all that is lost
            pass

    def clear(self) -> None:
        """Delete every table of the run; no result may still be read from them."""
        self._delete(self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back from there.

        Shuffle files that the write needed go as soon as the table stands; otherwise they
        stay until the driver's garbage collector meets the plan.
        """
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._orbweave_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for table in tables:
            self._delete(table._orbweave_path)

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

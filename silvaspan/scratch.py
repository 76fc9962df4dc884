"""Intermediate tables in the folder that the driver and all executors share.

Iterative operators cut their lineage by writing a table and reading it again. The folder is the one
the cluster names in ``spark.checkpoint.dir``; only where that setting is absent and Spark runs in one local
process (tests, a laptop) a temporary folder is used. On a cluster its absence is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; a local one is made only if the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="silvaspan-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """A folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/silvaspan/{label}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes the rows as Parquet and returns them as a frame that reads what was written."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._silvaspan_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that no later plan reads."""
        path = getattr(df, "_silvaspan_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

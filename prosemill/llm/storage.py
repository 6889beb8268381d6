"""Tables that an operator writes between two of its steps.

They lie in the folder that the session names in ``spark.checkpoint.dir``, which all executors share, so a lost executor
loses none of them and a long plan is cut there. ``Scratch`` is one operator call's folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; where none is set and the master is local (tests, a laptop), a local one is made and set."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='prosemill-')}"
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


class Scratch:
    """Names, writes, reads back and drops the tables of one operator call."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session; only where that is unset
and the master is local (tests) a temporary folder of this machine takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Writes DataFrames as Parquet and reads them back, which cuts their lineage.

    drop() and leave() delete tables that nothing needs any more.  What a returned
    DataFrame still reads stays until the shared folder is emptied.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gneiss-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._gneiss_path = path
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for kept in tables:
            self._delete(kept._gneiss_path)

    def leave(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        left = {t._gneiss_path for t in tables}
        for n in range(self.count):
            if f"{self.root}/{n}" not in left:
                self._delete(f"{self.root}/{n}")

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

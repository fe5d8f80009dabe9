"""Session factory and the settings every gneiss job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session; on a cluster spark-submit supplies master and memory instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gneiss")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("GNEISS_DRIVER_MEMORY", "8g"))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; zone-less timestamps become session (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def shared_dir(spark: SparkSession) -> str:
    """The folder of intermediate tables, spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="gneiss-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage and fixes its partitions' contents."""
    path = new_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._gneiss_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables that cut() made and nothing reads any more."""
    for kept in tables:
        path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(kept._gneiss_path)
        path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

"""Tables in the folder that all executors share: intermediate ones that go again, and paths for the ones that are kept."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine if all of Spark runs on it (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "lodestone-shared")


_held: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder; what is written there is deleted when Python ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _held[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _held.pop(path, None)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, the work is done once, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, "t")
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    delete(df.sparkSession, df.stored_at)


@atexit.register
def sweep() -> None:
    """Deletes what new_path() named and nobody deleted. Tables made from it can't be read after this."""
    for path, spark in list(_held.items()):
        try:
            delete(spark, path)
        except Exception:  # the session is gone
            _held.pop(path, None)

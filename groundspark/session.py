"""What operators that iterate need from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one where it is unset and the master is local."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return (folder or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df in the shared folder; lineage ends there, and lost executors lose nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df as compressed columns in the shared folder, for tables as large as the input; rows may come back in another order.

    Files of the shuffles that made it go at once, not when the driver collects its garbage. `discard` removes the copy.
    """
    spark = df.sparkSession
    at, was = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    found = spark.read.schema(df.schema).parquet(at)
    found._stored_at = at
    return found


def discard(*frames: DataFrame) -> None:
    """Removes copies that `stored` made and that nothing will read again; other tables stay."""
    for df in frames:
        if at := getattr(df, "_stored_at", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.operators.joins import HOT, join_once, small  # noqa: F401  (the operators here use it too)

#: The two kinds of characters that contracts speak of: words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        if conf is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="shared-"))
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    return conf or set_.get()


def held(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder: lost executors cost no more than their running tasks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a URI or plain path, and the path in it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3:" if scheme in ("s3a", "s3n") else scheme + ":") + rest)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; JVM-side. A text without any has none."""
    trimmed = F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")

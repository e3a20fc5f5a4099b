"""Tables written in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary one, in local mode only."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sightline-')}"
        spark.conf.set(_KEY, base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/sightline/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read back: later jobs start from files, whichever executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files behind a table that :func:`saved` returned, when no later plan reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    base = f"{shared_dir(spark)}/sightline/"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = name.find("/sightline/")
        if at >= 0:
            path = jvm.org.apache.hadoop.fs.Path(base + name[at + len("/sightline/") :])
            path.getFileSystem(conf).delete(path, True)

"""Tables written in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """The URI of a new folder below the one that ``spark.checkpoint.dir`` names; in local mode below a temporary one where it is unset."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_KEY} must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sightline-')}"
        spark.conf.set(_KEY, base)
    return f"{base.rstrip('/')}/sightline/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str = "settled") -> DataFrame:
    """``df`` as a written table: later plans start from its files, whichever executors are lost.

    A checkpoint would keep the estimated size of the plan behind it, and over rounds of joins the product of such
    estimates grows beyond the driver's memory; files have their own size.
    """
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that :func:`settled` made, when no later plan reads them."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sightline/settled-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)

"""Tables in the folder that driver and executors share, where lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that spark.checkpoint.dir names, or a temporary one where it is unset and all run on one
    machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        root = f"file://{tempfile.mkdtemp(prefix='almanac-')}"
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a new shared folder, read back: what is decided once, such as which range a row fell in,
    stays decided, and a lost executor costs a re-read. The table goes when the application ends."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)

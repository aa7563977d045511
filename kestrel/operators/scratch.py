"""Tables that cut the lineage of iterative operators, in the folder all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; on a local master an own temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="kestrel-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kestrel-graph/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    spark, path = df.sparkSession, folder(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

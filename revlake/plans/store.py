"""Tables that cut lineage, in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, *layout: str) -> DataFrame:
    """Written once and read again; survives lost executors. layout: columns to partition the folders by, so that reads
    of few of their values touch few files."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="revlake-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/revlake/{uuid.uuid4().hex}"
    df.write.partitionBy(*layout).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

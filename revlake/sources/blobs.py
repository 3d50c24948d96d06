"""Content-addressed blobs: one stored row for each digest, verified when read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged(content: DataFrame, column: str) -> DataFrame:
    """(hash, size, bytes), one row for each different content."""
    body = F.col(column).cast("binary")
    return content.select(F.unhex(F.sha2(body, 256)).alias("hash"), F.octet_length(body).cast("long").alias("size"), body.alias("bytes")).dropDuplicates(["hash"])


def opened(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Versions with their bytes; a digest that does not fit fails the read."""
    checked = F.when(F.unhex(F.sha2("bytes", 256)) == F.col("hash"), F.col("bytes")).otherwise(F.raise_error(F.lit("content does not have its digest")))
    return versions.join(blobs.select("hash", "bytes"), "hash").withColumn("bytes", checked)

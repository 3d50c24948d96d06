"""Explicit schemas of the model and their attestation; nothing is inferred."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = (
    "tenant STRING, object_id BINARY, parent_id BINARY, revision BIGINT, metadata_revision BIGINT, content_revision BIGINT, name STRING, name_key STRING, kind TINYINT, mode BIGINT, size BIGINT, hash BINARY, link_target STRING, desired_revision BIGINT, observed_revision BIGINT, verified_revision BIGINT, applied_revision BIGINT, mount_visible BOOLEAN, file_provider_visible BOOLEAN, tombstone BOOLEAN"
)
CHANGES = ("tenant STRING, revision BIGINT, scope_kind TINYINT, presentation TINYINT, scope_parent BINARY, scope_domain STRING, scope_generation BIGINT, sequence BIGINT, kind TINYINT, object_id BINARY, object_revision BIGINT")
INBOX = ("authority STRING, sequence BIGINT, predecessor_sequence BIGINT, stream STRING, predecessor_event BIGINT, through_event BIGINT, root_epoch STRING, event_count BIGINT, payload_digest BINARY, payload BINARY")
#: A change row never uses this sequence: as a cursor it stands for a revision that is wholly read.
COMPLETE = 4294967295


class SchemaMismatch(ValueError):
    pass


def fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema).encode()).hexdigest()


def attested(df: DataFrame, ddl: str) -> DataFrame:
    """df, or SchemaMismatch if names, order or types differ."""
    schema = df.sparkSession.createDataFrame([], ddl).schema
    if fingerprint(df.schema) != fingerprint(schema):
        raise SchemaMismatch(f"{df.schema.simpleString()} is not {schema.simpleString()}")
    return df


def opened(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table of the store, read under its explicit schema once its files have been attested to have it."""
    attested(spark.read.parquet(path), ddl)
    return spark.read.schema(ddl).parquet(path)


def row_violations(versions: DataFrame) -> DataFrame:
    """Rows that break a rule of stored versions, with the first rule they break."""
    kind = {"file": 1, "directory": 2, "symlink": 3}
    rules = [
        ("identity", F.octet_length("object_id") != 16),
        ("revision", (F.col("revision") <= 0) | (F.col("metadata_revision") <= 0)),
        ("size", F.col("size") < 0),
        ("proof order", (F.col("desired_revision") < F.col("observed_revision")) | (F.col("observed_revision") < F.col("verified_revision")) | (F.col("verified_revision") < F.col("applied_revision"))),
        ("name", (F.col("name") == "") & (F.col("object_id") != F.col("parent_id"))),
        ("directory content", (F.col("kind") == kind["directory"]) & (F.col("content_revision") > 0)),
        ("file content", (F.col("kind") == kind["file"]) & ((F.col("content_revision") <= 0) | (F.col("link_target") != ""))),
        ("link", (F.col("kind") == kind["symlink"]) & ((F.col("size") != F.octet_length("link_target")) | (F.col("hash") != F.unhex(F.sha2(F.col("link_target").cast("binary"), 256))))),
    ]
    broken = F.coalesce(*(F.when(cond, F.lit(name)) for name, cond in rules))
    return versions.withColumn("rule", broken).where("rule IS NOT NULL")

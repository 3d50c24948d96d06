"""Token counts through a digest cache.

Texts are normalised natively (runs of ASCII white space to one space, which the tokenizer does itself), digested, and
joined with the stored counts of that digest and tokenizer version. Only one text of each digest that is not stored is
encoded; its count is appended to the cache. Copies, within a run or from run to run, are never encoded again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm import fasttokens
from revlake.llm.common import Stored

CACHE = "content string, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+", " ")


def read_cache(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CACHE)


def encode(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(content, text) to (content, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = fasttokens.words(tokenizer, "word")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(words.counts(batch.column(1).to_pylist()), pa.int64())], names=["content", "n_tokens"])

    return texts.mapInArrow(count, "content string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row.

    Defined cases: null text is empty (0 bytes, 0 tokens); repeated rows stay; a null doc_id stays null; an empty table
    gives no rows; other columns are not read. cache is a folder of Parquet files that is created or appended to; two
    runs that append the same digest at once leave equal rows, of which one is used.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    content = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    rows = Stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), content.alias("content")), "digests")
    # one row of each digest stands for it: the one with the least id
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    stands = rows.df.groupBy("content").agg(F.min("doc_id").alias("doc_id")).join(known.select("content"), "content", "left_anti")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), content.alias("digest"))
    # by digest and id, so that neither copies nor rows without id are a hot key
    same = (texts["digest"] == stands["content"]) & texts["id"].eqNullSafe(stands["doc_id"])
    fresh = encode(texts.join(stands.hint("merge"), same, "inner").select("content", "text"), tokenizer)
    fresh.groupBy("content").agg(F.min("n_tokens").alias("n_tokens")).select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    counted = F.coalesce("n_tokens", F.raise_error(F.lit("a digest has no count")).cast("long"))
    return rows.df.join(known, "content", "left").withColumn("n_tokens", counted).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

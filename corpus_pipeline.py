"""From raw documents to packed sequences: toxicity, line de-duplication, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents. A stage's result has to be written before the next stage is called, in run() and elsewhere:
the scratch tables that it reads go then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import public_tokenizers
from revlake.llm import common, jaccard_join, line_dedup, mixing, packing, toxicity
from revlake.llm.queries import WEIGHTS

TAG = "pipeline"
#: In the metadata of columns whose table lies in the order of the mixture.
MIXED = "revlake.mixed"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def swept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.sweep(spark, TAG)
        with common.tagged(TAG):
            return f(spark, docs, sf_dir)

    return swept


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator reads, and the others as one column, whose names then clash with no added one."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*(F.col(f"`{c}`") for c in others), F.lit(None).cast("int").alias("_")).alias("other"))


def back(docs: DataFrame, changed: dict[str, Column], *used: str) -> list[Column]:
    return [changed.get(c, F.col(c) if c in used else F.col("other").getField(c)).alias(c) for c in docs.columns]


@stage
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models take for toxic go. Null and empty texts, repeated rows that are not
    toxic, and rows without id stay; an empty table stays empty; other columns may have any names but `evidence`."""
    labelled = toxicity.label_rows(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), "toxic")
    return toxicity.reject(docs, labelled)


@stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike the first stays; a document keeps its row whatever is left of its text, and n_chars goes
    with it. Null texts stay null; rows equal in doc_id and text fare alike; an empty table stays empty."""
    out = line_dedup.dedup_lines(aside(docs, "doc_id", "text"))
    changed = {}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("other.n_chars"))
    return out.select(*back(docs, changed, "doc_id", "text"))


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of 0.8 on five-word shingles connect exactly one stays: the one with the least doc_id, rows
    without id last. Every row counts for itself, so repeated rows and copies without id are told apart. Texts without
    words are linked with nothing and stay; an empty table stays empty."""
    rows = common.stored(common.packed(docs).withColumn("rid", F.monotonically_increasing_id()), "near-rows")  # rid is final once stored
    parts = jaccard_join.jaccard_components(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), words=5, num=80, den=100)
    own = F.col("row.doc_id").cast("long")
    named = rows.select("rid", own.isNull().alias("nameless"), own.alias("id")).join(parts.select(F.col("doc_id").alias("rid"), "component_id"), "rid")
    first = named.groupBy("component_id").agg(F.min(F.struct("nameless", "id", "rid")).alias("first")).select("first.rid")
    return rows.join(first.hint("merge"), "rid", "left_semi").select("row.*")


def marked(docs: DataFrame, value: bool) -> list[Column]:
    """docs' columns, each said to be in the order of a mixture or in no order. Parquet keeps the word."""
    plain = {f.name: {k: v for k, v in f.metadata.items() if k != MIXED} for f in docs.schema}
    return [F.col(f"`{c}`").alias(c, metadata=m | ({MIXED: True} if value else {})) for c, m in plain.items()]


def placed(docs: DataFrame) -> DataFrame | None:
    """docs with their place in the table, `_place` from 0 without gaps, if the mixing stage has ordered them and they are
    nothing but that table read again: a file has its rows in order, and Spark's writer numbers the files in it."""
    if not docs.columns or not all(f.metadata.get(MIXED) for f in docs.schema) or docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        return None
    at = docs.select("*", F.regexp_extract("_metadata.file_name", r"^part-(\d+)-", 1).alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = at.groupBy("_part", "_file").agg(F.count("*").alias("_n"))
    if sizes.where("_part = ''").limit(1).count():
        return None  # some other writer's files
    before = Window.orderBy(F.col("_part").cast("int"), "_file").rowsBetween(Window.unboundedPreceding, -1)  # a row of each file
    base = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return at.join(F.broadcast(base), "_file").select(*(F.col(f"`{c}`") for c in docs.columns), (F.col("_base") + F.col("_row")).alias("_place"))


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture, which the written table keeps from file to file; its columns say so, and
    the packing stage takes its order from there. Repeated rows and rows without id or source are placed one by one; an
    empty table stays empty."""
    mixed = mixing.mix(aside(docs, "doc_id", "source"), WEIGHTS).orderBy("position").select(*back(docs, {}, "doc_id", "source"))
    return mixed.select(*marked(mixed, True))


@stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences follow the order that the mixing stage has given the table: groups are stretches of it. Rows that do not
    come from that stage's written result are mixed first. Null and empty texts are one piece with the separator; repeated
    rows and rows without id are packed one by one; an empty table gives no pieces."""
    tokenizer, rows = public_tokenizers.path("byte_bpe_50k.json"), placed(docs)
    if rows is None:
        return packing.pack_mixed(docs, tokenizer, WEIGHTS)
    return packing.pack_mixed(rows, tokenizer, WEIGHTS, position="_place")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: MinHash candidates, Kneser-Ney evidence and tokenizers are outside of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage_of in STAGES[:-1]:
        result = common.Stored(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = result.df, result
    return STAGES[-1][1](spark, docs, sf_dir)

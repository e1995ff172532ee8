"""Corpus pipeline: toxicity, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes each stage's result as
Parquet in the shared folder and rereads it; the table before goes once the next is written. Columns of documents, extra
ones included whatever their names, are kept to the last stage, which returns packed pieces.

Edge cases: null and empty texts are never toxic, near copies or cut, and pack as a single end id; rows with null doc_ids
go through every stage and stay apart by row number; of repeated rows (and of ties in doc_id) the first by doc_id and
then by row number stays; an empty table, or one that a stage empties, gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, secrets, suffix_dedup, toxicity
from tessera.llm.common import Stored, free_name, with_rid


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated model rejects go; the model learns from the labelled rows of this stage's input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    return toxicity.toxicity(docs, model, score, predicted).where(F.col(predicted) == 0).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the smallest doc_id stays; blank ones all stay."""
    rid = free_name(docs, "rid")
    rowed = with_rid(docs, rid)
    groups = ngram_join.jaccard_components(rowed.select(F.col(rid).alias("doc_id"), "text"), k=5, num=4, den=5)
    member = groups.select(F.col("doc_id").alias(rid), F.col("component_id").alias("group")).join(rowed.select(rid, F.col("doc_id").alias("id")), rid)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col(rid).alias("row"))).alias("first")
    kept = member.groupBy("group").agg(first).select(F.col("first.row").alias(rid))
    return rowed.join(kept, rid, "left_semi").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte of strings of 200 bytes that occur elsewhere; n_chars follows."""
    kept = suffix_dedup.suffix_dedup(docs)
    return kept.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; n_chars follows."""
    return secrets.redacted(docs, secrets.train(docs), length="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a packed sequence."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("suffix_dedup", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the stages; tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        after = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = after.df, after
    return docs

"""Corpus pipeline: ``documents`` in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; run() writes what a stage returns as Parquet in the shared
checkpoint folder and reads it again as the next stage's docs.  All stages but
the last return the columns of ``documents``; extra columns are carried along.
Empty tables, null texts, null ids and repeated rows go through every stage as
its operator defines them; a rejected, duplicate or contaminated document is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm import decontaminate, line_dedup, minhash, packing, pu_quality
from redactflow.llm.common import held_out, stage, table
from redactflow.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the training fold of the labels."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    model = pu_quality.fit(docs.where(~held_out("doc_id")), labels)
    return pu_quality.scored(docs, model).where("predicted = 1").select(*_names(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more hold; n_chars follows the text."""
    ship_package(spark)
    out = line_dedup.without_frequent_lines(docs, line_dedup.LineIndex.of(docs))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*_names(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id.

    Texts under one doc_id are documents of their own, told apart by their hash.
    Of rows with equal doc_id and text, the least by its other columns' JSON stays."""
    ship_package(spark)
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text_hash")))
    kept = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text")).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = stage(kept, "kept").withColumnRenamed("doc_id", "_kept")
    known = docs.withColumn("_key", key).join(kept, F.col("_key") == F.col("_kept"))
    order = F.to_json(F.struct(*_names(docs.drop("text"))))
    known = known.groupBy("_key").agg(F.min_by(F.struct(*_names(docs)), order).alias("_row")).select("_row.*")
    return known.union(docs.where("doc_id is null"))  # linked with nothing


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*_names(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship_package(spark)
    return packing.pack(docs, packing.tokenizer_path())


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_copies),
    ("benchmark_decontamination", benchmark),
    ("packing", sequences),
]
#: The stages have no SQL form; tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs

"""The file service: files in, redacted texts, metadata, audit and a summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.plans.scrub import ScrubConfig, scrub
from redactflow.sources.files import MAX_FILE_SIZE_MB, documents_and_quarantine, ingest_files
from redactflow.sources.sinks import audit_report_rows, file_stem, metadata_json_rows, output_names, run_report


def process_files(spark: SparkSession, path: str, out: str, cfg: ScrubConfig = ScrubConfig(),
                  max_file_size_mb: int = MAX_FILE_SIZE_MB, csv_header: bool = True) -> DataFrame:
    """Redact every file under ``path``; tables ``redacted``, ``metadata``, ``audit``,
    ``quarantine`` and ``run`` are written under ``out``, keyed by path and record.

    Returns one row per file: status (completed or rejected), file, file_name,
    file_size, file_hash, documents, entities_found, redactions_applied,
    by_type, output_files, message.  The scrub runs once; everything else is
    read from its written table.
    """
    ingest_files(spark, path, max_file_size_mb, csv_header).write.mode("overwrite").parquet(f"{out}/ingested")
    ingested = spark.read.parquet(f"{out}/ingested")
    docs, bad = documents_and_quarantine(ingested)
    bad.write.mode("overwrite").parquet(f"{out}/quarantine")
    scrub(docs, cfg=cfg).write.mode("overwrite").parquet(f"{out}/scrubbed")
    done = spark.read.parquet(f"{out}/scrubbed")
    keys = ("path", "file_name", "record")
    context = F.create_map(F.lit("file"), F.col("file_name"))
    done.select(*keys, "redacted_text").write.mode("overwrite").parquet(f"{out}/redacted")
    metadata_json_rows(done, keys).write.mode("overwrite").json(f"{out}/metadata")
    audit_report_rows(done, cfg.mode, keys, context).write.mode("overwrite").json(f"{out}/audit")
    stats, _ = run_report(done, cfg.mode, keys, context)
    stats.write.mode("overwrite").json(f"{out}/run")

    types = F.transform("entities", lambda x: x["entity_type"])
    by_type = (done.select("path", F.explode(types).alias("t")).groupBy("path", "t").agg(F.count("*").alias("n"))
               .groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("by_type")))
    per_file = done.groupBy("path", "file_name", "file_size_bytes", "file_hash").agg(
        F.count("*").alias("documents"), F.sum(F.size("entities")).cast("long").alias("entities_found"),
        F.sum(F.size("redaction_metadata")).cast("long").alias("redactions_applied"))
    names = output_names(file_stem(F.col("file_name")))
    good = per_file.join(by_type, "path", "left").select(
        F.lit("completed").alias("status"), F.col("path").alias("file"), "file_name", F.col("file_size_bytes").alias("file_size"),
        "file_hash", "documents", "entities_found", "redactions_applied",
        F.coalesce("by_type", F.create_map().cast("map<string,bigint>")).alias("by_type"),
        F.array(names["redacted"], names["metadata"], names["audit"]).alias("output_files"), F.lit(None).cast("string").alias("message"))
    none = F.lit(0).cast("long")
    rejected = spark.read.parquet(f"{out}/quarantine").select(
        F.lit("rejected").alias("status"), F.col("path").alias("file"), "file_name", F.col("file_size_bytes").alias("file_size"),
        "file_hash", none.alias("documents"), none.alias("entities_found"), none.alias("redactions_applied"),
        F.create_map().cast("map<string,bigint>").alias("by_type"), F.array().cast("array<string>").alias("output_files"), "message")
    return good.unionByName(rejected)

"""Structured Streaming forms of the scrub.

``stream_scrub`` is the narrow document-row plan (no shuffle, no state), so
it runs in append mode.  ``stream_entity_counts`` and ``stream_feedback_stats``
are stateful aggregates: event-time windows with a watermark, so state for
closed windows is dropped and late rows beyond the watermark are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from redactflow.plans.scrub import ScrubConfig, detect, scrub
from redactflow.session import shared_dir


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def stream_scrub(stream: DataFrame, cfg: ScrubConfig = ScrubConfig(), text_col: str = "text",
                 id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Redacted documents of a stream (stateless; append mode)."""
    out = scrub(stream, text_col, cfg, with_metadata=False)
    return out.select(*id_cols, "redacted_text", F.size("entities").alias("entities_found"))


def stream_entity_counts(stream: DataFrame, ts_col: str, text: Column, window: str = "1 hour",
                         watermark: str = "1 hour", cfg: ScrubConfig = ScrubConfig()) -> DataFrame:
    """Entity counts per tumbling event-time window and type."""
    docs = stream.select(F.col(ts_col).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("doc_id"),
                         text.alias("text"))
    # posexplode_outer: explode would infer a size() > 0 filter and run the detection a second time for it
    ents = detect(docs, cfg=cfg).select("ts", F.posexplode_outer("entities").alias("p", "x")).where(F.col("p").isNotNull())
    return (ents.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), F.col("x.entity_type").alias("entity_type"))
            .agg(F.count(F.lit(1)).alias("n")))


def stream_feedback_stats(feedback_stream: DataFrame) -> DataFrame:
    """Running count per feedback type (update or complete mode)."""
    return feedback_stream.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))


def run_pseudonyms(stream: DataFrame, path: str, checkpoint: str, cfg: ScrubConfig = ScrubConfig(), text_col: str = "text",
                   id_cols: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Redact a stream with pseudonyms that hold over all of it: (documents, dictionary).

    The state across micro-batches is the dictionary, an append-only table in
    which a batch's new keys are the version of its number (``path/names``).  A
    batch numbers only keys that no earlier version has, from each prefix's
    highest number on, so a key has one name for good.  A repeated batch
    reads the versions before its own and rewrites itself, both in the
    dictionary and in ``path/documents``: a restart neither doubles nor renames.
    Over all batches the names are those of one batch run over the documents in the
    order in which they came.  The dictionary is spread by key: a state store keyed by
    prefix would number all names of a type in one task.
    """
    from redactflow.operators import redact as R
    from redactflow.operators.report import PSEUDONYM_SCHEMA, store_pseudonyms
    from redactflow.plans.versions import read_versions, write_version
    from redactflow.session import cut_lineage

    spark, ids = stream.sparkSession, list(id_cols)

    def batch(docs: DataFrame, number: int) -> None:
        found = cut_lineage(detect(docs.select(*ids, text_col), text_col, cfg))
        rows = found.select(*ids, F.posexplode_outer(R.redaction_order(F.col("entities"))).alias("seq", "x")).where(F.col("seq").isNotNull())
        rows = rows.select(*ids, F.col("seq").cast("long").alias("seq"), "x", F.col("x.text").alias("text"), F.col("x.entity_type").alias("entity_type"))
        names = store_pseudonyms(rows.select(*ids, "seq", "text", "entity_type"), f"{path}/names", number, (*ids, "seq"))
        named = rows.join(names.select("text", "entity_type", "pseudonym"), ["text", "entity_type"])
        arrays = named.groupBy(*ids).agg(F.collect_list(F.col("x").withField("replacement", F.col("pseudonym"))).alias("_named"))
        plain = F.transform("entities", lambda x: x.withField("replacement", F.lit(None).cast("string")))
        out = found.join(arrays, ids, "left").withColumn("entities", F.coalesce("_named", plain))
        write_version(out.select(*ids, R.redact_text(F.col(text_col), F.col("entities")).alias("redacted_text"),
                                 F.size("entities").alias("entities_found")), f"{path}/documents", number)

    q = (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start())
    q.awaitTermination()
    kinds = ", ".join(f"{c} {dict(stream.dtypes)[c]}" for c in ids)
    return read_versions(spark, f"{path}/documents", f"{kinds}, redacted_text string, entities_found int"), read_versions(spark, f"{path}/names", PSEUDONYM_SCHEMA)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over everything available now into an in-memory table of
    the driver: for tests and small looks only.

    The checkpoint lives under the shared checkpoint folder, so a restarted
    driver resumes from the committed offsets.
    """
    spark = df.sparkSession
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", shared_dir(spark, f"stream-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    q = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_updates(df: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over everything available now, in update mode,
    and return its latest row per key.

    Each micro-batch writes the rows that changed as ``path/batch=<id>``;
    a repeated batch overwrites its own folder, so a restart doubles nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    values = [c for c in df.columns if c not in keys]
    written = df.sparkSession.read.schema(df.schema.add("batch", "long")).parquet(path)
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")

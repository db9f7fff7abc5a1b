"""Writers for scrub results: redacted text, metadata (JSON / CSV), audit reports.

Every writer takes a DataFrame and a directory; output is keyed by the
document id, so two inputs with one name never overwrite each other.  By
default the metadata leaves out the original text of each entity: a
redaction report that carries the data it redacts defeats its purpose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.functions.arrays import let
from redactflow.operators.redact import redaction_order
from redactflow.plans.scrub import SERVICE_STANDARDS

# FIXED VALUES: output name suffixes and the supported export formats.
SUFFIX_REDACTED = "_redacted.txt"
SUFFIX_METADATA = "_metadata.json"
SUFFIX_AUDIT = "_audit.json"
EXPORT_FORMATS = ("txt", "json", "csv")


def output_names(stem: Column) -> Column:
    """struct of the three output names for a file stem."""
    return F.struct(F.concat(stem, F.lit(SUFFIX_REDACTED)).alias("redacted"),
                    F.concat(stem, F.lit(SUFFIX_METADATA)).alias("metadata"),
                    F.concat(stem, F.lit(SUFFIX_AUDIT)).alias("audit"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _without_original(metadata: Column) -> Column:
    return F.transform(metadata, lambda m: m.dropFields("original_text"))


def write_redacted_text(scrubbed: DataFrame, path: str, id_cols: Sequence[str] = ("doc_id",)) -> None:
    scrubbed.select(*id_cols, "redacted_text").write.mode("overwrite").parquet(path)


def _pseudonym_map(entities: Column) -> Column:
    """``text_type`` -> pseudonym; where two (text, type) pairs spell one key,
    the pair met last in redaction order wins."""
    pseudo = F.filter(redaction_order(entities), lambda x: F.coalesce(x["replacement"].startswith("USER_"), F.lit(False)))
    pairs = F.array_distinct(F.transform(pseudo, lambda x: F.struct(x["text"], x["entity_type"], x["replacement"])))
    keyed = F.array_sort(F.transform(pairs, lambda x, i: F.struct(
        F.concat(x["text"], F.lit("_"), x["entity_type"]).alias("k"), (-i).alias("at"), x["replacement"].alias("v"))))
    last = let(keyed, lambda k: F.filter(k, lambda x, i: F.coalesce(F.get(k, i - 1)["k"] != x["k"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def metadata_json_rows(scrubbed: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                       include_original: bool = False) -> DataFrame:
    """redacted_text, redaction_metadata, pseudonym_map, export_timestamp; one
    row per document.  The map's keys spell the original texts, so it is there
    only with ``include_original`` (else null, and left out of the JSON)."""
    md = F.col("redaction_metadata") if include_original else _without_original(F.col("redaction_metadata"))
    pseudonyms = _pseudonym_map(F.col("entities")) if include_original else F.lit(None).cast("map<string,string>")
    return scrubbed.select(*id_cols, "redacted_text", md.alias("redaction_metadata"), pseudonyms.alias("pseudonym_map"),
                           F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("export_timestamp"))


def write_metadata_json(scrubbed: DataFrame, path: str, id_cols: Sequence[str] = ("doc_id",),
                        include_original: bool = False) -> None:
    metadata_json_rows(scrubbed, id_cols, include_original).write.mode("overwrite").json(path)


def metadata_csv_rows(scrubbed: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                      include_original: bool = False) -> DataFrame:
    rows = (scrubbed.select(*id_cols, F.posexplode_outer("redaction_metadata").alias("seq", "m"))
            .where(F.col("seq").isNotNull()))
    cols = [*id_cols, "seq"] + (["m.original_text"] if include_original else []) + [
        F.col("m.entity_type").alias("entity_type"), F.col("m.replacement").alias("replacement"),
        F.col("m.position.start").alias("position_start"), F.col("m.position.end").alias("position_end"),
        F.col("m.confidence").alias("confidence")]
    return rows.select(*cols)


def write_metadata_csv(scrubbed: DataFrame, path: str, id_cols: Sequence[str] = ("doc_id",),
                       include_original: bool = False) -> bool:
    """Flattened metadata rows as CSV with a header; ``False`` when there are none."""
    rows = metadata_csv_rows(scrubbed, id_cols, include_original)
    rows.write.mode("overwrite").option("header", True).csv(path)
    return not scrubbed.sparkSession.read.option("header", True).csv(path).isEmpty()  # of what was written, not a second run


def audit_report_rows(scrubbed: DataFrame, mode: str, id_cols: Sequence[str] = ("doc_id",),
                      context: Column | None = None, standards: Sequence[str] = SERVICE_STANDARDS,
                      generate_audit_log: bool = True) -> DataFrame:
    """One audit report per document: report_timestamp, redaction_stats,
    audit_log (one entry per redaction), compliance_certifications."""
    ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ctx = context if context is not None else F.create_map(F.lit("source"), F.lit("text_input"))
    log = F.transform(F.col("redaction_metadata"), lambda m: F.struct(
        ts.alias("timestamp"), m["entity_type"].alias("entity_type"), m["confidence"].alias("confidence"),
        F.lit(mode).alias("replacement_mode"), ctx.alias("context")))
    if not generate_audit_log:
        log = F.slice(log, 1, 0)
    n = F.size("redaction_metadata").cast("long")
    pseudo = F.size(F.array_distinct(F.transform(
        F.filter(F.col("entities"), lambda x: F.coalesce(x["replacement"].startswith("USER_"), F.lit(False))),
        lambda x: F.struct(x["text"], x["entity_type"])))).cast("long")
    stats = F.struct(n.alias("total_redacted"), F.size(log).cast("long").alias("audit_entries"),
                     pseudo.alias("pseudonym_mappings"), ts.alias("generation_time"))
    return scrubbed.select(*id_cols, ts.alias("report_timestamp"), stats.alias("redaction_stats"),
                           log.alias("audit_log"),
                           F.array(*[F.lit(s) for s in standards]).alias("compliance_certifications"))


def write_audit_report(scrubbed: DataFrame, path: str, mode: str, **kw) -> None:
    audit_report_rows(scrubbed, mode, **kw).write.mode("overwrite").json(path)


def run_report(scrubbed: DataFrame, mode: str, id_cols: Sequence[str] = ("doc_id",), context: Column | None = None,
               standards: Sequence[str] = SERVICE_STANDARDS) -> tuple[DataFrame, DataFrame]:
    """One report for a whole run: (one row of its statistics, one row per audit entry).
    The log of a run has no bound, so it is a table and not an array."""
    each = audit_report_rows(scrubbed, mode, id_cols, context, standards)
    stats = each.agg(F.coalesce(F.sum("redaction_stats.total_redacted"), F.lit(0)).alias("total_redacted"),
                     F.coalesce(F.sum("redaction_stats.audit_entries"), F.lit(0)).alias("audit_entries"),
                     F.coalesce(F.sum("redaction_stats.pseudonym_mappings"), F.lit(0)).alias("pseudonym_mappings"))
    ts = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stats = stats.select(ts.alias("report_timestamp"), "*", F.array(*[F.lit(s) for s in standards]).alias("compliance_certifications"))
    log = each.select(*id_cols, F.posexplode_outer("audit_log").alias("seq", "entry")).where(F.col("seq").isNotNull())
    return stats, log.select(*id_cols, "seq", "entry.*")


def write_run_report(scrubbed: DataFrame, path: str, mode: str, **kw) -> None:
    stats, log = run_report(scrubbed, mode, **kw)
    stats.write.mode("overwrite").json(f"{path}/summary")
    log.write.mode("overwrite").json(f"{path}/audit_log")


def write_outputs(scrubbed: DataFrame, path: str, fmt: str, **kw) -> bool:
    """Dispatch on the export format: txt, json or csv."""
    if fmt == "txt":
        write_redacted_text(scrubbed, path, **kw)
        return True
    if fmt == "json":
        write_metadata_json(scrubbed, path, **kw)
        return True
    if fmt == "csv":
        return write_metadata_csv(scrubbed, path, **kw)
    raise ValueError(f"Unsupported format: {fmt}")

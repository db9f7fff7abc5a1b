"""The scrub plan: documents in, entity arrays / redacted text / metadata out.

Shape: every stage is a projection of the document row (windows, spans,
dedups, boost, splice), so a whole scrub is one narrow stage: scan ->
project -> write, with no exchange.  The entity table is an ``explode`` of
the row's array.  Aggregates over entities (reports) then shuffle only
partial aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactflow.functions.arrays import memoized
from redactflow.functions.text import WINDOW_OVERLAP, WINDOW_SIZE, normalize_text
from redactflow.operators import detect as D
from redactflow.operators import redact as R
from redactflow.operators.boost import context_boost
from redactflow.operators.rules import (
    DEFAULT_RULES, SERVICE_THRESHOLD, Rule, active_rules, with_guards,
)

# FIXED VALUES: compliance standards named by the service pipeline.
SERVICE_STANDARDS = ("gdpr", "hipaa", "ccpa", "dpdp")


@dataclass(frozen=True)
class ScrubConfig:
    mode: str = "full"
    pseudonymize: bool = False
    threshold: float = SERVICE_THRESHOLD
    window_size: int = WINDOW_SIZE
    overlap: int = WINDOW_OVERLAP
    normalize: bool = False
    boost: bool = True
    guards: bool = True
    generate_audit_log: bool = True
    compliance_standards: tuple[str, ...] = SERVICE_STANDARDS
    rules: tuple[Rule, ...] = field(default=DEFAULT_RULES)

    def plan_rules(self) -> tuple[Rule, ...]:
        return with_guards(active_rules(self.threshold, self.rules), self.guards)


def entities_expr(text: Column, cfg: ScrubConfig, external: Column | None = None) -> Column:
    """Final entity array of a document, in document order.  The mode does not
    change detection, so one built expression serves every mode."""
    from dataclasses import replace as _replace
    return _entities_expr(text, _replace(cfg, mode="full", pseudonymize=False), external)


@memoized
def _entities_expr(text: Column, cfg: ScrubConfig, external: Column | None = None) -> Column:
    ents = D.drop_handles_in_urls(D.dedup_document_spans(
        D.detect_windows(text, cfg.plan_rules(), cfg.window_size, cfg.overlap, external=external)))
    if cfg.boost:
        ents = context_boost(ents, text)
    return F.coalesce(ents, F.array().cast(D.ENTITIES_TYPE))  # a null text has no entities


def detect(df: DataFrame, text_col: str = "text", cfg: ScrubConfig = ScrubConfig(),
           out_col: str = "entities", external_col: str | None = None) -> DataFrame:
    """Adds the entity array; replaces ``text_col`` by its normalized form when
    ``cfg.normalize``.  ``external_col`` names an array column of external
    entity structs (see ``union_external_spans``)."""
    if cfg.normalize:
        df = df.withColumn(text_col, normalize_text(F.col(text_col)))
    ext = F.col(external_col) if external_col else None
    return df.withColumn(out_col, entities_expr(F.col(text_col), cfg, ext))


def union_external_spans(docs: DataFrame, spans: DataFrame, cfg: ScrubConfig = ScrubConfig(),
                         key: str = "doc_id") -> DataFrame:
    """Attach spans of an external detector (``key, s, e, text, entity_type,
    score``, document offsets; ``rank`` too where several detectors differ,
    else 12) to the documents as an entity array column ``external``; scores
    below the threshold are dropped.

    The spans are grouped per document (bounded by the document's size) and
    joined on the key: a shuffle of both sides unless the tables share a
    bucketing on the key.
    """
    ent = D.external_entities(F.col("s"), F.col("e"), F.col("text"), F.col("entity_type"), F.col("score"),
                              cfg.threshold, F.col("rank") if "rank" in spans.columns else 12)
    per_doc = (spans.select(key, ent.alias("x")).where(F.col("x").isNotNull())
               .groupBy(key).agg(F.collect_list("x").alias("external")))
    return (docs.join(per_doc, key, "left")
            .withColumn("external", F.coalesce(F.col("external"), F.array().cast(D.ENTITIES_TYPE))))


def scrub(df: DataFrame, text_col: str = "text", cfg: ScrubConfig = ScrubConfig(),
          with_metadata: bool = True, timestamp: Column | None = None,
          include_original: bool = True) -> DataFrame:
    """Adds ``entities`` (with replacements), ``redacted_text`` and, if asked,
    ``redaction_metadata``."""
    out = detect(df, text_col, cfg)
    out = out.withColumn("entities", R.with_replacements(F.col("entities"), cfg.mode, cfg.pseudonymize))
    out = out.withColumn("redacted_text", R.redact_text(F.col(text_col), F.col("entities")))
    if with_metadata:
        out = out.withColumn("redaction_metadata", R.redaction_metadata(
            F.col("entities"), timestamp, include_original))
    return out


def entity_rows(df: DataFrame, id_cols: Sequence[str] = ("doc_id",), col: str = "entities",
                extra: Sequence[str] = ()) -> DataFrame:
    """The entity table: one row per entity, ``idx`` = position in document order.

    ``posexplode_outer`` + a null filter, not ``posexplode``: for an inner
    generator Catalyst infers ``size(entities) > 0`` and pushes it below any
    exchange, which would run the whole detection twice.
    """
    base = (df.select(*id_cols, *extra, F.posexplode_outer(col).alias("idx", "x"))
            .where(F.col("idx").isNotNull()))
    cols = [F.col(c) for c in id_cols] + [F.col(c) for c in extra] + [
        F.col("idx").cast("long").alias("idx"),
        F.col("x.text").alias("text"),
        F.col("x.entity_type").alias("entity_type"),
        F.col("x.s").cast("long").alias("start_char"),
        F.col("x.e").cast("long").alias("end_char"),
        F.col("x.confidence").alias("confidence"),
        F.col("x.source").alias("source"),
        F.col("x.window_id").cast("long").alias("window_id"),
    ]
    if "replacement" in [f.name for f in df.schema[col].dataType.elementType.fields]:
        cols.append(F.col("x.replacement").alias("replacement"))
    return base.select(*cols)


def entity_table(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",),
                 cfg: ScrubConfig = ScrubConfig(), extra: Sequence[str] = ()) -> DataFrame:
    return entity_rows(detect(df.select(*id_cols, *extra, text_col), text_col, cfg), id_cols,
                       extra=extra)

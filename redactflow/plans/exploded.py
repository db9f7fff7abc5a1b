"""The exploded plan: windows and spans as rows, one shuffle of span rows.

Same rules and results as the document-row plan (``plans.scrub``), shaped for
entity tables of corpora with very large documents:

    documents --explode windows--> window rows  [optional spread: windows of one
                                                 document go to many tasks]
      --rules, window dedup, boost (window carries +-100 chars of context)-->
    span rows --repartition(doc_id)--> document dedup (groupBy) + handle removal
      (running max of URL ends) + order (row_number), all on that partitioning

Only span rows cross the shuffle, never the text.  The confidence boost is
taken per window before the document dedup: it depends only on the span and
the text around it and never decreases the order of confidences, so boosting
the maximum equals the maximum of the boosted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.functions.arrays import let
from redactflow.functions.spans import MARK, with_free_mark
from redactflow.functions.text import CONTEXT_RADIUS, context_windows
from redactflow.operators import detect as D
from redactflow.operators.boost import anchor_boost, BOOST_CAP
from redactflow.plans.scrub import ScrubConfig


def _boost_in_window(ents: Column, w: Column) -> Column:
    """Boost spans (window offsets) using the window's widened context."""
    def one(x):
        s = x["s"] + w["start_char"]
        e = x["e"] + w["start_char"]
        lo = F.greatest(s - CONTEXT_RADIUS, F.lit(0))
        sl = F.lower(F.substring(w["context"], lo - w["context_start"] + 1, e + CONTEXT_RADIUS - lo))
        return x.withField("confidence", F.least(x["confidence"] + anchor_boost(sl), F.lit(BOOST_CAP)))
    return F.transform(ents, one)


def entity_table_exploded(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          cfg: ScrubConfig = ScrubConfig(), partitions: int | None = None,
                          spread_windows: int | None = None) -> DataFrame:
    """Entity rows (id, idx, text, entity_type, start_char, end_char,
    confidence, source, window_id), equal to ``entity_rows(detect(...))``.

    ``spread_windows``: repartition window rows over that many tasks before
    the rules run (a shuffle of window text, worth it when a few documents
    are very large); by default windows stay in the task that read them.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = cfg.plan_rules()
    guard = D.combined_guard(rules)
    anchored = [r for r in rules if r.anchored]
    ctx = CONTEXT_RADIUS if cfg.boost else 0

    wins = (docs.select(id_col, F.posexplode_outer(
        context_windows(F.col(text_col), cfg.window_size, cfg.overlap, context=ctx)).alias("pos", "w"))
        .where(F.col("pos").isNotNull()).select(id_col, "w"))
    if spread_windows:
        wins = wins.repartition(spread_windows, id_col, F.col("w.window_id"))
    w = F.col("w")

    def detect_in(use) -> Column:
        def ents(mark: Column | None) -> Column:
            found = D.union_detectors(w["content"], use, w["window_id"], mark=mark)
            return D.dedup_window_spans(found) if len(use) > 1 else found

        return with_free_mark(w["content"], cfg.window_size, w["content"].contains(MARK), ents)

    ents = detect_in(rules)
    if guard is not None:
        few = detect_in(anchored) if anchored else F.array().cast(D.ENTITIES_TYPE)
        ents = F.when(D.prefilter(w["content"], guard), ents).otherwise(few)
    if cfg.boost:
        ents = let(ents, lambda found: _boost_in_window(found, w))
    spans = (wins.select(id_col, w["start_char"].alias("ws"), F.posexplode_outer(ents).alias("p", "x"))
             .where(F.col("p").isNotNull())
             .select(id_col, (F.col("x.s") + F.col("ws")).alias("s"), (F.col("x.e") + F.col("ws")).alias("e"),
                     F.col("x.text").alias("text"), F.col("x.entity_type").alias("entity_type"),
                     F.col("x.confidence").alias("confidence"), F.col("x.source").alias("source"),
                     F.col("x.window_id").alias("window_id")))

    # One shuffle of span rows on the document id; the aggregate and both
    # windows below are satisfied by this partitioning, so none adds another.
    dd = (spans.repartition(n, id_col)
          .groupBy(id_col, "s", "e", "entity_type", "text")
          .agg(F.max("confidence").alias("confidence"), F.min("window_id").alias("window_id"),
               F.min("source").alias("source")))
    by_start = Window.partitionBy(id_col).orderBy(
        "s", F.when(F.col("entity_type") == "URL", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    url_reach = F.max(F.when(F.col("entity_type") == "URL", F.col("e"))).over(by_start)
    kept = (dd.withColumn("_reach", url_reach)
            .where(~((F.col("entity_type") == "PROFILE_HANDLE") & (F.coalesce(F.col("_reach"), F.lit(-1)) >= F.col("e")))))
    order = Window.partitionBy(id_col).orderBy("s", "e", "window_id")
    return kept.select(
        id_col, (F.row_number().over(order) - 1).cast("long").alias("idx"), "text", "entity_type",
        F.col("s").cast("long").alias("start_char"), F.col("e").cast("long").alias("end_char"),
        "confidence", "source", F.col("window_id").cast("long").alias("window_id"))

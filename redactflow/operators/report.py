"""Reports over the entity table and the feedback / knowledge tables.

Aggregations are plain ``groupBy``/``rollup``: Spark combines map-side, so
only one partial row per key and task is shuffled.  Per-document summaries
are computed on the document row itself and need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactflow.functions.masks import pseudonym_prefix

# FIXED VALUES: feedback kinds counted by the zero-filled statistics form,
# defaults of a feedback record, and the audit contexts of the two entry points.
FEEDBACK_TYPES = ("missed", "over_scrubbed", "correct")
DEFAULT_DOMAIN = "general"
DEFAULT_USER = "system"
TEXT_INPUT_CONTEXT = ("source", "text_input")
FILE_CONTEXT_KEY = "file"


# ---- distributions and summaries ----------------------------------------------

def entity_distribution(entities: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts by ``by`` and type over entity rows (a shuffle of partial counts)."""
    return entities.groupBy(*by, "entity_type").agg(F.count(F.lit(1)).alias("n"))


def entity_distribution_rows(detected: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                             col: str = "entities") -> DataFrame:
    """Per-document counts by type read from each row's entity array: no shuffle."""
    return (detected.select(*id_cols, F.explode(type_counts(F.col(col))).alias("c"))
            .select(*id_cols, F.col("c.entity_type").alias("entity_type"), F.col("c.n").alias("n")))


def entity_distribution_corpus(entities: DataFrame, dims: Sequence[str] = ("lang",)) -> DataFrame:
    """Counts by type with subtotals over ``dims`` (ROLLUP: dims..., type).
    Rows are counted at the finest grain first; only that small table is rolled up."""
    finest = entities.groupBy(*dims, "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return finest.rollup(*dims, "entity_type").agg(F.sum("n").alias("n"))


def type_counts(entities: Column) -> Column:
    """``array<struct<entity_type, n>>`` of a row's entity array, sorted by type."""
    types = F.transform(entities, lambda x: x["entity_type"])
    return F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(
        t.alias("entity_type"), F.size(F.filter(types, lambda y: y == t)).cast("long").alias("n")))


def by_type_map(entities: Column) -> Column:
    return F.map_from_entries(type_counts(entities))


def by_type_text(entities: Column) -> Column:
    """``TYPE:n,TYPE:n`` in type order (stable text form of the map)."""
    return F.array_join(F.transform(type_counts(entities), lambda c: F.concat(
        c["entity_type"], F.lit(":"), c["n"].cast("string"))), ",")


def document_summary(scrubbed: DataFrame, id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """entities_found, redactions_applied (equal by construction), by_type; on the row."""
    return scrubbed.select(
        *id_cols,
        F.size("entities").cast("long").alias("entities_found"),
        F.size(F.coalesce("redaction_metadata", F.col("entities"))).cast("long").alias("redactions_applied"),
        by_type_map(F.col("entities")).alias("by_type"),
    )


def run_metrics(scrubbed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents, entities, redactions, distinct types, characters.

    One aggregate over the document rows with their distinct types exploded;
    document-level sums count only the first exploded row of a document.
    """
    per_doc = scrubbed.select(
        F.size("entities").alias("k"), F.length(text_col).alias("chars"),
        F.posexplode_outer(F.array_distinct(F.transform("entities", lambda x: x["entity_type"])))
        .alias("pos", "etype"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return per_doc.agg(
        F.count_if(first).alias("documents"),
        F.sum(F.when(first, F.col("k"))).cast("long").alias("entities"),
        F.sum(F.when(first, F.col("k"))).cast("long").alias("redactions"),
        F.countDistinct("etype").cast("long").alias("distinct_types"),
        F.sum(F.when(first, F.col("chars"))).cast("long").alias("characters_processed"),
    )


def redaction_stats(entities: DataFrame, pseudonyms: DataFrame | None = None,
                    generate_audit_log: bool = True) -> DataFrame:
    """total_redacted, audit_entries, pseudonym_mappings (one row)."""
    stats = entities.agg(F.count(F.lit(1)).alias("total_redacted"))
    stats = stats.withColumn("audit_entries", F.col("total_redacted") if generate_audit_log else F.lit(0).cast("long"))
    n_ps = pseudonyms.count() if pseudonyms is not None else 0
    return stats.withColumn("pseudonym_mappings", F.lit(n_ps).cast("long"))


def redaction_stats_rows(detected: DataFrame, col: str = "entities", generate_audit_log: bool = True) -> DataFrame:
    """``redaction_stats`` from document rows: sums of array sizes, no explode."""
    n = F.sum(F.size(col)).cast("long")
    return detected.agg(n.alias("total_redacted"),
                        (n if generate_audit_log else F.lit(0).cast("long")).alias("audit_entries"),
                        F.lit(0).cast("long").alias("pseudonym_mappings"))


def audit_log(entities: DataFrame, mode: str, context: Column | None = None,
              timestamp: Column | None = None) -> DataFrame:
    """One row per redaction: type, confidence, mode, context map (and a timestamp)."""
    ctx = context if context is not None else F.create_map(F.lit(TEXT_INPUT_CONTEXT[0]), F.lit(TEXT_INPUT_CONTEXT[1]))
    cols = [c for c in ("doc_id", "seq") if c in entities.columns] + [
        F.col("entity_type"), F.col("confidence"), F.lit(mode).alias("replacement_mode"), ctx.alias("context")]
    if timestamp is not None:
        cols.append(timestamp.alias("timestamp"))
    return entities.select(*cols)


# ---- pseudonyms over a corpus -----------------------------------------------------

#: A dictionary entry: ``number`` counts the names of one prefix.
PSEUDONYM_SCHEMA = "text string, entity_type string, prefix string, number long, pseudonym string"


def extend_pseudonyms(known: DataFrame | None, entities: DataFrame, order_cols: Sequence[str] = ("doc_id", "seq"),
                      ranges: int | None = None) -> DataFrame:
    """The entries (``PSEUDONYM_SCHEMA``) that ``entities`` add to the dictionary ``known``.

    ``n`` of ``USER_<TYP>_<n>`` numbers keys of one prefix by first encounter
    (``order_cols``), from the highest known number of the prefix on; known
    keys keep their names.  The distinct new keys are range-partitioned by
    (prefix, first encounter) and numbered within their range; what each range
    adds comes from a table of (ranges x prefixes) counts, whose size doesn't
    depend on the corpus.  So a type of a third of all keys spreads over
    ranges like any other.
    """
    from redactflow.plans.joins import by_shuffle
    from redactflow.session import cut_lineage

    spark = entities.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = entities.groupBy("text", "entity_type").agg(F.min(F.struct(*order_cols)).alias("first"))
    if known is not None:
        first = first.join(by_shuffle(known.select("text", "entity_type")), ["text", "entity_type"], "left_anti")
    first = first.withColumn("prefix", pseudonym_prefix(F.col("entity_type")))
    # the range of a row is fixed here, once, for both branches below
    ranged = cut_lineage(first.repartitionByRange(n, "prefix", "first", "text", "entity_type")
                         .withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("prefix", "range").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("prefix").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("prefix", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    if known is not None:
        highest = known.groupBy("prefix").agg(F.max("number").alias("highest"))
        offsets = (offsets.join(highest, "prefix", "left")
                   .select("prefix", "range", (F.col("offset") + F.coalesce("highest", F.lit(0))).alias("offset")))
    local = ranged.withColumn("local", F.row_number().over(
        Window.partitionBy("range", "prefix").orderBy("first", "text", "entity_type")))
    number = (F.col("offset") + F.col("local")).cast("long")
    # ranges x prefixes rows; left to the planner, which takes them for far more, the keys would be broadcast instead
    return (local.join(F.broadcast(offsets), ["prefix", "range"])
            .select("text", "entity_type", "prefix", number.alias("number"),
                    F.concat(F.col("prefix"), F.lit("_"), number.cast("string")).alias("pseudonym")))


def pseudonymize_corpus(entities: DataFrame, order_cols: Sequence[str] = ("doc_id", "seq"), ranges: int | None = None) -> DataFrame:
    """One dictionary ``(text, type) -> USER_<TYP>_<n>`` for the whole corpus (see ``extend_pseudonyms``)."""
    return extend_pseudonyms(None, entities, order_cols, ranges).select("text", "entity_type", "pseudonym")


def store_pseudonyms(entities: DataFrame, path: str, version: int, order_cols: Sequence[str] = ("doc_id", "seq"),
                     ranges: int | None = None) -> DataFrame:
    """Add the new keys of ``entities`` as ``version`` of the dictionary table at ``path`` and return the whole dictionary.

    The table only grows: a version reads the ones before it, so names given
    once never change, and running a version again gives the same entries."""
    from redactflow.plans.versions import read_versions, write_version

    spark = entities.sparkSession
    known = read_versions(spark, path, PSEUDONYM_SCHEMA, before=version)
    write_version(extend_pseudonyms(known, entities, order_cols, ranges), path, version)
    return read_versions(spark, path, PSEUDONYM_SCHEMA, before=version + 1)


def with_corpus_pseudonyms(detected: DataFrame, key: str = "doc_id", col: str = "entities") -> DataFrame:
    """``detected`` with each entity's replacement from the corpus dictionary.

    Entity rows meet the dictionary in a join on (text, type), which adaptive
    execution splits where one key is frequent, and go back to their document
    as one array; texts join them on ``key`` only.
    """
    from redactflow.operators.redact import redaction_order
    from redactflow.plans.joins import by_shuffle
    from redactflow.session import cut_lineage

    docs = cut_lineage(detected)
    ordered = docs.select(key, F.posexplode_outer(redaction_order(F.col(col))).alias("seq", "x")).where(F.col("seq").isNotNull())
    rows = ordered.select(F.col(key).alias("doc_id"), F.col("seq").cast("long").alias("seq"), "x",
                          F.col("x.text").alias("text"), F.col("x.entity_type").alias("entity_type"))
    names = pseudonymize_corpus(rows.select("doc_id", "seq", "text", "entity_type"))
    named = rows.join(by_shuffle(names), ["text", "entity_type"]).select("doc_id", F.col("x").withField("replacement", F.col("pseudonym")).alias("x"))
    arrays = named.groupBy("doc_id").agg(F.collect_list("x").alias("_named")).withColumnRenamed("doc_id", key)
    plain = F.transform(col, lambda x: x.withField("replacement", F.lit(None).cast("string")))
    return docs.join(by_shuffle(arrays), key, "left").withColumn(col, F.coalesce("_named", plain)).drop("_named")


# ---- overlaps ---------------------------------------------------------------------

def overlap_pairs(entities: DataFrame, bucket: int = 1024) -> DataFrame:
    """Pairs (a before b in document order) of overlapping spans of a document.

    A range join on (doc_id, position bucket): each span is listed under every
    bucket it touches, candidate pairs meet only inside shared buckets, and a
    pair is kept once, in the bucket holding the start of the overlap.  So no
    document's spans are compared all against all.
    """
    from redactflow.plans.joins import by_shuffle
    from redactflow.session import cut_lineage

    # both join sides read the same spans: materialized once
    b = cut_lineage(entities.select("doc_id", "idx", "start_char", "end_char",
                                    F.explode(F.sequence(F.floor(F.col("start_char") / bucket),
                                                         F.floor(F.greatest(F.col("end_char") - 1,
                                                                            F.col("start_char")) / bucket)))
                                    .alias("bk")))
    a, c = b.alias("a"), b.alias("c")
    cond = ((F.col("a.doc_id") == F.col("c.doc_id")) & (F.col("a.bk") == F.col("c.bk"))
            & (F.col("a.idx") < F.col("c.idx"))
            & (F.col("c.start_char") < F.col("a.end_char")) & (F.col("a.start_char") < F.col("c.end_char"))
            & (F.floor(F.greatest(F.col("a.start_char"), F.col("c.start_char")) / bucket) == F.col("a.bk")))
    return a.join(by_shuffle(c), cond).select(F.col("a.doc_id").alias("doc_id"), F.col("a.idx").alias("a_idx"),
                                              F.col("c.idx").alias("b_idx"))


# ---- feedback ---------------------------------------------------------------------

def feedback_records(df: DataFrame, text: Column, entity: Column, entity_type: Column, feedback_type: Column,
                     domain: Column | None = None, user_id: Column | None = None,
                     timestamp: Column | None = None) -> DataFrame:
    """Feedback rows with the defaults of the reference (domain ``general``,
    user ``system``); ``timestamp`` defaults to the run's current time."""
    return df.select(
        (timestamp if timestamp is not None else F.date_format(F.current_timestamp(),
                                                               "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        text.alias("text"), entity.alias("entity"), entity_type.alias("entity_type"),
        feedback_type.alias("feedback_type"),
        F.coalesce(domain if domain is not None else F.lit(None), F.lit(DEFAULT_DOMAIN)).alias("domain"),
        F.coalesce(user_id if user_id is not None else F.lit(None), F.lit(DEFAULT_USER)).alias("user_id"),
    )


def feedback_append(records: DataFrame, path: str) -> None:
    """Append feedback records to the feedback table (parquet, append-only)."""
    records.write.mode("append").parquet(path)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """SQL form: one row per feedback type present, with the total."""
    counts = feedback.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))
    # the total is one row from partial sums; no window gathers the kinds in one task
    return counts.crossJoin(F.broadcast(feedback.agg(F.count(F.lit(1)).alias("total_feedback"))))


def feedback_stats_zero_filled(feedback: DataFrame) -> DataFrame:
    """JSON form: total plus missed / over_scrubbed / correct, absent kinds as 0."""
    return feedback.agg(F.count(F.lit(1)).alias("total_feedback"),
                        *[F.count_if(F.col("feedback_type") == t).alias(t) for t in FEEDBACK_TYPES])


def feedback_by_domain(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("domain", "feedback_type").agg(F.count(F.lit(1)).alias("n"))


def feedback_flag_entities(feedback: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity type: feedback on detected entities (correct, over_scrubbed,
    precision = correct / (correct + over_scrubbed)) and missed reports."""
    keys = entities.select(F.col("text").alias("entity"), "entity_type").distinct()
    hit = feedback.join(keys, ["entity", "entity_type"], "left_semi")
    return (hit.groupBy("entity_type").agg(
        F.count_if(F.col("feedback_type") == "correct").alias("correct"),
        F.count_if(F.col("feedback_type") == "over_scrubbed").alias("over_scrubbed"),
        F.count_if(F.col("feedback_type") == "missed").alias("missed"))
        .withColumn("precision", F.round(F.col("correct") / F.nullif(F.col("correct") + F.col("over_scrubbed"),
                                                                     F.lit(0)), 4)))


# ---- knowledge base ---------------------------------------------------------------

#: A knowledge state: hits of each type of each text.
KNOWLEDGE_SCHEMA = "entity_text string, entity_type string, hits long"


def knowledge_state(entities: DataFrame) -> DataFrame:
    """Hits per (text, type): what a knowledge table is derived from, and what can be merged."""
    return entities.groupBy(F.col("text").alias("entity_text"), "entity_type").agg(F.count(F.lit(1)).alias("hits"))


def knowledge_merge(*states: DataFrame) -> DataFrame:
    """The state of all rows that the states were made from, in any order."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, [s.select("entity_text", "entity_type", "hits") for s in states])
    return both.groupBy("entity_text", "entity_type").agg(F.sum("hits").alias("hits"))


def knowledge_view(state: DataFrame) -> DataFrame:
    """entity_text -> most frequent type (ties: smallest name), frequency = all hits."""
    return (state.groupBy("entity_text")
            .agg(F.min(F.struct(-F.col("hits"), F.col("entity_type"))).alias("_best"), F.sum("hits").alias("frequency"))
            .select("entity_text", F.col("_best.entity_type").alias("entity_type"), F.col("frequency").cast("long").alias("frequency")))


def knowledge_build(entities: DataFrame) -> DataFrame:
    """The knowledge table of ``entities``."""
    return knowledge_view(knowledge_state(entities))


def knowledge_upsert(state: DataFrame, entities: DataFrame) -> DataFrame:
    """The state with new hits merged in.  It keeps the hits of every type, so
    the view of it is the table that a build over all rows would give."""
    return knowledge_merge(state, knowledge_state(entities))


def store_knowledge(entities: DataFrame, path: str, version: int) -> DataFrame:
    """Add the hits of ``entities`` as ``version`` of the state table at ``path`` and return the
    merged state.  A version holds its own hits only, so writing one costs nothing of the others."""
    from redactflow.plans.versions import read_versions, write_version

    write_version(knowledge_state(entities), path, version)
    return knowledge_merge(read_versions(entities.sparkSession, path, KNOWLEDGE_SCHEMA, before=version + 1))


def knowledge_lookup(entities: DataFrame, kb: DataFrame, max_broadcast_bytes: int | None = None) -> DataFrame:
    """Exact, case-sensitive lookup of each entity text; misses give nulls.

    A stored knowledge table can be broadcast after its size is checked
    (``max_broadcast_bytes``); otherwise the join shuffles on the text.
    """
    from redactflow.plans.joins import by_shuffle, sized_broadcast

    k = kb.select(F.col("entity_text").alias("text"), F.col("entity_type").alias("kb_type"),
                  F.col("frequency").alias("kb_frequency"))
    k = by_shuffle(k) if max_broadcast_bytes is None else sized_broadcast(k, max_broadcast_bytes)
    return entities.join(k, "text", "left")


def merge_overlaps_table(entities: DataFrame, id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Islands of overlapping spans from the entity table (rows with ``idx``,
    ``start_char``, ``end_char``, ``entity_type``).

    Row form of ``redact.merge_overlaps`` for documents with very many
    entities: a span opens a new island when it starts at or after the
    largest end before it, and an island's number is that of the spans that
    opened one.  Both are segmented prefix scans over ranges of (document,
    idx), so one huge document spreads over tasks.
    """
    from redactflow.plans.versions import in_ranges, running_before
    from redactflow.session import cut_lineage

    spans = in_ranges(entities.select(id_col, "idx", "start_char", "end_char", "entity_type"), id_col, "idx", ranges)
    spans = running_before(spans, id_col, "idx", F.col("end_char"), F.max, F.greatest, "_reach")
    opens = F.when(F.col("_reach").isNull() | (F.col("start_char") >= F.col("_reach")), 1).otherwise(0)
    # two branches of the next scan read these rows
    spans = cut_lineage(spans.withColumn("_open", opens))
    spans = running_before(spans, id_col, "idx", F.col("_open"), F.sum, lambda a, b: a + b, "_before")
    island = F.coalesce("_before", F.lit(0)) + F.col("_open")
    return (spans.groupBy(id_col, island.alias("_island"))
            .agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"),
                 F.count(F.lit(1)).alias("n_spans"), F.min_by("entity_type", "idx").alias("entity_type"))
            .drop("_island"))

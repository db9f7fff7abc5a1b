"""F9 feedback / knowledge / domain patterns, F11 terms and greedy annotation."""

from pyspark.sql import functions as F

from redactflow.operators import redact as R
from redactflow.operators.boost import domain_pattern_lookup
from redactflow.operators.report import (feedback_stats, feedback_stats_zero_filled, knowledge_build,
                                         knowledge_lookup, overlap_pairs, pseudonymize_corpus)


def test_f9_feedback(spark):
    fb = spark.createDataFrame([("missed",), ("missed",), ("correct",), ("other",)], "feedback_type string")
    assert {r.feedback_type: (r.n, r.total_feedback) for r in feedback_stats(fb).collect()} == {
        "missed": (2, 4), "correct": (1, 4), "other": (1, 4)}
    z = feedback_stats_zero_filled(fb).first()
    assert (z.total_feedback, z.missed, z.over_scrubbed, z.correct) == (4, 2, 0, 1)


def test_f9_knowledge(spark):
    ents = spark.createDataFrame([("Ann Lee", "PERSON_NAME"), ("Ann Lee", "PERSON_NAME"), ("Ann Lee", "EMAIL")],
                                 "text string, entity_type string")
    kb = knowledge_build(ents)
    assert [tuple(r) for r in kb.collect()] == [("Ann Lee", "PERSON_NAME", 3)]
    q = spark.createDataFrame([("Ann Lee",), ("ann lee",)], "text string")
    got = {r.text: r.kb_type for r in knowledge_lookup(q, kb).collect()}
    assert got == {"Ann Lee": "PERSON_NAME", "ann lee": None}


def test_f9_domain_lookup_last_wins(spark):
    pats = spark.createDataFrame([(1, "general", "tok", "a+", 0.1), (2, "general", "tok", "b+", 0.2),
                                  (3, "legal", "x", "c", 0.3)],
                                 "id long, domain string, pattern_name string, pattern_regex string, confidence_boost double")
    assert [tuple(r) for r in domain_pattern_lookup(pats, "general").collect()] == [("tok", "b+", 0.2)]


def test_f11_terms(spark):
    md = F.array(F.struct(F.lit("Ann").alias("original_text"), F.lit("PERSON_NAME").alias("entity_type")),
                 F.struct(F.lit("Ann Lee").alias("original_text"), F.lit("PERSON_NAME").alias("entity_type")))
    out = spark.range(1).select(R.redact_terms(F.lit("Ann Lee and Ann"), R.term_replacements(md, "full"))).first()[0]
    assert out == "███████ and ███"


def test_f11_greedy(spark):
    arr = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(0).alias("window_id"))
                    for s, e in [(0, 10), (5, 8), (10, 12)]])
    got = spark.range(1).select(R.greedy_nonoverlap(arr).alias("g")).first().g
    assert [(x.s, x.e) for x in got] == [(0, 10), (10, 12)]


def test_overlap_pairs_bucket_edges(spark):
    rows = [(1, 0, 1020, 1030), (1, 1, 1025, 2050), (1, 2, 2049, 2051), (1, 3, 3000, 3001), (2, 0, 0, 5)]
    ents = spark.createDataFrame(rows, "doc_id long, idx long, start_char long, end_char long")
    got = sorted(tuple(r) for r in overlap_pairs(ents, bucket=1024).collect())
    assert got == [(1, 0, 1), (1, 1, 2)]


def test_corpus_pseudonyms_match_single_window(spark):
    rows = [(d, q, f"t{(d * 7 + q) % 13}", ["EMAIL", "PERSON", "PERSON_NAME", "PHONE"][(d + q) % 4])
            for d in range(40) for q in range(5)]
    ents = spark.createDataFrame(rows, "doc_id long, seq long, text string, entity_type string")
    got = {(r.text, r.entity_type): r.pseudonym for r in pseudonymize_corpus(ents, ranges=3).collect()}
    first = {}
    for d, q, t, ty in sorted(rows):
        first.setdefault((t, ty), (d, q))
    want, counters = {}, {}
    for key, pos in sorted(first.items(), key=lambda kv: (kv[1], kv[0])):
        p = "USER_" + key[1][:3].upper()
        counters[p] = counters.get(p, 0) + 1
        want[key] = f"{p}_{counters[p]}"
    assert got == want


def test_merge_overlaps_table_equals_array_form(spark):
    from redactflow import tables as TB
    from redactflow.operators.report import merge_overlaps_table
    from redactflow.plans.scrub import detect, entity_rows
    d = detect(TB.documents(spark, "/root/testdata/sf0.01"))
    arr = (d.select("doc_id", F.explode(R.merge_overlaps(R.document_order(F.col("entities")))).alias("m"))
           .select("doc_id", F.col("m.s").cast("long").alias("start_char"), F.col("m.e").cast("long").alias("end_char"),
                   F.col("m.n").cast("long").alias("n_spans"), F.col("m.entity_type").alias("entity_type")))
    rows = merge_overlaps_table(entity_rows(d)).select("doc_id", "start_char", "end_char", "n_spans", "entity_type")
    assert arr.exceptAll(rows).count() == 0 and rows.exceptAll(arr).count() == 0


def test_domain_patterns_join_path_equals_literal_path(spark):
    from redactflow import tables as TB
    from redactflow.catalog import domain_patterns
    from redactflow.operators.boost import detect_domain_patterns
    docs = TB.documents(spark, "/root/testdata/sf0.01")
    a = detect_domain_patterns(docs, domain_patterns(spark), "general")           # patterns as literals
    b = detect_domain_patterns(docs, domain_patterns(spark), "general", max_patterns=1)  # joined
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_apply_domain_boost(spark):
    from redactflow.catalog import domain_patterns
    from redactflow.operators.boost import apply_domain_boost
    ents = spark.createDataFrame([("general", "4111111111111111", 0.98), ("general", "a@b.co", 0.98),
                                  ("legal", "4111111111111111", 0.98)], "domain string, text string, confidence double")
    got = [round(r.confidence, 4) for r in apply_domain_boost(ents, domain_patterns(spark)).orderBy("domain", "text").collect()]
    assert got == [0.99, 0.98, 0.98]


def test_knowledge_upsert(spark):
    from redactflow.operators.report import knowledge_state, knowledge_upsert, knowledge_view
    old = knowledge_state(spark.createDataFrame([("Ann Lee", "PERSON_NAME")], "text string, entity_type string"))
    new = spark.createDataFrame([("Ann Lee", "EMAIL"), ("Ann Lee", "EMAIL"), ("Bo", "PHONE")],
                                "text string, entity_type string")
    got = {r.entity_text: (r.entity_type, r.frequency) for r in knowledge_view(knowledge_upsert(old, new)).collect()}
    assert got == {"Ann Lee": ("EMAIL", 3), "Bo": ("PHONE", 1)}
